"""What a Python worker remembers between batches, bounded by bytes, and tokenizers built once in a worker."""

from __future__ import annotations

import os
from collections.abc import Callable, Hashable, Iterable

#: Bytes that one generation of a worker's memory holds; there are two, the older one is dropped.
GENERATION = 48_000_000
#: A remembered key takes about so many bytes beside its own and its value's; longer keys are not remembered.
EACH, LONGEST = 200, 256


class Remembered:
    """Values of keys that were met lately. `make` gives the values of a list of new keys, `size` is about the bytes of a value.

    Two generations: a full young one becomes the old one, whose entries are taken over when they are met again.
    """

    def __init__(self, make: Callable[[list], Iterable], size: int, most: int = GENERATION):
        self.make, self.size, self.most = make, size, most
        self.young: dict = {}
        self.old: dict = {}
        self.held = 0

    def of(self, keys: set) -> dict:
        """A dictionary that has the values of all keys."""
        if self.held > self.most:
            self.old, self.young, self.held = self.young, {}, 0
        new, got = [], {}
        for key in keys.difference(self.young):
            if key in self.old:
                got[key] = self.old[key]
            else:
                new.append(key)
        got.update(zip(new, self.make(new), strict=True) if new else ())
        apart = {key: got.pop(key) for key in new if len(key) > LONGEST}
        self.young.update(got)
        self.held += sum(map(len, got)) + (self.size + EACH) * len(got)
        return self.young | apart if apart else self.young


_BUILT: dict = {}


def built(key: Hashable, make: Callable[[], object]) -> object:
    """make() once in a Python worker, for the last few keys."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has its own core, and workers are forked
    if key not in _BUILT:
        if len(_BUILT) > 3:
            _BUILT.clear()
        _BUILT[key] = make()
    return _BUILT[key]

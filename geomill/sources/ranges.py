"""Parts of files by offset, from inside tasks: wherever Spark lists files, without taking whole ones."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Callable, Iterable

from pyarrow import fs


def located(path: str) -> tuple[fs.FileSystem, str]:
    """File system and place in it of a path as Spark's file listing gives it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class Ranged:
    """A file whose bytes are read on demand, in blocks that are kept; `taken` counts the bytes read."""

    def __init__(self, path: str, block: int = 256, system: fs.FileSystem | None = None) -> None:
        system, place = (system, path) if system else located(path)
        self.file, self.block, self.taken = system.open_input_file(place), block, 0
        self.size = self.file.size()
        self.blocks: dict[int, bytes] = {}

    def __enter__(self) -> Ranged:
        return self

    def __exit__(self, *_: object) -> None:
        self.file.close()

    def read(self, at: int, size: int) -> bytes:
        """Bytes from `at` on; fewer at the end of the file."""
        if size <= 0 or at < 0:
            return b""
        first, last = at // self.block, (at + size - 1) // self.block
        for i in range(first, last + 1):
            if i not in self.blocks:
                self.blocks[i] = self.file.read_at(self.block, i * self.block) if i * self.block < self.size else b""
                self.taken += len(self.blocks[i])
        whole = b"".join(self.blocks[i] for i in range(first, last + 1))
        return whole[at - first * self.block :][:size]

    def unpack(self, form: str, at: int) -> tuple:
        """Values of a struct at an offset; struct.error beyond the end."""
        return struct.unpack(form, self.read(at, struct.calcsize(form)))


def put(folder: str, name: str, parts: Iterable[bytes], check: Callable[[Ranged], None] = lambda _: None) -> int:
    """Write a file under a name of its own, check it and move it into place; its bytes.

    A task that runs again replaces the file, a lost one leaves no half file under the name, one that fails nothing.
    """
    system, place = located(folder)
    system.create_dir(place, recursive=True)
    aside = f"{place}/.{name}.{uuid.uuid4().hex}"
    try:
        with system.open_output_stream(aside) as out:
            for p in parts:
                out.write(p)
        with Ranged(aside, system=system) as f:
            check(f)
            size = f.size
        system.move(aside, f"{place}/{name}")
    except BaseException:
        if system.get_file_info(aside).type == fs.FileType.File:
            system.delete_file(aside)
        raise
    return size

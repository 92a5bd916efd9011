"""Byte-level BPE: encoding with a hierarchical-bitmap rank queue over many pre-tokens at once, and decoding."""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geomill.llm.common import bounded_batches, give_back, slices

#: Bytes of pre-tokens and ids that one generation of a worker's memory holds; there are two, the older one is dropped.
GENERATION = 48_000_000
#: A remembered pre-token takes about so many bytes beside its own and its ids'; longer ones are not remembered.
EACH, LONGEST = 160, 256
#: Bytes of text whose new pre-tokens are merged together.
TOGETHER = 4_000_000
_NONE = np.iinfo(np.int32).max


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """Token bytes to rank, from lines of base64 token and rank."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}


class Merger:
    """Merges by rank. A pair of tokens has the rank of the token that their bytes make, if there is one."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.n = len(self.tokens)
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left * (self.n + 1) + right] = rank
        self.keys = np.array(sorted(pairs), np.int64)
        self.made = np.array([pairs[k] for k in self.keys.tolist()], np.int32)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of neighbours, _NONE where no token is made of them."""
        key = left * (self.n + 1) + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.made[at], _NONE)

    def merge(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The ids of each pre-token.

        All pre-tokens lie in one array of parts, a doubly linked list with a stop behind each pre-token. Pairs wait in
        buckets by merge rank, which hold positions of the list. The bitmap has two levels: a bit for each word of 64
        ranks, and inside a word the ranks themselves. Find-first-set names the first word in which anything waits;
        each pre-token takes its own lowest rank there and works off all places of it, from left to right. What
        waits longer stays in the bucket, and an entry whose pair has changed since is skipped.
        """
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        start = np.r_[0, np.cumsum(size + 1)]
        total = int(start[-1])
        token = np.full(total, self.n, np.int64)  # the stop, of which no pair is made
        owner = np.repeat(np.arange(len(pieces)), size + 1)
        inside = np.ones(total, bool)
        inside[start[1:] - 1] = False
        token[inside] = self.byte[np.frombuffer(b"".join(pieces), np.uint8)]
        after, before = np.arange(1, total + 1), np.arange(-1, total - 1)
        rank = np.full(total, _NONE, np.int32)
        if total > 1:
            rank[:-1] = self.rank_of(token[:-1], token[1:])
        buckets: dict[int, list[np.ndarray]] = {}
        waiting = 0

        def put(spots: np.ndarray) -> int:
            word = rank[spots] >> 6
            order = np.argsort(word, kind="stable")
            spots, word = spots[order], word[order]
            edge = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            bits = 0
            for w, part in zip(word[edge].tolist(), np.split(spots, edge[1:]), strict=True):
                buckets.setdefault(w, []).append(part)
                bits |= 1 << w
            return bits

        first = np.flatnonzero(rank != _NONE)
        if len(first):
            waiting = put(first)
        while waiting:
            w = (waiting & -waiting).bit_length() - 1  # find first set
            spots = buckets.pop(w)
            spots = spots[0] if len(spots) == 1 else np.concatenate(spots)
            spots = np.sort(spots[rank[spots] >> 6 == w])
            if len(spots) > 1:
                spots = spots[np.r_[True, spots[1:] != spots[:-1]]]
            if not len(spots):
                waiting &= waiting - 1
                continue
            own, r = owner[spots], rank[spots]
            edge = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            if len(edge) < len(spots):
                least = np.minimum.reduceat(r, edge)
                now = r == np.repeat(least, np.diff(np.r_[edge, len(spots)]))
                left, spots = spots[~now], spots[now]
                # places of one rank that share a part: every other one of such a row, from its left end
                chained = np.r_[False, after[spots[:-1]] == spots[1:]]
                if chained.any():
                    i = np.arange(len(spots))
                    spots = spots[(i - np.maximum.accumulate(np.where(chained, 0, i))) % 2 == 0]
            else:
                left = spots[:0]
            if len(left):
                buckets[w] = [left]
            else:
                waiting &= waiting - 1
            gone = after[spots]
            then = after[gone]
            token[spots] = rank[spots]
            rank[gone] = _NONE
            inside[gone] = False
            after[spots] = then
            before[then] = spots  # a pre-token's last part is followed by its stop
            back = before[spots]
            back = back[back >= 0]
            changed = np.concatenate([spots, back[inside[back]]])
            rank[changed] = self.rank_of(token[changed], token[after[changed]])
            changed = changed[rank[changed] != _NONE]
            if len(changed):
                waiting |= put(changed)
        alive = np.flatnonzero(inside)
        ids = token[alive].astype("<u4")
        cut = np.searchsorted(alive, start[1:-1])
        return np.split(ids, cut)


class Memory:
    """Pre-token to its ids as packed little-endian unsigned 32-bit integers, for what was met lately.

    Two generations: a full young one becomes the old one, whose entries are taken over when they are met again.
    """

    def __init__(self, merger: Merger):
        self.merger = merger
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0

    def learn(self, pieces: set[str]) -> dict[str, bytes]:
        """A dictionary that has the ids of all pieces."""
        if self.held > GENERATION:
            self.old, self.young, self.held = self.young, {}, 0
        young, old = self.young, self.old
        new, got = [], {}
        for piece in pieces.difference(young):
            ids = old.get(piece)
            if ids is None:
                new.append(piece)
            else:
                got[piece] = ids
        # in order of length, so that those that end early do not wait in the arrays of long ones
        new.sort(key=len)
        got.update(zip(new, (x.tobytes() for x in self.merger.merge([x.encode() for x in new])), strict=True) if new else ())
        long = [x for x in new if len(x) > LONGEST]
        apart = {x: got.pop(x) for x in long}
        young.update(got)
        self.held += sum(map(len, got)) + sum(map(len, got.values())) + EACH * len(got)
        return young | apart if apart else young


_BUILT: dict = {}


def _tables(key, raw: bytes, pattern: str):
    """Built once in a Python worker."""
    if key not in _BUILT:
        _BUILT.clear()
        merger = Merger(read_ranks(raw))
        _BUILT[key] = (Memory(merger), merger.tokens, regex.compile(pattern).findall)
    return _BUILT[key]


def encode_documents(
    docs: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text", decoded: bool = False
) -> DataFrame:
    """Rows doc_id, ids: the token ids of each whole text as packed little-endian unsigned 32-bit integers.

    With `decoded`, also what decode_documents would give for the ids, in the same pass and so by half the workers.

    Each match of `pattern` is encoded separately and there are no special tokens. The new pre-tokens of some megabytes
    of text are merged together, and a worker remembers those that it met lately. The vocabulary file is read once
    on the driver and broadcast; its size does not depend on the data. Null text: as the empty text, no ids. Repeated
    rows: one result each. Empty table: no rows. Other columns are not carried.
    """
    with open(ranks_path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = docs.schema[key].dataType.simpleString()
    bounded_batches(docs.sparkSession)

    def scan(batches):
        memory, tokens, find = _tables((ranks_path, pattern), shared.value, pattern)
        for batch in batches:
            for part in slices(batch, "text", TOGETHER):
                found = [find(x) if x else [] for x in part.column("text").to_pylist()]
                known = memory.learn(set().union(*found)).__getitem__
                ids = [b"".join(map(known, x)) for x in found]
                del found
                columns = {"doc_id": part.column("doc_id"), "ids": pa.array(ids, pa.binary())}
                if decoded:
                    columns["decoded"] = pa.array([_joined(x, tokens) for x in ids], pa.binary())
                yield pa.RecordBatch.from_pydict(columns)
        give_back()

    d = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return d.mapInArrow(scan, f"doc_id {kind}, ids binary" + ", decoded binary" * decoded)


def _joined(packed: bytes, tokens: list[bytes]) -> bytes:
    """The bytes of packed ids."""
    return b"".join(map(tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))


def decode_documents(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """Rows of encode_documents with the column decoded: the bytes of each id joined. An unknown id is an error."""
    with open(ranks_path, "rb") as f:
        shared = encoded.sparkSession.sparkContext.broadcast(f.read())
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def scan(batches):
        ranks = read_ranks(shared.value)
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        for batch in batches:
            for part in slices(batch, "ids"):
                raw = part.column("ids").to_pylist()
                out = [_joined(x, tokens) for x in raw]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("ids"), pa.array(out, pa.binary())], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(scan, f"doc_id {kind}, ids binary, decoded binary")


def digests(decoded: DataFrame, ids: bool = False) -> DataFrame:
    """Rows of decode_documents as doc_id, n_tokens, ids_sha256, decoded_sha256, and the ids themselves if asked for."""
    return decoded.select(
        "doc_id", *["ids"] * ids, F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


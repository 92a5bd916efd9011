"""What the operators of this subpackage share: written stages, components, byte batches, word shingles."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geomill.operators.graph import rooted as components
from geomill.operators.stages import discard, shared_dir, tidy, written

__all__ = ["components", "discard", "shared_dir", "tidy", "written"]

#: A side is broadcast only when it is counted to have no more rows, and measured to have no more bytes, than these.
BROADCAST_ROWS, BROADCAST_BYTES = 300_000, 16_000_000

def bounded_batches(spark: SparkSession, most: str = "8m") -> None:
    """Texts reach Python in batches of so many bytes, not only of so many rows: a worker's memory is bounded by it.

    The setting is read when a query runs, which is after the operator has returned, so it stays with the session.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", most)


def small_or_not(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `limit` rows and BROADCAST_BYTES bytes, else as it is.

    Rows are measured by their JSON, which takes about as much as a row of the broadcast table or more.
    """
    few = df.limit(limit + 1).agg(F.count("*"), F.coalesce(F.sum(F.length(F.to_json(F.struct("*"))).cast("long") + 16), F.lit(0))).first()
    return F.broadcast(df) if few[0] <= limit and few[1] <= BROADCAST_BYTES else df


# ---- bytes and words in Arrow batches -------------------------------------------------------------------------


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary array joined, and the n + 1 offsets of its rows. Null rows are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    if data is None or off[-1] == off[0]:
        return np.zeros(0, np.uint8), off - off[0]
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = x ^ np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}
_LETTERS = mixed(np.arange(1, 257, dtype=np.uint64), 11) | np.uint64(1)


def powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        have[0] = 1
        with np.errstate(over="ignore"):
            have = np.cumprod(have, dtype=np.uint64)
        _POWERS[base] = have
    return have[:n]


class Rolling:
    """Hashes of any slices of one byte array, from one prefix sum."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(_LETTERS[data] * powers(_INVERSE, n), out=self.sums[1:])
        self.powers = powers(_BASE, n + 1)

    def of(self, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed((self.sums[end] - self.sums[start]) * self.powers[start] + (end - start).astype(np.uint64), seed)


#: Separators of words: space, tab, line feed, vertical tab, form feed, carriage return.
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ASCII-lower-cased bytes, and start, end and row of each maximal run without white space."""
    low = _LOWER[data]
    gap = np.ones(len(data) + 1, bool)
    gap[:-1] = _SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[off[:-1]] = True  # a row's start ends the word before it
    inside = ~gap[:-1]
    begins = inside & (np.r_[True, gap[:-2]] | first[:-1]) if len(data) else inside
    ends = inside & (gap[1:] | first[1:]) if len(data) else inside
    start = np.flatnonzero(begins)
    end = np.flatnonzero(ends) + 1
    return low, start, end, np.searchsorted(off, start, "right") - 1


def shingles(data: np.ndarray, off: np.ndarray, k: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingle hashes of each row: values sorted within rows, and the n + 1 offsets.

    A row with words but fewer than k has its whole sequence as one shingle, or none unless `short`; a row without
    words has none.
    """
    n = len(off) - 1
    low, start, end, row = words(data, off)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    h = Rolling(low).of(start, end, 3)
    count = np.bincount(row, minlength=n)
    base = np.r_[0, np.cumsum(count)]
    i = np.arange(len(start)) - base[row]
    with np.errstate(over="ignore"):
        value = h * np.uint64(0x9E3779B97F4A7C15)
        for j in range(1, k):
            nxt = np.zeros(len(h), np.uint64)
            nxt[: len(h) - j] = h[j:]
            inside = i + j < count[row]  # beyond the end a short row adds nothing
            value = np.where(inside, mixed(value, j) + nxt * np.uint64(0xC2B2AE3D27D4EB4F), value)
    value = mixed(value, 5)
    use = i + k <= count[row]
    if short:
        use |= (i == 0) & (count[row] < k)
    value, row = value[use], row[use]
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    new = np.r_[True, (value[1:] != value[:-1]) | (row[1:] != row[:-1])]
    value, row = value[new], row[new]
    return value, np.r_[0, np.cumsum(np.bincount(row, minlength=n))]


def slices(batch: pa.RecordBatch, column: str, most: int = 1_000_000):
    """Parts of a batch with about `most` bytes in a column, so that work arrays stay bounded. One row is never cut."""
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0))
    edges = np.searchsorted(np.cumsum(size), np.arange(most, int(size.sum()) + most, most), "left") + 1
    at = 0
    for to in np.unique(np.minimum(np.r_[edges, len(size)], len(size))):
        if to > at:
            yield batch.slice(at, int(to) - at)
            at = int(to)
    give_back()


def _trimmer():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):  # another C library
        return lambda _: 0


_TRIM = _trimmer()


def give_back() -> None:
    """Freed memory goes back to the system: a worker lives on through stages, beside the heap of its executor."""
    pa.default_memory_pool().release_unused()
    _TRIM(0)


def packed(values: np.ndarray, off: np.ndarray) -> pa.Array:
    """Rows of fixed-width values as one binary array."""
    raw = np.ascontiguousarray(values)
    width = raw.dtype.itemsize
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(off) - 1, [None, pa.py_buffer((off * width).astype(np.int64)), pa.py_buffer(raw)]
    ).cast(pa.binary())


def with_type(name: str, kind: T.DataType, rest: str) -> T.StructType:
    """A schema of one column of a given type and others in DDL."""
    return T.StructType([T.StructField(name, kind), *T.StructType.fromDDL(rest).fields])

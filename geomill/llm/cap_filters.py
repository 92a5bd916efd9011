"""Near-duplicate vectors by spherical-cap filters from random product codes (Becker, Ducas, Gama, Laarhoven 2016)."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geomill.llm.common import components, small_or_not, written
from geomill.llm.near import runs

#: Blocks of a code, and filters of one code that a vector passes on average, at any number of vectors.
BLOCKS, LIST = 2, 16
#: The chance at most that a pair at the cosine asked for shares no filter; codes are added until it is met. Filters of
#: one code that share a block are not independent, so a code counts as SPREAD of what independent filters would give.
MISS, SPREAD = 1e-4, 0.25
#: Filters grow narrower with the number of vectors while a filter of one vector of a pair holds the other so often.
SHARED = 0.05
#: Blocks have at least so many coordinates; a single block has at most so many vectors, which are all tried.
WIDE, SINGLE = 4, 4096
#: From so many vectors of one filter on, pairs that share a smaller filter too are left to that one.
LARGE = 64


#: Vectors and codes are rounded to whole steps for decoding, so that products and sums are exact in doubles (up to 8,192
#: coordinates) and a vector passes the same filters whatever rows it is decoded with.
FINE = 2.0**-20


def _fine(x: np.ndarray) -> np.ndarray:
    return np.round(x / FINE) * FINE


@lru_cache(maxsize=64)
def code(number: int, dim: int, size: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """A random rotation, and `size` random unit vectors for each block of coordinates, in steps of FINE."""
    rng = np.random.default_rng([20161, number])
    turn = _fine(np.linalg.qr(rng.standard_normal((dim, dim)))[0])
    out = []
    for part in np.array_split(np.arange(dim), blocks_of(dim)):
        c = rng.standard_normal((size, len(part)))
        out.append(_fine(c / np.linalg.norm(c, axis=1, keepdims=True) * np.sqrt(len(part) / dim)))
    return turn, out


def blocks_of(dim: int) -> int:
    return max(1, min(BLOCKS, dim // WIDE))


def caught(threshold: float, angle: float, dim: int) -> float:
    """The chance that a random direction has an inner product of `threshold` or more with both of two unit vectors.

    Seen in their plane the direction has an even angle and a length of rho or more with chance (1 - rho^2)^((dim - 2) / 2).
    With angle 0 this is the size of a spherical cap.
    """
    if dim == 1:
        return 0.5
    most = np.arccos(threshold) - angle / 2
    if most <= 0:
        return 0.0
    turn = (np.arange(20_000) + 0.5) / 20_000 * most
    inside = np.clip(1 - (threshold / np.cos(turn + angle / 2)) ** 2, 0, 1)
    return float((inside ** ((dim - 2) / 2)).mean() * most / np.pi)


def _threshold(good) -> float:
    """The greatest threshold in (0, 1) that is good; smaller ones are good too."""
    lo, hi = 0.0, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if good(mid) else (lo, mid)
    return lo


@lru_cache(maxsize=256)
def code_size(n: int, dim: int, cosine: float = 0.95) -> tuple[int, int, float]:
    """Codes, vectors a block, and the threshold on the inner product, so that a filter holds a handful of n vectors.

    The threshold is the exact quantile of a spherical cap, so a vector passes LIST filters of a code on average at any
    n. Where filters that narrow would seldom hold both of a pair, or too many for a single block, as in few dimensions, they stay wider.
    """
    angle = float(np.arccos(np.clip(cosine, -1, 1)))
    blocks = blocks_of(dim)
    narrow = _threshold(lambda t: caught(t, angle, dim) >= SHARED * caught(t, 0.0, dim))
    cap = max(caught(narrow, 0.0, dim), 1 / max(n, 1000))
    size = max(16, int(np.ceil((LIST / cap) ** (1 / blocks))))
    size = min(size, SINGLE) if blocks == 1 else size
    threshold = _threshold(lambda t: caught(t, 0.0, dim) >= LIST / size**blocks)
    shared = size**blocks * caught(threshold, angle, dim)
    return max(1, int(np.ceil(-np.log(MISS) / (SPREAD * shared)))), size, threshold


def decode(unit: np.ndarray, codes_n: int, size: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Row and filter of all filter directions whose inner product with a unit vector reaches the threshold.

    Partial sums over the blocks are kept only where the best of the remaining blocks can still reach it.
    """
    rows, filters = [], []
    step = max(1, 4_000_000 // size)
    for number in range(codes_n):
        turn, codes = code(number, unit.shape[1], size)
        for lo in range(0, len(unit), step):
            x, at, scores = _fine(_fine(unit[lo : lo + step]) @ turn), 0, []
            for c in codes:
                scores.append(x[:, at : at + c.shape[1]] @ c.T)
                at += c.shape[1]
            rest = np.cumsum(np.stack([s.max(1) for s in [*scores[1:], np.zeros((len(x), 1))]], 1)[:, ::-1], 1)[:, ::-1]
            row, which, total = np.arange(len(x)), np.zeros(len(x), np.int64), np.zeros(len(x))
            for b, s in enumerate(scores):
                found = []
                for k in range(0, len(row), step):  # several partial sums a row may be left
                    own = row[k : k + step]
                    i, j = np.nonzero(total[k : k + step, None] + s[own] >= threshold - rest[own, b][:, None])
                    found.append((total[i + k] + s[own[i], j], which[i + k] * size + j, own[i]))
                total, which, row = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (total, which, row)
            rows.append(row + lo)
            filters.append(which + number * size ** len(codes))
    return np.concatenate(rows), np.concatenate(filters)


def _unit(raw: np.ndarray) -> np.ndarray:
    """Rows at length 1; by their largest component first, so that no square overflows or vanishes."""
    raw = raw.astype(np.float64)
    x = raw / np.abs(raw).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _filtered(n: int, cosine: float, kind: str):
    def scan(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                dims = part.column("dim").to_numpy()
                raw = part.column("raw").to_pylist()
                for dim in np.unique(dims):
                    own = np.flatnonzero(dims == dim)
                    x = np.frombuffer(b"".join(raw[i] for i in own), kind).reshape(len(own), dim)
                    row, which = decode(_unit(x), *code_size(n, int(dim), cosine))
                    for at in range(0, len(row), 20_000):
                        take = pa.array(own[row[at : at + 20_000]])
                        filt = which[at : at + 20_000] ^ (int(dim) << 48)
                        yield pa.RecordBatch.from_arrays([pa.array(filt), *(part.column(c).take(take) for c in ("id", "dim", "raw"))], ["filter", "id", "dim", "raw"])

    return scan


def _verified(n: int, cosine: float, kind: str):
    """Linked pairs of each filter, the smaller id first."""

    def pairs(x: np.ndarray, ids: np.ndarray, filt: int, dim: int):
        m = len(x)
        if m < LARGE:
            return
        row, which = decode(x, *code_size(n, dim, cosine))
        before = which < (filt ^ (dim << 48))
        row, which = row[before], np.unique(which[before], return_inverse=True)[1]
        passed = np.zeros((m, int(which.max()) + 1 if len(which) else 1), np.float32)
        passed[row, which] = 1
        for s in range(0, m, 1024):
            ok = x[s : s + 1024] @ x.T >= cosine
            ok &= passed[s : s + 1024] @ passed.T < 0.5
            i, j = np.nonzero(ok)
            up = i + s < j
            yield ids[i[up] + s], ids[j[up]]

    def scan(batches):
        for t, at in runs(batches, "filter"):
            ids, filt, dims = t.column("id").to_numpy(), t.column("filter").to_numpy(), t.column("dim").to_numpy()
            raw = t.column("raw").combine_chunks().to_pylist()
            size = np.diff(at)
            a, b = [], []
            for dim in np.unique(dims):
                own = np.flatnonzero((dims[at[:-1]] == dim) & (size > 1) & (size < LARGE))
                for k in np.unique(size[own]):
                    first = at[own[size[own] == k]]
                    p, q = np.triu_indices(k, 1)
                    step = max(1, 2_000_000 // (int(k) * int(dim)))
                    for s in range(0, len(first), step):
                        rows = first[s : s + step, None] + np.arange(k)
                        x = _unit(np.frombuffer(b"".join(raw[i] for i in rows.ravel()), kind).reshape(-1, dim)).reshape(len(rows), k, dim)
                        hit, pair = np.nonzero(np.matmul(x, x.transpose(0, 2, 1))[:, p, q] >= cosine)
                        a.append(ids[rows[hit, p[pair]]])
                        b.append(ids[rows[hit, q[pair]]])
            for r in np.flatnonzero(size >= LARGE):
                dim = int(dims[at[r]])
                x = _unit(np.frombuffer(b"".join(raw[at[r] : at[r + 1]]), kind).reshape(-1, dim))
                for u, v in pairs(x, ids[at[r] : at[r + 1]], int(filt[at[r]]), dim):
                    a.append(u)
                    b.append(v)
            if a:
                a, b = np.concatenate(a), np.concatenate(b)
                if len(a):
                    two = np.unique(np.c_[np.minimum(a, b), np.maximum(a, b)], axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(two[:, 0]), pa.array(two[:, 1])], ["a", "b"])

    return scan


def _raw(kind: str):
    """Vectors as packed numbers of their own kind, null where they are null, empty, zero or hold anything but finite numbers."""

    def scan(batches):
        for batch in batches:
            out = []
            for v in batch.column("v").to_pylist():
                x = None
                if v and all(c is not None for c in v):
                    x = np.array(v, kind) + np.array(0, kind)  # -0.0 is 0.0
                    x = x if np.isfinite(x).all() and x.any() else None
                out.append((0, None) if x is None else (len(x), x.tobytes()))
            if out:
                dims, raw = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(dims, pa.int32()), pa.array(raw, pa.binary())], ["vec_id", "dim", "raw"])

    return scan


def near_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = 0.95) -> DataFrame:
    """Link vectors of cosine `cosine` or more, in double precision, and name their components.

    Equal vectors are one class from the start. Each class is dealt to all filters it passes; inside a filter cosines
    are computed in blocks. A code grows with the square root of the number of vectors, so a filter holds a handful
    of unrelated ones at any size, and codes are as many as a miss chance of MISS needs. Returns vec_id, n_links (other vectors linked directly), component_id (smallest
    vec_id reachable), kept (vec_id = component_id).

    Null, empty or zero vectors and those with null or non-finite components link with nothing: n_links 0, their own
    component. Vectors of different lengths do not link. Null ids: no links, component null, kept. Rows that share an
    id: each has its own vector's links. Empty table: no rows. Other columns are not carried.
    """
    kind = vectors.schema[key].dataType.simpleString()
    single = vectors.schema[vector].dataType.simpleString() == "array<float>"  # floats travel as such and are compared as doubles
    packed = "f4" if single else "f8"
    v = F.col(vector) if single else F.col(vector).cast("array<double>")
    raw = vectors.select(F.col(key).cast("long").alias("vec_id"), v.alias("v")).mapInArrow(_raw(packed), "vec_id long, dim int, raw binary")
    raw = written(raw.withColumn("form", F.sha2("raw", 256)), "vectors")
    classes = raw.where("vec_id is not null and form is not null").groupBy("form").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"), F.min(F.struct("dim", "raw")).alias("r"))
    classes = written(classes.select(F.monotonically_increasing_id().alias("id"), "form", "least", "n", "r.*"), "classes")
    count = classes.count()
    dealt = classes.select("id", "dim", "raw").mapInArrow(_filtered(count, cosine, packed), "filter long, id long, dim int, raw binary")
    dealt = dealt.repartition("filter").sortWithinPartitions("filter", "id")
    pairs = written(dealt.mapInArrow(_verified(count, cosine, packed), "a long, b long").dropDuplicates(), "links")
    sides = pairs.union(pairs.select("b", "a"))
    many = classes.select(F.col("id").alias("b"), "n")
    links = sides.join(small_or_not(many), "b").groupBy("a").agg(F.sum("n").alias("links")).withColumnRenamed("a", "id")
    groups = components(pairs).select(F.col("node").alias("id"), "component")
    named = classes.select("id", "form", "least", "n").join(links, "id", "left").join(groups, "id", "left")
    lowest = named.where("component is not null").groupBy("component").agg(F.min("least").alias("low"))
    named = named.join(lowest, "component", "left")
    named = named.where("n > 1 or links is not null").select(
        "form", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("low", "least").alias("component_id")
    )
    out = raw.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("form")).alias("form")).join(small_or_not(named), "form", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        F.col("vec_id").cast(kind).alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.cast(kind).alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )

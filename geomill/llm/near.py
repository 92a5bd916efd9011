"""Near-duplicate machinery: MinHash signatures, colliding keys, and exact classes inside candidate groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geomill.llm.common import components, give_back, mixed, small_or_not, written

_ANY = mixed(np.arange(1, 1025, dtype=np.uint64), 101)
_ODD = mixed(np.arange(1, 1025, dtype=np.uint64), 202) | np.uint64(1)


def minhash(values: np.ndarray, off: np.ndarray, k: int, first: int = 0) -> np.ndarray:
    """k minima of each nonempty row of `values`, from the one numbered `first`, one row of the result each."""
    start = off[:-1][np.diff(off) > 0]
    out = np.empty((len(start), k), np.uint64)
    if len(start):
        with np.errstate(over="ignore"):
            for j in range(k):
                out[:, j] = np.minimum.reduceat((values ^ _ANY[first + j]) * _ODD[first + j], start)
    return mixed(out, 7)


def set_hash(values: np.ndarray, off: np.ndarray) -> pa.Array:
    """A 128-bit hash of each nonempty row of distinct values, whatever their order."""
    start = off[:-1][np.diff(off) > 0]
    two = np.empty((len(start), 2), np.uint64)
    if len(start):
        with np.errstate(over="ignore"):
            two[:, 0] = np.add.reduceat(mixed(values, 21), start)
            two[:, 1] = np.add.reduceat(mixed(values, 22), start)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(start), [None, pa.py_buffer(two)]).cast(pa.binary())


def rows_of(col: pa.Array, width: int) -> np.ndarray:
    """A binary array of equal widths as a matrix of bytes."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, np.int32)[col.offset]
    return np.frombuffer(data, np.uint8)[at : at + len(col) * width].reshape(len(col), width)


def runs(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole runs of a sorted column, with the n + 1 starts of the runs; a run is never cut between tables."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(column).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(key, key[-1], "left"))  # the last run may go on
        if cut == 0 and held and held[-1].column(column)[-1].as_py() == key[0]:
            held.append(batch)
            continue
        if held or cut:
            yield _whole([*held, batch.slice(0, cut)], column)
        held = [batch.slice(cut)]
    if held:
        yield _whole(held, column)
    give_back()


def _whole(parts: list[pa.RecordBatch], column: str) -> tuple[pa.Table, np.ndarray]:
    t = pa.Table.from_batches(parts).combine_chunks()
    key = t.column(column).to_numpy()
    return t, np.r_[0, np.flatnonzero(key[1:] != key[:-1]) + 1, len(key)]


def spanning(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Edges that join what `near` joins: breadth-first, each node against the nodes not reached so far only."""
    edges, left = [], np.arange(n)
    while len(left):
        front, left = [int(left[0])], left[1:]
        while front and len(left):
            x = front.pop()
            hit = near(x, left)
            if hit.any():
                got = left[hit]
                edges += [(x, int(y)) for y in got]
                front += got.tolist()
                left = left[~hit]
    return edges


def collisions(keys: DataFrame, kind: str, differing: int | None = None, size_ratio: tuple[int, int] | None = None) -> DataFrame:
    """Edges (a, b) that connect the ids sharing a key.

    keys: key long, id, and with `differing` also n int and sig binary: then only ids whose signatures differ in no
    more than so many bytes, and whose set sizes allow the similarity, are connected. Inside a key the edges are a
    spanning forest, so there are never more than rows.
    """

    def star(batches):
        for t, at in runs(batches, "key"):  # around the first id
            size = np.diff(at)
            first = np.repeat(at[:-1], size)
            keep = (first != np.arange(len(first))) & np.repeat(size > 1, size)
            if keep.any():
                ids = _column(t, "id")
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(first[keep])), ids.take(pa.array(np.flatnonzero(keep)))], ["a", "b"])

    def by_signature(t: pa.Table):
        sig, n = rows_of(_column(t, "sig"), 64), t.column("n").to_numpy().astype(np.int64)
        num, den = size_ratio

        def near(x, ys):
            lo, hi = np.minimum(n[x], n[ys]), np.maximum(n[x], n[ys])
            return ((sig[ys] != sig[x]).sum(1) <= differing) & (den * lo >= num * hi)

        return near

    if differing is None:
        dealt = keys.repartition("key").sortWithinPartitions("key", "id")
        return dealt.mapInArrow(star, f"a {kind}, b {kind}").dropDuplicates()
    dealt = keys.repartition("key").sortWithinPartitions("key", "id")
    return dealt.mapInArrow(_searched("key", by_signature), f"a {kind}, b {kind}").dropDuplicates()


def _column(t: pa.Table, name: str) -> pa.Array:
    c = t.column(name).combine_chunks()
    return c.chunk(0) if isinstance(c, pa.ChunkedArray) else c


def _searched(unit: str, similar: Callable[[pa.Table], Callable]):
    """For runs of rows with one unit: the edges of a spanning forest of what `similar` links."""

    def scan(batches):
        for t, at in runs(batches, unit):
            size = np.diff(at)
            big = np.flatnonzero(size > 1)
            if not len(big):
                continue
            near, ids, pairs = similar(t), _column(t, "id"), []
            two = at[big[size[big] == 2]]
            if len(two):
                ok = near(two, two + 1)
                pairs.append(np.c_[two[ok], two[ok] + 1])
            for r in big[size[big] > 2]:
                base = int(at[r])
                got = spanning(int(size[r]), lambda x, ys, base=base, near=near: near(x + base, ys + base))
                if got:
                    pairs.append(np.array(got, np.int64) + base)
            if sum(map(len, pairs)):
                a, b = np.concatenate(pairs).T
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(a)), ids.take(pa.array(b))], ["a", "b"])

    return scan


def _by_elements(num: int, den: int, differing: int):
    """Links of rows (sig, elements) by exact Jaccard; far signatures are ruled out before sets are intersected."""

    def similar(t: pa.Table):
        sig, raw = rows_of(_column(t, "sig"), 64), _column(t, "elements")
        _, offsets, data = raw.buffers()
        edge = np.frombuffer(offsets, np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64) // 8
        values = np.frombuffer(data, np.uint64, count=int(edge[-1]))
        size = np.diff(edge)

        def one(x: int, ys: np.ndarray) -> np.ndarray:
            ok = (sig[ys] != sig[x]).sum(1) <= differing
            ok &= den * np.minimum(size[x], size[ys]) >= num * np.maximum(size[x], size[ys])
            some = ys[ok]
            if len(some):
                own, n = values[edge[x] : edge[x + 1]], size[some]
                base = np.r_[0, np.cumsum(n)]
                other = values[np.repeat(edge[some] - base[:-1], n) + np.arange(base[-1])]
                spot = np.searchsorted(own, other)
                hit = own[np.minimum(spot, len(own) - 1)] == other
                both = np.add.reduceat(hit.astype(np.int64), base[:-1])
                ok[ok] = den * both >= num * (size[x] + n - both)
            return ok

        def near(x, ys):
            if np.ndim(x):
                return np.array([one(int(p), np.array([q]))[0] for p, q in zip(x, ys, strict=True)], bool)
            return one(int(x), ys)

        return near

    return similar


#: Rows of one group that a task compares at most; bigger groups are split into blocks of about so many.
LARGE = 1000
_PIVOTS = 8


def exact_classes(sets: DataFrame, kind: str, num: int, den: int, differing: int, large: int = LARGE) -> DataFrame:
    """Rows (id, root) for the ids that an exact Jaccard of num/den or more links with another id of their group.

    sets: grp, id, sig binary of 64 bytes, elements binary (sorted distinct unsigned 64-bit values). root is the least
    id of the class.

    A group of more than `large` rows is split into blocks. First every block is searched together with a few pivots of
    the group, twice, the second time with the nodes that reached most others, so that a group around a common original
    becomes one class in linear work. Then the rows outside the group's largest class meet all blocks: two rows inside
    it are connected already, and every other pair is compared in some task. No task holds a whole group.
    """
    schema = f"a {kind}, b {kind}"
    similar = _by_elements(num, den, differing)

    def searched(rows: DataFrame) -> DataFrame:
        return rows.repartition("unit").sortWithinPartitions("unit", "id").mapInArrow(_searched("unit", similar), schema)

    sets = written(sets, "sets")
    counts = sets.groupBy("grp").agg(F.count("*").alias("rows"))
    big = written(counts.where(F.col("rows") > large).select("grp", F.ceil(F.col("rows") / large).cast("int").alias("blocks")), "big")
    small = sets.join(small_or_not(big.select("grp")), "grp", "left_anti")
    edges = searched(small.withColumn("unit", F.col("grp")))
    if not big.isEmpty():
        rows = sets.join(small_or_not(big), "grp").withColumn("h", F.xxhash64("id"))
        rows = written(rows.withColumn("block", F.pmod("h", F.col("blocks")).cast("int")), "blocks")

        def with_pivots(pivots: DataFrame) -> DataFrame:
            to_all = rows.join(small_or_not(pivots), ["grp", "id"], "left_semi").withColumn("to", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            to_all = to_all.where("to <> block").drop("block").withColumnRenamed("to", "block").select(*rows.columns)
            return searched(rows.union(to_all).withColumn("unit", F.xxhash64("grp", "block")))

        slot = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(_PIVOTS))
        pivots = rows.groupBy("grp", slot.alias("slot")).agg(F.min(F.struct("h", "id")).alias("p")).select("grp", "p.id").distinct()
        first = written(with_pivots(pivots), "first")
        reached = first.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("n")).join(rows.select("grp", "id"), "id")
        pivots = reached.groupBy("grp", slot.alias("slot")).agg(F.max(F.struct("n", "id")).alias("p")).select("grp", "p.id").distinct()
        first = written(first.union(with_pivots(pivots)), "first")
        label = components(first).select(F.col("node").alias("id"), "component")
        place = written(rows.select("grp", "id", "block", "blocks").join(label, "id", "left").withColumn("component", F.coalesce("component", "id")), "place")
        main = place.groupBy("grp", "component").agg(F.count("*").alias("n")).groupBy("grp").agg(F.max_by("component", F.struct("n", "component")).alias("component"))
        rest = place.join(main.select("grp", F.col("component").alias("main")), "grp").where("component <> main").select("grp", "id")
        rest = rest.withColumn("part", F.pmod(F.xxhash64("id", F.lit(2)), F.lit(1 << 30)))
        parts = rest.groupBy("grp").agg(F.ceil(F.count("*") / large).cast("int").alias("parts"))
        rest = written(rest.join(parts, "grp").select("grp", "id", F.pmod("part", F.col("parts")).cast("int").alias("part")), "rest")
        if not rest.isEmpty():
            own = rows.join(small_or_not(rest), ["grp", "id"]).withColumn("to", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            own = own.where("to <> block").select("grp", "id", "sig", "elements", F.col("to").alias("block"), "part")
            every = rows.join(small_or_not(parts), "grp").select("grp", "id", "sig", "elements", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
            edges = edges.union(searched(own.union(every).withColumn("unit", F.xxhash64("grp", "block", "part"))))
        edges = edges.union(first)
    return components(edges).select(F.col("node").alias("id"), F.col("component").alias("root"))


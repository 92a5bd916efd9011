"""Exact substring deduplication by prefix-free parsing.

A rolling hash over GRAM bytes sets triggers: in every window of LENGTH bytes the gram with the least hash (the last one
on ties). Triggers depend on the bytes of the window alone, so equal windows have their trigger at the same offset, and
the windows of one trigger form a phrase that starts and ends by content. The parse is the sequence of phrases of each
document, the dictionary the distinct ones. Only grams that occur with different phrases need sorting: their phrases'
windows are put in suffix order inside the gram's group, where equal neighbours are told apart by place in the corpus.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from geomill.llm.common import Rolling, bounded_batches, slices, small_or_not, text_bytes, with_type, written
from geomill.llm.near import runs

LENGTH, GRAM = 100, 40
#: Phrases of one gram that are sorted as one group; grams with more have each window dealt by its own hash.
GROUP = 4096
_LEAST = -(1 << 63)
_PLACE = (1 << 22) - 1
_BLOCK = 1 << 21


def triggers(data: np.ndarray, off: np.ndarray, length: int, gram: int):
    """Row, trigger, first and last window start of each phrase, with the hashes of all slices."""
    roll = Rolling(data)
    span = length - gram + 1
    n = len(data) - length + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return roll, none, none, none, none
    at = np.arange(len(data) - gram + 1)
    h = roll.of(at, at + gram)
    best = np.empty(n, np.int64)
    for s in range(0, n, _BLOCK):
        part = h[s : s + _BLOCK + span - 1]
        m = len(part) - span + 1
        v = (part & ~np.uint64(_PLACE)) | (np.uint64(_PLACE) - np.arange(len(part), dtype=np.uint64))
        v = np.r_[v, np.full(-len(v) % span, 0xFFFFFFFFFFFFFFFF, np.uint64)].reshape(-1, span)
        ahead = np.minimum.accumulate(v, axis=1).reshape(-1)
        back = np.minimum.accumulate(v[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        low = np.minimum(back[:m], ahead[span - 1 : span - 1 + m])
        best[s : s + m] = s + _PLACE - (low & np.uint64(_PLACE)).astype(np.int64)
    size = np.diff(off)
    left = np.repeat(off[1:], size) - np.arange(len(data))
    starts = np.flatnonzero(left[:n] >= length)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return roll, none, none, none, none
    own = best[starts]
    new = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    first, last = starts[new], starts[np.r_[new[1:] - 1, len(starts) - 1]]
    return roll, np.searchsorted(off, first, "right") - 1, own[new], first, last


def _parsed(length: int, gram: int):
    """Phrases: the gram's hash, the phrase's hash, place and number of windows. Copies within a batch are told at once."""

    def scan(batches):
        for batch in batches:
            for part in slices(batch, "text", 500_000):
                data, off = text_bytes(part.column("text"))
                roll, row, spot, first, last = triggers(data, off, length, gram)
                if not len(row):
                    continue
                key = roll.of(spot, spot + gram)
                phrase = roll.of(first, last + length, 9) + (spot - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                doc = part.column("doc").to_numpy()[row]
                copy = part.column("copy").to_numpy()[row]
                at = first - off[row]
                order = np.lexsort((at, copy, doc, phrase, key))
                seen = np.r_[False, (key[order][1:] == key[order][:-1]) & (phrase[order][1:] == phrase[order][:-1])]
                key = key[order]
                key[seen] ^= phrase[order][seen] + at[order][seen].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)  # spreads them
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(phrase[order].view(np.int64)), pa.array(doc[order]), pa.array(copy[order]),
                     pa.array(at[order].astype(np.int32)), pa.array((last - first + 1)[order].astype(np.int16)), pa.array(seen)],
                    ["key", "phrase", "doc", "copy", "at", "n", "seen"],
                )

    return scan


def _told(batches):
    """Of the rows in order of gram, phrase and place: repeats (again), and first phrases of grams that have several.

    Rows flow through; only the first phrase of the last gram is held back until a second one shows.
    """
    names = ["key", "doc", "copy", "at", "n"]
    held = None  # the last gram's first phrase, not yet given out
    key0 = phrase0 = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, phrase = batch.column("key").to_numpy(), batch.column("phrase").to_numpy()
        seen = batch.column("seen").to_numpy(zero_copy_only=False)
        base = batch.select(names)
        if seen.any():
            yield base.filter(pa.array(seen)).append_column("again", pa.array(np.ones(int(seen.sum()), bool)))
            base = base.filter(pa.array(~seen))
            key, phrase = key[~seen], phrase[~seen]
            if not len(key):
                continue
        same_key = np.r_[key[0] == key0, key[1:] == key[:-1]]
        again = same_key & np.r_[phrase[0] == phrase0, phrase[1:] == phrase[:-1]]
        key0, phrase0 = key[-1], phrase[-1]
        if again.any():
            yield base.filter(pa.array(again)).append_column("again", pa.array(np.ones(int(again.sum()), bool)))
        firsts = np.flatnonzero(~again)
        if not len(firsts):
            continue
        goes_on = same_key[firsts].copy()  # its gram has been seen before
        # same_key looks at the row before, which has the same gram exactly if the first phrase before does
        followed = np.r_[goes_on[1:], False]
        if goes_on[0] and held is not None:
            yield held
        held = None
        give = goes_on | followed
        out = base.take(pa.array(firsts))
        if not give[-1]:
            held = out.slice(len(firsts) - 1, 1)
            held = held.append_column("again", pa.array(np.zeros(1, bool)))
        if give.any():
            yield out.filter(pa.array(give)).append_column("again", pa.array(np.zeros(int(give.sum()), bool)))


def _contexts(length: int):
    """The bytes of wanted phrases, or each window of them by itself where the gram has too many."""
    names = ["grp", "doc", "copy", "at", "n", "bytes"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]

    def scan(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            out, windows = [], {}
            for doc, copy, z, wanted in zip(*(batch.column(c).to_pylist() for c in ("doc", "copy", "z", "wanted")), strict=True):
                raw = unpack.decompress(z)
                for w in wanted:
                    at, n = w["at"], w["n"]
                    if not w["hot"]:
                        out.append((w["key"], doc, copy, at, n, raw[at : at + n - 1 + length]))
                        continue
                    for i in range(at, at + n):
                        window = raw[i : i + length]
                        place = windows.get(window)
                        if place is None or (doc, copy, i) < place:
                            windows[window], place = (doc, copy, i), place
                        else:
                            place = (doc, copy, i)
                        if place is not None:  # not the first of this batch: told at once
                            out.append((hash(place), *place, 1, None))
            for window, place in windows.items():
                out.append((xxhash.xxh3_64_intdigest(window) - (1 << 63), *place, 1, window))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return scan


def _sorted(length: int):
    """Suffix order inside groups: every window that equals its neighbour before is told as a repeat."""

    def scan(batches):
        for t, at in runs(batches, "grp"):
            raw = t.column("bytes").combine_chunks()
            raw = raw.chunk(0) if isinstance(raw, pa.ChunkedArray) else raw
            data, off = text_bytes(raw)
            doc, copy, place = t.column("doc").to_numpy(), t.column("copy").to_numpy(), t.column("at").to_numpy()
            known = np.asarray(raw.is_null())
            n = np.where(known, 0, t.column("n").to_numpy()).astype(np.int64)
            run = np.repeat(np.arange(len(at) - 1), np.diff(at))
            row = np.repeat(np.arange(len(n)), n)
            j = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            rows, starts, ends = [np.flatnonzero(known)], [place[known]], [place[known] + length]
            if len(row):
                view = np.lib.stride_tricks.sliding_window_view(data, length)
                windows = np.ascontiguousarray(view[off[row] + j]).view(f"S{length}").reshape(-1)
                # rows are in corpus order, and both sorts are stable
                order = np.argsort(windows, kind="stable")
                order = order[np.argsort(run[row[order]], kind="stable")]
                w, r = windows[order], run[row[order]]
                dup = np.zeros(len(row), bool)
                dup[order[1:]] = (w[1:] == w[:-1]) & (r[1:] == r[:-1])
                hit = np.flatnonzero(dup)
                if len(hit):
                    cut = np.flatnonzero(np.r_[True, (row[hit][1:] != row[hit][:-1]) | (j[hit][1:] != j[hit][:-1] + 1)])
                    to = np.r_[cut[1:] - 1, len(hit) - 1]
                    own = row[hit[cut]]
                    rows.append(own)
                    starts.append(place[own] + j[hit[cut]])
                    ends.append(place[own] + j[hit[to]] + length)
            rows = np.concatenate(rows)
            if len(rows):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc[rows]), pa.array(copy[rows]), pa.array(np.concatenate(starts).astype(np.int32)), pa.array(np.concatenate(ends).astype(np.int32))],
                    ["doc", "copy", "lo", "hi"],
                )

    return scan


def _packed(batches):
    pack = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        for part in slices(batch, "text"):
            z = pa.array([pack.compress((x or "").encode()) for x in part.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("carried", "doc_id", "doc", "copy", "first")), z], ["carried", "doc_id", "doc", "copy", "first", "z"])


def _cut_out(batches):
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        out = []
        gone = batch.column("gone")
        flat, at = gone.flatten(), np.r_[0, np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(gone), 0)))]
        lo, hi = flat.field("lo").to_numpy(), flat.field("hi").to_numpy()
        for i, z in enumerate(batch.column("z").to_pylist()):
            raw = unpack.decompress(z)
            if at[i + 1] == at[i]:
                out.append((len(raw), 0, 0, raw))
                continue
            step = np.zeros(len(raw) + 1, np.int32)
            np.add.at(step, lo[at[i] : at[i + 1]], 1)
            np.add.at(step, hi[at[i] : at[i + 1]], -1)
            off = np.cumsum(step[:-1]) > 0
            spans = int(off[0]) + int((off[1:] & ~off[:-1]).sum())
            out.append((len(raw), int(off.sum()), spans, np.frombuffer(raw, np.uint8)[~off].tobytes()))
        if out:
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column("carried"), batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.binary())],
                ["carried", "doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )


def remove_repeats(
    docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, group: int = GROUP, carry: tuple[str, ...] = ()
) -> DataFrame:
    """Remove each byte covered by a `length`-byte string that also starts earlier in the corpus.

    Earlier means a smaller id, or the same document and an earlier start; strings never cross documents, overlap
    counts, and all are judged on the input. Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept
    (the remaining bytes).

    Null text: as the empty text. Null id: before all others. Rows that share an id: separate documents in the order
    of a hash of their text; wholly equal ones are one place and remove nothing from each other. Texts shorter than
    `length`: whole. Empty table: no rows. The columns named in `carry` come back as fields of the struct `carried`,
    so their names clash with none; others are not carried.
    """
    kind = docs.schema[key].dataType.simpleString()
    bounded_batches(docs.sparkSession)
    d = docs.select(
        F.col(key).alias("doc_id"), F.coalesce(F.col(key).cast("long"), F.lit(_LEAST)).alias("doc"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.lit(0).alias("copy"), F.lit(True).alias("first"),
        F.struct(F.lit(None).cast("int").alias("_"), *carry).alias("carried"),
    )
    if not d.groupBy("doc").count().where("count > 1").isEmpty():
        order = W.partitionBy("doc").orderBy(F.xxhash64("text"), "text")
        d = d.withColumn("copy", (F.dense_rank().over(order) - 1).cast("int"))
        d = d.withColumn("first", F.coalesce(F.lag("copy").over(order) != F.col("copy"), F.lit(True)))
    # only the first of wholly equal rows is parsed and compared; what goes from it goes from all of them
    phrases = d.where("first").select("doc", "copy", "text").mapInArrow(
        _parsed(length, gram), "key long, phrase long, doc long, copy int, at int, n short, seen boolean"
    )
    phrases = phrases.repartition("key").sortWithinPartitions("key", "phrase", "doc", "copy", "at")
    told = written(phrases.mapInArrow(_told, "key long, doc long, copy int, at int, n short, again boolean"), "told")
    several = told.where("not again")
    hot = several.groupBy("key").count().where(F.col("count") > group).select("key", F.lit(True).alias("hot"))
    wanted = several.join(small_or_not(hot), "key", "left")
    wanted = wanted.groupBy("doc", "copy").agg(
        F.collect_list(F.struct("key", "at", F.col("n").cast("int").alias("n"), F.coalesce("hot", F.lit(False)).alias("hot"))).alias("wanted")
    )
    carried = d.schema["carried"].dataType
    z = d.select("carried", "doc_id", "doc", "copy", "first", "text").mapInArrow(
        _packed, with_type("carried", carried, f"doc_id {kind}, doc long, copy int, first boolean, z binary")
    )
    contexts = z.where("first").select("doc", "copy", "z").join(wanted, ["doc", "copy"])
    contexts = contexts.mapInArrow(_contexts(length), "grp long, doc long, copy int, at int, n int, bytes binary")
    contexts = contexts.repartition("grp").sortWithinPartitions("grp", "doc", "copy", "at")
    gone = contexts.mapInArrow(_sorted(length), "doc long, copy int, lo int, hi int")
    gone = gone.union(told.where("again").select("doc", "copy", F.col("at").alias("lo"), (F.col("at") + F.col("n") - 1 + length).cast("int").alias("hi")))
    gone = gone.groupBy("doc", "copy").agg(F.collect_list(F.struct("lo", "hi")).alias("gone"))
    out = z.join(gone, ["doc", "copy"], "left").select("doc_id", "carried", "z", F.coalesce("gone", F.array().cast("array<struct<lo:int,hi:int>>")).alias("gone"))
    out = out.mapInArrow(_cut_out, with_type("carried", carried, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary"))
    return out if carry else out.drop("carried")

"""MinHash near-duplicates of documents by a multi-index join on Hamming distance."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geomill.llm.common import bounded_batches, components, mixed, packed, shingles, slices, small_or_not, text_bytes, written
from geomill.llm.near import collisions, exact_classes, minhash, rows_of, set_hash

#: A signature has VALUES minima. Of the first CHUNKS * WIDTH, 16 bits each are indexed; of all, 8 bits each are kept.
VALUES, CHUNKS, WIDTH = 64, 6, 4
#: Pairs that differ in at most 2 * CHUNKS - 1 indexed values differ in at most one value of some chunk, by the
#: pigeonhole principle, so they meet under a key that leaves one value of a chunk out. At Jaccard 0.85 a value differs
#: with chance 0.15, and the chance that 12 or more of 24 differ is 6e-5.
DIFFERING = 26  # of the 64 kept bytes: six standard deviations above the mean at Jaccard 0.85


def index_keys(first: np.ndarray) -> np.ndarray:
    """All keys of each row of CHUNKS * WIDTH 16-bit values: for each chunk, each way to leave one value out."""
    v = first.astype(np.uint64)
    out = np.empty((len(v), CHUNKS * WIDTH), np.uint64)
    for c in range(CHUNKS):
        for d in range(WIDTH):
            kept = [c * WIDTH + i for i in range(WIDTH) if i != d]
            key = np.full(len(v), c * WIDTH + d, np.uint64)
            for col in kept:
                key = key << np.uint64(16) | v[:, col]
            out[:, c * WIDTH + d] = mixed(key, 31)
    return out


def _signed(words: int):
    def scan(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                data, off = text_bytes(part.column("text"))
                values, at = shingles(data, off, words)
                n = np.diff(at)
                full = np.flatnonzero(n > 0)
                place = np.full(len(n), -1)
                place[full] = np.arange(len(full))
                place = pa.array(place, mask=n == 0)
                low = minhash(values, at, VALUES)
                sig = (low & np.uint64(0xFF)).astype(np.uint8)
                first = (low[:, : CHUNKS * WIDTH] >> np.uint64(8) & np.uint64(0xFFFF)).astype(np.uint16)
                even = np.arange(len(full) + 1)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n), set_hash(values, at).take(place),
                     packed(sig, even * VALUES).take(place), packed(first, even * CHUNKS * WIDTH).take(place)],
                    ["doc_id", "n_shingles", "set", "sig", "first"],
                )

    return scan


def _indexed(batches):
    for batch in batches:
        if batch.num_rows:
            keys = index_keys(rows_of(batch.column("first"), 2 * CHUNKS * WIDTH).copy().view(np.uint16))
            which = pa.array(np.repeat(np.arange(batch.num_rows), keys.shape[1]))
            for lo in range(0, len(which), 100_000):
                w = which.slice(lo, 100_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.reshape(-1)[lo : lo + 100_000].view(np.int64)), *(batch.column(c).take(w) for c in ("id", "n", "sig"))],
                    ["key", "id", "n", "sig"],
                )


def _sets(words: int):
    def scan(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                data, off = text_bytes(part.column("text"))
                values, at = shingles(data, off, words)
                full = pa.array(np.flatnonzero(np.diff(at) > 0))
                out = pa.RecordBatch.from_arrays(
                    [*(part.column(c).take(full) for c in ("grp", "id", "sig")), packed(values, at).take(full)], ["grp", "id", "sig", "elements"]
                )
                yield out.filter(pc.equal(set_hash(values, at), part.column("set").take(full)))  # another text may have the same doc_id

    return scan


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, num: int = 85, den: int = 100) -> DataFrame:
    """Components of documents whose sets of word shingles have a Jaccard similarity of num/den or more.

    Words are runs without ASCII white space, A-Z lower-cased. Documents with equal sets are one class from the start
    and only one of them is compared. Classes that share an index key and have near signatures form candidate groups,
    and inside a group full sets are intersected, each against what is not yet connected. Returns doc_id, n_shingles,
    component_id (smallest id reachable), kept (doc_id = component_id).

    Null or wordless text: no shingles, linked with nothing, its own component, kept. Null id: takes no part; component
    null, kept. Rows that share an id: one result each. Empty table: no rows. Other columns are not carried.
    """
    kind = docs.schema[key].dataType.simpleString()
    bounded_batches(docs.sparkSession)
    d = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    signed = written(d.mapInArrow(_signed(words), f"doc_id {kind}, n_shingles long, set binary, sig binary, first binary"), "signed")
    own = signed.where("doc_id is not null and set is not null")
    classes = own.groupBy("set").agg(F.min(F.struct("doc_id", "n_shingles", "sig", "first")).alias("r"), F.count("*").alias("n_docs"))
    classes = written(classes.select(F.monotonically_increasing_id().alias("id"), "set", "n_docs", "r.*"), "classes")
    keyed = classes.select("id", F.col("n_shingles").cast("int").alias("n"), "sig", "first")
    keyed = keyed.mapInArrow(_indexed, "key long, id long, n int, sig binary")
    groups = components(collisions(keyed, "long", DIFFERING, (num, den)))
    groups = groups.select(F.col("node").alias("id"), F.col("component").alias("grp"))
    members = classes.select("id", "doc_id", "set", "sig").join(groups, "id")
    texts = d.join(small_or_not(members), "doc_id").select("grp", "id", "set", "sig", "text")
    sets = texts.mapInArrow(_sets(words), "grp long, id long, sig binary, elements binary").dropDuplicates(["id"])
    linked = exact_classes(sets, "long", num, den, DIFFERING).join(classes.select("id", "doc_id"), "id")
    linked = written(linked, "linked")
    least = linked.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    linked = linked.join(least, "root").select("id", "component_id")
    # one row for each class that has copies or links; every other document is its own component
    named = classes.select("set", "n_docs", "doc_id", "id").join(linked, "id", "left").where("n_docs > 1 or component_id is not null")
    named = named.select("set", F.coalesce("component_id", "doc_id").alias("component_id"))
    out = signed.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("set")).alias("set"))
    out = out.join(small_or_not(named), "set", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without the near-copies: of each component one row, that with the smallest id, stays, all columns kept.

    Rows that share an id are documents of their own, in the order of a hash of their text; those without an id come
    last. Of rows that share id and text one stays. Null or wordless texts are in no component and stay.
    """
    ids = docs.groupBy(key).count()
    if ids.where((F.col("count") > 1) | F.col(key).isNull()).isEmpty():
        gone = near_duplicates(docs, key, text).where("not kept").select(F.col("doc_id").alias(key))
        return docs.join(small_or_not(gone), key, "left_anti")
    kind = docs.schema[key].dataType
    zero = F.lit("").cast(kind) if kind.simpleString() == "string" else F.lit(0).cast(kind)
    content = F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary"))
    row = F.struct(F.col(key).isNull().alias("last"), F.coalesce(F.col(key), zero).alias("id"), content.alias("content"))
    d = docs.withColumn("__row", row)
    found = near_duplicates(d.select("__row", text), "__row", text).where("n_shingles > 0")
    fate = found.groupBy(F.col("doc_id").alias("__row")).agg(F.bool_and("kept").alias("__kept"), F.count("*").alias("__n"))
    fate = written(fate.where("not __kept or __n > 1"), "fate")
    rest = d.join(small_or_not(fate), "__row", "left_anti").select(*docs.columns)
    again = d.join(small_or_not(fate.where("__kept").select("__row")), "__row", "left_semi")
    whole = F.struct(*docs.columns)
    again = again.groupBy("__row").agg(F.min_by(whole, F.xxhash64(F.to_json(whole))).alias("r")).select("r.*")
    return rest.union(again)

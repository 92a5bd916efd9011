"""Canonical exact digests of documents, and of each document edited with the head of the next one."""

from __future__ import annotations

import hashlib
import unicodedata

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geomill.llm.common import bounded_batches, slices, small_or_not, written

_LEAST = -(1 << 63)


def canonical(text: str) -> bytes:
    """NFKC, case folding, NFKC again, and each run of white space as one space, none at the ends."""
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split()).encode("utf-8", "surrogatepass")


def digest(canon: bytes) -> bytes:
    return xxhash.xxh3_128_digest(canon)


def _dealt(bounds: np.ndarray):
    """Each row to the range of its key, compressed; a range's first rows also to the end of the range before."""

    def scan(batches):
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for part in slices(batch, "text"):
                key = part.column("key").to_numpy(zero_copy_only=False)
                bucket = np.searchsorted(bounds, key, "right") - 1
                texts = [x or "" for x in part.column("text").to_pylist()]
                raw = [x.encode() for x in texts]
                z = pa.array([pack.compress(x) for x in raw], pa.binary())
                tie = pa.array([xxhash.xxh3_128_digest(x) for x in raw], pa.binary())
                heads = np.flatnonzero(bounds[bucket] == key)
                ids = part.column("doc_id")
                for take, to, extra in (
                    (np.arange(len(key)), bucket, 0),
                    (heads, (bucket[heads] - 1) % len(bounds), 1),
                ):
                    if len(take):
                        i = pa.array(take)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(to.astype(np.int32)), pa.array(np.full(len(take), extra, np.int8)), pa.array(key[take]),
                             tie.take(i), ids.take(i), z.take(i)], ["bucket", "extra", "key", "tie", "doc_id", "z"],
                        )

    return scan


def _follow(batches):
    """Rows in order; each is finished when the one after it in its range is seen."""
    unpack = zstandard.ZstdDecompressor()
    held = None  # bucket, doc_id, text, canonical form

    def finish(row, nxt, nxt_canon):
        _, doc_id, text, canon = row
        n = len(text)
        k = n // 4
        edited = text[: n - k] + nxt[:k]
        canon2 = canonical(edited)
        return (
            doc_id, n, hashlib.sha256(edited.encode()).hexdigest(), digest(canon), digest(canon2),
            hashlib.sha256(canon).hexdigest()[:16], hashlib.sha256(canon2).hexdigest()[:16],
            float(canon == canon2), float(canon == nxt_canon),
        )

    names = ["doc_id", "n_chars", "edited_sha256", "digest", "edited_digest", "tag", "edited_tag", "near_edited", "near_next"]
    kinds = [None, pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    for batch in batches:
        out = []
        kinds[0] = batch.schema.field("doc_id").type
        for bucket, extra, doc_id, z in zip(*(batch.column(c).to_pylist() for c in ("bucket", "extra", "doc_id", "z")), strict=True):
            if extra and (held is None or held[0] != bucket):
                continue  # a further row with the id of the next range's first
            text = unpack.decompress(z).decode()
            canon = canonical(text)
            if held is not None and held[0] == bucket:
                out.append(finish(held, text, canon))
            held = None if extra else (bucket, doc_id, text, canon)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)


def _members(batches):
    for batch in batches:
        for part in slices(batch, "text"):
            canon = [canonical(x or "") for x in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([digest(x) for x in canon], pa.binary()), pa.array(canon, pa.binary())], ["digest", "canon"])


def fingerprint_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprint every whole text and its edited text.

    The edited text has its last floor(n_chars / 4) code points replaced by the first as many, or all, of the next
    document in ascending id order; the first follows the last. A fingerprint is the 128-bit xxHash of the canonical
    form in hexadecimal. Equal digests are grouped and their canonical bytes compared; where different forms share a
    digest, a part of their SHA-256 is appended, so fingerprints are equal exactly when the canonical forms are.
    near_edited and near_next are 1 for equal canonical forms, else 0.

    Order without a global sort task: ids are dealt by quantile ranges (four a shuffle partition; the bounds are
    ids of the table), and the first rows of a range also go to the end of the range before it.

    Null text: as the empty text. Null id: before all others. Rows with the same id: in the order of the xxHash of
    their text. Empty table: no rows. Other columns of `docs` are not carried.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    d = docs.select(
        F.col(key).alias("doc_id"), F.coalesce(F.col(key).cast("long"), F.lit(_LEAST)).alias("key"), F.col(text).cast("string").alias("text")
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = [i / (4 * parts) for i in range(4 * parts)]
    least, ids = d.agg(F.min("key"), F.percentile_approx("key", cuts, 20 * parts + 10000)).first()
    bounds = np.unique(np.array([_LEAST if least is None else least, *(ids or [])], np.int64))
    kind = docs.schema[key].dataType.simpleString()
    dealt = d.mapInArrow(_dealt(bounds), f"bucket int, extra byte, key long, tie binary, doc_id {kind}, z binary")
    dealt = dealt.repartition(parts, "bucket").sortWithinPartitions("bucket", "extra", "key", "tie")
    out = dealt.mapInArrow(
        _follow,
        f"doc_id {kind}, n_chars long, edited_sha256 string, digest binary, edited_digest binary, tag string, edited_tag string, near_edited double, near_next double",
    )
    out = written(out, "fingerprints")
    multi = out.groupBy("digest").count().where("count > 1").select("digest")
    members = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(_members, "digest binary, canon binary")
    members = members.join(small_or_not(multi), "digest", "left_semi")
    forms = members.groupBy("digest", "canon").agg(F.count("*").alias("n"))  # compares whole forms; copies meet before the shuffle
    clash = written(forms.groupBy("digest").count().where("count > 1").select("digest"), "clashes")

    def named(digest: str, tag: str):
        return F.concat(F.lower(F.hex(digest)), tag)

    tags = {c: F.lit("") for c in ("digest", "edited_digest")}
    if not clash.isEmpty():
        for c, tag in (("digest", "tag"), ("edited_digest", "edited_tag")):
            side = clash.select(F.col("digest").alias(c), F.lit(True).alias(f"{c}_clash"))
            out = out.join(side, c, "left")
            tags[c] = F.when(F.col(f"{c}_clash"), F.concat(F.lit("-"), F.col(tag))).otherwise("")
    return out.select(
        "doc_id", "n_chars", "edited_sha256", named("digest", tags["digest"]).alias("fingerprint"),
        named("edited_digest", tags["edited_digest"]).alias("edited_fingerprint"), "near_edited", "near_next",
    )

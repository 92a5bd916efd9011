"""Sharding by jump consistent hashing (Lamping and Veach 2014), in Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: The multiplier of the published generator.
MULTIPLIER = 2862933555777941757
_M32 = 0xFFFFFFFF


def stable_key(col: Column) -> Column:
    """60 well-mixed bits of any value that casts to a string; a null counts as the empty string."""
    return F.conv(F.substring(F.md5(F.coalesce(col.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def jump(key: Column, shards: int) -> Column:
    """The shard 0..shards-1 of a nonnegative 64-bit key.

    The generator runs modulo 2^64 in 32-bit halves multiplied by 16-bit limbs, as ANSI arithmetic does not
    wrap. The bucket rises with each step, so `shards` steps always reach the end.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    c = [MULTIPLIER >> s & 0xFFFF for s in (0, 16, 32, 48)]

    def low(x: Column, limb: int) -> Column:  # x * limb * 2^16 modulo 2^32
        return F.shiftleft((x * F.lit(limb)).bitwiseAND(0xFFFF), 16)

    def step(acc: Column, _: Column) -> Column:
        hi, lo = acc["hi"], acc["lo"]
        r = lo * F.lit(c[0]) + low(lo, c[1]) + 1
        carry = F.shiftright(r, 32) + F.shiftright(lo * F.lit(c[1]), 16)
        up = (carry + lo * F.lit(c[2]) + low(lo, c[3]) + hi * F.lit(c[0]) + low(hi, c[1])).bitwiseAND(_M32)
        j = F.floor((acc["j"] + 1).cast("double") * (F.lit(2147483648.0) / (F.shiftright(up, 1) + 1).cast("double")))
        new = F.struct(up.alias("hi"), r.bitwiseAND(_M32).alias("lo"), acc["j"].alias("b"), j.alias("j"))
        return F.when(acc["j"] >= shards, acc).otherwise(new)

    start = F.struct(
        F.shiftright(key, 32).bitwiseAND(_M32).alias("hi"), key.bitwiseAND(_M32).alias("lo"),
        F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"),
    )
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step, lambda acc: acc["b"].cast("int"))


def shard_documents(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text", blocks: int = 1024) -> DataFrame:
    """Put every document into one of `shards` shards by its key alone (law `key`).

    Returns doc_id, size (UTF-8 bytes of the text plus 1), text_crc32, law, shard, slot, grown_shard. slot numbers
    a shard's rows from 0 without gaps: rows are numbered inside blocks of a shard, and a block starts where the
    ones before it end, so no task ever sorts a whole shard. grown_shard is the shard with one shard more: it is
    either the same or the new one.

    Null key: counts as the empty string, one fixed shard. Null text: size 1, checksum 0. Empty text: the same.
    Equal rows: each gets a slot of its own. Empty table: no rows. Other columns of `docs` are not carried.
    """
    d = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    d = d.select(
        "doc_id", (F.octet_length("t").cast("long") + 1).alias("size"), F.crc32(F.col("t").cast("binary")).alias("text_crc32"),
        stable_key(F.col("doc_id")).alias("k"),
    )
    d = d.select(
        "doc_id", "size", "text_crc32", jump(F.col("k"), shards).alias("shard"), jump(F.col("k"), shards + 1).alias("grown_shard"),
        F.pmod(F.col("k") + F.col("size") + F.col("text_crc32"), F.lit(blocks)).cast("int").alias("block"),
    )
    before = d.groupBy("shard", "block").agg(F.count("*").alias("n"))
    before = before.select(
        "shard", "block",
        F.coalesce(F.sum("n").over(W.partitionBy("shard").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("at"),
    )
    rank = F.row_number().over(W.partitionBy("shard", "block").orderBy("doc_id", "size", "text_crc32"))
    return d.withColumn("rank", rank).join(before, ["shard", "block"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("at") + F.col("rank") - 1).cast("long").alias("slot"), "grown_shard",
    )


ORACLE_SQL = """
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
    ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS k
  FROM documents),
j16 AS (
  SELECT rid, CAST(k AS HUGEINT) AS k, CAST(-1 AS BIGINT) AS b, CAST(0 AS BIGINT) AS j, 16 AS n FROM d
  UNION ALL SELECT rid, CAST(k AS HUGEINT), -1, 0, 17 FROM d
  UNION ALL
  SELECT rid, nk, j, CAST(floor(CAST(j + 1 AS DOUBLE) * (2147483648.0::DOUBLE / CAST((nk // 8589934592) + 1 AS DOUBLE))) AS BIGINT), n
  FROM (SELECT rid, j, n, (k * 2862933555777941757 + 1) % 18446744073709551616 AS nk FROM j16 WHERE j < n) s),
s AS (
  SELECT rid, CAST(max(CASE WHEN n = 16 THEN b END) AS INTEGER) AS shard,
    CAST(max(CASE WHEN n = 17 THEN b END) AS INTEGER) AS grown_shard
  FROM j16 WHERE j >= n GROUP BY rid),
tab AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i)) AS c),
crc AS (
  SELECT rid, doc_id, k, CAST(octet_length(encode(t)) + 1 AS BIGINT) AS size, CAST(xor(list_reduce(
      list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda x: ('0x' || x)::BIGINT),
      lambda a, x: xor(a // 256, c[xor(a, x) % 256 + 1]), 4294967295), 4294967295) AS BIGINT) AS text_crc32
  FROM d, tab)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
  CAST(row_number() OVER (PARTITION BY shard ORDER BY (k + size + text_crc32) % 1024, doc_id NULLS FIRST, size, text_crc32) - 1 AS BIGINT) AS slot,
  grown_shard
FROM crc JOIN s USING (rid)
"""

"""A Merkle manifest of a table: leaves by group, runs of eight, a root over the groups, and proofs folded from rows as presented.

The nodes of a group are cut into superblocks of consecutive nodes. On the way up each superblock becomes the one node
of the tier above it. On the way down the nodes of a superblock are cogrouped with the outer node that they became and
its path to the root; that call finishes the local reduction, joins the proofs and folds what is presented.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from geomill.llm.common import discard, small_or_not, written

#: Nodes of one run, and levels that a superblock takes in at once: 8^4 nodes of some 100 bytes.
RUN, LEVELS = 8, 4

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lowered(text: Column) -> Column:
    """Text with A-Z in lower case and nothing else changed."""
    return F.translate(text, _UPPER, _UPPER.lower())


def leaf_digest(*values: Column) -> Column:
    """Lowercase hex sha256 of the values, each `-` if null, else its UTF-8 byte count, a colon and itself."""
    parts = []
    for value in values:
        value = value.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def digest_of(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def fold(node: str, path: list[tuple[list[str], list[str]]]) -> str:
    """The root that a node leads to by the siblings left and right of it at each level."""
    for left, right in path:
        node = digest_of([*left, node, *right])
    return node


def local_levels(nodes: list[str], n: int, high: int) -> list[list[str]]:
    """All levels of one superblock of a group of n nodes. One that is not alone always rises by `high` levels."""
    levels = [nodes]
    while len(levels[-1]) > 1 if n <= RUN**high else len(levels) <= high:
        below = levels[-1]
        levels.append([digest_of(below[i : i + RUN]) for i in range(0, len(below), RUN)])
    return levels


def local_path(levels: list[list[str]], at: int) -> Iterator[tuple[str, str]]:
    """Digests joined left and right of a node's way through its superblock, a pair for each level."""
    for level in levels[:-1]:
        first = at - at % RUN
        yield "".join(level[first:at]), "".join(level[at + 1 : first + RUN])
        at //= RUN


def seated(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with seat, their place from 0 in their group grp by the columns of `order`, and n, the rows of the group.

    Rows are dealt by ranges of (grp, order) and numbered inside a range; where a range starts in a group is the sum of
    what lies before it, so no group is sorted in one task. Rows that tie in all of `order` are dealt by their place in
    the table, so copies of one row don't gather either.
    """
    first = written(rows.withColumn("tie", F.monotonically_increasing_id()), "unseated")
    keys = [F.col(c).asc_nulls_first() for c in ("grp", *order, "tie")]
    dealt = first.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("tie")
    dealt = written(dealt.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), "dealt")
    discard(first)
    starts = dealt.groupBy("grp", "part").agg(F.min("at").alias("low"), F.count("*").alias("rows"))
    group = W.partitionBy("grp")
    before = F.coalesce(F.sum("rows").over(group.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = starts.select("grp", "part", (before - F.col("low")).alias("shift"), F.sum("rows").over(group).alias("n"))
    starts = written(starts, "starts")
    return dealt.join(small_or_not(starts), ["grp", "part"]).withColumn("seat", F.col("at") + F.col("shift")).drop("at", "part", "shift")


_NODE = "grp string, block long, digest string, n long"
_PATH = "grp string, seat long, digest string, lefts array<string>, rights array<string>"


def _risen(tier: DataFrame, high: int) -> DataFrame:
    """A tier's superblocks, each as the node it becomes: (grp, seat, digest, n)."""

    def rise(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["n"].iloc[0])
        top = local_levels(pdf.sort_values("seat")["digest"].tolist(), n, high)[-1][0]
        return pd.DataFrame({"grp": [key[0]], "block": [key[1]], "digest": [top], "n": [-(-n // RUN**high)]})

    blocks = tier.select("grp", "seat", "digest", "n", F.expr(f"seat div {RUN**high}").alias("block"))
    return blocks.groupBy("grp", "block").applyInPandas(rise, _NODE).withColumnRenamed("block", "seat")


def _tiers(nodes: DataFrame, high: int) -> list[DataFrame]:
    """nodes(grp, seat, digest, n) and the tiers above them; the last has one node a group. Their number is a logarithm."""
    tiers = [nodes]
    while True:
        tiers.append(written(_risen(tiers[-1], high), "tier"))
        most = tiers[-1].agg(F.max("n")).first()[0]
        if most is None or most == 1:
            return tiers


def _exchange(tier: DataFrame, outer: DataFrame, high: int, one: Callable, schema: str) -> DataFrame:
    """Superblocks of a tier cogrouped with their outer node: one(nodes of a superblock, its levels, outer node) gives the rows."""

    def prove(inner: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        inner = inner.sort_values("seat", ignore_index=True)
        levels = local_levels(inner["digest"].tolist(), int(inner["n"].iloc[0]), high)
        own = above.iloc[0]
        if levels[-1][0] != own["digest"]:
            raise ValueError("a superblock does not lead to its outer node")
        return one(inner, levels, own)

    blocks = tier.withColumn("block", F.expr(f"seat div {RUN**high}"))
    above = outer.withColumnRenamed("seat", "block")
    return blocks.groupBy("grp", "block").cogroup(above.groupBy("grp", "block")).applyInPandas(prove, schema)


def _paths(tier: DataFrame, outer: DataFrame, high: int) -> DataFrame:
    """Each node of a tier with the digests left and right of its whole way to the root."""

    def one(inner: pd.DataFrame, levels: list[list[str]], own: pd.Series) -> pd.DataFrame:
        lefts, rights = [], []
        for at in range(len(inner)):
            way = list(local_path(levels, at))
            lefts.append([x for x, _ in way] + list(own["lefts"]))
            rights.append([x for _, x in way] + list(own["rights"]))
        return pd.DataFrame({"grp": inner["grp"], "seat": inner["seat"], "digest": inner["digest"], "lefts": lefts, "rights": rights})

    return _exchange(tier, outer, high, one, _PATH)


def _descended(tiers: list[DataFrame], outer: DataFrame, high: int) -> DataFrame:
    """The paths of the superblocks of tiers[0]: those of the last tier are given, and go down tier by tier."""
    for tier in reversed(tiers[1:-1]):
        outer = written(_paths(tier, outer, high), "paths")
    return outer


def manifest(leaves: DataFrame, order: list[str], siblings: bool = True, high: int = LEVELS) -> DataFrame:
    """Proofs for leaves(grp, leaf, presented and others): seats, subroots, the root and what each presented leaf folds to.

    grp: the group as a string, null allowed, groups being ordered bytewise with null first. leaf: hex digest of the row.
    presented: that of the row as someone shows it, null where it is as recorded. Leaves of a group ascend by `order`
    (null first), then by leaf. While a group has several nodes every RUN consecutive ones become the digest of
    their joined digests; what remains is the subroot, and the subroots in order of the groups lead to the root in
    the same way.

    Gives the columns of `order`, grp, seat, leaf, subroot, root, siblings (the digests of the proof, joined, level by level
    and left to right, without the node's own), lefts and rights (how many stand on each side at each level), folded_root
    (the presented leaf folded by these) and verified (whether that is the root). With siblings=False only their digest
    proof_sha256 comes out of the tasks. A superblock takes in `high` levels. Repeated rows have a leaf and a seat each. A lone leaf is its subroot, a lone
    subroot the root; an empty proof is the empty text. Empty table: no rows. Other columns are dropped.
    """
    plain = leaves.select(
        *order, F.coalesce(F.concat(F.lit("="), F.col("grp")), F.lit("")).alias("grp"), F.col("leaf").alias("digest"),
        F.when(F.col("presented") != F.col("leaf"), F.col("presented")).alias("shown"),
    )
    nodes = written(seated(plain, [*order, "digest"]), "leaves")
    tiers = _tiers(nodes, high)
    tops = tiers[-1].select(F.lit("").alias("grp"), F.col("grp").alias("of"), "digest")
    roots = written(seated(tops, ["of"]), "subroots")
    over = _tiers(roots, high)
    none = F.array().cast("array<string>")
    top = over[-1].select("grp", "seat", "digest", none.alias("lefts"), none.alias("rights"))
    top = written(_paths(roots, _descended(over, top, high), high), "root-paths")
    root = over[-1].select("digest").first()  # one row, none for an empty table
    named = roots.select("of", "seat", F.col("digest").alias("subroot"))
    ways = top.drop("digest", "grp").join(named, "seat").select(F.col("of").alias("grp"), F.lit(0).cast("long").alias("seat"), F.col("subroot").alias("digest"), "lefts", "rights")
    outer = _descended(tiers, ways, high)
    tied = named.select(F.col("of").alias("grp"), "subroot", F.lit(root[0] if root else None).cast("string").alias("root"))
    outer = outer.join(small_or_not(tied), "grp")

    kinds = ", ".join(f"`{c}` {leaves.schema[c].dataType.simpleString()}" for c in order)
    proof = "siblings string, lefts array<int>, rights array<int>" if siblings else "proof_sha256 string"

    def one(inner: pd.DataFrame, levels: list[list[str]], own: pd.Series) -> pd.DataFrame:
        after = list(zip(own["lefts"], own["rights"], strict=True))
        found: dict[str, list] = {"folded_root": [], "siblings": [], "lefts": [], "rights": []}
        for at, (leaf, shown) in enumerate(zip(inner["digest"], inner["shown"], strict=True)):
            way = [*local_path(levels, at), *after]
            node = shown if isinstance(shown, str) else leaf
            for left, right in way:
                node = hashlib.sha256((left + node + right).encode()).hexdigest()
            found["folded_root"].append(node)
            joined = "".join(map("".join, way))
            if siblings:
                found["siblings"].append(joined)
                found["lefts"].append([len(x) // 64 for x, _ in way])
                found["rights"].append([len(x) // 64 for _, x in way])
            else:
                found["siblings"].append(hashlib.sha256(joined.encode()).hexdigest())
        out = inner[[*order, "grp", "seat"]].assign(leaf=inner["digest"], subroot=own["subroot"], root=own["root"], folded_root=found["folded_root"])
        out["verified"] = out["folded_root"] == out["root"]
        if siblings:
            return out.assign(siblings=found["siblings"], lefts=found["lefts"], rights=found["rights"])
        return out.assign(proof_sha256=found["siblings"])

    schema = f"{kinds}, grp string, seat long, leaf string, subroot string, root string, folded_root string, verified boolean, {proof}"
    out = _exchange(nodes, outer, high, one, schema)
    return out.withColumn("grp", F.when(F.col("grp") != "", F.substr("grp", F.lit(2))))


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def document_manifest(docs: DataFrame, tampered: Column | None = None, siblings: bool = True, high: int = LEVELS) -> DataFrame:
    """The manifest of documents by language: leaves over doc_id, source, lang, n_chars and text, in order of doc_id.

    Where `tampered` holds the row is presented with its A-Z in lower case; where it is null the row is as recorded.
    A null in any field has its own mark, so it differs from an empty one; null ids come first in their language.
    """
    leaf = leaf_digest(*map(F.col, FIELDS))
    shown = leaf_digest(*map(F.col, FIELDS[:-1]), lowered(F.col("text").cast("string")))
    presented = F.lit(None).cast("string") if tampered is None else F.when(tampered, shown)
    rows = docs.select("doc_id", F.col("lang").cast("string").alias("grp"), leaf.alias("leaf"), presented.alias("presented"))
    return manifest(rows, ["doc_id"], siblings, high)


def third(key: Column) -> Column:
    """Whether 3 divides the unsigned crc32 of a key's decimal text; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % 3 == 0


def _levels_sql(name: str, depth: int) -> list[str]:
    """CTEs name0..: nodes (g, p, h, n) of each level, from name0; a finished group stays as it is."""
    out = []
    for k in range(depth):
        out.append(f"""{name}r{k} AS (SELECT g, p // 8 AS q, any_value(n) AS n, list(h ORDER BY p) AS hs FROM {name}{k} GROUP BY g, p // 8),
{name}{k + 1} AS (SELECT g, q AS p, CASE WHEN n > 1 THEN sha256(array_to_string(hs, '')) ELSE hs[1] END AS h, (n + 7) // 8 AS n FROM {name}r{k})""")
    return out


def _walk_sql(name: str, start: str, own: str, place: str, depth: int, carry: str) -> list[str]:
    """CTEs that walk rows (g, place, folded, sibs) up the runs of a tree, one for each level."""
    out, last = [], start
    for k in range(depth):
        now = f"{name}w{k}"
        out.append(f"""{now} AS (SELECT {carry}, w.{own}, w.{place} // 8 AS {place},
  CASE WHEN r.n > 1 THEN sha256(array_to_string(r.hs[:w.{place} % 8], '') || folded || array_to_string(r.hs[w.{place} % 8 + 2:], '')) ELSE folded END AS folded,
  CASE WHEN r.n > 1 THEN sibs || array_to_string(r.hs[:w.{place} % 8], '') || array_to_string(r.hs[w.{place} % 8 + 2:], '') ELSE sibs END AS sibs
  FROM {last} w JOIN {name}r{k} r ON r.g = w.{own} AND r.q = w.{place} // 8)""")
        last = now
    return out


_FIELD = "coalesce(CAST(octet_length(encode(CAST({0} AS VARCHAR))) AS VARCHAR) || ':' || CAST({0} AS VARCHAR), '-')"
_LEAF = " || ".join(_FIELD.format(f) for f in FIELDS)
_SHOWN = " || ".join(_FIELD.format(f) for f in [*FIELDS[:-1], f"translate(text, '{_UPPER}', '{_UPPER.lower()}')"])
#: Levels written out: right up to 8^8 documents of a language and 8^8 languages.
_DEPTH = 8

ORACLE_SQL = ",\n".join([
    """WITH tab AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i)) AS c),
d AS (
  SELECT doc_id, coalesce('=' || lang, '') AS g, sha256(""" + _LEAF + """) AS leaf, sha256(""" + _SHOWN + """) AS shown,
    xor(list_reduce(list_transform(regexp_extract_all(hex(encode(CAST(doc_id AS VARCHAR))), '..'), lambda x: ('0x' || x)::BIGINT),
      lambda a, x: xor(a // 256, c[xor(a, x) % 256 + 1]), 4294967295), 4294967295) % 3 = 0 AS bad
  FROM documents, tab),
s AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, count(*) OVER (PARTITION BY g) AS n FROM d),
a0 AS (SELECT g, p, leaf AS h, n FROM s)""",
    *_levels_sql("a", _DEPTH),
    f"b0 AS (SELECT 0 AS g, row_number() OVER (ORDER BY encode(g)) - 1 AS p, h, count(*) OVER () AS n, g AS lang FROM a{_DEPTH})",
    *_levels_sql("b", _DEPTH),
    "aw AS (SELECT doc_id, leaf, g, p, CASE WHEN bad THEN shown ELSE leaf END AS folded, '' AS sibs FROM s)",
    *_walk_sql("a", "aw", "g", "p", _DEPTH, "doc_id, leaf"),
    f"bw AS (SELECT w.doc_id, w.leaf, b0.h AS subroot, 0 AS g, b0.p, w.folded, w.sibs FROM aw{_DEPTH - 1} w JOIN b0 ON b0.lang = w.g)",
    *_walk_sql("b", "bw", "g", "p", _DEPTH, "doc_id, leaf, subroot"),
]) + f"""
SELECT doc_id, leaf, subroot, r.h AS root, sha256(sibs) AS proof_sha256, folded AS folded_root, folded = r.h AS verified
FROM bw{_DEPTH - 1} w, b{_DEPTH} r
"""  # fmt: skip

"""The Merkle manifest against a plain loop over sorted rows."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from geomill.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, grp string, seat long, n long, leaf string, tie int, part int, at int, digest string, block int, shown string"


def _sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def _field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def _leaf(doc_id, text, lang, source, n_chars):
    return _sha("".join(map(_field, (doc_id, source, lang, n_chars, text))))


def _proofs(nodes):
    """The top node and, for each node, the (left, right) siblings of each level."""
    ways = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(at):
            run = nodes[p - p % 8 : p - p % 8 + 8]
            ways[i].append((run[: p % 8], run[p % 8 + 1 :]))
            at[i] = p // 8
        nodes = [_sha("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)]
    return nodes[0], ways


def _plain(rows):
    by_lang = {}
    for r in rows:
        by_lang.setdefault(r[2], []).append(r)
    langs = sorted(by_lang, key=lambda x: b"" if x is None else b"=" + x.encode())
    tops = {}
    for lang in langs:
        own = sorted(by_lang[lang], key=lambda r: (r[0] is not None, r[0] or 0, _leaf(*r)))
        tops[lang] = (own, *_proofs([_leaf(*r) for r in own]))
    root, over = _proofs([tops[lang][1] for lang in langs])
    out = []
    for lang, outer in zip(langs, over, strict=True):
        own, subroot, ways = tops[lang]
        for r, way in zip(own, ways, strict=True):
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1] is not None
            shown = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[1]) if bad else r[1]
            node = _leaf(r[0], shown, *r[2:])
            for left, right in way + outer:
                node = _sha("".join([*left, node, *right]))
            proof = _sha("".join("".join(left + right) for left, right in way + outer))
            out.append((r[0], _leaf(*r), subroot, root, proof, node, node == root))
    return sorted(out, key=repr)


def _rows(n, langs, seed):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "ÄÖ", "x:1", "-", "", "Z" * 50]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 6))), rng.choice(langs), rng.choice(["s", None, ""]), rng.choice([None, 3, -4])) for i in range(n)]
    rows += [(None, "No id", langs[0], "s", 1), (None, None, None, None, None), (5, None, "en", "s", 2), (5, "A twin", "en", "s", 2), (5, "A twin", "en", "s", 2)]
    return rows + [(n, "Long " * 50_000, "en", "s", 3), (n + 1, "A lone leaf", "zz", "s", 3)]


def _result(spark, rows, high):
    extra = ("g", 1, 2, "x", 3, 4, 5, "d", 6, "sh")
    df = spark.createDataFrame([(r[0], r[1], r[2], r[3], r[4], *extra) for r in rows], SCHEMA).repartition(3)
    return merkle.document_manifest(df, merkle.third(F.col("doc_id")), high=high)


@pytest.mark.parametrize(("n", "langs", "high"), [(300, ["en", "fr", None, "", "é", "Z"], 1), (700, ["en"] + [f"l{i}" for i in range(90)], 1), (100, ["en", "de"], 4)])
def test_plain_loop(spark, n, langs, high):
    rows = _rows(n, langs, n)
    got = [tuple(r) for r in _result(spark, rows, high).select("doc_id", "leaf", "subroot", "root", F.sha2("siblings", 256), "folded_root", "verified").collect()]
    want = _plain(rows)
    assert sorted(got, key=repr) == want
    assert {r[-1] for r in want} == {True, False}


def test_proofs_fold(spark):
    rows = _rows(200, ["en", "fr", None], 3)
    found = _result(spark, rows, 2).collect()
    for r in found:
        sides, at, way = r["siblings"], 0, []
        for left, right in zip(r["lefts"], r["rights"], strict=True):
            own = [sides[at + 64 * i : at + 64 * i + 64] for i in range(left + right)]
            at += 64 * (left + right)
            way.append((own[:left], own[left:]))
        assert at == len(sides)
        assert merkle.fold(r["leaf"], way) == r["root"]
    seats = {}
    for r in found:
        seats.setdefault(r["grp"], []).append(r["seat"])
    assert all(sorted(s) == list(range(len(s))) for s in seats.values())


def test_only_digests(spark):
    rows = _rows(40, ["en", "fr"], 4)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = [tuple(r) for r in merkle.document_manifest(df, merkle.third(F.col("doc_id")), siblings=False).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()]
    assert sorted(got, key=repr) == _plain(rows)
    assert merkle.document_manifest(df).where("not verified").count() == 0


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert merkle.document_manifest(df).count() == 0


def test_one_row(spark):
    df = spark.createDataFrame([(1, "x", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    r = merkle.document_manifest(df).first()
    assert r["leaf"] == r["subroot"] == r["root"] == r["folded_root"] == _leaf(1, "x", "en", "s", 1)
    assert r["siblings"] == "" and r["lefts"] == []

"""Alignment of two tokenizers against whole texts encoded at once and links counted in plain loops."""

import collections
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from geomill.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, row long, block long, place int, pair int, links string, n_a string, groups int, best int"


def _texts():
    rng = random.Random(13)
    words = ["it's", "naïve", "été", "x1y22z", "…!?", "<|endoftext|>", "<s>", "</s>", "<0x0A>", "東京", "가나", "𝒳😀", "ﬁ", "q̣̇", "\x00", "don't", "Supercalifragilistic", "aaaa", "​", "﻿"]
    gaps = [" ", "  ", "   ", "\n", " \n", "\n ", "\n\n  ", "\t", "\r\n", " ", " ", "", "\x1c ", " 　 ", "\xa0", "\xa0 "]
    mixed = ["".join(rng.choice(words) + rng.choice(gaps) for _ in range(n)) for n in (1, 2, 5, 40, 400)]
    plain = [" ".join("".join(rng.choices("abcdefghij", k=rng.randint(1, 9))) for _ in range(60)) for _ in range(8)]
    return [*mixed, *plain, None, "", " ", "  ", "\n", " \n ", "a", " a", "a ", "a  ", "a b▁c", "▁", "x" * 3000, " " * 300, "ab\n" * 50, "東京都" * 100, plain[0], plain[0], ", " * 200]


TEXTS = _texts()


@pytest.fixture(scope="module")
def sides():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    letters = alignment.byte_letters()
    a_bytes = {i: bytes(letters[c] for c in t) for t, i in a.get_vocab(with_added_tokens=False).items()}
    return a, a_bytes, b


def _plain(sides, rows):
    """The contract row by row: ends as sets, links by comparing every A range with every B range of the document."""
    a, a_bytes, b = sides
    found, corpus = [], collections.Counter()
    for doc_id, text in rows:
        links, groups = [], []
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        bytes_a = [a_bytes[i] for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not text or b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
            ids_a, ids_b, bytes_a, bytes_b = [], [], [], []
        ranges = []
        for parts in (bytes_a, bytes_b):
            at, own = 0, []
            for x in parts:
                own.append((at, at + len(x)))
                at += len(x)
            ranges.append(own)
        stops = {e for _, e in ranges[0]} & {e for _, e in ranges[1]}
        first = [0, 0]
        for stop in sorted(stops):
            to = [next(i for i, (_, e) in enumerate(own) if e == stop) + 1 for own in ranges]
            groups.append(",".join(map(str, ids_a[first[0] : to[0]])) + "|" + ",".join(map(str, ids_b[first[1] : to[1]])))
            first = to
        for i, (s, e) in zip(ids_a, ranges[0], strict=True):
            links += [(i, j) for j, (u, v) in zip(ids_b, ranges[1], strict=True) if s < v and u < e]
        corpus.update(links)
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        found.append((doc_id, len(ids_a), len(ids_b), len(groups), links, digest))
    most = collections.Counter()
    for (_, j), n in corpus.items():
        most[j] = max(most[j], n)
    return sorted(((d, x, y, g, len(ln), digest, sum(corpus[p] == most[p[1]] for p in ln), sum(corpus[p] for p in ln)) for d, x, y, g, ln, digest in found), key=repr)


def _scored(spark, rows):
    df = spark.createDataFrame([(i, t, 1, 2, 3, 4, "l", "n", 5, 6) for i, t in rows], SCHEMA).repartition(3)
    out = alignment.align_documents(df, A, B)
    out = out.withColumn("digest", F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise(""))
    return alignment.score_links(out, alignment.piece_count(B), ["n_a", "n_b", "n_groups", "n_links", "digest"])


def test_whole_texts(spark, sides):
    rows = [*enumerate(TEXTS), (None, "no id"), (None, "no id"), (4, "another text of 4")]
    got = sorted(map(tuple, _scored(spark, rows).collect()), key=repr)
    assert got == _plain(sides, rows)
    assert sum(r[1] == 0 for r in got) == 4  # null, empty, and two with a sign that the pieces write as a space


def test_blocks(spark, sides, monkeypatch):
    """Blocks only deal the work: many small ones give the same rows."""
    monkeypatch.setattr(alignment, "BLOCK", 200)
    rows = list(enumerate(TEXTS))
    want = _plain(sides, rows)
    aligned = alignment.align_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), A, B)
    assert aligned.select("block").distinct().count() > 2
    out = alignment.score_links(aligned.withColumn("digest", F.lit("")), alignment.piece_count(B), ["n_a", "n_b", "n_groups", "n_links", "digest"])
    assert sorted((tuple(r)[:5] + tuple(r)[6:] for r in out.collect()), key=repr) == [r[:5] + r[6:] for r in want]


def test_groups_and_links_of_lengths():
    rng = random.Random(1)
    for _ in range(300):
        cuts = [sorted({0, 40, *rng.sample(range(1, 40), rng.randint(0, 15))}) for _ in range(2)]
        a, b = ([y - x for x, y in zip(c, c[1:], strict=False)] for c in cuts)
        a_stop, b_stop, stops = alignment.common_ends(a, b)
        assert stops == sorted({*cuts[0][1:]} & {*cuts[1][1:]}) and (a_stop[-1], b_stop[-1]) == (len(a), len(b))
        at_a, at_b, first = alignment.links_of(a, b, np.array(a_stop), np.array(b_stop))
        want = [(i, k) for i in range(len(a)) for k in range(len(b)) if cuts[0][i] < cuts[1][k + 1] and cuts[1][k] < cuts[0][i + 1]]
        got = list(zip(at_a.tolist(), at_b.tolist(), strict=True))
        assert sorted(got) == want and first[-1] == len(want)
        assert all(a_stop[g] <= i < a_stop[g + 1] for g in range(len(stops)) for i, _ in got[first[g] : first[g + 1]])


def test_odd_tables(spark):
    assert _scored(spark, []).count() == 0
    assert [tuple(r) for r in _scored(spark, [(1, None), (2, "")]).orderBy("doc_id").collect()] == [(1, 0, 0, 0, 0, "", 0, 0), (2, 0, 0, 0, 0, "", 0, 0)]

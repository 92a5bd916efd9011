"""Token counts against the library on whole texts, with small chunks so that every text is spliced."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from geomill.llm import token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, row long, i long, n_tokens long, n_bytes string, last string, total int"


def _texts():
    rng = random.Random(12)
    words = ["it's", "don't", "I'll've", "naïve", "été", "ÄÖÜ", "x1y22z", "…!?", "'re", "<|endoftext|>", "<|startoftext|>", "<|endof", "text|>", "東京", "かが", "가나", "각", "١٢", "ﬁ", "İ", "Σς", "q̣̇", "̸"]
    gaps = [" ", "  ", "\n", "\t", "\r\n", " ", " ", "", "\x1c", " 　 "]
    mixed = ["".join(rng.choice(words) + rng.choice(gaps) for _ in range(n)) for n in (3, 40, 200, 900)]
    return [
        *mixed, None, "", " ", "   \n", "one", "a" * 5000, "<|endoftext|>" * 300, "'s" * 700, "'" * 999 + "s", "東京都" * 800, "é" * 1500, "́" * 700, "가" * 900 + " x",
        " " * 3000 + "x" + " " * 3000, "ab " * 2000, "1" * 2000, "x" + "̣̇" * 600 + "y z", "!" * 1000 + "<|endoftext|>" + "!" * 1000, mixed[2], mixed[2],
    ]


TEXTS = _texts()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def _frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, 3, "n", "l", 4) for i, t in rows], SCHEMA).repartition(3)


def _want(library, rows):
    return sorted(((i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False))) for i, t in rows), key=repr)


@pytest.mark.parametrize(("chunk", "overlap"), [(64, 32), (150, 40), (1000, 30), (token_counts.CHUNK, token_counts.OVERLAP)])
def test_library(spark, library, chunk, overlap):
    rows = [*enumerate(TEXTS), (None, "no id"), (None, "no id"), (3, TEXTS[3])]
    got = token_counts.count_tokens(_frame(spark, rows), PATH, chunk=chunk, overlap=overlap)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens"]
    assert sorted(map(tuple, got.collect()), key=repr) == _want(library, rows)


def test_megabyte(spark, library):
    rng = random.Random(2)
    text = " ".join("".join(rng.choices("abcdefgh'1,", k=rng.randint(1, 12))) for _ in range(160_000))
    rows = [(1, text), (2, text.replace(" ", "")[:200_000])]
    got = token_counts.count_tokens(_frame(spark, rows), PATH)
    assert sorted(map(tuple, got.collect())) == _want(library, rows)


def test_boundaries_are_those_of_the_whole(library):
    """Tokens before and after any two chunks' common boundary are those of the whole text, wherever it is cut."""
    rng = random.Random(4)
    joined = " ".join(t for t in TEXTS if t)[:40_000]
    used = 0
    for _ in range(300):
        a = rng.randint(0, len(joined) - 900)
        whole = joined[a : a + 900]
        cut = rng.randint(300, 500)
        left, right = whole[: cut + 100], whole[cut:]
        e, f = library.encode(left, add_special_tokens=False), library.encode(right, add_special_tokens=False)
        tails = dict(token_counts.boundaries(left, e.word_ids, e.offsets, cut, cut + 100, token_counts.AHEAD))
        heads = {p + cut: n for p, n in token_counts.boundaries(right, f.word_ids, f.offsets, 0, 100, 0)}
        ids = library.encode(whole, add_special_tokens=False).ids
        for p in tails.keys() & heads.keys():
            used += 1
            assert e.ids[: tails[p]] + f.ids[heads[p] :] == ids
    assert used > 500


def test_odd_tables(spark):
    assert token_counts.count_tokens(_frame(spark, []), PATH).count() == 0
    with pytest.raises(ValueError):
        token_counts.count_tokens(_frame(spark, []), PATH, chunk=10, overlap=10)
    with pytest.raises(ValueError, match="white space"):
        token_counts.count_tokens(_frame(spark, []), public_tokenizers.path("byte_bpe_50k.json"))

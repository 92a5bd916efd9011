"""Operators on small tables with nulls, empty and long texts, ties, repeated rows and clashing names, against brute force."""

import base64
import collections
import hashlib
import pathlib
import random
import re
import time
import warnings
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from geomill.llm import bpe, cap_filters, fingerprints, license_scan, minhash_dedup, mixing, paragraph_dedup, prefix_free, sharding, toxicity
from geomill.llm.common import components

#: Extra columns with the names that operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, at int, n int, id string, set string, grp long, w string, component_id long, carried string"
PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def _words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def _rows():
    rng = random.Random(5)
    base = _words(rng, 120)
    long = _words(rng, 40_000)
    w = base.split()
    near = " ".join([*w[:60], "changed", *w[61:]])
    passage = _words(rng, 60)
    texts = [
        base, near, base, None, "", "   \n\t ", "one", "one two three", "One  two\nthree", long, long[:-7] + "x",
        _words(rng, 30) + "\n" + passage + "\n" + _words(rng, 30), "\n" + passage, passage + " " + _words(rng, 20),
        "a" * 500, "Th " * 200, "äöü é ﬁ Straße STRASSE x", "ÄÖÜ É fi strasse strasse x", "Released under the MIT License. " + _words(rng, 20),
        "x Licensed under CC BY-NC 4.0. y", base[:300], "you idiot moron trash", "<|endoftext|> it's   1234\r\n!!",
    ]
    return [(i * 3, t) for i, t in enumerate(texts)]


ROWS = _rows()


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0, "k", 1, 2, "i", "s", 3, "w", 4, "c") for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, ROWS).cache()


@pytest.fixture(scope="module")
def odd(spark):
    """Repeated rows, a null id and one id with two texts."""
    return frame(spark, [*ROWS, ROWS[0], (None, "nothing here but words that are new"), (0, "another text of the same id")])


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, []).limit(0)


def sets(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def least(n, edges):
    part = list(range(n))

    def root(x):
        while part[x] != x:
            x = part[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        part[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


# ---- sharding


def jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2**31 / ((key >> 33) + 1)))
    return b


def test_sharding(docs, odd, empty):
    rows = sharding.shard_documents(docs, 5).collect()
    by = collections.defaultdict(list)
    text = dict(ROWS)
    for r in rows:
        key = int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:15], 16)
        t = (text[r.doc_id] or "").encode()
        assert (r.shard, r.grown_shard) == (jump(key, 5), jump(key, 6))
        assert (r["size"], r.text_crc32, r.law) == (len(t) + 1, zlib.crc32(t), "key")
        assert r.grown_shard in (r.shard, 5)
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert len(rows) == len(ROWS)
    slots = collections.defaultdict(list)
    for r in sharding.shard_documents(odd, 3).collect():
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and sum(map(len, slots.values())) == odd.count()
    assert sharding.shard_documents(empty).count() == 0
    with pytest.raises(ValueError):
        sharding.shard_documents(docs, 0)


# ---- fingerprints


def test_fingerprints(docs, odd, empty):
    got = {r.doc_id: r for r in fingerprints.fingerprint_documents(docs).collect()}
    order = sorted(ROWS)
    for i, (k, t) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        edited = t[: len(t) - len(t) // 4] + nxt[: len(t) // 4]
        r = got[k]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_edited == float(fingerprints.canonical(t) == fingerprints.canonical(edited))
        assert r.near_next == float(fingerprints.canonical(t) == fingerprints.canonical(nxt))
    forms = collections.defaultdict(set)
    for k, t in ROWS:
        forms[fingerprints.canonical(t or "")].add(got[k].fingerprint)
    assert all(len(f) == 1 for f in forms.values()) and len({next(iter(f)) for f in forms.values()}) == len(forms)
    assert got[48].fingerprint == got[51].fingerprint  # ligature, sharp s, case and no-break space
    assert fingerprints.fingerprint_documents(odd).count() == odd.count()
    assert fingerprints.fingerprint_documents(empty).count() == 0


def test_fingerprints_with_colliding_digests(docs, monkeypatch):
    monkeypatch.setattr(fingerprints, "digest", lambda canon: bytes(16))
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(fingerprints)
    try:
        got = {r.doc_id: r.fingerprint for r in fingerprints.fingerprint_documents(docs).collect()}
    finally:
        cloudpickle.unregister_pickle_by_value(fingerprints)
    assert len(set(got.values())) == len({fingerprints.canonical(t or "") for _, t in ROWS})


# ---- byte-level BPE


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), ranks


def test_bpe(docs, odd, empty, reference):
    encoding, _ = reference
    encoded = bpe.encode_documents(docs, PATH, public_tokenizers.PATTERN)
    for k, r in {r.doc_id: r for r in bpe.decode_documents(encoded, PATH).collect()}.items():
        text = dict(ROWS)[k] or ""
        assert np.frombuffer(r.ids, "<u4").tolist() == encoding.encode_ordinary(text)
        assert bytes(r.decoded) == text.encode()
    both = bpe.digests(bpe.encode_documents(odd, PATH, public_tokenizers.PATTERN, decoded=True))
    assert both.count() == odd.count()
    assert bpe.encode_documents(empty, PATH, public_tokenizers.PATTERN).count() == 0


@pytest.fixture(scope="module")
def merger(reference):
    return bpe.Merger(reference[1])


PIECE = st.binary(min_size=1, max_size=300) | st.text("aeinrst th", min_size=1, max_size=300).map(str.encode)


@settings(max_examples=200, deadline=None)
@given(st.lists(PIECE, min_size=1, max_size=8))
def test_rank_queue(reference, merger, pieces):
    """Pre-tokens that are merged together come out as each alone does."""
    encoding, _ = reference
    assert [x.tolist() for x in merger.merge(pieces)] == [encoding._core_bpe.encode_single_piece(x) for x in pieces]


def test_very_long_pre_tokens(reference, merger):
    encoding, _ = reference
    rng = random.Random(3)
    for x in ("a" * 30_001, "".join(rng.choice("abcdefgh") for _ in range(30_000))):
        assert merger.merge([x.encode()])[0].tolist() == encoding.encode_ordinary(x)
    whole = merger.merge(["".join(rng.choice("etaoin") for _ in range(1_000_000)).encode()])[0]
    assert sum(len(merger.tokens[i]) for i in whole.tolist()) == 1_000_000


def test_memory_of_pre_tokens(merger, monkeypatch):
    """A full memory starts a new generation and takes over what is met again; it never stops taking."""
    monkeypatch.setattr(bpe, "GENERATION", 20_000)
    memory = bpe.Memory(merger)
    for lo in range(0, 2000, 50):
        pieces = {f" w{i}" for i in range(lo, lo + 80)} | {"x" * 300}
        known = memory.learn(pieces)
        assert all(known[x] == merger.merge([x.encode()])[0].tobytes() for x in pieces)
        assert f" w{lo}" in memory.young and "x" * 300 not in memory.young
    assert len(memory.young) + len(memory.old) < 400


# ---- near-duplicates


def test_minhash(docs, odd, empty):
    got = {r.doc_id: r for r in minhash_dedup.near_duplicates(docs).collect()}
    s = [sets(t, 3) for _, t in ROWS]
    edges = [(a, b) for b in range(len(s)) for a in range(b) if s[a] and 100 * len(s[a] & s[b]) >= 85 * len(s[a] | s[b])]
    want = least(len(s), edges)
    assert len(edges) > 3
    for i, (k, _) in enumerate(ROWS):
        assert (got[k].n_shingles, got[k].component_id, got[k].kept) == (len(s[i]), want[i] * 3, want[i] == i)
    assert minhash_dedup.near_duplicates(odd).count() == odd.count()
    assert minhash_dedup.near_duplicates(empty).count() == 0
    kept = minhash_dedup.deduplicate(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {k for k, r in got.items() if r.kept}


@pytest.mark.parametrize("large", [1000, 12])
def test_minhash_on_a_large_group_of_near_copies(spark, monkeypatch, large):
    """Copies edited apart from each other, linked through the original only, and a chain; whole and split into blocks."""
    classes = minhash_dedup.exact_classes
    monkeypatch.setattr(minhash_dedup, "exact_classes", lambda *a: classes(*a, large=large))
    rng = random.Random(1)
    w = _words(rng, 300).split()
    rows = []
    for i in range(80):
        v = list(w)
        for j in rng.sample(range(300), 6):
            v[j] = f"edit{i}x{j}"
        rows.append((i + 10, " ".join(v)))
    rows.append((500, " ".join(w)))
    chain = list(w[::-1])
    for i in range(30):
        chain[i * 10] = f"chain{i}"
        rows.append((600 + i, " ".join(chain)))
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(frame(spark, rows)).collect()}
    s = [sets(t, 3) for _, t in rows]
    edges = [(a, b) for b in range(len(s)) for a in range(b) if 100 * len(s[a] & s[b]) >= 85 * len(s[a] | s[b])]
    want = least(len(s), edges)
    assert [got[k] for k, _ in rows] == [rows[i][0] for i in want]


@settings(max_examples=50, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(0, 2 * minhash_dedup.CHUNKS - 1))
def test_all_pairs_within_the_distance_meet(seed, errors):
    rng = np.random.default_rng(seed)
    n = minhash_dedup.CHUNKS * minhash_dedup.WIDTH
    a = rng.integers(0, 1 << 16, n, dtype=np.uint16)
    b = a.copy()
    b[rng.choice(n, errors, replace=False)] ^= 1
    keys = minhash_dedup.index_keys(np.stack([a, b]))
    assert (keys[0] == keys[1]).any()


def blocks(text):
    """First word and word shingles of each paragraph of a text."""
    raw = np.frombuffer((text or "").encode(), np.uint8)
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    n = paragraph_dedup.LENGTH
    own = paragraph_dedup.Blocks(raw, np.array([0, len(raw)]), 5, n, paragraph_dedup.REACH)
    return {int(p): {tuple(w[i : i + 5]) for i in range(p, p + n - 4)} for p in own.first}


def repeats(rows):
    """doc_id and paragraph of all that link with another, with the place that stays: all pairs of distinct places are compared."""
    places = sorted({(k, p, frozenset(x)) for k, t in set(rows) if k is not None for p, x in blocks(t).items()}, key=lambda v: v[:2])
    own = [x for _, _, x in places]
    by = collections.defaultdict(list)
    for i, x in enumerate(own):
        for sh in x:
            by[sh].append(i)
    edges = {(a, b) for at in by.values() for b in at for a in at if a < b}
    edges = [(a, b) for a, b in edges if 5 * len(own[a] & own[b]) >= 4 * len(own[a] | own[b])]
    want = least(len(own), edges)
    size = collections.Counter(want)
    return collections.Counter((*places[i][:2], *places[w][:2], places[w][:2] == places[i][:2]) for i, w in enumerate(want) if size[w] > 1)


def found(frame):
    return collections.Counter((r.doc_id, r.paragraph, r.kept_doc_id, r.kept_paragraph, r.kept) for r in paragraph_dedup.repeated_paragraphs(frame).collect())


def test_paragraphs(docs, odd, empty):
    got = found(docs)
    assert got == repeats(ROWS) and {0, 3, 6, 33, 36, 39} <= {k for k, *_ in got}
    assert found(odd) == repeats([*ROWS, ROWS[0], (None, "nothing here but words that are new"), (0, "another text of the same id")])
    assert paragraph_dedup.repeated_paragraphs(empty).count() == 0
    rest = {r.doc_id: r.text for r in paragraph_dedup.remove_repeated(docs).collect()}
    assert rest[0] == ROWS[0][1] and rest[9] is None and len(rest) == len(ROWS)
    gone = [p for k, p, *_, kept in got if k == 6 and not kept]
    w = ROWS[2][1].split()
    assert gone and rest[6].split() == [x for i, x in enumerate(w) if not any(p <= i < p + paragraph_dedup.LENGTH for p in gone)]
    assert paragraph_dedup.remove_repeated(docs).columns == docs.columns


def test_passages_inside_longer_lines(spark):
    """Passages of 51 to 70 words pasted into lines, some with a word changed; short recurring lines are left alone."""
    rng = random.Random(15)
    rows, pasted = [], set()
    short = [_words(rng, 12) for _ in range(3)]
    for i in range(40):
        passage = _words(rng, 51 + i % 20).split()
        for k in (3 * i, 3 * i + 1):
            if k % 3 and i % 4 == 0:
                passage[3] = "changed"
            rows.append((k, " ".join([_words(rng, 20 + rng.randrange(40)), *passage, _words(rng, 30), short[i % 3]])))
            pasted.add(k)
        rows.append((3 * i + 2, _words(rng, 90) + "\n" + short[i % 3] + "\n" + _words(rng, 5)))
    got = found(frame(spark, rows))
    assert got == repeats(rows)
    hit = {k for k, *_ in got}
    assert hit <= pasted and len(hit) >= 0.95 * len(pasted)


def test_repeated_ids_in_deduplication(spark):
    """A clean text is not removed with the near-copy of its id, and one of rows with equal text stays."""
    rng = random.Random(13)
    base, clean, lone, same = (_words(rng, 120) for _ in range(4))
    near = base + " more"
    rows = [(1, base), (2, near), (2, clean), (3, lone), (3, lone), (None, same), (None, same), (None, base), (4, None), (4, None)]
    got = minhash_dedup.deduplicate(frame(spark, rows))
    assert got.columns == SCHEMA.replace(" long", "").replace(" string", "").replace(" int", "").split(", ")
    assert collections.Counter((r.doc_id, r.text) for r in got.collect()) == collections.Counter([(1, base), (2, clean), (3, lone), (None, same), (4, None), (4, None)])


def test_paragraphs_of_repeated_ids(spark):
    """A class is compared by its own text, whichever row of the id holds it, and removal spares the id's other rows."""
    rng = random.Random(14)
    rows = []
    for i in range(12):
        line = _words(rng, 40)
        rows += [(i, _words(rng, 40)), (i, line), (i, _words(rng, 40)), (100 + i, line + " more")]
    rows += [(200, rows[0][1] + " end"), (200, _words(rng, 40))]
    assert found(frame(spark, rows)) == repeats(rows)
    rest = collections.Counter((r.doc_id, r.text) for r in paragraph_dedup.remove_repeated(frame(spark, rows)).collect())
    assert rest[rows[-1]] == 1 and all(rest[r] == 1 for r in rows if r[0] < 100) and sum(rest.values()) == len(rows)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(0, 150), st.sampled_from([1, 2, 3, 7, 11, 30, 10**6]))
def test_every_word_lies_in_a_paragraph(seed, n, different):
    """Random and recurring words: no gap between paragraphs, and none so near another that it would link with it."""
    rng = random.Random(seed)
    pool = [_words(rng, 1) for _ in range(min(different, 200))]
    text = " ".join(pool[i % len(pool)] if different < 30 else rng.choice(pool) for i in range(n))
    first = sorted(blocks(text))
    whole = n < paragraph_dedup.LENGTH + paragraph_dedup.APART
    covered = {i for p in first for i in range(p, n if whole else p + paragraph_dedup.LENGTH)}
    assert covered == set(range(n)) and all(b - a >= paragraph_dedup.APART for a, b in zip(first, first[1:], strict=False))
    assert len(first) <= n / 11 + 2


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32 - 1), st.lists(st.integers(0, 120), min_size=1, max_size=6))
def test_anchors_by_ascending_hash(seed, lengths):
    value = np.random.default_rng(seed).integers(0, 1 << 63, sum(lengths), dtype=np.uint64)
    want, base = [], 0
    for n in lengths:
        taken = []
        for x in sorted(range(n), key=lambda x: int(value[base + x])):
            if all(abs(x - y) > 10 for y in taken):
                taken.append(x)
        want += sorted(base + x for x in taken)
        base += n
    i = np.concatenate([np.arange(n) for n in lengths])
    left = np.concatenate([n - np.arange(n) for n in lengths])
    assert paragraph_dedup.anchors(value, i, left, 10).tolist() == want


def test_paragraphs_at_ends_and_of_short_texts(spark):
    """Repeated heads, tails and short texts are found and cut, lone ones are not; an overlapped kept paragraph stays whole."""
    rng = random.Random(16)
    head, tail, short, bare, lone = (_words(rng, n) for n in (24, 24, 22, 3, 23))
    rows = [(i, head + " " + _words(rng, 70)) for i in (1, 2)] + [(i, _words(rng, 70) + " " + tail) for i in (3, 4)]
    rows += [(5, short), (6, short.upper().replace(" ", "\n")), (7, bare), (8, " " + bare), (9, lone), (10, "Th " * 200), (11, _words(rng, 26)), (12, _words(rng, 25))]
    hit = {(r.doc_id, r.paragraph, r.kept_doc_id, r.kept_paragraph) for r in paragraph_dedup.repeated_paragraphs(frame(spark, rows)).collect()}
    assert {x for x in hit if x[0] != 10} == {(1, 0, 1, 0), (2, 0, 1, 0), (3, 70, 3, 70), (4, 70, 3, 70), (5, 0, 5, 0), (6, 0, 5, 0), (7, 0, 7, 0), (8, 0, 7, 0)}
    rest = {r.doc_id: r.text.split() for r in paragraph_dedup.remove_repeated(frame(spark, rows)).collect()}
    w = {k: t.split() for k, t in rows}
    assert rest == w | {2: w[2][24:], 4: w[4][:70], 6: [], 8: [], 10: ["Th"] * 24}


def test_paragraphs_leave_no_shuffle_files(spark):
    """What a step shuffles is off the disk when the step ends, whether or not the driver has collected garbage."""
    folders = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())

    def files():
        return {f for d in folders for f in pathlib.Path(d).rglob("shuffle_*.data")}

    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = files(), spark.conf.get(name, None)
    assert paragraph_dedup.repeated_paragraphs(frame(spark, ROWS)).columns and spark.conf.get(name, None) == setting
    for _ in range(100):  # executors remove them on their own time
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before


def test_groups_of_a_common_passage_are_split(spark):
    """No pair that links is parted, pairs that share the passage alone hardly meet, and small groups stay."""
    rng = np.random.default_rng(17)
    common, sets = rng.integers(0, 1 << 62, 9), []
    for i in range(300):
        own = sets[-1][:-1] if i % 5 == 4 else np.r_[common, rng.integers(0, 1 << 62, 11)]
        sets.append(np.r_[own, rng.integers(0, 1 << 62, 20 - len(own))])
    sets = [np.sort(x.astype(np.uint64)) for x in sets] + [np.array([i], np.uint64) for i in (5, 6)]
    rows = [(1 if i < 300 else 2, i, bytearray(x.tobytes())) for i, x in enumerate(sets)]
    got = paragraph_dedup.narrowed(spark.createDataFrame(rows, "grp long, id long, elements binary"), 4, 5, large=50).collect()
    by = collections.defaultdict(set)
    for r in got:
        by[r.grp].add(r.id)
        assert bytes(r.elements) == sets[r.id].tobytes()
    met = {(a, b) for ids in by.values() for a in ids for b in ids if a < b}
    links = {(a, b) for a in range(300) for b in range(a + 1, 300) if 5 * len(np.intersect1d(sets[a], sets[b])) >= 4 * len(np.union1d(sets[a], sets[b]))}
    assert links <= met and len(links) >= 50 and (300, 301) in met and len(met) < 2 * len(links)


# ---- exact substrings


def cut(rows, length):
    seen, out = set(), {}
    for k, t in sorted(rows):
        raw = (t or "").encode()
        off = np.zeros(len(raw), bool)
        for p in range(len(raw) - length + 1):
            w = raw[p : p + length]
            if w in seen:
                off[p : p + length] = True
            seen.add(w)
        spans = int((off & ~np.r_[False, off[:-1]]).sum()) if len(off) else 0
        out[k] = (len(raw), int(off.sum()), spans, np.frombuffer(raw, np.uint8)[~off].tobytes())
    return out


@pytest.mark.parametrize("group", [prefix_free.GROUP, 1])
def test_prefix_free(spark, docs, odd, empty, group):
    rows = [(k, t if len(t or "") < 50_000 else t[:20_000]) for k, t in ROWS]
    d = frame(spark, rows)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in prefix_free.remove_repeats(d, group=group).collect()}
    assert got == cut(rows, 100)
    if group == 1:
        return
    assert prefix_free.remove_repeats(odd).count() == odd.count()
    assert prefix_free.remove_repeats(empty).count() == 0
    carried = prefix_free.remove_repeats(d, carry=("key", "carried", "at")).select("carried.key", "carried.carried", "carried.at")
    assert {tuple(r) for r in carried.collect()} == {("k", "c", 1)}


def test_prefix_free_on_random_texts(spark):
    rng = random.Random(3)
    parts = ["".join(rng.choice("ab ") for _ in range(rng.randint(5, 60))) for _ in range(12)]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))) for i in range(60)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in prefix_free.remove_repeats(frame(spark, rows), length=30, gram=12, group=2).collect()}
    assert got == cut(rows, 30)


def test_prefix_free_on_repeated_rows(spark):
    """Equal rows are one place and keep what one of them keeps; other rows of an id are documents by hash of their text."""
    rng = random.Random(11)
    shared, own = _words(rng, 60), [_words(rng, 60) for _ in range(6)]
    rows = [
        (7, own[0] + shared), (7, own[0] + shared), (7, own[1]), (None, own[2]), (None, own[2]), (None, own[2]), (None, own[3] + own[3]),
        (None, own[3] + own[3]), (9, own[4] + own[2]), (9, own[4] + own[2]), (12, shared + own[5]), (12, shared + own[5]), (13, None), (13, None),
    ]

    def place(row):
        h = xxhash.xxh64_intdigest((row[1] or "").encode(), 42)
        return (row[0] is not None, row[0] or 0, h - (h >> 63 << 64))

    places = sorted(set(rows), key=place)
    want = {places[i]: v for i, v in cut([(i, t) for i, (_, t) in enumerate(places)], 100).items()}
    got = [(r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept))) for r in prefix_free.remove_repeats(frame(spark, rows)).collect()]
    assert collections.Counter(got) == collections.Counter((r[0], want[r]) for r in rows)
    assert (None, (len(own[2]), 0, 0, own[2].encode())) in got


# ---- vectors


def test_vectors(spark):
    rng = np.random.default_rng(2)
    centre = rng.standard_normal((6, 16))
    x = [(c + 0.12 * rng.standard_normal(16)).astype(np.float32).tolist() for c in centre for _ in range(25)]
    x += rng.standard_normal((60, 16)).astype(np.float32).tolist()
    x += [x[0], x[0], None, [], [0.0] * 16, [float("nan")] * 16, [None, *x[0][1:]], [2 * v for v in x[3]], [1.0, 2.0], [2.0, 4.0]]
    rows = [(i * 2, v, i) for i, v in enumerate(x)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, id int").repartition(3)
    good = [i for i, v in enumerate(x) if v and None not in v and np.isfinite(v).all() and any(v)]
    edges = []
    for b in good:
        for a in good:
            if a < b and len(x[a]) == len(x[b]):
                p, q = np.float64(x[a]), np.float64(x[b])
                if p @ q / np.linalg.norm(p) / np.linalg.norm(q) >= 0.95:
                    edges.append((a, b))
    n = collections.Counter(i for e in edges for i in e)
    want = least(len(x), edges)
    got = {r.vec_id: r for r in cap_filters.near_vectors(d).collect()}
    assert len(got) == len(x)
    found = sum(r.n_links for r in got.values())
    assert found >= 0.9 * 2 * len(edges) and all(got[2 * i].n_links <= n[i] for i in range(len(x)))
    assert np.mean([got[2 * i].component_id == 2 * want[i] for i in range(len(x))]) > 0.98
    assert all(got[2 * i].n_links == 0 and got[2 * i].kept for i in range(len(x)) if i not in good)
    assert cap_filters.near_vectors(d.limit(0)).count() == 0


def linked(rows, cosine=0.95):
    """vec_id, n_links, component of each row, by all pairs of those with an id."""
    unit = []
    for k, v in rows:
        x = np.array(v, np.float64) if k is not None and v and None not in v else np.zeros(1)
        x = x / np.abs(x).max() if np.isfinite(x).all() and x.any() else None
        unit.append(None if x is None else x / np.linalg.norm(x))
    edges = [
        (i, j) for j in range(len(rows)) for i in range(j)
        if unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine
    ]
    n = collections.Counter(i for e in edges for i in e)
    part = least(len(rows), edges)
    low = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            low[part[i]] = min(k, low.get(part[i], k))
    return collections.Counter((k, n[i], low.get(part[i]) if k is not None else None) for i, (k, _) in enumerate(rows))


def test_vectors_in_few_dimensions(spark):
    """Every link is found in 1 to 8 dimensions, at extreme magnitudes, and rows that share an id have their own links."""
    rng = np.random.default_rng(8)
    rows = []
    for dim in (1, 2, 3, 4, 8):
        for _ in range(40):
            x = rng.standard_normal(dim)
            rows.append((len(rows), x.tolist()))
            rows.append((len(rows), ((x + 0.05 * rng.standard_normal(dim)) * 10.0 ** rng.integers(-3, 4)).tolist()))
    rows += [(900, [1e200, 1e200]), (901, [1e-200, 1.01e-200]), (902, [1e300, -1e300]), (5, rows[0][1]), (5, [0.0, 0.0]), (7, rows[9][1]), (7, rows[9][1]), (None, rows[9][1])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = collections.Counter((r.vec_id, r.n_links, r.component_id) for r in cap_filters.near_vectors(d).collect())
    assert got == linked(rows)


@pytest.mark.parametrize(("dim", "n"), [(64, 2_000), (64, 200_000), (64, 2_000_000), (32, 200_000), (2, 2_000)])
def test_filters_of_near_vectors_at_any_size(dim, n):
    """Filters a vector passes do not shrink with n, and pairs just above the cosine share one."""
    rng = np.random.default_rng(6)
    x, y = rng.standard_normal((2, 150, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (y * x).sum(1, keepdims=True) * x
    y = 0.951 * x + np.sqrt(1 - 0.951**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    row, which = cap_filters.decode(np.r_[x, y], *cap_filters.code_size(n, dim))
    assert len(row) / 300 == pytest.approx(cap_filters.LIST * cap_filters.code_size(n, dim)[0], rel=0.25)
    of = [set(which[row == i].tolist()) for i in range(300)]
    assert sum(bool(of[i] & of[i + 150]) for i in range(150)) >= 149


# ---- licenses


def test_licenses(docs, odd, empty):
    got = {(r.doc_id, r.license): r for r in license_scan.scan_licenses(docs).collect()}
    assert set(got) == {(54, "MIT"), (57, "CC-BY-NC-4.0")}
    assert got[54, "MIT"].containment == 1.0 and got[57, "CC-BY-NC-4.0"].first_word == 1
    assert license_scan.scan_licenses(odd).count() == 2
    assert license_scan.scan_licenses(empty).count() == 0


def test_license_of_many_words_with_edits(spark):
    rng = random.Random(9)
    notice = _words(rng, 160).split()
    edited = list(notice)
    edited[40] = edited[120] = "other"
    far = [w if i % 4 else "x" for i, w in enumerate(notice)]
    rows = [(i, " ".join([*_words(rng, 77).split(), *v, *_words(rng, 50).split()])) for i, v in enumerate((notice, edited, far))]
    got = {r.doc_id: r.containment for r in license_scan.scan_licenses(frame(spark, rows), {"own": " ".join(notice)}).collect()}
    assert got[0] == 1.0 and 0.9 < got[1] < 1.0 and 2 not in got


# ---- toxicity


def test_toxicity(spark, docs, odd, empty):
    rng = random.Random(4)
    bad = ["idiot", "moron", "scum", "vequ"]
    rows, labels = [], []
    for i in range(600):
        t = _words(rng, 60).split()
        toxic = i % 4 == 0
        if toxic:
            for j in rng.sample(range(60), 1 + i % 5):
                t[j] = rng.choice(bad) + ("" if rng.random() < 0.6 else _words(rng, 1))
        rows.append((i, " ".join(t)))
        labels.append((i, int(toxic)))
    d = frame(spark, rows)
    known = spark.createDataFrame([*labels[:400], (None, 1), (7, None)], "doc_id long, toxic int")
    model = toxicity.fit(d, known)
    assert (np.diff(model.thresholds) > 0).all()
    got = {r.doc_id: r for r in toxicity.score_documents(d, model).collect()}
    held = labels[400:]
    assert np.mean([got[i].toxic == bool(y) for i, y in held]) > 0.95
    graded = [got[i].severity for i, y in held if y]
    assert np.corrcoef([sum(w.startswith(tuple(bad)) for w in rows[i][1].split()) for i, y in held if y], graded)[0, 1] > 0.5
    plain = {r.doc_id: r for r in toxicity.score_documents(docs, model).collect()}
    assert all(plain[k].severity == 0 and not plain[k].toxic for k, t in ROWS if not (t or "").strip())
    assert plain[63].toxic and not plain[0].toxic
    assert toxicity.score_documents(odd, model).count() == odd.count()
    assert toxicity.score_documents(empty, toxicity.fit(empty, known)).count() == 0
    assert not any(r.toxic for r in toxicity.score_documents(d, toxicity.fit(d, known.limit(0))).collect())


# ---- mixing


def test_mixing(spark, docs, odd, empty):
    rng = random.Random(8)
    rows = []
    for i in range(400):
        low = i % 5 == 0
        rows.append((i, " ".join(["$$$"] * 40) if low else _words(rng, 40 + i % 30), "en" if i % 3 else "fr", "s", 0, "k", 1, 2, "i", "s", 3, "w", 4, "c"))
    d = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 5 != 0)) for i in range(0, 400, 2)] + [(None, 1), (3, None)], "doc_id long, quality int")
    r = {x.doc_id: x for x in mixing.mixing_rates(d, labels).collect()}
    assert all(x.rate >= 0 for x in r.values()) and {x.domain for x in r.values()} == {"en/0", "en/1", "fr/0", "fr/1"}
    now, then = collections.Counter(), collections.Counter()
    for x in r.values():
        now[x.domain] += x.n_tokens
        then[x.domain] += x.n_tokens * x.rate
    for k, v in now.items():  # the classes are clear, so hard totals follow the targets too
        assert then[k] == pytest.approx(v * (v / max(now.values())) ** -0.3, rel=0.05)
    goal = {k: 1000.0 for k in now}
    rate = {x.doc_id: x.rate for x in mixing.mixing_rates(d, labels, goal).collect()}
    traits = mixing.described(d)
    names, model, prior = mixing._domains(traits, labels, "doc_id", "quality")
    soft = mixing.posteriors(traits, model, prior).collect()
    expected = sum(rate[x.doc_id] * x.n_tokens * np.array(x.posterior) for x in soft)
    assert sorted(goal) == names and expected == pytest.approx(np.full(4, 1000.0), rel=0.01)
    assert {x.rate for x in mixing.mixing_rates(d, labels.limit(0)).collect()} == {1.0}
    assert mixing.mixing_rates(odd, labels).count() == odd.count()
    assert mixing.mixing_rates(empty, labels).count() == 0


def test_mixing_of_skewed_domains_and_zero_targets(spark):
    """A small domain that must grow thousandfold, one that is not wanted, and targets that cannot be met together."""
    rng = random.Random(12)
    rows = []
    for i in range(300):
        lang = ("en", "de", "fr")[0 if i >= 6 else 1 if i >= 3 else 2]
        rows.append((i, _words(rng, 400 if lang == "en" else 5), lang, "s", 0, "k", 1, 2, "i", "s", 3, "w", 4, "c"))
    d = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, 1) for i in range(300)], "doc_id long, quality int")
    traits = mixing.described(d)
    names, model, prior = mixing._domains(traits, labels, "doc_id", "quality")
    soft = mixing.posteriors(traits, model, prior).collect()
    assert names == ["de/1", "en/1", "fr/1"]

    def totals(goal):
        rate = {x.doc_id: x.rate for x in mixing.mixing_rates(d, labels, goal).collect()}
        assert all(r >= 0 for r in rate.values())
        return sum(rate[x.doc_id] * x.n_tokens * np.array(x.posterior) for x in soft)

    assert totals({"de/1": 2e5, "en/1": 2e5, "fr/1": 3e5}) == pytest.approx([2e5, 2e5, 3e5], rel=0.01)
    assert totals({"en/1": 4e4}) == pytest.approx([0.0, 4e4, 0.0], rel=0.01, abs=100)
    alike = d.withColumn("lang", F.lit("en")).withColumn("text", F.lit("a b"))
    both = labels.withColumn("quality", (F.col("doc_id") % 2).cast("int"))
    with pytest.warns(UserWarning, match="not reached"):
        mixing.mixing_rates(alike, both, {"en/0": 1e3, "en/1": 1e4}).count()


def test_mixing_against_projected_gradient(spark):
    """Totals of the rates are those of a plain projected gradient over all documents, one with targets out of reach too."""
    rng = random.Random(21)
    rows = []
    for i in range(240):
        text = _words(rng, 10 + rng.randrange(60)) + " " + "$ " * rng.randrange(0, 40 if i % 3 == 0 else 4)
        rows.append((i, text, ("en", "de")[i % 5 == 0], "s", 0, "k", 1, 2, "i", "s", 3, "w", 4, "c"))
    d = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(240)], "doc_id long, quality int")
    traits = mixing.described(d)
    names, model, prior = mixing._domains(traits, labels, "doc_id", "quality")
    soft = mixing.posteriors(traits, model, prior).collect()
    p, w = np.array([x.posterior for x in soft]), np.array([x.n_tokens for x in soft], float)
    for goal in (np.array([900.0, 3000.0, 2500.0, 4000.0]), np.array([1.0, 50_000.0, 1.0, 100.0])):
        r = np.ones(len(w))
        step = 1 / np.linalg.eigvalsh((p / np.sqrt(goal)).T @ (w[:, None] * p / np.sqrt(goal)))[-1]
        y, t = r, 1.0
        for _ in range(60_000):  # accelerated
            new = np.maximum(0, y - step * p @ (((w * y) @ p - goal) / goal))
            t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
            y, r = new + (before - 1) / t * (new - r), new
        best = ((((w * r) @ p - goal) ** 2) / goal).sum()
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            rate = {x.doc_id: x.rate for x in mixing.mixing_rates(d, labels, dict(zip(names, goal, strict=True))).collect()}
        own = np.array([rate[x.doc_id] for x in soft])
        got = ((((w * own) @ p - goal) ** 2) / goal).sum()
        assert (own >= 0).all() and got <= best * 1.001 + 1e-3


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(300, 400)] + [(5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame([*edges, (None, 3)], "a long, b long")).collect()}
    want = least(401, edges)
    met = {i for a, b in edges if a != b for i in (a, b)}
    assert got == {i: want[i] for i in met}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0

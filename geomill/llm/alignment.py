"""Alignment of the tokens of two tokenizers by the byte places where both end, and how often ids are linked corpus-wide.

Tokens of a byte-level BPE (side A) and of a piece model with byte fallback (side B) are laid over the bytes of a space
and the text. Both tokenizers start anew at a space that follows a sign, so texts are aligned by such fields, each new
field once; a document's groups are those of its fields. Links are counted by blocks of documents: a block asks for its
distinct id pairs and is cogrouped with the answers.
"""

from __future__ import annotations

import hashlib
import json
import re
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from geomill.llm.common import bounded_batches, discard, give_back, slices, written
from geomill.llm.remembered import Remembered, built

#: Bytes of text in one block of documents, and signs of new fields that are encoded as one text.
BLOCK, TOGETHER = 2_000_000, 50_000
#: Bytes of fields that one generation of a worker's memory holds.
REMEMBERED = 90_000_000
#: Fields start at a space after a sign that is no white space: there both tokenizers have a boundary, whatever follows.
_FIELD, _GAP = re.compile(r"(?<=\S) "), re.compile(r"\s ")
_PLAIN_PIECE = re.compile("▁*[^▁]*", re.DOTALL)


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable ones stand for themselves, others follow from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Sides:
    """Both tokenizers with the bytes of their tokens."""

    def __init__(self, a_raw: str, b_raw: bytes):
        self.a = Tokenizer.from_str(a_raw)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True  # their strings are ordinary text
        letters = byte_letters()
        vocabulary = json.loads(a_raw)["model"]["vocab"]
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(map(letters.__getitem__, token))
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_raw)
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
            if not _PLAIN_PIECE.fullmatch(piece):
                raise ValueError("a piece holds a space after another sign, so fields are not independent")
        self.space = self.b.piece_to_id("▁")
        self.a_size, self.b_size = list(map(len, self.a_bytes)), list(map(len, self.b_bytes))
        self.a_text, self.b_text = list(map(str, range(len(self.a_bytes)))), list(map(str, range(len(self.b_bytes))))

    def aligned(self, fields: list[str]) -> list[tuple]:
        """For each field (groups as text, n_a, n_b, n_groups, packed links), or None where the bytes are not those of the field.

        Fields are given without the space before them. Those that end in no white space are independent of what follows
        and are encoded many in one text.
        """
        out: dict[int, tuple | None] = {}
        some, size = [], 0
        for k, field in enumerate(fields):
            if not field or field[-1].isspace():
                self._align([k], [field], out)
                continue
            some.append(k)
            size += len(field)
            if size > TOGETHER:
                self._align(some, [fields[i] for i in some], out)
                some, size = [], 0
        if some:
            self._align(some, [fields[i] for i in some], out)
        return list(map(out.__getitem__, range(len(fields))))

    def _align(self, places: list[int], fields: list[str], out: dict[int, tuple | None]) -> None:
        text = " ".join(fields)
        a = self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids
        b = self.b.encode(text, num_threads=1) if text else [self.space]  # the model adds the space, save to an empty text
        raw = b" " + text.encode()
        if b"".join(map(self.a_bytes.__getitem__, a)) != raw or b"".join(map(self.b_bytes.__getitem__, b)) != raw:
            if len(fields) == 1:
                out[places[0]] = None
                return
            half = len(fields) // 2
            self._align(places[:half], fields[:half], out)
            self._align(places[half:], fields[half:], out)
            return
        a_size, b_size = list(map(self.a_size.__getitem__, a)), list(map(self.b_size.__getitem__, b))
        a_stop, b_stop, stops = common_ends(a_size, b_size)
        ends = list(accumulate(1 + (len(x) if x.isascii() else len(x.encode())) for x in fields))  # of fields, which are ends of tokens on both sides
        a_text, b_text = list(map(self.a_text.__getitem__, a)), list(map(self.b_text.__getitem__, b))
        spans = zip(a_stop, a_stop[1:], b_stop, b_stop[1:], strict=False)
        groups = [f"{a_text[i]}|{b_text[k]}" if j - i == 1 == m - k else ",".join(a_text[i:j]) + "|" + ",".join(b_text[k:m]) for i, j, k, m in spans]
        stop_a, stop_b = np.array(a_stop), np.array(b_stop)
        at_a, at_b, first = links_of(a_size, b_size, stop_a, stop_b)
        packed = (np.array(a, np.int64)[at_a] * len(self.b_bytes) + np.array(b, np.int64)[at_b]).astype("<u4").tobytes()
        last = np.searchsorted(stops, ends) + 1  # groups up to the end of each field
        begin = np.r_[0, last[:-1]]
        count_a, count_b = stop_a[last] - stop_a[begin], stop_b[last] - stop_b[begin]
        for k, i, j, x, y, u, v in zip(places, begin.tolist(), last.tolist(), count_a.tolist(), count_b.tolist(), (4 * first[begin]).tolist(), (4 * first[last]).tolist(), strict=True):
            out[k] = (";".join(groups[i:j]), x, y, j - i, packed[u:v])


def common_ends(a: list[int], b: list[int]) -> tuple[list[int], list[int], list[int]]:
    """How many tokens of each side, given by their lengths, end by each place where both have an end, from 0 on; and the places."""
    a_at = dict(zip(accumulate(a), range(1, len(a) + 1), strict=True))
    b_at = dict(zip(accumulate(b), range(1, len(b) + 1), strict=True))
    stops = sorted(a_at.keys() & b_at.keys())
    return [0, *map(a_at.__getitem__, stops)], [0, *map(b_at.__getitem__, stops)], stops


def links_of(a: list[int], b: list[int], a_stop: np.ndarray, b_stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of both sides whose byte ranges overlap, group by group, and how many of these pairs lie before each group."""
    n_a, n_b = np.diff(a_stop), np.diff(b_stop)
    tangled = np.flatnonzero((n_a > 1) & (n_b > 1)).tolist()
    at = zip(tangled, a_stop[tangled].tolist(), a_stop[1:][tangled].tolist(), b_stop[tangled].tolist(), b_stop[1:][tangled].tolist(), strict=True)
    found = {g: overlaps(a[i:j], b[k:m]) for g, i, j, k, m in at}
    n = np.maximum(n_a, n_b)  # one token of a side meets all of the other
    n[tangled] = list(map(len, found.values()))
    first = np.r_[0, np.cumsum(n)]
    step = np.arange(first[-1]) - np.repeat(first[:-1], n)
    at_a = np.repeat(a_stop[:-1], n) + np.where(np.repeat(n_a > 1, n), step, 0)
    at_b = np.repeat(b_stop[:-1], n) + np.where(np.repeat(n_b > 1, n), step, 0)
    if found:
        spots = np.concatenate([np.arange(first[g], first[g + 1]) for g in tangled])
        own = np.array([x for pairs in found.values() for x in pairs])
        at_a[spots] = np.repeat(a_stop[tangled], n[tangled]) + own[:, 0]
        at_b[spots] = np.repeat(b_stop[tangled], n[tangled]) + own[:, 1]
    return at_a, at_b, first


def overlaps(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Pairs of tokens of one group, given by their lengths, whose ranges overlap."""
    i = k = 0
    a_end, b_end, out = a[0], b[0], []
    while True:
        out.append((i, k))
        if a_end == b_end:
            return out  # only at the end of the group
        if a_end < b_end:
            i += 1
            a_end += a[i]
        else:
            k += 1
            b_end += b[k]


def split_fields(text: str) -> list[str]:
    """The fields of a space and the text, without the space that each begins with."""
    if text.startswith(" ") or _GAP.search(text):
        first, *rest = _FIELD.split(" " + text)
        return [first[1:], *rest]
    return text.split(" ")


_ALIGNED = {"n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "groups": pa.string(), "block": pa.int64(), "wide": pa.bool_(), "links": pa.binary(), "pairs": pa.binary(), "times": pa.binary()}
_NO_TOKENS = ("", 0, 0, 0)


def _placed(links: list[bytes]) -> tuple[np.ndarray, int, list[bytes]]:
    """The distinct id pairs of fields, the bytes of a place among them, and the places of each field's links."""
    pairs, place = np.unique(np.frombuffer(b"".join(links), "<u4"), return_inverse=True)
    width = 4 if len(pairs) > 1 << 16 else 2
    raw = place.astype(f"<u{width}").tobytes()
    ends = [0, *accumulate(len(x) // 4 * width for x in links)]
    return pairs.astype("<u4"), width, [raw[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True)]


def align_documents(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text's tokens by two tokenizers, cut into groups where both end.

    Gives doc_id, n_a, n_b, n_groups, n_links, groups (`a1,a2|b1;a3|b2`: ids in order) and the links by block: `links`
    are the places of a document's links in its block's distinct id pairs, packed in two bytes or, where wide, four;
    the first document of a block has `pairs` (packed a * vocabulary of B + b) and `times`, how often the block has each.

    Special strings are plain text. A null or empty text, or one whose tokens' bytes are not a space and the text, has no
    tokens: zeros and an empty string. Repeated rows and null keys: a row each. Empty table: no rows. Other columns are
    not carried. The files are read on the driver and broadcast; their size does not depend on the data.
    """
    with open(a_path, encoding="utf-8") as f:
        a_raw = f.read()
    with open(b_path, "rb") as f:
        b_raw = f.read()
    name = hashlib.sha256(a_raw.encode() + b_raw).hexdigest()
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((a_raw, b_raw))
    kind = docs.schema[key].dataType.simpleString()
    bounded_batches(spark)

    def scan(batches):
        def memory() -> Remembered:
            sides = Sides(*shared.value)
            return Remembered(sides.aligned, 240, REMEMBERED)

        known = built(("alignment", name), memory)
        for batch in batches:
            for part in slices(batch, "text", BLOCK):
                found = [split_fields(x) if x else [] for x in part.column("text").to_pylist()]
                distinct = list(set().union(*found))
                got = known.of(set(distinct))
                met = [f for f in distinct if got[f] is not None]
                values = [got[f] for f in met]
                pairs, width, places = _placed([v[4] for v in values])
                of = {f: (*v[:4], x) for f, v, x in zip(met, values, places, strict=True)}.__getitem__
                bad = set(distinct).difference(met)
                rows, raw = [], []
                for fields in found:
                    if not fields or not bad.isdisjoint(fields):
                        rows.append(_NO_TOKENS)
                        raw.append(b"")
                        continue
                    texts, n_a, n_b, n_groups, links = zip(*map(of, fields), strict=True)
                    rows.append((";".join(texts), sum(n_a), sum(n_b), sum(n_groups)))
                    raw.append(b"".join(links))
                del found, of, values
                wide = width == 4
                times = np.bincount(np.frombuffer(b"".join(raw), f"<u{width}"), minlength=len(pairs)).astype("<u4")
                n, rest = len(raw), [None] * (len(raw) - 1)
                columns = {
                    "n_a": [r[1] for r in rows], "n_b": [r[2] for r in rows], "n_groups": [r[3] for r in rows], "n_links": [len(x) // width for x in raw],
                    "groups": [r[0] for r in rows], "block": [part.column("row")[0].as_py()] * n, "wide": [wide] * n,
                    "links": raw, "pairs": [pairs.tobytes(), *rest], "times": [times.tobytes(), *rest],
                }
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(columns[c], k) for c, k in _ALIGNED.items())], ["doc_id", *_ALIGNED])
        give_back()

    d = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    out = "n_a long, n_b long, n_groups long, n_links long, groups string, block long, wide boolean, links binary, pairs binary, times binary"
    return d.mapInArrow(scan, f"doc_id {kind}, {out}")


def _asked(aligned: DataFrame) -> DataFrame:
    """(block, place, pair, times): the distinct id pairs of each block."""

    def scan(batches):
        for batch in batches:
            for block, pairs, times in zip(*(batch.column(c).to_pylist() for c in ("block", "pairs", "times")), strict=True):
                p = np.frombuffer(pairs, "<u4").astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(p), block)), pa.array(np.arange(len(p))), pa.array(p), pa.array(np.frombuffer(times, "<u4").astype(np.int64))], ["block", "place", "pair", "times"]
                )

    return aligned.where("pairs is not null").select("block", "pairs", "times").mapInArrow(scan, "block long, place long, pair long, times long")


def pair_counts(asked: DataFrame, b_size: int) -> DataFrame:
    """(pair, count, best): how many links hold each id pair, and whether no other pair of its B id has more."""
    counts = asked.groupBy("pair").agg(F.sum("times").alias("count")).withColumn("b", F.col("pair") % b_size)
    counts = written(counts, "pair-counts")  # at most one row for each pair of two vocabularies
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    return counts.join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def score_links(aligned: DataFrame, b_size: int, carry: list[str]) -> DataFrame:
    """Rows of align_documents as doc_id, the columns of `carry`, n_best and count_sum.

    count_sum adds up, over a document's links, how many links of the whole corpus hold that id pair; n_best counts the
    links whose pair is the most frequent of its B id, ties included. No document is dealt by id pair: a block's distinct
    pairs go out, are counted, and come back to it.
    """
    aligned = written(aligned.select("doc_id", *carry, "block", "wide", "links", "pairs", "times"), "aligned")
    asked = written(_asked(aligned), "asked")
    answers = asked.select("block", "place", "pair").join(pair_counts(asked, b_size), "pair").select("block", "place", "count", "best")
    kinds = ", ".join(f"`{c}` {aligned.schema[c].dataType.simpleString()}" for c in ("doc_id", *carry))

    def score(rows: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        count, best = np.zeros(len(got), np.int64), np.zeros(len(got), np.int64)
        at = got["place"].to_numpy()
        count[at], best[at] = got["count"].to_numpy(), got["best"].to_numpy()
        links = [np.frombuffer(x, "<u4" if wide else "<u2") for x, wide in zip(rows["links"], rows["wide"], strict=True)]
        return rows[["doc_id", *carry]].assign(n_best=[int(best[x].sum()) for x in links], count_sum=[int(count[x].sum()) for x in links])

    dealt = aligned.select("doc_id", *carry, "block", "wide", "links").groupBy("block").cogroup(answers.groupBy("block"))
    return dealt.applyInPandas(score, f"{kinds}, n_best long, count_sum long")


def piece_count(b_path: str) -> int:
    return sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()

"""Token counts of whole texts; huge texts are encoded as overlapping chunks that are spliced where their tokens agree.

A boundary is proven when both chunks start a pre-token at the same place of the text and neither the cut of a chunk
nor Unicode composition can reach over it. Pre-tokens are found by one scan from left to right that looks only ahead, so
from such a place on both scans see the same text in the same state: what the left chunk has before it and the right
chunk from it on are the tokens of the whole text.
"""

from __future__ import annotations

import hashlib
import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from geomill.llm.common import bounded_batches, discard, give_back, slices, small_or_not, written
from geomill.llm.remembered import Remembered, built

#: Characters of a chunk and of what the next one repeats of it. Texts of more than CHUNK characters are huge.
CHUNK, OVERLAP = 32_768, 512
#: Where chunks do not agree the document is cut anew with both so many times as wide.
WIDER = 4
#: Characters before a cut in which no boundary counts, as a match may look so far ahead; no less than a special string.
AHEAD = 16
#: Chunks that are encoded, or cut, at once.
TOGETHER = 16
_SPACE = frozenset(" \t\n\v\f\r")
_PROBES = ["it's a test", "don't  stop\nnow", "x ' s", "<|a b|>", "1 2,3 . !", "\tá ́b\r\n"]


def _tokenizer(raw: str) -> Tokenizer:
    tokenizer = Tokenizer.from_str(raw)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _counts(tokenizer: Tokenizer, texts: list[str]) -> list[int]:
    return [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def check_white_space(raw: str) -> int:
    """The characters before a cut in which no boundary counts; an error if this tokenizer's tokens run over white space."""
    tokenizer = _tokenizer(raw)
    special = [t["content"] for t in json.loads(raw).get("added_tokens") or [{"content": ""}]]
    if any(set(t) & _SPACE for t in special):
        raise ValueError("a special string holds white space")
    for text in _PROBES:
        if _counts(tokenizer, [text])[0] != sum(_counts(tokenizer, text.split())):
            raise ValueError("this tokenizer has tokens over white space; its texts cannot be counted by parts")
    return max(AHEAD, *map(len, special))


def inert(text: str, at: int) -> bool:
    """Whether what stands before a place of the text cannot be composed with what follows it.

    Nothing below U+0300 and no ideograph is the second part of a composition, and nothing composes with white space.
    """
    c = ord(text[at])
    return c < 0x300 or 0x3400 <= c <= 0x9FFF or (at > 0 and text[at - 1] in _SPACE)


def boundaries(text: str, words: list, offsets: list, low: int, high: int, cut: int) -> list[tuple[int, int]]:
    """(place, tokens before it) of the proven starts of pre-tokens from low up to high that end `cut` before the text's end.

    words and offsets are those of the tokens of the text.
    """
    out = []
    last = len(text) - cut
    for t, (at, _) in enumerate(offsets):
        if low <= at <= high and at <= last and at < len(text) and (t == 0 or words[t] != words[t - 1] or words[t] is None) and inert(text, at):
            out.append((at, t))
    return out


def _cut(texts: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """Overlapping chunks of texts(row, text): (row, i, at, last, piece), places counted in characters."""

    def scan(batches):
        for batch in batches:
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist(), strict=True):
                starts = range(0, max(1, len(text) - overlap), chunk)
                for first in range(0, len(starts), TOGETHER):
                    some = starts[first : first + TOGETHER]
                    columns = [[row] * len(some), range(first, first + len(some)), some, [a + chunk + overlap >= len(text) for a in some], [text[a : a + chunk + overlap] for a in some]]
                    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["row", "i", "at", "last", "piece"])
        give_back()

    return texts.select("row", "text").mapInArrow(scan, "row long, i long, at long, last boolean, piece string")


def _encoded(pieces: DataFrame, shared, name: str, chunk: int, overlap: int, guard: int) -> DataFrame:
    """(row, i, total, heads, tails): a chunk's tokens, and the tokens before each proven boundary of what it shares on both sides."""

    def scan(batches):
        tokenizer = built(("tokenizer", name), lambda: _tokenizer(shared.value))
        edge = pa.map_(pa.int64(), pa.int64())
        for batch in batches:
            for at in range(0, len(batch), TOGETHER):
                part = batch.slice(at, TOGETHER)
                texts = part.column("piece").to_pylist()
                totals, heads, tails = [], [], []
                for text, start, i, last, enc in zip(texts, part.column("at").to_pylist(), part.column("i").to_pylist(), part.column("last").to_pylist(), tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
                    totals.append(len(enc))
                    words, offsets = enc.word_ids, enc.offsets
                    cut = 0 if last else guard
                    heads.append([(start + p, n) for p, n in boundaries(text, words, offsets, 0, overlap, cut)] if i else [])
                    tails.append([] if last else [(start + p, n) for p, n in boundaries(text, words, offsets, chunk, chunk + overlap, cut)])
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("i"), pa.array(totals, pa.int64()), pa.array(heads, edge), pa.array(tails, edge)], ["row", "i", "total", "heads", "tails"]
                )
        give_back()

    return pieces.mapInArrow(scan, "row long, i long, total long, heads map<long,long>, tails map<long,long>")


def _spliced(encoded: DataFrame) -> DataFrame:
    """(row, n_tokens, bad): the chunks' tokens without those that both of two neighbours have; bad where two don't agree.

    Neighbours meet by row and number, so the chunks of one document never come into one task.
    """
    left = encoded.select("row", (F.col("i") + 1).alias("i"), "total", "tails")
    met = left.join(encoded.select("row", "i", "heads"), ["row", "i"])
    common = F.array_intersect(F.map_keys("tails"), F.map_keys("heads"))
    met = met.withColumn("common", common).withColumn("shifts", F.array_distinct(F.transform("common", lambda p: F.element_at("tails", p) - F.element_at("heads", p))))
    twice = F.when(F.size("shifts") == 1, F.col("total") - F.get("shifts", F.lit(0)))
    joints = met.select("row", (-twice).alias("n"), twice.isNull().alias("bad"))
    every = encoded.select("row", F.col("total").alias("n"), F.lit(False).alias("bad")).unionByName(joints)
    return every.groupBy("row").agg(F.sum("n").alias("n_tokens"), F.bool_or("bad").alias("bad"))


def count_tokens(
    docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """Rows doc_id, n_bytes, n_tokens: the tokens of each whole text as the library counts them for a tokenizer file.

    No begin or end tokens are added; special strings inside a text are what the library makes of them by default. A text
    of at most `chunk` characters is counted by its fields between ASCII white space, each new field encoded by the
    library and remembered (no token runs over white space, which check_white_space asserts). A longer text is cut into
    chunks that overlap; these are dealt to tasks, encoded with offsets and spliced at boundaries proven stable
    (module docstring). A document with a joint without such a boundary is cut anew, chunks and overlaps WIDER times
    as wide, until one chunk holds it.

    Null text: 0 bytes, 0 tokens, as the empty one. Repeated rows and null keys: a row each. Empty table: no rows. Other
    columns are not carried. Bytes that are no UTF-8 count as the replacement character.
    """
    if not 0 < overlap < chunk:
        raise ValueError("the overlap must lie inside a chunk")
    with open(tokenizer_path, encoding="utf-8") as f:
        raw = f.read()
    guard, name = check_white_space(raw), hashlib.sha256(raw.encode()).hexdigest()
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(raw)  # a vocabulary file: its size does not depend on the data
    kind = docs.schema[key].dataType.simpleString()
    bounded_batches(spark)

    def scan(batches):
        def memory() -> Remembered:
            tokenizer = _tokenizer(shared.value)
            return Remembered(lambda fields: _counts(tokenizer, [x.decode("utf-8", "replace") for x in fields]), 28)

        known = built(("counts", name), memory)
        for batch in batches:
            for part in slices(batch, "text", 4_000_000):
                found = [x.split() for x in part.column("text").to_pylist()]
                whole = [n <= chunk for n in part.column("chars").to_pylist()]
                count = known.of(set().union(*(x for x, w in zip(found, whole, strict=True) if w))).__getitem__
                tokens = [sum(map(count, x)) if w else None for x, w in zip(found, whole, strict=True)]
                texts = pa.array([None if w else x.as_py().decode("utf-8", "replace") for x, w in zip(part.column("text"), whole, strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("doc_id"), part.column("n_bytes"), pa.array(tokens, pa.int64()), texts], ["row", "doc_id", "n_bytes", "n_tokens", "text"])
        give_back()

    d = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    d = d.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.octet_length("t").cast("long").alias("n_bytes"), F.length("t").alias("chars"), F.col("t").cast("binary").alias("text"))
    first = written(d.mapInArrow(scan, f"row long, doc_id {kind}, n_bytes long, n_tokens long, text string"), "counted")
    out = first.where("n_tokens is not null").select("doc_id", "n_bytes", "n_tokens")
    huge = first.where("n_tokens is null")
    todo = huge.select("row", "text")
    while not todo.isEmpty():
        pieces = _cut(todo, chunk, overlap).repartition("row", "i")
        encoded = written(_encoded(pieces, shared, name, chunk, overlap, guard), "encoded")
        spliced = written(_spliced(encoded), "spliced")
        discard(encoded)
        done = spliced.where("not bad").select("row", "n_tokens")
        out = out.unionByName(huge.select("row", "doc_id", "n_bytes").join(small_or_not(done), "row").select("doc_id", "n_bytes", "n_tokens"))
        bad = spliced.where("bad").select("row")
        todo = huge.select("row", "text").join(small_or_not(bad), "row", "left_semi")
        chunk, overlap = chunk * WIDER, overlap * WIDER
    return out

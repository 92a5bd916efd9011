"""Substring deduplication by paragraphs: MinHash bands, exact Jaccard, removal by components.

Line breaks do not bound a repeated passage, so a paragraph is a block of LENGTH words around an anchor that the words
nearby set. Wherever a passage is pasted, inside lines or across them, its anchors and so its paragraphs come along.
Anchors are so near each other that, with a paragraph at either end of a text, every word lies in one.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geomill.llm.common import Rolling, bounded_batches, discard, mixed, packed, slices, small_or_not, text_bytes, tidy, with_type, written
from geomill.llm.common import words as split_words
from geomill.llm.near import LARGE, exact_classes, minhash

#: Words of a paragraph; word pairs become anchors by ascending hash, each unless one lies within REACH pairs. So next
#: anchors are 11 to 21 pairs apart.
LENGTH, REACH = 24, 10
#: Paragraphs whose first words are nearer than this would link for their common words alone (Jaccard 18/22 at 2, 17/23 at 3).
APART = 3
#: Rounds of choosing anchors; what is free after them (hashes that recur all along) is taken by steps of REACH + 1.
ROUNDS = 10
#: Bands of ROWS minima. At Jaccard 0.8 a pair shares a band with chance 1 - (1 - 0.8^3)^8 = 0.997, at 0.9 with 0.99997.
BANDS, ROWS = 8, 3
#: Passes over bands, over texts and over sets, each with its share of them all: what one shuffles is off the disk before the next.
PASSES = 2
#: Bytes of the 64-byte signature that may differ before sets are intersected: five standard deviations at Jaccard 0.8.
DIFFERING = 29
_VALUES = 64
_HASH = np.uint64(0xC2B2AE3D27D4EB4F)


def anchors(pair: np.ndarray, i: np.ndarray, left: np.ndarray, reach: int) -> np.ndarray:
    """Places of the anchors: pairs by ascending hash (equal ones from the left), each unless one is within `reach`.

    i and left: pairs of its text before each pair, and from it to the end, itself included (0: no pair begins there).
    Every pair of a text is within `reach` of an anchor.
    """
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    pair = np.minimum(pair, top - np.uint64(1))
    pair[left < 1] = top
    chosen, free = [], np.flatnonzero(left > 0)
    for last in [False] * ROUNDS + [True]:
        if not len(free):
            break
        if last:
            new = np.r_[True, (np.diff(free) > 1) | (i[free[1:]] == 0)]
            begin = free[np.maximum.accumulate(np.where(new, np.arange(len(free)), 0))]
            at = free[(free - begin) % (reach + 1) == 0]
        else:
            at = free
            for s in range(1, reach + 1):
                before = (i[at] < s) | (pair[at] < pair[np.maximum(at - s, 0)])
                behind = (left[at] <= s) | (pair[at] <= pair[np.minimum(at + s, len(pair) - 1)])
                at = at[before & behind]
        chosen.append(at)
        pair[at] = top
        for s in range(1, reach + 1):
            pair[at[i[at] >= s] - s] = top
            pair[at[left[at] > s] + s] = top
        free = free[pair[free] != top]
    return np.sort(np.concatenate(chosen)) if chosen else free


def reached(count: np.ndarray, length: int) -> np.ndarray:
    """Words of a paragraph in texts of so many words: a text too short for two is one paragraph as a whole."""
    return np.where(count < length + APART, count, length)


class Blocks:
    """The paragraphs of all rows of a byte array: row, first word (in its text and of all), and shingles by first word."""

    def __init__(self, data: np.ndarray, off: np.ndarray, k: int, length: int, reach: int):
        low, self.start, self.end, row = split_words(data, off)
        n = len(off) - 1
        count = np.bincount(row, minlength=n)
        base = np.r_[0, np.cumsum(count)]
        i = np.arange(len(row)) - base[row]
        left = count[row] - i  # words from here to the text's end
        h = Rolling(low).of(self.start, self.end, 3) if len(row) else np.zeros(0, np.uint64)
        few = base[:-1][(count > 0) & (count < k)]
        with np.errstate(over="ignore"):
            pair = mixed(h * _HASH + np.r_[h[1:], np.zeros(min(1, len(h)), np.uint64)], 13)
            value = h * np.uint64(0x9E3779B97F4A7C15)
            whole = value[few]  # all words of a text that has fewer than k
            for j in range(1, k):
                value = mixed(value, j) + np.r_[h[j:], np.zeros(min(j, len(h)), np.uint64)] * _HASH
                whole = np.where(left[few] > j, mixed(whole, j) + h[np.minimum(few + j, len(h) - 1)] * _HASH, whole)
        value[few] = whole
        self.shingles = mixed(value, 5)  # right where k words are left, and at the start of a text of fewer
        at = anchors(pair, i, left - 1, reach)
        first = i[at] - length // 2
        behind = count[row[at]] - length - first  # words after the paragraph
        first, text = first[ok := (first >= APART) & (behind >= APART)], row[at][ok]
        some, long = np.flatnonzero(count), np.flatnonzero(count >= length + APART)
        text, first = np.r_[text, some, long], np.r_[first, np.zeros(len(some), first.dtype), count[long] - length]
        order = np.lexsort((first, text))
        self.row, self.first, self.length = text[order], first[order], length
        self.word = base[self.row] + self.first
        self.size = np.maximum(reached(count[self.row], length) - k + 1, 1)  # shingles
        # where no shingle recurs nearby, paragraphs that overlap share what they overlap in and never link
        order = np.argsort(self.shingles, kind="stable")
        near = np.flatnonzero((self.shingles[order[1:]] == self.shingles[order[:-1]]) & (np.diff(order) < 2 * length))
        again = np.zeros(len(row) + 1, np.int64)
        again[order[near] + 1] = again[order[near + 1] + 1] = 1
        again = np.cumsum(again)
        self.plain = again[np.minimum(self.word + 2 * length, len(row))] == again[np.maximum(self.word - length, 0)]

    def overlapped(self, which: np.ndarray) -> np.ndarray:
        """By how many words the next of some consecutive paragraphs begins later, if the two overlap and cannot link; else 0."""
        row, first, plain = self.row[which], self.first[which], self.plain[which]
        step = np.r_[first[1:] - first[:-1], np.zeros(min(1, len(which)), first.dtype)]
        step[:-1][(row[1:] != row[:-1]) | (step[:-1] >= self.length) | ~plain[1:] | ~plain[:-1]] = 0
        return step

    def sets(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct shingle hashes of some paragraphs, and their n + 1 offsets."""
        size = self.size[which]
        step = np.minimum(np.arange(size.max(initial=1)), size[:, None] - 1)
        v = np.sort(self.shingles[self.word[which][:, None] + step], axis=1)
        new = np.c_[np.ones(len(v), bool), v[:, 1:] != v[:, :-1]]
        return v[new], np.r_[0, np.cumsum(new.sum(1))]


def band_keys(values: np.ndarray, at: np.ndarray, bands: range = range(BANDS)) -> np.ndarray:
    """The keys of each set in some consecutive bands."""
    low = minhash(values, at, len(bands) * ROWS, bands.start * ROWS)
    keys = np.empty((len(low), len(bands)), np.uint64)
    for c, b in enumerate(bands):
        key = np.full(len(low), b, np.uint64)
        for j in range(ROWS):
            key = mixed(key ^ low[:, c * ROWS + j], 41)
        keys[:, c] = key
    return keys


def _keyed(k: int, length: int, reach: int, bands: range):
    """A row for each of these bands of each paragraph. Overlapping paragraphs that cannot link have one row for a band they share.

    A place is the first word times `length`, plus the step to the next paragraph's if the row stands for that too.
    """

    def scan(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                blocks = Blocks(*text_bytes(part.column("text")), k, length, reach)
                for lo in range(0, len(blocks.row), 20_000):
                    which = np.arange(lo, min(lo + 20_000, len(blocks.row)))
                    keys = band_keys(*blocks.sets(which), bands)
                    step = blocks.overlapped(which)
                    same = np.zeros((len(which) + 1, len(bands)), bool)  # a paragraph and the one before it
                    same[1:-1] = (keys[1:] == keys[:-1]) & (step[:-1, None] > 0)
                    both = same[1:] & ~same[:-1]  # stands for the next as well
                    alone = ~np.r_[np.zeros((1, len(bands)), bool), both[:-1]].reshape(-1)
                    place = (blocks.first[which].astype(np.int64)[:, None] * length + both * step[:, None]).reshape(-1)[alone]
                    ids = part.column("doc_id").take(pa.array(np.repeat(blocks.row[which], len(bands))[alone]))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(keys.reshape(-1)[alone].view(np.int64)), pa.array(place)], ["doc_id", "key", "place"])

    return scan


def _several(length: int):
    """Of rows in the order of key the paragraphs of those whose key another row has too. Rows flow through; only one is held back."""

    def paragraphs(t):
        ids, place = t.column("doc_id"), t.column("place").to_numpy()
        also = np.flatnonzero(place % length)
        first = np.r_[place // length, (place // length + place % length)[also]].astype(np.int32)
        t = pa.Table.from_arrays([ids.take(pa.array(np.r_[np.arange(len(place)), also])), pa.array(first)], ["doc_id", "paragraph"])
        return t.combine_chunks().to_batches()

    def scan(batches):
        held, known = None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch] if held is None else [held, batch])
            key = t.column("key").to_numpy()
            same = key[1:] == key[:-1]
            out = np.r_[known, same] | np.r_[same, False]
            held, known = batch.slice(batch.num_rows - 1), bool(out[-1])
            out[-1] = False
            if out.any():
                yield from paragraphs(t.filter(pa.array(out)))
        if known:
            yield from paragraphs(pa.Table.from_batches([held]))

    return scan


def _elements(k: int, length: int, reach: int):
    """The sets of the wanted paragraphs of each text."""

    def scan(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                blocks = Blocks(*text_bytes(part.column("text")), k, length, reach)
                wanted = part.column("wanted")
                row = np.repeat(np.arange(part.num_rows), np.diff(wanted.offsets.to_numpy()))
                flat = wanted.flatten().to_numpy().astype(np.int64)
                which = np.flatnonzero(np.isin(blocks.row << 32 | blocks.first, row << 32 | flat))
                for lo in range(0, len(which), 20_000):
                    some = which[lo : lo + 20_000]
                    ids = part.column("doc_id").take(pa.array(blocks.row[some]))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(blocks.first[some].astype(np.int32)), packed(*blocks.sets(some)), pa.array(blocks.plain[some])], ["doc_id", "paragraph", "elements", "plain"])

    return scan


def _values(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, off = text_bytes(col)
    return np.frombuffer(data.tobytes(), np.uint64), off // 8


def _banded(batches):
    for batch in batches:
        if batch.num_rows:
            keys = band_keys(*_values(batch.column("elements")))
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.repeat(batch.column("id").to_numpy(), BANDS))], ["key", "id"])


def _signed(batches):
    for batch in batches:
        if batch.num_rows:
            sig = (minhash(*_values(batch.column("elements")), _VALUES) & np.uint64(0xFF)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [batch.column("grp"), batch.column("id"), packed(sig, np.arange(len(sig) + 1) * _VALUES), batch.column("elements")], ["grp", "id", "sig", "elements"]
            )


def _listed(num: int, den: int):
    """Each element of each row; any two rows of a similarity of num/den or more share one of `most`, whatever the order of elements."""

    def scan(batches):
        for batch in batches:
            if batch.num_rows:
                values, at = _values(batch.column("elements"))
                size = np.diff(at)
                names, of = ["grp", "id"], pa.array(np.repeat(np.arange(batch.num_rows), size))
                most = np.repeat(size - -(-size * num // den) + 1, size).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(of) for c in names), pa.array(values.view(np.int64)), pa.array(most)], [*names, "element", "most"])

    return scan


def narrowed(sets: DataFrame, num: int, den: int, large: int = LARGE) -> DataFrame:
    """Rows (grp, id, elements) with groups of more than `large` rows split, so that no pair that can link is parted.

    A common passage inside many different paragraphs gives them a band in common, but few of them link. The elements of a
    row are put in order, those first that the fewest rows of its group have. Rows of a similarity of num/den or more have
    an element in common among the first n - ceil(n num / den) + 1 of each (prefix filter), so every row goes to one
    group for each of these, and nothing else is compared. Groups with the same members are one.
    """
    big = written(sets.groupBy("grp").agg(F.count("*").alias("n")).where(F.col("n") > large).select("grp"), "large")
    if big.isEmpty():
        return sets
    rows = sets.join(small_or_not(big), "grp")
    listed = written(rows.mapInArrow(_listed(num, den), "grp long, id long, element long, most int"), "listed")
    often = listed.groupBy("grp", "element").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("grp", "id").orderBy("n", "element"))
    parts = listed.join(often, ["grp", "element"]).withColumn("rank", rank).where("rank <= most and n > 1")
    parts = written(parts.select("id", "grp", F.xxhash64("grp", "element").alias("part")), "parts")
    sized = parts.groupBy("part").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("x")).where("n > 1")
    parts = parts.join(sized, "part").select("grp", "id", F.xxhash64("x", "n").alias("part")).distinct()
    split = written(rows.join(parts, ["grp", "id"]).select(F.col("part").alias("grp"), "id", "elements").distinct(), "split")
    discard(listed)
    return sets.join(small_or_not(big), "grp", "left_anti").select("grp", "id", "elements").union(split)


def repeated_paragraphs(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, num: int = 4, den: int = 5, length: int = LENGTH, reach: int = REACH
) -> DataFrame:
    """Paragraphs that repeat, exactly or nearly: one row for each paragraph that is not alone in its component.

    Words are runs without ASCII white space, A-Z lower-cased. Word pairs become anchors in the order of their hashes,
    each unless an anchor is within `reach` pairs. Paragraphs are the `length` words around each anchor (APART words or
    more from both ends), the first `length` of the text and the last, so each word is in one. A text of fewer than
    `length` + APART words is one paragraph as a whole.
    A paragraph's set holds its distinct shingles of `words` words, or all its words if they are fewer. Paragraphs that share none of their MinHash bands with another
    go first, by a sort on bands that holds one row at a time. Of the others equal sets are one class, whose first
    occurrence by (id, paragraph) stands for it; classes that share a band are compared, and those with an exact Jaccard
    similarity of num/den or more link. A component keeps its first occurrence, and the rest is to be removed. A line of
    fewer than `length` words is compared with what stands beside it, so short recurring lines of longer texts stay.

    Returns doc_id, paragraph (its first word, from 0), kept_doc_id, kept_paragraph, kept. A row with kept true is
    the occurrence that stays.

    Null, empty and wordless texts have no paragraphs. Null ids: such rows take no part. Rows that share id and text
    are one place; rows that share an id only each have their paragraphs under it. Empty table: no rows. Other columns
    are not carried.
    """
    with tidy(docs.sparkSession):
        return _repeated(docs, key, text, words, num, den, length, reach)


def _repeated(docs: DataFrame, key: str, text: str, words: int, num: int, den: int, length: int, reach: int) -> DataFrame:
    kind = docs.schema[key].dataType
    bounded_batches(docs.sparkSession)
    d = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id is not null")
    place = with_type("doc_id", kind, "paragraph int")

    def share(column: str, i: int):
        return F.pmod(F.xxhash64(column), F.lit(PASSES)) == i

    dealt = []
    for i in range(PASSES):
        bands = range(BANDS * i // PASSES, BANDS * (i + 1) // PASSES)
        keys = d.mapInArrow(_keyed(words, length, reach, bands), with_type("doc_id", kind, "key long, place long"))
        keys = keys.select("key", "place", "doc_id").repartition("key").sortWithinPartitions("key")
        dealt.append(written(keys.mapInArrow(_several(length), place).groupBy("doc_id").agg(F.collect_set("paragraph").alias("wanted")), "wanted"))
    wanted = reduce(DataFrame.union, dealt).groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("wanted"))).alias("wanted"))
    wanted = written(wanted, "wanted")
    discard(*dealt)
    some, elements = small_or_not(wanted), with_type("doc_id", kind, "paragraph int, elements binary, plain boolean")
    read = []
    for i in range(PASSES):
        blocks = d.where(share("doc_id", i)).join(some, "doc_id").select("doc_id", "text", "wanted")
        read.append(written(blocks.mapInArrow(_elements(words, length, reach), elements), "paragraphs"))
    discard(wanted)
    blocks = reduce(DataFrame.union, read)
    digest = F.unhex(F.md5("elements")).alias("set")  # for joins, where a set need only be told from others
    places = blocks.select("doc_id", "paragraph", digest)
    unique = d.groupBy("doc_id").count().where("count > 1").isEmpty()
    if not unique:
        blocks = blocks.select("doc_id", "paragraph", "elements", F.lit(False).alias("plain")).distinct()
        places = places.distinct()
    classed = []
    for i in range(PASSES):
        classes = blocks.where(share("elements", i)).groupBy("elements")
        classes = classes.agg(F.min(F.struct("doc_id", "paragraph", "plain")).alias("at"), F.count("*").alias("n"))
        number = (F.monotonically_increasing_id() * PASSES + i).alias("id")
        classes = classes.select(number, "elements", digest, F.struct("at.doc_id", "at.paragraph").alias("at"), "n", "at.plain")
        classed.append(written(classes, "classes"))
    classes = reduce(DataFrame.union, classed)
    places = written(places, "places")
    discard(*read)
    banded = written(classes.select("id", "elements").mapInArrow(_banded, "key long, id long"), "bands")
    # a candidate group is what shares a band; groups with the same members are one
    by_key = banded.repartition("key")  # most keys are alone, so counts before the exchange would not shrink it
    groups = by_key.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("x")).where("n > 1")
    groups = by_key.join(groups, "key").select(F.xxhash64("x", "n").alias("grp"), "id").distinct()
    if unique:  # what only overlaps itself in one text, without recurring shingles, cannot link
        groups = met = written(groups.join(classes.select("id", "at", "plain"), "id"), "groups")
        low, high = F.min("at").alias("low"), F.max("at").alias("high")
        apart = (F.col("low.doc_id") != F.col("high.doc_id")) | (F.col("high.paragraph") - F.col("low.paragraph") >= length) | ~F.col("plain")
        found = groups.groupBy("grp").agg(low, high, F.min("plain").alias("plain")).where(apart)
        groups = groups.select("grp", "id").join(found.select("grp"), "grp")
    sets = written(groups.join(classes.select("id", "elements"), "id").select("grp", "id", "elements"), "members")
    classes = written(classes.select("id", "set", "at", "n"), "classes")
    discard(banded, *classed, *([met] if unique else []))
    narrow = narrowed(sets, num, den)
    linked = exact_classes(narrow.mapInArrow(_signed, "grp long, id long, sig binary, elements binary"), "long", num, den, DIFFERING)
    linked = written(linked.join(classes.select("id", "at"), "id"), "linked")
    least = linked.groupBy("root").agg(F.min("at").alias("kept_at"))
    linked = linked.join(least, "root").select("id", "kept_at")
    discard(sets)
    named = classes.join(linked, "id", "left").where("n > 1 or kept_at is not null").select("set", F.coalesce("kept_at", "at").alias("kept_at"))
    out = places.join(named, "set")
    return out.select(
        "doc_id", "paragraph", F.col("kept_at.doc_id").alias("kept_doc_id"), F.col("kept_at.paragraph").alias("kept_paragraph"),
        (F.struct("doc_id", "paragraph") == F.col("kept_at")).alias("kept"),
    )


def _without(length: int, column: str):
    """Texts without the words of the paragraphs in the column __gone, from the first byte of each to its last."""

    def scan(batches):
        for batch in batches:
            for part in slices(batch, column):
                data, off = text_bytes(part.column(column))
                _, start, end, row = split_words(data, off)
                count = np.bincount(row, minlength=part.num_rows)
                base, words = np.r_[0, np.cumsum(count)], reached(count, length)
                out = []
                for r, (old, gone) in enumerate(zip(part.column(column).to_pylist(), part.column("__gone").to_pylist(), strict=True)):
                    if gone:
                        keep = np.ones(int(off[r + 1] - off[r]), bool)
                        for x in gone:
                            p, q = x["paragraph"], x["paragraph"] + int(words[r])
                            if x["stays"] is not None:  # the kept one is before it in this text, and may overlap it
                                p = max(p, x["stays"] + int(words[r]))
                            keep[start[base[r] + p] - off[r] : end[base[r] + q - 1] - off[r]] = False
                        old = data[off[r] : off[r + 1]][keep].tobytes().decode()
                    out.append(old)
                names = [c for c in part.schema.names if c != "__gone"]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if c == column else part.column(c) for c in names], names)

    return scan


def remove_repeated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without the paragraphs that repeated_paragraphs does not keep; all columns and rows stay.

    Of a paragraph that overlaps the kept one of its component in the same text, only the words behind that one go.
    Rows that share an id are documents of their own, in the order of a hash of their text. The text must be a string.
    """
    row = F.when(F.col(key).isNotNull() & F.col(text).isNotNull(), F.struct(F.col(key).alias("id"), F.md5(text).alias("content")))
    d = docs.withColumn("__row", row)
    gone = repeated_paragraphs(d.select("__row", text), "__row", text).where("not kept")
    place = F.struct("paragraph", F.when(F.col("kept_doc_id") == F.col("doc_id"), F.col("kept_paragraph")).alias("stays"))
    gone = written(gone.groupBy(F.col("doc_id").alias("__row")).agg(F.collect_set(place).alias("__gone")), "gone")
    d = d.join(small_or_not(gone), "__row", "left").drop("__row")
    return d.mapInArrow(_without(LENGTH, text), docs.schema)

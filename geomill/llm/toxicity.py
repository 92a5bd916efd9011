"""Severity of toxicity by cumulative-link ordinal regression on sparse text features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geomill.llm.common import Rolling, bounded_batches, discard, give_back, slices, text_bytes, with_type, written

#: Hashed features; the weights are one array of this size, whatever the data.
BITS = 20
#: Bytes of a word's beginnings that are features beside the word itself.
PREFIXES = (3, 4, 5, 6, 7, 8)
#: Labelled documents that the model is fitted on at most: the first by hash of id, so many of each class.
MAX_TOXIC, MAX_CLEAN = 2000, 3000
GRADES = 4

_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature and row of each occurrence, and the number of words of each row. A word is a run of letters or digits."""
    n = len(off) - 1
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(n, np.int64)
    inside = _LETTER[data]
    first = np.zeros(len(data) + 1, bool)
    first[off] = True
    start = np.flatnonzero(inside & (np.r_[True, ~inside[:-1]] | first[:-1]))
    end = np.flatnonzero(inside & (np.r_[~inside[1:], True] | first[1:])) + 1
    row = np.searchsorted(off, start, "right") - 1
    roll = Rolling(data)
    shift = np.uint64(64 - BITS)
    which = [(roll.of(start, end, 1) >> shift).astype(np.int64)]
    rows = [row]
    for length in PREFIXES:
        longer = end - start > length
        s = start[longer]
        which.append((roll.of(s, s + length, length) >> shift).astype(np.int64))
        rows.append(row[longer])
    return np.concatenate(which), np.concatenate(rows), np.bincount(row, minlength=n)


def _counted(batches):
    """Distinct features of each document with their share of its words in percent."""
    for batch in batches:
        for part in slices(batch, "text"):
            data, off = text_bytes(pc.utf8_lower(part.column("text")))
            which, row, n = features(data, off)
            cell, count = np.unique(row << BITS | which, return_counts=True)
            row = cell >> BITS
            value = (100.0 * count / np.maximum(n[row], 1)).astype(np.float32)
            at = np.r_[0, np.cumsum(np.bincount(row, minlength=len(off) - 1))].astype(np.int32)
            which = pa.ListArray.from_arrays(at, pa.array((cell & ((1 << BITS) - 1)).astype(np.int32)))
            value = pa.ListArray.from_arrays(at, pa.array(value))
            yield pa.RecordBatch.from_arrays([part.column("toxic"), which, value], ["toxic", "which", "value"])


@dataclass(frozen=True)
class Model:
    """One weight a feature, shared by all thresholds, which ascend."""

    weights: np.ndarray
    thresholds: np.ndarray

    def grades(self, score: np.ndarray) -> np.ndarray:
        """Probability of each grade, a row a score."""
        below = _sigmoid(self.thresholds[None, :] - score[:, None])
        return np.diff(np.c_[np.zeros(len(score)), below, np.ones(len(score))], axis=1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _fit(toxic: np.ndarray, col: np.ndarray, val: np.ndarray, row: np.ndarray, clear: np.ndarray, steps: int = 300, l2: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the columns and thresholds: maximum likelihood by Adam. clear: columns that speak clearly for toxicity.

    A toxic document's grade is the third in which the share of its words that speak clearly for toxicity lies.
    """
    n, used = len(toxic), len(clear)
    share = np.bincount(row, weights=val * clear[col], minlength=n)
    cuts = np.quantile(share[toxic == 1], [1 / 3, 2 / 3])
    grade = np.where(toxic == 1, 1 + np.searchsorted(cuts, share, "left"), 0)
    p = np.r_[np.zeros(used), 1.0, 0.0, 0.0]  # weights, first threshold, logs of the gaps between thresholds
    m, v = np.zeros_like(p), np.zeros_like(p)
    one = np.arange(n)
    for t in range(1, steps + 1):
        w, (first, *gaps) = p[:used], p[used:]
        theta = first + np.r_[0.0, np.cumsum(np.exp(gaps))]
        score = np.bincount(row, weights=w[col] * val, minlength=n)
        below = np.c_[np.zeros(n), _sigmoid(theta[None, :] - score[:, None]), np.ones(n)]
        hi, lo = below[one, grade + 1], below[one, grade]
        prob = np.maximum(hi - lo, 1e-9)
        by_score = hi + lo - 1
        by_theta = np.zeros((n, GRADES + 1))
        by_theta[one, grade + 1] += hi * (1 - hi) / prob
        by_theta[one, grade] -= lo * (1 - lo) / prob
        g = by_theta[:, 1:GRADES].sum(0)
        grad = np.r_[
            -np.bincount(col, weights=by_score[row] * val, minlength=used) / n + l2 * w,
            -g.sum() / n, -g[1:].sum() / n * np.exp(gaps[0]), -g[2:].sum() / n * np.exp(gaps[1]),
        ]
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad**2
        p = p - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    first, *gaps = p[used:]
    return p[:used], first + np.r_[0.0, np.cumsum(np.exp(gaps))]


def _only(used: np.ndarray):
    """Of the features of each document the used ones, by their place in `used`."""

    def scan(batches):
        for batch in batches:
            which, value = batch.column("which"), batch.column("value")
            row = np.repeat(np.arange(batch.num_rows), np.diff(which.offsets.to_numpy()))
            flat, val = which.flatten().to_numpy(), value.flatten().to_numpy()
            at = np.minimum(np.searchsorted(used, flat), len(used) - 1)
            keep = used[at] == flat
            edge = np.r_[0, np.cumsum(np.bincount(row[keep], minlength=batch.num_rows))].astype(np.int32)
            cols = [pa.ListArray.from_arrays(edge, pa.array(x)) for x in (at[keep].astype(np.int32), val[keep])]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), *cols], ["toxic", "which", "value"])

    return scan


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Fit on at most MAX_TOXIC + MAX_CLEAN labelled documents, the first of each class by hash of id.

    Features are counted by class in Spark; those that tell the classes apart (z of the log odds of 2.5 or more, in three
    documents or more) are used, and only their values in the labelled documents come to the driver. Rows without id,
    label or text say nothing; of several labels of one id the highest counts. Without labelled rows of both kinds the
    model finds nothing toxic.
    """
    spark = docs.sparkSession
    none = Model(np.zeros(1 << BITS, np.float32), np.array([20.0, 21.0, 22.0]))
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("doc_id"))
    known = known.agg(F.max((F.col(label) > 0).cast("int")).alias("toxic"))
    order = F.xxhash64("doc_id")
    some = known.where("toxic = 1").orderBy(order, "doc_id").limit(MAX_TOXIC).collect()
    some += known.where("toxic = 0").orderBy(order, "doc_id").limit(MAX_CLEAN).collect()
    if not some:
        return none
    some = F.broadcast(spark.createDataFrame(some, known.schema))
    d = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text")).where("text is not null")
    d = d.join(some, "doc_id").dropDuplicates(["doc_id"]).select("toxic", "text")
    counted = written(d.mapInArrow(_counted, "toxic int, which array<int>, value array<float>"), "labelled")
    n, n1 = counted.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not n1 or n1 == n:
        return none
    df = counted.select("toxic", F.explode("which").alias("which")).groupBy("which")
    df = df.agg(F.sum("toxic").alias("df1"), F.sum(1 - F.col("toxic")).alias("df0"))
    odds = F.log((F.col("df1") + 0.5) / (n1 + 1)) - F.log((F.col("df0") + 0.5) / (n - n1 + 1))
    z = F.col("odds") / F.sqrt(1 / (F.col("df1") + 0.5) + 1 / (F.col("df0") + 0.5))
    df = df.withColumn("odds", odds).withColumn("z", z).where("abs(z) >= 2.5 and df1 + df0 >= 3")
    df = df.select("which", (F.col("z") >= 4) & (F.col("odds") >= float(np.log(5)))).toArrow()
    if not df.num_rows:
        return none
    used, clear = df.column(0).to_numpy(), np.asarray(df.column(1))
    by = np.argsort(used)
    used, clear = used[by], clear[by].astype(np.float64)
    got = counted.mapInArrow(_only(used), "toxic int, which array<int>, value array<float>").toArrow().combine_chunks()
    which, value = got.column("which").combine_chunks(), got.column("value").combine_chunks()
    row = np.repeat(np.arange(got.num_rows), np.diff(which.offsets.to_numpy()))
    toxic, col, val = got.column("toxic").to_numpy().astype(np.float64), which.flatten().to_numpy(), value.flatten().to_numpy().astype(np.float64)
    weights = np.zeros(1 << BITS, np.float32)
    weights[used], thresholds = _fit(toxic, col, val, row, clear)
    del got, which, value, row, col, val
    discard(counted)
    give_back()
    return Model(weights, thresholds)


def score_documents(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """Rows doc_id, severity (expected grade, 0 to 3), grade (the likeliest), p_toxic (chance of grade 1 or more), toxic.

    toxic: p_toxic is at least `threshold`. Null, empty and wordless texts: severity 0, not toxic. Repeated rows: one
    result each. Empty table: no rows. Other columns are not carried.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))

    def scan(batches):
        own = Model(*shared.value)
        for batch in batches:
            for part in slices(batch, "text"):
                data, off = text_bytes(pc.utf8_lower(part.column("text")))
                which, row, n = features(data, off)
                score = 100.0 * np.bincount(row, weights=own.weights[which], minlength=len(n)) / np.maximum(n, 1)
                by_grade = own.grades(score)
                p = np.where(n > 0, 1 - by_grade[:, 0], 0.0)
                severity = np.where(n > 0, by_grade @ np.arange(GRADES), 0.0)
                grade = np.where(n > 0, by_grade.argmax(1), 0).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(severity), pa.array(grade), pa.array(p), pa.array(p >= threshold)],
                    ["doc_id", "severity", "grade", "p_toxic", "toxic"],
                )

    d = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return d.mapInArrow(scan, with_type("doc_id", d.schema["doc_id"].dataType, "severity double, grade int, p_toxic double, toxic boolean"))

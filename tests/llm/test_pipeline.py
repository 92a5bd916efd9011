"""Every stage of the pipeline against what its operator decides, on the smallest tables."""

import corpus_pipeline
import pytest
from geomill.llm import bpe, minhash_dedup, mixing, prefix_free, toxicity
from geomill.llm.common import written
from pyspark.sql import functions as F

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = [spark.read.parquet(f"{D}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        docs.append(written(stage(spark, docs[-1], D), "test"))
    return docs


def test_stages(spark, stages):
    start, clean, single, cut, mixed, encoded = stages
    assert [s.columns for s in stages[:5]] == [start.columns] * 5
    labels = spark.read.parquet(f"{D}/labels.parquet")
    scored = toxicity.score_documents(start, toxicity.fit(start, labels))
    ids = lambda d: sorted(r.doc_id for r in d.select("doc_id").collect())
    assert ids(clean) == ids(scored.where("not toxic"))
    assert ids(single) == ids(minhash_dedup.near_duplicates(clean).where("kept"))
    want = {r.doc_id: bytes(r.kept).decode("utf-8", "ignore") for r in prefix_free.remove_repeats(single).collect()}
    assert {r.doc_id: r.text for r in cut.collect()} == want
    assert all(r.n_chars == len(r.text) for r in cut.collect())
    rates = {r.doc_id: r.rate for r in mixing.mixing_rates(cut, labels).collect()}
    times = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert set(times) == set(rates) and all(max(1, int(rates[k])) <= n <= max(1, int(rates[k]) + 1) for k, n in times.items())
    texts = {r.doc_id: r.text for r in mixed.collect()}
    for r in encoded.withColumn("whole", F.sha2("ids", 256)).collect():
        assert r.whole == r.ids_sha256 and r.n_tokens * 4 == len(r.ids)
    assert encoded.count() == mixed.count() and set(ids(encoded)) == set(texts)
    assert bpe.read_ranks(b"IQ== 0\n") == {b"!": 0}


def test_stages_on_empty_and_odd_tables(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    none = docs.limit(0)
    odd = spark.createDataFrame([(None, None, None, None, None), (1, None, "en", "s", 0), (2, "", None, None, 0), (3, "x y", "en", "s", 3), (3, "x y", "en", "s", 3)], docs.schema)
    for _, stage in corpus_pipeline.STAGES:
        none = written(stage(spark, none, D), "test")
        odd = written(stage(spark, odd, D), "test")
    assert none.count() == 0
    assert odd.count() >= 4

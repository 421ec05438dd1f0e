import pytest
from pyspark.sql import functions as F

from prefixory.plans.queries import QUERIES
from prefixory.sources import corpus

SF = "/root/testdata/sf0.001"


def test_merged_corpus_is_whole_up_to_the_limit(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    both = corpus.unigrams(docs).unionByName(corpus.bigrams(docs)).select("query").distinct().count()
    assert both > 20_000
    assert QUERIES["corpus_merge_max"](spark, SF).count() == min(both, 300_000)


@pytest.mark.parametrize("n", [1, 1500, 5000])
@pytest.mark.parametrize("kinds", [1, 7])
def test_top_by_ranges_equals_sorting(spark, monkeypatch, n, kinds):
    monkeypatch.setattr(corpus, "FEW", 0)
    rows = spark.range(3000).select(F.concat(F.lit("q"), F.pmod(F.col("id") * 7919, F.lit(3000))).alias("query"), F.pmod("id", F.lit(kinds)).alias("count"))
    expected = sorted(map(tuple, rows.collect()), key=lambda r: (-r[1], r[0]))[:n]
    assert list(map(tuple, corpus.top(rows, n).collect())) == expected


def test_synthetic_corpus_is_whole_up_to_the_limit(spark):
    part = spark.read.parquet(f"{SF}/part.parquet")
    h, m = part.select(F.split("p_name", " ")[0]).distinct().count(), part.select("p_brand").distinct().count()
    assert QUERIES["synthetic_zipf"](spark, SF).count() == min(h + h * m + h * (h - 1) + h * (h - 1) * m, 300_000)


def test_words_and_pairs_are_counted_in_one_reading(spark, monkeypatch):
    docs = spark.createDataFrame([("A b  b a\x1ca1 7 a _a aİ K\n",), (None,), ("",), (" ",), ("b a",)], "text string")
    got = {r.query: r["count"] for r in corpus.word_counts(docs, 1, 2).collect()}
    assert got == {"a": 4, "b": 3, "a1": 1, "k": 1, "a b": 1, "b b": 1, "b a": 2, "a a1": 1}
    plan = corpus.word_counts(spark.read.parquet(f"{SF}/documents.parquet"), 1, 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    assert {r.query: r["count"] for r in corpus.unigrams(docs).unionByName(corpus.bigrams(docs)).collect()} == got

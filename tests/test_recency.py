import pytest
from pyspark.sql import functions as F

from prefixory.operators import ranking, recency


def score(spark, times, now, half=100.0):
    df = spark.createDataFrame([("q", float(t)) for t in times], "query string, t double")
    return recency.recency_scores(df, now, half).first().score


@pytest.mark.parametrize("now, expected", [(1000, 1.0), (1100, 0.5), (1200, 0.25), (900, 1.0)])
def test_half_life(spark, now, expected):
    assert score(spark, [1000], now) == pytest.approx(expected)


def test_accumulates(spark):
    assert score(spark, [1000, 1100], 1100) == pytest.approx(1.5)


def test_no_half_life(spark):
    assert score(spark, [1000], 1001, 0.0) == 0.0
    assert score(spark, [1000], 1000, 0.0) == 1.0


def test_spike_fades_below_steady(spark):
    rows = [("spike", 0.0)] * 100 + [("steady", 60.0 * i) for i in range(20)]
    df = spark.createDataFrame(rows, "query string, t double")
    at = lambda now: {r.query: r.score for r in recency.recency_scores(df.where(F.col("t") <= now), now, 60.0).collect()}
    assert at(0.0)["spike"] > at(0.0)["steady"]
    assert at(1200.0)["spike"] < at(1200.0)["steady"]


def test_fold_equals_closed_form(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 5.0), ("b", 2.0), ("a", 9.0)], "query string, t double")
    a = {r.query: r.score for r in recency.recency_fold(df, 10.0, 3.0).collect()}
    b = {r.query: r.score for r in recency.recency_scores(df, 10.0, 3.0).collect()}
    assert a == pytest.approx(b)


def test_prefix_pool(spark):
    scores = spark.createDataFrame([("data mining", 2.0), ("data science", 3.0), ("london", 9.0), ("dim", 1e-3)], "query string, score double")
    asked = spark.createDataFrame([("d",), ("data ",)], "prefix string")
    got = sorted(map(tuple, recency.by_prefix(scores, asked).collect()))
    assert got == [("d", "data mining", 2.0), ("d", "data science", 3.0), ("data ", "data mining", 2.0), ("data ", "data science", 3.0)]


@pytest.mark.parametrize("recent, first", [(0.0, "alpha"), (50.0, "beta")])
def test_blend(spark, recent, first):
    pool = spark.createDataFrame([("p", "alpha", 1_000_000, 0.0), ("p", "beta", 10_000, recent)], "prefix string, query string, count long, recency double")
    out = ranking.blend(pool).orderBy("rank").collect()
    assert out[0].query == first
    assert out[0].score <= 1.0


def test_prune_keeps_first_seen(spark):
    df = spark.createDataFrame([("a", 1.0, 3), ("b", 1.0, 1), ("c", 2.0, 9)], "query string, score double, first_seen long")
    assert [r.query for r in recency.pruned(df, 2).collect()] == ["c", "b"]


def test_prune_query_is_whole_up_to_the_capacity(spark):
    from prefixory.plans.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    queries = spark.read.parquet(f"{sf}/events.parquet").select("event_type", F.col("user_id") % 20).distinct().count()
    assert QUERIES["recency_prune"](spark, sf).count() == min(queries, 50_000) > 40

import json

import pytest
from pyspark.sql import functions as F

from prefixory.plans.engine import Suggestions
from prefixory.settings import Settings

SEED = {"apple": 100, "application": 80, "apply": 60, "appetite": 30, "banana": 50, "band": 40, "bandana": 20}


@pytest.fixture(scope="module")
def engine(spark):
    df = spark.createDataFrame(list(SEED.items()), "query string, count long")
    return Suggestions(df, settings=Settings(trie_node_capacity=10, recency_half_life=10_000.0))


def ask(spark, *prefixes):
    return spark.createDataFrame([(p,) for p in prefixes], "prefix string")


def listed(df):
    return [r.query for r in df.orderBy("rank").collect()]


def test_basic_order_and_limit(spark, engine):
    assert listed(engine.suggest(ask(spark, " APP "))) == ["apple", "application", "apply", "appetite"]
    assert listed(engine.suggest(ask(spark, "app"), limit=2)) == ["apple", "application"]
    assert listed(engine.suggest(ask(spark, "app"), mode="nonsense", limit=0)) == ["apple", "application", "apply", "appetite"]


def test_bypass_and_unknown(spark, engine):
    rows = {r.prefix: r for r in engine.responses(ask(spark, "  ", "zzz", None, "ban")).collect()}
    assert (rows[""].cache, rows[""]["count"], rows["zzz"]["count"]) == ("bypass", 0, 0)
    assert json.loads(rows["ban"].suggestions)[0] == {"query": "banana", "count": 50, "score": 50.0}


def test_trending_promotes_a_burst(spark, engine):
    after = engine.search(spark.createDataFrame([("Bandana ",)] * 8, "query string"), 1000.0)
    assert listed(after.suggest(ask(spark, "ban"), "trending", now=1000.0))[0] == "bandana"
    assert listed(after.suggest(ask(spark, "ban")))[0] == "banana"
    assert after.trending(3, 1000.0).first().query == "bandana"


def test_counts_grow_and_new_queries_appear(spark, engine):
    after = engine.search(spark.createDataFrame([("appetite",)] * 25 + [("apt",), ("",)], "query string"), 5.0)
    got = {r.query: r["count"] for r in after.counts.collect()}
    assert (got["appetite"], got["apt"]) == (55, 1)
    assert listed(after.suggest(ask(spark, "ap")))[-1] == "apt"
    assert after.health().first().queries == 8


def test_arguments_are_checked(spark, engine):
    with pytest.raises(ValueError):
        engine.suggest(ask(spark, "a"), limit=51)
    with pytest.raises(ValueError):
        engine.trending(101)
    with pytest.raises(ValueError):
        engine.ring_distribution(99)


def test_cache_debug(spark, engine):
    cached = spark.createDataFrame([("suggest:basic:java", 12.5)], "key string, ttl_remaining double")
    asked = spark.createDataFrame([("java", "basic"), ("java", "trending")], "prefix string, mode string")
    rows = {r.mode: r for r in engine.cache_debug(asked, cached).collect()}
    assert (rows["basic"].label, rows["basic"].present, rows["trending"].present) == ("cache-1#88", True, False)


def test_settings_from_env():
    s = Settings.from_env({"SUGGEST_LIMIT": "7", "CACHE_NODES": "x", "RECENCY_WEIGHT": "0.5", "WAL_ENABLED": "no"})
    assert (s.suggest_limit, s.cache_nodes, s.recency_weight, s.wal_enabled) == (7, 4, 0.5, False)


def test_empty_tables(spark):
    e = Suggestions(spark.createDataFrame([], "query string, count long"))
    assert e.suggest(ask(spark, "a")).count() == 0
    assert e.suggest(ask(spark, "a"), "trending").count() == 0
    assert e.health().first().nodes == 1
    assert e.trending().count() == 0
    assert e.counts.select(F.count("*")).first()[0] == 0

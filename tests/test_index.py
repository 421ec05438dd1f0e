import random

import pytest
from pyspark.sql import functions as F

from prefixory.operators import index
from prefixory.sources.scratch import written


def rows(df):
    out = {}
    for r in df.orderBy("prefix", "rank").collect():
        out.setdefault(r.prefix, []).append((r.query, r["count"]))
    return out


def brute(counts, k):
    out = {}
    for q, c in counts.items():
        for i in range(len(q) + 1):
            out.setdefault(q[:i], []).append((q, c))
    return {p: sorted(v, key=lambda x: (-x[1], x[0]))[:k] for p, v in out.items()}


def frame(spark, counts):
    return spark.createDataFrame(list(counts.items()), "query string, count long")


def test_bulk_equals_brute_force(spark):
    r = random.Random(7)
    counts = {"".join(r.choices("abcde", k=r.randint(1, 6))): r.randint(1, 1_000_000) for _ in range(3000)}
    assert rows(index.prefix_topk(frame(spark, counts), 10)) == brute(counts, 10)


def test_incremental_equals_rebuild(spark):
    r = random.Random(11)
    counts, table = {}, index.prefix_topk(frame(spark, {"a": 1}).where("false"), 8)
    for _ in range(3):
        changed = {}
        for _ in range(1300):
            q = "".join(r.choices("abc", k=r.randint(1, 5)))
            counts[q] = counts.get(q, 0) + r.randint(1, 50)
            changed[q] = counts[q]
        table = written(index.updated(table, frame(spark, changed), 8), "index")
    assert rows(table) == brute(counts, 8)


def test_promotion_and_capacity(spark):
    table = index.prefix_topk(frame(spark, {"aa": 10, "ab": 9, "ac": 8}), 2)
    assert rows(table)["a"] == [("aa", 10), ("ab", 9)]
    assert rows(index.updated(table, frame(spark, {"ac": 100}), 2))["a"] == [("ac", 100), ("aa", 10)]


def test_empty_queries_and_code_points(spark):
    table = rows(index.prefix_topk(frame(spark, {"": 5, "é😀x": 2}), 3))
    assert table == {"": [("é😀x", 2)], "é": [("é😀x", 2)], "é😀": [("é😀x", 2)], "é😀x": [("é😀x", 2)]}


def test_partial_limit_before_the_exchange(spark):
    df = index.top_per_prefix(frame(spark, {"a": 1}).select(F.substring("query", 1, 1).alias("prefix"), "query", "count"), 3)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_limits_are_checked():
    with pytest.raises(ValueError):
        index.checked(51, 1, 50, "limit")


def test_sketches_merge(spark):
    from prefixory.operators.index import index_stats, merged_stats, sketches

    counts = spark.range(30_000).select(F.concat(F.lit("q"), F.hex(F.xxhash64("id"))).alias("query"), F.lit(1).cast("long").alias("count"), (F.col("id") % 3).alias("flush"))
    again = counts.unionByName(counts.where("flush = 1").withColumn("flush", F.lit(7).cast("long")))
    exact, own = index_stats(counts).first(), merged_stats(sketches(again, "flush")).first()
    for name in ("queries", "nodes"):
        assert abs(own[name] / exact[name] - 1) < 0.03
    assert merged_stats(sketches(again)).first().queries == own.queries
    assert sketches(counts.limit(0), "flush").count() == 0


def test_suggestions_from_counts_are_those_of_the_index(spark):
    from prefixory.operators.index import prefix_topk, suggest_basic, suggest_from_counts

    counts = spark.createDataFrame([(f"{a}{b}", i % 5 + 1) for i, (a, b) in enumerate((a, b) for a in "abc" for b in "wxyzäöü")], "query string, count long")
    asked = spark.createDataFrame([(" A",), ("bx",), ("",), ("zz",)], "prefix string")
    assert sorted(map(tuple, suggest_from_counts(asked, counts, 4).collect())) == sorted(map(tuple, suggest_basic(asked, prefix_topk(counts), 4).collect()))

import pytest
from pyspark.sql import functions as F

from prefixory.functions import text
from prefixory.operators.metrics import benchmark_summary, latency_summary
from prefixory.sources import corpus


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize("raw, expected", [("  IPhone 15  ", "iphone 15"), ("A\tB\nC", "a b c"), (None, ""), ("", ""), ("a  b\u0085c\u001cd", "a b c d"), ("É", "é")])
def test_normalize(spark, raw, expected):
    assert value(spark, text.normalize(F.lit(raw).cast("string"))) == expected


def test_prefixes(spark):
    assert value(spark, text.prefixes(F.lit("a😀b"))) == ["a", "a😀", "a😀b"]
    assert value(spark, text.prefixes(F.lit(""))) == []


@pytest.mark.parametrize("n, expected", [(999, "999"), (1000, "1K"), (1250, "1.3K"), (1234, "1.2K"), (209_950_000, "209.9M"), (2_500_000_000, "2.5B")])
def test_short_count(spark, n, expected):
    assert value(spark, text.short_count(F.lit(n))) == expected


def test_markup(spark):
    assert value(spark, text.escape_html(F.lit("<a & 'b' \"c\">"))) == "&lt;a &amp; &#39;b&#39; &quot;c&quot;&gt;"
    assert value(spark, text.highlight(F.lit("Apple"), F.lit("ap"))) == "<mark>Ap</mark>ple"
    assert value(spark, text.highlight(F.lit("Apple"), F.lit(""))) == "Apple"
    assert value(spark, text.bar_width(F.lit(0), F.lit(0))) == 0


def test_tsv(spark, tmp_path):
    (tmp_path / "u").write_text("The\t5\nthe\t9\nx\t0\nno\nbad!\t3\n12\t3\na b c d e f\t1\nhalf\t1.5\nunder\t1_0\n")
    (tmp_path / "b").write_text("of the\t7\n")
    got = [(r.query, r["count"]) for r in corpus.load_corpus(spark, str(tmp_path / "u"), str(tmp_path / "b"), 10).collect()]
    assert got == [("the", 9), ("of the", 7)]
    with pytest.raises(FileNotFoundError):
        corpus.load_corpus(spark, str(tmp_path / "none"))


def test_synthetic_jitter_is_bounded_and_repeatable(spark):
    heads = spark.createDataFrame([("a", 1), ("b", 2)], "head string, pos long")
    mods = spark.createDataFrame([("x", 1)], "modifier string, pos long")
    plain = {r.query: r["count"] for r in corpus.synthetic(heads, mods).collect()}
    one, two = ({r.query: r["count"] for r in corpus.synthetic(heads, mods, seed=42).collect()} for _ in range(2))
    assert one == two and plain["a"] == 10_000_000
    assert all(0.89 <= one[q] / plain[q] <= 1.11 for q in plain)
    assert set(plain) == {"a", "b", "a x", "b x", "a b", "b a", "a b x", "b a x"}


def test_percentiles(spark):
    df = spark.range(1, 101).select(F.col("id").cast("double").alias("latency"))
    r = latency_summary(df).first()
    assert (r["count"], r["min"], r["p50"], r["p95"], r["p99"]) == (100, 1.0, 50.5, 95.05, 99.01)
    empty = latency_summary(df.where("false")).first()
    assert (empty["count"], empty.p95) == (0, 0.0)
    assert latency_summary(df.where("latency = 7")).first().p99 == 7.0


def test_benchmark_summary(spark):
    sums = spark.createDataFrame([("a", 100, 96, 2.0, 8000, 1032), ("b", 0, 0, 0.0, 0, 0)], "phase string, n long, hits long, s double, searches long, upserts long")
    rows = {r.phase: tuple(r)[1:] for r in benchmark_summary(sums, "phase", requests="n", hits="hits", seconds="s", searches="searches", upserts="upserts").collect()}
    assert rows == {"a": (50.0, 0.96, 87.1, 7.75), "b": (0.0, 0.0, 0.0, 0.0)}

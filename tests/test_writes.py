import pytest
from pyspark.sql import functions as F

from prefixory.operators import writes
from prefixory.sources.store import Store, read_segments


def submissions(spark, *pairs):
    return spark.createDataFrame([(q,) for q, n in pairs for _ in range(n)], "query string")


def as_dict(df):
    return {r.query: r["count"] for r in df.collect()}


def test_reduction(spark):
    df = submissions(spark, ("apple", 5), ("banana", 3), ("", 2)).withColumn("flush", F.lit(1))
    r = writes.write_reduction(df, "flush").first()
    assert (r.searches, r.upserts, r.flushes, r.reduction) == (8, 2, 1, 4.0)
    assert writes.write_reduction(df.where("false"), "flush").first().reduction == 0.0


def test_recovery(spark, tmp_path):
    for name, lines in {"log.seg.3": ["x", "x", "", "y"], "log": ["z"], "log.seg.bad": ["never"], "log.seg.2": ["old"]}.items():
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    segments = read_segments(spark, str(tmp_path))
    base = spark.createDataFrame([("x", 100)], "query string, count long")
    assert as_dict(writes.upsert(base, writes.deltas(writes.replayed(segments, 2)))) == {"x": 102, "y": 1, "z": 1}
    r = writes.recovery_seq(segments, 2).first()
    assert (r.lines, r.seq) == (4, 4)


def test_committed_segment_is_not_applied_again(spark):
    segments = spark.createDataFrame([(5, "apple")], "seq long, query string")
    assert writes.replayed(segments, 5).count() == 0


def test_store_applies_once_and_compacts(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    assert store.count_rows() == 0 and store.get_count("a") is None
    assert store.bulk_replace(spark.createDataFrame([("a", 1, 0), ("a", 7, 1), ("b", 2, 2)], "query string, count long, ord long")) == 3
    change = spark.createDataFrame([("a", 1), ("c", 4)], "query string, delta long")
    store.apply_batch(change, 1, 10.0)
    store.apply_batch(change, 1, 10.0)
    assert as_dict(store.load_all()) == {"a": 8, "b": 2, "c": 4}
    store.compact()
    assert as_dict(store.load_all()) == {"a": 8, "b": 2, "c": 4}
    store.apply_batch(change, 2, 20.0)
    rows = {r.query: (r["count"], r.last_searched) for r in store.load_all().collect()}
    assert rows == {"a": (9, 20.0), "b": (2, None), "c": (8, 20.0)}
    store.bulk_replace(spark.createDataFrame([("z", 1)], "query string, count long"))
    assert as_dict(store.load_all()) == {"z": 1}
    store.set_meta("k", "x")
    assert store.get_meta_int("k", 3) == 3


def test_replacing_by_an_empty_table(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store.apply_batch(spark.createDataFrame([("apple", 5)], "query string, delta long"), 1, 1.0)
    assert store.bulk_replace(spark.createDataFrame([], "query string, count long")) == 0
    assert as_dict(store.load_all()) == {} and store.watermark() == 1
    store.apply_batch(spark.createDataFrame([("apple", 2)], "query string, delta long"), store.watermark() + 1, 1.0)
    assert as_dict(store.load_all()) == {"apple": 2}


def test_flush_during_compaction_is_not_lost(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "store"))
    change = lambda n: spark.createDataFrame([("q", n)], "query string, delta long")
    store.apply_batch(change(1), 1, 1.0)
    put = store._put

    def late(rows, version, flush):
        if version:
            store.apply_batch(change(10), 2, 1.0)
        put(rows, version, flush)

    monkeypatch.setattr(store, "_put", late)
    store.compact()
    assert as_dict(store.load_all()) == {"q": 11}


def test_repeated_flushes_and_vacuum(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    change = lambda n: spark.createDataFrame([("q", n)], "query string, delta long")
    assert store.apply_batch(change(1), 1, 1.0)
    assert not store.apply_batch(change(1), 1, 1.0)  # sent again
    with pytest.raises(ValueError):
        store.apply_batch(change(2), 1, 1.0)  # another flush
    store.apply_batch(change(4), 2, 1.0)
    assert as_dict(store.load_all()) == {"q": 5} and as_dict(store.load_all(1)) == {"q": 1}
    (tmp_path / "store/counts/.spark-staging-x/version=0/flush=3").mkdir(parents=True)  # a writer that died
    assert as_dict(store.load_all()) == {"q": 5}
    store.compact()
    store.apply_batch(change(7), 3, 1.0)
    store.vacuum()
    assert as_dict(store.load_all()) == {"q": 12} and store._partitions() == (1, 2, [3])
    with pytest.raises(ValueError):
        store.load_all(1)
    with pytest.raises(ValueError):
        store.apply_batch(change(1), 0, 1.0)


def test_late_replays_after_compaction_change_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    change = spark.createDataFrame([("apple", 1)], "query string, delta long")
    for n in (1, 2, 3):
        store.apply_batch(change, n, 1.0)
    for n in (1, 2):
        store.compact()
        store.vacuum()
        assert not store.apply_batch(change, n, 1.0)
        assert store.watermark() == 3 and as_dict(store.load_all()) == {"apple": 3}
    store.compact()
    store.vacuum()
    assert store.watermark() == 3 and as_dict(store.load_all()) == {"apple": 3}


def test_an_empty_flush_is_one(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store.apply_batch(spark.createDataFrame([], "query string, delta long"), 1, 1.0)
    assert store.watermark() == 1 and store.count_rows() == 0


def test_duplicates_without_an_order_are_refused(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    with pytest.raises(ValueError):
        store.bulk_replace(spark.createDataFrame([("a", 1), ("a", 2)], "query string, count long"))
    assert store.count_rows() == 0


def test_lookup_filters_before_it_merges(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store.bulk_replace(spark.createDataFrame([("a", 1), ("b", 2)], "query string, count long"))
    store.apply_batch(spark.createDataFrame([("b", 4), ("c", 1)], "query string, delta long"), 1, 1.0)
    assert [store.get_count(q) for q in ("a", "b", "c", "d")] == [1, 6, 1, None]
    asked = spark.createDataFrame([("b",), ("c",), ("x",)], "query string")
    assert as_dict(store.load_all(among=asked)) == {"b": 6, "c": 1}


def test_segments_in_folders(spark, tmp_path):
    spark.createDataFrame([("x", 3), ("y", None), ("z", 12)], "value string, seq long").write.partitionBy("seq").text(str(tmp_path / "log"))
    assert sorted(map(tuple, read_segments(spark, str(tmp_path / "log")).collect()), key=str) == [(12, "z"), (3, "x"), (None, "y")]


def test_invalidation_covers_all_prefixes_and_modes(spark):
    keys = {r.cache_key for r in writes.stale_keys(spark.createDataFrame([("ab",)], "query string")).collect()}
    assert keys == {"suggest:basic:a", "suggest:basic:ab", "suggest:trending:a", "suggest:trending:ab"}


@pytest.mark.parametrize("increment", [1, 3])
def test_increment(spark, increment):
    assert writes.deltas(submissions(spark, ("q", 2)), increment=increment).first().delta == 2 * increment

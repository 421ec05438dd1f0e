import pytest

from pyspark.sql import functions as F

from prefixory.operators import metrics
from prefixory.operators.index import prefix_topk
from prefixory.operators.recency import recency_scores
from prefixory.settings import Settings
from prefixory.sources.index_table import IndexTable
from prefixory.sources.store import Store
from prefixory.streaming import flush, progress, state


def source(spark, folder, schema, **options):
    reader = spark.readStream.schema(schema)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.parquet(str(folder))


def write(spark, rows, schema, folder):
    for batch in rows:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(folder))


def held(spark, log, name, **options):
    """Entries of a state variable."""
    return spark.read.format("statestore").option("stateVarName", name).load(str(log)).count()


def test_flushes_are_exactly_once_over_restarts(spark, tmp_path):
    write(spark, [[("Apple",), ("apple ",)], [("b",)]], "query string", tmp_path / "in")
    store, log = Store(spark, str(tmp_path / "store")), str(tmp_path / "log")
    stream = lambda: source(spark, tmp_path / "in", "query string", maxFilesPerTrigger=1)
    failed = []

    def breaks(batch, n):
        flush.flusher(store, lambda: 1.0, log)(batch, n)
        if n == 1 and not failed:
            failed.append(n)
            raise RuntimeError("after the write, before the commit")

    with pytest.raises(Exception):
        flush.drain(stream(), breaks, log)
    flush.drain(stream(), flush.flusher(store, lambda: 2.0, log), log)
    assert {r.query: r["count"] for r in store.load_all().collect()} == {"apple": 2, "b": 1}
    assert store.watermark() == 2


def test_state_equals_closed_form_over_batches(spark, tmp_path):
    rows = [[("a", 1000.0), ("b", 1005.0)], [("a", 1010.0), ("a", 1007.0)], [("b", 1002.0), ("a", 1030.0)]]
    write(spark, rows, "query string, t double", tmp_path / "in")
    stream = state.recency_stream(source(spark, tmp_path / "in", "query string, t double", maxFilesPerTrigger=1), 10.0)
    last = {}

    def keep(batch, n):
        last.update({r.query: (r.score, r.updated) for r in batch.collect()})

    flush.drain(stream, keep, str(tmp_path / "log"), "update")
    events = spark.createDataFrame([r for batch in rows for r in batch], "query string, t double")
    for r in events.groupBy("query").agg({"t": "max"}).collect():
        own = recency_scores(events.where(events["query"] == r.query), r[1], 10.0).first()
        assert last[r.query] == (pytest.approx(own.score), r[1])


def test_state_of_forgotten_queries_goes(spark, tmp_path):
    """With a half-life of ten seconds a query of long ago has no state any more, and begins anew."""
    rows = []
    for batch in ([("a", 10.0), ("a", 10.0)], [("b", 1e6)], [("c", 2e6)], [("a", 3e6)]):
        write(spark, [batch], "query string, t double", tmp_path / "in")
        stream = state.recency_stream(source(spark, tmp_path / "in", "query string, t double"), 10.0)
        flush.drain(stream, lambda df, n: rows.extend(df.collect()), str(tmp_path / "log"), "update")
    assert [(r.query, r.score) for r in rows] == [("a", 2.0), ("b", 1.0), ("c", 1.0), ("a", 1.0)]
    assert held(spark, tmp_path / "log", "score") == 1


def test_a_second_drain_goes_on_after_the_first(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    for k, query in enumerate(("apple", "banana")):
        write(spark, [[(query,)]], "query string", tmp_path / f"in{k}")
        log = str(tmp_path / f"log{k}")
        flush.drain(source(spark, tmp_path / f"in{k}", "query string"), flush.flusher(store, lambda: 1.0, log), log)
    assert {r.query: r["count"] for r in store.load_all().collect()} == {"apple": 1, "banana": 1}


def begun(folder, name="x"):
    """A checkpoint as a started query leaves it."""
    folder.mkdir(parents=True, exist_ok=True)
    (folder / "metadata").write_text(f'{{"id":"{name}"}}')
    return str(folder)


def test_a_renewed_checkpoint_loses_nothing(spark, tmp_path):
    import shutil

    store, log = Store(spark, str(tmp_path / "store")), str(tmp_path / "log")
    for k, query in enumerate(("apple", "banana")):
        write(spark, [[(query,)]], "query string", tmp_path / f"in{k}")
        flush.drain(source(spark, tmp_path / f"in{k}", "query string"), flush.flusher(store, lambda: 1.0, log), log)
        shutil.rmtree(log)  # begun anew at the same path
    assert {r.query: r["count"] for r in store.load_all().collect()} == {"apple": 1, "banana": 1}


def test_index_of_repeated_batches_and_of_a_new_driver(spark, tmp_path):
    store, log = Store(spark, str(tmp_path / "store")), begun(tmp_path / "log")
    store.bulk_replace(spark.createDataFrame([("apply", 1)], "query string, count long"))
    batch = spark.createDataFrame([("Apple",), ("apple",)], "query string")
    keeper = flush.IndexMaintainer(store, log)
    keeper(batch, 0)
    keeper(batch, 0)
    again = flush.IndexMaintainer(store, log)
    again(batch, 0)
    again(spark.createDataFrame([("apply",)], "query string"), 1)
    again(batch, 0)  # late
    got = [tuple(r) for r in again.index().where("prefix = 'app'").orderBy("rank").select("query", "count").collect()]
    assert got == [("apple", 2), ("apply", 2)]
    whole = prefix_topk(store.load_all().select("query", "count"))
    assert sorted(map(tuple, again.index().collect())) == sorted(map(tuple, whole.collect()))


def files(folder):
    return {str(f.relative_to(folder)) for f in folder.rglob("*.parquet")}


def test_a_flush_rewrites_the_touched_buckets_alone(spark, tmp_path):
    table = IndexTable(spark, str(tmp_path), buckets=32)
    counts = spark.createDataFrame([(f"{a}{b}{c}", 5) for a in "abcdefgh" for b in "xyz" for c in "123"], "query string, count long")
    table.begin(counts, 0)
    before = files(tmp_path / "table")
    grown = spark.createDataFrame([("ax1", 9)], "query string, count long")
    table.grow(grown, 1)
    own = {table_bucket for table_bucket in (r.b for r in spark.createDataFrame([("a",), ("ax",), ("ax1",), ("",)], "prefix string").select(table.bucket(F.col("prefix")).alias("b")).collect())}
    changed = {int(f.split("bucket=")[1].split("/")[0]) for f in before ^ files(tmp_path / "table")}
    assert changed == own and len(own) <= 4
    now = counts.join(grown.select("query"), "query", "left_anti").unionByName(grown)
    assert sorted(map(tuple, table.index().collect())) == sorted(map(tuple, prefix_topk(now).collect()))
    assert [f.name for f in (tmp_path / "staged").glob("flush=*")] == ["flush=1"]


def test_a_flush_that_died_between_its_steps_is_finished(spark, tmp_path, monkeypatch):
    import shutil

    table = IndexTable(spark, str(tmp_path), buckets=4)
    table.begin(spark.createDataFrame([("ab", 2)], "query string, count long"), 0)
    finish = IndexTable._finish
    monkeypatch.setattr(IndexTable, "_finish", lambda self, n: shutil.rmtree(tmp_path / "table" / "bucket=4"))  # the root's bucket is lost on the way
    grown = spark.createDataFrame([("ac", 3)], "query string, count long")
    table.grow(grown, 1)
    monkeypatch.setattr(IndexTable, "_finish", finish)
    table.grow(grown, 1)
    want = prefix_topk(spark.createDataFrame([("ab", 2), ("ac", 3)], "query string, count long"))
    assert sorted(map(tuple, table.index().collect())) == sorted(map(tuple, want.collect()))


def test_requests_meet_the_newest_index(spark, tmp_path):
    table = IndexTable(spark, str(tmp_path / "index"), buckets=4)
    table.begin(spark.createDataFrame([("apple", 2)], "query string, count long"), 0)
    write(spark, [[(1, " AP")], [(2, "ap")]], "id long, prefix string", tmp_path / "in")
    got = []

    def keep(rows, n):
        got.extend((r.id, r.rank, r.query) for r in rows.collect())
        table.grow(spark.createDataFrame([("apply", 9)], "query string, count long"), n + 1)

    flush.drain(source(spark, tmp_path / "in", "id long, prefix string", maxFilesPerTrigger=1), flush.serve(table, keep), str(tmp_path / "log"))
    assert sorted(got) == [(1, 1, "apple"), (2, 1, "apply"), (2, 2, "apple")]
    static = []
    flush.drain(flush.suggestions(source(spark, tmp_path / "in", "id long, prefix string"), table), lambda rows, n: static.extend(r.query for r in rows.collect()), str(tmp_path / "log2"))
    assert sorted(static) == ["apple", "apple", "apply", "apply"]


def test_the_loop_lives_over_failures(spark, tmp_path):
    write(spark, [[("q",)]], "query string", tmp_path / "in")
    store, log, tries = Store(spark, str(tmp_path / "store")), str(tmp_path / "log"), []
    each = flush.flusher(store, lambda: 1.0, log)

    def fails_twice(batch, n):
        tries.append(n)
        each(batch, n)
        if len(tries) < 3:
            raise RuntimeError("after the write")

    failures = flush.keep_flushing(source(spark, tmp_path / "in", "query string"), fails_twice, log, lambda: len(tries) >= 3, 0.2)
    assert failures == 2 and tries == [0, 0, 0]
    assert store.get_count("q") == 1


def test_size_trigger(spark, tmp_path):
    """Files of 100 submissions, flushes of at most 250: two files a flush."""
    write(spark, [[(f"q{k}",)] * 100 for k in range(5)], "query string", tmp_path / "in")
    sizes = []
    stream = source(spark, tmp_path / "in", "query string", **flush.by_size(Settings(batch_max_size=250), 100))
    flush.drain(stream, lambda batch, n: sizes.append(batch.count()), str(tmp_path / "log"))
    assert sizes == [200, 200, 100]


def test_timed_flush_stops(spark, tmp_path):
    write(spark, [[("q",)]], "query string", tmp_path / "in")
    store = Store(spark, str(tmp_path / "store"))
    q = flush.start(source(spark, tmp_path / "in", "query string"), flush.flusher(store, lambda: 1.0, str(tmp_path / "log")), str(tmp_path / "log"), 0.2)
    q.processAllAvailable()
    q.stop()
    assert store.get_count("q") == 1


def test_a_loop_whose_query_cannot_start_lives_on(spark, tmp_path):
    write(spark, [[("q",)]], "query string", tmp_path / "in")
    store, log, tries = Store(spark, str(tmp_path / "store")), tmp_path / "log", []
    log.write_text("in the way")  # no folder: the query fails to start

    def stopped():
        tries.append(0)
        if len(tries) == 2:
            log.unlink()
        return store.get_count("q") == 1

    assert flush.keep_flushing(source(spark, tmp_path / "in", "query string"), flush.flusher(store, lambda: 1.0, str(log)), str(log), stopped, 0.2) >= 1
    assert store.get_count("q") == 1


def test_processing_time_state_has_a_time_to_live(spark, tmp_path):
    """With a half-life of 0.05 s state lives for about two seconds after its last change."""
    import time

    rows = []
    write(spark, [[("a", 10.0), ("a", 10.0)]], "query string, t double", tmp_path / "in")
    stream = state.recency_stream(source(spark, tmp_path / "in", "query string, t double"), 0.05, clock="processing")
    q = stream.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "log")).trigger(processingTime="100 milliseconds").foreachBatch(lambda df, n: rows.extend(map(tuple, df.collect()))).start()
    wait(lambda: len(rows) == 1, q)
    time.sleep(4)
    write(spark, [[("a", 10.0), ("b", 11.0)]], "query string, t double", tmp_path / "in")
    wait(lambda: len(rows) == 3, q)
    q.stop()
    assert rows[0] == ("a", 2.0, 10.0) and sorted(rows[1:]) == [("a", 1.0, 10.0), ("b", 1.0, 11.0)]


def test_scores_without_a_half_life(spark, tmp_path):
    write(spark, [[("a", 1.0), ("a", 1.0), ("a", 0.5)]], "query string, t double", tmp_path / "in")
    rows = []
    flush.drain(state.recency_stream(source(spark, tmp_path / "in", "query string, t double"), 0.0), lambda df, n: rows.extend(map(tuple, df.collect())), str(tmp_path / "log"), "update")
    assert rows == [("a", 2.0, 1.0)]


def wait(done, query, seconds=60):
    import time

    end = time.time() + seconds
    while not done():
        if query.exception():
            raise query.exception()
        assert time.time() < end
        time.sleep(0.1)


@pytest.mark.parametrize("seed", [1, 2])
def test_debounce_equals_the_batch_form_on_late_rows(spark, tmp_path, seed):
    import random

    r = random.Random(seed)
    rows = [(r.randrange(3), i, float(r.randrange(0, 400) / 4)) for i in range(150)]
    arrival = sorted(rows, key=lambda x: x[2] + r.random() * 8)
    batches = [arrival[k : k + 25] for k in range(0, 150, 25)] + [[(9, 999, 1000.0)], [(9, 1000, 2000.0)]]
    write(spark, batches, "session long, event_id long, t double", tmp_path / "in")
    got = []
    stream = state.debounced(source(spark, tmp_path / "in", "session long, event_id long, t double", maxFilesPerTrigger=1), 3.0, "10 seconds")
    flush.drain(stream, lambda df, n: got.extend(map(tuple, df.collect())), str(tmp_path / "log"))
    want = metrics.debounced(spark.createDataFrame([x for b in batches for x in b], "session long, event_id long, t double"), "session", "t", 3.0, "event_id")
    want = {tuple(x) for x in want.select("session", "event_id", "t").collect()}
    assert sorted(got) == sorted(x for x in want if x[2] < 1500)
    assert held(spark, tmp_path / "log", "runs") == 1  # the last keystroke waits


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    batches = [[("q", 100.0), ("q", 160.0)], [("q", 161.0)], [("q", 10.0), ("q", 20.0), ("q", 150.0)], [("q", 900.0)]]
    write(spark, batches, "query string, t double", tmp_path / "in")
    got = []
    rows = source(spark, tmp_path / "in", "query string, t double", maxFilesPerTrigger=1).select("query", F.timestamp_seconds("t").alias("ts"))
    counts = flush.sliding_counts(rows, "60 seconds", "30 seconds", "20 seconds")
    q = counts.writeStream.option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).foreachBatch(lambda df, n: got.extend((r.start.timestamp(), r.delta) for r in df.collect())).start()
    q.awaitTermination()
    assert sorted(got) == [(60.0, 1), (90.0, 1), (120.0, 3), (150.0, 3)]
    assert flush.dropped(q.recentProgress) == 2  # of q in two windows


def buffer(spark, tmp_path, lanes, settings, submissions, sink=state.LaneSink, sent=0, **options):
    out = sink(spark, str(tmp_path / "out"), lanes, str(tmp_path / "log"), lambda: 1.0)
    stream = state.buffered(source(spark, tmp_path / "in", "query string", **options), out.acks(), settings, lanes)
    flushes = []

    def each(df, n):
        flushes.extend(df.groupBy("lane", "flush").count().collect())
        out(df, n)

    q = stream.writeStream.option("checkpointLocation", str(tmp_path / "log")).trigger(processingTime="200 milliseconds").foreachBatch(each).start()
    try:
        wait(lambda: len(flushes) >= sent and sum(r["count"] for r in out.load_all().collect()) >= submissions, q)
    finally:
        q.stop()
    return out, flushes


def test_a_flush_comes_at_so_many_distinct_queries_or_after_the_interval(spark, tmp_path):
    write(spark, [[(f"q{i % 5}",) for i in range(12)]], "query string", tmp_path / "in")
    by_size, flushes = buffer(spark, tmp_path, 1, Settings(batch_max_size=5, batch_flush_interval=3600.0), 12)
    assert {r.query: r["count"] for r in by_size.load_all().collect()} == {"q0": 3, "q1": 3, "q2": 2, "q3": 2, "q4": 2}
    assert [tuple(r) for r in flushes] == [(0, 1, 5)]
    write(spark, [[("a",), ("a",), ("B",), ("",)]], "query string", tmp_path / "t" / "in")
    by_time, flushes = buffer(spark, tmp_path / "t", 1, Settings(batch_max_size=500, batch_flush_interval=0.5), 3)
    assert {r.query: r["count"] for r in by_time.load_all().collect()} == {"a": 2, "b": 1}
    assert {(r.flush, r["count"]) for r in flushes} == {(1, 2)}


class Failing(state.LaneSink):
    """Whose first flushes fail, the second after it was written."""

    tries = 0

    def __call__(self, batch, n):
        for store in self.stores:
            apply = type(store).apply_batch

            def broken(changes, seq, at, store=store, apply=apply):
                self.tries += 1
                if self.tries == 1:
                    raise OSError("before the write")
                out = apply(store, changes, seq, at)
                if self.tries == 2:
                    raise OSError("after the write")
                return out

            store.apply_batch = broken
        super().__call__(batch, n)


def test_failed_flushes_go_on_with_the_next(spark, tmp_path):
    """The store fails twice; what was submitted meanwhile follows, and nothing is lost or counted twice."""
    write(spark, [[("kiwi",)] * 2, [("kiwi",)], [("fig",)], [("kiwi",), ("fig",)], [("kiwi",)]], "query string", tmp_path / "in")
    out, flushes = buffer(spark, tmp_path, 1, Settings(batch_max_size=500, batch_flush_interval=0.3), 7, Failing, sent=4, maxFilesPerTrigger=1)
    assert {r.query: r["count"] for r in out.load_all().collect()} == {"kiwi": 5, "fig": 2}
    assert out.failures == 2 and [r.flush for r in flushes][:4] == [1, 1, 1, 2]


def test_progress_is_a_table(spark, tmp_path):
    write(spark, [[("a",), ("a",), ("b",)], [("a",), ("",)]], "query string", tmp_path / "in")
    store, log = Store(spark, str(tmp_path / "store")), str(tmp_path / "log")
    with progress.ProgressLog(spark, str(tmp_path / "progress")) as seen:
        flush.drain(source(spark, tmp_path / "in", "query string", maxFilesPerTrigger=1), flush.flusher(store, lambda: 1.0, log), log)
        with pytest.raises(Exception):
            flush.drain(source(spark, tmp_path / "in", "query string"), lambda df, n: 1 / 0, str(tmp_path / "log2"))
    own = progress.flush_metrics(seen.table(), store, flush.checkpoint_id(spark, log)).first()
    assert (own.searches, own.upserts, own.flushes, own.reduction, own.failures) == (5, 3, 2, 1.667, 0) and own.mean_ms > 0
    other = progress.flush_metrics(seen.table(), store, flush.checkpoint_id(spark, str(tmp_path / "log2"))).first()
    assert other.failures == 1 and other.searches == 0


def test_the_log_of_submissions_holds_each_batch_once(spark, tmp_path):
    log = str(tmp_path / "submissions")
    for k in range(3):
        if k < 2:
            write(spark, [[(f"q{k}",)] * 2], "query string", tmp_path / "in")
        flush.log_submissions(source(spark, tmp_path / "in", "query string"), log, str(tmp_path / "log"))
    (tmp_path / "submissions" / "part-00000-stray.snappy.parquet").write_bytes(b"half-written")  # of a task that died
    back = []
    flush.drain(spark.readStream.schema("query string").parquet(log), lambda df, n: back.extend(r.query for r in df.collect()), str(tmp_path / "back"))
    assert sorted(back) == ["q0", "q0", "q1", "q1"]

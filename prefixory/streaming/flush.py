"""Submissions as a stream: exactly-once flushes, windows, sessions, suggestions and a log of the submissions themselves.

A flush is a micro-batch: what came within the interval (the query's trigger) and at most so many files (the size trigger is
the source's, see `by_size`; `state.buffered` counts distinct queries). A batch that is sent again after a failure is known by
its number, so counts never double; a new checkpoint goes on after what the store has.
"""

from __future__ import annotations

import logging
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize
from ..operators.writes import deltas
from ..settings import Settings
from ..sources.index_table import IndexTable
from ..sources.store import Store

log = logging.getLogger(__name__)


def drain(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """All that is there, batch by batch, then stops: the graceful end of a writer."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
    query.awaitTermination()


def by_size(settings: Settings, rows_a_file: int) -> dict[str, str]:
    """Options of a file source whose files hold about so many submissions: a flush takes `batch_max_size` of them at most,
    or one file."""
    return {"maxFilesPerTrigger": str(max(1, settings.batch_max_size // max(1, rows_a_file)))}


def start(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, seconds: float = Settings.batch_flush_interval):
    """A flush every so many seconds until the returned query is stopped. A failed batch ends the query; started again with
    the same checkpoint it repeats that batch (`keep_flushing` does so)."""
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").foreachBatch(each).start()


def keep_flushing(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, stopped: Callable[[], bool], seconds: float = Settings.batch_flush_interval) -> int:
    """Flushes until stopped() says so, over failures: each is logged, and after the interval its batch is tried again. A query
    that can't start counts as a failure too, and one that ended by itself is started again after the interval. Returns the
    number of failures."""
    failures = 0
    while not stopped():
        query = None
        try:
            query = start(stream, each, checkpoint, seconds)
            while query.isActive and not stopped():
                query.awaitTermination(max(1, int(seconds)))
            if query.isActive:
                query.processAllAvailable()
            elif not stopped():
                time.sleep(seconds)
        except Exception:  # noqa: BLE001  whatever a batch met, the loop lives on
            failures += 1
            log.exception("a flush failed and is tried again")
            time.sleep(seconds)
        finally:
            if query is not None:
                query.stop()
    return failures


def checkpoint_id(spark: SparkSession, checkpoint: str) -> str:
    """What Spark has named a checkpoint; one that is begun anew at the same path has another."""
    return spark.read.schema("id string").json(f"{checkpoint}/metadata").first().id


def first_number(store: Store, checkpoint: str) -> int:
    """The number before that of the checkpoint's first batch: the store's watermark when the checkpoint was new."""
    key = f"first-{checkpoint_id(store.spark, checkpoint)}"
    known = store.get_meta_int(key, -1)
    if known < 0:
        known = store.watermark()
        store.set_meta(key, str(known))
    return known


def submitted(batch: DataFrame) -> DataFrame:
    """query, delta of a batch of submissions."""
    return deltas(batch.select(normalize(F.col("query")).alias("query")))


def flusher(store: Store, at: Callable[[], float], checkpoint: str) -> Callable[[DataFrame, int], None]:
    """Applies each batch's deltas under the batch's number, counted on from what the store had when the checkpoint was new."""
    first = None

    def flush(batch: DataFrame, batch_id: int) -> None:
        nonlocal first
        if first is None:  # the checkpoint has its id once its query runs
            first = first_number(store, checkpoint)
        store.apply_batch(submitted(batch), first + batch_id + 1, at())

    return flush


class IndexMaintainer:
    """Keeps counts (in a store) and the prefix index current over flushes. A batch that comes again changes nothing, and a new
    driver goes on from what is stored."""

    def __init__(self, store: Store, checkpoint: str, k: int = Settings.trie_node_capacity, at: Callable[[], float] = time.time, buckets: int = 64):
        self.store, self.checkpoint, self.at, self.first = store, checkpoint, at, None
        self.table = IndexTable(store.spark, f"{store.root}/index", k, buckets)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        if self.first is None:
            self.first = first_number(self.store, self.checkpoint)
            self.table.begin(self.store.load_all(), self.store.watermark())
        seq, changes = self.first + batch_id + 1, submitted(batch)
        self.store.apply_batch(changes, seq, self.at())
        self.table.grow(self.store.load_all(among=changes).select("query", "count"), seq)

    def index(self) -> DataFrame:
        return self.table.index()


def flush_windows(events: DataFrame, interval: str, delay: str) -> DataFrame:
    """Deltas of tumbling windows of event time; later than the delay is dropped."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", interval).alias("w"), "query").agg(F.count("*").alias("delta")).select(F.col("w.start").alias("start"), "query", "delta")


def sessions(events: DataFrame, gap: str, delay: str) -> DataFrame:
    """Bursts of a user: sessions that end with a gap."""
    own = F.session_window("ts", gap).alias("s")
    return events.withWatermark("ts", delay).groupBy(own, "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("s.start").alias("start"), "n")


def sliding_counts(events: DataFrame, length: str, step: str, delay: str) -> DataFrame:
    """start, query, delta of overlapping windows of event time. An event later than the delay is dropped, which the
    progress of the query tells (`dropped`)."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", length, step).alias("w"), "query").agg(F.count("*").alias("delta")).select(F.col("w.start").alias("start"), "query", "delta")


def dropped(progresses: list) -> int:
    """What a query's operators dropped as too late, by its progress: of a batch's rows, summed before they meet the state,
    each window and key counts once."""
    return sum(op["numRowsDroppedByWatermark"] for p in progresses for op in p["stateOperators"])


def log_submissions(stream: DataFrame, path: str, checkpoint: str):
    """Appends submissions (query, and further columns) to a log, as Parquet by Spark's own file sink: its metadata log tells
    which files count, so a batch that is sent again, or died half-written, is there once. Runs over what is there."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def suggestions(requests: DataFrame, table: IndexTable, limit: int = Settings.suggest_limit) -> DataFrame:
    """Suggestions for a stream of requests (prefix and any further columns): a join of each batch with the stored index as
    it is when the query starts; `serve` reads it anew for each batch."""
    return table.suggest(requests, limit)


def serve(table: IndexTable, each: Callable[[DataFrame, int], None], limit: int = Settings.suggest_limit) -> Callable[[DataFrame, int], None]:
    """For foreachBatch over requests: each batch meets the index of the last flush, and `each` gets its suggestions."""
    return lambda batch, n: each(table.suggest(batch, limit), n)

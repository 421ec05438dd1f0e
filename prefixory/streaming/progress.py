"""What running queries did, from the engine's own progress, as a table."""

from __future__ import annotations

import json
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..sources.scratch import scratch_path
from ..sources.store import Store

SCHEMA = "id string, batch long, rows long, ms long, dropped long, failed string"


class ProgressLog(StreamingQueryListener):
    """A row for each batch that a query of the session ran and for each failure. Rows are few and narrow; every `most` of
    them, and at `save`, they are appended to the table at `path`."""

    def __init__(self, spark: SparkSession, path: str | None = None, most: int = 1000):
        self.spark, self.path, self.most = spark, path or scratch_path(spark, "progress"), most
        self.waiting: list[tuple] = []
        self.lock = threading.Lock()

    def __enter__(self) -> ProgressLog:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *_) -> None:
        self.spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        self.spark.streams.removeListener(self)
        self.save()

    def _add(self, row: tuple) -> None:
        with self.lock:
            self.waiting.append(row)
        if len(self.waiting) >= self.most:
            self.save()

    def save(self) -> None:
        with self.lock:
            rows, self.waiting = self.waiting, []
        self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = json.loads(event.progress.json)
        dropped = sum(op["numRowsDroppedByWatermark"] for op in p["stateOperators"])
        self._add((p["id"], p["batchId"], p["numInputRows"], p["durationMs"].get("triggerExecution", 0), dropped, None))

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            self._add((str(event.id), None, 0, 0, 0, str(event.exception)[:1000]))

    def table(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(self.path)


def flush_metrics(progress: DataFrame, store: Store, query_id: str) -> DataFrame:
    """searches, upserts, flushes, reduction (as write_reduction has them of a batch of rows), failures and the mean ms of a
    query that flushes into the store: read rows by its progress, written ones by the store's flushes."""
    own = progress.where(F.col("id") == query_id).agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("searches"), F.count("failed").alias("failures"), F.round(F.avg(F.when(F.col("rows") > 0, F.col("ms"))), 1).alias("mean_ms"))
    written = store.flush_sizes().where("upserts > 0").agg(F.coalesce(F.sum("upserts"), F.lit(0)).alias("upserts"), F.count("*").alias("flushes"))
    both = own.crossJoin(written)  # one row each
    return both.select("searches", "upserts", "flushes", F.round(F.coalesce(F.try_divide("searches", "upserts"), F.lit(0.0)), 3).alias("reduction"), "failures", "mean_ms")

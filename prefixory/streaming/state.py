"""Keyed state by stateful processors: decayed scores, debounced keystrokes, and a buffer of submissions that waits for its sink.

State lies in RocksDB, which these processors need; making one of these streams sets it for streams started from then on in
the session. Each key's state is small and bounded as its processor says; rows of a key are folded frame by frame.
"""

from __future__ import annotations

import logging
import math
import sys
import time
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import normalize
from ..settings import MIN_RECENCY, Settings
from ..sources.store import Store
from .flush import first_number

log = logging.getLogger(__name__)

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Searches of a query at most within what a score remembers, where state lives for a fixed time (processing time).
MOST_SCORE = 2.0**32


def _rocks(df: DataFrame) -> DataFrame:
    """Sets what the processors need; they are sent whole, so executors need not have this package."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return df


class _Recency(StatefulProcessor):
    """Two numbers a query. In event time a timer clears them when the score has decayed away; a timer that finds the score
    still alive sets itself again, so each query has one. In processing time they live for a fixed time after each change."""

    def __init__(self, half_life: float, least: float, event_time: bool):
        self.half_life, self.least, self.event_time = half_life, least, event_time

    def _lives(self, score: float) -> float:
        return self.half_life * math.log2(max(2.0, score / self.least)) if self.half_life > 0 else 0.0

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        ttl = None if self.event_time else max(1, int(self._lives(MOST_SCORE) * 1000))
        self.state = handle.getValueState("score", "score double, updated double", ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.state.get() if self.state.exists() else None
        score, updated = (0.0, -math.inf) if known is None else known
        for frame in rows:
            t = frame["t"].to_numpy(float)
            last = max(updated, float(t.max()))
            if self.half_life > 0:
                before = score * 0.5 ** ((last - updated) / self.half_life) if score else 0.0
                score = before + float(np.power(0.5, (last - t) / self.half_life).sum())
            else:
                score = (score if updated == last else 0.0) + float((t == last).sum())
            updated = last
        self.state.update((score, updated))
        if self.event_time and known is None:
            self._wake(updated + self._lives(score), timerValues)
        yield pd.DataFrame({"query": [key[0]], "score": [score], "updated": [updated]})

    def _wake(self, seconds: float, timerValues) -> None:
        self.handle.registerTimer(max(math.ceil(seconds * 1000), timerValues.getCurrentWatermarkInMs() + 1))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            score, updated = self.state.get()
            end = updated + self._lives(score)
            if end * 1000 <= timerValues.getCurrentWatermarkInMs():
                self.state.clear()
            else:
                self._wake(end, timerValues)
        return iter(())


def recency_stream(events: DataFrame, half_life: float = Settings.recency_half_life, least: float = MIN_RECENCY, clock: str = "event") -> DataFrame:
    """events (query, t): after each batch the query's score decayed to its last event. By the event clock a query's state goes
    when its score has decayed below `least`, and an event so late that it counts less than `least` may be left out; by the
    processing clock it goes when it hasn't changed for so long that any score would have."""
    wait = half_life * math.log2(1 / least) if half_life > 0 else 0.0
    rows = _rocks(events).select("query", "t", F.timestamp_seconds("t").alias("ts"))
    own = _Recency(half_life, least, clock == "event")
    timed = rows.withWatermark("ts", f"{int(wait * 1000)} milliseconds") if own.event_time else rows
    return timed.groupBy("query").transformWithStateInPandas(own, "query string, score double, updated double", "update", "eventTime" if own.event_time else "processingTime")


class _Debounce(StatefulProcessor):
    """Of a session the runs of keystrokes that follow each other within the time, each as begin, end and the last keystroke's
    id: a keystroke within a run, or just before it, is followed by another. A run is let out, as its last keystroke, by the
    timer at its end plus the time, when the watermark says that nothing more comes before. Few runs are open at once: those
    that began within the time and the stream's delay."""

    def __init__(self, seconds: float):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.runs = handle.getListState("runs", "begin double, end double, id long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        old = [tuple(r) for r in self.runs.get()] if self.runs.exists() else []
        runs = old
        for frame in rows:
            t, i = frame["t"].to_numpy(float), frame["event_id"].to_numpy(np.int64)
            begin, end, last = (np.concatenate((np.array([r[k] for r in runs], a.dtype), a)) for k, a in enumerate((t, t, i)))
            order = np.lexsort((last, end, begin))
            begin, end, last = begin[order], end[order], last[order]
            reach = np.maximum.accumulate(end)
            fresh = np.concatenate(([True], begin[1:] - reach[:-1] >= self.seconds))
            group = np.cumsum(fresh) - 1
            latest = np.lexsort((last, end, group))  # of each run the latest keystroke is its last
            latest = latest[np.append(np.flatnonzero(fresh)[1:] - 1, len(group) - 1)]
            runs = list(zip(begin[fresh].tolist(), end[latest].tolist(), last[latest].tolist(), strict=True))
        self.runs.put(runs)
        known = {r[1] for r in old}
        for _, end, _ in runs:
            if end not in known:
                self.handle.registerTimer(self._due(end))
        return iter(())

    def _due(self, end: float) -> int:
        return math.ceil((end + self.seconds) * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        runs = [tuple(r) for r in self.runs.get()] if self.runs.exists() else []
        due = [r for r in runs if self._due(r[1]) <= expiredTimerInfo.getExpiryTimeInMs()]  # a timer of a run that has grown since finds none
        if due:
            left = [r for r in runs if r not in due]
            self.runs.put(left) if left else self.runs.clear()
            yield pd.DataFrame({"session": [key[0]] * len(due), "event_id": [r[2] for r in due], "t": [r[1] for r in due]})


def debounced(keystrokes: DataFrame, seconds: float, delay: str) -> DataFrame:
    """session, event_id, t of keystrokes (session, event_id, t) that none of the same session follows within the time. Rows may
    come in any order within the delay; later ones are dropped."""
    rows = _rocks(keystrokes).select(F.col("session").cast("long"), F.col("event_id").cast("long"), "t", F.timestamp_seconds("t").alias("ts"))
    return rows.withWatermark("ts", delay).groupBy("session").transformWithStateInPandas(_Debounce(seconds), "session long, event_id long, t double", "append", "eventTime")


class _Buffer(StatefulProcessor):
    """Of a lane the open deltas (query to delta) and those that were sent and wait for the sink's word. A flush is sent when
    `keys` distinct queries are open or `interval` has passed since the first; while one is under way, deltas gather. A
    timer sends it again, under its number, until it is acknowledged."""

    def __init__(self, keys: int, interval: float):
        self.keys, self.interval = keys, max(1, int(interval * 1000))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "query string", "delta long")
        self.sent = handle.getMapState("sent", "query string", "delta long")
        self.head = handle.getValueState("head", "flush long, under_way boolean, n_open long, due long")

    def _emit(self, lane: int, flush: int, deltas: dict[str, int]) -> pd.DataFrame:
        return pd.DataFrame({"lane": [lane] * len(deltas), "flush": [flush] * len(deltas), "query": list(deltas), "delta": list(deltas.values())})

    def _step(self, lane: int, now: int, flush: int, under_way: bool, n_open: int, due: int) -> Iterator[pd.DataFrame]:
        """due: when the timer wakes, 0 for none."""
        if n_open and not under_way and (n_open >= self.keys or (due and now >= due)):
            deltas = {k[0]: v[0] for k, v in self.open.iterator()}
            self.sent.clear()
            for q, d in deltas.items():
                self.sent.updateValue((q,), (d,))
            self.open.clear()
            flush, under_way, n_open, due = flush + 1, True, 0, 0
            yield self._emit(lane, flush, deltas)
        elif under_way and due and now >= due:
            yield self._emit(lane, flush, {k[0]: v[0] for k, v in self.sent.iterator()})
            due = 0
        if not n_open and not under_way:
            due = 0  # what comes next has its whole interval
        elif not due:
            due = now + self.interval
            self.handle.registerTimer(due)
        self.head.update((flush, under_way, n_open, due))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        flush, under_way, n_open, due = self.head.get() if self.head.exists() else (0, False, 0, 0)
        counts, acked = Counter(), set()
        for frame in rows:
            counts.update(frame["query"].dropna())
            acked.update(frame["ack"].dropna().astype(int))
        if under_way and flush in acked:
            self.sent.clear()
            under_way = False
        for q, n in counts.items():
            if self.open.containsKey((q,)):
                self.open.updateValue((q,), (self.open.getValue((q,))[0] + n,))
            else:
                self.open.updateValue((q,), (n,))
                n_open += 1
        yield from self._step(key[0], timerValues.getCurrentProcessingTimeInMs(), flush, under_way, n_open, due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.head.exists():
            flush, under_way, n_open, due = self.head.get()
            if due and due <= expiredTimerInfo.getExpiryTimeInMs():
                yield from self._step(key[0], timerValues.getCurrentProcessingTimeInMs(), flush, under_way, n_open, due)


def buffered(submissions: DataFrame, acks: DataFrame, settings: Settings | None = None, lanes: int = 1) -> DataFrame:
    """lane, flush, query, delta of a stream of submissions (query). Queries are dealt to lanes by their hash; a lane's flush comes
    at `batch_max_size` / lanes distinct queries or after the interval. acks: a stream of lane, ack (the flush's number)."""
    s = settings or Settings()
    query = normalize(F.col("query"))
    own = _rocks(submissions).select(F.pmod(F.xxhash64(query), F.lit(lanes)).cast("int").alias("lane"), query.alias("query"), F.lit(None).cast("long").alias("ack")).where("query <> ''")
    words = acks.select(F.col("lane").cast("int"), F.lit(None).cast("string").alias("query"), F.col("ack").cast("long"))
    processor = _Buffer(max(1, s.batch_max_size // lanes), s.batch_flush_interval)
    return own.unionByName(words).groupBy("lane").transformWithStateInPandas(processor, "lane int, flush long, query string, delta long", "append", "processingTime")


class LaneSink:
    """For foreachBatch over `buffered`: each lane's flushes go to a store of its own (root/lane=<k>), and what was applied is
    acknowledged in root/acks. A lane whose store fails is logged and left; its flush comes again, and the next waits for it."""

    ACKS = "lane int, ack long"

    def __init__(self, spark, root: str, lanes: int, checkpoint: str, at: Callable[[], float], settings: Settings | None = None):
        self.spark, self.root, self.checkpoint, self.at = spark, root, checkpoint, at
        self.stores = [Store(spark, f"{root}/lane={k}") for k in range(lanes)]
        self.failures = 0
        spark.createDataFrame([], self.ACKS).write.mode("append").json(f"{root}/acks")

    def acks(self) -> DataFrame:
        return self.spark.readStream.schema(self.ACKS).json(f"{self.root}/acks")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            for lane, flush in sorted(map(tuple, batch.select("lane", "flush").distinct().collect())):  # a flush or two a lane
                try:
                    store = self.stores[lane]
                    store.apply_batch(batch.where((F.col("lane") == lane) & (F.col("flush") == flush)).select("query", "delta"), first_number(store, self.checkpoint) + flush, self.at())
                except Exception:  # noqa: BLE001  the flush stays in the buffer's state
                    self.failures += 1
                    log.exception("flush %s of lane %s failed and is sent again", flush, lane)
                else:
                    self.spark.range(1).select(F.lit(lane).alias("lane"), F.lit(flush).alias("ack")).write.mode("append").json(f"{self.root}/acks")
        finally:
            batch.unpersist()

    def load_all(self) -> DataFrame:
        """Lanes share no query."""
        out = self.stores[0].load_all()
        for store in self.stores[1:]:
            out = out.unionByName(store.load_all())
        return out


def run_until(stream: DataFrame, sink: LaneSink, checkpoint: str, done: Callable[[], bool], seconds: float = 0.2, most: float = 900.0) -> None:
    """Runs `buffered` into its sink, a batch every so many seconds, until done() says so; then the buffer has been flushed as
    far as the caller wants. Fails if that takes more than `most` seconds."""
    query = stream.writeStream.option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").foreachBatch(sink).start()
    try:
        end = time.monotonic() + most
        while not done():
            if query.awaitTermination(1):
                raise RuntimeError("the buffer's query ended by itself")
            if time.monotonic() > end:
                raise TimeoutError(f"not flushed after {most} seconds")
    finally:
        query.stop()

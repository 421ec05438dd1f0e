"""LRU and TTL result caching, replayed over a request log.

A cache node is a sequence: what a request finds depends on all before it. Yet a part of its log can be told without what
came before: requests and sets bring their key to the front whether it is live or not, so the keys that a part has touched lie
before all others, and only the others leave while there are any. `replay` deals each node's log to parts of about `PART`
operations, in order. Each part is told in parallel from an empty cache, as a few rows (`_told`); one pass over these rows,
not over the log, finds what each part begins with (`_begun`); and each part is replayed in parallel from there. A task holds a
part's share of the log and a node's live entries. A key that is asked for in part after part, many times within its time to
live, is told by nearly all its times; so the pass goes in turns of `TURN` parts, and no task sorts more than a turn's rows.
A bare get moves its key only if that is live, so a part is told up to its first get; what follows there is passed on operation
by operation.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import OrderedDict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..settings import Settings
from ..sources.scratch import delete_on_exit, scratch_path, written

SCHEMA = "node string, seq long, op string, key string, t double, hit boolean, evicted boolean, expired boolean, size int"
TOLD = "node string, part int, pos long, op string, key string, t double, limits array<double>, untils array<double>"
BEGUN = "node string, part int, seq long, key string, t double"
COLUMNS = ["node", "part", "pos", "op", "key", "t", "limits", "untils"]
#: Operations in a part.
PART = 1 << 15
#: Parts in a turn.
TURN = 128


class Node:
    """One node's entries: key to expiry, least recently used first."""

    def __init__(self, capacity: int, ttl: float):
        self.capacity, self.ttl = capacity, ttl
        self.entries: OrderedDict[str, float] = OrderedDict()

    def get(self, key: str, now: float) -> tuple[bool, bool]:
        """(hit, expired): an expired entry goes when it is touched."""
        until = self.entries.get(key)
        if until is None:
            return False, False
        if until <= now:
            del self.entries[key]
            return False, True
        self.entries.move_to_end(key)
        return True, False

    def put(self, key: str, now: float) -> tuple[str, float] | None:
        """The entry that had to go."""
        self.entries[key] = now + self.ttl
        self.entries.move_to_end(key)
        return self.entries.popitem(last=False) if len(self.entries) > self.capacity else None

    def invalidate(self, key: str) -> bool:
        return self.entries.pop(key, None) is not None

    def apply(self, op: str, key: str, t: float) -> tuple[bool, bool, bool]:
        """(hit, evicted, expired)"""
        hit = expired = False
        evicted = None
        if op in ("request", "get"):
            hit, expired = self.get(key, t)
        if op == "set" or op == "request" and not hit:
            evicted = self.put(key, t)
        if op == "invalidate":
            hit = self.invalidate(key)
        if op == "clear":
            self.entries.clear()
        return hit, evicted is not None, expired


def expiries(times: list[float], ttl: float) -> tuple[list[float], list[float]]:
    """(limits, untils): after requests at these times an entry that came with an expiry up to a limit, and above the limit
    before, has the until beside it; one above all limits keeps its own."""
    ahead, later = [], []  # times that none between here and them reaches, negated, the nearest last; their untils
    for t in reversed(times):
        if t != t:
            continue  # expires nothing
        i = bisect_right(ahead, -(t + ttl)) - 1
        until = later[i] if i >= 0 else t + ttl
        while ahead and -ahead[-1] <= t:
            ahead.pop()
            later.pop()
        ahead.append(-t)
        later.append(until)
    limits, untils = [], []
    for t, until in zip(reversed(ahead), reversed(later), strict=True):
        if untils and untils[-1] == until:
            limits[-1] = -t
        else:
            limits.append(-t)
            untils.append(until)
    return limits, untils


class Told:
    """A part's operations from an empty cache. Its rows, by pos:

    touch, drop: the first request or set of a key, the first invalidation of one not touched, while entries from before may
      be left; all: a clear. t of each is the most entries that the part had at once since the row before.
    end: t likewise.
    entry: an entry of the part in the end, least recently used first; t is its expiry if the key was not there before, and
      limits and untils tell it from the expiry before, if that matters.
    """

    def __init__(self, capacity: int, ttl: float):
        self.node, self.rows = Node(capacity, ttl), []
        self.seen, self.times = set(), {}  # times: requests of keys whose expiry may come from before
        self.most, self.closed, self.cleared = 0, capacity <= 0, False

    def _row(self, op: str, key: str | None) -> None:
        self.rows.append((op, key, float(self.most), None, None))
        self.most = len(self.node.entries)

    def add(self, op: str, key: str, t: float) -> None:
        if op not in ("request", "set", "invalidate", "clear"):
            return
        entries = self.node.entries
        if op == "clear":
            entries.clear()
            if not self.cleared:
                self._row("all", None)
            self.closed = self.cleared = True
            self.times.clear()
            return
        if not self.closed and key not in self.seen:
            self.seen.add(key)
            self._row("drop" if op == "invalidate" else "touch", key)
            if op == "request":
                self.times[key] = []
        if op == "invalidate" or op == "set":
            self.times.pop(key, None)
        elif key in self.times:
            self.times[key].append(t)
        if op == "invalidate":
            entries.pop(key, None)
            return
        if op == "set" or not self.node.get(key, t)[0]:
            if gone := self.node.put(key, t):
                self.times.pop(gone[0], None)
        self.most = max(self.most, len(entries))
        self.closed = self.closed or len(entries) >= self.node.capacity

    def told(self) -> list[tuple]:
        self._row("end", None)
        for key, until in self.node.entries.items():
            known = key not in self.times
            self.rows.append(("entry", key, until, *((None, None) if known else expiries(self.times[key], self.node.ttl))))
        return self.rows


def _told(rows: DataFrame, capacity: int, ttl: float) -> DataFrame:
    def fold(frames):
        at, part, pos, out = None, None, 0, []

        def put(found):
            nonlocal pos
            for row in found:
                out.append((*at, pos, *row))
                pos += 1

        for frame in frames:
            for node, number, op, key, t in zip(frame["node"], frame["part"], frame["op"], frame["key"], frame["t"], strict=True):
                if (node, number) != at:
                    if part:
                        put(part.told())
                    at, part, pos = (node, number), Told(capacity, ttl), 0
                if op == "get" and part:
                    put(part.told())
                    part = None
                if part:
                    part.add(op, key, t)
                else:
                    put([(op, key, t, None, None)])
            yield pd.DataFrame(out, columns=COLUMNS)
            out.clear()
        if part:
            put(part.told())
        yield pd.DataFrame(out, columns=COLUMNS)

    return rows.mapInPandas(fold, TOLD)


def _begun(told: DataFrame, parts: int, capacity: int, ttl: float) -> DataFrame:
    """The entries with which each part begins, least recently used first. A turn leaves its nodes' entries, as of part -1, to
    the next one."""

    def fold(frames):
        at, node, out = (None, None), None, []
        before, touched = OrderedDict(), {}  # entries that came into the part and are left; those that it has touched

        def leave(most):
            while before and len(before) + most > capacity:
                before.popitem(last=False)

        def begin(name, part):
            out.extend((name, part, i, *entry) for i, entry in enumerate(node.entries.items()))

        for frame in frames:
            for name, part, op, key, t, limits, untils in zip(*(frame[c] for c in ("node", "part", "op", "key", "t", "limits", "untils")), strict=True):
                if (name, part) != at:
                    if node is None or name != at[0]:
                        if node and at[1] >= 0:
                            begin(at[0], -1)
                        node = Node(capacity, ttl)
                    at, before, touched = (name, part), node.entries, {}
                    if part >= 0:
                        begin(name, part)
                if op in ("touch", "drop", "all", "end"):
                    leave(int(t))
                    if op == "all":
                        before.clear()
                    elif op != "end" and key in before:
                        touched[key] = before.pop(key)
                elif op == "left":
                    before[key] = t
                elif op == "entry":
                    if limits is not None and key in touched:
                        i = bisect_left(limits, touched[key]) if touched[key] == touched[key] else len(limits)
                        t = untils[i] if i < len(limits) else touched[key]
                    before[key] = t
                else:
                    node.apply(op, key, t)
            yield pd.DataFrame(out, columns=["node", "part", "seq", "key", "t"])
            out.clear()
        if node and at[1] >= 0:
            begin(at[0], -1)
        yield pd.DataFrame(out, columns=["node", "part", "seq", "key", "t"])

    spark, path = told.sparkSession, scratch_path(told.sparkSession, "begun")
    told = written(told.withColumn("turn", F.floor(F.col("part") / TURN).cast("int")), "told", "turn")
    for turn in range((parts - 1) // TURN + 1):
        rows = told.where(F.col("turn") == turn).drop("turn")
        if turn:
            left = spark.read.schema(BEGUN).parquet(f"{path}/turn={turn - 1}").where("part = -1")
            rows = rows.unionByName(left.withColumnRenamed("seq", "pos").withColumn("op", F.lit("left")), allowMissingColumns=True)
        rows.repartition("node").sortWithinPartitions("node", "part", "pos").mapInPandas(fold, BEGUN).write.parquet(f"{path}/turn={turn}")
    delete_on_exit(spark, path)
    return spark.read.schema(BEGUN).parquet(path).drop("turn").where("part >= 0")


def replay(operations: DataFrame, capacity: int = Settings.cache_capacity_per_node, ttl: float = Settings.cache_ttl_seconds) -> DataFrame:
    """operations: node, seq, op ('request': get, and set on a miss; 'get', 'set', 'invalidate', 'clear'), key, t. Each
    row comes back with what it met: hit, evicted, expired and the number of entries after it."""

    def fold(frames):
        node, at = Node(capacity, ttl), None
        for frame in frames:
            out = []
            for name, part, op, key, t in zip(frame["node"], frame["part"], frame["op"], frame["key"], frame["t"], strict=True):
                if (name, part) != at:
                    node, at = Node(capacity, ttl), (name, part)
                if op == "entry":
                    node.entries[key] = t
                    out.append((False, False, False, 0))
                else:
                    out.append((*node.apply(op, key, t), len(node.entries)))
            met = pd.concat([frame.reset_index(drop=True), pd.DataFrame(out, columns=["hit", "evicted", "expired", "size"])], axis=1)
            yield met[met["op"] != "entry"].drop(columns=["part", "log"])

    operations = operations.select("node", "seq", "op", "key", "t")
    parts = operations.count() // PART + 1
    dealt = operations.repartitionByRange(parts, "node", "seq")
    rows = written(dealt.withColumn("part", F.spark_partition_id()), "log")
    told = _told(rows.repartition(parts, "node", "part").sortWithinPartitions("node", "part", "seq"), capacity, ttl)
    begun = _begun(told, parts, capacity, ttl).withColumn("op", F.lit("entry")).withColumn("log", F.lit(False))
    both = rows.withColumn("log", F.lit(True)).unionByName(begun).repartition(parts, "node", "part").sortWithinPartitions("node", "part", "log", "seq")
    return both.select("node", "seq", "op", "key", "t", "part", "log").mapInPandas(fold, SCHEMA)


def stats(replayed: DataFrame) -> DataFrame:
    """Per node and in total (node null): hits, misses, sets, evictions, expirations, hit_rate (0 without lookups)."""
    lookup = F.col("op").isin("request", "get")
    return (
        replayed.rollup("node")
        .agg(
            F.count_if(lookup & F.col("hit")).alias("hits"),
            F.count_if(lookup & ~F.col("hit")).alias("misses"),
            F.count_if((F.col("op") == "set") | (F.col("op") == "request") & ~F.col("hit")).alias("sets"),
            F.count_if("evicted").alias("evictions"),
            F.count_if("expired").alias("expirations"),
        )
        .withColumn("hit_rate", F.round(F.coalesce(F.try_divide("hits", F.col("hits") + F.col("misses")), F.lit(0.0)), 6))
    )


def live_entries(replayed: DataFrame, now: float, ttl: float = Settings.cache_ttl_seconds) -> DataFrame:
    """key, ttl_remaining of what was last set and neither invalidated since nor evicted by capacity (use on logs without
    evictions): expired entries show 0."""
    sets = (F.col("op") == "set") | (F.col("op") == "request") & ~F.col("hit")
    last = replayed.groupBy("node", "key").agg(F.max(F.when(sets, F.col("seq"))).alias("set_seq"), F.max_by("t", F.when(sets, F.col("seq"))).alias("set_t"), F.max(F.when(F.col("op") == "invalidate", F.col("seq"))).alias("gone"))
    return last.where(F.col("set_seq").isNotNull() & (F.col("gone").isNull() | (F.col("gone") < F.col("set_seq")))).select("node", "key", F.greatest(F.lit(0.0), F.col("set_t") + ttl - F.lit(now)).alias("ttl_remaining"))

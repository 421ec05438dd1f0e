"""Operator 12: how filters interact, over every order in which they can be applied.

The orders form a trie. It is walked depth first: each state is the DataFrame of the rows that survive the filters so far,
made from its parent's and persisted while its subtree is walked, and each edge counts the rows that its filter removes
from it. Which rows survive does not depend on the order of the filters before, so a state is visited once for each set of
filters (2^n in place of n! paths) and its counts serve every path through it; one aggregate of a state counts all edges
that leave it. Counts of a state are written as soon as they are known, by part, with partial sums before the exchange.

Whole texts are read once, to tell which filters each row fails; the walk reads narrow rows. What is equal to an earlier
text is told by a join on the text's SHA-256 with the hashes that occur more than once; both sides of it are written
tables, so Spark can split a hash that very many rows share.

Defined results: a null text is an empty one, a null lang the empty string; an empty text has no words and fails A only
(and E, if repeated); rows without doc_id are parts' rows like others, have no label and neither have nor are an earlier
copy; of rows that share doc_id and text none is earlier; labels that are repeated count once; an empty table gives no
rows; clashing names can't arise, as only the named columns are read.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import scratch_path
from .common import table, written

#: Filters at most: the walk visits 2^n states and reports n! orders.
MOST_FILTERS = 6
WORD_GAP = r"[\x20\x09-\x0D]+"


def edges_of(survivors: DataFrame, filters: list[str], losses: list[str]) -> DataFrame:
    """part, filter, alive, removed and a count of each loss, for every filter that can come next."""
    sums = [F.count("*").alias("alive")]
    for f in filters:
        sums += [F.count_if(f).alias(f"{f}_removed"), *(F.count_if(F.col(f) & F.col(x)).alias(f"{f}_{x}") for x in losses)]
    each = survivors.groupBy("part").agg(*sums)
    rows = F.array(*(F.struct(F.lit(f).alias("filter"), F.col("alive"), F.col(f"{f}_removed").alias("removed"), *(F.col(f"{f}_{x}").alias(x) for x in losses)) for f in filters))
    return each.select("part", F.explode(rows).alias("e")).select("part", "e.*")


def walk(flags: DataFrame, filters: list[str], losses: list[str]) -> DataFrame:
    """flags: part, and for each filter and each loss a boolean column that is never null. Returns state (bits of the filters
    applied before), part, filter, alive, removed and the losses, for all edges of the trie of orders."""
    if not 1 <= len(filters) <= MOST_FILTERS:
        raise ValueError(f"1 to {MOST_FILTERS} filters can be audited")
    spark, path, full, schema = flags.sparkSession, scratch_path(flags.sparkSession, "edges"), (1 << len(filters)) - 1, None
    seen = {full}  # no edge leaves the last state

    def visit(state: int, survivors: DataFrame) -> None:
        nonlocal schema
        seen.add(state)
        survivors = survivors.persist()
        try:
            following = [k for k in range(len(filters)) if not state >> k & 1]
            out = edges_of(survivors, [filters[k] for k in following], losses)
            schema = schema or out.schema
            out.write.mode("overwrite").parquet(f"{path}/state={state}")
            for k in following:
                if state | 1 << k not in seen:
                    visit(state | 1 << k, survivors.where(~F.col(filters[k])))
        finally:
            survivors.unpersist()

    visit(0, flags.select("part", *filters, *losses))
    return spark.read.schema(T.StructType([*schema, T.StructField("state", T.IntegerType())])).parquet(path)


def report(edges: DataFrame, filters: list[str], losses: list[str]) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, the losses (as <name>_lost) and shapley for every part
    and order: each (part, filter) has one row of at most 2^(n-1) states, which its orders look up."""
    n = len(filters)
    bit = {f: 1 << k for k, f in enumerate(filters)}
    # Orders that pass through an edge: those of the filters before it times those after.
    paths = F.create_map(*itertools.chain.from_iterable((F.lit(s), F.lit(math.factorial(s.bit_count()) * math.factorial(n - 1 - s.bit_count()))) for s in range((1 << n) - 1)))
    others = F.create_map(*itertools.chain.from_iterable((F.lit(f), F.lit((1 << n) - 1 - b)) for f, b in bit.items()))
    own = edges.groupBy("part", "filter").agg(
        F.map_from_entries(F.collect_list(F.struct("state", F.struct("alive", "removed", *losses)))).alias("by"),  # one entry a state
        F.sum(F.col("removed") * paths[F.col("state")]).alias("shapley"),
        F.sum(F.when(F.col("state") == 0, F.col("removed"))).alias("failing"),
        F.coalesce(F.sum(F.when(F.col("state") == others[F.col("filter")], F.col("removed"))), F.lit(0)).alias("unique_fails"),
    )
    orders = []
    for order in itertools.permutations(filters):
        state = 0
        for step, f in enumerate(order, 1):
            orders.append((f, "".join(order), step, state))
            state |= bit[f]
    # n! * n rows, at most 4320.
    plan = edges.sparkSession.createDataFrame(orders, "filter string, filter_order string, step int, state int")
    at = F.try_element_at("by", F.col("state"))
    value = lambda name: F.coalesce(at[name], F.lit(0))
    return own.join(F.broadcast(plan), "filter").select(
        "part",
        "filter_order",
        "step",
        (value("alive") - value("removed")).alias("kept"),
        value("removed").alias("removed"),
        (F.col("failing") - value("removed")).alias("redundant"),
        "unique_fails",
        *(value(x).alias(f"{x}_lost") for x in losses),
        "shapley",
    )


def audit(flags: DataFrame, filters: list[str], losses: list[str]) -> DataFrame:
    """The report of the filters over all orders. flags as for `walk`; it should be a written table, as it is read twice if
    an executor is lost."""
    return report(walk(flags, filters, losses), filters, losses)


def failures() -> dict[str, Column]:
    """The filters that look at a text alone: too few words, repeated words, capitals, marks."""
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(text, WORD_GAP), lambda w: w != "")
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": F.size(words) < 100,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * 80,
        "C": capitals * 100 > F.length(text) * 10,
        "D": text.rlike("[#$%&*|]"),
    }


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, good, toxic and the failures A to E of each row of docs, as a written table."""
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long"), F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("hash"), *(c.alias(f) for f, c in failures().items()))
    own = written(spark, own, "failures")
    copies = own.groupBy("hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1").select("hash", "first")
    marks = labels.where("doc_id IS NOT NULL AND (quality = 1 OR toxic = 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.bool_or(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.bool_or(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    rows = own.join(written(spark, copies, "copies"), "hash", "left").join(written(spark, marks, "marks"), "doc_id", "left")
    no = F.lit(False)
    return written(spark, rows.select("part", "A", "B", "C", "D", F.coalesce(F.col("doc_id") > F.col("first"), no).alias("E"), F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic")), "flags")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(flagged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")), list("ABCDE"), ["good", "toxic"])


OP12_SQL = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
f AS (SELECT part, (len(ws) < 100)::INT + 2 * (100 * len(list_distinct(ws)) < 80 * len(ws))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t))::INT
  + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM w LEFT JOIN l USING (doc_id)),
m AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM f GROUP BY 1, 2),
b AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(f, bit)),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM b a, b b, b c, b d, b e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (SELECT filter_order, CAST(k AS INT) AS step, bits[k] AS bit, CAST(coalesce(list_sum(bits[1:k - 1]), 0) AS INT) AS before FROM o, range(1, 6) r(k)),
c AS (SELECT part, filter_order, step, bit, sum(n) FILTER (fails & (before | bit) = 0) AS kept, sum(n) FILTER (fails & before = 0 AND fails & bit > 0) AS removed,
  sum(n) FILTER (fails & before > 0 AND fails & bit > 0) AS redundant, sum(n) FILTER (fails = bit) AS unique_fails,
  sum(g) FILTER (fails & before = 0 AND fails & bit > 0) AS good_lost, sum(x) FILTER (fails & before = 0 AND fails & bit > 0) AS toxic_lost FROM m, s GROUP BY ALL)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, coalesce(sum(removed) OVER (PARTITION BY part, bit), 0)::BIGINT AS shapley FROM c"""

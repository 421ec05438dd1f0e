"""Query-count corpora: tab-separated files, documents, and a generator."""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scores import zipf_count
from ..functions.text import TOKEN, is_clean, normalize
from .scratch import written


def read_tsv(spark: SparkSession, *paths: str) -> DataFrame:
    """query, count of lines `query<TAB>count`: exactly two fields, a clean query, a positive integer; others are dropped."""
    fields = F.split("value", "\t", -1)
    number = F.trim(fields[1])
    rows = spark.read.text(list(paths)).where(F.size(fields) == 2).select(normalize(fields[0]).alias("query"), F.when(number.rlike("^[+-]?[0-9]+$"), number.try_cast("bigint")).alias("count"))
    return rows.where(is_clean(F.col("query")) & (F.col("count") > 0))


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def load_corpus(spark: SparkSession, unigrams: str, bigrams: str | None = None, limit: int = 300_000) -> DataFrame:
    """The files' rows, the largest count of each query, the `limit` most frequent. The first file must exist."""
    if not exists(spark, unigrams):
        raise FileNotFoundError(unigrams)
    paths = [unigrams, *([bigrams] if bigrams and exists(spark, bigrams) else [])]
    return top(max_merge(read_tsv(spark, *paths)), limit)


def auto(spark: SparkSession, unigrams: str, bigrams: str | None, vocabulary: tuple[DataFrame, DataFrame], limit: int = 300_000) -> DataFrame:
    """The files if they are there, else the generator over (heads, modifiers)."""
    return load_corpus(spark, unigrams, bigrams, limit) if exists(spark, unigrams) else synthetic(*vocabulary, limit=limit)


def max_merge(rows: DataFrame) -> DataFrame:
    return rows.groupBy("query").agg(F.max("count").alias("count"))


def last_wins(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    return rows.groupBy(key).agg(F.max_by(value, order).alias(value))


#: Up to so many rows each task may send its own best ones to one task.
FEW = 1000


def top(counts: DataFrame, n: int) -> DataFrame:
    """The n most frequent, ties by query. Beyond a FEW no task gets more than its share: rows are written and the different
    counts numbered (m of them stand for m^2 / 2 words at least) to find the count at which the n-th row lies; what is not
    below it is dealt to ranges in order, and only the range in which the n-th row lies is numbered."""
    order = [F.col("count").desc(), F.col("query")]
    if n <= FEW:
        return counts.orderBy(*order).limit(n)
    rows = written(counts, "counted")
    by_count = Window.partitionBy(F.lit(0)).orderBy(F.col("count").desc())
    sizes = rows.groupBy("count").agg(F.count("*").alias("held")).withColumn("upto", F.sum("held").over(by_count))
    least = sizes.where(F.col("upto") >= n).agg(F.max("count")).first()[0]
    if least is None:  # there are fewer
        return rows.orderBy(*order)
    ranges = written(rows.where(F.col("count") >= least).repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(F.lit(0)).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    sums = ranges.groupBy("range").agg(F.count("*").alias("held")).withColumn("base", F.coalesce(F.sum("held").over(before), F.lit(0)))
    room = sums.where(F.col("base") < n).select("range", (F.col("base") + F.col("held") <= n).alias("whole"), (F.lit(n) - F.col("base")).alias("room"))
    full, cut = room.where("whole").select("range"), room.where("NOT whole").select("range", "room")
    last = ranges.join(F.broadcast(cut), "range").withColumn("place", F.row_number().over(Window.partitionBy("range").orderBy(*order)))
    kept = ranges.join(F.broadcast(full), "range").unionByName(last.where(F.col("place") <= F.col("room")), allowMissingColumns=True)
    return kept.select(*counts.columns).orderBy(*order)


#: Different queries and words that a task holds before it sends them on.
HELD = 1 << 17
CLEAN_WORD = re.compile(TOKEN[1:-1]).fullmatch


def word_counts(docs: DataFrame, *sizes: int) -> DataFrame:
    """query, count of the runs of `sizes` clean words in the texts. Texts are read once: tasks count the runs of some texts
    at a time, Spark sums them by query."""

    def count(batches):
        schema = pa.schema([("query", pa.string()), ("count", pa.int64())])
        clean, found = Clean(), Counter()

        def held():
            return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], schema=schema)

        for batch in batches:
            for text in batch.column(0):
                w = [clean[x] for x in (text.as_py() or "").lower().split()]
                for n in sizes:
                    found.update(filter(None, w) if n == 1 else [" ".join(run) for run in zip(*(w[i:] for i in range(n)), strict=False) if None not in run])
                if len(found) > HELD:
                    yield held()
                    found.clear()
        yield held()

    return docs.select(F.make_valid_utf8("text").alias("text")).mapInArrow(count, "query string, count long").groupBy("query").agg(F.sum("count").alias("count"))


class Clean(dict):
    """word: itself if it is clean, else None. Words are looked at once while they are held."""

    def __missing__(self, word: str) -> str | None:
        if len(self) > HELD:
            self.clear()
        self[word] = found = word if CLEAN_WORD(word) else None
        return found


def unigrams(docs: DataFrame) -> DataFrame:
    """query, count of the clean words of the texts."""
    return word_counts(docs, 1)


def bigrams(docs: DataFrame) -> DataFrame:
    """query, count of neighbouring clean words."""
    return word_counts(docs, 2)


def synthetic(heads: DataFrame, modifiers: DataFrame, limit: int = 300_000, seed: int | None = None) -> DataFrame:
    """query, count: heads; head modifier; head head; head head modifier, in this order, each query at its first place,
    with Zipf counts by place (jittered by at most a tenth if there is a seed). heads: (head, pos), modifiers: (modifier,
    pos). The vocabulary is small by design, and only `limit` rows of the order are numbered."""
    h, m = heads.select("head", F.col("pos").alias("a")), modifiers.select("modifier", F.col("pos").alias("c"))
    h2 = heads.select(F.col("head").alias("other"), F.col("pos").alias("b"))
    none = F.lit(0)
    pairs = h.crossJoin(h2).where("head <> other")
    rows = h.select(F.col("head").alias("query"), F.struct(F.lit(1).alias("kind"), "a", none.alias("b"), none.alias("c")).alias("place"))
    rows = rows.unionByName(h.crossJoin(m).select(F.concat_ws(" ", "head", "modifier").alias("query"), F.struct(F.lit(2).alias("kind"), "a", none.alias("b"), "c").alias("place")))
    rows = rows.unionByName(pairs.select(F.concat_ws(" ", "head", "other").alias("query"), F.struct(F.lit(3).alias("kind"), "a", "b", none.alias("c")).alias("place")))
    rows = rows.unionByName(pairs.crossJoin(m).select(F.concat_ws(" ", "head", "other", "modifier").alias("query"), F.struct(F.lit(4).alias("kind"), "a", "b", "c").alias("place")))
    first = rows.groupBy("query").agg(F.min("place").alias("place")).orderBy("place", "query").limit(limit)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("place", "query")))
    jitter = None if seed is None else F.lit(0.9) + F.pmod(F.xxhash64("query", F.lit(seed)), F.lit(1_000_000)) / F.lit(5e6)
    return ranked.select("query", zipf_count(F.col("rank"), jitter=jitter).alias("count"))


def summary(counts: DataFrame) -> DataFrame:
    """queries, multi_word, single_word, smallest, largest."""
    spaced = F.instr("query", " ") > 0
    return counts.agg(F.count("*").alias("queries"), F.count_if(spaced).alias("multi_word"), F.count_if(~spaced).alias("single_word"), F.min("count").alias("smallest"), F.max("count").alias("largest"))


def top_ten(counts: DataFrame) -> DataFrame:
    return top(counts.select("query", "count"), 10)


def prefix_pool(queries: DataFrame, order: str, size: int = 800) -> DataFrame:
    """prefix: the letters and prefixes of two to four characters of the queries (how many follows from `order`), distinct,
    the first `size` by code points."""
    letters = queries.sparkSession.range(26).select(F.char(F.col("id") + 97).alias("prefix"))
    cut = queries.select(F.substring("query", F.lit(1), (F.lit(2) + F.pmod(F.col(order), F.lit(3))).cast("int")).alias("prefix"))
    return letters.unionByName(cut).where("prefix <> ''").distinct().orderBy("prefix").limit(size)


def zipf_weights(items: DataFrame, order: str, exponent: float = 1.1) -> DataFrame:
    """item rank, weight and the cumulative share at which weighted sampling cuts."""
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(order))  # a pool of prefixes, small by design
    weighted = items.withColumn("rank", rank).withColumn("weight", F.pow(F.col("rank").cast("double"), F.lit(-exponent)))
    running = Window.partitionBy(F.lit(0)).orderBy("rank")
    total = F.sum("weight").over(Window.partitionBy(F.lit(0)))
    return weighted.withColumn("share", F.round(F.sum("weight").over(running) / total, 6)).withColumn("weight", F.round("weight", 6))


#: Slices of the unit interval by which draws meet the items.
SLICES = 1024


def zipf_sample(weighted: DataFrame, item: str, draws: int) -> DataFrame:
    """draw, item of so many weighted draws from `zipf_weights` rows: draw i falls at the fractional part of i times the golden
    ratio's inverse (to 32 bits), which spreads evenly. Items are listed under the slices that they cover: an equi join."""
    at = (F.pmod(F.col("id") * F.lit(2654435769), F.lit(1 << 32)) + F.lit(0.5)) / F.lit(float(1 << 32))
    drawn = weighted.sparkSession.range(draws).select(F.col("id").alias("draw"), at.alias("at")).withColumn("slice", F.floor(F.col("at") * SLICES).cast("int"))
    low = F.coalesce(F.lag("share").over(Window.partitionBy(F.lit(0)).orderBy("rank")), F.lit(0.0))
    spans = weighted.select(item, "share", low.alias("low")).where("low < share")
    last = F.least(F.floor(F.col("share") * SLICES).cast("int"), F.lit(SLICES - 1))
    spans = spans.withColumn("slice", F.explode(F.sequence(F.floor(F.col("low") * SLICES).cast("int"), last)))
    return drawn.join(spans, "slice").where((F.col("at") >= F.col("low")) & (F.col("at") < F.col("share"))).select("draw", item)

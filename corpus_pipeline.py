"""The corpus pipeline: five operators in a row over `documents`.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns of documents (the last: packed pieces); it
works on all that the stage before kept. n_chars follows the text where a stage changes it.

Defined results, each as its operator's module states it: a null or empty text is kept by the first stage (it has no word to
judge), is one empty line, is a near duplicate of empty texts alone, holds no personal data, and is packed as its end id;
texts of any length are judged, split, compared, searched and packed whole; of rows with equal texts, repeated rows among
them, the least doc_id stays, of those with one doc_id any one; rows without doc_id are kept like others, and count as
smaller than any with one where lines are dropped; an empty table gives none; further columns go through the first four
stages unchanged, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefixory.llm import lines, minhash, packing, pii, quality
from prefixory.llm.common import prepare, table, written


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast("long"))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is within their language's threshold."""
    prepare(spark)
    return quality.filtered(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that at least five hold, but for the largest doc_id."""
    prepare(spark)
    return _counted(lines.dedup_lines(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that of the least doc_id."""
    prepare(spark)
    return minhash.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    prepare(spark)
    return _counted(pii.redacted(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences of 2048 tokens."""
    import public_tokenizers

    prepare(spark)
    return packing.pack(packing.tokenised(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("personal data", personal_data),
    ("packing", best_fit_packing),
]

#: The first and the last stage are a trained model and a tokenizer, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(spark, stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

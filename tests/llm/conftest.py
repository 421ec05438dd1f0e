import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def make(spark):
    """A documents table from (doc_id, text) or (doc_id, text, lang); more columns clash with names inside the operators."""

    def documents(rows, extra=False):
        rows = [(*r, "en")[:3] if len(r) < 3 else r for r in rows]
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("source", F.lit("s")).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long"))
        if extra:
            for name in ("shard", "slot", "bucket", "rank", "h1", "h2", "node", "label", "key", "gone", "_ppl2", "c0", "batch", "length", "_id", "_node", "_own", "_h1", "_h2", "_row_hash", "_gone_id", "_lang", "_text", "_ppl", "judged", "row", "rid", "_hg_key"):
                df = df.withColumn(name, F.lit("x"))
        return df

    return documents


#: Nulls, empty and blank texts, a long text, repeated rows, equal texts, a null id.
HARD = [
    (1, None),
    (2, ""),
    (3, " \n\t \n"),
    (4, "word " * 30_000),
    (5, "same text here"),
    (5, "same text here"),
    (6, "same text here"),
    (None, "no id at all"),
    (7, "é😀 ñandú\x00\x1f end"),
]


@pytest.fixture(scope="session")
def hard(make):
    return make(HARD, extra=True)

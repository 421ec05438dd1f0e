"""Operator 11: fill-in-middle transformation of documents.

A text becomes a UTF-32 code-point array. Each code point has a class (the unit's: itself, its word class, its line);
where the classes of neighbours differ a unit begins, so flatnonzero of the comparison gives all boundaries at once. Two
ranks drawn from a hash of the doc_id index the boundaries, the array is sliced there and the pieces are encoded again.
Rows are mapped one by one without a shuffle; what is drawn depends on seed and doc_id alone, so a repeated task gives
the same rows.

Defined results: a null text is an empty one; an empty text, and one that holds a sentinel, stays plain; a text of any
length is cut as a whole; a null doc_id draws as the empty string in place of its number; repeated rows and equal
doc_ids are transformed each; an empty table gives no rows; other columns are not read, so their names can't clash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepared, record, table, texts

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNITS = ("code_point", "word", "line")
_OUT = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])


def classes(codes: np.ndarray, unit: str) -> np.ndarray:
    """A number for each code point; a unit is a longest run of equal ones."""
    if unit == "code_point":
        return np.arange(len(codes), dtype=np.int32)
    if unit == "line":  # the line end belongs to its line
        return np.cumsum(np.concatenate(([False], codes[:-1] == 10)), dtype=np.int32) if len(codes) else np.zeros(0, np.int32)
    own, back = np.unique(codes, return_inverse=True)
    kind = np.array([0 if chr(c).isspace() else 1 if chr(c).isalnum() else 2 for c in own], np.int32)
    return kind[back] if len(own) else kind


def boundaries(codes: np.ndarray, unit: str) -> np.ndarray:
    """The places where units begin, and the end."""
    if not len(codes):
        return np.zeros(1, np.int64)
    kind = classes(codes, unit)
    return np.concatenate(([0], np.flatnonzero(kind[1:] != kind[:-1]) + 1, [len(codes)]))


def draws(seed: int, doc_id: int | None) -> list[int]:
    """Four unsigned 32-bit numbers."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return np.frombuffer(digest[:16], ">u4").tolist()


def cut(text: str, h: list[int], unit: str, percent: int, spm_percent: int) -> tuple[int, str, int | None, int | None, str]:
    """Units, form, code points of prefix and middle, and the output."""
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
    marks = boundaries(codes, unit)
    n = len(marks) - 1
    if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or h[2] % 100 >= percent:
        return n, "plain", None, None, text
    a, b = marks[sorted((h[0] % (n + 1), h[1] % (n + 1)))].tolist()
    prefix, middle, suffix = (codes[i:j].tobytes().decode("utf-32-le") for i, j in ((0, a), (a, b), (b, len(codes))))
    if h[3] % 100 < spm_percent:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


@prepared
def fill_in_middle(docs: DataFrame, unit: str = "code_point", percent: int = 90, spm_percent: int = 20, seed: int = 1) -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars (code points) and output. percent of the
    documents are cut, spm_percent of these have the suffix first."""
    if unit not in UNITS:
        raise ValueError(f"unit is one of {UNITS}")

    def run(batches):
        for batch in batches:
            rows = [cut(t, draws(seed, i), unit, percent, spm_percent) for i, t in zip(batch.column("doc_id").to_pylist(), texts(batch), strict=True)]
            n, form, before, middle, output = zip(*rows, strict=True) if rows else [()] * 5
            yield record(_OUT, doc_id=batch.column("doc_id"), n=n, form=form, prefix_chars=before, middle_chars=middle, output=output)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. The text holds no sentinel, and none can arise where pieces meet one, so the
    first of each kind is the one that was put in."""

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        """What follows each of the three sentinels."""
        at = F.locate(second, output)
        end = F.call_function("locate", F.lit(MIDDLE), output, at + len(second))
        return F.substr(output, F.lit(len(first) + 1), at - len(first) - 1), F.substr(output, at + len(second), end - at - len(second)), F.substr(output, end + len(MIDDLE))

    prefix, suffix, middle = parts(PREFIX, SUFFIX)
    last, head, mid = parts(SUFFIX, PREFIX)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(head, mid, last)).otherwise(output)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


OP11_SQL = """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
x AS (SELECT doc_id, t, length(t) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
  CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM x),
p AS (SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
sha256(t) AS restored_sha256 FROM p"""

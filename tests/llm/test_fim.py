import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from prefixory.llm import fim

from ..oracle import differing
from .conftest import HARD


def plainly(doc_id, text):
    """The contract's transformation in plain Python."""
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_sql(spark, sf):
    assert differing(fim.op11_fill_in_middle(spark, sf), fim.OP11_SQL, sf) == []


def test_hard_rows(make):
    rows = [*HARD, *((i, f"x<{'PSM'[i % 3]}>y {i}") for i in range(10, 40)), *((i, f"a<b>< <P <S >M> é😀 {i}") for i in range(40, 80))]
    docs = make(rows, extra=True).withColumn("output", F.lit("clash")).withColumn("form", F.lit(1))
    got = fim.fill_in_middle(docs).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=key) == sorted(((i, *plainly(i, t)) for i, t in rows), key=key)
    assert sorted(r.back for r in got) == sorted(t or "" for _, t in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(make([])).count() == 0


@pytest.mark.parametrize("unit", fim.UNITS)
def test_units(make, unit):
    docs = make([(i, f"One two,  three{i}!\nline two\n\nend é😀") for i in range(60)])
    got = fim.fill_in_middle(docs, unit, 100, 50).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    for r in got:
        text = f"One two,  three{r.doc_id}!\nline two\n\nend é😀"
        assert r.back == text and r.form != "plain"
        marks = fim.boundaries(np.frombuffer(text.encode("utf-32-le"), "<u4"), unit).tolist()
        assert r.n == len(marks) - 1 and r.prefix_chars in marks and r.prefix_chars + r.middle_chars in marks
    with pytest.raises(ValueError):
        fim.fill_in_middle(docs, "byte")


def test_boundaries():
    codes = lambda t: np.frombuffer(t.encode("utf-32-le"), "<u4")
    assert fim.boundaries(codes("ab  c,d"), "word").tolist() == [0, 2, 4, 5, 6, 7]
    assert fim.boundaries(codes("a\n\nb"), "line").tolist() == [0, 2, 3, 4]
    assert fim.boundaries(codes("a\n"), "line").tolist() == [0, 2]
    assert fim.boundaries(codes("é😀"), "code_point").tolist() == [0, 1, 2]
    assert [fim.boundaries(codes(""), u).tolist() for u in fim.UNITS] == [[0]] * 3


@given(st.text(max_size=40), st.integers(0, 10**12), st.sampled_from(fim.UNITS))
@settings(max_examples=200, deadline=None)
def test_pieces_are_the_text(text, doc_id, unit):
    n, form, a, m, output = fim.cut(text, fim.draws(1, doc_id), unit, 90, 20)
    if form == "plain":
        assert output == text
    else:
        assert output.replace("<P>", "", 1).replace("<S>", "", 1).replace("<M>", "", 1).__len__() == len(text)
        assert output.split("<M>")[-1] == text[a : a + m]

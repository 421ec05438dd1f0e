"""run() against the same stages worked out plainly."""

import re
from collections import defaultdict

import pytest

import corpus_pipeline
from prefixory.llm import pii, quality
from prefixory.llm.common import table, written

from .test_lines import brute as plain_lines
from .test_minhash import brute as plain_classes
from .test_packing import check as check_packing

SF = "/root/testdata/sf0.01"


def test_stages_equal_plain_versions(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    outputs = []
    for name, stage in corpus_pipeline.STAGES:
        docs = written(spark, stage(spark, docs, SF), name.replace(" ", "-"))
        outputs.append(docs)
        if name != "packing":
            assert docs.columns == columns
    good, deduped, unique, private, packed = [[tuple(r) for r in df.collect()] for df in outputs]
    text_of = lambda rows: {r[0]: r[1] for r in rows}
    # 1: what the thresholds say
    scores, _, limits = quality.judged(table(spark, SF, "documents"), table(spark, SF, "labels"))
    keep = {r.doc_id for r in scores.collect() if r["_ppl"] is None or limits.get(r["_lang"]) is None or r["_ppl"] <= limits[r["_lang"]]}
    assert set(text_of(good)) == keep
    # 2: the lines left
    assert text_of(deduped) == {i: t for i, _, _, t in plain_lines(list(text_of(good).items()))}
    # 3: one of each class
    rows = list(text_of(deduped).items())
    assert {str(i) for i in text_of(unique)} == {c for _, c in plain_classes(rows)}
    # 4: no base span is left but inside what replaced it
    before, after = text_of(unique), text_of(private)
    assert before.keys() == after.keys()
    for i, t in after.items():
        assert not pii.base_spans(re.sub(r"<[A-Z]+>", " ", t))
        if not pii.candidates(before[i], pii.base_spans(before[i])):
            assert t == before[i]
    assert all(r[4] == len(r[1] or "") for r in private)
    # 5: all pieces of all documents
    pieces = outputs[4].collect()
    check_packing(pieces, list(after.items()))
    assert len(packed) == len(pieces)
    # and the whole at once
    by = defaultdict(int)
    for r in corpus_pipeline.run(spark, SF).collect():
        by[r.doc_id] += r.length
    own = defaultdict(int)
    for r in pieces:
        own[r.doc_id] += r.length
    assert by == own


@pytest.mark.parametrize("stage", range(5))
def test_empty_table(spark, stage):
    docs = table(spark, SF, "documents").where("false")
    assert corpus_pipeline.STAGES[stage][1](spark, docs, SF).count() == 0


def test_hard_rows(spark, make):
    """Nulls, empty and very long texts, repeated rows, ties, a null id and clashing names through all stages."""
    from .conftest import HARD

    long = "a line that many of these documents hold, of more than forty code points"
    words = " ".join(f"word{i}" for i in range(40))
    rows = [*HARD, *((100 + i, f"{long}\nown text number {i} of this document") for i in range(6)), (200, words), (201, words), (202, words + " more"), (300, "write to a.b@example.org now")]
    docs = make(rows, extra=True)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(spark, stage(spark, docs, SF), name.replace(" ", "-"))
        assert docs.columns == columns
        assert all(r.shard == "x" and r.judged == "x" for r in docs.collect())
        if name == "line dedup":
            assert {r.doc_id for r in docs.collect() if long in (r.text or "")} == {105}
            assert docs.count() == len(rows)
    left = docs.collect()
    ids = [r.doc_id for r in left]
    assert {4, 7, None, *range(100, 106), 200, 300} <= set(ids) and len(ids) == len(set(ids))
    assert not {201, 202, 6} & set(ids) and 5 in ids
    assert len({1, 2, 3} & set(ids)) >= 1  # empty texts are one class
    mail = next(r.text for r in left if r.doc_id == 300)
    assert "example.org" not in mail and mail.startswith("write to ")
    check_packing(corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect(), [(r.doc_id, r.text) for r in left])

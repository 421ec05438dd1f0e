import itertools
import re

import pytest
from pyspark.sql import functions as F

from prefixory.llm import audit

from ..oracle import differing

WORDS = " ".join(f"w{i}" for i in range(120))


def brute(docs, labels):
    """Rows (part, order, step, ...) by applying each order to the rows, one after another."""
    rows = []
    for i, t, lang in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        earlier = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs)
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": earlier}
        own = [x for x in labels if x[0] == i and i is not None]
        rows.append((lang or "", fails, any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    out = {}
    for part in {r[0] for r in rows}:
        for order in itertools.permutations("ABCDE"):
            left, gone = [r for r in rows if r[0] == part], []
            for step, f in enumerate(order, 1):
                removed = [r for r in left if r[1][f]]
                redundant = sum(r[1][f] for r in gone)
                left = [r for r in left if not r[1][f]]
                gone += removed
                unique = sum(r[0] == part and [k for k in r[1] if r[1][k]] == [f] for r in rows)
                out[part, "".join(order), step] = [len(left), len(removed), redundant, unique, sum(r[2] for r in removed), sum(r[3] for r in removed)]
    shapley = {}
    for (part, order, step), v in out.items():
        shapley[part, order[step - 1]] = shapley.get((part, order[step - 1]), 0) + v[1]
    return sorted((p, o, s, *v, shapley[p, o[s - 1]]) for (p, o, s), v in out.items())


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_sql(spark, sf):
    assert differing(audit.op12_filter_audit(spark, sf), audit.OP12_SQL, sf) == []


def test_hard_rows_and_brute_force(spark):
    docs = [
        (1, None, "en"), (2, "", "en"), (3, " \n\t", None), (4, "word " * 5000, "en"), (5, WORDS, "en"), (5, WORDS, "en"), (6, WORDS, "de"), (7, WORDS + " #", "en"),
        (8, WORDS.upper(), ""), (None, WORDS, "en"), (9, WORDS + " A" * 40 + "$", "de"), (10, "a b", None), (11, "a b", "en"), (12, WORDS + "\x0b\x0cz", "en"), (13, "Ü" * 50, "en"),
    ]
    labels = [(5, 1, 0), (5, 1, 1), (4, 0, 1), (6, 1, None), (None, 1, 1), (8, None, 1), (99, 1, 1), (9, 1, 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumns({c: F.lit("x") for c in ("part", "hash", "first", "n", "A", "good", "state")})
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("good", F.lit("x"))
    out = audit.audit(audit.flagged(df, marks), list("ABCDE"), ["good", "toxic"])
    assert out.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, out.collect())) == brute(docs, labels)
    none = audit.flagged(df.limit(0), marks)
    assert audit.audit(none, list("ABCDE"), ["good", "toxic"]).count() == 0


def test_states_are_visited_once_and_released(spark, monkeypatch):
    flags = spark.createDataFrame([("p", True, False, True), ("p", False, True, True), ("q", False, False, False)], "part string, X boolean, Y boolean, Z boolean")
    seen = []
    edges_of = audit.edges_of
    monkeypatch.setattr(audit, "edges_of", lambda df, filters, losses: seen.append(tuple(filters)) or edges_of(df, filters, losses))
    rows = audit.walk(flags, ["X", "Y", "Z"], []).collect()
    assert len(seen) == len(set(seen)) == 7
    assert seen[:3] == [("X", "Y", "Z"), ("Y", "Z"), ("Z",)]  # depth first
    assert {(r.state, r.filter): r.removed for r in rows if r.part == "p"} == {(0, "X"): 1, (0, "Y"): 1, (0, "Z"): 2, (1, "Y"): 1, (1, "Z"): 1, (2, "X"): 1, (2, "Z"): 1}
    assert not spark.sparkContext._jsc.getPersistentRDDs()
    with pytest.raises(ValueError):
        audit.walk(flags, list("ABCDEFG"), [])

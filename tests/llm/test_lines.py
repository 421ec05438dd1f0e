from collections import defaultdict

from pyspark.sql import functions as F

from prefixory.llm import lines

from ..oracle import differing

LONG = "this line has more than forty code points in it"


def brute(rows):
    """doc rows (doc_id, text) to (doc_id, n_lines, n_dropped, kept)."""
    strip = " \t\n\x0b\x0c\r"
    holders = defaultdict(list)
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    keyed = [(i, (t or "").split("\n")) for i, t in rows]
    for n, (i, ls) in enumerate(keyed):
        for k in {x.strip(strip).translate(lower) for x in ls}:
            if len(k) >= 40:
                holders[k].append((n, i))
    out = []
    for i, ls in keyed:
        kept = []
        for x in ls:
            h = holders.get(x.strip(strip).translate(lower), [])
            last = max((j for _, j in h if j is not None), default=None)
            gone = len(h) >= 5 and last is not None and (i is None or i < last)
            if not gone:
                kept.append(x)
        out.append((i, len(ls), len(ls) - len(kept), "\n".join(kept)))
    return out


def test_sql(spark):
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        assert differing(lines.op8_lines(spark, sf), lines.OP8_SQL, sf) == []


def test_hard_rows_and_brute_force(make, hard):
    from .conftest import HARD

    rows = [*HARD, *((i, f"a{i}\n {LONG.upper()} \n{LONG}\nend") for i in range(10, 17)), (None, LONG), (16, LONG), (3, "ü" * 40), *((i, "ü" * 40) for i in range(20, 24)), *((i, "ü" * 39) for i in range(20, 26))]
    df = make(rows, extra=True)
    out = lines.dedup_lines(df)
    assert out.columns == df.columns
    got = sorted((str(r.doc_id), r.text or "") for r in out.collect())
    assert got == sorted((str(i), kept) for i, _, _, kept in brute(rows))
    assert lines.dedup_lines(make([])).count() == 0


def test_clashing_names(spark):
    rows = [(i, f"{LONG}\nown {i}", "x", 1, "y", i) for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _h1 string, _row_hash int, c0 string, _gone_id long").withColumn("_h2", F.lit(1)).withColumn("_gone_hash", F.lit("z"))
    out = lines.dedup_lines(df)
    assert out.columns == df.columns
    assert sorted(tuple(r)[2:] for r in out.collect()) == sorted(tuple(r)[2:] for r in df.collect())
    assert {r.doc_id: r.text for r in out.collect()} == {i: (f"{LONG}\n" if i == 7 else "") + f"own {i}" for i in range(8)}


def test_runs_are_compacted_and_decide_what_repeats(spark, make):
    runs = lines.LineRuns(spark, fanout=2, buckets=3)
    repeats = []
    for b in range(4):  # by falling doc_id
        docs = make([(90 - b * 10 - i, f"{LONG} {b if i else 'everywhere'} {i % 3}") for i in range(5)])
        repeats.append(sorted(r.doc_id for r in runs.add(lines.line_hashes(docs)).collect()))
    # In each batch lines 1 and 4 are equal; after the first, 'everywhere' is held by a larger doc_id too.
    assert repeats == [[86], [76, 80], [66, 70], [56, 60]]
    assert [len(level) for level in runs.levels] == [0, 0, 1]
    assert runs.runs[0].files.count() == 13
    assert runs.frequent(4).count() == 1
    seen = lines.line_hashes(make([(9, f"{LONG} everywhere 0\n{LONG} never before")]))
    assert runs.unseen(seen).count() == 1
    runs.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run")]

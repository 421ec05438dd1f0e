"""A query's rows against the SQL's on the same tables."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def differing(df, sql, sf):
    """Rows of one side only; columns are compared by name."""
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    right = con.sql(sql)
    names = sorted(df.columns)
    assert names == sorted(right.columns)
    at = [right.columns.index(n) for n in names]
    a = sorted(repr([plain(r[n]) for n in names]) for r in df.collect())
    b = sorted(repr([plain(r[i]) for i in at]) for r in right.fetchall())
    assert len(a) == len(b)
    return [x for x, y in zip(a, b, strict=True) if x != y]

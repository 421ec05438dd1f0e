import pytest

from prefixory.plans.queries import QUERIES, SQL

from .oracle import differing

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    assert differing(QUERIES[name](spark, SF), SQL[name], SF) == []


def test_invalidation_equals_plain_simulation(spark):
    from collections import OrderedDict

    rows = QUERIES["cache_invalidation"](spark, SF).orderBy("node", "seq").collect()
    entries, node = OrderedDict(), None
    for r in rows:
        if r.node != node:
            entries, node = OrderedDict(), r.node
        live = r.key in entries and entries[r.key] > r.t
        if r.op == "invalidate":
            assert r.hit == (entries.pop(r.key, None) is not None)
        else:
            if r.op == "request":
                assert r.hit == live
                assert r.expired == (r.key in entries and not live)
            if not live:
                entries.pop(r.key, None) if r.op == "request" else None
            if r.op == "set" or not live:
                entries[r.key] = r.t + 21600.0
            entries.move_to_end(r.key)
            if len(entries) > 12:
                entries.popitem(last=False)
        assert r.size == len(entries)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

import datetime as dt

from tamarack.operators import orphans as o

AT = dt.datetime(2024, 5, 1)


def _refs(spark, rows):
    return spark.createDataFrame([("t", "f", i, r, a, "p") for i, r, a in rows], "tab string, field string, row_id long, ref long, at timestamp, target string")


def _parents(spark, ids):
    return spark.createDataFrame([("p", i) for i in ids], "target string, id long")


def test_splits_ranges_and_hot_key(spark):
    have = [i for i in range(1000) if i % 7]
    refs = [(i, i % 1100, AT) for i in range(3000)] + [(10_000 + i, 7, AT) for i in range(2000)] + [(20_000, None, AT), (20_001, 5, None)]
    got = {r.row_id for r in o.find_orphans(_refs(spark, refs), _parents(spark, have + have[:5] + [None]), per_range=20, per_task=100).collect()}
    assert got == {i for i, r, _ in refs if r is not None and r not in set(have)}


def test_no_parents_no_refs(spark):
    refs = _refs(spark, [(1, 5, AT), (1, 5, AT)])
    assert o.find_orphans(refs, _parents(spark, [])).count() == 2
    assert o.find_orphans(_refs(spark, []), _parents(spark, [1])).count() == 0


def test_period_report_counts_a_repeat_once(spark):
    refs = _refs(spark, [(1, 5, AT), (1, 5, AT), (2, 6, AT), (3, 5, None)])
    rows = {r.period: (r.refs, r.orphans, r.missing_keys) for r in o.orphans_by_period(o.find_orphans(refs, _parents(spark, [6])), refs).collect()}
    assert rows == {"2024-05": (2, 1, 1), None: (1, 1, 1)}

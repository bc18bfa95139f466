import numpy as np

from tamarack.operators.sweep_run import State, Thresholds, run_sweep


def test_a_sweep_runs_its_passes_in_order(spark):
    """Uncategorized members that are alike become a category, a stale category goes and its members move up, twins among siblings merge,
    twins among painpoints merge once confirmed, and a stray goes to where it belongs."""
    rng = np.random.default_rng(4)
    base = rng.standard_normal((6, 16))
    at = lambda k, s=0.1: (lambda x: (x / np.linalg.norm(x)).tolist())(base[k] + s * rng.standard_normal(16))
    fresh, old = "2025-12-20 00:00:00", "2025-01-01 00:00:00"
    cats = [(1, "Uncategorized", None, None, True, None), (2, "Root", None, "all", True, fresh), (3, "Billing", 2, "bills", False, fresh), (4, "Invoices", 2, "bills too", False, fresh), (5, "Dead", 2, "old", False, old), (6, "Login", 2, "sign in", False, fresh)]
    where = {**{i: (1, 0) for i in range(10, 14)}, **{i: (3, 1) for i in range(20, 24)}, **{i: (4, 1) for i in range(30, 33)}, 40: (5, 3), **{i: (6, 4) for i in range(50, 54)}, 60: (3, 4)}
    pps = [(i, f"t{i}", "d", 5, 1 + i % 3, c, old if c == 5 else fresh) for i, (c, _) in where.items()]
    s = State(
        spark.createDataFrame(cats, "id long, name string, parent_id long, description string, is_seed boolean, member_set_last_changed_at string"),
        spark.createDataFrame(pps, "id long, title string, description string, severity int, signal_count long, category_id long, last_updated string").selectExpr("id", "title", "description", "severity", "signal_count", "category_id", "cast(last_updated as timestamp) as last_updated"),
        spark.createDataFrame([(i, 1000 + i) for i in where], "painpoint_id long, pending_painpoint_id long"),
        spark.createDataFrame([(1, 3)], "id long, category_id long"),
        spark.createDataFrame([(i, at(k)) for i, (_, k) in where.items()], "id long, v array<double>"),
        spark.createDataFrame([(2, at(5)), (3, at(1)), (4, at(1)), (5, at(3)), (6, at(4))], "id long, v array<double>"),
    )
    after, audit, summary = run_sweep(s, "2026-01-01", Thresholds(pair=0.95), confirm=lambda e: e.where("category_id = 6"))
    got = {r.event_type: (r.proposed, r.accepted) for r in summary.collect()}
    place = {r.id: r.category_id for r in after.painpoints.collect()}
    assert got["uncategorized"] == (1, 1) and len({place[i] for i in range(10, 14)}) == 1 and place[10] > 6
    assert got["delete"] == (2, 1) and place[40] != 5  # the root is empty too, but its children name it
    assert got["merge"][1] == 1 and {place[i] for i in range(30, 33)} == {3}
    assert got["painpoint_merge"][1] >= 1 and after.painpoints.count() == len(where) - got["painpoint_merge"][1]
    assert after.bridge.count() == len(where) and after.painpoints.agg({"signal_count": "sum"}).first()[0] == sum(p[4] for p in pps)
    assert place[60] == 6 and got["reroute"][1] >= 1
    assert {r.id for r in after.categories.collect()} >= {1, 2, 3, 6} and not {4, 5} & {r.id for r in after.categories.collect()}
    assert audit.count() == sum(p for p, _ in got.values())

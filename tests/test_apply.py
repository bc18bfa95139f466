from tamarack.operators import apply as A, extract as X


def test_delete_keeps_what_is_referenced(spark):
    c = spark.createDataFrame([(1, "Uncategorized", None), (2, "a", None), (3, "b", 2), (4, "c", None)], "id long, name string, parent_id long")
    p = spark.createDataFrame([(10, 2), (11, 3), (12, 4), (13, None)], "id long, category_id long")
    q = spark.createDataFrame([(1, 4)], "id long, category_id long")
    got = A.delete_categories(c, p, q, spark.createDataFrame([(2,), (3,), (4,)], "id long"))
    assert {r.id for r in got[0].collect()} == {1, 2, 4}
    assert {r.id: r.category_id for r in got[1].collect()} == {10: 2, 11: 2, 12: 4, 13: None}
    assert {r.id: r.accepted for r in got[2].collect()} == {2: False, 3: True, 4: False}


def test_add_category_and_audit(spark):
    c = spark.createDataFrame([(1, "Uncategorized", None, "", True), (2, "Tools", None, "", True)], "id long, name string, parent_id long, description string, is_seed boolean")
    p = spark.createDataFrame([(10, 1), (11, 1), (12, 1)], "id long, category_id long")
    new = spark.createDataFrame([(1, "Maps", "d", "Any > Tools", [10]), (2, "Tools", "x", None, [11]), (3, "Lost", "d", "Nowhere", [])], "n int, name string, description string, parent string, members array<long>")
    cats, pps = A.add_category(c, p, new, 50)
    assert {r.id: (r.name, r.parent_id) for r in cats.collect()} == {1: ("Uncategorized", None), 2: ("Tools", None), 50: ("Maps", 2), 52: ("Lost", None)}
    assert {r.id: r.category_id for r in pps.collect()} == {10: 50, 11: 2, 12: 1}
    log = A.audit(spark.createDataFrame([], "event_type string, reason string"), spark.createDataFrame([(50, 3.0, True, "applied")], "id long, value double, accepted boolean, reason string"), "add_category_new", "cluster_size", 3.0)
    assert log.first().metric_value == 3.0


def test_extraction_survives_a_failing_batch(spark):
    rows = spark.createDataFrame([("g", 0, 1, "good"), ("g", 1, 2, "bad"), ("h", 0, 3, "good")], "grp string, batch long, id long, rendered string")

    def make():
        def run(posts):
            if posts[0][1] == "bad":
                raise RuntimeError
            return [{"post_id": i, "title": t, "severity": 5} for i, t in posts]

        return run

    got = X.extract(rows, make).collect()
    assert sorted((r.grp, r.batch, r.failed) for r in got) == [("g", 0, False), ("g", 1, True), ("h", 0, False)]
    assert X.extract(rows.limit(0), make).count() == 0


def test_judge_sample_takes_whole_posts(spark):
    rows = spark.createDataFrame([(i, i % 3 + 1) for i in range(50)], "post_id long, n int")
    got = X.judge_sample(rows, 10).collect()
    assert sum(r.n for r in got) >= 10 and sum(r.n for r in sorted(got, key=lambda r: r["rank"])[:-1]) < 10

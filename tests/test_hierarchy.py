import random

from tamarack.operators import hierarchy as h

SCHEMA = "id long, parent_id long, name string, depth string"


def _frame(spark, rows):
    return spark.createDataFrame([(i, p, n, "x") for i, p, n in rows], SCHEMA)  # an own depth column: a clashing name


def test_paths_roots_rings(spark):
    rows = [(1, None, "a"), (2, 1, " b "), (3, 2, None), (4, 99, ""), (5, 6, "e"), (6, 7, "f"), (7, 6, "g"), (8, 8, "h"), (9, 8, "i"), (None, 1, "z"), (2, 1, " b ")]
    got = {r.id: r for r in h.hierarchy(_frame(spark, rows)).collect()}
    assert sorted(got) == list(range(1, 10))
    assert (got[3].path, got[3].depth, got[3].root_id) == ("a > b > 3", 3, 1)
    assert (got[4].path, got[4].depth) == ("4", 1)
    assert (got[1].n_descendants, got[4].n_descendants, got[5].n_descendants) == (2, 0, None)
    assert {i: got[i].loop_id for i in got if got[i].in_ring} == {5: 6, 6: 6, 7: 6, 8: 8, 9: 8}


def test_deep_random_forest_against_walking(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.choice([None, i - 1, rnd.randint(1, 60)]) if i > 1 else None, f"n{i}") for i in range(1, 61)] + [(i, i - 1, "c") for i in range(100, 140)]
    parent = {i: p for i, p, _ in rows}
    want = {}
    for i in parent:
        seen, at = [], i
        while at in parent and at not in seen:
            seen.append(at)
            at = parent[at]
        if at in seen:
            want[i] = min(seen[seen.index(at):])
    assert {r.id: r.loop_id for r in h.rings(_frame(spark, rows)).collect()} == want
    pairs = {(r.ancestor_id, r.descendant_id, r.distance) for r in h.ancestor_pairs(_frame(spark, rows)).collect()}
    walk = set()
    for i in parent:
        if i not in want:
            at, d = parent[i], 1
            while at in parent:
                walk.add((at, i, d))
                at, d = parent[at], d + 1
    assert pairs == walk


def test_empty(spark):
    assert h.hierarchy(_frame(spark, [])).count() == 0
    assert h.rings(_frame(spark, [])).count() == 0

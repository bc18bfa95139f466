import random

from tamarack.llm import clusters

from .test_clusters_and_mixing import FEATURES, TROUBLES, _rows


def test_a_subject_of_a_third_of_the_rows_keeps_its_clusters(spark):
    """One product told of in a third of all records is a subject like any other: its records fall into clusters by trouble and
    feature, and don't mix with those of other products."""
    rows, truth = _rows(160)
    rnd = random.Random(9)
    i = 10_000
    for n in range(len(rows) // 2):
        f, t = n % 8, (n // 8) % 8
        i += 1
        fa, fb = rnd.sample(FEATURES[f], 2)
        ta, tb = rnd.sample(TROUBLES[t], 2)
        rows.append((i, f"Zanoruvix: {fa} {ta}", f"Users of Zanoruvix report that the {fb} {tb}."))
        truth[i] = ("hot", f, t)
    df = spark.createDataFrame(rows, "id long, title string, description string")
    members, edges = clusters.cluster(df)
    got = {r.id: r.cluster_id for r in members.collect()}
    pairs = lambda lab: {(a, b) for a in lab for b in lab if a < b and lab[a] == lab[b]}
    hot = {k: v for k, v in truth.items() if k >= 10_000}
    want, have = pairs(hot), {(a, b) for a, b in pairs(got) if a >= 10_000 or b >= 10_000}
    assert len(want & have) >= 0.9 * len(want) and len(want & have) >= 0.85 * len(have)


def test_modularity_of_two_triangles(spark):
    e = [(1, 2), (2, 3), (1, 3), (4, 5), (5, 6), (4, 6), (3, 4)]
    both = spark.createDataFrame([(*x, 1.0) for u, v in e for x in ((u, v), (v, u))], "u long, v long, w double")
    lab = spark.createDataFrame([(i, 1 if i < 4 else 4) for i in range(1, 7)], "id long, c long")
    assert abs(clusters.modularity(both, lab) - (12 / 14 - 2 * (7 / 14) ** 2)) < 1e-9
    from tamarack.session import Scratch

    found = {r.id: r.c for r in clusters.communities(both, Scratch(spark, "t")).collect()}
    assert len({found[i] for i in (1, 2, 3)}) == len({found[i] for i in (4, 5, 6)}) == 1 and found[1] != found[4]

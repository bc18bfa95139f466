import random

from tamarack.llm import components, topn

PAIRS = "a long, b long, extra string"


def test_components_against_union_find(spark):
    rnd = random.Random(5)
    pairs = [(rnd.randint(1, 80), rnd.randint(1, 80)) for _ in range(55)] + [(i + 1, i) for i in range(200, 240)] + [(500, i) for i in range(501, 530)] + [(7, 7), (None, 3), (3, None)]
    pairs += pairs[:5]
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a and b and a != b:
            a, b = sorted((find(a), find(b)))
            up[b] = a
    df = spark.createDataFrame([(a, b, "x") for a, b in pairs], PAIRS)
    assert {r.id: r.group_id for r in components.connected_components(df).collect()} == {x: find(x) for x in up}
    assert components.connected_components(df.limit(0)).count() == 0


def test_top_n_with_ties_nulls_repeats_and_a_hot_group(spark):
    rnd = random.Random(2)
    rows = [("hot" if rnd.random() < 0.6 else f"g{rnd.randint(1, 9)}", i, rnd.choice([None, 1, 2, 3]), rnd.choice([None, 5, 6]), 1) for i in range(3000)]
    rows += [(g, i, 99, 99, 0) for g, i, *_ in rows[:50]] + [(None, 9999, 9, 9, 1), ("hot", None, 9, 9, 1)]  # older versions don't count
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "200")
    df = spark.createDataFrame(rows, "grp string, item long, a int, b int, at int").withColumnRenamed("grp", "rank")  # a clashing name
    got = topn.top_n_per_group(df, "rank", "item", ("a", "b"), 5, "at").collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for g, i, a, b, at in rows:
        if g and i is not None and at == 1:
            want.setdefault(g, []).append((-(a or 0), -(b or 0), i))
    want = {(g, r + 1, k[2]) for g, ks in want.items() for r, k in enumerate(sorted(ks)[:5])}
    assert {(r.grp, r["rank"], r.item) for r in got} == want
    assert topn.top_n_per_group(df.limit(0), "rank", "item", ("a", "b")).count() == 0

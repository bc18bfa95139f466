import random

from tamarack.llm import clusters, mixing

FEATURES = [("chat widget", "live bubble"), ("price list", "table of tariffs"), ("route planner", "delivery map"), ("stock counter", "inventory sheet"), ("dark theme", "night layout"), ("search box", "finder"), ("invoice export", "billing download"), ("login screen", "sign-in page")]
TROUBLES = [("crashes the app", "takes everything down"), ("is painfully slow", "needs several minutes"), ("charges twice", "bills two times"), ("loses the filter", "forgets selections"), ("garbles umlauts", "breaks accented letters"), ("drains the battery", "empties a charge"), ("shows old numbers", "displays stale figures"), ("hides the button", "buries its control")]


def _rows(n_products=220, seed=3):
    rnd = random.Random(seed)
    rows, truth, i = [], {}, 0
    for p in range(n_products):
        name = "".join(rnd.choice("bdfgklm") + rnd.choice("aeiou") for _ in range(4)).capitalize() + "x"
        for f, t in rnd.sample([(f, t) for f in range(8) for t in range(8)], 2):
            for _ in range(rnd.randint(1, 4)):
                i += 1
                fa, fb = rnd.sample(FEATURES[f], 2)
                ta, tb = rnd.sample(TROUBLES[t], 2)
                rows.append((i, f"{name}: {fa} {ta}", f"Users of {name} report that the {fb} {tb}."))
                truth[i] = (p, f, t)
    return rows, truth


def test_clusters_of_other_words(spark):
    rows, truth = _rows()
    df = spark.createDataFrame([(*r, "x") for r in rows] + [(9001, None, None, "x"), (9002, "", None, "x"), (None, "a", "b", "x"), (*rows[0], "x"), (9003, "word", None, "x")], "id long, title string, description string, cluster_id string")
    members, edges = clusters.cluster(df)
    got = {r.id: r.cluster_id for r in members.collect()}
    pairs = lambda lab: {(a, b) for a in lab for b in lab if a < b and lab[a] == lab[b]}
    want, have = pairs(truth), pairs(got)
    assert len(want & have) >= 0.9 * len(want) and len(want & have) >= 0.9 * len(have)
    d = clusters.describe(members, edges, df).collect()
    assert sum(r["size"] for r in d) == len(got) and all(len(r.typical_ids.split(",")) == min(3, r["size"]) for r in d)
    assert clusters.cluster(df.limit(0))[0].count() == 0


def test_neighbours_reach_recall(spark):
    """Of the true nearest ten at or above the least cosine, nine in ten are found."""
    import numpy as np

    from tamarack.session import Scratch

    rnd = np.random.default_rng(1)
    base = rnd.standard_normal((12, 128))
    m = base[rnd.integers(0, 12, 400)] + 0.5 * rnd.standard_normal((400, 128))
    q = np.rint(m / np.abs(m).max() * 127).astype(np.int8)
    nodes = spark.createDataFrame([(i, f"s{i % 5}", float(m[i, 0]), bytearray(q[i].tobytes())) for i in range(400)], "id long, subject string, place double, vec binary")
    u = q.astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -1)
    want = {(i, int(j)) for i in range(400) for j in np.argsort(-s[i])[:10] if s[i, j] >= 0.6}
    old = clusters.CHUNK
    clusters.CHUNK = 64  # blocks much smaller than the groups
    try:
        got = {(r.u, r.v) for r in clusters.neighbour_graph(nodes, Scratch(spark, "t")).collect()}
    finally:
        clusters.CHUNK = old
    assert len(want & got) >= 0.9 * len(want)


def test_mixing_meets_targets_and_caps(spark):
    rnd = random.Random(1)
    rows = [(i, s, rnd.randint(20, 400)) for i, s in enumerate(["big"] * 900 + ["mid"] * 300 + ["small"] * 12)] + [(5000, None, 50), (5001, "big", 0)]
    tokens = spark.createDataFrame(rows, "doc_id long, source string, tokens long")
    plan = spark.createDataFrame([("m", " Big ", 0.5, 2), ("m", "mid", 0.4, 4), ("m", "small", 0.1, 3), ("m", "absent", 0.0, 3), ("n", "mid", 1.0, 1), ("o", "absent", 1.0, 2)], "mix_name string, source string, target_share double, max_repeats int")
    copies, report = mixing.mix_sources(tokens, plan)
    r = {(x.mix_name, x.source): x for x in report.collect()}
    assert all(x.max_copies <= x.max_repeats for x in r.values())
    small = sum(t for _, s, t in rows if s == "small")
    assert r["m", "small"].actual_tokens == 3 * small  # held by its cap
    for s in ("big", "mid"):
        assert abs(r["m", s].actual_tokens - r["m", s].wanted_tokens) <= 400
    assert r["m", "absent"].docs == 0 and r["o", "absent"].actual_share == 0.0 and r["n", "mid"].actual_share == 1.0
    got = {}
    for c in copies.collect():
        got[c.mix_name, c.source] = got.get((c.mix_name, c.source), 0) + c.tokens * c.copies
    assert got == {k: x.actual_tokens for k, x in r.items() if x.actual_tokens}
    assert mixing.mix_sources(tokens.limit(0), plan)[0].count() == 0
    assert mixing.mix_sources(tokens, plan.limit(0))[1].count() == 0


def test_tokens_of_a_public_vocabulary(spark):
    df = spark.createDataFrame([(1, "hello world <|endoftext|>", " Post "), (2, None, None), (3, "", "x")], "doc_id long, text string, source string")
    got = {r.doc_id: (r.source, r.tokens) for r in mixing.count_tokens(df, mixing.tokenizer_path()).collect()}
    assert got[1][0] == "post" and got[1][1] > 4 and got[2] == (None, 0) and got[3] == ("x", 0)

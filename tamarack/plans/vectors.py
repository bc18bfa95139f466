"""Queries of vectors, retrieval and the sweep."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..adapter import Views, with_tables
from ..operators import retrieval as R
from ..operators import sweep as W
from ..operators import vectors as V
from ..operators.sweep_run import State, Thresholds, run_sweep
from ..session import Scratch

T1, T2, ROUTE = 0.38, 0.42, 0.02
NOW, LATER = "2026-01-01", "2026-01-02"


def _vec(v: Views):
    return v.vectors.select(F.col("vec_id").alias("id"), "v", F.col("label").cast("long").alias("label"))


def _queries(v: Views):
    return _vec(v).where("id % 50 = 0")


def _pairs(v: Views, t=T1):
    return V.similarity_join(_vec(v), t)


def _cents(v: Views):
    return Scratch(v.spark, "cents").write(V.centroids(_vec(v), "label"), "c")


def _catvec(v: Views):
    return _cents(v).select(F.col("label").alias("id"), F.col("centroid").alias("v"))


def _members(v: Views):
    """Painpoints that have a vector, in the category of its label; label 1 is Uncategorized."""
    p = v.painpoints.select("id", "signal_count", "severity", "last_updated")
    return p.join(_vec(v), "id").withColumn("category_id", F.col("label"))


def _docs(v: Views):
    return v.categories.select("id", F.concat_ws(" ", "name", "description").alias("text"))


def _asks(v: Views):
    return v.painpoints.where("id % 50 = 0").select(F.col("id").alias("q"), F.concat_ws(" ", "title", "description").alias("text"))


def _dense(v: Views):
    """Each asked painpoint's nearest categories by vector, both sides by the delivered vectors' ids."""
    cats = _vec(v).join(v.categories.select("id"), "id", "left_semi").select("id", "v")
    return V.nearest(_vec(v).where("id % 50 = 0"), cats, 20, exclude_self=False)


def _round(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.round(c, 6))
    return df


def _rank(df):
    return df.withColumn("rank", F.col("rank").cast("long"))


def _hybrid(v: Views):
    """For each asked painpoint the categories but its own and Uncategorized, by the delivered vectors of both ids and by words."""
    asked = v.painpoints.where("id % 50 = 0")
    cats = _vec(v).join(v.categories.select("id"), "id", "left_semi").select("id", "v")
    queries = _vec(v).join(asked.select("id"), "id", "left_semi").select(F.col("id").alias("q"), "v")
    asks = _asks(v).join(queries.select("q"), "q", "left_semi")
    return R.hybrid(queries, cats, asks, _docs(v), asked.select(F.col("id").alias("q"), F.col("category_id").alias("id")))


def _fates(v: Views):
    """For each asked vector: its best centroid, its own group's centroid, and what would become of it as a category."""
    near = V.nearest(_queries(v), _catvec(v), 1, exclude_self=False).select("q", F.col("id").alias("best_label"), "sim")
    own = _queries(v).select(F.col("id").alias("q"), "label", "v").join(_cents(v).select("label", "centroid"), "label").select("q", "label", V.cosine(F.col("v"), F.col("centroid")).alias("own"))
    j = near.join(own, "q")
    return j.select("q", "best_label", F.round("sim", 6).alias("best"), F.round("own", 6).alias("own"), R.creation_gate(F.col("sim"), 0.35).alias("gate"), R.split_fate(F.col("sim"), F.col("own"), F.col("best_label") % 2 == F.col("label") % 2, 0.4, 0.2, 0.05).alias("fate"))


def _similar_categories(v: Views):
    c = _cents(v).select(F.col("label").alias("id"), F.col("centroid").alias("v"))
    return _round(V.similarity_join(c, -1.0), "sim")


def _reroutes(v: Views):
    """By hybrid candidates: the groups' centroids and the texts of the categories of those ids."""
    m = Scratch(v.spark, "members").write(_members(v), "m")
    cats = _catvec(v).where(F.col("id") != K.UNCATEGORIZED)
    docs = _docs(v).join(cats.select("id"), "id", "left_semi")
    asks = m.join(v.painpoints.select("id", "title", "description"), "id").select(F.col("id").alias("q"), F.concat_ws(" ", "title", "description").alias("text"))
    cand = R.hybrid(m.select(F.col("id").alias("q"), "v"), cats, asks, docs, m.select(F.col("id").alias("q"), F.col("category_id").alias("id")))
    return W.reroutes(m.select("id", "category_id"), V.leave_one_out(m, "category_id"), cand, ROUTE)


def _pp_pairs(v: Views):
    m = Scratch(v.spark, "members").write(_members(v).select("id", "category_id", "signal_count", "v"), "m")
    return W.painpoint_pairs(m.drop("v"), m.select("id", "v"), 0.3, 20)


def _folded(v: Views):
    return W.fold_merges(_pp_pairs(v), "category_id", "rank").select(F.col("grp").alias("category_id"), F.col("at").alias("rank"), "survivor", "loser", "accepted", "reason")


def _siblings(v: Views):
    """Sibling merges after the fold, by parent, in the order of the ids."""
    e = W.sibling_merges(v.categories, _vec(v).select("id", "v"), 0.25, 0.2).join(v.categories.select(F.col("id").alias("survivor"), F.coalesce("parent_id", F.lit(0)).alias("parent")), "survivor")
    return W.fold_merges(e.withColumn("at", F.struct("survivor", "loser")).withColumn("at", F.col("survivor") * 1_000_000 + F.col("loser")), "parent", "at")


def _moved(v: Views):
    """The painpoints as they are after the accepted merges: losers gone."""
    return _members(v).join(_folded(v).where("accepted").select(F.col("loser").alias("id")), "id", "left_anti")


def _split(v: Views):
    m = Scratch(v.spark, "members").write(_members(v).select("id", "category_id", "v"), "m")
    crowded = m.groupBy(F.col("category_id").alias("id")).agg(F.count("*").alias("n")).where((F.col("n") >= K.SPLIT_MIN_SIZE) & (F.col("id") != K.UNCATEGORIZED)).select("id")
    return W.split_clusters(crowded, m.select("id", "category_id"), V.pairs_within(m, "category_id", 0.3), 2)


def _whole_sweep(v: Views):
    """All passes over painpoints with vectors in the category of their label; pairs of one severity count as confirmed."""
    m = _members(v).join(v.painpoints.select("id", "title", "description"), "id")
    cats = v.stamped_categories
    state = State(cats, m.drop("v", "label"), v.bridge, v.pendings.select("id", "category_id"), m.select("id", "v"), _vec(v).join(cats.where(F.col("id") != K.UNCATEGORIZED).select("id"), "id", "left_semi").select("id", "v"))
    level = v.painpoints.select("id", F.coalesce("severity", F.lit(5)).alias("s"))

    def confirm(e):
        a, b = (level.select(F.col("id").alias(x), F.col("s").alias(f"s_{x}")) for x in ("survivor", "loser"))
        return e.join(a, "survivor").join(b, "loser").where("s_survivor = s_loser").drop("s_survivor", "s_loser")

    return run_sweep(state, NOW, Thresholds(cluster=0.3, split=0.3, sibling=0.25, root=0.2, pair=0.3, margin=ROUTE, stale_days=90), confirm)


def _clusters(v: Views):
    m = _members(v).where(F.col("category_id") == K.UNCATEGORIZED)
    return W.uncategorised_clusters(m.select("id"), V.similarity_join(m.select("id", "v"), 0.3), 0.3, 2)


_Q = {
    "cosine_pairs": lambda v: _vec(v).alias("a").join(_vec(v).alias("b"), F.col("b.id") == F.col("a.id") + 1).select(F.col("a.id").alias("id"), F.round(V.cosine(F.col("a.v"), F.col("b.v")), 6).alias("cos")),
    "similarity_join": lambda v: _round(_pairs(v), "sim"),
    "knn_topk": lambda v: _rank(_round(V.nearest(_queries(v), _vec(v), 10), "sim")),
    "nearest_above": lambda v: _round(V.nearest(_queries(v), _vec(v), 1, 0.3), "sim").select("q", "id", "sim"),
    "best_category": lambda v: V.nearest(_vec(v), _catvec(v), 1, exclude_self=False).select(F.col("q").alias("vec_id"), F.when(F.col("sim") >= 0.35, F.col("id")).otherwise(F.lit(K.UNCATEGORIZED)).cast("long").alias("category"), F.round("sim", 6).alias("sim")),
    "leave_one_out": lambda v: _round(V.leave_one_out(_vec(v), "label"), "sim"),
    "centroids": lambda v: _cents(v).select("label", "n", F.posexplode("centroid").alias("pos", "x")).select("label", "n", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x")),
    "blended_centroids": lambda v: _cents(v).join(_vec(v).select(F.col("id").alias("label"), F.col("v").alias("anchor")), "label", "left").select("label", F.posexplode(V.blend(F.col("anchor"), F.col("centroid"), F.col("label") % 2 == 0)).alias("pos", "x")).select("label", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x")),
    "category_similarity": _similar_categories,
    "anchor_violations": lambda v: _round(V.similarity_join(_vec(v).join(v.categories.select("id"), "id", "left_semi"), 0.4), "sim"),
    "valid_vectors": lambda v: V.valid(_vec(v), 64).groupBy("label").agg(F.count("*").alias("n")),
    "clusters": lambda v: V.components(_pairs(v, T2)),
    "cluster_summary": lambda v: V.cluster_summary(Scratch(v.spark, "pairs").write(_pairs(v), "p"), _vec(v), [T1, 0.40, T2]),
    "bm25_topk": lambda v: _rank(R.bm25(_asks(v), _docs(v), 10)),
    "rrf_fusion": lambda v: _rank(R.fuse(_dense(v).where(F.col("rank") <= 10), R.bm25(_asks(v), _docs(v), 10))),
    "hybrid_candidates": lambda v: _rank(_round(_hybrid(v), "sim")),
    "split_fate": _fates,
    "sweep_uncat_clusters": _clusters,
    "sweep_homeless": lambda v: W.homeless(_members(v).where(F.col("category_id") == K.UNCATEGORIZED).select("id", "signal_count", "severity"), _clusters(v), V.nearest(_members(v).where(F.col("category_id") == K.UNCATEGORIZED).select("id", "v"), _catvec(v).where(F.col("id") != 1), 1, exclude_self=False), 0.2).select("id", F.round("best", 6).alias("best"), "priority"),
    "sweep_split_candidates": lambda v: W.split_candidates(v.categories, v.painpoints, F.col("id") % 5),
    "sweep_delete": lambda v: W.delete_candidates(v.stamped_categories, v.painpoints, NOW, 90),
    "sweep_split": _split,
    "sweep_merge_fold": lambda v: _siblings(v).select("survivor", "loser", "accepted", "reason"),
    "sweep_painpoint_fold": lambda v: _rank(_folded(v)),
    "sweep_summary": lambda v: _whole_sweep(v)[2],
    "sweep_audit": lambda v: _whole_sweep(v)[1].withColumn("value", F.round("value", 6)),
    "accept_delete": lambda v: W.accept_deletes(W.delete_candidates(v.stamped_categories, v.painpoints, NOW, 90).select("id", "metric"), v.stamped_categories, v.painpoints, LATER, 150),
    "accept_reroute": lambda v: W.accept_reroutes(_reroutes(v), _moved(v), v.categories.where(F.col("id") != 5)),
    "sweep_merge": lambda v: W.sibling_merges(v.categories, _vec(v).select("id", "v"), 0.25, 0.2),
    "sweep_painpoint_pairs": lambda v: _rank(_pp_pairs(v)),
    "sweep_reroute": _reroutes,
    "acceptance_tests": lambda v: W.accept_merges(_pp_pairs(v).select("survivor", "loser", "sim"), _members(v).where("id % 9 <> 0").withColumn("category_id", F.when(F.col("id") % 13 == 0, F.lit(99)).otherwise(F.col("category_id")))),
}
QUERIES = {k: (lambda spark, sf, f=f: f(Views(spark, sf))) for k, f in _Q.items()}

_E = """E AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, CAST(label AS BIGINT) AS label FROM embeddings)"""
_COS = lambda a, b: f"list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})))"
_CENT = f"""{_E}, pos AS (SELECT label, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS pos FROM E), tot AS (SELECT label, pos, sum(x) AS s FROM pos GROUP BY 1, 2),
cent0 AS (SELECT label, list(s ORDER BY pos) AS total FROM tot GROUP BY 1), cent AS (SELECT label, (SELECT count(*) FROM E e WHERE e.label = c.label) AS n, total, list_transform(total, lambda x: x / sqrt(list_dot_product(total, total))) AS c FROM cent0 c)"""
_CTOK = lambda c: f"list_filter(string_split_regex(lower(coalesce({c}, '')), '[^a-z0-9]+'), lambda t: length(t) >= 2 AND t NOT IN ('and', 'or', 'not', 'near'))"
_BM = f"""docs AS (SELECT id, {_CTOK("concat_ws(' ', name, description)")} AS ts FROM categories), inv AS (SELECT id, len(ts) AS dl, term, count(*) AS tf FROM (SELECT id, ts, unnest(ts) AS term FROM docs) GROUP BY ALL),
st AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM docs), dfs AS (SELECT term, count(*) AS df FROM inv GROUP BY 1), asked AS (SELECT DISTINCT q, term FROM (SELECT id AS q, unnest({_CTOK("concat_ws(' ', title, description)")}) AS term FROM painpoints WHERE id % 50 = 0)),
sc AS (SELECT q, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score FROM asked JOIN dfs USING (term) JOIN inv USING (term), st GROUP BY 1, 2),
lex AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS rank FROM sc)"""
_DENSE = f"""{_E}, dense AS (SELECT a.id AS q, b.id, row_number() OVER (PARTITION BY a.id ORDER BY {_COS('a.v', 'b.v')} DESC, b.id) AS rank FROM E a, E b WHERE a.id % 50 = 0 AND b.id IN (SELECT id FROM categories))"""
_FUSE = lambda d, l: f"""seen AS (SELECT q, id, 1.0 / (60 + rank - 1) AS s, 0 AS list, rank FROM {d} WHERE rank <= 10 UNION ALL SELECT q, id, 1.0 / (60 + rank - 1), 1, rank FROM {l} WHERE rank <= 10),
fused AS (SELECT q, id, sum(s) AS rrf, min(list * 1000 + rank) AS first FROM seen GROUP BY 1, 2), ranked AS (SELECT q, id, round(rrf, 9) AS rrf, row_number() OVER (PARTITION BY q ORDER BY round(rrf, 12) DESC, first) AS rank FROM fused)"""  # noqa: E731
_CC = """n2 AS (SELECT id_a AS a, id_b AS b FROM pr UNION SELECT id_b, id_a FROM pr), reach AS (SELECT a AS id, a AS node FROM n2 UNION SELECT r.id, n2.b FROM reach r JOIN n2 ON n2.a = r.node), lab AS (SELECT id, min(node) AS label FROM reach GROUP BY 1)"""
_PAIR = lambda t, src="E": f"pr AS (SELECT a.id AS id_a, b.id AS id_b, {_COS('a.v', 'b.v')} AS sim FROM {src} a JOIN {src} b ON a.id < b.id WHERE {_COS('a.v', 'b.v')} >= {t})"
_M = "M AS (SELECT p.id, signal_count, severity, last_updated, e.v, e.label AS category_id FROM painpoints p JOIN E e ON e.id = p.id)"
_PP = f"""{_E}, {_M}, pr AS (SELECT a.id AS ia, b.id AS ib, a.category_id, a.signal_count AS sa, b.signal_count AS sb, round({_COS('a.v', 'b.v')}, 6) AS sim FROM M a JOIN M b ON a.category_id = b.category_id AND a.id < b.id WHERE a.category_id <> 1 AND {_COS('a.v', 'b.v')} >= 0.3),
pp AS (SELECT category_id, CASE WHEN coalesce(sa, 1) >= coalesce(sb, 1) THEN ia ELSE ib END AS survivor, CASE WHEN coalesce(sa, 1) >= coalesce(sb, 1) THEN ib ELSE ia END AS loser, sim, row_number() OVER (PARTITION BY category_id ORDER BY sim DESC, ia DESC, ib DESC) AS rank FROM pr QUALIFY rank <= 20)"""
_OUT = "ex AS (SELECT id AS q, category_id AS id FROM painpoints UNION SELECT id, 1 FROM E)"
_ACT = f"""st0 AS (SELECT category_id AS id, max(extracted_at) AS stamp FROM pending_painpoints GROUP BY 1), mem AS (SELECT category_id AS id, count(*) AS members, max(last_updated) AS newest FROM painpoints GROUP BY 1),
act AS (SELECT c.id, coalesce(members, 0) AS members, stamp, coalesce(stamp, newest) AS last FROM categories c LEFT JOIN st0 USING (id) LEFT JOIN mem USING (id) WHERE c.name <> 'Uncategorized'),
doomed AS (SELECT *, 'member_count' AS metric FROM act WHERE members = 0 AND stamp IS NOT NULL UNION ALL SELECT *, 'category_age_days' FROM act WHERE members > 0 AND last < TIMESTAMP '{NOW}' - INTERVAL 90 DAY)"""
_WHY = "CASE WHEN accepted THEN 'applied' ELSE 'cascade: survivor or loser already retired' END"
_FOLD = lambda src, grp, at: f"""f AS (SELECT {grp} AS grp, CAST({at} AS BIGINT) AS at, survivor, loser, true AS accepted, [loser] AS gone FROM {src} WHERE {at} = 1 UNION ALL
  SELECT f.grp, f.at + 1, s.survivor, s.loser, NOT list_has_any(f.gone, [s.survivor, s.loser]), CASE WHEN list_has_any(f.gone, [s.survivor, s.loser]) THEN f.gone ELSE list_append(f.gone, s.loser) END FROM f JOIN {src} s ON s.{grp} = f.grp AND s.{at} = f.at + 1)"""  # noqa: E731
_PPL = _PP[len(_E) + len(_M) + 4 :]
_BM_ALL = _BM.replace("FROM categories)", "FROM categories WHERE id IN (SELECT label FROM embeddings WHERE label <> 1))").replace("FROM painpoints WHERE id % 50 = 0)", "FROM painpoints WHERE id IN (SELECT vec_id FROM embeddings))")
_REROUTE = f"""own AS (SELECT m.id, m.category_id, m.v, CASE WHEN m.category_id = 1 OR mc.n <= 1 THEN 0.0 ELSE {_COS('m.v', 'list_transform(list_zip(mc.total, m.v), lambda z: z[1] - z[2])')} END AS own FROM M m
  JOIN (SELECT category_id, count(*) AS n, list_transform(range(1, 65), lambda i: list_sum(list_transform(list(v), lambda x: x[i]))) AS total FROM M GROUP BY 1) mc USING (category_id)),
near AS (SELECT o.id AS q, c.label AS id, row_number() OVER (PARTITION BY o.id ORDER BY {_COS('o.v', 'c.c')} DESC, c.label) AS rank FROM own o JOIN cent c ON c.label <> 1 AND c.label <> o.category_id),
lex2 AS (SELECT q, l.id, row_number() OVER (PARTITION BY q ORDER BY rank) AS rank FROM lex l JOIN own o ON o.id = l.q WHERE l.id <> o.category_id), {_FUSE('near', 'lex2')},
rr AS (SELECT o.id, o.category_id, r.id AS target, round(coalesce({_COS('o.v', 'c.c')}, 0) - own, 6) AS metric FROM own o JOIN ranked r ON r.q = o.id AND r.rank = 1 LEFT JOIN cent c ON c.label = r.id WHERE round(coalesce({_COS('o.v', 'c.c')}, 0) - own, 6) >= {ROUTE})"""
_UC = f"""{_CENT}, {_M}, U AS (SELECT * FROM M WHERE category_id = 1), {_PAIR(0.3, 'U')}, {_CC}, uc AS (SELECT id, label, count(*) OVER (PARTITION BY label) AS size FROM lab)"""

ORACLE = {
    "cosine_pairs": f"WITH {_E} SELECT a.id, round({_COS('a.v', 'b.v')}, 6) AS cos FROM E a JOIN E b ON b.id = a.id + 1",
    "similarity_join": f"WITH {_E}, {_PAIR(T1)} SELECT id_a, id_b, round(sim, 6) AS sim FROM pr",
    "knn_topk": f"WITH {_E} SELECT a.id AS q, b.id, round({_COS('a.v', 'b.v')}, 6) AS sim, row_number() OVER (PARTITION BY a.id ORDER BY {_COS('a.v', 'b.v')} DESC, b.id) AS rank FROM E a, E b WHERE a.id % 50 = 0 AND a.id <> b.id QUALIFY rank <= 10",
    "nearest_above": f"WITH {_E} SELECT a.id AS q, b.id, round({_COS('a.v', 'b.v')}, 6) AS sim FROM E a, E b WHERE a.id % 50 = 0 AND a.id <> b.id AND {_COS('a.v', 'b.v')} >= 0.3 QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY {_COS('a.v', 'b.v')} DESC, b.id) = 1",
    "best_category": f"WITH {_CENT} SELECT e.id AS vec_id, CASE WHEN {_COS('e.v', 'c.c')} >= 0.35 THEN c.label ELSE 1 END AS category, round({_COS('e.v', 'c.c')}, 6) AS sim FROM E e, cent c QUALIFY row_number() OVER (PARTITION BY e.id ORDER BY {_COS('e.v', 'c.c')} DESC, c.label) = 1",
    "leave_one_out": f"WITH {_CENT}, r AS (SELECT e.id, e.label, e.v, n, list_transform(list_zip(total, v), lambda z: z[1] - z[2]) AS rest FROM E e JOIN cent USING (label)) SELECT id, label, CASE WHEN n > 1 THEN round({_COS('v', 'rest')}, 6) ELSE 0.0 END AS sim FROM r",
    "centroids": f"WITH {_CENT} SELECT label, n, unnest(range(0, len(c))) AS pos, round(unnest(c), 6) AS x FROM cent",
    "blended_centroids": f"WITH {_CENT}, w AS (SELECT cent.label, c, a.v, CASE WHEN cent.label % 2 = 0 THEN 0.85 ELSE 0.60 END AS w FROM cent LEFT JOIN E a ON a.id = cent.label), b AS (SELECT label, CASE WHEN v IS NULL THEN c ELSE list_transform(list_zip(v, c), lambda z: w * z[1] + (1 - w) * z[2]) END AS b FROM w), u AS (SELECT label, list_transform(b, lambda x: x / sqrt(list_dot_product(b, b))) AS u FROM b) SELECT label, unnest(range(0, len(u))) AS pos, round(unnest(u), 6) AS x FROM u",
    "category_similarity": f"WITH {_CENT} SELECT a.label AS id_a, b.label AS id_b, round({_COS('a.c', 'b.c')}, 6) AS sim FROM cent a JOIN cent b ON a.label < b.label",
    "anchor_violations": f"WITH {_E}, X AS (SELECT * FROM E WHERE id IN (SELECT id FROM categories)), {_PAIR(0.4, 'X')} SELECT id_a, id_b, round(sim, 6) AS sim FROM pr",
    "valid_vectors": f"WITH {_E} SELECT label, count(*) AS n FROM E WHERE len(v) = 64 GROUP BY 1",
    "clusters": f"WITH RECURSIVE {_E}, {_PAIR(T2)}, {_CC} SELECT id, label FROM lab",
    "cluster_summary": f"WITH RECURSIVE {_E}, {_PAIR(T1)}, ts AS (SELECT unnest([{T1}, 0.40, {T2}]) AS t), both_ways AS (SELECT t, id_a AS a, id_b AS b FROM ts JOIN pr ON sim >= t UNION ALL SELECT t, id_b, id_a FROM ts JOIN pr ON sim >= t), walk AS (SELECT t, id, id AS node FROM ts, E UNION SELECT w.t, w.id, x.b FROM walk w JOIN both_ways x ON x.t = w.t AND x.a = w.node), part AS (SELECT t, id, min(node) AS label FROM walk GROUP BY ALL), sizes AS (SELECT t, label, count(*) AS size FROM part GROUP BY ALL) SELECT t AS threshold, count(*) AS components, max(size) AS largest, count(*) FILTER (size = 1) AS singletons FROM sizes GROUP BY 1",
    "bm25_topk": f"WITH {_BM} SELECT q, id, score, rank FROM lex WHERE rank <= 10",
    "rrf_fusion": f"WITH {_BM}, {_DENSE}, {_FUSE('dense', 'lex')} SELECT * FROM ranked WHERE rank <= 10",
    "hybrid_candidates": f"WITH {_BM}, {_DENSE}, {_OUT}, d2 AS (SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY rank) AS rank FROM dense ANTI JOIN ex USING (q, id) WHERE q IN (SELECT id FROM painpoints)), l2 AS (SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY rank) AS rank FROM lex ANTI JOIN ex USING (q, id) WHERE q IN (SELECT id FROM E)), {_FUSE('d2', 'l2')} SELECT q, r.id, coalesce(round({_COS('a.v', 'b.v')}, 6), 0.0) AS sim, rrf, rank FROM ranked r JOIN E a ON a.id = q LEFT JOIN E b ON b.id = r.id",
    "split_fate": f"WITH {_CENT}, b AS (SELECT e.id AS q, e.label, e.v, c.label AS best_label, {_COS('e.v', 'c.c')} AS s FROM E e, cent c WHERE e.id % 50 = 0 QUALIFY row_number() OVER (PARTITION BY e.id ORDER BY {_COS('e.v', 'c.c')} DESC, c.label) = 1), o AS (SELECT b.*, {_COS('b.v', 'c.c')} AS o FROM b JOIN cent c USING (label)) SELECT q, best_label, round(s, 6) AS best, round(o, 6) AS own, CASE WHEN s >= 0.35 THEN 'absorb' ELSE 'create' END AS gate, CASE WHEN s >= 0.4 THEN 'absorb' WHEN s >= 0.2 AND s - o >= 0.05 AND best_label % 2 <> label % 2 THEN 'replant' ELSE 'create' END AS fate FROM o",
    "sweep_uncat_clusters": f"WITH RECURSIVE {_UC} SELECT * FROM uc WHERE size >= 2",
    "sweep_homeless": f"WITH RECURSIVE {_UC}, nb AS (SELECT u.id, max({_COS('u.v', 'c.c')}) AS best FROM U u, cent c WHERE c.label <> 1 GROUP BY 1) SELECT u.id, round(best, 6) AS best, CAST(coalesce(signal_count, 1) * coalesce(severity, 5) AS BIGINT) AS priority FROM U u LEFT JOIN nb ON nb.id = u.id WHERE u.id NOT IN (SELECT id FROM uc WHERE size >= 2) AND (best IS NULL OR best < 0.2)",
    "sweep_split_candidates": "SELECT c.id, c.name, count(*) AS members, c.id % 5 AS last_count FROM categories c JOIN painpoints p ON p.category_id = c.id GROUP BY c.id, c.name HAVING count(*) >= 10 AND count(*) - c.id % 5 >= 10",
    "sweep_delete": f"WITH {_ACT} SELECT id, metric, CASE WHEN members = 0 THEN 0.0 ELSE round(epoch_us(TIMESTAMP '{NOW}') / 86400e6 - epoch_us(last) / 86400e6, 6) END AS value, CASE WHEN members = 0 THEN 0.0 ELSE 90.0 END AS threshold FROM doomed",
    "accept_delete": f"WITH {_ACT} SELECT id, metric, CASE WHEN members > 0 AND last >= TIMESTAMP '{LATER}' - INTERVAL 150 DAY THEN 'member activity at ' || strftime(last, '%Y-%m-%d %H:%M:%S') || ' is fresh' ELSE 'applied' END AS reason, NOT (members > 0 AND last >= TIMESTAMP '{LATER}' - INTERVAL 150 DAY) AS accepted FROM doomed",
    "sweep_split": f"WITH RECURSIVE {_E}, {_M}, crowd AS (SELECT category_id FROM M WHERE category_id <> 1 GROUP BY 1 HAVING count(*) >= 10), pr AS (SELECT a.id AS id_a, b.id AS id_b FROM M a JOIN M b ON a.category_id = b.category_id AND a.id < b.id WHERE {_COS('a.v', 'b.v')} >= 0.3), {_CC}, sz AS (SELECT m.category_id, label, count(*) AS size FROM lab JOIN M m USING (id) WHERE m.category_id IN (SELECT category_id FROM crowd) GROUP BY ALL HAVING count(*) >= 2) SELECT category_id, label, size, CAST(part AS INT) AS part FROM (SELECT *, row_number() OVER (PARTITION BY category_id ORDER BY size DESC, label) AS part, count(*) OVER (PARTITION BY category_id) AS n FROM sz) WHERE n >= 2 AND part <= 4",
    "sweep_painpoint_fold": f"WITH RECURSIVE {_PP}, {_FOLD('pp', 'category_id', 'rank')} SELECT grp AS category_id, f.at AS rank, survivor, loser, accepted, {_WHY} AS reason FROM f",
    "sweep_merge_fold": f"WITH RECURSIVE {_E}, k AS (SELECT c.id, parent_id, v FROM categories c JOIN E e ON e.id = c.id), mm AS (SELECT coalesce(a.parent_id, 0) AS parent, a.id AS survivor, b.id AS loser, row_number() OVER (PARTITION BY a.parent_id ORDER BY a.id, b.id) AS n FROM k a JOIN k b ON a.id < b.id AND a.parent_id IS NOT DISTINCT FROM b.parent_id WHERE {_COS('a.v', 'b.v')} >= CASE WHEN a.parent_id IS NULL THEN 0.2 ELSE 0.25 END), {_FOLD('mm', 'parent', 'n')} SELECT survivor, loser, accepted, {_WHY} AS reason FROM f",
    "accept_reroute": f"WITH RECURSIVE {_BM_ALL}, {_CENT}, {_M}, {_REROUTE}, {_PPL}, {_FOLD('pp', 'category_id', 'rank')} SELECT r.id, category_id, target, metric, CASE WHEN r.id IN (SELECT loser FROM f WHERE accepted) THEN 'cascade: painpoint deleted' WHEN target = 5 OR target NOT IN (SELECT id FROM categories) THEN 'cascade: target category ' || target || ' gone' ELSE 'applied' END AS reason, r.id NOT IN (SELECT loser FROM f WHERE accepted) AND target <> 5 AND target IN (SELECT id FROM categories) AS accepted FROM rr r",
    "sweep_merge": f"WITH {_E}, k AS (SELECT c.id, parent_id, v FROM categories c JOIN E e ON e.id = c.id) SELECT a.id AS survivor, b.id AS loser, round({_COS('a.v', 'b.v')}, 6) AS metric FROM k a JOIN k b ON a.id < b.id AND a.parent_id IS NOT DISTINCT FROM b.parent_id WHERE {_COS('a.v', 'b.v')} >= CASE WHEN a.parent_id IS NULL THEN 0.2 ELSE 0.25 END",
    "sweep_painpoint_pairs": f"WITH {_PP} SELECT * FROM pp",
    "sweep_reroute": f"WITH {_BM_ALL}, {_CENT}, {_M}, {_REROUTE} SELECT * FROM rr",
    "acceptance_tests": f"WITH {_PP}, X AS (SELECT id, CASE WHEN id % 13 = 0 THEN 99 ELSE category_id END AS category_id FROM M WHERE id % 9 <> 0) SELECT survivor, loser, sim, CASE WHEN s.category_id IS NULL OR l.category_id IS NULL THEN 'cascade: painpoint deleted' WHEN s.category_id <> l.category_id THEN 'cascade: survivor/loser moved categories' ELSE 'applied' END AS reason, coalesce(s.category_id = l.category_id, false) AS accepted FROM pp LEFT JOIN X s ON s.id = survivor LEFT JOIN X l ON l.id = loser",
}

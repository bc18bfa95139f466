"""Queries of the stateful pipeline: promotion, packing, quote repair, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapter import Views, with_tables
from ..functions import quotes
from ..operators import apply as A
from ..operators import extract as X
from ..operators import promote as P
from ..operators import sweep as S3
from ..operators import vectors as V
from ..session import Scratch
from ..sources import listing as L
from ..streaming import promotion as S
from . import vectors as W


def _items(v: Views):
    return Scratch(v.spark, "items").write(v.vectors.select(F.col("vec_id").alias("id"), "v"), "items")


def _links(v: Views, t: float):
    e = _items(v)
    return P.promote(e.where("id > 60"), e.where("id <= 60"), t)


def _merges(v: Views):
    """All positive decisions: whatever they link directly or through others falls to the painpoint of the most signals (ties: least id)."""
    lab = V.components(v.raw("merge_decisions").where("duplicates and painpoint_a <> painpoint_b").select(F.col("painpoint_a").alias("id_a"), F.col("painpoint_b").alias("id_b")))
    there = lab.join(v.painpoints.select("id", "signal_count"), "id")
    best = there.groupBy("label").agg(F.min(F.struct((-F.coalesce("signal_count", F.lit(1))).alias("s"), F.col("id").alias("survivor"))).alias("b")).select("label", "b.survivor")
    return there.join(best, "label").where("id <> survivor").select("survivor", F.col("id").alias("loser"))


def _cat_merges(v: Views):
    """The sweep's sibling merges that its fold accepts, chains resolved."""
    return A.resolve(W._siblings(v).where("accepted"))


def _deleted(v: Views):
    """The sweep's deletions against all references."""
    return A.delete_categories(v.categories, v.painpoints, v.pendings, S3.delete_candidates(v.stamped_categories, v.painpoints, W.NOW, 90).select("id"))


def _rerouted(v: Views):
    return A.move_members(v.painpoints, W._reroutes(v).select("id", "target"), "2026-01-01")


def _split_up(v: Views):
    m = W._members(v).select("id", "category_id")
    parts = W._split(v)
    lab = V.components(V.pairs_within(W._members(v), "category_id", 0.3))
    return A.split_categories(v.categories, m, parts, lab, 1_000_000)


def _gold(v: Views):
    p = v.painpoints
    return v.raw("merge_decisions").select(F.col("decision_id").cast("string").alias("id"), "painpoint_a", "painpoint_b", F.when(F.col("duplicates"), "positive").when(~F.col("duplicates"), "negative").alias("label")).join(p.select(F.col("id").alias("painpoint_a"), F.col("title").alias("a")), "painpoint_a", "left").join(p.select(F.col("id").alias("painpoint_b"), F.col("description").alias("b")), "painpoint_b", "left")


_Q = {
    "apply_reroute": lambda v: _rerouted(v).select("id", "category_id", F.date_format("last_updated", "yyyy-MM-dd HH:mm:ss").alias("updated")),
    "apply_split": lambda v: _split_up(v)[1].select("id", "category_id"),
    "apply_split_categories": lambda v: _split_up(v)[0].select("id", "name", "parent_id"),
    "apply_painpoint_merge": lambda v: A.merge_painpoints(v.painpoints, v.bridge, _merges(v))[0].select("id", "signal_count"),
    "apply_painpoint_merge_sources": lambda v: A.merge_painpoints(v.painpoints, v.bridge, _merges(v))[1],
    "apply_category_merge": lambda v: A.merge_categories(v.categories, v.painpoints, _cat_merges(v))[0].select("id", "parent_id"),
    "apply_category_merge_members": lambda v: A.merge_categories(v.categories, v.painpoints, _cat_merges(v))[1].select("id", "category_id"),
    "apply_delete": lambda v: _deleted(v)[1].select("id", "category_id"),
    "apply_delete_audit": lambda v: _deleted(v)[2],
    "gold_violations": lambda v: X.gold_violations(_gold(v)),
    "components_renumbered": lambda v: X.renumber(V.components(v.raw("merge_decisions").where("duplicates").select(F.col("painpoint_a").alias("id_a"), F.col("painpoint_b").alias("id_b")))).select("label", "size", F.col("number").cast("long").alias("number")),
    "promote": lambda v: _links(v, 0.38).select("id", "action", "target", F.round("sim", 6).alias("sim")),
    "pending_dedup": lambda v: (lambda e: P.save_pendings(e.where("id > 60"), e.where("id <= 60"), 0.42))(_items(v)).select("id", "action", "target", F.round("sim", 6).alias("sim")),
    "promoted_signals": lambda v: P.apply_links(v.painpoints.withColumn("signal_count", F.col("signal_count").cast("long")), _links(v, 0.38), v.pendings, v.sources)[0].select("id", "signal_count"),
    "batch_packing": lambda v: P.pack(v.posts.join(L.token_totals(v.posts, v.comments), "id").select(F.col("subreddit").alias("grp"), "id", "tokens")),
    "quote_repair": lambda v: quotes.repair_quotes(v.pendings, v.posts, v.comments),
    "quote_repair_stats": lambda v: quotes.repair_quotes(v.pendings, v.posts, v.comments).agg(F.count("*").alias("items"), *[F.count_if(c).alias(c) for c in ("kept", "attribution_fixed", "fuzzy", "numeric")]),
    "stream_event_counts": lambda v: S.run_event_counts(v.spark, f"{v.sf}/events.parquet*", v.raw("events").schema),
}
QUERIES = {k: (lambda spark, sf, f=f: f(Views(spark, sf))) for k, f in _Q.items()}

_REACH = """n2 AS (SELECT painpoint_a AS a, painpoint_b AS b FROM merge_decisions WHERE duplicates UNION SELECT painpoint_b, painpoint_a FROM merge_decisions WHERE duplicates), reach AS (SELECT a AS id, a AS node FROM n2 UNION SELECT r.id, n2.b FROM reach r JOIN n2 ON n2.a = r.node)"""
_MERGES = f"""{_REACH}, lab AS (SELECT id, min(node) AS label FROM reach GROUP BY 1), known AS (SELECT l.id, label, first_value(l.id) OVER (PARTITION BY label ORDER BY coalesce(signal_count, 1) DESC, l.id) AS survivor FROM lab l JOIN painpoints p ON p.id = l.id), m AS (SELECT survivor, id AS loser FROM known WHERE id <> survivor)"""
_CM = W.ORACLE["sweep_merge_fold"][len("WITH RECURSIVE ") :].split(" SELECT survivor, loser, accepted")[0] + """, link AS (SELECT survivor, loser FROM f WHERE accepted), up AS (SELECT loser, survivor FROM link UNION ALL SELECT up.loser, l.survivor FROM up JOIN link l ON l.loser = up.survivor), m AS (SELECT loser, survivor FROM up WHERE survivor NOT IN (SELECT loser FROM link))"""
_DEL = f"""{W._ACT}, e AS (SELECT d.id, c.parent_id, d.id IN (SELECT parent_id FROM categories WHERE parent_id IS NOT NULL) OR d.id IN (SELECT category_id FROM pending_painpoints WHERE category_id IS NOT NULL) AS used FROM doomed d JOIN categories c ON c.id = d.id)"""
_SPLIT = W.ORACLE["sweep_split"][len("WITH RECURSIVE ") :].split(" SELECT category_id, label, size, CAST(part")[0] + """, parts AS (SELECT *, 999999 + row_number() OVER (ORDER BY category_id, part) AS new_id FROM (SELECT *, row_number() OVER (PARTITION BY category_id ORDER BY size DESC, label) AS part, count(*) OVER (PARTITION BY category_id) AS n FROM sz) WHERE n >= 2 AND part <= 4),
after AS (SELECT m.id, coalesce(p.new_id, m.category_id) AS category_id FROM M m LEFT JOIN lab USING (id) LEFT JOIN parts p ON p.label = lab.label AND p.category_id = m.category_id),
gone AS (SELECT DISTINCT category_id AS id FROM parts WHERE category_id NOT IN (SELECT category_id FROM after) AND category_id IN (SELECT id FROM categories WHERE parent_id IS NOT NULL))"""

_FOLDED = lambda t: f"""{W._E}, it AS (SELECT id, v, row_number() OVER (ORDER BY id) AS n FROM E WHERE id > 60), held AS (SELECT id, v FROM E WHERE id <= 60),
hb AS (SELECT i.id, max_by(struct_pack(o := h.id, s := {W._COS('i.v', 'h.v')}), struct_pack(s := {W._COS('i.v', 'h.v')}, m := -h.id)) AS best FROM it i, held h WHERE {W._COS('i.v', 'h.v')} >= {t} GROUP BY i.id),
near AS (SELECT a.id, list(struct_pack(o := b.id, s := {W._COS('a.v', 'b.v')})) AS es FROM it a JOIN it b ON b.id < a.id WHERE {W._COS('a.v', 'b.v')} >= {t} GROUP BY a.id),
ask AS (SELECT i.id, i.n, hb.best AS hb, coalesce(near.es, []) AS es FROM it i LEFT JOIN hb USING (id) LEFT JOIN near USING (id)),
step AS (SELECT CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS id, CAST(NULL AS VARCHAR) AS action, CAST(NULL AS BIGINT) AS target, CAST(NULL AS DOUBLE) AS sim, CAST([] AS BIGINT[]) AS leaders
  UNION ALL SELECT n, id, CASE WHEN pick IS NULL AND hb IS NULL THEN 'create' WHEN pick IS NULL OR hb.s >= pick.s THEN 'link_held' ELSE 'link' END,
    CASE WHEN pick IS NULL AND hb IS NULL THEN id WHEN pick IS NULL OR hb.s >= pick.s THEN hb.o ELSE pick.o END,
    CASE WHEN pick IS NULL AND hb IS NULL THEN NULL WHEN pick IS NULL OR hb.s >= pick.s THEN hb.s ELSE pick.s END,
    CASE WHEN pick IS NULL AND hb IS NULL THEN list_append(leaders, id) ELSE leaders END
  FROM (SELECT a.n, a.id, a.hb, s.leaders, list_sort(list_transform(list_filter(a.es, lambda e: list_contains(s.leaders, e.o)), lambda e: struct_pack(s := e.s, m := -e.o, o := e.o)), 'DESC')[1] AS pick FROM step s JOIN ask a ON a.n = s.n + 1)),
links AS (SELECT id, action, target, round(sim, 6) AS sim FROM step WHERE n > 0)"""  # noqa: E731

ORACLE = {
    "promote": f"WITH RECURSIVE {_FOLDED(0.38)} SELECT * FROM links",
    "pending_dedup": f"WITH RECURSIVE {_FOLDED(0.42)} SELECT id, CASE WHEN action = 'create' THEN 'insert' ELSE 'extra_source' END AS action, target, sim FROM links",
    "promoted_signals": with_tables("SELECT p.id, CAST(p.signal_count + coalesce((SELECT sum(greatest(1, (SELECT count(*) FROM S s WHERE s.pending_painpoint_id = l.id))) FROM links l WHERE l.action = 'link_held' AND l.target = p.id), 0) AS BIGINT) AS signal_count FROM painpoints p", _FOLDED(0.38), recursive=True),
    "apply_reroute": f"WITH {W._BM_ALL}, {W._CENT}, {W._M}, {W._REROUTE} SELECT p.id, coalesce(r.target, p.category_id) AS category_id, strftime(CASE WHEN r.id IS NOT NULL THEN TIMESTAMP '2026-01-01' ELSE last_updated END, '%Y-%m-%d %H:%M:%S') AS updated FROM painpoints p LEFT JOIN rr r ON r.id = p.id",
    "apply_painpoint_merge": f"WITH RECURSIVE {_MERGES} SELECT id, CAST(signal_count + coalesce((SELECT sum(x.signal_count) FROM m JOIN painpoints x ON x.id = m.loser WHERE m.survivor = p.id), 0) AS BIGINT) AS signal_count FROM painpoints p WHERE id NOT IN (SELECT loser FROM m)",
    "apply_painpoint_merge_sources": with_tables("SELECT DISTINCT coalesce(m.survivor, b.painpoint_id) AS painpoint_id, b.pending_painpoint_id FROM PS b LEFT JOIN m ON m.loser = b.painpoint_id", _MERGES, recursive=True),
    "apply_category_merge": f"WITH RECURSIVE {_CM} SELECT c.id, CASE WHEN m.survivor = c.id THEN NULL ELSE coalesce(m.survivor, c.parent_id) END AS parent_id FROM categories c LEFT JOIN m ON m.loser = c.parent_id WHERE c.id NOT IN (SELECT loser FROM m)",
    "apply_category_merge_members": f"WITH RECURSIVE {_CM} SELECT p.id, coalesce(m.survivor, p.category_id) AS category_id FROM painpoints p LEFT JOIN m ON m.loser = p.category_id",
    "apply_delete": f"WITH {_DEL} SELECT p.id, CASE WHEN e.id IS NOT NULL THEN coalesce(e.parent_id, 1) ELSE p.category_id END AS category_id FROM painpoints p LEFT JOIN e ON e.id = p.category_id AND NOT e.used",
    "apply_delete_audit": f"WITH {_DEL} SELECT id, NOT used AS accepted, CASE WHEN used THEN 'apply error: still referenced' ELSE 'applied' END AS reason FROM e",
    "apply_split": f"WITH RECURSIVE {_SPLIT} SELECT id, category_id FROM after",
    "apply_split_categories": f"WITH RECURSIVE {_SPLIT}, made AS (SELECT id, name, parent_id FROM categories UNION ALL SELECT new_id, 'AutoCat-' || (new_id - 999999), category_id FROM parts) SELECT k.id, k.name, CASE WHEN k.parent_id IN (SELECT id FROM gone) THEN (SELECT c.parent_id FROM categories c WHERE c.id = k.parent_id) ELSE k.parent_id END AS parent_id FROM made k WHERE k.id NOT IN (SELECT id FROM gone)",
    "gold_violations": "SELECT CAST(decision_id AS VARCHAR) AS id, why FROM (SELECT decision_id, CASE WHEN trim(coalesce(a.title, '')) = '' OR trim(coalesce(b.description, '')) = '' THEN 'empty text' WHEN duplicates IS NULL THEN 'unknown label' WHEN count(*) OVER (PARTITION BY decision_id) > 1 THEN 'id twice' END AS why FROM merge_decisions d LEFT JOIN painpoints a ON a.id = d.painpoint_a LEFT JOIN painpoints b ON b.id = d.painpoint_b) WHERE why IS NOT NULL",
    "components_renumbered": f"WITH RECURSIVE {_REACH}, lab AS (SELECT id, min(node) AS label FROM reach GROUP BY 1) SELECT label, count(*) AS size, row_number() OVER (ORDER BY count(*) DESC, label) AS number FROM lab GROUP BY 1",
    "stream_event_counts": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "batch_packing": with_tables("SELECT subreddit AS grp, id, tokens, batch FROM f", """t AS (SELECT p.subreddit, p.id, CAST(greatest(1, (length(coalesce(title, '')) + length(coalesce(selftext, '')) + coalesce((SELECT sum(length(coalesce(body, ''))) FROM C c WHERE c.post_id = p.id), 0)) // 4) AS BIGINT) AS tokens FROM P p),
o AS (SELECT *, row_number() OVER (PARTITION BY subreddit ORDER BY id) AS n FROM t),
f AS (SELECT subreddit, id, tokens, n, CAST(0 AS BIGINT) AS batch, tokens AS used FROM o WHERE n = 1 UNION ALL
  SELECT o.subreddit, o.id, o.tokens, o.n, CASE WHEN f.used + o.tokens > 2000 THEN f.batch + 1 ELSE f.batch END, CASE WHEN f.used + o.tokens > 2000 THEN o.tokens ELSE f.used + o.tokens END FROM f JOIN o ON o.subreddit IS NOT DISTINCT FROM f.subreddit AND o.n = f.n + 1)""", recursive=True),
}

"""Queries of metrics, evaluation and snapshot differences."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..adapter import Views, with_tables
from ..operators import hierarchy as H
from ..operators import metrics as M
from .general import _TREE

ACCEPT = 50.0
KEYS = ["permalink", "comment_key"]


def _runs(v: Views):
    q = v.pendings.join(v.posts.select(F.col("id").alias("post_id"), "permalink"), "post_id").join(v.comments.select(F.col("id").alias("comment_id"), F.col("permalink").alias("cl")), "comment_id", "left")
    q = q.select("id", "permalink", F.coalesce("cl", F.lit("__POST_BODY__")).alias("comment_key"), "severity", "quoted_text")
    return M.cross_run(q.where("id % 3 <> 0"), q.where("id % 3 <> 1"), KEYS)


def _pairs(v: Views):
    """Decided pairs with a score: how close the two painpoints' severities and sizes are."""
    p = v.painpoints.select("id", F.coalesce("severity", F.lit(5)).alias("s"), "signal_count")
    d = v.raw("merge_decisions").where("duplicates is not null")
    a, b = (p.select(F.col("id").alias(f"painpoint_{x}"), F.col("s").alias(f"s{x}"), F.col("signal_count").alias(f"n{x}")) for x in "ab")
    return d.join(a, "painpoint_a").join(b, "painpoint_b").select("decision_id", F.col("duplicates").alias("positive"), F.round(1 / (1 + F.abs(F.col("sa") - F.col("sb")) + F.abs(F.col("na") - F.col("nb")) / 10.0), 6).alias("score"))


def _items(v: Views):
    """Observations with a label as an extractor gives it: any known kind, in other case, unknown or missing."""
    kinds = [*K.EVIDENCE_KEPT, *K.EVIDENCE_DROPPED, "maybe_pain"]
    kind = F.element_at(F.array(*[F.lit(x) for x in kinds]), (F.col("id") % len(kinds) + 1).cast("int"))
    kind = F.when(F.col("id") % 4 == 0, F.concat(F.lit(" "), F.initcap(kind))).otherwise(kind)
    return v.pendings.select("id", "post_id", "comment_id", "title", "quoted_text", F.when(F.col("id") % 13 != 0, kind).alias("evidence_type"))


def _usage(v: Views):
    u = v.raw("events").select(F.concat(F.lit("model_"), F.col("user_id") % 3).alias("model"), (F.col("event_id") % 1000 + 200).alias("prompt"), (F.col("event_id") % 100).alias("cached"), (F.col("event_id") % 300).alias("completion"))
    return u, v.spark.createDataFrame([("model_0", 0.05, 0.40), ("model_1", 0.40, 1.60), ("model_2", 0.10, 0.40)], "model string, price_in double, price_out double")


_Q = {
    "metrics_totals": lambda v: M.totals(v.categories),
    "metrics_dedup": lambda v: M.dedup_metrics(v.pendings, v.extras),
    "dedup_groups": lambda v: M.dedup_groups(v.pendings, v.extras).select("id", "title", "extra_count", F.array_join(F.transform("extra_sources", lambda s: s.post_id.cast("string")), ",").alias("extra_posts")),
    "metrics_merge": lambda v: M.merge_metrics(v.bridge, v.painpoints),
    "metrics_categorisation": lambda v: M.categorisation(v.painpoints, v.categories),
    "metrics_per_subreddit": lambda v: M.per_subreddit(v.posts, v.comments, v.pendings, v.bridge),
    "metrics_events": lambda v: M.event_counts(v.raw("events"), ACCEPT),
    "signal_integrity": lambda v: M.signal_integrity(v.painpoints, v.bridge),
    "category_rollup": lambda v: M.rollup(v.categories, v.painpoints, H.ancestor_pairs(v.categories)),
    "cross_run_diff": _runs,
    "changed_cells": lambda v: M.changed_cells(_runs(v)).select("permalink", "comment_key", "severity_a", "severity_b", "delta"),
    "snapshot_diff": lambda v: M.snapshot_diff(v.pendings, v.pendings.where("extracted_at < timestamp'2024-06-01'")).select("id", "title"),
    "pair_eval": lambda v: M.confusion(_pairs(v), F.col("score") >= 0.5, F.col("positive")),
    "threshold_sweep": lambda v: M.threshold_sweep(_pairs(v), 0.1, 0.9, 0.05),
    "label_distribution": lambda v: M.score_distribution(_pairs(v)),
    "severity_histogram": lambda v: M.severity_profile(v.pendings),
    "severity_moments": lambda v: M.severity_moments(v.pendings),
    "quote_status": lambda v: M.quote_status(v.pendings, v.posts, v.comments),
    "quote_status_report": lambda v: M.quote_status(v.pendings, v.posts, v.comments).groupBy("status").agg(F.count("*").alias("n")),
    "token_cost": lambda v: M.token_cost(*_usage(v)),
    "author_stats": lambda v: M.author_stats(v.posts),
    "engagement_rank": lambda v: M.engagement_rank(v.posts, 60).select("id", "engagement", F.col("rank").cast("long").alias("rank"), "chunk"),
    "evidence_filter": lambda v: M.evidence_filter(_items(v)).select("id", "title"),
    "evidence_dropped": lambda v: M.evidence_dropped(_items(v)),
    "evidence_filter_stats": lambda v: M.evidence_filter_stats(_items(v)),
}
QUERIES = {k: (lambda spark, sf, f=f: f(Views(spark, sf))) for k, f in _Q.items()}

_R4 = lambda a, b, d=4: f"round(coalesce(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0), 0.0), {d})"
_RUNS = """keyed AS (SELECT q.id, p.permalink, coalesce(c.permalink, '__POST_BODY__') AS comment_key, q.severity, q.quoted_text FROM Q q JOIN P p ON p.id = q.post_id LEFT JOIN C c ON c.id = q.comment_id),
a AS (SELECT * FROM keyed WHERE id % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY permalink, comment_key ORDER BY id DESC) = 1),
b AS (SELECT * FROM keyed WHERE id % 3 <> 1 QUALIFY row_number() OVER (PARTITION BY permalink, comment_key ORDER BY id DESC) = 1),
diff AS (SELECT coalesce(a.permalink, b.permalink) AS permalink, coalesce(a.comment_key, b.comment_key) AS comment_key, a.severity AS severity_a, a.quoted_text AS quote_a, b.severity AS severity_b, b.quoted_text AS quote_b,
  CASE WHEN a.id IS NULL THEN 'only_b' WHEN b.id IS NULL THEN 'only_a' ELSE 'common' END AS bucket FROM a FULL JOIN b ON a.permalink = b.permalink AND a.comment_key = b.comment_key)"""
_PAIRS = """pairs AS (SELECT d.decision_id, d.duplicates AS positive, round(1 / (1 + abs(coalesce(a.severity, 5) - coalesce(b.severity, 5)) + abs(a.signal_count - b.signal_count) / 10.0), 6) AS score
  FROM merge_decisions d JOIN painpoints a ON a.id = d.painpoint_a JOIN painpoints b ON b.id = d.painpoint_b WHERE d.duplicates IS NOT NULL)"""
_CONF = lambda h: f"count(*) FILTER ({h} AND positive) AS tp, count(*) FILTER ({h} AND NOT positive) AS fp, count(*) FILTER (NOT {h} AND positive) AS fn, count(*) FILTER (NOT {h} AND NOT positive) AS tn"
_PRF = f"tp, fp, fn, tn, {_R4('tp', '(tp + fp)', 6)} AS precision, {_R4('tp', '(tp + fn)', 6)} AS recall, {_R4('2 * tp', '(2 * tp + fp + fn)', 6)} AS f1"
_KEPT = "'direct_complaint', 'missing_feature', 'broken_experience', 'unmet_need'"
_DROPPED = "'joke_meme_sarcasm', 'self_promotion_showcase', 'praise_only', 'thought_leadership', 'policy_news_grief_inferred', 'abstract_opinion'"
_ITEMS = f"""raw AS (SELECT *, [{_KEPT}, {_DROPPED}, 'maybe_pain'][id % 11 + 1] AS kind FROM Q), items AS (SELECT *, CASE WHEN id % 13 = 0 THEN 'unknown' WHEN kind = 'maybe_pain' THEN 'unknown' ELSE kind END AS label FROM raw)"""
_SHORT = lambda c: f"(SELECT CASE WHEN length(t) > 120 THEN substr(t, 1, 117) || '...' ELSE t END FROM (SELECT trim(regexp_replace(coalesce({c}, ''), '\\s+', ' ', 'g')) AS t))"
_NORM = lambda c: f"trim(lower(regexp_replace(regexp_replace(translate(coalesce({c}, ''), '‘’“”–— ', '''''\"\"-- '), '[*_`]', '', 'g'), '\\s+', ' ', 'g')))"
_STATUS = f"""qq AS (SELECT id, post_id, comment_id, {_NORM('quoted_text')} AS q FROM Q), pp AS (SELECT id, {_NORM("concat_ws(' ', title, selftext)")} AS t FROM P), cc AS (SELECT id, post_id, {_NORM('body')} AS t FROM C),
st AS (SELECT qq.id, CASE WHEN q = '' THEN 'blank' WHEN contains(cc.t, q) OR (qq.comment_id IS NULL AND contains(pp.t, q)) THEN 'attributed' WHEN contains(pp.t, q) THEN 'post'
  WHEN EXISTS (SELECT 1 FROM cc o WHERE o.post_id = qq.post_id AND contains(o.t, q)) THEN 'other_comment' ELSE 'missing' END AS status FROM qq LEFT JOIN pp ON pp.id = qq.post_id LEFT JOIN cc ON cc.id = qq.comment_id)"""

ORACLE = {
    "metrics_totals": "SELECT count(*) AS categories, count(*) FILTER (parent_id IS NULL) AS roots, count(*) FILTER (id NOT IN (SELECT parent_id FROM categories WHERE parent_id IS NOT NULL)) AS leaves, count(*) FILTER (is_seed) AS seed, count(*) FILTER (NOT is_seed) AS runtime FROM categories",
    "metrics_dedup": with_tables(f"SELECT pendings, groups, extras, max_extras, {_R4('extras', '(pendings + extras)')} AS rate FROM (SELECT (SELECT count(*) FROM Q) AS pendings, count(*) AS groups, CAST(coalesce(sum(n), 0) AS BIGINT) AS extras, coalesce(max(n), 0) AS max_extras FROM (SELECT count(*) AS n FROM PX GROUP BY pending_painpoint_id))"),
    "dedup_groups": with_tables("SELECT id, title, (SELECT count(*) FROM PX x WHERE x.pending_painpoint_id = q.id) AS extra_count, (SELECT string_agg(CAST(post_id AS VARCHAR), ',' ORDER BY post_id) FROM PX x WHERE x.pending_painpoint_id = q.id) AS extra_posts FROM Q q WHERE (SELECT count(*) FROM PX x WHERE x.pending_painpoint_id = q.id) >= 1"),
    "metrics_merge": with_tables(f"SELECT linked, painpoints_linked, merged, max_sources, max_signal, painpoints, {_R4('merged', 'painpoints')} AS rate FROM (SELECT CAST(sum(n) AS BIGINT) AS linked, count(*) AS painpoints_linked, count(*) FILTER (n > 1) AS merged, max(n) AS max_sources, (SELECT max(signal_count) FROM painpoints) AS max_signal, (SELECT count(*) FROM painpoints) AS painpoints FROM (SELECT count(*) AS n FROM PS GROUP BY painpoint_id))"),
    "metrics_categorisation": f"SELECT total, uncategorized, in_seed, in_runtime, without, {_R4('uncategorized', 'total')} AS uncategorized_share FROM (SELECT count(*) AS total, count(*) FILTER (category_id = 1) AS uncategorized, count(*) FILTER (is_seed AND category_id <> 1) AS in_seed, count(*) FILTER (NOT is_seed) AS in_runtime, count(*) FILTER (category_id IS NULL) AS without FROM painpoints p LEFT JOIN categories c ON c.id = p.category_id)",
    "metrics_per_subreddit": with_tables("SELECT p.subreddit, count(DISTINCT p.id) AS posts, (SELECT count(*) FROM C c JOIN P x ON x.id = c.post_id WHERE x.subreddit = p.subreddit) AS comments, (SELECT count(DISTINCT q.id) FROM Q q JOIN P x ON x.id = q.post_id WHERE x.subreddit = p.subreddit) AS pendings, (SELECT count(DISTINCT b.painpoint_id) FROM Q q JOIN P x ON x.id = q.post_id JOIN PS b ON b.pending_painpoint_id = q.id WHERE x.subreddit = p.subreddit) AS painpoints FROM P p GROUP BY 1"),
    "metrics_events": f"SELECT event_type, count(*) AS proposed, count(*) FILTER (value >= {ACCEPT}) AS accepted FROM events GROUP BY 1",
    "signal_integrity": with_tables("SELECT p.id, signal_count, (SELECT count(*) FROM PS b WHERE b.painpoint_id = p.id) AS sources FROM painpoints p WHERE signal_count <> (SELECT count(*) FROM PS b WHERE b.painpoint_id = p.id)"),
    "category_rollup": f"WITH RECURSIVE {_TREE}, pairs AS (SELECT id, unnest(ids) AS a FROM tree), n AS (SELECT category_id, count(*) AS n FROM painpoints GROUP BY 1) SELECT c.id, c.name, coalesce((SELECT n FROM n WHERE n.category_id = c.id), 0) AS direct_count, CAST(coalesce((SELECT n FROM n WHERE n.category_id = c.id), 0) + coalesce((SELECT sum(n.n) FROM pairs p JOIN n ON n.category_id = p.id WHERE p.a = c.id AND p.id <> c.id), 0) AS BIGINT) AS total_count FROM categories c",
    "cross_run_diff": with_tables("SELECT * FROM diff", _RUNS),
    "changed_cells": with_tables("SELECT permalink, comment_key, severity_a, severity_b, abs(coalesce(severity_a, 0) - coalesce(severity_b, 0)) AS delta FROM diff WHERE bucket = 'common' AND (coalesce(severity_a, 0) <> coalesce(severity_b, 0) OR quote_a IS DISTINCT FROM quote_b) ORDER BY 5 DESC, 1, 2 LIMIT 40", _RUNS),
    "snapshot_diff": with_tables("SELECT id, title FROM Q WHERE id > (SELECT coalesce(max(id), 0) FROM Q WHERE extracted_at < TIMESTAMP '2024-06-01')"),
    "pair_eval": with_tables(f"SELECT {_PRF}, {_R4('(tp + tn)', '(tp + fp + fn + tn)', 6)} AS accuracy FROM (SELECT {_CONF('score >= 0.5')} FROM pairs)", _PAIRS),
    "threshold_sweep": with_tables(f"SELECT threshold, {_PRF} FROM (SELECT threshold, {_CONF('score >= threshold')} FROM pairs, (SELECT round(0.1 + i * 0.05, 4) AS threshold FROM range(0, 17) t(i)) GROUP BY 1)", _PAIRS),
    "label_distribution": with_tables("SELECT positive, min(score) AS lo, list_sort(list(score))[count(*) // 2 + 1] AS median, max(score) AS hi, count(*) AS n FROM pairs GROUP BY 1", _PAIRS),
    "severity_histogram": with_tables("SELECT CAST(s AS INT) AS severity, (SELECT count(*) FROM Q WHERE severity = s) AS n FROM range(1, 11) t(s)"),
    "severity_moments": with_tables("SELECT count(severity) AS n, round(avg(severity), 6) AS mean, round(stddev_samp(severity), 6) AS stdev FROM Q"),
    "quote_status": with_tables("SELECT * FROM st", _STATUS),
    "quote_status_report": with_tables("SELECT status, count(*) AS n FROM st GROUP BY 1", _STATUS),
    "token_cost": f"WITH u AS (SELECT 'model_' || (user_id % 3) AS model, event_id % 1000 + 200 AS prompt, event_id % 100 AS cached, event_id % 300 AS completion FROM events), p(model, price_in, price_out) AS (VALUES ('model_0', 0.05, 0.40), ('model_1', 0.40, 1.60), ('model_2', 0.10, 0.40)) SELECT model, CAST(sum(prompt) AS BIGINT) AS prompt, CAST(sum(cached) AS BIGINT) AS cached, CAST(sum(completion) AS BIGINT) AS completion, {_R4('sum(cached) * 100', 'sum(prompt)', 2)} AS hit_pct, round(CAST((sum(prompt) * max(price_in) + sum(completion) * max(price_out)) AS DOUBLE) / 1e6, 6) AS cost FROM u JOIN p USING (model) GROUP BY 1",
    "author_stats": with_tables("SELECT author, count(*) AS posts, CAST(sum(score) AS BIGINT) AS score, CAST(sum(num_comments) AS BIGINT) AS comments FROM P WHERE author IS NOT NULL AND trim(author) <> '' AND author <> '[deleted]' GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 10"),
    "engagement_rank": with_tables("SELECT id, engagement, rank, (rank - 1) // 25 AS chunk FROM (SELECT id, CAST(coalesce(num_comments, 0) + floor(coalesce(score, 0) / 5) AS BIGINT) AS engagement, row_number() OVER (ORDER BY CAST(coalesce(num_comments, 0) + floor(coalesce(score, 0) / 5) AS BIGINT) DESC, id) AS rank FROM P) WHERE rank <= 60"),
    "evidence_filter": with_tables(f"SELECT id, title FROM items WHERE label IN ({_KEPT})", _ITEMS),
    "evidence_filter_stats": with_tables(f"SELECT label, count(*) AS n, label IN ({_KEPT}) AS kept FROM items GROUP BY 1", _ITEMS),
    "evidence_dropped": with_tables(f"SELECT id, label AS evidence_type, post_id, comment_id, {_SHORT('title')} AS title, {_SHORT('quoted_text')} AS quoted_text FROM items WHERE label NOT IN ({_KEPT})", _ITEMS),
}

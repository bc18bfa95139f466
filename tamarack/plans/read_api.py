"""Queries of the read API."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapter import Views, with_tables
from ..operators import read_api as R
from ..sources.listing import rank_all

SUB = "tinyshopfloor"
TEXT_BODY = "quoted_text IS NOT NULL AND trim(quoted_text) <> ''"


def _cand(v: Views, category=None):
    return R.opportunity_candidates(v.sources, v.bridge, v.pendings, v.posts, v.painpoints, v.categories, category)


def _split(v: Views):
    return R.evidence_split(R.top_candidates(_cand(v), 3), v.bridge, v.pendings, v.posts, v.comments)


def _tiers(v: Views):
    split = R.evidence_split(_cand(v), v.bridge, v.pendings, v.posts, v.comments).where("is_local")
    best = lambda kind: F.coalesce(F.max(F.when(F.col("source_type") == kind, F.col("source_score"))), F.lit(0))
    top = split.groupBy("painpoint_id", "requested_subreddit").agg(best("post").alias("best_post"), best("comment").alias("best_comment"))
    c = _cand(v).join(top, ["painpoint_id", "requested_subreddit"])
    tier = R.conviction_tier(F.col("local_signal_count"), F.col("severity_max"), F.col("best_post"), F.col("best_comment"))
    return c.select("painpoint_id", "requested_subreddit", tier.alias("tier"), "best_post", "best_comment")


_Q = {
    "fetch_by_ids": lambda v: R.fetch_by_ids(v.posts, [1, 5, 9, 13]).select("id", "reddit_id", "subreddit", "score", "num_comments"),
    "post_comments": lambda v: R.comments_of_post(v.comments, 1).select("id", "author", "score", "body"),
    "root_categories": lambda v: v.categories.where(F.col("parent_id").isNull()).select("id", "name"),
    "painpoint_lookup": lambda v: R.with_category(R.lookup(v.painpoints, "id", 7), v.categories).select("id", "title", "severity", "signal_count", "category"),
    "top_painpoints": lambda v: R.top_painpoints(v.painpoints, v.categories, 50).select("id", "title", "signal_count", "severity", "category"),
    "painpoints_by_category": lambda v: R.painpoints_in_category(v.painpoints, v.categories, "Uncategorized", 50).select("id", "title", "signal_count", "category"),
    "painpoints_by_subreddit": lambda v: R.painpoints_in_subreddit(v.painpoints, v.bridge, v.pendings, v.posts, SUB, 50).select("id", "title", "signal_count", "evidence_count"),
    "painpoint_evidence": lambda v: R.evidence(v.bridge, v.pendings, v.posts, v.comments, v.categories).drop("post_body", "comment_body"),
    "painpoint_evidence_page": lambda v: R.evidence_page(R.evidence(v.bridge, v.pendings, v.posts, v.comments, v.categories), 2).select("painpoint_id", "pending_id", F.col("rank").cast("long").alias("rank"), "total_count", "truncated"),
    "global_stats": lambda v: R.global_stats(v.posts, v.comments, v.pendings, v.painpoints, v.categories, v.bridge),
    "subreddit_summary": lambda v: R.subreddit_summary(v.posts, v.comments, v.pendings, v.bridge),
    "subreddit_top_categories": lambda v: R.subreddit_top_categories(v.posts, v.pendings, v.bridge, v.categories).select("subreddit", "category", "painpoint_count", F.col("rank").cast("long").alias("rank")),
    "category_paths": lambda v: R.category_paths(v.categories),
    "category_hierarchy_order": lambda v: rank_all(R.category_paths(v.categories), [F.col("group_name").asc_nulls_last(), F.col("is_root").desc(), F.col("name").asc_nulls_last(), F.col("id")]).select("id", "group_name", "is_root", "name", "rank"),
    "leaf_categories": lambda v: R.leaf_categories(v.categories).select("id", "name"),
    "unmerged_pendings": lambda v: R.unmerged(v.pendings, v.bridge).select("id", "title"),
    "unextracted_posts": lambda v: R.unextracted(v.posts, v.pendings).select("id", "reddit_id"),
    "missing_anchor_categories": lambda v: v.categories.join(v.vectors.select(F.col("vec_id").alias("id")), "id", "left_anti").select("id", "name"),
    "all_sources_union": lambda v: v.sources,
    "validated_pendings": lambda v: R.validate(v.pendings, v.posts, v.comments).select("id", "post_id", "comment_id", "severity"),
    "pending_listing": lambda v: R.pending_listing(v.pendings, v.posts, SUB, 100).select("id", "title", "subreddit"),
    "opportunity_candidates": lambda v: _cand(v),
    "opportunity_candidates_by_category": lambda v: R.top_candidates(_cand(v, "Uncategorized"), 5).select("requested_subreddit", "painpoint_id", "local_signal_count", F.col("rank").cast("long").alias("rank")),
    "opportunity_evidence_split": lambda v: _split(v).withColumn("rank", F.col("rank").cast("long")),
    "opportunity_packs": lambda v: R.packs(R.top_candidates(_cand(v), 3), _split(v)).select("painpoint_id", "requested_subreddit", F.array_join("subreddits_seen", ",").alias("seen"), "evidence_strength.local_quote_count", "evidence_strength.cross_subreddit_quote_count", F.array_join(F.transform("local_quotes", lambda q: q.url), " ").alias("local_urls")),
    "conviction_tiers": _tiers,
}
QUERIES = {k: (lambda spark, sf, f=f: f(Views(spark, sf))) for k, f in _Q.items()}

_CAND = f"""rows AS (SELECT b.painpoint_id, p.subreddit, q.severity FROM PS b JOIN S s USING (pending_painpoint_id) JOIN P p ON p.id = s.post_id JOIN Q q ON q.id = b.pending_painpoint_id),
per_sub AS (SELECT painpoint_id, subreddit, count(*) AS here FROM rows GROUP BY ALL),
per_pp AS (SELECT painpoint_id, count(*) AS everywhere, min(severity) AS lo, max(severity) AS hi, array_to_string(list_sort(list_distinct(list(subreddit))), ',') AS seen FROM rows GROUP BY ALL),
backed AS (SELECT DISTINCT b.painpoint_id FROM Q q JOIN PS b ON b.pending_painpoint_id = q.id SEMI JOIN P p ON p.id = q.post_id WHERE {TEXT_BODY}),
cand AS (SELECT x.painpoint_id, pp.title, pp.description, pp.severity, pp.signal_count, c.name AS category, x.here AS local_signal_count, y.everywhere AS global_signal_count,
  y.lo AS severity_min, y.hi AS severity_max, y.seen AS subreddits_seen, x.subreddit AS requested_subreddit
  FROM per_sub x JOIN per_pp y USING (painpoint_id) JOIN backed USING (painpoint_id) JOIN painpoints pp ON pp.id = x.painpoint_id LEFT JOIN categories c ON c.id = pp.category_id)"""
_ORDER = "local_signal_count DESC, global_signal_count DESC, signal_count DESC NULLS LAST, severity DESC NULLS LAST, painpoint_id"
_RANKED = f"ranked AS (SELECT *, row_number() OVER (PARTITION BY requested_subreddit ORDER BY {_ORDER}) AS rank FROM cand)"


def _quotes(source: str) -> str:
    return f"""quotes AS (
  SELECT c0.painpoint_id, c0.requested_subreddit, p.subreddit = c0.requested_subreddit AS is_local, q.id AS pending_painpoint_id, q.quoted_text, q.severity AS quote_severity, p.subreddit AS quote_subreddit,
    p.score AS post_score, c.score AS comment_score, coalesce(c.permalink <> '', false) AS from_comment, CASE WHEN coalesce(c.permalink <> '', false) THEN c.permalink ELSE coalesce(p.permalink, '') END AS link
  FROM {source} c0 JOIN PS b ON b.painpoint_id = c0.painpoint_id JOIN Q q ON q.id = b.pending_painpoint_id AND {TEXT_BODY} JOIN P p ON p.id = q.post_id LEFT JOIN C c ON c.id = q.comment_id),
split AS (
  SELECT painpoint_id, requested_subreddit, is_local, row_number() OVER (PARTITION BY painpoint_id, requested_subreddit, is_local ORDER BY post_score DESC NULLS LAST, coalesce(comment_score, -1) DESC, pending_painpoint_id) AS rank,
    pending_painpoint_id, quoted_text, quote_severity, quote_subreddit, CASE WHEN from_comment THEN 'comment' ELSE 'post' END AS source_type, CASE WHEN from_comment THEN comment_score ELSE post_score END AS source_score,
    CASE WHEN link LIKE 'http%' THEN link WHEN link LIKE '/%' THEN 'https://reddit.com' || link ELSE 'https://reddit.com/' || link END AS url
  FROM quotes WHERE link <> '' QUALIFY rank <= 10)"""


_EV = """ev AS (SELECT b.painpoint_id, q.id AS pending_id, q.title AS pending_title, q.description AS pending_description, q.quoted_text, q.severity AS pending_severity, q.extracted_at, p.subreddit, p.title AS post_title, p.score AS post_score,
  p.permalink AS post_permalink, p.created_utc AS post_created_utc, c.score AS comment_score, c.permalink AS comment_permalink, k.name AS category_name
  FROM PS b JOIN Q q ON q.id = b.pending_painpoint_id JOIN P p ON p.id = q.post_id LEFT JOIN C c ON c.id = q.comment_id LEFT JOIN categories k ON k.id = q.category_id)"""
_TOP3 = "top3 AS (SELECT * FROM ranked WHERE rank <= 3)"

ORACLE = {
    "fetch_by_ids": with_tables("SELECT id, reddit_id, subreddit, score, num_comments FROM P WHERE id IN (1, 5, 9, 13)"),
    "post_comments": with_tables("SELECT id, author, score, body FROM C WHERE post_id = 1"),
    "root_categories": "SELECT id, name FROM categories WHERE parent_id IS NULL",
    "painpoint_lookup": "SELECT p.id, title, severity, signal_count, c.name AS category FROM painpoints p LEFT JOIN categories c ON c.id = p.category_id WHERE p.id = 7",
    "top_painpoints": "SELECT p.id, title, signal_count, severity, c.name AS category FROM painpoints p LEFT JOIN categories c ON c.id = p.category_id ORDER BY signal_count DESC, severity DESC NULLS LAST, p.id LIMIT 50",
    "painpoints_by_category": "SELECT p.id, title, signal_count, c.name AS category FROM painpoints p JOIN categories c ON c.id = p.category_id AND c.name = 'Uncategorized' ORDER BY signal_count DESC, severity DESC NULLS LAST, p.id LIMIT 50",
    "painpoints_by_subreddit": with_tables(f"SELECT pp.id, pp.title, pp.signal_count, count(DISTINCT q.id) AS evidence_count FROM painpoints pp JOIN PS b ON b.painpoint_id = pp.id JOIN Q q ON q.id = b.pending_painpoint_id JOIN P p ON p.id = q.post_id WHERE p.subreddit = '{SUB}' GROUP BY 1, 2, 3 ORDER BY 4 DESC, 3 DESC, 1 LIMIT 50"),
    "painpoint_evidence": with_tables("SELECT * FROM ev", _EV),
    "painpoint_evidence_page": with_tables("SELECT painpoint_id, pending_id, row_number() OVER (PARTITION BY painpoint_id ORDER BY post_score DESC NULLS LAST, pending_id) AS rank, count(*) OVER (PARTITION BY painpoint_id) AS total_count, count(*) OVER (PARTITION BY painpoint_id) > 2 AS truncated FROM ev QUALIFY rank <= 2", _EV),
    "global_stats": with_tables("SELECT (SELECT count(*) FROM P) AS posts, (SELECT count(*) FROM C) AS comments, (SELECT count(*) FROM Q) AS pending_painpoints, (SELECT count(*) FROM painpoints) AS painpoints, (SELECT count(*) FROM categories) AS categories, (SELECT count(DISTINCT id) FROM Q WHERE id NOT IN (SELECT pending_painpoint_id FROM PS)) AS unmerged_pending, (SELECT count(DISTINCT subreddit) FROM P) AS subreddits"),
    "subreddit_summary": with_tables("SELECT p.subreddit, count(DISTINCT p.id) AS post_count, count(c.id) AS comment_count, (SELECT count(DISTINCT b.painpoint_id) FROM PS b JOIN Q q ON q.id = b.pending_painpoint_id JOIN P x ON x.id = q.post_id WHERE x.subreddit = p.subreddit) AS painpoint_count FROM P p LEFT JOIN C c ON c.post_id = p.id GROUP BY p.subreddit"),
    "subreddit_top_categories": with_tables("SELECT *, row_number() OVER (PARTITION BY subreddit ORDER BY painpoint_count DESC, category) AS rank FROM (SELECT p.subreddit, k.name AS category, count(DISTINCT b.painpoint_id) AS painpoint_count FROM PS b JOIN Q q ON q.id = b.pending_painpoint_id JOIN P p ON p.id = q.post_id JOIN categories k ON k.id = q.category_id GROUP BY 1, 2) QUALIFY rank <= 10"),
    "category_paths": "SELECT c.id, c.name, p.name AS parent_name, concat_ws(' > ', p.name, c.name) AS path, coalesce(p.name, c.name) AS group_name, c.parent_id IS NULL AS is_root FROM categories c LEFT JOIN categories p ON p.id = c.parent_id",
    "category_hierarchy_order": "SELECT id, group_name, is_root, name, row_number() OVER (ORDER BY group_name NULLS LAST, is_root DESC, name NULLS LAST, id) AS rank FROM (SELECT c.id, coalesce(p.name, c.name) AS group_name, c.parent_id IS NULL AS is_root, c.name FROM categories c LEFT JOIN categories p ON p.id = c.parent_id)",
    "leaf_categories": "SELECT id, name FROM categories c WHERE NOT EXISTS (SELECT 1 FROM categories k WHERE k.parent_id = c.id)",
    "unmerged_pendings": with_tables("SELECT q.id, q.title FROM Q q LEFT JOIN PS b ON b.pending_painpoint_id = q.id WHERE b.painpoint_id IS NULL"),
    "unextracted_posts": with_tables("SELECT id, reddit_id FROM P WHERE id NOT IN (SELECT post_id FROM Q WHERE post_id IS NOT NULL)"),
    "missing_anchor_categories": "SELECT id, name FROM categories WHERE id NOT IN (SELECT vec_id FROM embeddings)",
    "all_sources_union": with_tables("SELECT * FROM S"),
    "validated_pendings": with_tables("SELECT q.id, q.post_id, CASE WHEN q.comment_id IN (SELECT id FROM C) THEN q.comment_id END AS comment_id, CASE WHEN q.severity IS NOT NULL THEN CAST(greatest(1, least(10, q.severity)) AS INT) END AS severity FROM Q q WHERE q.post_id IN (SELECT id FROM P)"),
    "pending_listing": with_tables(f"SELECT q.id, q.title, p.subreddit FROM Q q JOIN P p ON p.id = q.post_id WHERE p.subreddit = '{SUB}' AND q.id > 100"),
    "opportunity_candidates": with_tables("SELECT * FROM cand", _CAND),
    "opportunity_candidates_by_category": with_tables("SELECT requested_subreddit, painpoint_id, local_signal_count, rank FROM (SELECT *, row_number() OVER (PARTITION BY requested_subreddit ORDER BY " + _ORDER + ") AS rank FROM cand WHERE category = 'Uncategorized') WHERE rank <= 5", _CAND),
    "opportunity_evidence_split": with_tables("SELECT * FROM split", f"{_CAND}, {_RANKED}, {_TOP3}, {_quotes('top3')}"),
    "opportunity_packs": with_tables("SELECT c.painpoint_id, c.requested_subreddit, c.subreddits_seen AS seen, CAST(count(*) FILTER (is_local) AS INT) AS local_quote_count, CAST(count(*) FILTER (NOT is_local) AS INT) AS cross_subreddit_quote_count, coalesce(string_agg(url, ' ' ORDER BY s.rank) FILTER (is_local), '') AS local_urls FROM top3 c JOIN split s USING (painpoint_id, requested_subreddit) GROUP BY 1, 2, 3", f"{_CAND}, {_RANKED}, {_TOP3}, {_quotes('top3')}"),
    "conviction_tiers": with_tables("SELECT painpoint_id, requested_subreddit, CASE WHEN local_signal_count >= 3 AND severity_max >= 5 AND (best_post >= 100 OR best_comment >= 50) THEN 'highest' WHEN local_signal_count >= 2 THEN 'strong' ELSE 'exploratory' END AS tier, best_post, best_comment FROM cand JOIN (SELECT painpoint_id, requested_subreddit, coalesce(max(source_score) FILTER (source_type = 'post'), 0) AS best_post, coalesce(max(source_score) FILTER (source_type = 'comment'), 0) AS best_comment FROM split WHERE is_local GROUP BY 1, 2) USING (painpoint_id, requested_subreddit)", f"{_CAND}, {_quotes('cand')}"),
}

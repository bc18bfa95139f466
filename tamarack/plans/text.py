"""Queries of scalar text functions, listings and writes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import constants as K
from ..adapter import Views, with_tables
from ..functions import text as T
from ..sources import listing as L

_Q = {
    "normalize_subreddit": lambda v: v.raw("evidence_packs").select("pack_id", T.normalize_subreddit(F.col("requested_subreddit")).alias("sub")).distinct(),
    "permalink_normalise": lambda v: v.posts.select("id", T.absolute_permalink(F.col("permalink")).alias("stored"), T.evidence_url(F.col("permalink")).alias("shown")),
    "tokenize": lambda v: v.categories.select("id", F.array_join(T.search_tokens(F.concat_ws(" ", "name", "description")), " ").alias("tokens"), T.or_query(T.search_tokens(F.col("name"))).alias("query")),
    "text_normalise": lambda v: v.pendings.select("id", T.normalize_quote(F.col("quoted_text")).alias("norm")),
    "special_tokens": lambda v: v.pendings.select("id", F.array_join(T.special_tokens(F.coalesce("description", F.lit(""))), "|").alias("tokens")),
    "compact_text": lambda v: v.raw("documents").select("doc_id", T.compact(F.col("text")).alias("short"), T.compact(F.col("text"), 60, "…").alias("shorter")),
    "slugify": lambda v: v.categories.select("id", T.slug(F.col("name")).alias("slug")),
    "anchor_text": lambda v: v.categories.select("id", T.anchor_text(F.col("name"), F.col("description")).alias("anchor")),
    "csv_set": lambda v: v.categories.select("id", F.array_join(T.csv_set(F.col("description")), "|").alias("parts")),
    "parent_resolver": lambda v: _resolver(v),
    "token_estimate": lambda v: L.token_totals(v.posts, v.comments),
    "relevance": lambda v: _relevance(v),
    "epoch_text": lambda v: v.posts.select("id", T.epoch_minute(F.col("created_utc")).alias("minute")),
    "retry_after": lambda v: v.raw("events").select("event_id", T.retry_after(F.concat(F.lit("try again in "), F.col("user_id").cast("string"), F.when(F.col("event_id") % 2 == 0, "ms").otherwise("s"))).alias("seconds")),
    "delta_text": lambda v: v.painpoints.select("id", T.delta_text(F.col("severity").cast("int"), F.col("signal_count").cast("int")).alias("delta")),
    "leftover_json": lambda v: v.posts.select("id", F.get_json_object("extra", "$.via").alias("via"), F.get_json_object("extra", "$.gilded").cast("long").alias("gilded")),
    "unique_texts": lambda v: v.pendings.groupBy(T.anchor_text(F.col("title"), F.col("description")).alias("text")).agg(F.count("*").alias("n"), F.min("id").alias("first_id")),
    "instructions": lambda v: v.categories.select("id", F.concat(F.lit("- "), F.coalesce("name", F.lit("Uncategorized")), F.lit(": "), F.coalesce(F.nullif(F.trim("description"), F.lit("")), F.lit("(no description)"))).alias("line")),
    "render_post": lambda v: L.render(v.posts, v.comments).select("id", F.md5("rendered").alias("digest"), F.length("rendered").cast("long").alias("n")),
    "parse_posts": lambda v: L.parse_posts(v.raw("posts")).distinct(),
    "dedup_and_rank": lambda v: L.dedup_and_rank(_windows(v)).select("id", F.col("rank").cast("long").alias("rank"), "engagement"),
    "comment_targets": lambda v: L.comment_targets(L.dedup_and_rank(_windows(v)), 5, 60).select("id", "score"),
    "post_comments_topn": lambda v: L.top_comments(v.comments, K.PER_POST).select("post_id", "id", F.col("rank").cast("long").alias("rank")),
    "search_posts": lambda v: L.search(v.posts, "spreadsheet", 30).select("id", "score"),
    "insert_if_absent_posts": lambda v: L.insert_if_absent(v.posts.where("id % 2 = 0"), v.raw("posts"), "reddit_id", "fetched_at", "score").select("id", "score"),
    "id_map": lambda v: v.comments.where("parent_reddit_id like 't3_%'").join(v.posts.select(F.col("reddit_id").alias("parent_reddit_id"), F.col("id").alias("parent_id")), "parent_reddit_id").select("id", "parent_id"),
    "distinct_subreddits": lambda v: v.posts.select("subreddit").distinct(),
    "event_windows": lambda v: v.raw("events").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total"),
    "max_ids": lambda v: v.posts.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).join(v.pendings.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top_pending"))),
    "comment_threads": lambda v: L.thread_depths(v.comments),
    "trending": lambda v: L.trending(v.posts, 15),
}


def _relevance(v: Views):
    """Each source of each observation, in a post or a comment, at the time of the newest post."""
    now = v.posts.agg(F.max("created_utc").alias("now"))  # one row
    p = v.posts.select(F.col("id").alias("post_id"), F.col("score").alias("ps"), "num_comments", F.col("created_utc").alias("pc"))
    c = v.comments.select(F.col("id").alias("comment_id"), F.lit(True).alias("known"), F.col("score").alias("cs"), F.col("created_utc").alias("cc"))
    s = v.sources.join(p, "post_id").join(c, "comment_id", "left").join(F.broadcast(now))
    r = T.relevance(F.col("ps"), F.col("num_comments"), F.col("pc"), F.col("now"), K.HALF_LIFE_DAYS, F.col("known"), F.col("cs"), F.col("cc"))
    return s.select("pending_painpoint_id", "post_id", "comment_id", F.round(r, 6).alias("relevance"))


def _resolver(v: Views):
    c = v.categories.select("id", "name")
    wanted = c.select("id", F.concat(F.lit("Any > "), "name").alias("path"))
    known = c.select(F.col("name").alias("parent"), F.col("id").alias("parent_id"))
    return wanted.withColumn("parent", T.parent_name(F.col("path"))).join(known, "parent", "left").select("id", "parent", "parent_id")


def _windows(v: Views):
    """The three listing windows, in the order in which a post's first row stands."""
    w = F.get_json_object("extra", "$.window")
    at = F.when(w == "week", 0).when(w == "month", 1).when(w == "year", 2)
    return v.raw("posts").withColumn("window_no", at).where("window_no is not null")


QUERIES = {k: (lambda spark, sf, f=f: f(Views(spark, sf))) for k, f in _Q.items()}

_TOK = lambda c: f"list_filter(string_split_regex(lower(coalesce({c}, '')), '[^a-z0-9]+'), lambda t: length(t) >= 2 AND t NOT IN ('and', 'or', 'not', 'near'))"
_UNIQ = lambda l: f"list_filter({l}, lambda x, i: list_position({l}, x) = i)"
_COMP = lambda c, n, m: f"CASE WHEN length({c}) > {n} THEN substr({c}, 1, {n} - {len(m)}) || '{m}' ELSE {c} END"
_ANCHOR = lambda n, d: f"CASE WHEN trim(trim(coalesce({n}, '')) || ' ' || trim(coalesce({d}, ''))) = '' THEN '__empty__' ELSE trim(trim(coalesce({n}, '')) || ' ' || trim(coalesce({d}, ''))) END"
_WIN = """w AS (SELECT *, CASE json_extract_string(extra, '$.window') WHEN 'week' THEN 0 WHEN 'month' THEN 1 WHEN 'year' THEN 2 END AS window_no FROM posts),
one AS (SELECT *, coalesce(score, 0) + coalesce(num_comments, 0) AS engagement FROM w WHERE window_no IS NOT NULL QUALIFY row_number() OVER (PARTITION BY reddit_id ORDER BY window_no, fetched_at, score) = 1),
r AS (SELECT *, row_number() OVER (ORDER BY engagement DESC, id) AS rank FROM one)"""
_RENDER = """r AS (SELECT p.id, concat('# ', coalesce(p.title, ''), chr(10), coalesce(p.selftext, ''), coalesce((SELECT string_agg(chr(10) || '- [' || CAST(c.score AS VARCHAR) || '] ' || coalesce(c.body, ''), '' ORDER BY c.score DESC, c.id) FROM C c WHERE c.post_id = p.id), '')) AS rendered FROM P p)"""

ORACLE = {
    "normalize_subreddit": "SELECT DISTINCT pack_id, lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(requested_subreddit, '^\\s+|\\s+$', '', 'g'), '^r/', ''), '^/r/', ''), '^/+|/+$', '', 'g')) AS sub FROM evidence_packs",
    "permalink_normalise": with_tables("SELECT id, CASE WHEN coalesce(permalink, '') = '' OR permalink LIKE 'http%' THEN coalesce(permalink, '') ELSE 'https://reddit.com' || permalink END AS stored, CASE WHEN coalesce(permalink, '') = '' OR permalink LIKE 'http%' THEN coalesce(permalink, '') WHEN permalink LIKE '/%' THEN 'https://reddit.com' || permalink ELSE 'https://reddit.com/' || permalink END AS shown FROM P"),
    "tokenize": f"SELECT id, array_to_string({_UNIQ('t')}, ' ') AS tokens, array_to_string({_UNIQ('n')}, ' OR ') AS query FROM (SELECT id, {_TOK('concat_ws(chr(32), name, description)')} AS t, {_TOK('name')} AS n FROM categories)",
    "text_normalise": with_tables("SELECT id, trim(lower(regexp_replace(regexp_replace(translate(quoted_text, '‘’“”–— ', '''''\"\"-- '), '[*_`]', '', 'g'), '\\s+', ' ', 'g'))) AS norm FROM Q"),
    "special_tokens": with_tables("SELECT id, array_to_string(regexp_extract_all(coalesce(description, ''), '([$€£][0-9][0-9,.]*|[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]+(?:[.,][0-9]+)*%?|\\b[A-Z][a-zA-Z]+\\b)', 1), '|') AS tokens FROM Q"),
    "compact_text": f"SELECT doc_id, {_COMP('t', 120, '...')} AS short, {_COMP('t', 60, '…')} AS shorter FROM (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS t FROM documents)",
    "slugify": "SELECT id, lower(regexp_replace(name, '[^A-Za-z0-9]', '_', 'g')) AS slug FROM categories",
    "anchor_text": f"SELECT id, {_ANCHOR('name', 'description')} AS anchor FROM categories",
    "csv_set": "SELECT id, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(coalesce(description, ''), ','), lambda x: trim(x)), lambda x: x <> ''))), '|') AS parts FROM categories",
    "parent_resolver": "SELECT c.id, trim(c.name) AS parent, k.id AS parent_id FROM categories c LEFT JOIN categories k ON k.name = trim(c.name)",
    "token_estimate": with_tables("SELECT p.id, CAST(greatest(1, (length(coalesce(title, '')) + length(coalesce(selftext, '')) + coalesce((SELECT sum(length(coalesce(body, ''))) FROM C c WHERE c.post_id = p.id), 0)) // 4) AS BIGINT) AS tokens FROM P p"),
    "relevance": with_tables("""SELECT pending_painpoint_id, post_id, comment_id, round(traction * CASE WHEN since IS NULL THEN 1 ELSE pow(0.5, greatest(0, now - since) / 86400 / 14) END, 6) AS relevance
  FROM (SELECT s.*, CASE WHEN c.id IS NULL THEN ln(1 + greatest(0, coalesce(p.score, 0))) / 2 + ln(1 + greatest(0, coalesce(p.num_comments, 0))) * 0.8 ELSE ln(1 + greatest(0, coalesce(c.score, 0))) / 2 END AS traction,
    coalesce(nullif(c.created_utc, 0), p.created_utc) AS since, (SELECT max(created_utc) FROM P) AS now FROM S s JOIN P p ON p.id = s.post_id LEFT JOIN C c ON c.id = s.comment_id)"""),
    "epoch_text": with_tables("SELECT id, strftime(make_timestamp(CAST(floor(created_utc) AS BIGINT) * 1000000), '%Y-%m-%d %H:%M') AS minute FROM P"),
    "retry_after": "SELECT event_id, user_id / CASE WHEN event_id % 2 = 0 THEN 1000.0 ELSE 1.0 END AS seconds FROM events",
    "delta_text": "SELECT id, CASE WHEN d >= 0 THEN '+' ELSE '-' END || abs(d) || CASE WHEN severity <> 0 THEN ' (' || CASE WHEN d / severity >= 0 THEN '+' ELSE '-' END || format('{:.1f}', abs(d / severity) * 100) || '%)' ELSE '' END AS delta FROM (SELECT id, severity, signal_count - severity AS d FROM painpoints)",
    "leftover_json": with_tables("SELECT id, json_extract_string(extra, '$.via') AS via, CAST(json_extract_string(extra, '$.gilded') AS BIGINT) AS gilded FROM P"),
    "unique_texts": with_tables(f"SELECT {_ANCHOR('title', 'description')} AS text, count(*) AS n, min(id) AS first_id FROM Q GROUP BY 1"),
    "instructions": "SELECT id, '- ' || coalesce(name, 'Uncategorized') || ': ' || coalesce(nullif(trim(description), ''), '(no description)') AS line FROM categories",
    "render_post": with_tables("SELECT id, md5(rendered) AS digest, length(rendered) AS n FROM r", _RENDER),
    "parse_posts": "SELECT DISTINCT reddit_id, substr(coalesce(selftext, ''), 1, 10000) AS selftext, CASE WHEN coalesce(permalink, '') = '' OR permalink LIKE 'http%' THEN coalesce(permalink, '') ELSE 'https://reddit.com' || permalink END AS permalink, coalesce(is_self, false) AS is_self, coalesce(score, 0) AS score FROM posts WHERE NOT coalesce(stickied, false)",
    "dedup_and_rank": f"WITH {_WIN} SELECT id, rank, CAST(engagement AS BIGINT) AS engagement FROM r",
    "comment_targets": f"WITH {_WIN} SELECT id, score FROM r WHERE score >= 5 ORDER BY rank LIMIT 60",
    "post_comments_topn": with_tables("SELECT post_id, id, row_number() OVER (PARTITION BY post_id ORDER BY score DESC NULLS LAST, id) AS rank FROM C QUALIFY rank <= 25"),
    "search_posts": with_tables("SELECT id, score FROM P WHERE (title ILIKE '%spreadsheet%' OR selftext ILIKE '%spreadsheet%') AND NOT coalesce(stickied, false) ORDER BY score DESC NULLS LAST, id LIMIT 30"),
    "insert_if_absent_posts": with_tables("SELECT id, score FROM P"),
    "id_map": with_tables("SELECT c.id, p.id AS parent_id FROM C c JOIN P p ON p.reddit_id = c.parent_reddit_id WHERE c.parent_reddit_id LIKE 't3_%'"),
    "distinct_subreddits": with_tables("SELECT DISTINCT subreddit FROM P"),
    "event_windows": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "max_ids": with_tables("SELECT (SELECT max(id) FROM P) AS top, (SELECT max(id) FROM Q) AS top_pending"),
    "comment_threads": with_tables("SELECT post_id, count(*) AS comments, CAST(max(depth) AS BIGINT) AS deepest, count(*) FILTER (parent_reddit_id LIKE 't3_%') AS direct_replies FROM C WHERE post_id IS NOT NULL GROUP BY 1"),
    "trending": with_tables("SELECT subreddit, count(*) AS posts, round(sum(num_comments) / count(*), 2) AS rate FROM P GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15"),
}

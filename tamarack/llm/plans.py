"""Queries of the llm problems and, where SQL can state them, the same in plain SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import canonical_subreddit
from ..session import Scratch, table
from . import clusters, components, leaks, mixing, pii, quality, topn, truncation


def _personal_texts(spark: SparkSession, sf: str) -> DataFrame:
    parts = (("posts", "selftext"), ("comments", "body"), ("pending_painpoints", "quoted_text"))
    return reduce(DataFrame.unionByName, (table(spark, sf, t).select(F.lit(t).alias("tab"), F.col("id").alias("row_id"), F.col(c).alias("text")) for t, c in parts))


def _pii_key(spark: SparkSession) -> bytes:
    """The secret that keys the surrogates: the session's tamarack.pii.key; these queries on test tables do with a fixed one."""
    return spark.conf.get("tamarack.pii.key", "for test tables only").encode()


def p1_redacted(spark: SparkSession, sf: str) -> DataFrame:
    return pii.redact(_personal_texts(spark, sf), _pii_key(spark)).withColumn("kinds", F.array_join("kinds", ","))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """The kinds of the finds that the replacement replaced."""
    out = pii.redact(_personal_texts(spark, sf), _pii_key(spark))
    return out.where("surrogate is not null").select("tab", "row_id", F.explode("kinds").alias("kind")).distinct()


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    links = table(spark, sf, "merge_decisions").where("duplicates")
    return components.connected_components(links, "painpoint_a", "painpoint_b").select(F.col("id").alias("painpoint_id"), "group_id")


def p3_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Every painpoint with its group: those that nothing links, and ids only named in decisions, are their own."""
    d = table(spark, sf, "merge_decisions")
    ids = table(spark, sf, "painpoints").select("id").unionByName(d.select(F.col("painpoint_a").alias("id"))).unionByName(d.select(F.col("painpoint_b").alias("id"))).where("id is not null").distinct()
    groups = p3_found(spark, sf)
    return ids.join(groups, ids.id == groups.painpoint_id, "left").select(F.col("id").alias("painpoint_id"), F.coalesce("group_id", "id").alias("group_id"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """All pairs within each cluster, the form that the data's description asks for."""
    members = clusters.cluster(table(spark, sf, "pending_painpoints"))[0]
    a, b = members.select(F.col("id").alias("id_a"), "cluster_id"), members.select(F.col("id").alias("id_b"), "cluster_id")
    return a.join(b, "cluster_id").where("id_a < id_b").select("id_a", "id_b")


def p5_clusters(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pending_painpoints")
    return clusters.describe(*clusters.cluster(p), p)


def _top_packs(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "evidence_packs").select(canonical_subreddit(F.col("requested_subreddit")).alias("subreddit"), "pack_id", "evidence_strength.local_signal_count", "evidence_strength.global_signal_count", "built_at")
    return topn.top_n_per_group(p, "subreddit", "pack_id", ("local_signal_count", "global_signal_count"), 5, "built_at")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return _top_packs(spark, sf).select(F.col("grp").alias("subreddit"), F.col("item").alias("pack_id"))


def p6_ranked(spark: SparkSession, sf: str) -> DataFrame:
    return _top_packs(spark, sf).select(F.col("grp").alias("subreddit"), F.col("rank").cast("long").alias("rank"), F.col("item").alias("pack_id"), F.col("s1").alias("local_signal_count"), F.col("s2").alias("global_signal_count"))


def _stored_texts(spark: SparkSession, sf: str) -> DataFrame:
    p, c = table(spark, sf, "posts"), table(spark, sf, "comments")
    return p.select(F.lit("posts").alias("tab"), "id", F.col("selftext").alias("text")).unionByName(c.select(F.lit("comments").alias("tab"), "id", F.col("body").alias("text")))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.find_truncated(_stored_texts(spark, sf)).select("tab", F.col("id").alias("row_id"))


def p7_by_source(spark: SparkSession, sf: str) -> DataFrame:
    p, c = table(spark, sf, "posts"), table(spark, sf, "comments")
    rows = p.select(F.lit("posts").alias("tab"), "id", F.col("id").alias("post_id")).unionByName(c.select(F.lit("comments").alias("tab"), "id", "post_id"))
    sources = p.select(F.col("id").alias("post_id"), F.get_json_object("extra", "$.via").alias("source"))
    return truncation.truncation_by_source(rows, truncation.find_truncated(_stored_texts(spark, sf)), sources)


def p8_leaks(spark: SparkSession, sf: str) -> DataFrame:
    return leaks.find_leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return p8_leaks(spark, sf).where("shared_run").select("doc_id", "item_id").distinct()


def p8_items(spark: SparkSession, sf: str) -> DataFrame:
    """Every item with the number of documents that hold a passage of it, exactly or within the edit budget."""
    hits = p8_leaks(spark, sf).groupBy("item_id").agg(F.countDistinct("doc_id").alias("docs"), F.countDistinct(F.when(F.col("shared_run"), F.col("doc_id"))).alias("docs_exact"))
    items = table(spark, sf, "eval_items").select("item_id", "suite").distinct()
    return items.join(hits, "item_id", "left").na.fill(0, ["docs", "docs_exact"])


def _mix(spark: SparkSession, sf: str):
    tokens = Scratch(spark, "tokens").write(mixing.count_tokens(table(spark, sf, "documents"), mixing.tokenizer_path()))
    return mixing.mix_sources(tokens, table(spark, sf, "mix_plan"))


def p9_mix(spark: SparkSession, sf: str) -> DataFrame:
    return _mix(spark, sf)[0]


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    return _mix(spark, sf)[1]


def p10_stats(spark: SparkSession, sf: str) -> DataFrame:
    return quality.text_statistics(table(spark, sf, "documents"))


def p10_classified(spark: SparkSession, sf: str) -> DataFrame:
    return quality.classify(table(spark, sf, "documents"))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return p10_classified(spark, sf).where("not is_prose").select("doc_id").distinct()


QUERIES = {"p1_found": p1_found, "p1_redacted": p1_redacted, "p3_found": p3_found, "p3_groups": p3_groups, "p5_found": p5_found, "p5_clusters": p5_clusters, "p6_found": p6_found, "p6_ranked": p6_ranked,
           "p7_found": p7_found, "p7_by_source": p7_by_source, "p8_found": p8_found, "p8_leaks": p8_leaks, "p8_items": p8_items, "p10_found": p10_found, "p10_stats": p10_stats, "p10_classified": p10_classified, "p9_mix": p9_mix, "p9_shares": p9_shares}

_LINKS = """links AS (SELECT painpoint_a AS a, painpoint_b AS b FROM merge_decisions WHERE duplicates AND painpoint_a <> painpoint_b),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a AS id, a AS node FROM both_ways UNION SELECT r.id, w.b FROM reach r JOIN both_ways w ON w.a = r.node)"""
_PACKS = """packs AS (
  SELECT pack_id, regexp_replace(regexp_replace(lower(trim(requested_subreddit)), '^/?r/', ''), '^/+|/+$', '', 'g') AS subreddit,
    CAST(coalesce(evidence_strength.local_signal_count, 0) AS BIGINT) AS local_signal_count, CAST(coalesce(evidence_strength.global_signal_count, 0) AS BIGINT) AS global_signal_count
  FROM evidence_packs WHERE requested_subreddit IS NOT NULL QUALIFY row_number() OVER (PARTITION BY pack_id ORDER BY built_at DESC) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY subreddit ORDER BY local_signal_count DESC, global_signal_count DESC, pack_id) AS rank FROM packs)"""

_COMMON = ", ".join(f"'{w}'" for w in dict.fromkeys(quality.COMMON))

ORACLE = {
    "p3_found": f"WITH RECURSIVE {_LINKS} SELECT id AS painpoint_id, min(node) AS group_id FROM reach GROUP BY 1",
    "p3_groups": f"""WITH RECURSIVE {_LINKS}, ids AS (SELECT id FROM painpoints UNION SELECT painpoint_a FROM merge_decisions UNION SELECT painpoint_b FROM merge_decisions)
SELECT i.id AS painpoint_id, coalesce(min(r.node), i.id) AS group_id FROM ids i LEFT JOIN reach r ON r.id = i.id WHERE i.id IS NOT NULL GROUP BY i.id""",
    "p6_found": f"WITH {_PACKS} SELECT subreddit, pack_id FROM ranked WHERE rank <= 5",
    "p6_ranked": f"WITH {_PACKS} SELECT subreddit, rank, pack_id, local_signal_count, global_signal_count FROM ranked WHERE rank <= 5",
    "p8_found": """WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS ws FROM documents WHERE text IS NOT NULL),
d AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 11], ' ') AS run FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 10)) AS i FROM w)),
v AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS ws FROM eval_items WHERE text IS NOT NULL),
e AS (SELECT DISTINCT item_id, array_to_string(ws[i:i + 11], ' ') AS run FROM (SELECT item_id, ws, unnest(range(1, len(ws) - 10)) AS i FROM v))
SELECT DISTINCT doc_id, item_id FROM d JOIN e USING (run)""",
    "p10_stats": f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(lower(t), '[\\p{{L}}\\p{{N}}]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: length(trim(x)) > 0) AS ls FROM d)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS word_count,
  CASE WHEN len(ws) > 0 THEN CAST(list_sum(list_transform(ws, lambda x: length(x))) AS DOUBLE) / len(ws) ELSE 0.0 END AS mean_word_length,
  CASE WHEN length(t) > 0 THEN CAST(length(regexp_replace(t, '[\\p{{L}}\\p{{N}} \\t\\n\\x0B\\f\\r]', '', 'g')) AS DOUBLE) / length(t) ELSE 0.0 END AS symbol_ratio,
  CASE WHEN len(ls) > 0 THEN CAST(len(list_filter(ls, lambda x: regexp_matches(rtrim(x), '[.!?:]["'')\\]]*$'))) AS DOUBLE) / len(ls) ELSE 0.0 END AS punctuated_lines,
  CASE WHEN len(ws) > 0 THEN CAST(len(list_filter(ws, lambda x: x IN ({_COMMON}))) AS DOUBLE) / len(ws) ELSE 0.0 END AS common_words FROM w""",
}

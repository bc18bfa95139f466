"""The typed read queries: lookups, listings, evidence, summaries and opportunity candidates.

All are plain DataFrame plans over tables passed in. Correlated aggregates are one groupBy joined back; EXISTS and NOT
EXISTS are semi and anti joins; every top-N has a unique tie-break. Which side is small is left to the optimiser's sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as T


def has_text(c: Column) -> Column:
    """Not null and not only spaces (spaces alone, as SQL's TRIM)."""
    return c.isNotNull() & (F.trim(c) != "")


def clamp_severity(c: Column) -> Column:
    return F.when(c.isNotNull(), F.greatest(F.lit(1), F.least(F.lit(10), c)))


def lookup(df: DataFrame, key: str, value) -> DataFrame:
    return df.where(F.col(key) == value)


def fetch_by_ids(posts: DataFrame, ids: list[int]) -> DataFrame:
    return posts.where(F.col("id").isin(ids)).orderBy((F.coalesce("score", F.lit(0)) + F.coalesce("num_comments", F.lit(0))).desc(), "id")


def comments_of_post(comments: DataFrame, post_id: int) -> DataFrame:
    return comments.where(F.col("post_id") == post_id).orderBy(F.col("score").desc(), "id")


def with_category(painpoints: DataFrame, categories: DataFrame, how: str = "left") -> DataFrame:
    c = categories.select(F.col("id").alias("category_id"), F.col("name").alias("category"))
    return painpoints.join(c, "category_id", how)


def top_painpoints(painpoints: DataFrame, categories: DataFrame, n: int) -> DataFrame:
    best = painpoints.orderBy(F.col("signal_count").desc(), F.col("severity").desc(), "id").limit(n)
    return with_category(best, categories)


def painpoints_in_category(painpoints: DataFrame, categories: DataFrame, name: str, n: int) -> DataFrame:
    got = with_category(painpoints, categories.where(F.col("name") == name), "inner")
    return got.orderBy(F.col("signal_count").desc(), F.col("severity").desc(), "id").limit(n)


def painpoints_in_subreddit(painpoints: DataFrame, bridge: DataFrame, pendings: DataFrame, posts: DataFrame, subreddit: str, n: int) -> DataFrame:
    """By primary post only; evidence_count counts distinct observations."""
    there = posts.where(F.col("subreddit") == T.py_normalize_subreddit(subreddit)).select(F.col("id").alias("post_id"))
    seen = bridge.join(pendings.select(F.col("id").alias("pending_painpoint_id"), "post_id").distinct(), "pending_painpoint_id").join(there, "post_id", "left_semi")
    count = seen.groupBy("painpoint_id").agg(F.countDistinct("pending_painpoint_id").alias("evidence_count"))
    return painpoints.join(count, painpoints.id == count.painpoint_id).drop("painpoint_id").orderBy(F.col("evidence_count").desc(), F.col("signal_count").desc(), "id").limit(n)


def evidence(bridge: DataFrame, pendings: DataFrame, posts: DataFrame, comments: DataFrame, categories: DataFrame, painpoint_id: int | None = None) -> DataFrame:
    """Observations with post, comment and the observation's own category."""
    b = bridge.where(F.col("painpoint_id") == painpoint_id) if painpoint_id is not None else bridge
    q = pendings.select(F.col("id").alias("pending_painpoint_id"), F.col("title").alias("pending_title"), F.col("description").alias("pending_description"), "quoted_text", F.col("severity").alias("pending_severity"), "extracted_at", "post_id", "comment_id", "category_id")
    p = posts.select(F.col("id").alias("post_id"), "subreddit", F.col("title").alias("post_title"), F.col("selftext").alias("post_body"), F.col("score").alias("post_score"), F.col("permalink").alias("post_permalink"), F.col("created_utc").alias("post_created_utc"))
    c = comments.select(F.col("id").alias("comment_id"), F.col("body").alias("comment_body"), F.col("score").alias("comment_score"), F.col("permalink").alias("comment_permalink"))
    k = categories.select(F.col("id").alias("category_id"), F.col("name").alias("category_name"))
    out = b.join(q, "pending_painpoint_id").join(p, "post_id").join(c, "comment_id", "left").join(k, "category_id", "left")
    return out.select("painpoint_id", F.col("pending_painpoint_id").alias("pending_id"), "pending_title", "pending_description", "quoted_text", "pending_severity", "extracted_at", "subreddit", "post_title", "post_body", "post_score", "post_permalink", "post_created_utc", "comment_body", "comment_score", "comment_permalink", "category_name")


def evidence_page(ev: DataFrame, n: int) -> DataFrame:
    """First n rows of each painpoint by post score, with the total and whether it was cut."""
    w = Window.partitionBy("painpoint_id")
    return ev.withColumn("total_count", F.count("*").over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.col("post_score").desc_nulls_last(), "pending_id"))).where(F.col("rank") <= n).withColumn("truncated", F.col("total_count") > n)


def global_stats(posts: DataFrame, comments: DataFrame, pendings: DataFrame, painpoints: DataFrame, categories: DataFrame, bridge: DataFrame) -> DataFrame:
    """One row of counts, each a separate aggregate of one row."""
    one = lambda df, e, n: df.agg(e.cast("long").alias(n))
    left = pendings.select(F.col("id").alias("pending_painpoint_id")).distinct().join(bridge, "pending_painpoint_id", "left_anti")
    parts = [one(posts, F.count("*"), "posts"), one(comments, F.count("*"), "comments"), one(pendings, F.count("*"), "pending_painpoints"), one(painpoints, F.count("*"), "painpoints"), one(categories, F.count("*"), "categories"), one(left, F.count("*"), "unmerged_pending"), one(posts, F.countDistinct("subreddit"), "subreddits")]
    out = parts[0].withColumn("_", F.lit(1))
    for p in parts[1:]:
        out = out.join(p.withColumn("_", F.lit(1)), "_")
    return out.drop("_")


def subreddit_summary(posts: DataFrame, comments: DataFrame, pendings: DataFrame, bridge: DataFrame) -> DataFrame:
    """post, comment and painpoint counts of every subreddit, each side aggregated before it is joined."""
    p = posts.select("id", "subreddit")
    per_post = comments.groupBy("post_id").agg(F.count("*").alias("n"))
    a = p.join(per_post, p.id == per_post.post_id, "left").groupBy("subreddit").agg(F.count("*").alias("post_count"), F.sum(F.coalesce("n", F.lit(0))).alias("comment_count"))
    q = pendings.select(F.col("id").alias("pending_painpoint_id"), "post_id").distinct()
    b = bridge.join(q, "pending_painpoint_id").join(p, F.col("post_id") == F.col("id")).groupBy("subreddit").agg(F.countDistinct("painpoint_id").alias("painpoint_count"))
    return a.join(b, "subreddit", "left").select("subreddit", "post_count", "comment_count", F.coalesce("painpoint_count", F.lit(0)).alias("painpoint_count"))


def subreddit_top_categories(posts: DataFrame, pendings: DataFrame, bridge: DataFrame, categories: DataFrame, n: int = 10) -> DataFrame:
    q = pendings.select(F.col("id").alias("pending_painpoint_id"), "post_id", "category_id").distinct()
    got = bridge.join(q, "pending_painpoint_id").join(posts.select(F.col("id").alias("post_id"), "subreddit"), "post_id").join(categories.select(F.col("id").alias("category_id"), F.col("name").alias("category")), "category_id")
    per = got.groupBy("subreddit", "category").agg(F.countDistinct("painpoint_id").alias("painpoint_count"))
    w = Window.partitionBy("subreddit").orderBy(F.col("painpoint_count").desc(), "category")
    return per.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def category_paths(categories: DataFrame) -> DataFrame:
    """``Parent > Child``, with the keys of the listing order: parent's or own name, roots first, name."""
    p = categories.select(F.col("id").alias("parent_id"), F.col("name").alias("parent_name"))
    out = categories.join(p, "parent_id", "left")
    return out.select("id", "name", "parent_name", F.concat_ws(" > ", "parent_name", "name").alias("path"), F.coalesce("parent_name", "name").alias("group_name"), F.col("parent_id").isNull().alias("is_root"))


def leaf_categories(categories: DataFrame) -> DataFrame:
    return categories.join(categories.select(F.col("parent_id").alias("id")).where("id is not null"), "id", "left_anti")


def unmerged(pendings: DataFrame, bridge: DataFrame) -> DataFrame:
    return pendings.join(bridge.select(F.col("pending_painpoint_id").alias("id")), "id", "left_anti")


def unextracted(posts: DataFrame, pendings: DataFrame) -> DataFrame:
    return posts.join(pendings.select(F.col("post_id").alias("id")).where("id is not null"), "id", "left_anti")


def validate(pendings: DataFrame, posts: DataFrame, comments: DataFrame) -> DataFrame:
    """Rows of unknown posts go; an unknown comment becomes null; severity is clamped to 1..10."""
    known = comments.select(F.col("id").alias("comment_id")).distinct().withColumn("known", F.lit(True))
    ok = pendings.join(posts.select(F.col("id").alias("post_id")), "post_id", "left_semi").join(known, "comment_id", "left")
    return ok.withColumn("comment_id", F.when(F.col("known"), F.col("comment_id"))).drop("known").withColumn("severity", clamp_severity(F.col("severity")))


def pending_listing(pendings: DataFrame, posts: DataFrame, subreddit: str | None = None, since: int | None = None, limit: int | None = None) -> DataFrame:
    q = pendings.join(posts.select(F.col("id").alias("post_id"), "subreddit"), "post_id")
    if subreddit:
        q = q.where(F.col("subreddit") == T.py_normalize_subreddit(subreddit))
    if since is not None:
        q = q.where(F.col("id") > since)
    return q.orderBy("id").limit(limit) if limit else q


def opportunity_candidates(sources: DataFrame, bridge: DataFrame, pendings: DataFrame, posts: DataFrame, painpoints: DataFrame, categories: DataFrame, category: str | None = None) -> DataFrame:
    """Painpoints that a quote of a known post backs, by subreddit: local and global source rows, severity range, subreddits seen.

    One groupBy by painpoint and subreddit gives the local counts; the global ones are its coarser grain.
    """
    q = pendings.select(F.col("id").alias("pending_painpoint_id"), "post_id", F.col("severity").alias("pending_severity"), "quoted_text").dropDuplicates(["pending_painpoint_id"])
    known = posts.select(F.col("id").alias("post_id"), "subreddit")
    rows = bridge.join(sources, "pending_painpoint_id").join(known, "post_id").join(q.drop("quoted_text", "post_id"), "pending_painpoint_id")
    fine = rows.groupBy("painpoint_id", "subreddit").agg(F.count("*").alias("n"), F.min("pending_severity").alias("lo"), F.max("pending_severity").alias("hi"))
    seen = F.array_join(F.array_sort(F.collect_set("subreddit")), ",").alias("subreddits_seen")  # as many as there are subreddits
    whole = fine.groupBy("painpoint_id").agg(F.sum("n").alias("global_signal_count"), F.min("lo").alias("severity_min"), F.max("hi").alias("severity_max"), seen)
    quoted = bridge.join(q.where(has_text(F.col("quoted_text"))).join(known, "post_id", "left_semi"), "pending_painpoint_id").select("painpoint_id")
    named = with_category(painpoints.withColumnRenamed("id", "painpoint_id"), categories)
    if category:
        named = named.where(F.col("category") == category)
    out = fine.select("painpoint_id", F.col("subreddit").alias("requested_subreddit"), F.col("n").alias("local_signal_count")).join(whole, "painpoint_id").join(named, "painpoint_id").join(quoted, "painpoint_id", "left_semi")
    return out.select("painpoint_id", "title", "description", "severity", "signal_count", "category", "local_signal_count", "global_signal_count", "severity_min", "severity_max", "subreddits_seen", "requested_subreddit")


def top_candidates(cand: DataFrame, n: int) -> DataFrame:
    """The n first of each subreddit by local and global count, then the painpoint's own signal and severity, then its id."""
    order = [F.col(c).desc_nulls_last() for c in ("local_signal_count", "global_signal_count", "signal_count", "severity")]
    w = Window.partitionBy("requested_subreddit").orderBy(*order, "painpoint_id")
    return cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def evidence_split(cand: DataFrame, bridge: DataFrame, pendings: DataFrame, posts: DataFrame, comments: DataFrame, cap: int = K.SIDE_LIMIT) -> DataFrame:
    """Quotes of each candidate, local and elsewhere, each side capped by post score, then comment score."""
    q = pendings.select(F.col("id").alias("pending_painpoint_id"), "post_id", "comment_id", "quoted_text", F.col("severity").alias("quote_severity")).dropDuplicates(["pending_painpoint_id"]).where(has_text(F.col("quoted_text")))
    p = posts.select(F.col("id").alias("post_id"), F.col("subreddit").alias("quote_subreddit"), F.col("score").alias("post_score"), F.col("permalink").alias("post_permalink"))
    c = comments.select(F.col("id").alias("comment_id"), F.col("score").alias("comment_score"), F.col("permalink").alias("comment_permalink"))
    rows = cand.select("painpoint_id", "requested_subreddit").join(bridge, "painpoint_id").join(q, "pending_painpoint_id").join(p, "post_id").join(c, "comment_id", "left")
    rows = rows.withColumn("is_local", F.col("quote_subreddit") == F.col("requested_subreddit")).withColumn("from_comment", F.coalesce(F.col("comment_permalink") != "", F.lit(False)))
    rows = rows.withColumn("url", T.evidence_url(F.when(F.col("from_comment"), F.col("comment_permalink")).otherwise(F.col("post_permalink")))).where("url != ''")
    w = Window.partitionBy("painpoint_id", "requested_subreddit", "is_local").orderBy(F.col("post_score").desc_nulls_last(), F.coalesce("comment_score", F.lit(-1)).desc(), "pending_painpoint_id")
    rows = rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= cap)
    return rows.select("painpoint_id", "requested_subreddit", "is_local", "rank", "pending_painpoint_id", "quoted_text", "quote_severity", "quote_subreddit", F.when(F.col("from_comment"), "comment").otherwise("post").alias("source_type"), F.when(F.col("from_comment"), F.col("comment_score")).otherwise(F.col("post_score")).alias("source_score"), "url")


def packs(cand: DataFrame, split: DataFrame) -> DataFrame:
    """A candidate with its strength and its quotes as nested rows."""
    quote = F.struct("rank", "quoted_text", "source_type", "source_score", "url")
    side = lambda local, n: F.array_sort(F.collect_list(F.when(F.col("is_local") == local, quote))).alias(n)
    q = split.groupBy("painpoint_id", "requested_subreddit").agg(side(True, "local_quotes"), side(False, "cross_subreddit_quotes"))
    out = cand.join(q, ["painpoint_id", "requested_subreddit"])
    strength = F.struct("local_signal_count", "global_signal_count", "severity_min", "severity_max", F.size("local_quotes").alias("local_quote_count"), F.size("cross_subreddit_quotes").alias("cross_subreddit_quote_count"))
    return out.select("painpoint_id", "title", "category", "requested_subreddit", F.split("subreddits_seen", ",").alias("subreddits_seen"), strength.alias("evidence_strength"), "local_quotes", "cross_subreddit_quotes")


def conviction_tier(local: Column, severity_max: Column, best_post: Column, best_comment: Column) -> Column:
    return F.when((local >= 3) & (severity_max >= 5) & ((best_post >= 100) | (best_comment >= 50)), "highest").when(local >= 2, "strong").when(local >= 1, "exploratory")

"""Listings of posts and comments: parsing, windows, targets, writes that keep the first row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from .. import constants as K
from ..functions import text as T
from ..session import Scratch

_POST = S.StructType([S.StructField(n, t) for n, t in (("name", S.StringType()), ("subreddit", S.StringType()), ("title", S.StringType()), ("selftext", S.StringType()), ("url", S.StringType()), ("author", S.StringType()), ("score", S.LongType()), ("upvote_ratio", S.DoubleType()), ("num_comments", S.LongType()), ("permalink", S.StringType()), ("created_utc", S.DoubleType()), ("is_self", S.BooleanType()), ("stickied", S.BooleanType()))])
_COMMENT = S.StructType([S.StructField(n, t) for n, t in (("name", S.StringType()), ("parent_id", S.StringType()), ("author", S.StringType()), ("body", S.StringType()), ("score", S.LongType()), ("controversiality", S.LongType()), ("permalink", S.StringType()), ("created_utc", S.DoubleType()), ("depth", S.LongType()))])


def _page(item: S.StructType) -> S.StructType:
    child = S.StructType([S.StructField("kind", S.StringType()), S.StructField("data", item)])
    return S.StructType([S.StructField("data", S.StructType([S.StructField("children", S.ArrayType(child)), S.StructField("after", S.StringType())]))])


def read_listing(spark: SparkSession, path: str) -> DataFrame:
    """Posts of stored listing pages (JSON documents, one a line), without pinned ones."""
    page = spark.read.schema(_page(_POST)).json(path)
    return page.select(F.explode("data.children").alias("c")).select("c.data.*").where("name is not null and not coalesce(stickied, false)")


def read_comment_pages(spark: SparkSession, path: str, limit: int = K.PER_POST) -> DataFrame:
    """Comments of stored comment pages (a list of two listings a line): kind t1 only, the best of each page."""
    both = S.ArrayType(_page(_COMMENT))
    rows = spark.read.text(path).select(F.monotonically_increasing_id().alias("page"), F.from_json("value", both)[1].alias("p"))
    rows = rows.select("page", F.explode("p.data.children").alias("c")).where("c.kind = 't1'").select("page", "c.data.*")
    w = Window.partitionBy("page").orderBy(F.col("score").desc_nulls_last(), "name")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).drop("page")


def parse_posts(raw: DataFrame) -> DataFrame:
    """Canonical columns: link made absolute, text capped, flags to booleans, pinned posts out."""
    return raw.where("not coalesce(stickied, false)").select("reddit_id", F.substring(F.coalesce("selftext", F.lit("")), 1, K.POST_CAP).alias("selftext"), T.absolute_permalink(F.col("permalink")).alias("permalink"), F.coalesce("is_self", F.lit(False)).alias("is_self"), F.coalesce("score", F.lit(0)).alias("score"))


def dedup_and_rank(windows: DataFrame) -> DataFrame:
    """The first row of each post in window order, ranked by score and comments. The rank of all rows needs one order; it is
    numbered by range partitions, not in one task."""
    w = Window.partitionBy("reddit_id").orderBy("window_no", "fetched_at", "score")
    one = windows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    one = one.withColumn("engagement", (F.coalesce("score", F.lit(0)) + F.coalesce("num_comments", F.lit(0))).cast("long"))
    return rank_all(one, [F.col("engagement").desc(), F.col("id")])


def rank_all(df: DataFrame, order: list) -> DataFrame:
    """1-based rank over all rows: places within range partitions plus the sizes of those before.

    The partitioned rows are written once with their places, so that both the rows and the sizes come from one partitioning.
    Equal rows in the order get ranks next to each other; no rows give none.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    placed = Scratch(df.sparkSession, "ranks").write(placed, "placed")  # a place is the partition's number and, in 33 bits, the row's
    part, row = F.shiftright("_place", 33), F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))  # a row a partition
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "_before")
    return placed.withColumn("_p", part).join(F.broadcast(before), "_p").withColumn("rank", row + F.col("_before") + 1).drop("_p", "_before", "_place")


def comment_targets(ranked: DataFrame, min_score: int, n: int) -> DataFrame:
    return ranked.where(F.col("score") >= min_score).orderBy("rank").limit(n)


def top_comments(comments: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("post_id").orderBy(F.col("score").desc_nulls_last(), "id")
    return comments.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def search(posts: DataFrame, words: str, n: int) -> DataFrame:
    like = F.col("title").ilike(f"%{words}%") | F.col("selftext").ilike(f"%{words}%")
    return posts.where(like & ~F.coalesce("stickied", F.lit(False))).orderBy(F.col("score").desc_nulls_last(), "id").limit(n)


def insert_if_absent(existing: DataFrame, incoming: DataFrame, key: str, *order: str) -> DataFrame:
    """The table after a write in which the first row of a key stands: rows held stay as they are, new keys come in once."""
    new = incoming.join(existing.select(key), key, "left_anti")
    w = Window.partitionBy(key).orderBy(*order)
    first = new.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return existing.unionByName(first.select(*existing.columns))


def token_totals(posts: DataFrame, comments: DataFrame) -> DataFrame:
    """A quarter of the letters of a post with its comments, 1 at least; comments are summed before the join."""
    c = comments.groupBy("post_id").agg(F.sum(F.length(F.coalesce("body", F.lit("")))).alias("n"))
    p = posts.join(c, posts.id == c.post_id, "left")
    n = F.length(F.coalesce("title", F.lit(""))) + F.length(F.coalesce("selftext", F.lit(""))) + F.coalesce("n", F.lit(0))
    return p.select("id", F.greatest(F.lit(1), F.floor(n / 4)).cast("long").alias("tokens"))


def render(posts: DataFrame, comments: DataFrame) -> DataFrame:
    """A post and its comments, best first, as one text for a reader; by nature one value a post."""
    lines = comments.select("post_id", F.struct((-F.col("score")).alias("s"), "id", F.concat(F.lit("\n- ["), F.col("score").cast("string"), F.lit("] "), F.coalesce("body", F.lit(""))).alias("line")).alias("r"))
    c = lines.groupBy("post_id").agg(F.array_sort(F.collect_list("r")).alias("rs"))
    p = posts.join(c, posts.id == c.post_id, "left")
    body = F.coalesce(F.array_join(F.transform("rs", lambda r: r.line), ""), F.lit(""))
    return p.select("id", F.concat(F.lit("# "), F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("selftext", F.lit("")), body).alias("rendered"))


def thread_depths(comments: DataFrame) -> DataFrame:
    return comments.where("post_id is not null").groupBy("post_id").agg(F.count("*").alias("comments"), F.max("depth").cast("long").alias("deepest"), F.count_if(F.col("parent_reddit_id").startswith("t3_")).alias("direct_replies"))


def trending(posts: DataFrame, n: int) -> DataFrame:
    return posts.groupBy("subreddit").agg(F.count("*").alias("posts"), F.round(F.sum("num_comments") / F.count("*"), 2).alias("rate")).orderBy(F.col("posts").desc(), "subreddit").limit(n)

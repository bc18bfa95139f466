"""The pipeline's tables from the delivered ones, as DataFrames.

A record that was fetched twice keeps its first row. The bridge from canonical painpoints to observations and the
extra sources are not delivered; they are derived from the ids, three observations to a painpoint.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.text import normalize_subreddit
from .session import table


def first_rows(df: DataFrame, key: str, *order: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


class Views:
    def __init__(self, spark: SparkSession, sf: str) -> None:
        self.spark, self.sf = spark, sf

    def raw(self, name: str) -> DataFrame:
        return table(self.spark, self.sf, name)

    @cached_property
    def posts(self) -> DataFrame:
        return first_rows(self.raw("posts"), "id", "fetched_at", "score").withColumn("subreddit", normalize_subreddit(F.col("subreddit")))

    @cached_property
    def comments(self) -> DataFrame:
        return first_rows(self.raw("comments"), "id", "fetched_at", "score")

    @cached_property
    def categories(self) -> DataFrame:
        return self.raw("categories")

    @cached_property
    def stamped_categories(self) -> DataFrame:
        """Categories with the time their member set last changed, which isn't delivered: the newest observation that names the category."""
        seen = self.raw("pending_painpoints").where("category_id is not null").groupBy("category_id").agg(F.max("extracted_at").alias("member_set_last_changed_at"))
        c = self.categories
        return c.join(seen, c.id == seen.category_id, "left").drop("category_id")

    @cached_property
    def pendings(self) -> DataFrame:
        return self.raw("pending_painpoints").distinct()

    @cached_property
    def painpoints(self) -> DataFrame:
        return self.raw("painpoints")

    @cached_property
    def bridge(self) -> DataFrame:
        q = self.raw("pending_painpoints").select(F.col("id").alias("pending_painpoint_id"), F.expr("(id - 1) div 3 + 1").alias("painpoint_id")).distinct()
        return q.join(self.painpoints.select(F.col("id").alias("painpoint_id")), "painpoint_id", "left_semi").select("painpoint_id", "pending_painpoint_id")

    @cached_property
    def extras(self) -> DataFrame:
        q = self.raw("pending_painpoints").where("id % 7 = 0").select(F.col("id").alias("pending_painpoint_id"), (F.col("post_id") + 1).alias("post_id")).distinct()
        return q.join(self.raw("posts").select(F.col("id").alias("post_id")).distinct(), "post_id", "left_semi").select("pending_painpoint_id", "post_id", F.lit(None).cast("long").alias("comment_id"))

    @cached_property
    def sources(self) -> DataFrame:
        """Primary and extra sources of every observation, distinct."""
        first = self.raw("pending_painpoints").select(F.col("id").alias("pending_painpoint_id"), "post_id", "comment_id")
        return first.unionByName(self.extras).distinct()

    @cached_property
    def vectors(self) -> DataFrame:
        return self.raw("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")


#: The same tables in plain SQL.
CTES = r"""P AS (SELECT * REPLACE (lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(subreddit, '^\s+|\s+$', '', 'g'), '^r/', ''), '^/r/', ''), '^/+|/+$', '', 'g')) AS subreddit) FROM posts QUALIFY row_number() OVER (PARTITION BY id ORDER BY fetched_at, score) = 1),
C AS (SELECT * FROM comments QUALIFY row_number() OVER (PARTITION BY id ORDER BY fetched_at, score) = 1),
Q AS (SELECT DISTINCT * FROM pending_painpoints),
PS AS (SELECT DISTINCT (id - 1) // 3 + 1 AS painpoint_id, id AS pending_painpoint_id FROM pending_painpoints WHERE (id - 1) // 3 + 1 IN (SELECT id FROM painpoints)),
PX AS (SELECT DISTINCT id AS pending_painpoint_id, post_id + 1 AS post_id, CAST(NULL AS BIGINT) AS comment_id FROM pending_painpoints WHERE id % 7 = 0 AND post_id + 1 IN (SELECT id FROM posts)),
S AS (SELECT id AS pending_painpoint_id, post_id, comment_id FROM pending_painpoints UNION SELECT * FROM PX)"""


def with_tables(body: str, more: str = "", recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{CTES}{', ' + more if more else ''} {body}"

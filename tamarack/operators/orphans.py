"""References to records that do not exist.

Keys are range-partitioned; each range holds its parents as one sorted array, and batches of references are probed
against it by binary search. A range to which many references point is split: its array is repeated, its references
are spread. So no task gets more than about ``per_task`` references, whatever the share of one key.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import partitions

PER_RANGE = 200_000
PER_TASK = 400_000
MAX_RANGES = 4096


def find_orphans(refs: DataFrame, parents: DataFrame, per_range: int = PER_RANGE, per_task: int = PER_TASK) -> DataFrame:
    """refs: tab, field, row_id long, ref long, at timestamp; parents: target, id long, and refs' target says which.

    Gives the refs whose ref is not null and equals no id of their target. Null ids, repeated rows and empty tables
    are allowed: with no parents every reference is an orphan, each repeated row comes out as often as it came in.
    """
    spark = refs.sparkSession
    refs, ids = refs.where("ref is not null"), parents.where("id is not null").select("target", "id")
    stats = ids.groupBy("target").agg(F.count("*").alias("n")).collect()  # one row a table
    bounds = {}
    for s in stats:  # quantiles of the ids bound the ranges: at most MAX_RANGES numbers a table
        n = max(1, min(MAX_RANGES, -(-s.n // per_range)))
        cuts = ids.where(F.col("target") == s.target).approxQuantile("id", [i / n for i in range(1, n)], 0.25 / n) if n > 1 else []
        bounds[s.target] = np.array(sorted({int(x) for x in cuts}), np.int64)

    def number(col: str):
        """How many bounds are at or below the value; -1 where the table has no ids."""
        out = F.lit(-1)
        for t, cuts in bounds.items():
            if len(cuts) <= 32:
                at = sum((F.when(F.col(col) >= F.lit(int(c)), 1).otherwise(0) for c in cuts), F.lit(0))
            else:
                at = F.pandas_udf(lambda v, cuts=cuts: pd.Series(np.searchsorted(cuts, v.to_numpy(), "right").astype("int32")), "int")(F.col(col))
            out = F.when(F.col("target") == t, at).otherwise(out)
        return out.cast("int")

    refs, ids = refs.withColumn("rng", number("ref")), ids.withColumn("rng", number("id"))
    many = refs.groupBy("target", "rng").agg(F.count("*").alias("n")).where(F.col("n") > per_task).collect()  # at most MAX_RANGES rows a table
    split = spark.createDataFrame([(r.target, r.rng, -(-r.n // per_task)) for r in many], "target string, rng int, pieces int")
    refs, ids = (x.join(F.broadcast(split), ["target", "rng"], "left").withColumn("pieces", F.coalesce("pieces", F.lit(1))) for x in (refs, ids))
    refs = refs.withColumn("part", F.pmod(F.hash("row_id"), F.col("pieces")))
    held = ids.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).select("target", "rng", "part", "id")

    def probe(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        have, want = np.sort(right["id"].to_numpy(np.int64)), left["ref"].to_numpy(np.int64)
        if len(have):
            at = np.searchsorted(have, want)
            miss = have[np.minimum(at, len(have) - 1)] != want
        else:
            miss = np.ones(len(want), bool)
        return left.loc[miss, ["tab", "field", "row_id", "ref", "at"]]

    # as many places as pieces, fixed, so that several pieces don't fall together in one task
    keys = ("target", "rng", "part")
    pieces = sum(len(cuts) + 1 for cuts in bounds.values()) + sum(-(-r.n // per_task) for r in many)
    n = max(partitions(spark), min(pieces, 20_000))
    refs, held = refs.repartition(n, *keys), held.repartition(n, *keys)
    return refs.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(probe, "tab string, field string, row_id long, ref long, at timestamp")


def project_references(comments: DataFrame, pendings: DataFrame, posts: DataFrame, categories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The references of this data model and the ids they may name."""

    def ref(df, tab, field, target, at):
        return df.select(F.lit(tab).alias("tab"), F.lit(field).alias("field"), F.col("id").cast("long").alias("row_id"), F.col(field).cast("long").alias("ref"), F.col(at).cast("timestamp").alias("at"), F.lit(target).alias("target"))

    refs = [ref(comments, "comments", "post_id", "posts", "fetched_at"), ref(pendings, "pending_painpoints", "comment_id", "comments", "extracted_at"),
            ref(pendings, "pending_painpoints", "category_id", "categories", "extracted_at")]
    parents = [df.select(F.lit(t).alias("target"), F.col("id").cast("long").alias("id")) for t, df in (("posts", posts), ("comments", comments), ("categories", categories))]
    return reduce(DataFrame.unionByName, refs), reduce(DataFrame.unionByName, parents)


def orphans_by_period(orphans: DataFrame, refs: DataFrame) -> DataFrame:
    """Per table, field and month: rows with a reference, orphans among them, distinct keys missed. A record's repeats count once an id and month."""
    month = F.date_format("at", "yyyy-MM").alias("period")
    bad = orphans.select("tab", "field", month, "row_id", "ref").distinct().groupBy("tab", "field", "period").agg(F.count("*").alias("orphans"), F.countDistinct("ref").alias("missing_keys"))
    whole = refs.where("ref is not null").select("tab", "field", month, "row_id", "ref").distinct().groupBy("tab", "field", "period").agg(F.count("*").alias("refs"))
    out = whole.join(bad, (whole.tab == bad.tab) & (whole.field == bad.field) & whole.period.eqNullSafe(bad.period), "left")
    return out.select(whole.tab, whole.field, whole.period, "refs", F.coalesce("orphans", F.lit(0)).cast("long").alias("orphans"), F.coalesce("missing_keys", F.lit(0)).cast("long").alias("missing_keys"))

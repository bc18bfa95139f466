"""Extraction of observations by an injected extractor, batch by batch, and the checks and samples around it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ITEMS = "grp string, batch long, post_id long, title string, description string, quoted_text string, severity int, evidence_type string, failed boolean"


def extract(rendered: DataFrame, make: Callable[[], Callable[[list[tuple[int, str]]], list[dict]]]) -> DataFrame:
    """rendered: grp, batch, id, rendered. The extractor gets the (id, text) of a batch and gives items; a batch whose call fails
    gives one row with failed set, and the others go on. No posts give no rows."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        head = {"grp": part["grp"].iloc[0], "batch": int(part["batch"].iloc[0])}
        names = [c.split()[0] for c in ITEMS.split(", ")]
        try:
            items = make()([(int(i), t) for i, t in zip(part["id"], part["rendered"])])
            return pd.DataFrame([{**head, "failed": False, **x} for x in items], columns=names, dtype=object)
        except Exception:  # noqa: BLE001
            return pd.DataFrame([{**head, "failed": True}], columns=names, dtype=object)

    return rendered.groupBy("grp", "batch").applyInPandas(run, ITEMS)


def gold_violations(pairs: DataFrame) -> DataFrame:
    """Rows of a labelled pair set that break its rules: an empty text, an unknown label, an id that comes twice."""
    n = F.count("*").over(Window.partitionBy("id"))
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    why = F.when(blank("a") | blank("b"), "empty text").when(~F.coalesce(F.col("label").isin("positive", "negative"), F.lit(False)), "unknown label").when(blank("id"), "no id").when(n > 1, "id twice")
    return pairs.withColumn("why", why).where("why is not null").select("id", "why")


def judge_sample(rows: DataFrame, size: int, seed: int = 1) -> DataFrame:
    """Whole posts in a shuffled order until so many observations are together. rows: post_id, n; ranges give the running sums."""
    from ..sources.listing import rank_all

    order = [F.xxhash64("post_id", F.lit(seed)), F.col("post_id")]
    few = rank_all(rows, order).where(F.col("rank") <= size)  # a post has one observation at least
    run = F.sum("n").over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1))  # at most ``size`` rows
    return few.withColumn("before", F.coalesce(run, F.lit(0))).where(F.col("before") < size).select("post_id", "n", "rank")


def renumber(components: DataFrame) -> DataFrame:
    """Components numbered from 1 by size, then by least member. components: id, label; a row a component is ranked."""
    from ..sources.listing import rank_all

    size = components.groupBy("label").agg(F.count("*").alias("size"))
    return rank_all(size, [F.col("size").desc(), F.col("label")]).select("label", "size", F.col("rank").alias("number"))

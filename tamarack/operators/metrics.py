"""Quality metrics, snapshot differences and evaluation measures."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import quotes
from ..functions import text as T
from ..session import Scratch, partitions


def safe_ratio(a: Column, b: Column, digits: int = 4) -> Column:
    return F.round(F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0)), digits)


def totals(categories: DataFrame) -> DataFrame:
    """Root, leaf, seed and runtime categories, one scan and one anti join."""
    parents = categories.select(F.col("parent_id").alias("id")).where("id is not null").distinct().withColumn("is_parent", F.lit(True))
    c = categories.join(parents, "id", "left")
    return c.agg(F.count("*").alias("categories"), F.count_if(F.col("parent_id").isNull()).alias("roots"), F.count_if(F.col("is_parent").isNull()).alias("leaves"), F.count_if("is_seed").alias("seed"), F.count_if(~F.col("is_seed")).alias("runtime"))


def dedup_metrics(pendings: DataFrame, extras: DataFrame) -> DataFrame:
    per = extras.groupBy("pending_painpoint_id").agg(F.count("*").alias("n"))
    a = per.agg(F.count("*").alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("extras"), F.coalesce(F.max("n"), F.lit(0)).alias("max_extras"))
    n = pendings.agg(F.count("*").alias("pendings"))
    return n.join(a).withColumn("rate", safe_ratio(F.col("extras"), F.col("pendings") + F.col("extras")))


def dedup_groups(pendings: DataFrame, extras: DataFrame, at_least: int = 1) -> DataFrame:
    """Observations with so many extra sources, largest first, the sources nested."""
    g = extras.groupBy("pending_painpoint_id").agg(F.count("*").alias("extra_count"), F.array_sort(F.collect_list(F.struct("post_id", "comment_id"))).alias("extra_sources")).where(F.col("extra_count") >= at_least)
    return pendings.dropDuplicates(["id"]).join(g, F.col("id") == F.col("pending_painpoint_id")).select("id", "title", "extra_count", "extra_sources")


def merge_metrics(bridge: DataFrame, painpoints: DataFrame) -> DataFrame:
    per = bridge.groupBy("painpoint_id").agg(F.count("*").alias("n"))
    a = per.agg(F.sum("n").alias("linked"), F.count("*").alias("painpoints_linked"), F.count_if(F.col("n") > 1).alias("merged"), F.max("n").alias("max_sources"))
    b = painpoints.agg(F.max("signal_count").alias("max_signal"), F.count("*").alias("painpoints"))
    return a.join(b).withColumn("rate", safe_ratio(F.col("merged"), F.col("painpoints")))


def categorisation(painpoints: DataFrame, categories: DataFrame) -> DataFrame:
    p = painpoints.join(categories.select(F.col("id").alias("category_id"), "is_seed"), "category_id", "left")
    out = p.agg(F.count("*").alias("total"), F.count_if(F.col("category_id") == K.UNCATEGORIZED).alias("uncategorized"), F.count_if(F.col("is_seed") & (F.col("category_id") != K.UNCATEGORIZED)).alias("in_seed"), F.count_if(~F.col("is_seed")).alias("in_runtime"), F.count_if(F.col("category_id").isNull()).alias("without"))
    return out.withColumn("uncategorized_share", safe_ratio(F.col("uncategorized"), F.col("total")))


def per_subreddit(posts: DataFrame, comments: DataFrame, pendings: DataFrame, bridge: DataFrame) -> DataFrame:
    """Posts, comments, observations and painpoints of each subreddit; each table is cut to keys and counted before the join."""
    p = posts.select(F.col("id").alias("post_id"), "subreddit")
    c = comments.groupBy("post_id").agg(F.count("*").alias("comments"))
    q = pendings.select("post_id", F.col("id").alias("pending_painpoint_id")).distinct()
    a = p.join(c, "post_id", "left").groupBy("subreddit").agg(F.count("*").alias("posts"), F.sum(F.coalesce("comments", F.lit(0))).alias("comments"))
    b = q.join(p, "post_id").groupBy("subreddit").agg(F.count("*").alias("pendings"))
    d = q.join(p, "post_id").join(bridge, "pending_painpoint_id").groupBy("subreddit").agg(F.countDistinct("painpoint_id").alias("painpoints"))
    return reduce(lambda x, y: x.join(y, "subreddit", "full"), (a, b, d)).na.fill(0)


def event_counts(events: DataFrame, threshold: float) -> DataFrame:
    return events.groupBy("event_type").agg(F.count("*").alias("proposed"), F.count_if(F.col("value") >= threshold).alias("accepted"))


def signal_integrity(painpoints: DataFrame, bridge: DataFrame) -> DataFrame:
    n = bridge.groupBy(F.col("painpoint_id").alias("id")).agg(F.count("*").alias("sources"))
    return painpoints.join(n, "id", "left").withColumn("sources", F.coalesce("sources", F.lit(0))).where(F.col("sources") != F.col("signal_count")).select("id", "signal_count", "sources")


def rollup(categories: DataFrame, painpoints: DataFrame, pairs: DataFrame) -> DataFrame:
    """Direct and total painpoints of every category; pairs are (ancestor_id, descendant_id) of the tree."""
    direct = painpoints.where("category_id is not null").groupBy("category_id").agg(F.count("*").alias("direct"))
    below = pairs.join(direct, pairs.descendant_id == direct.category_id).groupBy("ancestor_id").agg(F.sum("direct").alias("below"))
    out = categories.select("id", "name").join(direct, F.col("id") == F.col("category_id"), "left").join(below, F.col("id") == F.col("ancestor_id"), "left")
    d, b = F.coalesce("direct", F.lit(0)), F.coalesce("below", F.lit(0))
    return out.select("id", "name", d.alias("direct_count"), (d + b).alias("total_count"))


def cross_run(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer difference of two runs by natural key; of equal keys in a run the one of the greatest id stands."""
    last = lambda df, s: df.groupBy(*keys).agg(F.max_by(F.struct("id", "severity", "quoted_text"), "id").alias("r")).select(*keys, F.col("r.severity").alias(f"severity_{s}"), F.col("r.quoted_text").alias(f"quote_{s}"), F.lit(True).alias(f"in_{s}"))
    out = last(a, "a").join(last(b, "b"), keys, "full")
    bucket = F.when(F.col("in_a").isNull(), "only_b").when(F.col("in_b").isNull(), "only_a").otherwise("common")
    return out.withColumn("bucket", bucket).drop("in_a", "in_b")


def changed_cells(diff: DataFrame, n: int = 40) -> DataFrame:
    d = F.abs(F.coalesce("severity_a", F.lit(0)) - F.coalesce("severity_b", F.lit(0)))
    both = diff.where("bucket = 'common'").withColumn("delta", d).where((d > 0) | ~F.col("quote_a").eqNullSafe(F.col("quote_b")))
    return both.orderBy(F.col("delta").desc(), "permalink", "comment_key").limit(n)


def snapshot_diff(now: DataFrame, before: DataFrame) -> DataFrame:
    top = before.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    return now.join(F.broadcast(top), F.col("id") > F.col("top"))  # one row


def confusion(df: DataFrame, predicted: Column, actual: Column, by: list[str] | None = None) -> DataFrame:
    g = df.groupBy(*(by or [])).agg(F.count_if(predicted & actual).alias("tp"), F.count_if(predicted & ~actual).alias("fp"), F.count_if(~predicted & actual).alias("fn"), F.count_if(~predicted & ~actual).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return g.select(*(by or []), "tp", "fp", "fn", "tn", safe_ratio(tp, tp + fp, 6).alias("precision"), safe_ratio(tp, tp + fn, 6).alias("recall"), safe_ratio(2 * tp, 2 * tp + fp + fn, 6).alias("f1"), safe_ratio(tp + tn, tp + fp + fn + tn, 6).alias("accuracy"))


def threshold_sweep(pairs: DataFrame, start: float, stop: float, step: float) -> DataFrame:
    """Measures at every threshold of an inclusive range. Scores are counted once by the number of thresholds they reach; the
    thresholds, a short list, then sum those counts."""
    n = int(round((stop - start) / step)) + 1
    ts = [round(start + i * step, 4) for i in range(n)]
    spark = pairs.sparkSession
    grid = spark.createDataFrame([(i, t) for i, t in enumerate(ts)], "i int, threshold double")
    reached = sum((F.when(F.col("score") >= t, 1).otherwise(0) for t in ts), F.lit(0))
    counts = pairs.groupBy(reached.alias("reached")).agg(F.count_if("positive").alias("pos"), F.count_if(~F.col("positive")).alias("neg"))
    hit = F.col("reached") > F.col("i")
    g = grid.join(F.broadcast(counts), how="cross").groupBy("threshold").agg(*[F.sum(F.when(h, F.col(c)).otherwise(0)).alias(k) for k, h, c in (("tp", hit, "pos"), ("fp", hit, "neg"), ("fn", ~hit, "pos"), ("tn", ~hit, "neg"))])
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    return g.select("threshold", "tp", "fp", "fn", "tn", safe_ratio(tp, tp + fp, 6).alias("precision"), safe_ratio(tp, tp + fn, 6).alias("recall"), safe_ratio(2 * tp, 2 * tp + fp + fn, 6).alias("f1"))


def score_distribution(pairs: DataFrame) -> DataFrame:
    """Least, upper median (element n div 2 of the sorted scores) and greatest score by label, by rank instead of a collected list."""
    w = Window.partitionBy("positive").orderBy("score")
    c = pairs.groupBy("positive", "score").agg(F.count("*").alias("c"))  # a row for each score that occurs
    c = c.withColumn("upto", F.sum("c").over(w)).withColumn("n", F.sum("c").over(Window.partitionBy("positive")))
    mid = F.expr("n div 2 + 1")
    return c.groupBy("positive").agg(F.min("score").alias("lo"), F.min(F.when(F.col("upto") >= mid, F.col("score"))).alias("median"), F.max("score").alias("hi"), F.max("n").alias("n"))


def severity_profile(pendings: DataFrame) -> DataFrame:
    bins = pendings.sparkSession.range(1, 11).select(F.col("id").cast("int").alias("severity"))
    n = pendings.groupBy("severity").agg(F.count("*").alias("n"))
    return bins.join(n, "severity", "left").na.fill(0, ["n"])


def severity_moments(pendings: DataFrame) -> DataFrame:
    return pendings.agg(F.count("severity").alias("n"), F.round(F.avg("severity"), 6).alias("mean"), F.round(F.stddev_samp("severity"), 6).alias("stdev"))


def quote_status(pendings: DataFrame, posts: DataFrame, comments: DataFrame) -> DataFrame:
    """blank, attributed, post, other_comment or missing, in that order of proof. Other comments are looked at only for quotes
    that neither the named source nor the post holds, in blocks of a post by an index of their letters."""
    norm = lambda c: T.normalize_quote(F.coalesce(c, F.lit("")))
    q = pendings.select("id", "post_id", "comment_id", norm(F.col("quoted_text")).alias("q"))
    p = posts.select(F.col("id").alias("post_id"), norm(F.concat_ws(" ", "title", "selftext")).alias("pt"))
    c = comments.select(F.col("id").alias("comment_id"), norm(F.col("body")).alias("ct"))
    has = lambda t: F.coalesce(F.instr(F.col(t), F.col("q")) > 0, F.lit(False)) if t else None
    known = q.join(p, "post_id", "left").join(c, "comment_id", "left")
    known = known.withColumn("in_post", F.coalesce(F.expr("position(q in pt) > 0"), F.lit(False))).withColumn("in_comment", F.coalesce(F.expr("position(q in ct) > 0"), F.lit(False))).drop("pt", "ct")
    known = Scratch(pendings.sparkSession, "status").write(known, "known")
    open_ = known.where((F.col("q") != "") & ~F.col("in_post") & ~F.col("in_comment")).select("post_id", "q").distinct()
    others = comments.join(open_.select("post_id").distinct(), "post_id", "left_semi").select("post_id", "id", norm(F.col("body")).alias("ct"))
    size = others.groupBy("post_id").agg(F.ceil(F.count("*") / quotes.BLOCK).alias("blocks"))
    blocks = others.join(size, "post_id").groupBy("post_id", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block")).agg(F.collect_list("ct").alias("cts"))
    per = open_.groupBy("post_id").agg(F.collect_list("q").alias("qs"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                post, src = batch["post_id"][i].as_py(), quotes.Sources(batch["cts"][i].as_py())
                out += [(post, x) for x in batch["qs"][i].as_py() if src.exact(x) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string())], ["post_id", "q"])

    found = blocks.join(per, "post_id").repartition(4 * partitions(pendings.sparkSession), "post_id", "block").select("post_id", "cts", "qs").mapInArrow(scan, "post_id long, q string")
    found = found.distinct().withColumn("in_other", F.lit(True))
    status = F.when(F.col("q") == "", "blank").when(F.col("in_comment") | (F.col("comment_id").isNull() & F.col("in_post")), "attributed").when(F.col("in_post"), "post").when(F.coalesce("in_other", F.lit(False)), "other_comment").otherwise("missing")
    return known.join(found, ["post_id", "q"], "left").select("id", status.alias("status"))


def token_cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """usage: model, prompt, cached, completion tokens; prices: model, price_in, price_out by million tokens, a row a model."""
    s = usage.groupBy("model").agg(F.sum("prompt").alias("prompt"), F.sum("cached").alias("cached"), F.sum("completion").alias("completion"))
    cost = F.round((F.col("prompt") * F.col("price_in") + F.col("completion") * F.col("price_out")) / 1e6, 6)
    return s.join(prices, "model").select("model", "prompt", "cached", "completion", safe_ratio(F.col("cached") * 100, F.col("prompt"), 2).alias("hit_pct"), cost.alias("cost"))


def author_stats(posts: DataFrame, n: int = 10) -> DataFrame:
    ok = posts.where("author is not null and trim(author) != '' and author != '[deleted]'")
    return ok.groupBy("author").agg(F.count("*").alias("posts"), F.sum("score").alias("score"), F.sum("num_comments").alias("comments")).orderBy(F.col("score").desc(), "author").limit(n)


def engagement_rank(posts: DataFrame, n: int = 25, chunk: int = 25) -> DataFrame:
    """num_comments + score // 5, best first, with the number of the chunk of so many."""
    e = F.coalesce("num_comments", F.lit(0)) + F.floor(F.coalesce("score", F.lit(0)) / 5)
    top = posts.select("id", e.cast("long").alias("engagement")).orderBy(F.col("engagement").desc(), "id").limit(n)
    w = Window.orderBy(F.col("engagement").desc(), "id")  # n rows
    return top.withColumn("rank", F.row_number().over(w)).withColumn("chunk", F.floor((F.col("rank") - 1) / chunk).cast("long"))


def evidence_filter(items: DataFrame, label: str = "evidence_type") -> DataFrame:
    """Keeps the allowed evidence kinds and drops the label; what is no known kind is out."""
    kind = F.lower(F.trim(F.coalesce(F.col(label), F.lit(""))))
    return items.where(kind.isin(*K.EVIDENCE_KEPT)).drop(label)


def _label(kind: Column) -> Column:
    return F.when(kind.isin(*K.EVIDENCE_KEPT, *K.EVIDENCE_DROPPED), kind).otherwise("unknown")


def evidence_filter_stats(items: DataFrame, label: str = "evidence_type") -> DataFrame:
    """Rows by label, whether the label is kept; labels that are no known kind are counted as unknown."""
    kind = F.lower(F.trim(F.coalesce(F.col(label), F.lit(""))))
    return items.groupBy(_label(kind).alias("label")).agg(F.count("*").alias("n")).withColumn("kept", F.col("label").isin(*K.EVIDENCE_KEPT))


def evidence_dropped(items: DataFrame, label: str = "evidence_type") -> DataFrame:
    """The rows that the filter drops, in short: their label, post, comment, and title and quote of 120 letters at most."""
    kind = F.lower(F.trim(F.coalesce(F.col(label), F.lit(""))))
    out = items.where(~kind.isin(*K.EVIDENCE_KEPT))
    return out.select("id", _label(kind).alias("evidence_type"), "post_id", "comment_id", T.compact(F.col("title")).alias("title"), T.compact(F.col("quoted_text")).alias("quoted_text"))

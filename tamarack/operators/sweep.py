"""Proposals of the category sweep, as plans from state to events; their tests before a change; the fold that applies them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from . import vectors as V


def uncategorised_clusters(members: DataFrame, edges: DataFrame, threshold: float, least: int = K.MIN_CLUSTER) -> DataFrame:
    """Components of at least so many members: a proposal for a category each."""
    lab = V.components(edges.where(F.col("sim") >= threshold), members)
    size = lab.groupBy("label").agg(F.count("*").alias("size")).where(F.col("size") >= least)
    return lab.join(size, "label")


def homeless(members: DataFrame, clustered: DataFrame, nearest: DataFrame, floor: float = K.CATEGORY_COSINE) -> DataFrame:
    """Members in no cluster whose nearest category is below the floor or missing, by priority signal * severity."""
    left = members.join(clustered.select("id"), "id", "left_anti").join(nearest.select(F.col("q").alias("id"), F.col("sim").alias("best")), "id", "left")
    pri = F.coalesce("signal_count", F.lit(1)) * F.coalesce("severity", F.lit(5))
    return left.where(F.col("best").isNull() | (F.col("best") < floor)).select("id", "best", pri.cast("long").alias("priority"))


def split_candidates(categories: DataFrame, painpoints: DataFrame, last_count: Column, least: int = K.SPLIT_MIN_SIZE, growth: int = K.SPLIT_DELTA) -> DataFrame:
    n = painpoints.where("category_id is not null").groupBy("category_id").agg(F.count("*").alias("members"))
    c = categories.join(n, categories.id == n.category_id).withColumn("last_count", last_count)
    return c.where((F.col("members") >= least) & (F.col("members") - F.col("last_count") >= growth)).select("id", "name", "members", "last_count")


def split_clusters(candidates: DataFrame, members: DataFrame, pairs: DataFrame, least: int = K.SPLIT_PART, most: int = K.SPLIT_PARTS) -> DataFrame:
    """(category_id, label, size, part): the parts into which a crowded category would fall: its components of so many members at
    least, the largest first (ties: least label), so many at most, where there are two. members: id, category_id; pairs: id_a, id_b
    within a category."""
    inside = members.join(candidates.select(F.col("id").alias("category_id")), "category_id", "left_semi")
    lab = V.components(pairs).join(inside.select("id", "category_id"), "id")
    size = lab.groupBy("category_id", "label").agg(F.count("*").alias("size")).where(F.col("size") >= least)
    w = Window.partitionBy("category_id")
    part = size.withColumn("part", F.row_number().over(w.orderBy(F.col("size").desc(), "label"))).withColumn("of", F.count("*").over(w))
    return part.where((F.col("of") >= 2) & (F.col("part") <= most)).drop("of")


def _activity(categories: DataFrame, painpoints: DataFrame) -> DataFrame:
    """Categories but Uncategorized with their members and the time their member set last changed: the stamp, where it is missing
    the newest member's."""
    a = painpoints.where("category_id is not null").groupBy("category_id").agg(F.count("*").alias("n"), F.max("last_updated").cast("timestamp").alias("newest"))
    c = categories.where(F.col("id") != K.UNCATEGORIZED).select("id", "parent_id", F.col("member_set_last_changed_at").cast("timestamp").alias("stamp"))
    c = c.join(a, F.col("id") == F.col("category_id"), "left").withColumn("members", F.coalesce("n", F.lit(0)))
    return c.select("id", "parent_id", "members", "stamp", F.when(F.col("members") > 0, F.coalesce("stamp", "newest")).alias("last_activity"))


def delete_candidates(categories: DataFrame, painpoints: DataFrame, now: str, days: int = K.STALE_DAYS) -> DataFrame:
    """(id, metric, value, threshold): categories that ran empty (member_count), which only those with a stamp of their member set
    can have; and those with members whose last change is older than so many days (category_age_days). Seeds are no exception."""
    at = F.lit(now).cast("timestamp")
    c = _activity(categories, painpoints)
    age = (F.unix_micros(at) - F.unix_micros("last_activity")) / 86_400_000_000
    empty = (F.col("members") == 0) & F.col("stamp").isNotNull()
    stale = (F.col("members") > 0) & (F.col("last_activity") < at - F.make_interval(days=F.lit(days)))
    got = c.where(empty | stale)
    return got.select("id", F.when(empty, "member_count").otherwise("category_age_days").alias("metric"), F.when(empty, 0.0).otherwise(F.round(age, 6)).alias("value"), F.when(empty, 0.0).otherwise(float(days)).alias("threshold"))


def sibling_merges(categories: DataFrame, vectors: DataFrame, threshold: float = K.MERGE_CATEGORY, root_threshold: float = K.MERGE_ROOT) -> DataFrame:
    """Pairs of one parent (roots share none) at or above the threshold; the lower id survives. Only siblings meet."""
    c = categories.select("id", "parent_id").join(vectors.select("id", "v"), "id")
    pairs = V.pairs_within(c, "parent_id", min(threshold, root_threshold))
    return pairs.where(F.col("sim") >= F.when(F.col("key").isNull(), root_threshold).otherwise(threshold)).select(F.col("id_a").alias("survivor"), F.col("id_b").alias("loser"), F.round("sim", 6).alias("metric"))


def painpoint_pairs(painpoints: DataFrame, vectors: DataFrame, threshold: float = K.PAIR_CANDIDATE, cap: int = K.PAIRS_PER_CATEGORY) -> DataFrame:
    """The most alike pairs of each category but Uncategorized, cosine then ids descending; the survivor has the greater signal.
    Only painpoints of one category meet."""
    p = painpoints.where(F.col("category_id") != K.UNCATEGORIZED).select("id", "category_id", "signal_count")
    pairs = V.pairs_within(p.join(vectors.select("id", "v"), "id"), "category_id", threshold)
    a, b = (p.select(F.col("id").alias(f"id_{x}"), F.col("signal_count").alias(f"s{x}")) for x in "ab")
    both = pairs.join(a, "id_a").join(b, "id_b").withColumn("sim", F.round("sim", 6))
    w = Window.partitionBy("key").orderBy(F.col("sim").desc(), F.col("id_a").desc(), F.col("id_b").desc())
    keep_a = F.coalesce("sa", F.lit(1)) >= F.coalesce("sb", F.lit(1))
    survivor, loser = F.when(keep_a, F.col("id_a")).otherwise(F.col("id_b")), F.when(keep_a, F.col("id_b")).otherwise(F.col("id_a"))
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= cap).select(F.col("key").alias("category_id"), survivor.alias("survivor"), loser.alias("loser"), "sim", "rank")


def reroutes(painpoints: DataFrame, current: DataFrame, candidates: DataFrame, margin: float = K.REROUTE_MARGIN) -> DataFrame:
    """Members whose first hybrid candidate is nearer than the rest of their own category by the margin. painpoints: id,
    category_id; current: id, sim with the rest of the own category; candidates: q, id, sim, rank without the own category and
    Uncategorized. A member of Uncategorized has nothing to lose: its own nearness counts 0."""
    first = candidates.where("rank = 1").select("q", F.col("id").alias("target"), F.col("sim").alias("target_sim"))
    cur = painpoints.select("id", "category_id").join(current.select("id", "sim"), "id", "left")
    own = F.when(F.col("category_id") == K.UNCATEGORIZED, 0.0).otherwise(F.coalesce("sim", F.lit(0.0)))
    out = cur.withColumn("own", own).join(first, F.col("id") == F.col("q")).withColumn("metric", F.round(F.col("target_sim") - F.col("own"), 6))
    return out.where(F.col("metric") >= margin).select("id", "category_id", "target", "metric")


def due(members: DataFrame, centroid_moved: str | None) -> DataFrame:
    """Members that a reroute has to look at: never looked at, or changed since, or a centroid has moved since."""
    return members.where(~reroute_skip(F.col("reroute_checked_at"), F.col("last_updated"), F.lit(centroid_moved).cast("timestamp")))


def reroute_skip(checked: Column, member_changed: Column, latest_centroid: Column) -> Column:
    """A member looked at since both its own last change and the newest centroid needs no new look. One never looked at does; a
    change or centroid without a time counts as none."""
    since = lambda t: F.coalesce(t <= checked, F.lit(True))
    return checked.isNotNull() & since(member_changed) & since(latest_centroid)


def accept_deletes(events: DataFrame, categories: DataFrame, painpoints: DataFrame, now: str, days: int = K.STALE_DAYS) -> DataFrame:
    """The test before a deletion: one proposed as empty must still be, one proposed as stale must not have come to life. events: id, metric."""
    at = F.lit(now).cast("timestamp") - F.make_interval(days=F.lit(days))
    e = events.join(_activity(categories, painpoints), "id", "left")
    arrived = (F.col("metric") == "member_count") & (F.col("members") > 0)
    fresh = (F.col("metric") != "member_count") & (F.col("members") > 0) & (F.col("last_activity") >= at)
    reason = F.when(arrived, F.concat(F.lit("cascade: "), F.col("members").cast("string"), F.lit(" members arrived after propose")))
    reason = reason.when(fresh, F.concat(F.lit("member activity at "), F.date_format("last_activity", "yyyy-MM-dd HH:mm:ss"), F.lit(" is fresh"))).otherwise("applied")
    return e.select("id", "metric", reason.alias("reason"), (reason == "applied").alias("accepted"))


def accept_reroutes(events: DataFrame, painpoints: DataFrame, categories: DataFrame) -> DataFrame:
    """The test before a reroute: the member is there and where it was, the target too. events: id, category_id, target, metric."""
    p = painpoints.select("id", F.col("category_id").alias("is_in"), F.lit(True).alias("there"))
    c = categories.select(F.col("id").alias("target"), F.lit(True).alias("open"))
    e = events.join(p, "id", "left").join(c, "target", "left")
    moved = F.concat(F.lit("cascade: pp "), F.col("id").cast("string"), F.lit(" now in cat "), F.coalesce(F.col("is_in").cast("string"), F.lit("none")), F.lit(", expected "), F.col("category_id").cast("string"))
    reason = F.when(F.col("there").isNull(), "cascade: painpoint deleted").when(~F.col("is_in").eqNullSafe(F.col("category_id")), moved)
    reason = reason.when(F.col("open").isNull(), F.concat(F.lit("cascade: target category "), F.col("target").cast("string"), F.lit(" gone"))).otherwise("applied")
    return e.select("id", "category_id", "target", "metric", reason.alias("reason"), (reason == "applied").alias("accepted"))


def fold_merges(events: DataFrame, group: str, order: str) -> DataFrame:
    """The ordered fold over merges: in each group, which share no record with another, events go in order, and one that names a
    record retired before is rejected. events: survivor, loser, the group and the order; a group's events are few (a cap a
    category, the pairs of one parent). Adds accepted and reason."""
    rows = events.select(F.col(group).alias("grp"), F.col(order).alias("at"), "survivor", "loser")
    kinds = dict(rows.dtypes)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["at", "survivor", "loser"])
        done = apply_in_order(part[["survivor", "loser"]].to_dict("records"))
        return part.assign(accepted=[d["accepted"] for d in done], reason=[d["reason"] for d in done])

    return rows.groupBy("grp").applyInPandas(run, f"grp {kinds['grp']}, at {kinds['at']}, survivor long, loser long, accepted boolean, reason string")


def accept_merges(events: DataFrame, painpoints: DataFrame) -> DataFrame:
    """The test before a painpoint merge: both still there, in one category; and no earlier event of the sweep retired either."""
    p = painpoints.select("id", "category_id")
    s = p.select(F.col("id").alias("survivor"), F.col("category_id").alias("sc"))
    l = p.select(F.col("id").alias("loser"), F.col("category_id").alias("lc"))  # noqa: E741
    e = events.join(s, "survivor", "left").join(l, "loser", "left")
    reason = F.when(F.col("sc").isNull() | F.col("lc").isNull(), "cascade: painpoint deleted").when(F.col("sc") != F.col("lc"), "cascade: survivor/loser moved categories").otherwise("applied")
    return e.select("survivor", "loser", "sim", reason.alias("reason"), (reason == "applied").alias("accepted"))


def apply_in_order(events: list[dict], retired: set | None = None) -> list[dict]:
    """The ordered fold over a sweep's few accepted events: an event that names a retired side is rejected, and each gets its audit line."""
    gone, out = set(retired or ()), []
    for e in events:
        if e["survivor"] in gone or e["loser"] in gone:
            out.append({**e, "accepted": False, "reason": "cascade: survivor or loser already retired"})
        else:
            gone.add(e["loser"])
            out.append({**e, "accepted": True, "reason": "applied"})
    return out

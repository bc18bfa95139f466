"""Appliers of sweep events: from tables and accepted events to the tables after, and the audit lines.

An event set names each loser or member once; the ordered fold of ``sweep.apply_in_order`` sees to that. Tables are small
columns keyed by id; events are few beside them, and the optimiser may broadcast them by their size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..session import Scratch


def resolve(merges: DataFrame) -> DataFrame:
    """merges: survivor, loser, each loser once. The same with survivors that nothing retires, found by doubling jumps."""
    scratch = Scratch(merges.sparkSession, "resolve")
    m = scratch.write(merges.select("survivor", "loser"), "m")
    while True:
        up = m.select(F.col("loser").alias("survivor"), F.col("survivor").alias("up"))
        nxt = scratch.write(m.join(up, "survivor", "left").select(F.coalesce("up", "survivor").alias("survivor"), "loser", F.col("up").isNotNull().alias("moved")), "m")
        scratch.drop(m)
        m = nxt.select("survivor", "loser")
        m._tamarack_path = nxt._tamarack_path
        if nxt.where("moved").isEmpty():
            return m


def split_categories(categories: DataFrame, painpoints: DataFrame, parts: DataFrame, members: DataFrame, next_id: int, names: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """parts: category_id, label, part; members: id, label. Each part becomes a child of its category with an id from next_id on,
    in order of category and part, and takes its members; a category left empty that has a parent goes, its children to the parent.
    names: category_id, part, name, description, else AutoCat-n."""
    n = F.row_number().over(Window.orderBy("category_id", "part"))  # a row a part: few
    new = parts.withColumn("n", n).withColumn("new_id", (F.lit(next_id) + F.col("n") - 1).cast("long"))
    if names is not None:
        new = new.join(names, ["category_id", "part"], "left")
    else:
        new = new.withColumn("name", F.lit(None).cast("string")).withColumn("description", F.lit(None).cast("string"))
    moved = members.join(new.select("label", "category_id", "new_id"), "label").select("id", F.col("category_id").alias("was"), "new_id")
    p = painpoints.join(moved, "id", "left").withColumn("category_id", F.when(F.col("category_id") == F.col("was"), F.col("new_id")).otherwise(F.col("category_id"))).drop("was", "new_id")
    left = p.where("category_id is not null").select(F.col("category_id").alias("id")).distinct()
    empty = new.select(F.col("category_id").alias("id")).distinct().join(left, "id", "left_anti").join(categories.where("parent_id is not null").select("id", "parent_id"), "id").select(F.col("id").alias("gone"), F.col("parent_id").alias("above"))
    made = new.select(F.col("new_id").alias("id"), F.coalesce("name", F.concat(F.lit("AutoCat-"), F.col("n").cast("string"))).alias("name"), F.col("category_id").alias("parent_id"), "description", F.lit(False).alias("is_seed"))
    c = categories.unionByName(made, allowMissingColumns=True).join(empty, F.col("parent_id") == F.col("gone"), "left").withColumn("parent_id", F.coalesce("above", "parent_id")).drop("gone", "above")
    return c.join(empty.select(F.col("gone").alias("id")), "id", "left_anti"), p


def move_members(painpoints: DataFrame, moves: DataFrame, now: str) -> DataFrame:
    """moves: id, target. A moved member gets the category and the time."""
    m = moves.select("id", "target")
    out = painpoints.join(m, "id", "left").withColumn("category_id", F.coalesce("target", "category_id"))
    return out.withColumn("last_updated", F.when(F.col("target").isNotNull(), F.lit(now).cast("timestamp")).otherwise(F.col("last_updated").cast("timestamp"))).drop("target")


def merge_painpoints(painpoints: DataFrame, bridge: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """merges: survivor, loser. Signals add up, sources are repointed and those held twice fall together, losers go."""
    m = merges.select("survivor", "loser")
    more = painpoints.join(m, F.col("id") == F.col("loser")).groupBy("survivor").agg(F.sum("signal_count").alias("more"))
    kept = painpoints.join(m.select(F.col("loser").alias("id")), "id", "left_anti").join(more, F.col("id") == F.col("survivor"), "left")
    kept = kept.withColumn("signal_count", (F.col("signal_count") + F.coalesce("more", F.lit(0))).cast("long")).drop("survivor", "more")
    links = bridge.join(m, F.col("painpoint_id") == F.col("loser"), "left").select(F.coalesce("survivor", "painpoint_id").alias("painpoint_id"), "pending_painpoint_id").distinct()
    return kept, links


def merge_categories(categories: DataFrame, painpoints: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members and children of a loser go to the survivor; the loser goes."""
    m = merges.select("survivor", "loser")
    c = categories.join(m.select(F.col("loser").alias("id")), "id", "left_anti").join(m, F.col("parent_id") == F.col("loser"), "left")
    c = c.withColumn("parent_id", F.when(F.col("survivor") == F.col("id"), None).otherwise(F.coalesce("survivor", "parent_id"))).drop("survivor", "loser")
    p = painpoints.join(m, F.col("category_id") == F.col("loser"), "left").withColumn("category_id", F.coalesce("survivor", "category_id")).drop("survivor", "loser")
    return c, p


def delete_categories(categories: DataFrame, painpoints: DataFrame, pendings: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members go to the parent, else to Uncategorized. A category that a child or an observation names can't go: its event
    fails with an apply error and nothing of it changes. Gives categories, painpoints and the audit lines."""
    used = categories.select(F.col("parent_id").alias("id")).unionByName(pendings.select(F.col("category_id").alias("id"))).where("id is not null").distinct().withColumn("used", F.lit(True))
    e = ids.select("id").distinct().join(used, "id", "left").join(categories.select("id", "parent_id"), "id", "left")
    audit = e.select("id", F.col("used").isNull().alias("accepted"), F.when(F.col("used").isNull(), "applied").otherwise("apply error: still referenced").alias("reason"))
    ok = e.where("used is null").select(F.col("id").alias("gone"), F.coalesce("parent_id", F.lit(K.UNCATEGORIZED)).alias("to"))
    c = categories.join(ok.select(F.col("gone").alias("id")), "id", "left_anti")
    p = painpoints.join(ok, F.col("category_id") == F.col("gone"), "left").withColumn("category_id", F.coalesce("to", "category_id")).drop("gone", "to")
    return c, p, audit


def add_category(categories: DataFrame, painpoints: DataFrame, new: DataFrame, next_id: int) -> tuple[DataFrame, DataFrame]:
    """new: n (1, 2, ...), name, description, parent (a name or path, unknown means root), members array<long>. A name that is
    there keeps its row and takes the members; others get ids from next_id on."""
    known = categories.select(F.col("name").alias("known"), F.col("id").alias("known_id"))
    e = new.join(known, F.col("name") == F.col("known"), "left").withColumn("id", F.coalesce("known_id", F.lit(next_id) + F.col("n") - 1))
    parent = categories.select(F.col("name").alias("pname"), F.col("id").alias("parent_id"))
    rows = e.where("known_id is null").withColumn("pname", F.trim(F.element_at(F.split(F.coalesce("parent", F.lit("")), ">"), -1))).join(parent, "pname", "left")
    c = categories.unionByName(rows.select("id", "name", "parent_id", "description", F.lit(False).alias("is_seed")), allowMissingColumns=True)
    moved = e.select(F.col("id").alias("target"), F.explode("members").alias("member"))
    p = painpoints.join(moved, F.col("id") == F.col("member"), "left").withColumn("category_id", F.coalesce("target", "category_id")).drop("target", "member")
    return c, p


def audit(log: DataFrame, events: DataFrame, event_type: str, metric: str, threshold: float) -> DataFrame:
    """The log with a line for every event, accepted or not. events: id, value, accepted, reason."""
    line = events.select(F.lit(event_type).alias("event_type"), F.col("id").alias("target_category"), F.lit(metric).alias("metric_name"), F.col("value").cast("double").alias("metric_value"), F.lit(threshold).alias("threshold"), "accepted", "reason")
    return log.unionByName(line, allowMissingColumns=True)

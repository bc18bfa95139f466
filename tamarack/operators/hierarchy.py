"""Parent-child links to full hierarchies: paths, depths, roots, descendants and rings.

Level-wise frontier joins start at the roots; what no level reaches hangs below a ring. Rings are named by
doubling jumps over the unreached rows only. A null or missing parent makes a root; a null id is dropped, and of
rows that repeat an id one counts, that with the smallest parent id (null before all).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch

#: Levels that one frontier join goes down; a power of two.
HOPS = 8


def _links(df: DataFrame, id_col: str, parent_col: str, name_col: str | None) -> DataFrame:
    cols = [F.col(id_col).cast("long").alias("id"), F.col(parent_col).cast("long").alias("parent")]
    cols.append((F.col(name_col).cast("string") if name_col else F.lit(None).cast("string")).alias("name"))
    return (
        df.select(*cols).where("id is not null").groupBy("id")
        .agg(F.min(F.struct(F.col("parent"), F.col("name"))).alias("r")).select("id", "r.parent", "r.name")
    )


def _reach(edges: DataFrame, scratch: Scratch, hops: int) -> DataFrame:
    """Descendants up to so many hops below every row, by doubling: top, id, dist, ids and labels from below top to id. A row has at most as many tops as hops, so it stays within hops times the rows."""
    near = edges.select(F.col("parent").alias("top"), "id", F.lit(1).alias("dist"), F.array("id").alias("ids"), F.array("label").alias("labels"))
    k = 1
    while k < hops:
        low = near.select(F.col("top").alias("mid"), F.col("id").alias("id2"), F.col("dist").alias("dist2"), F.col("ids").alias("ids2"), F.col("labels").alias("labels2"))
        far = near.where(F.col("dist") == k).join(low, F.col("id") == F.col("mid"))
        near = scratch.write(near.unionByName(far.select("top", F.col("id2").alias("id"), (F.col("dist") + F.col("dist2")).alias("dist"), F.concat("ids", "ids2").alias("ids"), F.concat("labels", "labels2").alias("labels"))), "near")
        k *= 2
    return near


def _walk(links: DataFrame, scratch: Scratch, sep: str | None) -> DataFrame:
    """Rows reached from the roots, HOPS levels with a join: id, depth, root_id, ids and, where sep is given, path."""
    ids = links.select(F.col("id").alias("known"))
    label = F.coalesce(F.nullif(F.trim("name"), F.lit("")), F.col("id").cast("string")) if sep else F.lit("")
    links = links.withColumn("label", label)
    roots = links.join(ids, links.parent == ids.known, "left").where("known is null")  # a parent equal to the own id is a ring of one
    first = [F.col("id"), F.lit(1).alias("depth"), F.col("id").alias("root_id"), F.array("id").alias("ids"), F.array("label").alias("labels")]
    level = scratch.write(roots.select(*first, F.lit(True).alias("front")), "level")
    levels = [level]
    near = _reach(links.where("parent is not null"), scratch, HOPS).select("top", F.col("id").alias("id2"), "dist", F.col("ids").alias("ids2"), F.col("labels").alias("labels2"))
    while True:
        nxt = level.where("front").join(near, F.col("id") == F.col("top"))
        level = scratch.write(nxt.select(F.col("id2").alias("id"), (F.col("depth") + F.col("dist")).alias("depth"), "root_id", F.concat("ids", "ids2").alias("ids"), F.concat("labels", "labels2").alias("labels"), (F.col("dist") == HOPS).alias("front")), "level")
        if level.isEmpty():
            break
        levels.append(level)
    reached = scratch.spark.read.schema(level.schema).parquet(*[x._tamarack_path for x in levels])
    return reached.select("id", "depth", "root_id", "ids", *([F.concat_ws(sep, "labels").alias("path")] if sep else []))


def _rings(links: DataFrame, reached: DataFrame, scratch: Scratch) -> DataFrame:
    """id and loop_id of every row that no root reaches. After 2^k >= rows jumps each row stands in its ring, and the
    least id on the next 2^k steps from there is the ring's least."""
    rest = scratch.write(links.join(reached.select("id"), "id", "left_anti").select("id", "parent"), "rest")
    n = rest.count()
    step = rest.select("id", F.col("parent").alias("jump"), F.col("id").alias("least"))
    for _ in range(max(1, math.ceil(math.log2(max(2, n))))):
        to = step.select(F.col("id").alias("jump"), F.col("jump").alias("jump2"), F.col("least").alias("least2"))
        new = scratch.write(step.join(to, "jump").select("id", F.col("jump2").alias("jump"), F.least("least", "least2").alias("least")), "jump")
        scratch.drop(step)
        step = new
    ring = step.select(F.col("id").alias("at"), F.col("least").alias("loop_id"))
    return step.join(ring, step.jump == ring["at"]).select("id", "loop_id")


def hierarchy(df: DataFrame, id_col: str = "id", parent_col: str = "parent_id", name_col: str = "name", sep: str = " > ") -> DataFrame:
    """One row an id: parent_id, depth (roots 1), root_id, path, ids (array from the root), n_descendants, in_ring, loop_id.

    Rows below or in a ring have null depth, root, path and ids; their descendants are not counted (null). Other
    columns of df are left out, so names can't clash. A null or blank name stands as the id. An empty df gives none.
    """
    scratch = Scratch(df.sparkSession, "hierarchy")
    links = scratch.write(_links(df, id_col, parent_col, name_col), "links")
    reached = _walk(links, scratch, sep)
    rings = _rings(links, reached, scratch)
    below = descendants_of(reached).groupBy(F.col("ancestor_id").alias("id")).agg(F.count("*").alias("n_descendants"))
    return (
        links.select("id", F.col("parent").alias("parent_id")).join(reached, "id", "left").join(below, "id", "left").join(rings, "id", "left")
        .select("id", "parent_id", "depth", "root_id", "path", "ids", F.when(F.col("depth").isNotNull(), F.coalesce("n_descendants", F.lit(0))).cast("long").alias("n_descendants"),
                F.col("loop_id").isNotNull().alias("in_ring"), "loop_id")
    )


def descendants_of(reached: DataFrame) -> DataFrame:
    """Ancestor pairs (ancestor_id, descendant_id, distance) from rows with ids; a row isn't its own descendant."""
    pos = reached.select(F.col("id").alias("descendant_id"), "depth", F.posexplode("ids").alias("pos", "ancestor_id"))
    return pos.where("pos < depth - 1").select("ancestor_id", "descendant_id", (F.col("depth") - F.col("pos") - 1).cast("int").alias("distance"))


def ancestor_pairs(df: DataFrame, id_col: str = "id", parent_col: str = "parent_id") -> DataFrame:
    scratch = Scratch(df.sparkSession, "hierarchy")
    links = scratch.write(_links(df, id_col, parent_col, None), "links")
    return descendants_of(_walk(links, scratch, None))


def rings(df: DataFrame, id_col: str = "id", parent_col: str = "parent_id") -> DataFrame:
    """id and loop_id (least id of the ring) of the rows in a ring or below one."""
    scratch = Scratch(df.sparkSession, "hierarchy")
    links = scratch.write(_links(df, id_col, parent_col, None), "links")
    return _rings(links, _walk(links, scratch, None), scratch)

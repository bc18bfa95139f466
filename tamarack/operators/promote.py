"""Ordered merging of observations into canonical records, and ordered packing.

Each item, in the order of its id, links to the nearest canonical record at or above the threshold or becomes one. Spark
finds the sparse edges (item to earlier item or to a held record) exactly; items of different components of these edges
can't touch each other, so each component is folded by itself, in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from . import vectors as V

LINKS = "id long, action string, target long, sim double"


def fold(items: list[int], edges: dict[int, list[tuple[float, int, bool]]]) -> list[tuple[int, str, int, float | None]]:
    """items in order; edges: item -> (cosine, other, whether other is a held record). The serial rule itself."""
    leaders: set[int] = set()
    out = []
    for i in items:
        open_ = [(s, -o, held) for s, o, held in edges.get(i, ()) if held or o in leaders]
        if open_:
            s, o, held = max(open_)
            out.append((i, "link_held" if held else "link", -o, s))
        else:
            leaders.add(i)
            out.append((i, "create", i, None))
    return out


def promote(items: DataFrame, held: DataFrame, threshold: float = K.MERGE_COSINE) -> DataFrame:
    """(id, action, target, sim): create, link (to an item that was created), link_held. items and held: id, v. Ties go to the lower id, held records first."""
    inner = V.similarity_join(items, threshold).select(F.col("id_b").alias("id"), F.col("id_a").alias("other"), "sim", F.lit(False).alias("held"))
    outer = V.nearest(items, held, 1, threshold, exclude_self=False).select(F.col("q").alias("id"), F.col("id").alias("other"), "sim", F.lit(True).alias("held"))
    lab = V.components(inner.select(F.col("id").alias("id_b"), F.col("other").alias("id_a")), items)
    mine = inner.unionByName(outer).groupBy("id").agg(F.collect_list(F.struct("sim", "other", "held")).alias("es"))
    rows = lab.join(mine, "id", "left")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id")
        edges = {int(i): [(e["sim"], int(e["other"]), bool(e["held"])) for e in (es if es is not None else [])] for i, es in zip(part["id"], part["es"])}
        return pd.DataFrame(fold(list(edges), edges), columns=["id", "action", "target", "sim"])

    return rows.groupBy("label").applyInPandas(run, LINKS)


def save_pendings(new: DataFrame, held: DataFrame, threshold: float = K.PENDING_MERGE) -> DataFrame:
    """The same rule for incoming observations: a near one is an extra source of the first, the rest are inserted."""
    got = promote(new, held, threshold)
    return got.select("id", F.when(F.col("action") == "create", "insert").otherwise("extra_source").alias("action"), "target", "sim")


def apply_links(painpoints: DataFrame, links: DataFrame, pendings: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The tables after a promotion: signals grow by the distinct sources of each linked item, created ones come in."""
    n = sources.groupBy("pending_painpoint_id").agg(F.count("*").alias("n"))
    got = links.join(n, links.id == n.pending_painpoint_id, "left").withColumn("n", F.greatest(F.coalesce("n", F.lit(1)), F.lit(1)))
    grown = got.where("action = 'link_held'").groupBy("target").agg(F.sum("n").alias("more"))
    held = painpoints.join(grown, painpoints.id == grown.target, "left").withColumn("signal_count", (F.col("signal_count") + F.coalesce("more", F.lit(0))).cast("long")).drop("target", "more")
    new = got.where("action <> 'link_held'").groupBy("target").agg(F.sum("n").cast("long").alias("signal_count"))
    made = pendings.dropDuplicates(["id"]).join(new, F.col("id") == F.col("target")).select("id", "title", F.coalesce("description", F.lit("")).alias("description"), "severity", "signal_count")
    return held, made


def pack(rows: DataFrame, budget: int = K.BATCH_TOKENS) -> DataFrame:
    """Batches in order within each group, closed when the next row would pass the budget; a larger row is a batch alone.
    rows: grp, id, tokens. A sorted stream carries one counter, so a group of any size needs no memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grp, batch, used = object(), 0, 0
        for b in batches:
            out = []
            for g, t in zip(b.column("grp").to_pylist(), b.column("tokens").to_pylist()):
                if g != grp:
                    grp, batch, used = g, 0, 0
                if used and used + t > budget:
                    batch, used = batch + 1, 0
                used += t
                out.append(batch)
            yield pa.RecordBatch.from_arrays([b.column("grp"), b.column("id"), b.column("tokens"), pa.array(out, pa.int64())], ["grp", "id", "tokens", "batch"])

    return rows.select("grp", "id", F.col("tokens").cast("long").alias("tokens")).repartition("grp").sortWithinPartitions("grp", "id").mapInArrow(run, "grp string, id long, tokens long, batch long")

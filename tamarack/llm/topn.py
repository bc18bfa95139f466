"""Top N items within every group, by partition lower bounds.

The N-th best score of a group within any part of the rows is a lower bound of its N-th best overall. Each partition keeps
the N best of every group that it has seen and gives the N-th as a bound; the best bound of a group is joined back, rows
below it go, and only survivors are ranked. A partition holds HELD rows at most: where it has seen more groups than that,
it gives the bounds it has and begins anew, which only makes them lower.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Rows that a partition holds at most, and rows that it reads before it sorts again.
HELD, READ = 1_000_000, 200_000


def partition_bounds(rows: DataFrame, n: int) -> DataFrame:
    """rows: grp string, s1, s2, item long, items distinct. Gives (grp, s1, s2, item) rows that are the n-th best of the group within a partition."""

    def best(t: pa.Table) -> tuple[pa.Table, np.ndarray]:
        """The n best rows of each group, and the places of the n-th among them."""
        t = t.combine_chunks()
        g = pc.dictionary_encode(t.column("grp").combine_chunks()).indices.to_numpy(zero_copy_only=False)
        s1, s2, item = (t.column(c).to_numpy() for c in ("s1", "s2", "item"))
        order = np.lexsort((item, -s2, -s1, g))
        g = g[order]
        start = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        place = np.arange(len(g)) - np.repeat(start, np.diff(np.r_[start, len(g)]))
        keep = place < n
        return t.take(pa.array(order[keep])), np.flatnonzero(place[keep] == n - 1)

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = kept = 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows - kept >= READ:
                t, last = best(pa.Table.from_batches(held))
                if t.num_rows > HELD:
                    yield from t.take(pa.array(last)).to_batches()
                    held, rows = [], 0
                else:
                    held, rows = t.to_batches(), t.num_rows
                kept = rows
        if rows:
            t, last = best(pa.Table.from_batches(held))
            yield from t.take(pa.array(last)).to_batches()

    return rows.mapInArrow(bounds, rows.schema)


def top_n_per_group(df: DataFrame, group: str, item: str, scores: tuple[str, str], n: int = 5, latest: str | None = None) -> DataFrame:
    """(grp, item, s1, s2, rank): the n highest items of each group by the two scores descending, then item ascending.

    Null scores count 0; rows with a null group or item are left out; an item that comes repeatedly counts once, with
    the row latest by ``latest`` (ties: highest scores, then least group). Groups of fewer than n keep all. Other columns are ignored.
    """
    s1, s2 = (F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(f"s{i}") for i, c in enumerate(scores, 1))
    last = F.col(latest) if latest else F.lit(0)
    rows = df.select(F.col(group).cast("string").alias("grp"), F.col(item).cast("long").alias("item"), s1, s2, last.alias("last")).where("grp is not null and item is not null")
    one = rows.groupBy("item").agg(F.max_by(F.struct("grp", "s1", "s2"), F.struct("last", "s1", "s2", "grp")).alias("r")).select("r.grp", "r.s1", "r.s2", "item")
    best = partition_bounds(one, n).groupBy("grp").agg(F.max(F.struct(F.col("s1"), F.col("s2"), (-F.col("item")).alias("neg"))).alias("bound"))
    kept = one.join(best, "grp", "left").where(F.col("bound").isNull() | (F.struct(F.col("s1"), F.col("s2"), (-F.col("item")).alias("neg")) >= F.col("bound")))
    w = Window.partitionBy("grp").orderBy(F.col("s1").desc(), F.col("s2").desc(), F.col("item").asc())
    return kept.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("grp", "item", "s1", "s2", "rank")

"""Vector operators: cosine, nearest neighbours, similarity join, centroids, blends, components.

Vectors are arrays of doubles. Searches put the query side, in blocks of at most BLOCK rows, against all rows: each block
is broadcast (its size is bounded by the parameter), rows are scanned in Arrow batches by matrix product, and only what
is asked for comes out. No pair is built that isn't kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..session import Scratch

BLOCK = 4096


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0 or a vector is missing."""
    n = norm(a) * norm(b)
    return F.coalesce(F.when(n > 0, dot(a, b) / n), F.lit(0.0))


def normalise(a: Column) -> Column:
    """To length 1; a zero vector stays."""
    return F.when(norm(a) > 0, F.transform(a, lambda x: x / norm(a))).otherwise(a)


def valid(df: DataFrame, dim: int, vec: str = "v") -> DataFrame:
    """Rows whose vector is there and has the dimension."""
    return df.where((F.size(vec) == dim) & ~F.exists(vec, lambda x: x.isNull()))


def require(df: DataFrame, dim: int, vec: str = "v") -> DataFrame:
    """Fails on a vector of another dimension, as a write must."""
    return df.withColumn(vec, F.when(F.size(vec) == dim, F.col(vec)).otherwise(F.raise_error(F.concat(F.lit("vector dimension "), F.size(vec).cast("string")))))


def replace(held: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return held.join(new.select(key), key, "left_anti").unionByName(new)


def _rows(m: list, width: int) -> np.ndarray:
    x = np.asarray(m, np.float64).reshape(len(m), -1) if m else np.empty((0, width))
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _against(queries: DataFrame, corpus: DataFrame, keep, block: int) -> DataFrame:
    """(q, id, sim) of what ``keep(sims, q ids, ids)`` selects in each batch. Both sides: id long, v array<double>."""
    spark = corpus.sparkSession
    qs = Scratch(spark, "queries").write(queries.select("id", "v").where("v is not null").orderBy("id"), "q")
    n = qs.count()
    if not n:
        return spark.createDataFrame([], "q long, id long, sim double")
    pieces = max(1, -(-n // block))
    cuts = [int(c) for c in qs.approxQuantile("id", [i / pieces for i in range(1, pieces)], 0.1 / pieces)] if pieces > 1 else []
    edges = [None, *sorted(set(cuts)), None]
    out = []
    for lo, hi in zip(edges, edges[1:]):
        part = qs
        if lo is not None:
            part = part.where(F.col("id") > lo)
        if hi is not None:
            part = part.where(F.col("id") <= hi)
        got = part.toPandas()  # about ``block`` rows
        held = spark.sparkContext.broadcast((got["id"].to_numpy(np.int64), _rows(got["v"].tolist(), 1)))

        def scan(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            qid, q = held.value
            for b in batches:
                ids = b.column(0).to_numpy(zero_copy_only=False)
                if not len(ids) or not len(qid):
                    continue
                sims = q @ _rows(b.column(1).to_pylist(), q.shape[1]).T
                i, j = keep(sims, qid, ids)
                yield pa.RecordBatch.from_arrays([pa.array(qid[i]), pa.array(ids[j]), pa.array(sims[i, j])], ["q", "id", "sim"])

        out.append(corpus.select(F.col("id").cast("long").alias("id"), "v").where("v is not null").mapInArrow(scan, "q long, id long, sim double"))
    return reduce(DataFrame.unionByName, out)


def nearest(queries: DataFrame, corpus: DataFrame, k: int, floor: float | None = None, exclude_self: bool = True, block: int = BLOCK) -> DataFrame:
    """The k nearest of every query by exact cosine, ties by id: (q, id, sim, rank)."""

    def keep(sims, qid, ids):
        s = np.where(qid[:, None] == ids[None, :], -9.0, sims) if exclude_self else sims
        if floor is not None:
            s = np.where(s >= floor, s, -9.0)
        n = min(k, s.shape[1])
        if n < s.shape[1]:  # every value as great as the n-th, so that ties are settled by id at the end
            least = np.partition(s, s.shape[1] - n, axis=1)[:, s.shape[1] - n]
            return np.nonzero((s >= least[:, None]) & (s > -9.0))
        return np.nonzero(s > -9.0)

    w = Window.partitionBy("q").orderBy(F.col("sim").desc(), "id")
    return _against(queries, corpus, keep, block).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def similarity_join(vectors: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """(id_a, id_b, sim), id_a < id_b, of cosine at least the threshold, exactly, block by block."""
    keep = lambda sims, qid, ids: np.nonzero((sims >= threshold) & (qid[:, None] < ids[None, :]))
    return _against(vectors, vectors, keep, block).select(F.col("q").alias("id_a"), F.col("id").alias("id_b"), "sim")


#: Vectors of one key that are met in one place.
TILE = 1024


def pairs_within(vectors: DataFrame, key: str, threshold: float, tile: int = TILE) -> DataFrame:
    """(key, id_a, id_b, sim), id_a < id_b, of the pairs of one key with a cosine of at least the threshold, exactly.

    vectors: id, v and the key; a null key is a key too. Only vectors of one key meet. A key's vectors are split into tiles,
    each pair of tiles is a cell of at most two tiles, so a key of any size takes bounded memory.
    """
    rows = vectors.select(F.col("id").cast("long").alias("id"), F.col(key).alias("key"), "v").where("v is not null and id is not null")
    n = rows.groupBy("key").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles")).withColumnRenamed("key", "of")
    rows = rows.join(n, F.col("key").eqNullSafe(F.col("of"))).withColumn("t", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    cell = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda j: F.struct(F.least("t", j).alias("i"), F.greatest("t", j).alias("j")))
    rows = rows.select("key", "id", "v", "t", F.explode(cell).alias("c")).select("key", "c.i", "c.j", "t", "id", "v")
    out = vectors.select(F.col(key).alias("key")).schema["key"].dataType.simpleString()

    def meet(part: pd.DataFrame) -> pd.DataFrame:
        i, j = part["i"].iloc[0], part["j"].iloc[0]
        a = part[part["t"] == i]
        b = a if i == j else part[part["t"] == j]
        ia, ib = a["id"].to_numpy(), b["id"].to_numpy()
        sims = _rows(a["v"].tolist(), 1) @ _rows(b["v"].tolist(), 1).T if len(a) and len(b) else np.empty((len(a), len(b)))
        x, y = np.nonzero((sims >= threshold) & ((ia[:, None] < ib[None, :]) if i == j else (ia[:, None] != ib[None, :])))
        got = pd.DataFrame({"id_a": np.minimum(ia[x], ib[y]), "id_b": np.maximum(ia[x], ib[y]), "sim": sims[x, y]})
        got.insert(0, "key", part["key"].iloc[0])
        return got

    return rows.groupBy("key", "i", "j").applyInPandas(meet, f"key {out}, id_a long, id_b long, sim double")


def centroids(vectors: DataFrame, by: str, vec: str = "v") -> DataFrame:
    """Sum, count and normalised mean by group, added up by position: no group is collected."""
    n = vectors.groupBy(by).agg(F.count("*").alias("n"))
    pos = vectors.select(by, F.posexplode(vec).alias("pos", "x")).groupBy(by, "pos").agg(F.sum("x").alias("s"))
    s = pos.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda r: r.s).alias("total"))  # dimension values
    return s.join(n, by).select(by, "n", "total", normalise(F.transform("total", lambda x: x / F.col("n"))).alias("centroid"))


def blend(anchor: Column, mean: Column, is_seed: Column) -> Column:
    """w * anchor + (1 - w) * mean, normalised; one of them alone where the other is missing."""
    w = F.when(is_seed, K.ANCHOR_WEIGHT_SEED).otherwise(K.ANCHOR_WEIGHT_RUNTIME)
    both = normalise(F.zip_with(anchor, mean, lambda a, m: w * a + (1 - w) * m))
    return F.when(anchor.isNotNull() & mean.isNotNull(), both).otherwise(F.coalesce(anchor, mean))


def shift(total: Column, n: Column, v: Column, sign: int) -> tuple[Column, Column]:
    """A running (sum, count) with a vector added or taken away; the count never falls below 0, and none left means a zero sum."""
    m = F.greatest(F.lit(0), n + sign)
    s = F.zip_with(total, v, lambda a, b: a + sign * b)
    return F.when(m > 0, s).otherwise(F.transform(total, lambda x: x * 0.0)), m


def leave_one_out(vectors: DataFrame, by: str) -> DataFrame:
    """Cosine of each member with the centroid of the others of its group; alone in a group it is 0."""
    c = centroids(vectors, by).select(by, "n", "total")
    rest = F.zip_with("total", "v", lambda s, x: s - x)
    return vectors.join(c, by).select("id", by, F.when(F.col("n") > 1, cosine(F.col("v"), rest)).otherwise(0.0).alias("sim"))


def components(edges: DataFrame, nodes: DataFrame | None = None, a: str = "id_a", b: str = "id_b") -> DataFrame:
    """(id, label): least id of the connected component; nodes without an edge are their own.

    Least labels spread along the edges, and each round also jumps to the label's own label, so the rounds grow with the
    logarithm of the longest chain in the usual case.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "components")
    both = scratch.write(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).unionByName(edges.select(F.col(b).alias("u"), F.col(a).alias("v"))).distinct(), "edges")
    lab = scratch.write(both.select(F.col("u").alias("id")).distinct().withColumn("label", F.col("id")), "lab")
    while True:
        near = both.join(lab, both.v == lab.id).groupBy("u").agg(F.min("label").alias("m"))
        new = lab.join(near, lab.id == near.u).select("id", F.least("label", "m").alias("label"))
        up = new.select(F.col("id").alias("at"), F.col("label").alias("up"))
        nxt = scratch.write(new.join(up, new.label == up["at"]).select("id", F.least("label", "up").alias("label")), "lab")
        changed = nxt.join(lab.withColumnRenamed("label", "old"), "id").where("label <> old").isEmpty()
        scratch.drop(lab)
        lab = nxt
        if changed:
            break
    if nodes is None:
        return lab
    return nodes.select("id").distinct().join(lab, "id", "left").select("id", F.coalesce("label", "id").alias("label"))


def cluster_summary(edges: DataFrame, nodes: DataFrame, thresholds: list[float]) -> DataFrame:
    """Number of components, largest size and singletons of the similarity graph at each threshold."""
    parts = []
    for t in thresholds:
        sizes = components(edges.where(F.col("sim") >= t), nodes).groupBy("label").agg(F.count("*").alias("size"))
        parts.append(sizes.agg(F.count("*").alias("components"), F.max("size").alias("largest"), F.count_if(F.col("size") == 1).alias("singletons")).withColumn("threshold", F.lit(float(t))))
    return reduce(DataFrame.unionByName, parts)

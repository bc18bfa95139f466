"""Keyword and hybrid retrieval: BM25 over an inverted index, reciprocal rank fusion, gates on the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as T
from . import vectors as V


def raw_tokens(c: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+"), lambda t: (F.length(t) >= 2) & ~t.isin("and", "or", "not", "near"))


def index(docs: DataFrame, text: str = "text") -> DataFrame:
    """(id, term, tf, dl): the inverted index, computed from the documents, so it is never out of step."""
    t = docs.select("id", raw_tokens(F.col(text)).alias("ts")).withColumn("dl", F.size("ts"))
    return t.select("id", "dl", F.explode("ts").alias("term")).groupBy("id", "dl", "term").agg(F.count("*").alias("tf"))


def bm25(queries: DataFrame, docs: DataFrame, k: int, text: str = "text") -> DataFrame:
    """(q, id, score, rank) of the k best documents of any query term, ties by id. queries: q, text."""
    inv = index(docs, text)
    stats = docs.select(F.size(raw_tokens(F.col(text))).alias("dl")).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))  # one row
    df = inv.groupBy("term").agg(F.count("*").alias("df"))
    terms = queries.select("q", F.explode(T.search_tokens(F.col("text"))).alias("term"))
    hits = terms.join(df, "term").join(inv, "term").join(F.broadcast(stats))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K.BM25_K1 + 1) / (F.col("tf") + K.BM25_K1 * (1 - K.BM25_B + K.BM25_B * F.col("dl") / F.col("avgdl")))
    score = hits.groupBy("q", "id").agg(F.round(F.sum(part), 6).alias("score"))
    w = Window.partitionBy("q").orderBy(F.col("score").desc(), "id")
    return score.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def fuse(dense: DataFrame, lexical: DataFrame, k: int | None = K.RRF_TOP) -> DataFrame:
    """Reciprocal rank fusion of two (q, id, rank) lists, ranks from 1 here and from 0 in the formula; equal scores keep the
    dense order, then the lexical one. k: how many come out, None for all."""
    one = lambda df, n: df.select("q", "id", (1 / (F.lit(K.RRF_K) + F.col("rank") - 1)).alias("s"), F.struct(F.lit(n).alias("list"), "rank").alias("seen"))
    both = one(dense, 0).unionByName(one(lexical, 1)).groupBy("q", "id").agg(F.sum("s").alias("rrf"), F.min("seen").alias("seen"))
    w = Window.partitionBy("q").orderBy(F.round("rrf", 12).desc(), "seen")
    ranked = both.withColumn("rank", F.row_number().over(w))
    return (ranked if k is None else ranked.where(F.col("rank") <= k)).select("q", "id", F.round("rrf", 9).alias("rrf"), "rank")


def hybrid(queries: DataFrame, categories: DataFrame, asks: DataFrame, docs: DataFrame, exclude: DataFrame, k: int = K.RRF_TOP) -> DataFrame:
    """(q, id, sim, rrf, rank): categories near a query by vector or by words, fused. queries: q, v; categories: id, v; asks: q,
    text; docs: id, text; exclude: q, id.

    Uncategorized is always left out, and what exclude names. Each list is cut to k without the excluded ones; what both hold
    comes out whole. sim is the cosine of every one, 0 where a vector is missing; it decides, the fusion only finds.
    """
    out = exclude.select("q", "id").where("id is not null").unionByName(queries.select("q", F.lit(K.UNCATEGORIZED).cast("long").alias("id"))).distinct()
    most = out.groupBy("q").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    w = Window.partitionBy("q").orderBy("rank")

    def cut(df: DataFrame) -> DataFrame:
        left = df.select("q", "id", "rank").join(out, ["q", "id"], "left_anti")
        return left.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    dense = V.nearest(queries.select(F.col("q").alias("id"), "v"), categories, k + most, exclude_self=False)
    got = fuse(cut(dense), cut(bm25(asks, docs, k + most)), None)
    got = got.join(queries.select("q", F.col("v").alias("qv")), "q").join(categories.select("id", F.col("v").alias("cv")), "id", "left")
    return got.select("q", "id", V.cosine(F.col("qv"), F.col("cv")).alias("sim"), "rrf", "rank")


def creation_gate(best: Column, threshold: float = K.SIMILAR_CATEGORY) -> Column:
    return F.when(best >= threshold, "absorb").otherwise("create")


def split_fate(best: Column, parent: Column, same_root: Column, absorb: float = K.SIMILAR_CATEGORY, least: float = K.CROSS_PARENT_MIN, margin: float = K.CROSS_PARENT_MARGIN) -> Column:
    """absorb a subcategory like an existing one, replant it under another root that it is closer to, or create it."""
    return F.when(best >= absorb, "absorb").when((best >= least) & (best - parent >= margin) & ~same_root, "replant").otherwise("create")

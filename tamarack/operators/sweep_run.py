"""One sweep over the category tree: seven ordered passes, each proposing from the state that the pass before left, testing, applying
and writing an audit line for every event."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..session import Scratch
from . import apply as A
from . import retrieval as R
from . import sweep as W
from . import vectors as V

AUDIT = ("event_type", "target", "metric", "value", "accepted", "reason")


@dataclass(frozen=True)
class State:
    """categories: id, name, parent_id, description, is_seed, member_set_last_changed_at; painpoints: id, title, description, severity,
    signal_count, category_id, last_updated; bridge: painpoint_id, pending_painpoint_id; pendings: id, category_id; vectors: id, v of
    painpoints; anchors: id, v of categories."""

    categories: DataFrame
    painpoints: DataFrame
    bridge: DataFrame
    pendings: DataFrame
    vectors: DataFrame
    anchors: DataFrame

    def members(self) -> DataFrame:
        return self.painpoints.join(self.vectors, "id")

    def centroids(self) -> DataFrame:
        """(id, v) of every category but Uncategorized that has an anchor or members with vectors, both blended."""
        mean = V.centroids(self.members().where("category_id is not null").select("category_id", "v"), "category_id").select(F.col("category_id").alias("id"), "centroid")
        c = self.categories.where(F.col("id") != K.UNCATEGORIZED).select("id", "is_seed").join(mean, "id", "left").join(self.anchors.withColumnRenamed("v", "anchor"), "id", "left")
        return c.select("id", V.blend(F.col("anchor"), F.col("centroid"), F.coalesce("is_seed", F.lit(False))).alias("v")).where("v is not null")


@dataclass(frozen=True)
class Thresholds:
    cluster: float = K.MERGE_COSINE
    split: float = K.MERGE_COSINE
    sibling: float = K.MERGE_CATEGORY
    root: float = K.MERGE_ROOT
    pair: float = K.PAIR_CANDIDATE
    margin: float = K.REROUTE_MARGIN
    stale_days: int = K.STALE_DAYS


def _line(events: DataFrame, kind: str, target: str, metric: str, value) -> DataFrame:
    value = F.col(value) if isinstance(value, str) else value
    return events.select(F.lit(kind).alias("event_type"), F.col(target).cast("long").alias("target"), F.lit(metric).alias("metric"), value.cast("double").alias("value"), "accepted", "reason")


def run_sweep(state: State, now: str, limits: Thresholds = Thresholds(), confirm: Callable[[DataFrame], DataFrame] | None = None, name: Callable[[DataFrame], DataFrame] | None = None) -> tuple[State, DataFrame, DataFrame]:
    """(state after, audit, summary). confirm keeps those of the proposed painpoint merges that an outside judge confirms, none by
    default; name gives parts (category_id, part) a name and description, AutoCat-n by default.

    An empty state gives no events. A record that an event before retired rejects the event. Every pass ends in written tables.
    """
    scratch = Scratch(state.categories.sparkSession, "sweep")
    lines: list[DataFrame] = []

    def log(events: DataFrame, kind: str, target: str, metric: str, value) -> DataFrame:
        events = scratch.write(events, kind)
        lines.append(_line(events, kind, target, metric, value))
        return events.where("accepted")

    def kept(s: State, **tables: DataFrame) -> State:
        return replace(s, **{k: scratch.write(df, k) for k, df in tables.items()})

    def next_id(s: State) -> int:
        return (s.categories.agg(F.max("id")).first()[0] or 0) + 1

    applied = (F.lit(True).alias("accepted"), F.lit("applied").alias("reason"))

    # 1 clusters of Uncategorized become categories
    m = state.members().where(F.col("category_id") == K.UNCATEGORIZED).select("id", "category_id", "signal_count", "severity", "v")
    pairs = V.pairs_within(m, "category_id", limits.cluster)
    lab = scratch.write(W.uncategorised_clusters(m.select("id"), pairs, limits.cluster), "clusters")
    new = log(lab.groupBy("label").agg(F.first("size").alias("size")).select("label", "size", *applied), "uncategorized", "label", "cluster_size", "size")
    parts = new.select(F.lit(K.UNCATEGORIZED).cast("long").alias("category_id"), "label", F.col("label").alias("part"))
    c, p = A.split_categories(state.categories, state.painpoints, parts, lab.select("id", "label"), next_id(state), name and name(parts))
    c = c.withColumn("parent_id", F.when(F.col("parent_id") != K.UNCATEGORIZED, F.col("parent_id")))  # they are roots
    after = kept(state, categories=c, painpoints=p)

    # 1b members that fit nowhere are for review; nothing is applied without a decision
    near = V.nearest(m.select("id", "v"), after.centroids(), 1, exclude_self=False)
    alone = W.homeless(m.select("id", "signal_count", "severity"), lab, near)
    log(alone.select("id", "priority", F.lit(False).alias("accepted"), F.lit("no decision").alias("reason")), "uncat_llm_review", "id", "priority", "priority")

    # 2 crowded categories fall into parts
    m = after.members().where(F.col("category_id") != K.UNCATEGORIZED).select("id", "category_id", "v")
    pairs = scratch.write(V.pairs_within(m, "category_id", limits.split), "pairs")
    crowded = W.split_candidates(after.categories, after.painpoints, F.lit(0)).where(F.col("id") != K.UNCATEGORIZED)
    parts = log(W.split_clusters(crowded, m.select("id", "category_id"), pairs).select("category_id", "label", "size", "part", *applied), "split", "category_id", "llm_split_decision", "size")
    c, p = A.split_categories(after.categories, after.painpoints, parts.select("category_id", "label", "part"), V.components(pairs), next_id(after), name and name(parts))
    after = kept(after, categories=c, painpoints=p)

    # 3 dead categories go
    events = W.delete_candidates(after.categories, after.painpoints, now, limits.stale_days)
    tested = events.join(W.accept_deletes(events.select("id", "metric"), after.categories, after.painpoints, now, limits.stale_days).drop("metric"), "id")
    c, p, audit = A.delete_categories(after.categories, after.painpoints, after.pendings, tested.where("accepted").select("id"))
    rest = tested.where("not accepted").select("id", "accepted", "reason")
    log(audit.select("id", "accepted", "reason").unionByName(rest).join(events.select("id", "value"), "id"), "delete", "id", "member_count or category_age_days", "value")
    after = kept(after, categories=c, painpoints=p)

    # 4 siblings that are one
    e = W.sibling_merges(after.categories, after.centroids(), limits.sibling, limits.root)
    e = e.join(after.categories.select(F.col("id").alias("survivor"), F.coalesce("parent_id", F.lit(0)).alias("parent")), "survivor").withColumn("at", F.struct("survivor", "loser").cast("string"))
    folded = W.fold_merges(e, "parent", "at").drop("at").join(e.select("survivor", "loser", "metric"), ["survivor", "loser"])
    merges = log(folded, "merge", "survivor", "merge_text_sim", "metric")
    c, p = A.merge_categories(after.categories, after.painpoints, A.resolve(merges))
    after = kept(after, categories=c, painpoints=p)

    # 4.5 painpoints of a category that are one, if the judge says so
    e = scratch.write(W.painpoint_pairs(after.painpoints, after.vectors, limits.pair), "pairs")
    sure = confirm(e) if confirm else e.limit(0)
    folded = W.fold_merges(sure, "category_id", "rank").join(sure.select("survivor", "loser", "sim"), ["survivor", "loser"])
    merges = log(folded, "painpoint_merge", "survivor", "cosine", "sim")
    p, b = A.merge_painpoints(after.painpoints, after.bridge, A.resolve(merges))
    after = kept(after, painpoints=p, bridge=b)

    # 5 members nearer to another category
    m = scratch.write(after.members(), "members")
    docs = after.categories.select("id", F.concat_ws(" ", "name", "description").alias("text"))
    asks = m.select(F.col("id").alias("q"), F.concat_ws(" ", "title", "description").alias("text"))
    own = m.where("category_id is not null").select(F.col("id").alias("q"), F.col("category_id").alias("id"))
    cand = R.hybrid(m.select(F.col("id").alias("q"), "v"), after.centroids(), asks, docs, own)
    e = W.reroutes(m.select("id", "category_id"), V.leave_one_out(m, "category_id"), cand, limits.margin)
    moved = log(W.accept_reroutes(e, after.painpoints, after.categories), "reroute", "id", "reroute_margin", "metric")
    after = kept(after, painpoints=A.move_members(after.painpoints, moved, now))

    audit = scratch.write(reduce(DataFrame.unionByName, lines), "audit")
    summary = audit.groupBy("event_type").agg(F.count("*").alias("proposed"), F.count_if("accepted").alias("accepted"))
    return after, audit, summary

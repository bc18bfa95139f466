"""Mixing sources to target weights by entropy balancing.

A document's rate w minimises the relative entropy to one copy each, subject to two moments of every source: its tokens
(target share of the total) and its documents (tokens over the source's mean length, so the lengths keep their
distribution). The optimum is a tilt w = min(cap, exp(a + b * tokens)) by source, and the dual in (a, b) is convex.
Newton steps need sums of w, w * tokens and w * tokens^2 by source, one distributed aggregate for all mixes and
sources. Rates become whole copies by a hashed threshold that is tuned, again on aggregates, to meet the tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch

#: The vocabulary's file name; where the file lies is a parameter.
VOCABULARY = "byte_bpe_50k.tiktoken"
STEPS = 100
BUCKETS = 4096


def tokenizer_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def count_tokens(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, tokens), the source trimmed and lower-cased; a null text has no tokens."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], ["doc_id", "source", "tokens"])

    src = F.lower(F.regexp_replace(F.col(source).cast("string"), r"^\s+|\s+$", ""))
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), src.alias("source"), F.col(text).cast("string").alias("text")).mapInArrow(count, "doc_id long, source string, tokens long")


def _targets(plan: list, have: dict, totals: dict | float | None = None) -> dict:
    """(mix, source) -> tokens wanted. Shares count among the sources that have documents. Without a total it is the largest at
    which every source can give its share at its cap. Where a given total is larger, what a source can't give at its cap
    goes to the others in proportion to their shares, as far as their caps allow."""
    out = {}
    for mix in {r.mix_name for r in plan}:
        rows = [r for r in plan if r.mix_name == mix and have.get(r.source, (0, 0))[1] and r.max_repeats > 0]
        most = {r.source: float(have[r.source][1] * r.max_repeats) for r in rows}
        open_ = {r.source: r.target_share for r in rows if r.target_share > 0}
        out |= {(mix, r.source): 0.0 for r in rows if r.source not in open_}
        if not open_:
            continue
        share = sum(open_.values())
        total = totals.get(mix) if isinstance(totals, dict) else totals
        if total is None:
            total = min(most[s] * share / t for s, t in open_.items())
        left = float(total)
        while open_:
            share = sum(open_.values())
            over = [s for s, t in open_.items() if left * t / share > most[s] * (1 + 1e-12)]
            if not over:
                out |= {(mix, s): left * t / share for s, t in open_.items()}
                break
            out |= {(mix, s): most[s] for s in over}
            left = max(0.0, left - sum(most[s] for s in over))
            open_ = {s: t for s, t in open_.items() if s not in over}
    return out


def mix_sources(tokens: DataFrame, plan: DataFrame, total: dict | float | None = None, steps: int = STEPS) -> tuple[DataFrame, DataFrame]:
    """tokens: doc_id, source, tokens; plan: mix_name, source, target_share, max_repeats. Gives the copies (mix_name, doc_id,
    source, tokens, copies; only copies > 0) and the report (mix_name, source, target_share, max_repeats, docs, tokens,
    wanted_tokens, actual_tokens, actual_share, max_copies, gap). total: tokens of a mix, or of each by name; without it the
    largest total that meets every target. gap is how far the rates' sum was from what is wanted when Newton's steps ended,
    as a share of it; below 1e-9 it has converged.

    A document without source or tokens is in no mix. A source named but without documents stays in the report with
    zeros. Repeated plan rows add up their shares, with the least cap. Plans are small (a row a mix and source) and
    live in the driver, as do the sums by mix and source; documents never do.
    """
    spark = tokens.sparkSession
    rows = plan.select("mix_name", F.lower(F.trim("source")).alias("source"), F.col("target_share").cast("double").alias("target_share"), F.col("max_repeats").cast("int").alias("max_repeats")).where("mix_name is not null and source is not null").groupBy("mix_name", "source").agg(F.sum(F.coalesce("target_share", F.lit(0.0))).alias("target_share"), F.min(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats")).collect()
    tokens = tokens.where("tokens > 0 and source is not null")
    have = {r.source: (r.n, r.t) for r in tokens.groupBy("source").agg(F.count("*").alias("n"), F.sum("tokens").alias("t")).where(F.col("source").isin(sorted({r.source for r in rows}))).collect()}
    want = _targets(rows, have, total)
    cap = {(r.mix_name, r.source): r.max_repeats for r in rows}
    dual = {k: [float(np.log(max(cap[k], 1)) - 0.7), 0.0] for k in want}  # half the cap: no rate is bound at first

    def rated() -> DataFrame:
        made = spark.createDataFrame([(m, s, float(a), float(b), have[s][1] / have[s][0], float(cap[m, s])) for (m, s), (a, b) in dual.items()], "mix_name string, source string, a double, b double, mean double, cap double")
        rate = F.least(F.col("cap"), F.exp(F.least(F.lit(40.0), F.col("a") + F.col("b") * (F.col("tokens") / F.col("mean")))))
        return tokens.join(F.broadcast(made), "source").withColumn("w", rate)  # a row a mix and source

    gaps = {}
    for _ in range(steps if want else 0):
        x = F.col("tokens") / F.col("mean")
        free = F.when(F.col("w") < F.col("cap"), F.col("w")).otherwise(0.0)
        sums = rated().groupBy("mix_name", "source").agg(F.sum("w").alias("w"), F.sum(F.col("w") * x).alias("wx"), F.sum(free).alias("f"), F.sum(free * x).alias("fx"), F.sum(free * x * x).alias("fxx")).collect()
        off = 0.0
        for r in sums:
            k = (r.mix_name, r.source)
            goal = want[k] / (have[r.source][1] / have[r.source][0])  # both moments, in documents of mean length
            g = np.array([goal - r.w, goal - r.wx])
            if goal >= cap[k] * have[r.source][0] * (1 - 1e-9):
                dual[k], gaps[k] = [40.0, 0.0], 0.0  # all at the cap
                continue
            if goal <= 0:
                dual[k], gaps[k] = [-700.0, 0.0], 0.0
                continue
            gaps[k] = float(np.abs(g).max() / goal)
            off = max(off, gaps[k])
            if r.f <= 0:  # every rate is bound: come down until some are free
                dual[k][0] -= 1.0
                continue
            hess = np.array([[r.f, r.fx], [r.fx, r.fxx]])
            step = np.linalg.lstsq(hess + 1e-9 * np.trace(hess) * np.eye(2), g, rcond=None)[0]
            dual[k] = list(np.array(dual[k]) + step / max(1.0, float(np.abs(step).max()) / 2.0))
        if off < 1e-9:
            break

    u = (F.shiftrightunsigned(F.xxhash64(F.lit("mix"), F.col("mix_name"), F.col("doc_id")), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    rates = rated().withColumn("base", F.floor("w")).withColumn("frac", F.col("w") - F.col("base")).withColumn("v", u / F.greatest(F.col("frac"), F.lit(1e-12)))  # one copy more where v is below the source's threshold, near 1
    scratch = Scratch(spark, "mix")
    rates = scratch.write(rates.select("mix_name", "source", "doc_id", "tokens", "base", F.when((F.col("frac") > 1e-9) & (F.col("base") < F.col("cap")), F.col("v")).alias("v")), "rates")
    fixed = {(r.mix_name, r.source): r.t for r in rates.groupBy("mix_name", "source").agg(F.sum(F.col("base") * F.col("tokens")).alias("t")).collect()}
    lo, hi = {k: 0.0 for k in want}, {k: 4.0 for k in want}
    below = {k: float(fixed.get(k, 0)) for k in want}
    for _ in range(3):  # each round narrows the threshold to a bucket of the last one
        edges = spark.createDataFrame([(m, s, lo[m, s], hi[m, s]) for m, s in want], "mix_name string, source string, lo double, hi double")
        part = rates.join(F.broadcast(edges), ["mix_name", "source"]).where("v >= lo and v < hi")
        part = part.groupBy("mix_name", "source", F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BUCKETS).alias("bucket")).agg(F.sum("tokens").alias("t"))
        by: dict = {k: [] for k in want}
        for r in part.collect():  # at most BUCKETS rows a mix and source
            by[r.mix_name, r.source].append((r.bucket, r.t))
        for k, parts in by.items():
            width = (hi[k] - lo[k]) / BUCKETS
            edge = hi[k]
            for bucket, t in sorted(parts):
                if below[k] + t > want[k]:
                    edge = lo[k] + bucket * width
                    break
                below[k] += t
            lo[k], hi[k] = edge, edge + width
    last = spark.createDataFrame([(m, s, lo[m, s]) for m, s in want], "mix_name string, source string, threshold double")
    copies = rates.join(F.broadcast(last), ["mix_name", "source"]).withColumn("copies", (F.col("base") + F.when(F.col("v") < F.col("threshold"), 1).otherwise(0)).cast("int")).where("copies > 0").select("mix_name", "doc_id", "source", "tokens", "copies")
    got = copies.groupBy("mix_name", "source").agg(F.countDistinct("doc_id").alias("docs"), F.sum(F.col("tokens") * F.col("copies")).alias("actual_tokens"), F.max("copies").alias("max_copies"))
    head = spark.createDataFrame([(r.mix_name, r.source, r.target_share, r.max_repeats, int(have.get(r.source, (0, 0))[1]), float(want.get((r.mix_name, r.source), 0.0)), gaps.get((r.mix_name, r.source))) for r in rows], "mix_name string, source string, target_share double, max_repeats int, tokens long, wanted_tokens double, gap double")
    report = head.join(got, ["mix_name", "source"], "left").na.fill(0, ["docs", "actual_tokens", "max_copies"])
    total = report.groupBy("mix_name").agg(F.sum("actual_tokens").alias("all_tokens"))
    report = report.join(total, "mix_name").withColumn("actual_share", F.coalesce(F.try_divide(F.col("actual_tokens").cast("double"), F.col("all_tokens")), F.lit(0.0))).drop("all_tokens")
    return copies, report

"""One object with the tool names of the read API over a folder of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .adapter import Views
from .operators import metrics as M
from .operators import read_api as R


class Engine:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.v = spark, Views(spark, folder)
        for t in ("posts", "comments", "categories", "pendings", "painpoints", "bridge", "sources"):
            getattr(self.v, t).createOrReplaceTempView(t)

    def get_stats(self) -> DataFrame:
        v = self.v
        return R.global_stats(v.posts, v.comments, v.pendings, v.painpoints, v.categories, v.bridge)

    def list_categories(self) -> DataFrame:
        return R.category_paths(self.v.categories).orderBy("group_name", F.col("is_root").desc(), "name", "id")

    def get_top_painpoints(self, limit: int = 10, category: str | None = None, subreddit: str | None = None) -> DataFrame:
        """By category, else by subreddit, else over all; the limit is kept within 1 and 50."""
        v, n = self.v, max(1, min(50, limit))
        if category:
            return R.painpoints_in_category(v.painpoints, v.categories, category, n)
        if subreddit:
            return R.painpoints_in_subreddit(v.painpoints, v.bridge, v.pendings, v.posts, subreddit, n)
        return R.top_painpoints(v.painpoints, v.categories, n)

    def get_painpoint(self, painpoint_id: int) -> DataFrame:
        return R.with_category(R.lookup(self.v.painpoints, "id", painpoint_id), self.v.categories)

    def get_painpoint_evidence(self, painpoint_id: int, limit: int = 20) -> DataFrame:
        v = self.v
        return R.evidence_page(R.evidence(v.bridge, v.pendings, v.posts, v.comments, v.categories, painpoint_id), limit)

    def get_subreddit_summary(self, subreddit: str) -> DataFrame:
        v = self.v
        return R.subreddit_summary(v.posts, v.comments, v.pendings, v.bridge).where(F.col("subreddit") == R.T.py_normalize_subreddit(subreddit))

    def get_opportunity_evidence(self, subreddit: str, limit: int = 10, category: str | None = None) -> DataFrame:
        v = self.v
        sub = R.T.py_normalize_subreddit(subreddit or "")
        c = R.opportunity_candidates(v.sources, v.bridge, v.pendings, v.posts, v.painpoints, v.categories, category).where(F.col("requested_subreddit") == sub)
        c = R.top_candidates(c, max(1, min(50, limit)))
        return R.packs(c, R.evidence_split(c, v.bridge, v.pendings, v.posts, v.comments))

    def get_post(self, post_id: int) -> tuple[DataFrame, DataFrame]:
        return R.lookup(self.v.posts, "id", post_id), R.comments_of_post(self.v.comments, post_id)

    def get_metrics(self) -> dict[str, DataFrame]:
        v = self.v
        return {"totals": M.totals(v.categories), "dedup": M.dedup_metrics(v.pendings, v.extras), "merge": M.merge_metrics(v.bridge, v.painpoints), "categorisation": M.categorisation(v.painpoints, v.categories)}

    def run_sql(self, query: str, limit: int = 100) -> DataFrame | dict:
        """A SELECT over the tables, else an error; what doesn't begin with SELECT isn't run."""
        if not query.strip().upper().startswith("SELECT") or ";" in query.strip().rstrip(";"):
            return {"error": "only a SELECT is allowed"}
        try:
            return self.spark.sql(query.strip().rstrip(";")).limit(limit)
        except Exception as e:  # noqa: BLE001
            return {"error": str(e).split("\n")[0]}

    def run_all_sql(self, queries: list[str]) -> list:
        """The first five queries, twenty rows each."""
        out = []
        for q in queries[:5]:
            got = self.run_sql(q, 20)
            out.append(got if isinstance(got, dict) else [r.asDict() for r in got.collect()])
        return out

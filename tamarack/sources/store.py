"""Versioned tables in a folder: each write is a new version, the pointer moves when it is whole, readers see one version.

One writer at a time. Snapshots are versions with a label ``NN_label``; the one before is the label before in order.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Store:
    def __init__(self, spark: SparkSession, base: str) -> None:
        self.spark, self.base = spark, base.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _exists(self, at: str) -> bool:
        return self._fs.exists(self._path(at))

    def _names(self, at: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(at))) if self._exists(at) else []

    def version(self, table: str) -> int:
        return max([-1, *(int(n[1:]) for n in self._names(f"{self.base}/{table}") if n[0] == "v" and self._exists(f"{self.base}/{table}/{n}/_SUCCESS"))])

    def write(self, table: str, df: DataFrame) -> int:
        v = self.version(table) + 1
        df.write.mode("overwrite").parquet(f"{self.base}/{table}/v{v:06d}")  # a half version has no _SUCCESS and is never read
        return v

    def read(self, table: str, version: int | None = None) -> DataFrame:
        v = self.version(table) if version is None else version
        return self.spark.read.parquet(f"{self.base}/{table}/v{v:06d}")

    def write_part(self, table: str, part: int, df: DataFrame) -> None:
        """One part of a table that grows by parts; written again it replaces itself, and half written it isn't read."""
        df.write.mode("overwrite").parquet(f"{self.base}/{table}/p{part:09d}")

    def parts(self, table: str, below: int | None = None) -> DataFrame | None:
        """All whole parts, or those below a number; None where there are none."""
        have = [n for n in self._names(f"{self.base}/{table}") if n[0] == "p" and self._exists(f"{self.base}/{table}/{n}/_SUCCESS")]
        paths = [f"{self.base}/{table}/{n}" for n in have if below is None or int(n[1:]) < below]
        return self.spark.read.parquet(*paths) if paths else None

    def snapshot(self, label: str, tables: dict[str, DataFrame]) -> str:
        n = len(self._names(f"{self.base}/snapshots"))
        name = f"{n:02d}_{label}"
        for t, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.base}/snapshots/{name}/{t}")
        return name

    def snapshots(self) -> list[str]:
        return self._names(f"{self.base}/snapshots")

    def previous(self, name: str) -> str | None:
        return max((s for s in self.snapshots() if s < name), default=None)

    def pick(self, label: str | None = None) -> str | None:
        """The given snapshot, else the last one but 00_clean, one not taken after a sweep before one that was."""
        names = [s for s in self.snapshots() if s[:2].isdigit() and s != "00_clean"]
        if label:
            return label if label in names else None
        return max(names, key=lambda s: (not s.endswith("post_sweep"), s), default=None)

    def cached(self, key: str, make, ttl: float = 86_400.0) -> DataFrame:
        """A result kept for a day by default."""
        at = f"{self.base}/cache/{key}"
        if self._exists(f"{at}/_SUCCESS") and time.time() - self._fs.getFileStatus(self._path(at)).getModificationTime() / 1000 < ttl:
            return self.spark.read.parquet(at)
        make().write.mode("overwrite").parquet(at)
        return self.spark.read.parquet(at)


def dump(df: DataFrame, at: str, kind: str = "json") -> None:
    """JSON or CSV files; nested columns go to CSV as JSON."""
    if kind == "csv":
        df = df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes])
        df.write.mode("overwrite").option("header", True).csv(at)
    else:
        df.write.mode("overwrite").json(at)

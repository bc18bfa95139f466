"""Session, table access and lineage cuts that survive the loss of an executor."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "tamarack", cores: str = "*") -> SparkSession:
    """A local session for tests and the bench; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application."""
    sc = spark.sparkContext
    if getattr(sc, "_tamarack_shipped", False):
        return
    here = Path(__file__).parent
    at = Path(tempfile.mkdtemp()) / "tamarack.zip"  # on the driver only; Spark hands it out
    with zipfile.ZipFile(at, "w") as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, str(p.relative_to(here.parent)))
    sc.addPyFile(str(at))
    sc._tamarack_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or where that is unset (tests, one machine) a new one."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="tamarack-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


class Scratch:
    """Tables written into the shared folder under one run's name; drop() or the end of a ``with`` removes what is no longer read."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        ship(spark)
        self.spark, self.base, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}", 0

    def __enter__(self) -> "Scratch":
        return self

    def __exit__(self, *_) -> None:
        """For results that were written elsewhere: all tables of this run go."""
        self._rm(self.base)

    def path(self, name: str = "t") -> str:
        self.n += 1
        return f"{self.base}/{self.n:04d}-{name}"

    def write(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Writes df once and reads it back: its lineage ends at files, which outlive executors."""
        at = self.path(name)
        df.write.mode("overwrite").parquet(at)
        out = self.spark.read.schema(df.schema).parquet(at)
        out._tamarack_path = at  # type: ignore[attr-defined]
        return out

    def drop(self, df: DataFrame | None) -> None:
        if at := getattr(df, "_tamarack_path", None):
            self._rm(at)

    def _rm(self, at: str) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(at)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))

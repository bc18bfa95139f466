"""Streams: promotion of arriving observations by micro-batches, and windowed counts of events with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.promote import promote
from ..session import Scratch
from ..sources.store import Store


def created(links: DataFrame) -> DataFrame:
    return links.where("action = 'create'").select("id", "v")


def canonical(store: Store) -> DataFrame | None:
    """The canonical records (id, v) of all batches so far."""
    links = store.parts("links")
    return None if links is None else created(links)


def promote_stream(spark: SparkSession, path: str, schema, store: Store, threshold: float, checkpoint: str, available_now: bool = True):
    """Reads id and v of arriving observations and links or creates canonical records in the store, one batch at a time.

    A batch is one part of the table ``links`` (id, action, target, sim, v with the vector of what it created), written whole
    or not at all. Run again after a failure it reads the parts before its own and replaces its own, so a rerun changes nothing,
    and no part is ever rewritten by another batch. ``canonical`` gives the records.
    """

    def step(batch: DataFrame, epoch: int) -> None:
        items = batch.select("id", "v").dropDuplicates(["id"])
        links = store.parts("links", below=epoch)
        if links is not None:
            items = items.join(links.select("id"), "id", "left_anti")
        held = batch.select("id", "v").limit(0) if links is None else created(links)
        got = promote(items, held, threshold)
        store.write_part("links", epoch, got.join(items, "id").withColumn("v", F.when(F.col("action") == "create", F.col("v"))))

    w = spark.readStream.schema(schema).parquet(path).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")).start()


def event_counts(events: DataFrame, every: str = "1 day", late: str = "2 days") -> DataFrame:
    """Count and sum by tumbling window and type; rows later than the watermark are left out in a stream."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def run_event_counts(spark: SparkSession, path: str, schema) -> DataFrame:
    """The stream over what lies at the path now, to its end. Each batch's counts are written whole; the last ones stand."""
    at = Scratch(spark, "events")
    out = at.path("counts")

    def step(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/{epoch:09d}")

    src = spark.readStream.schema(schema).parquet(path)
    q = event_counts(src).writeStream.foreachBatch(step).outputMode("complete").option("checkpointLocation", at.path("state")).trigger(availableNow=True).start()
    q.awaitTermination()
    last = q.lastProgress["batchId"]
    return spark.read.parquet(f"{out}/{last:09d}").select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")

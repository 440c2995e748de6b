"""Incremental upkeep from a stream of change events (an extension: batches of the same merge that a one-off update does)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def latest_events(events: DataFrame) -> DataFrame:
    """One row a file: its last event (file_id, ts, blob_sha, deleted). Of events at one time a deletion counts last, else the greatest content."""
    return events.groupBy("file_id").agg(F.max(F.struct("ts", "deleted", "blob_sha")).alias("r")).select("file_id", "r.ts", "r.blob_sha", "r.deleted")


def merge_inventory(inventory: DataFrame, events: DataFrame) -> DataFrame:
    """file_id, blob_sha after the events: deleted files go, others take the last content."""
    last = latest_events(events)
    kept = inventory.join(last, "file_id", "left_anti").select("file_id", "blob_sha")
    return kept.unionByName(last.where("not deleted").select("file_id", "blob_sha"))


def maintain_inventory(spark: SparkSession, source: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Keeps the inventory below ``folder`` current: each batch writes a new version, so a failed one leaves the last whole."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        path = f"{folder}/v={batch_id}"
        before = spark.createDataFrame([], "file_id string, blob_sha string") if batch_id == 0 else spark.read.parquet(f"{folder}/v={batch_id - 1}")
        merge_inventory(before, batch).write.mode("overwrite").parquet(path)

    return source.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

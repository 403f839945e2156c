"""The change feed as a stream: micro-batches give what one batch gives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexspark.sources.documents import CHANGE, change_rows


def read_changes(spark: SparkSession, path: str) -> DataFrame:
    return change_rows(spark.readStream.schema(CHANGE).option("multiLine", True).json(path))


def latest(changes: DataFrame) -> DataFrame:
    """doc_id with its last kind and day."""
    return changes.groupBy("doc_id").agg(F.max_by("kind", F.struct("detected", "kind")).alias("kind"), F.max("detected").alias("detected"))


def start(changes: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    return latest(changes).writeStream.outputMode("complete").format("memory").queryName(table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_by_window(events: DataFrame, late: str = "1 hour", length: str = "1 day") -> DataFrame:
    """Events by window and type; later than the watermark: dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))

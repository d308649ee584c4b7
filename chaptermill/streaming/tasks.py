"""Task states kept up to date by Structured Streaming over a folder of event files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENTS = "task_id long, project_id long, sequence long, state string, completed long, total long, occurred_at timestamp, updated_at timestamp"


def event_stream(spark: SparkSession, path: str, schema: str = EVENTS, files_per_trigger: int = 100) -> DataFrame:
    """Events from Parquet files as they arrive, each once."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def latest_states(events: DataFrame) -> DataFrame:
    """The running fold of :func:`chaptermill.operators.tasks.latest_state`; state is one row a task."""
    facts = F.struct("state", "completed", "total", "occurred_at")
    folded = events.groupBy("task_id").agg(F.max_by(facts, "sequence").alias("last"), F.sum((F.col("state") == "pending").cast("int")).alias("starts"), F.max("sequence").alias("sequence"))
    return folded.select("task_id", "last.*", F.greatest(F.col("starts"), F.lit(1)).alias("attempt"), "sequence")


def first_starts(events: DataFrame, keep: str = "1 day") -> DataFrame:
    """Start events without those that repeat a fingerprint within ``keep``; older keys leave the state."""
    return events.withWatermark("occurred_at", keep).dropDuplicatesWithinWatermark(["project_id", "input_fingerprint"])


def to_table(states: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Each batch's changed tasks as a version of their own below ``path``; readers take the last by sequence."""

    def publish(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return states.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(publish).trigger(availableNow=True).start()

"""The status-driven voucher pipeline as a stream: files of new vouchers in, each worked on once, status rows out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

STATUS = "id long, stage string, status string, batch long"


def run_stage(spark: SparkSession, source: str, schema: str, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, stage: str, files_per_batch: int = 50) -> StreamingQuery:
    """Everything new in `source` (Parquet) goes through `work`, a function to (id, ok), in micro-batches; then the stream ends.

    A batch's statuses are written under its number, so a batch that is run again after a failure replaces its own rows.
    """
    new = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        status = F.when(F.coalesce("ok", F.lit(False)), "done").otherwise("failed")
        work(batch).select("id", F.lit(stage).alias("stage"), status.alias("status"), F.lit(number).cast("long").alias("n")).write.mode("overwrite").parquet(f"{out}/n={number}")

    return new.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_status(events: DataFrame, key: str = "id", at: str = "ts", status: str = "status") -> DataFrame:
    return events.groupBy(key).agg(F.max_by(status, at).alias(status))


def ready_for(statuses: DataFrame, before: str, stage: str) -> DataFrame:
    """id of vouchers whose stage `before` is done and that have nothing of `stage` yet, by statuses(id, stage, status)."""
    done = statuses.where((F.col("stage") == before) & (F.col("status") == "done")).select("id").distinct()
    return done.join(statuses.where(F.col("stage") == stage).select("id"), "id", "left_anti")


def windowed_counts(events: DataFrame, late: str = "1 hour", size: str = "1 day") -> DataFrame:
    """An extension: counts and sums of each event type by day of event time, over a stream or a table."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("value")).select(F.col("w.start").alias("day"), "event_type", "n", "value")

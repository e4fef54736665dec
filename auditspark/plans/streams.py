"""Streaming queries, run to the end of what is there."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.graph import shared_folder
from ..streaming import statistics, status, voucher_state
from . import relational
from . import views as v
from .registry import query


@query("SELECT stage, status, count(*) AS n FROM (SELECT 'classify' AS stage, CASE WHEN event_type != 'error' THEN 'done' ELSE 'failed' END AS status FROM events) GROUP BY 1, 2")
def stream_status(spark, d):
    """Every event is worked on once, in micro-batches, and its status written."""
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    events = v.table(spark, d, "events")
    events.write.parquet(f"{at}/in")
    work = lambda batch: batch.select(F.col("event_id").alias("id"), (F.col("event_type") != "error").alias("ok"))
    status.run_stage(spark, f"{at}/in", events.schema, work, f"{at}/out", f"{at}/state", "classify").awaitTermination()
    return spark.read.parquet(f"{at}/out").groupBy("stage", "status").agg(F.count("*").alias("n"))


@query("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, round(sum(value), 2) AS value FROM events GROUP BY 1, 2")
def windowed_event_counts(spark, d):
    rows = status.windowed_counts(v.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), size="1 day")
    return rows.withColumn("day", F.col("day").cast("timestamp_ntz"))


FINAL, LIMIT_MS, LATE = ("purchase", "error"), 6 * 3_600_000, "1 hours"


@query("""WITH l AS (SELECT user_id AS id, arg_max(event_type, (ts, event_id)) AS status, max(ts) AS last_ts FROM events WHERE user_id IS NOT NULL GROUP BY 1), m AS (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM events)
SELECT id, status, status NOT IN ('purchase', 'error') AND last_ts + INTERVAL 6 HOUR <= mark AS stuck FROM l, m""")
def voucher_states(spark, d):
    """The latest status of each voucher and whether it is stuck, from state that a stream keeps over four batches of files."""
    at = f"{shared_folder(spark)}/states-{uuid.uuid4().hex}"
    events = v.table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.col("event_type").alias("status"))
    ends = events.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    for i in range(4):
        cut = lambda k: F.lit(ends.a + (ends.b - ends.a) / 4 * k)
        own = (F.col("ts") >= cut(i)) & ((F.col("ts") < cut(i + 1)) if i < 3 else F.lit(True))
        events.where(own).write.mode("append").parquet(f"{at}/in")
        stream = spark.readStream.schema(events.schema).parquet(f"{at}/in")
        voucher_state.track(stream, f"{at}/out", f"{at}/state", LIMIT_MS, LATE, FINAL).awaitTermination()
    return voucher_state.standing(spark.read.parquet(f"{at}/out")).select("id", "status", "stuck")


@query(relational.EXTRACT_STATS)
def category_stats_kept(spark, d):
    """category_extract_stats, kept up to date over micro-batches."""
    at = f"{shared_folder(spark)}/stats-{uuid.uuid4().hex}"
    rows = v.extracts(spark, d).select("category", "f_amount", "f_party", "f_date", "risk")
    parts = max(3, v.table(spark, d, "lineitem").rdd.getNumPartitions())  # as many files as the input has splits
    rows.repartition(parts).write.parquet(f"{at}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", -(-parts // 3)).parquet(f"{at}/in")
    for q in statistics.keep(stream, f"{at}/out", f"{at}/state"):
        q.awaitTermination()
    return statistics.current(spark, f"{at}/out")

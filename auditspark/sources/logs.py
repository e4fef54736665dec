"""Log rows of what a job wrote: counts that are taken as the rows pass, and how long it took.

The counts are an Observation on the rows that are written, so nothing is read or worked out twice. A job that fails is logged as
failed, with its error, and fails.
"""

from __future__ import annotations

import datetime as dt
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

LOG = "batch string, stage string, state string, total long, done long, failed long, started timestamp, duration_ms long, error string"


def logged(rows: DataFrame, write: Callable[[DataFrame], None], log: str, batch: str, stage: str, done: Column | None = None, failed: Column | None = None) -> dict:
    """Write rows by `write`, append a row of LOG below `log`, and return it.

    done and failed are conditions on the rows (of a column status: done, failed); partial if any failed, done if all are done,
    else pending.
    """
    is_done = F.col("status") == "done" if done is None else done
    is_failed = F.col("status") == "failed" if failed is None else failed
    seen = Observation(f"log-{uuid.uuid4().hex}")
    watched = rows.observe(seen, F.count(F.lit(1)).alias("total"), F.count_if(is_done).alias("done"), F.count_if(is_failed).alias("failed"))
    started, began = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None), time.monotonic()
    told = {"batch": batch, "stage": stage, "state": "failed", "total": None, "done": None, "failed": None, "started": started, "error": None}
    try:
        write(watched)
        told |= seen.get
        told["state"] = "partial" if told["failed"] else "done" if told["done"] == told["total"] else "pending"
    except Exception as e:
        told["error"] = str(e)[:1000]
        raise
    finally:
        told["duration_ms"] = int(1000 * (time.monotonic() - began))
        spark = rows.sparkSession
        spark.createDataFrame([tuple(told[c.split()[0]] for c in LOG.split(", "))], LOG).coalesce(1).write.mode("append").parquet(log)
    return told


def read_log(spark: SparkSession, log: str) -> DataFrame:
    return spark.read.schema(LOG).parquet(log)


def stage_totals(log: DataFrame) -> DataFrame:
    """stage, runs, total, failed, mean and greatest duration: what the log says of each stage."""
    return log.groupBy("stage").agg(F.count("*").alias("runs"), F.sum("total").alias("total"), F.sum("failed").alias("failed"), F.round(F.avg("duration_ms"), 1).alias("mean_ms"), F.max("duration_ms").alias("most_ms"))

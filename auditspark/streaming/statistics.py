"""Statistics of categories kept up to date by a stream: counts, amounts and dates, as views over all rows would give them.

Spark keeps the sums of each category as state and tells the categories that a micro-batch changed. They are written under the
batch's number, and so are the distinct parties of the batch; a batch that is run again after a failure replaces its own rows and
counts once.

Defined cases: a null category is one of its own; a null amount counts as missing; a null party is none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SUMS = {"total": "sum", "with_amount": "sum", "risky": "sum", "amount": "sum", "min_amount": "min", "max_amount": "max", "first_date": "min", "last_date": "max"}


def sums(rows: DataFrame) -> DataFrame:
    """The state of each category of rows(category, f_amount, f_party, f_date, risk)."""
    a = F.col("f_amount")
    return rows.groupBy("category").agg(
        F.count("*").alias("total"), F.count(a).alias("with_amount"), F.count_if(F.col("risk") == "R").alias("risky"), F.sum(a).alias("amount"), F.min(a).alias("min_amount"), F.max(a).alias("max_amount"),
        F.min("f_date").alias("first_date"), F.max("f_date").alias("last_date"),
    )


def keep(rows: DataFrame, out: str, checkpoint: str) -> list[StreamingQuery]:
    """Follow a stream of rows to the end of what is there, once for the sums and once for the parties."""

    def to(folder: str):
        return lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/{folder}/n={number}")

    start = lambda frame, folder, mode: frame.writeStream.foreachBatch(to(folder)).outputMode(mode).option("checkpointLocation", f"{checkpoint}/{folder}").trigger(availableNow=True).start()
    # Copies within a batch go here; those of other batches when the parties are read.
    parties = rows.select("category", "f_party").where("f_party IS NOT NULL")
    distinct = lambda batch, number: batch.distinct().write.mode("overwrite").parquet(f"{out}/parties/n={number}")
    second = parties.writeStream.foreachBatch(distinct).outputMode("append").option("checkpointLocation", f"{checkpoint}/parties").trigger(availableNow=True).start()
    return [start(sums(rows), "sums", "update"), second]


def current(spark: SparkSession, out: str) -> DataFrame:
    """category, total, with_amount, risky, without_amount, parties, avg_amount, min_amount, max_amount, first_date, last_date."""
    told = spark.read.parquet(f"{out}/sums")
    last = told.groupBy("category").agg(F.max_by(F.struct(*SUMS), "n").alias("x")).select("category", "x.*")
    parties = spark.read.parquet(f"{out}/parties").groupBy(F.col("category").alias("c")).agg(F.count_distinct("f_party").alias("parties"))
    both = last.join(parties, F.col("category").eqNullSafe(F.col("c")), "left")
    return both.select("category", "total", "with_amount", "risky", (F.col("total") - F.col("with_amount")).alias("without_amount"), F.coalesce("parties", F.lit(0)).alias("parties"), F.round(F.col("amount") / F.nullif("with_amount", F.lit(0)), 4).alias("avg_amount"), "min_amount", "max_amount", "first_date", "last_date")

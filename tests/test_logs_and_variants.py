import pytest
from pyspark.sql import functions as F

from auditspark.operators import variants
from auditspark.sources import logs


def test_counts_are_taken_as_the_rows_pass(spark, tmp_path):
    worked = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            worked.add(batch.num_rows)
            yield batch

    rows = spark.range(90).select("id", F.when(F.col("id") % 9 == 0, "failed").otherwise("done").alias("status")).mapInArrow(seen, "id long, status string")
    told = logs.logged(rows, lambda r: r.write.parquet(f"{tmp_path}/out"), f"{tmp_path}/log", "b", "s")
    assert worked.value == 90 and (told["total"], told["done"], told["failed"], told["state"]) == (90, 80, 10, "partial") and told["duration_ms"] >= 0
    logs.logged(rows.where("status = 'done'"), lambda r: r.write.parquet(f"{tmp_path}/out2"), f"{tmp_path}/log", "b", "s")
    logs.logged(rows.limit(0), lambda r: r.write.parquet(f"{tmp_path}/out3"), f"{tmp_path}/log", "b", "none")
    log = logs.read_log(spark, f"{tmp_path}/log")
    assert sorted((r.stage, r.state, r.total) for r in log.collect()) == [("none", "done", 0), ("s", "done", 80), ("s", "partial", 90)]
    assert {(r.stage, r.runs, r.total, r.failed) for r in logs.stage_totals(log).collect()} == {("s", 2, 170, 10), ("none", 1, 0, 0)}


def test_a_job_that_fails_is_logged_and_fails(spark, tmp_path):
    bad = spark.range(3).select("id", F.raise_error(F.lit("no good")).cast("string").alias("status"))
    with pytest.raises(Exception, match="no good"):
        logs.logged(bad, lambda r: r.write.parquet(f"{tmp_path}/out"), f"{tmp_path}/log", "b", "s")
    row = logs.read_log(spark, f"{tmp_path}/log").first()
    assert row.state == "failed" and row.total is None and "no good" in row.error


def test_variants_are_read_by_path_and_type(spark, tmp_path):
    texts = [(1, '{"a": {"b": "12"}, "l": [1, 2.5], "n": null}'), (2, "{bad"), (3, None), (4, "[]"), (5, '{"a": {"b": [3]}, "l": "x"}')]
    kept = variants.parsed(spark.createDataFrame(texts, "id long, t string").withColumn("value", F.lit("clash")), "t")
    assert kept.columns == ["id", "value", "value_ok", "value_text"]
    kept.write.parquet(f"{tmp_path}/v")
    got = spark.read.parquet(f"{tmp_path}/v").select("id", *variants.fields("value", {"b": ("$.a.b", "int"), "last": ("$.l[1]", "double"), "n": ("$.n", "string")}), "value_ok", "value_text")
    assert sorted(tuple(r) for r in got.collect()) == [(1, 12, 2.5, None, True, None), (2, None, None, None, False, "{bad"), (3, None, None, None, True, None), (4, None, None, None, True, None), (5, None, None, None, True, None)]

"""Every query that has SQL gives the rows that DuckDB gives for it."""

import duckdb
import pytest

from auditspark.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(value):
    return "~" if value is None else f"{value:.6g}" if isinstance(value, float) else str(value)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_rows_are_those_of_sql(spark, duck, name):
    frame = catalog.queries()[name](spark, DATA)
    result = duck.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(frame.columns)
    want = sorted(tuple(shown(r[columns.index(c)]) for c in sorted(columns)) for r in result.fetchall())
    assert sorted(tuple(shown(r[c]) for c in sorted(columns)) for r in frame.collect()) == want


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_queries_without_sql_run(spark, name):
    assert catalog.queries()[name](spark, DATA).count() > 0


def test_entry_and_plans(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalog.queries()) <= set(__spark_entry__.queries()) and set(catalog.oracle_sql()) <= set(__spark_entry__.oracle_sql())
    plan = lambda name: catalog.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan("vector_topk")
    daily = plan("daily_amount")
    assert daily.count("FileScan parquet") == 2 and "IsNotNull(l_partkey)]" in daily and "l_returnflag" not in daily
    assert "CartesianProduct" not in plan("trigram_pairs") and "BroadcastNestedLoopJoin" not in plan("near_dup_pairs")


def test_the_shared_folder_must_be_named_on_a_cluster():
    from types import SimpleNamespace

    from auditspark.operators.graph import shared_folder

    told = {"spark.checkpoint.dir": None}
    context = SimpleNamespace(getConf=lambda: told, getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(ValueError):
        shared_folder(SimpleNamespace(sparkContext=context))
    told["spark.checkpoint.dir"] = "hdfs://shared/"
    assert shared_folder(SimpleNamespace(sparkContext=context)) == "hdfs://shared"

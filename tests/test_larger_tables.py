"""Queries on small tables made for what the test tables are too small to show, held against their SQL."""

import duckdb
import pytest

from auditspark.plans import catalog


@pytest.fixture
def against_sql(spark, tmp_path):
    def held(name, **tables):
        con = duckdb.connect()
        for table, sql in tables.items():
            con.execute(f"COPY ({sql}) TO '{tmp_path}/{table}.parquet' (FORMAT parquet)")
            con.execute(f"CREATE OR REPLACE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
        shown = lambda row: tuple("~" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v) for v in row)
        result = con.execute(catalog.oracle_sql()[name])
        columns = [c[0] for c in result.description]
        want = sorted(shown(r) for r in result.fetchall())
        assert sorted(shown(r[c] for c in columns) for r in catalog.queries()[name](spark, str(tmp_path)).collect()) == want
        return want

    return held


PARTS = "SELECT i::BIGINT AS p_partkey, 'red bolt ' || i % 3 AS p_name, 'Brand#' || i % 25 + 1 AS p_brand, '{kind}' AS p_type, (i % 50)::INT AS p_size, 900.0::DOUBLE AS p_retailprice FROM range({n}) r(i)"


@pytest.mark.parametrize("shared", [[], [7, 5]])
def test_common_descendant_of_suppliers_that_share_no_part_or_two(against_sql, shared):
    pairs = [(3, 1), (3, 2), (4, 3), (4, 4)] + [(s, p) for s in (3, 4) for p in shared]
    lines = " UNION ALL ".join(f"SELECT {s}::BIGINT AS l_suppkey, {p}::BIGINT AS l_partkey" for s, p in pairs)
    got = against_sql("common_descendant_path", part=PARTS.format(kind="PROMO", n=10), lineitem=lines)
    assert len(got) == 1 and ("5000005" in got[0]) == bool(shared)


def test_more_files_of_a_type_than_four_digits(against_sql):
    assert len(against_sql("files_by_type", part=PARTS.format(kind="LARGE", n=10_012))) == 10_012


def test_more_twins_of_a_type_than_four_digits(against_sql):
    assert len(against_sql("files_with_twins", part=PARTS.format(kind="LARGE", n=10_012))) == 20_024


def test_python_gets_few_files_at_a_time(spark):
    from pyspark.sql import functions as F

    from auditspark.operators.graph import arrow_rows

    @F.pandas_udf("int")
    def held(rows):
        return rows * 0 + len(rows)

    most = lambda: spark.range(0, 1000, 1, 1).select(held(F.col("id").cast("int")).alias("n")).agg(F.max("n")).first()[0]
    with arrow_rows(spark, 64):
        assert most() == 64
    assert most() == 1000


def test_measures_of_images_do_not_hang_on_the_batches_of_the_action(spark, tmp_path):
    """Pixels are measured where few files go to Python at a time; what is returned reads the measures alone."""
    from auditspark.plans import media

    plan = media._images(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "image" not in plan.split("ReadSchema")[1]


def test_statistics_are_kept_from_as_many_files_as_the_input_has_splits(spark, against_sql, monkeypatch):
    frame = type(spark.range(1))
    dealt, deal = [], frame.repartition
    monkeypatch.setattr(frame, "repartition", lambda self, n, *c: (dealt.append(n), deal(self, n, *c))[1])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    lines = "SELECT i::BIGINT AS l_orderkey, 1 AS l_linenumber, (i % 10)::BIGINT AS l_partkey, (i % 50)::DOUBLE AS l_quantity, (i % 977)::DOUBLE AS l_extendedprice, 'R' AS l_returnflag, TIMESTAMP '2024-01-01' + INTERVAL (i % 99) DAY AS l_shipdate FROM range(20000) r(i)"
    try:
        against_sql("category_stats_kept", part=PARTS.format(kind="PROMO", n=10), lineitem=lines)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert max(dealt) > 3


@pytest.mark.parametrize("least_bits", [1, 2, 3])
def test_hashes_of_few_bits_do_not_all_meet(spark, least_bits):
    """Hashes that fill a part of the 64 bits share the rest: that must not make them candidates of each other."""
    import random

    from auditspark.operators import quality

    rng = random.Random(5)
    rows = [(i, rng.getrandbits(12)) for i in range(150)] + [(200, -(1 << 63)), (201, -(1 << 63) + 1)]
    first = {}
    for i, h in rows:
        first.setdefault(h, i)
    want = {(a, b, ((x ^ y) & (1 << 64) - 1).bit_count()) for x, a in first.items() for y, b in first.items() if a < b and ((x ^ y) & (1 << 64) - 1).bit_count() < least_bits}
    found = quality.near_duplicate_pairs_global(spark.createDataFrame(rows, "id long, h long"), least_bits)
    assert {tuple(r) for r in found.collect()} == want
    assert "shiftrightunsigned" not in found._jdf.queryExecution().toString()


def test_copies_of_a_hash_are_told_beside_the_pairs_of_hashes(spark, against_sql):
    from auditspark.operators import quality

    rows = [(4, 0), (1, 0), (7, 3), (9, 3), (8, 3), (5, 1 << 20), (6, None), (2, None)]
    found = {tuple(r) for r in quality.near_duplicate_links_global(spark.createDataFrame(rows, "id long, h long"), 3).collect()}
    assert found == {(1, 4, 0), (7, 8, 0), (7, 9, 0), (1, 7, 2), (1, 5, 1)}
    first = {h: min(i for i, g in rows if g == h) for _, h in rows if h is not None}
    near = {(first[g], first[h]) for i, g in rows for j, h in rows if i < j and None not in (g, h) and (g ^ h).bit_count() < 3}
    assert all(a == b or (min(a, b), max(a, b)) in {(a, b) for a, b, _ in found} for a, b in near)
    vectors = "SELECT i::BIGINT AS vec_id, [((i % 4 + 2) * (j + 3) % 7 - 3)::FLOAT FOR j IN range(64)] AS embedding, 1 AS label FROM range(12) r(i)"
    assert sum(r[2] == "0" for r in against_sql("near_dup_global", embeddings=vectors)) == 8


def test_files_are_listed_in_the_tasks_and_each_is_read_once(spark, tmp_path, monkeypatch):
    from auditspark.plans import media
    from auditspark.sources import file_layout, sinks

    plan = media.files_with_twins(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "InMemoryFileIndex" not in plan and "binaryFile" not in plan.lower()
    at = tmp_path / "out"
    names = [f"{k % 2}/{k % 3}/{k} ä+%20.txt" for k in range(100)] + ["_top", ".dot", "0/empty"] + [f"many/{k}" for k in range(500)]
    for name in [*names, "_staging-1/no"]:
        (at / name).parent.mkdir(parents=True, exist_ok=True)
        (at / name).write_bytes(name.encode() if "empty" not in name else b"")
    assert sorted((r.file, bytes(r.content)) for r in sinks.read_files(spark, str(at)).collect()) == sorted((n, n.encode() if "empty" not in n else b"") for n in names)
    monkeypatch.setattr(file_layout, "FILES_A_TASK", 60)
    reader = file_layout.FileLayoutReader(str(at), ["file"])
    slices = reader.partitions()
    read = [[f for b in reader.read(s) for f in b.column("file").to_pylist()] for s in slices]
    assert sorted(f for part in read for f in part) == sorted(names) and max(map(len, read)) < 120 and len(slices) > 9
    (tmp_path / "none").mkdir()
    assert sinks.read_files(spark, str(tmp_path / "none")).collect() == []

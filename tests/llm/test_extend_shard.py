from collections import defaultdict

from pyspark.sql import functions as F

from auditspark.llm import extend_shard as E


def check(spark, rows, limit):
    docs = spark.createDataFrame(rows, "doc_id long, text string, Shard string")
    got = E.assign_shards(docs, limit).withColumn("h", F.lpad(F.bin(F.xxhash64("doc_id", "text")), 64, "0")).collect()
    assert sorted(map(str, ((r.doc_id, r.text) for r in got))) == sorted(map(str, (r[:2] for r in rows)))
    shards = defaultdict(list)
    for r in got:
        shards[r.shard].append(r)
        assert r.h.startswith(r.shard.split(".")[0])
    for name, own in shards.items():
        total = sum(len((r.text or "").encode()) for r in own)
        assert {r.shard_bytes for r in own} == {total}
        assert total <= limit or len(own) == 1
        assert all(r.oversized == (total > limit) for r in own)
    return shards, got


def test_buckets_fit_and_no_bucket_was_split_in_vain(spark):
    rows = [(i, "é" * (i * 37 % 90), None) for i in range(2000)]
    shards, got = check(spark, rows, 600)
    names = set(shards)
    for a in names:  # prefix-free, and every parent of a shard exceeds the limit
        assert not any(a != b and b.startswith(a) for b in names)
        parent = [r for r in got if a and r.h.startswith(a[:-1])]
        assert not a or sum(len((r.text or "").encode()) for r in parent) > 600
    assert max(map(len, names)) > E.STRIDE


def test_one_shard_if_all_fits_and_none_without_rows(spark):
    assert set(check(spark, [(1, "a", "x"), (2, None, "y"), (None, "", "z")], 100)[0]) == {""}
    assert check(spark, [], 100)[1] == []


def test_equal_rows_overflow_to_pages_and_long_rows_stand_alone(spark):
    rows = [(7, "x" * 50, "old")] * 300 + [(8, "y" * 5000, None), (None, None, None), (None, None, None)] + [(i, "z" * 40, None) for i in range(100, 160)]
    shards, _ = check(spark, rows, 1000)
    assert sum(any(r.oversized for r in own) for own in shards.values()) == 1
    assert sum("." in name for name in shards) == 15

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditspark.llm import va_negatives as V

SCHEMA = "id long, label int, vector array<float>"


def plain(rows, is_anchor, positives=5, negatives=3, window=(50, 95)):
    """The rows asked for, by Python's whole numbers over all pairs; rows of one id are told apart by their place."""
    width = max((len(v) for _, _, v in rows), default=0)
    v = [(i, label, tuple([int(np.floor(256 * float(np.float32(x)))) for x in x_s] + [0] * (width - len(x_s)))) for i, label, x_s in rows]
    out = []
    for a, (i, label, x) in enumerate(v):
        if not is_anchor(i):
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, y)), j, other, y) for b, (j, other, y) in enumerate(v) if b != a)
        for s, p, _, _ in [r for r in scored if r[2] == label][:positives]:
            inside = [(t, n) for t, n, other, _ in scored if other != label and window[0] * -s <= 100 * -t <= window[1] * -s]
            out += [(i, p, rank + 1, n, -s, -t) for rank, (t, n) in enumerate(inside[:negatives])]
    return sorted(out)


def run(spark, rows, anchor, **how):
    return sorted(tuple(r) for r in V.hard_negatives(spark.createDataFrame(rows, SCHEMA), anchor, **how).collect())


@pytest.mark.parametrize("cells,block_rows,group", [(4, 40, 7), (16, 64, 1000), (256, 4096, 1024)])
def test_rows_are_those_of_all_pairs(spark, cells, block_rows, group):
    rng = np.random.default_rng(cells)
    base = rng.normal(size=(8, 10))
    rows = [(i, int(rng.integers(0, 3)), [float(x) for x in base[rng.integers(0, 8)] + 0.3 * rng.normal(size=10)]) for i in range(300)]
    rows += [(1000 + i, i % 2, [0.5] * 10) for i in range(40)] + [(1040, 0, [-1.0] * 10), (1050, 1, [0.0] * 10)]
    want = plain(rows, lambda i: i % 10 == 0)
    assert len(want) > 150 and run(spark, rows, F.col("id") % 10 == 0, cells=cells, block_rows=block_rows, group=group) == want


def test_bounds_hold_and_few_candidates_are_left():
    rng = np.random.default_rng(3)
    v = rng.integers(-128, 128, (3000, 32))
    v[:5] = 2**24  # far outside the sample
    table = V.make_cells(v[100:1100], v.min(axis=0), v.max(axis=0), 64)
    cells = table.of(v)
    anchors = v[:50]
    low, high = V.score_bounds(anchors, *table.bounds_of(cells))
    score = anchors @ v.T
    assert (low <= score).all() and (score <= high).all()
    labels = rng.integers(0, 4, len(v))
    found = V.positive_candidates(np.arange(5, 50), labels[5:50], v[5:50], np.arange(5, 3000), labels[5:], cells[5:], table, 5)
    pairs = {(a, r) for lot in found for a, r in zip(lot[0], lot[1])}
    for a in range(5, 50):
        best = sorted((-score[a, r], r) for r in range(5, 3000) if r != a and labels[r] == labels[a])[:5]
        assert {(a, r) for _, r in best} <= pairs
    assert len(pairs) < 45 * 60


def test_copies_hot_vectors_and_rows_of_one_id(spark):
    rows = [(i, 0, [1.0, 0.0]) for i in range(200)] + [(1000 + i, 1, [0.6, 0.1]) for i in range(200)] + [(0, 0, [1.0, 0.1]), (0, 1, [0.7, 0.0])]
    want = plain(rows, lambda i: i in (0, 100, 1050))
    assert want and run(spark, rows, F.col("id").isin(0, 100, 1050), block_rows=50) == want
    twice = rows[190:210] * 2
    assert run(spark, twice, F.col("id") == 195) == plain(twice, lambda i: i == 195)


def test_odd_rows_take_no_part(spark):
    good = [(0, 1, [1.0, 1.0]), (1, 1, [1.0]), (2, 2, [0.5, 0.5]), (3, 2, []), (4, 1, [-1.0, -1.0]), (5, 3, [0.0, 0.0])]
    odd = [(None, 1, [1.0, 1.0]), (50, None, [1.0, 1.0]), (60, 1, None), (70, 1, [1.0, None]), (80, 1, [float("nan"), 1.0]), (90, 2, [float("-inf"), 1.0]), (100, 2, [1e30, 1.0])]
    assert run(spark, good + odd, F.col("id") % 2 == 0) == plain(good, lambda i: i % 2 == 0)


def test_large_components(spark):
    rng = np.random.default_rng(4)
    top = V.largest_component(3) // 512
    rows = [(i, i % 3, [float(int(x)) for x in rng.integers(-top, top, 3)]) for i in range(60)]
    assert run(spark, rows, F.col("id") % 5 == 0, block_rows=16) == plain(rows, lambda i: i % 5 == 0)


def test_empty_tables_no_anchors_and_clashing_columns(spark):
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    for rows in ([], [(1, None, [1.0])], [(1, 1, [1.0]), (2, 2, [1.0])]):
        got = V.hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("id") > 100)
        assert got.columns == names and got.count() == 0
    rows = [(0, 1, [1.0]), (1, 1, [1.0]), (2, 2, [0.7])]
    more = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS row", "2 AS key", "3 AS score", "4 AS place", "5 AS rank")
    assert [tuple(r) for r in V.hard_negatives(more, F.col("id") == 0).collect()] == [(0, 1, 1, 2, 65536, 256 * 179)]

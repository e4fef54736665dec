import numpy as np
import pytest

from auditspark.llm import ann_tree as A

SCHEMA = "id long, vector array<float>"


def brute(rows, queries, k):
    ids = np.array([i for i, _ in rows])
    m = np.array([v for _, v in rows], dtype=np.float64)
    out = {}
    for qi, qv in queries:
        q = np.array([qv], dtype=np.float64)
        score = A.exact_cosine(np.repeat(q, len(m), axis=0), m)
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != qi][:k]
        out[qi] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def data(n, width=16, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, width))
    m = (centres[rng.integers(0, 12, n)] + 0.5 * rng.normal(size=(n, width))).astype(np.float32)
    return [(i, [float(x) for x in v]) for i, v in enumerate(m)]


def test_best_bin_first_lists_every_leaf_once_nearest_first():
    m = A._unit(A.pd.Series([v for _, v in data(2000)]))
    tree = A.Tree(m, leaf_rows=50)
    assert tree.leaves > 20
    own = tree.leaf_of(m[:50])
    for q, leaf in zip(m[:50], own):
        order = tree.visits(q, tree.leaves)
        assert order[0] == leaf and sorted(order) == list(range(tree.leaves))


def test_recall_and_exact_scores(spark):
    rows = data(3000)
    index = A.build_index(spark.createDataFrame(rows, SCHEMA), leaf_rows=60, block_rows=100)
    queries = rows[::30]
    own = index.blocks.where("id % 30 = 0")
    frame, reached = A.search_and_recall(index, own, k=5, recall=0.95)
    got = frame.collect()
    assert 0.9 <= reached <= 1
    want = brute(rows, queries, 5)
    assert len(got) == 5 * len(queries) and {r.rank for r in got} == {1, 2, 3, 4, 5}
    found = {}
    for r in sorted(got, key=lambda r: r.rank):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert sum(len({i for i, _ in found[q]} & {i for i, _ in want[q]}) for q in want) / (5 * len(want)) >= 0.9
    full = A.search(index, own, k=5, recall=1.0).collect()
    exact = {(r.query_id, r.rank): (r.vec_id, r.score) for r in full}
    assert sum(exact[q, n + 1] == want[q][n] for q in want for n in range(5)) / (5 * len(want)) > 0.97


def test_ties_copies_and_odd_vectors(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(200)] + [(500, None), (501, []), (502, [0.0, 0.0, 0.0]), (503, [float("nan"), 1.0, 1.0]), (504, [float("inf"), 1.0, 1.0]), (505, [1.0, None, 1.0]), (506, [1.0, 2.0]), (None, [1.0, 2.0, 3.0]), (507, [3e38, 3e38, 3e38]), (507, [3e38, 3e38, 3e38])]
    index = A.build_index(spark.createDataFrame(rows, SCHEMA), leaf_rows=10, block_rows=16)
    assert index.rows == 203
    got = {(r.query_id, r.rank): r.vec_id for r in A.search(index, index.blocks.where("id IN (0, 3)")).collect()}
    assert got == {(q, n + 1): v for q, near in ((0, [1, 2, 3, 4, 5]), (3, [0, 1, 2, 4, 5])) for n, v in enumerate(near)}


@pytest.mark.parametrize("n", [0, 1, 3])
def test_few_rows(spark, n):
    rows = data(n)
    index = A.build_index(spark.createDataFrame(rows, SCHEMA))
    got = A.search(index, index.blocks).collect()
    assert len(got) == n * max(0, n - 1)


def test_own_row_alone_is_left_out_and_columns_may_clash(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.1]), (None, [1.0, 0.0]), (2, [0.0, 1.0])]
    index = A.build_index(spark.createDataFrame(rows, SCHEMA))
    clash = index.blocks.where("id = 1 OR id IS NULL").selectExpr("*", "1 AS q_row", "2 AS rank", "'x' AS query_id")
    got = sorted(A.search(index, clash, k=3).collect(), key=lambda r: (r.query_id or 0, r.score, r.rank))
    assert [r.query_id for r in got].count(1) == 6 and [r.query_id for r in got].count(None) == 3
    first = {(r.query_id, r.rank): r.vec_id for r in got if r.query_id is None}
    assert first == {(None, 1): 1, (None, 2): 1, (None, 3): 2}
    outside = A.search(index, spark.createDataFrame([(7, [1.0, 0.0])], SCHEMA), k=4).collect()
    assert [r.vec_id for r in sorted(outside, key=lambda r: r.rank)] == [1, None, 1, 2]


def test_no_vectors_are_broadcast(spark):
    """Visits are many times their table's size, which the planner does not see: neither they nor the rows may go through the driver."""
    index = A.build_index(spark.createDataFrame(data(500), SCHEMA), leaf_rows=40, block_rows=50)
    queries = A.materialize(index.blocks.where("id % 10 = 0").selectExpr("row AS q_row", "row AS q_own", "vector AS q_vec"), "queries")
    for visits in (A._with_visits(index, queries, 4), A._all_leaves(index, queries)):
        plan = A._search_blocks(index.blocks, visits, 5)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        told = [part for part in plan.split("\n\n") if ") BroadcastExchange" in part]
        assert told and not [part for part in told if "q_vec" in part or "vector" in part]

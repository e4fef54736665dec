import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from auditspark.llm import dual_lloyd as D

SCHEMA = "vec_id long, embedding array<float>, cluster string, distance string"


def plain(vectors, k, rounds, seed=2):
    """ids to (cluster, distance) and the centroids, by Lloyd's rounds over all pairs with Python's whole numbers."""
    v = {i: [int(np.floor(256 * float(np.float32(x)))) for x in xs] for i, xs in vectors}
    first = sorted(v, key=lambda i: hashlib.sha256(f"{seed}:{i}".encode()).hexdigest())[:k]
    cents = [v[i] for i in first]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda x: min((gap(x, c), n) for n, c in enumerate(cents))
    for _ in range(rounds):
        groups = {}
        for x in v.values():
            groups.setdefault(near(x)[1], []).append(x)
        cents = [[sum(xs) // len(xs) for xs in zip(*groups[n])] if n in groups else c for n, c in enumerate(cents)]
    return {i: near(x)[::-1] for i, x in v.items()}, cents


def run(spark, rows, width, k, rounds, block_rows):
    df = spark.createDataFrame([(i, v, "x", None) for i, v in rows], SCHEMA)
    return D.cluster(spark, D.whole_vectors(df, "vec_id", "embedding", width), width, k, rounds, 2, block_rows)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(1, 300), st.integers(1, 12), st.integers(1, 4), st.integers(1, 60))
def test_dual_tree_finds_the_nearest_centroid(seed, n, k, width, spread):
    rng = np.random.default_rng(seed)
    rows = rng.integers(-spread, spread + 1, (n, width)) + 1000 * rng.integers(0, 3, (n, 1))
    cents = np.concatenate([rows[rng.integers(0, n, k)], rng.integers(-spread, spread + 1, (k, width))])
    tree = D.build_tree(rows)
    assert (rows[tree.order] == tree.points).all() and (np.sort(tree.order) == np.arange(n)).all()
    for c, lo, hi, kid, end in tree.nodes:
        assert lo <= c < hi and (end == kid or (tree.nodes[kid, 1], tree.nodes[end - 1, 2]) == (lo, hi))
    far = np.sqrt([((tree.points[lo:hi] - tree.points[c]) ** 2).sum(axis=1).max() for c, lo, hi, _, _ in tree.nodes])
    assert np.allclose(far, tree.radius)
    got = D.nearest_centroids(tree, D.build_centroid_tree(cents))
    assert (got == ((tree.points[:, None] - cents[None]) ** 2).sum(axis=2).argmin(axis=1)).all()


def test_pruning_saves_distances_where_vectors_form_groups():
    rng = np.random.default_rng(5)
    rows = (300 * rng.normal(size=(20, 64))).astype(np.int64)[rng.integers(0, 20, 3000)] + rng.integers(-9, 9, (3000, 64))
    count = {}
    D.nearest_centroids(D.build_tree(rows), D.build_centroid_tree(rows[:40]), count)
    assert count["distances"] < 0.2 * len(rows) * 40


def test_large_components_are_exact():
    rows = np.array([[2**26, -(2**26)], [2**26 - 1, -(2**26)], [-(2**27), 2**27]])
    assert D.all_squared(rows).tolist() == [[sum((int(x) - int(y)) ** 2 for x, y in zip(a, b)) for b in rows] for a in rows]


@pytest.mark.parametrize("block_rows", [7, 5000])
def test_rounds_are_those_of_plain_lloyd(spark, block_rows):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(6, 5))
    rows = [(i, [float(x) for x in base[i % 6] + 0.3 * rng.normal(size=5)]) for i in range(200)] + [(500 + i, [1.0, 2.0, 3.0, 4.0, 5.0]) for i in range(60)]
    assigned, cents = run(spark, rows, 5, 9, 4, block_rows)
    want, want_cents = plain(rows, 9, 4)
    assert cents.tolist() == want_cents
    assert {r.id: (r.cluster, r.distance) for r in assigned.collect()} == want
    told = D.with_inertia(assigned, cents).collect()
    assert {r.inertia for r in told} == {sum(d for _, d in want.values())}
    assert all(r.cluster_inertia == sum(d for c, d in want.values() if c == r.cluster) for r in told)
    assert all(r.centroid_sha256 == hashlib.sha256(",".join(map(str, want_cents[r.cluster])).encode()).hexdigest() for r in told)


def test_odd_vectors_and_ids(spark):
    good = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [0.0, 1.0]), (3, [-0.001, 1.0])]
    odd = [(4, None), (5, []), (6, [1.0]), (7, [1.0, None]), (8, [float("nan"), 1.0]), (9, [float("inf"), 1.0]), (10, [1e30, 0.0])]
    assigned, cents = run(spark, good + odd, 2, 3, 2, 10)
    got = sorted((r.id or 0, r.distance) for r in assigned.collect())
    assert len(cents) == 3 and [i for i, _ in got] == [0, 1, 1, 3]
    assert [0, 256] not in D.first_centroids(D.whole_vectors(spark.createDataFrame([(i, v, "x", None) for i, v in good], SCHEMA), "vec_id", "embedding", 2), 3, 2).tolist()  # of null id


def test_fewer_vectors_than_centroids_and_none(spark):
    assigned, cents = run(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])], 2, 5, 2, 10)
    assert len(cents) == 2 and {(r.id, r.cluster, r.distance) for r in assigned.collect()} == {(1, 0, 0), (2, 0, 0)}
    assigned, cents = run(spark, [(1, None)], 2, 5, 2, 10)
    assert len(cents) == 0 and D.with_inertia(assigned, cents).columns == ["id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and assigned.count() == 0

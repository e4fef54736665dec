import numpy as np
import pytest

from auditspark.llm import itq_dedup as I

SCHEMA = "id long, label int, vector array<float>"


def plain(rows, least=0.98):
    """id, links, component of each row, over all pairs."""
    ok = [k for k, (_, label, v) in enumerate(rows) if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {k: set() for k in range(len(rows))}
    for n, a in enumerate(ok):
        for b in ok[n + 1 :]:
            if rows[a][1] == rows[b][1] and len(rows[a][2]) == len(rows[b][2]):
                x, y = (np.array([rows[k][2]], dtype=np.float32).astype(np.float64) for k in (a, b))
                if I.cosines(x, y)[0] >= least:
                    links[a].add(b)
                    links[b].add(a)
    out = []
    for k, (i, _, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        ids = [rows[x][0] for x in seen if rows[x][0] is not None]
        least_id = min(ids) if ids else None
        out.append((i, len(links[k]), least_id, i is not None and i == least_id))
    return sorted(out, key=str)


def run(spark, rows, **how):
    return sorted((tuple(r) for r in I.near_vectors(spark.createDataFrame(rows, SCHEMA), **how).collect()), key=str)


def turned(rng, v, cosine):
    """Unit vectors at this cosine to unit vectors v."""
    away = rng.normal(size=v.shape)
    away -= (away * v).sum(axis=1, keepdims=True) * v
    return cosine * v + np.sqrt(1 - cosine**2) * away / np.linalg.norm(away, axis=1, keepdims=True)


def floats(m):
    return [[float(x) for x in v] for v in m]


def test_codes_are_balanced_and_the_radius_holds_the_pairs():
    rng = np.random.default_rng(1)
    x = I.unit(rng.normal(size=(20_000, 64)) * np.linspace(0.3, 2, 64) + 0.4)
    coder = I.learn(x[:5000])
    bits = np.unpackbits(coder.codes(x).view(np.uint8).reshape(-1, 8), axis=1).mean(axis=0)
    assert (np.abs(bits - 0.5) < 0.1).all() and len(set(coder.codes(x).tolist())) > 19_900
    masks = np.array(I._masks(coder.parts), dtype=np.uint64)
    assert sum(len(p) for p in coder.parts) == 64 and coder.radius < 2 * len(coder.parts)
    for cosine, share in ((0.98, 0.985), (0.99, 0.999)):
        gap = coder.codes(x[5000:]) ^ coder.codes(turned(rng, x[5000:], cosine))
        found = (np.bitwise_count(gap.view(np.uint64)) <= coder.radius) & (I.first_meeting(gap, masks) >= 0)
        assert found.mean() > share
    within = rng.integers(0, 2**62, 5000)
    gap = np.zeros(5000, dtype=np.int64)
    for b in range(coder.radius):
        gap ^= np.where(rng.random(5000) < 0.9, 1 << rng.integers(0, 63, 5000), 0)
    few = np.bitwise_count(gap.view(np.uint64)) <= coder.radius
    assert few.any() and (I.first_meeting(gap, masks)[few] >= 0).all() and len(within)


@pytest.mark.parametrize("tile", [8, 512])
def test_links_are_those_of_all_pairs(spark, tile):
    rng = np.random.default_rng(2)
    base = I.unit(rng.normal(size=(60, 32)))
    near = turned(rng, base[rng.integers(0, 20, 90)], 0.99)
    group = turned(rng, np.repeat(base[:1], 60, axis=0), 0.993)
    rows = [(n, n % 2, v) for n, v in enumerate(floats(np.concatenate((base, near, group))))]
    rows += [(1000 + n, 1, rows[0][2]) for n in range(30)] + [(2000 + n, 0, rows[0][2]) for n in range(3)]
    assert run(spark, rows, tile=tile) == plain(rows)


def test_recall_at_the_least_similarity(spark):
    rng = np.random.default_rng(3)
    base = I.unit(rng.normal(size=(1500, 64)))
    both = np.concatenate((base, turned(rng, base, 0.9801)))
    rows = [(n, n % 1500 % 3, v) for n, v in enumerate(floats(both))]
    got = {r[0]: r for r in run(spark, rows)}
    found = sum(got[n][1] >= 1 for n in range(1500))
    assert found >= 0.97 * 1500  # 0.9 is asked for
    wrong = [n for n in range(1500) if got[n][1] > 1]
    assert not wrong and all(got[n + 1500][2] in (n, n + 1500) for n in range(1500))


def test_odd_rows_link_with_nothing(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, 1, v), (2, 1, v), (3, 2, v), (4, None, v), (5, None, v), (None, 1, v), (6, 1, [0.0] * 3), (7, 1, [0.0] * 3), (8, 1, None), (9, 1, []), (10, 1, [1.0, None, 3.0]), (11, 1, [float("nan")] * 3), (12, 1, [float("inf"), 2.0, 3.0])]
    rows += [(20, 1, [1.0, 2.0]), (21, 1, [1.0, 2.001]), (22, 1, [3e38, 3e38]), (23, 1, [3e38, 2.9e38]), (30, 3, [1.0]), (31, 3, [2.0]), (32, 3, [-1.0]), (None, 9, [1.0])]
    assert run(spark, rows) == plain(rows)


def test_rows_of_one_id_and_chains(spark):
    angle = np.arange(0, 1.4, 0.19)  # each links with the next alone
    rows = [(50 - n, 1, [float(np.cos(a)), float(np.sin(a)), 0.0]) for n, a in enumerate(angle)] + [(43, 1, [0.0, 0.0, 1.0]), (43, 1, [0.0, 0.0, 1.0])]
    assert run(spark, rows) == plain(rows)


def test_empty_tables_and_columns_that_clash(spark):
    assert run(spark, []) == [] and run(spark, [(1, 1, None)]) == [(1, 0, 1, True)] and run(spark, [(1, 1, [1.0])]) == [(1, 0, 1, True)]
    df = spark.createDataFrame([(2, 1, [1.0, 0.0]), (1, 1, [1.0, 0.01]), (3, 2, [1.0, 0.0]), (None, 1, [1.0, 0.0])], SCHEMA).selectExpr("id AS vec_id", "label", "vector AS e", "7 AS id", "8 AS row", "9 AS kept", "1 AS n")
    kept = I.drop_near_vectors(df, "vec_id", "label", "e")
    assert kept.columns == df.columns and sorted(str(r.vec_id) for r in kept.collect()) == ["1", "3", "None"]

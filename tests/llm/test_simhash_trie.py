import random

import numpy as np
import xxhash

from auditspark.llm import simhash_trie as S
from auditspark.llm.components import components


def slow_simhash(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(fps, bits):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_fingerprints_are_those_of_the_definition():
    for t in (None, "", " \t", "One", "one two", "É é a B c d", "a b c d e f g " * 9, "x\ny\x0bz\x0c w", "😀 ok ok ok"):
        assert S.simhash(t) % 2**64 == slow_simhash(t if t is None else t.encode("utf-16", "surrogatepass").decode("utf-16"))


def test_traverse_finds_exactly_the_near_pairs():
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2**64, 40, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (40, 12), dtype=np.uint64)
    a = np.unique(np.concatenate([centres, (centres[:, None] ^ flips).ravel(), rng.integers(0, 2**64, 300, dtype=np.uint64), [np.uint64(0), np.uint64(2**64 - 1)]]))
    near = np.bitwise_count(a[:, None] ^ a[None, :]) <= 2
    for small in (1, 16, 10**9):
        i, j = S.traverse(a, a, 2, small)
        assert sorted(zip(i.tolist(), j.tolist())) == [(int(x), int(y)) for x, y in np.argwhere(np.triu(near, 1))]
    i, j = S.traverse(a[::2].copy(), a[1::2].copy(), 2)
    assert sorted(zip(i.tolist(), j.tolist())) == [(int(x), int(y)) for x, y in np.argwhere(near[::2, 1::2])]


def test_groups_equal_brute_force_with_a_crowded_trie(spark):
    random.seed(5)
    words = [f"w{i}" for i in range(50)]
    texts = [" ".join(random.choices(words, k=40)) for _ in range(25)]
    texts += [t + " " + random.choice(words) for t in texts for _ in range(3)] + texts[:5] * 4 + ["", None, " ", "only", "only two"]
    rows = [(i, t) for i, t in enumerate(texts)]
    fps = [slow_simhash(t) for t in texts]
    for bits in (2, 6):
        roots = brute_groups(fps, bits)
        least = {}
        for i, r in enumerate(roots):
            least.setdefault(r, i)
        got = {r.doc_id: (r.fp % 2**64, r.component_id) for r in S.simhash_groups(spark.createDataFrame(rows, "doc_id long, text string"), max_bits=bits, leaf_size=3).collect()}
        assert got == {i: (fps[i], least[roots[i]]) for i in range(len(texts))}


def test_one_row_of_each_group_stays_and_odd_rows_are_defined(spark):
    long = "the quick brown fox jumps over it " * 50
    rows = [(3, long, "a"), (1, long, "b"), (1, long, "b"), (2, "else entirely different words here", "c"), (None, long, "d"), (None, None, "e"), (7, None, None)]
    kept = S.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, component_id string"))
    assert kept.columns == ["doc_id", "text", "component_id"]
    assert sorted((r.doc_id or -1, r.component_id or "") for r in kept.collect()) == [(-1, "d"), (-1, "e"), (1, "b"), (2, "c"), (7, "")]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert S.simhash_groups(empty).collect() == [] and S.drop_near_duplicates(empty).collect() == []


def test_components_of_long_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(5, 4), (5, 4), (9, 9), (None, 3)]
    star = [(1000, 1001 + i) for i in range(50)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain + star, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {1000 + i: 1000 for i in range(51)}

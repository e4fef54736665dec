import random

import numpy as np
import pyarrow as pa

from auditspark.llm import components, simhash_trie
from auditspark.llm import near_dedup as N

SCHEMA = "doc_id long, text string, lang string"


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return words


def test_near_copies_go_and_others_stay(spark):
    rng = random.Random(9)
    rows, kin = [], {}
    for f in range(60):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(80, 400))]
        for k in range(rng.choice([1, 1, 2, 6])):
            text = edited(rng, base, 0 if k == 0 else rng.randint(0, len(base) // 50))
            kin[len(rows)] = f
            rows.append((len(rows), " ".join(text), "x"))
        rows.append((len(rows), " ".join(edited(rng, base, len(base) // 5)), "far"))
        kin[len(rows) - 1] = -len(rows)
    order = list(rows)
    rng.shuffle(order)
    gone = {r.doc_id: r.of for r in N.near_copies(spark.createDataFrame(order, SCHEMA), leaf_size=32).collect()}
    text = {i: t for i, t, _ in rows}
    assert all(N.similarity(text[a], text[b]) >= 0.8 and b not in gone and b < a for a, b in gone.items())
    near = [(a, b) for a in text for b in text if b < a and N.similarity(text[a], text[b]) >= 0.8]
    assert len(near) > 60
    assert sum(a not in gone and b not in gone for a, b in near) <= 0.05 * len(near)
    kept = N.drop_near_copies(spark.createDataFrame(order, SCHEMA), leaf_size=32)
    assert kept.columns == ["doc_id", "text", "lang"] and {r.doc_id for r in kept.collect()} == set(text) - set(gone)


def test_odd_rows(spark):
    long = "the quick brown fox jumps over it " * 50
    rows = [(3, long, "a"), (1, long, "b"), (1, long, "b"), (2, "else entirely different words here", "c"), (None, long, "d"), (None, None, "e"), (7, None, None), (8, "", None), (9, "two words", None), (10, "Two  words", None)]
    kept = N.drop_near_copies(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id or -1, r.lang or "") for r in kept) == [(-1, "d"), (-1, "e"), (1, "b"), (2, "c"), (7, ""), (9, "")]
    assert N.drop_near_copies(spark.createDataFrame([], SCHEMA)).collect() == []
    assert N.similarity("a b c d e f", "a b c d e g") == 1 / 3


def test_rows_that_share_an_id_but_not_the_text(spark):
    one, two = "the quick brown fox jumps over it " * 50, "entirely different words stand here now " * 50
    rows = [(1, one, "a"), (2, one, "b"), (2, two, "c"), (2, two, "d"), (3, two, "e")]
    kept = {(r.doc_id, r.text) for r in N.drop_near_copies(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert kept == {(1, one), (2, two)}


def test_runs_are_read_alike_however_batches_are_cut():
    rng = random.Random(1)
    rows = sorted((rng.choice([1, 2, 3, 5, 8, 9]) if rng.random() < 0.8 else rng.randrange(10, 60), rng.randrange(200), 10, 0, False) for _ in range(900))

    def read(cut, at_once=1):
        batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + cut]), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()))], names=["shingle", "key", "size", "place", "hot"]) for i in range(0, len(rows), cut)]
        return {tuple(r.values())[:4] for b in N._read_runs(0.8, 6, at_once)(iter(batches)) for r in b.to_pylist()}

    keys = {}
    for s, k, *_ in rows:
        keys.setdefault(s, set()).add(k)
    want = {(True, 0, a, b) for ks in keys.values() if len(ks) <= 6 for a in ks for b in ks if a < b} | {(False, s, k, 0) for s, ks in keys.items() if len(ks) > 6 for k in ks}
    assert read(900) == want
    for cut in (1, 7, 100):
        assert read(cut) == read(cut, 300) == read(cut, 20_000) == want


def test_every_pair_of_the_similarity_is_found(spark):
    """Runs of words replaced, left out and put in until a copy is barely near: none may be missed."""
    rng = random.Random(4)
    rows = []
    for _ in range(60):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(30, 300))]
        rows.append((len(rows), " ".join(base), "x"))
        run = len(base) // 10
        for kind in range(3):
            at, fresh = rng.randrange(len(base) - run), [f"new{rng.randrange(10**6)}" for _ in range(run)]
            text = base[:at] + (fresh if kind else []) + base[at + (run if kind < 2 else 0) :]
            while N.similarity(" ".join(base), " ".join(text)) < 0.8:
                text = [*base, *fresh[: len(base) // 5]] if kind == 2 else base[: len(base) - len(base) // 5 + 1]
            rows.append((len(rows), " ".join(text), "x"))
    text = {i: t for i, t, _ in rows}
    stay: list[int] = []
    for i in sorted(text):
        if not any(N.similarity(text[i], text[j]) >= 0.8 for j in stay):
            stay.append(i)
    for leaf_size in (3, 32):
        kept = N.drop_near_copies(spark.createDataFrame(rows[::-1], SCHEMA), leaf_size=leaf_size)
        assert sorted(r.doc_id for r in kept.collect()) == stay
    assert len(stay) < len(rows) - 150


def test_possible_drops_no_text_that_may_be_near(spark):
    rng = random.Random(6)
    rows = {(rng.randrange(6), i): (n := rng.randint(5, 60), rng.randrange(max(1, n // 3))) for i in range(200)}
    left = {(r.shingle, r.doc_id) for r in N.possible(spark.createDataFrame([(s, i, n, p) for (s, i), (n, p) in rows.items()], "shingle long, doc_id long, size int, place int"), 0.8).collect()}
    may = {x for x, (n, p) in rows.items() for y, (m, q) in rows.items() if x[0] == y[0] and x != y and N.enough_left(n, m, p, q, 0.8)}
    assert may <= left < set(rows)


def test_texts_of_a_template_that_the_sample_misses(spark, monkeypatch):
    """Pages that share half of their words, and near copies of some of them: the same stay as by all pairs, and no rounds of leaders
    are needed for the pages."""
    monkeypatch.setattr(N, "SAMPLE_SHARE", 0)
    rng = random.Random(8)
    frame = [f"menu{k}" for k in range(120)]
    rows = []
    for i in range(150):
        words = frame + [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(100, 140))]
        rows.append((len(rows), " ".join(words), "x"))
        if i % 10 == 0:
            for _ in range(3):
                rows.append((len(rows), " ".join(edited(rng, words, 4)), "near"))
    stay: list[int] = []
    for i, text, _ in rows:
        if not any(N.similarity(text, rows[j][1]) >= 0.8 for j in stay):
            stay.append(i)
    tables = []
    kept_as = N.materialize
    monkeypatch.setattr(N, "materialize", lambda df, name="table": tables.append(name) or kept_as(df, name))
    kept = N.drop_near_copies(spark.createDataFrame(rows[::-1], SCHEMA), leaf_size=8)
    assert sorted(r.doc_id for r in kept.collect()) == stay and len(stay) == 150
    assert tables.count("firsts") <= 2 and "met_again" in tables


def test_signatures_never_rule_out_near_sets_and_rule_out_most_others():
    rng = np.random.default_rng(3)
    kept = {True: 0, False: 0}
    for n in [1, 2, 5, 15, 16, 17, 60, 300, 3000] * 12:
        a = rng.integers(-(2**63), 2**63 - 1, n)
        for share in (1.0, 0.9, 0.89, 0.8, 0.6, 0.0):
            b = np.unique(np.concatenate((a[: int(round(share * n))], rng.integers(-(2**63), 2**63 - 1, max(1, n - int(round(share * n)))))))
            near = N.jaccard(np.unique(a), b) >= 0.8
            may = N.may_be_near(n, N.signature(np.unique(a)), len(b), N.signature(b), 0.8)
            assert may or not near
            kept[may] += n >= 60 and share <= 0.6
    assert kept[True] < 0.02 * kept[False]


def test_simhash_groups_spare_the_prefix_filter(spark, monkeypatch):
    """Texts of one SimHash group that are near its least document are not looked for again, and what stays is the same, also if
    that document goes for one that they are near to, or are not near to."""
    rng = random.Random(12)
    base = [f"w{k}" for k in range(600)]
    cut = lambda words, n: words[: len(words) - n]
    rows = [(10, " ".join(base), "x"), (11, " ".join([*base, "end"]), "x"), (12, " ".join([*base, "last", "end"]), "x")]
    rows += [(20 + i, " ".join(f"v{rng.randrange(10**6)}" for _ in range(200)), "other") for i in range(4)]
    near, barely = (5, " ".join(cut(base, 40)), "x"), (5, " ".join(cut(base, 119)), "x")
    assert N.similarity(barely[1], rows[0][1]) >= 0.8 > N.similarity(barely[1], rows[2][1])
    sizes, read = [], N._prefix_rows

    def counted(shared, least, width, leaf_size):
        sizes.append(width)
        return read(shared, least, width, leaf_size)

    monkeypatch.setattr(N, "_prefix_rows", counted)
    tables = {}
    kept_as = N.materialize

    def noted(df, name="table"):
        out = kept_as(df, name)
        tables.setdefault(name, out)
        return out

    monkeypatch.setattr(N, "materialize", noted)
    for more, passes in (([], 1), ([near], 1), ([barely], 2)):
        sizes.clear()
        tables.clear()
        every = rows + more
        stay: list[int] = []
        for i, text, _ in sorted(every):
            if not any(N.similarity(text, t) >= 0.8 for j, t, _ in every if j in stay):
                stay.append(i)
        kept = sorted(r.doc_id for r in N.drop_near_copies(spark.createDataFrame(every[::-1], SCHEMA)).collect())
        assert kept == stay and len(sizes) == passes
        assert {r.doc_id for r in tables["early"].collect()} == {11, 12}
        early = {r.id for r in tables["early_keys"].collect()}
        assert len(early) == 2 and not early & {k for r in tables["met"].select("a", "b").collect() for k in (r.a, r.b)}


def test_steps_without_rows_write_no_tables(spark, monkeypatch):
    """Each table is a plan of the driver's, whose memory many plans fill, so steps that have nothing to do make none."""
    tables = []
    kept_as = N.materialize
    for module in (N, simhash_trie, components):
        monkeypatch.setattr(module, "materialize", lambda df, name="table": tables.append(name) or kept_as(df, name))
    rng = random.Random(5)
    rows = [(i, " ".join(f"v{rng.randrange(10**6)}" for _ in range(60)), "x") for i in range(40)]
    rows += [(100 + i, rows[i][1], "copy") for i in range(5)]
    kept = N.drop_near_copies(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r.doc_id for r in kept) == list(range(40))
    assert tables.count("edges") == 1 and not {"shared_ids", "near", "judged", "settled", "sure"} & set(tables) and len(tables) <= 18

    tables.clear()
    base = [f"w{k}" for k in range(300)]
    rows += [(200, " ".join(base), "x"), (201, " ".join([*base, "end"]), "near"), (202, " ".join([*base[:100], "new", *base[101:]]), "near")]
    kept = N.drop_near_copies(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r.doc_id for r in kept) == [*range(40), 200]
    assert not {"likely_ids", "early_ids", "went"} & set(tables)

import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from auditspark.llm import cgk_decontam as D


def sellers(a, b):
    prev = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return min(prev)


def words(t):
    return re.findall(r"\w+", (t or "").lower())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=90), st.lists(st.integers(0, 4), max_size=120))
def test_edit_distance_is_exact(item, text):
    assert D.edit_distance_within(item, text) == sellers(item, text)


def test_word_hashes_do_not_depend_on_place_or_piece(monkeypatch):
    h = D.WordHasher()
    text = "One two, THREE-four é été 5x " * 40
    whole = h.words(text)
    assert len(whole) == 7 * 40 and (whole.reshape(40, 7) == whole[:7]).all() and len(set(whole[:7].tolist())) == 7
    monkeypatch.setattr(D, "PIECE_BYTES", 37)
    assert (D.WordHasher().words(text) == whole).all() and len(D.WordHasher().words("x" * 1000)) == 1


def corpus(seed, n_docs=250, n_items=30):
    rng = random.Random(seed)
    common, rare = ["the", "of", "and", "to", "in"], [f"w{i}" for i in range(3000)]
    say = lambda n: [rng.choice(common) if rng.random() < 0.4 else rng.choice(rare) for _ in range(n)]
    items = [(100 + i, say(rng.randint(5, 60))) for i in range(n_items)]
    docs = []
    for d in range(n_docs):
        text = say(rng.randint(0, 200))
        if d % 2:
            _, item = rng.choice(items)
            edited = list(item)
            for _ in range(rng.randint(0, int(0.25 * len(item)))):
                p = rng.randrange(len(edited))
                edited[p : p + rng.choice([0, 1, 1])] = rng.choice([[], say(1)])
            at = rng.randint(0, len(text))
            text[at:at] = edited
        docs.append((d, " ".join(w + rng.choice(["", "", ",", ".\n"]) for w in text)))
    return docs, [(i, " ".join(w).capitalize() + ".") for i, w in items]


def truth(docs, items):
    out = {}
    for d, t in docs:
        for i, x in items:
            if len(set(words(x)) & set(words(t))) > 1:
                e = sellers(words(x), words(t))
                if e <= int(D.MAX_RATE * len(words(x))):
                    out[d, i] = e
    return out


def test_recall_and_precision_against_brute_force(spark):
    docs, items = corpus(1)
    want = truth(docs, items)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    found = D.find_leaks(frame, spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.doc_id, x.item_id): x.edits for r in found.collect() for x in r.leaks}
    assert len(want) > 80 and all(got[k] == want.get(k) for k in got)
    assert len(got) / len(want) >= 0.95
    assert all(k in got for k, e in want.items() if e == 0)
    kept = D.drop_contaminated(frame, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == ["doc_id", "text"] and {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in got}


def test_results_do_not_depend_on_what_is_looked_at_together():
    docs, items = corpus(2, 60)
    index = D.LeakIndex(items)
    together = index.of_texts([t for _, t in docs])
    assert together == [index.of_texts([t])[0] for _, t in docs]
    assert index.repeats <= D.MOST_REPEATS and np.mean([len(x) for x in together]) > 0.2


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_ITEMS", 2)
    item = "Alpha beta gamma delta epsilon zeta eta theta"
    bench = [(1, item), (2, item), (3, "quite short"), (4, None), (None, item), (5, ""), (6, "é à ü ö ñ ç â î ô û"), (7, "審計準則第一號必須遵守"), (8, ",.;")]
    docs = [(1, None, "a"), (2, "", "b"), (3, f"x {item.upper()}! y", None), (4, "the " * 60_000 + item.replace(" ", "\n"), "d"), (5, "É À Ü Ö Ñ Ç Â Î Ô Û", "e"), (5, "É À Ü Ö Ñ Ç Â Î Ô Û", "e"), (6, "quite, SHORT", ""), (7, "short quite", ""), (8, "按審計準則第二號必須遵守。", "")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, LEAKS string")
    rows = D.find_leaks(frame, spark.createDataFrame(bench, "item_id long, text string"))
    assert rows.columns == ["doc_id", "text", "leaks"]
    got = sorted((r.doc_id, [(x.item_id, x.edits) for x in r.leaks]) for r in rows.collect())
    assert got == [(1, []), (2, []), (3, [(1, 0), (2, 0)]), (4, [(1, 0), (2, 0)]), (5, [(6, 0)]), (5, [(6, 0)]), (6, [(3, 0)]), (7, []), (8, [(7, 1)])]
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.drop_contaminated(frame, none).count() == 9 and D.find_leaks(frame.limit(0), none).collect() == []


def test_recall_at_the_most_edits_of_short_and_long_items(spark):
    """Items of each length by themselves, with all the edits that are allowed: easy trials do not make up for hard ones."""
    rng = random.Random(3)
    say = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    items = [(i, say(n)) for i, n in enumerate([*[5, 9] * 10, *[15, 24, 59] * 10, *[110, 150] * 10])]
    docs, lengths = [], {}
    for i, item in items:
        for _ in range(10):
            edited = list(item)
            for _ in range(int(D.MAX_RATE * len(item))):
                p = rng.randrange(len(edited))
                edited[p : p + rng.choice([0, 1, 1])] = rng.choice([[], say(1)])
            lengths.setdefault(len(item), []).append((len(docs), i))
            docs.append((len(docs), " ".join([*say(30), *edited, *say(30)])))
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    classes = D.leak_classes(bench).collect()
    assert sum(c["items"] for c in classes) == len(items) and all(c.recall >= D.TARGET_RECALL - 0.01 for c in classes) and any(c.walks for c in classes)
    for found, least in ((D.find_leaks(frame, bench, recall=1.0), 1), (D.find_leaks(frame, bench), 0.95)):
        got = {(r.doc_id, x.item_id) for r in found.collect() for x in r.leaks}
        for n, pairs in lengths.items():
            assert sum(p in got for p in pairs) >= least * len(pairs), n


def test_pieces_miss_nothing(monkeypatch):
    monkeypatch.setattr(D, "MOST_REPEATS", 0)
    docs, items = corpus(5)
    index = D.LeakIndex(items)
    got = {(d, i): e for (d, _), one in zip(docs, index.of_texts([t for _, t in docs])) for i, e in one}
    assert got == truth(docs, items) and index.repeats == 0 and len(got) > 80

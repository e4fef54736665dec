import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from auditspark.functions.text import trigrams
from auditspark.operators import search, trigram_index
from auditspark.operators.trigram_index import build_index

rng = random.Random(3)
LETTERS = "abcAB 1é票"
TEXTS = [(i, "".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 40)))) for i in range(300)] + [(300, None), (301, ""), (302, "100% real_thing"), (303, "a.b-c"), (304, "发票报销单")]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    return build_index(spark.createDataFrame(TEXTS, "id long, text string"), str(tmp_path_factory.mktemp("index") / "i"))


def ilike(text, word):
    pattern = "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in word.lower())
    return text is not None and re.search(pattern, text.lower(), re.S) is not None


@pytest.mark.parametrize("words", [["abc"], ["aBc a", "1é"], ["票"], ["a"], ["b 1", "票a"], ["ab_a", "ca%票"], ["报销"], ["nothing here"], [".b-"], ["abcabcabc", "发票"], []])
def test_what_is_found_is_what_ilike_finds(spark, index, words):
    rows = spark.createDataFrame(TEXTS, "id long, text string")
    want = sorted(i for i, t in TEXTS if any(ilike(t, w) for w in words))
    assert sorted(r.id for r in index.holding(rows, words, "text").collect()) == want


def test_words_without_letters_are_not_narrowed(spark, index):
    rows = spark.createDataFrame(TEXTS, "id long, text string")
    assert index.candidates(["-"]) is None and [r.id for r in index.holding(rows, ["-"], "text").collect()] == [303]
    assert index.narrowed(rows, ["abc"]).count() < 60


def test_lookups_reach_the_scan_and_the_rarest_come_first(index):
    plan = index.candidates(["abca"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "gram" in plan.split("PushedFilters: [")[1][:200] and "Cartesian" not in plan
    counts = {r.gram: r.n for r in index.counts.collect()}
    for word in ("abcab", "cab1"):
        found = index._lookups(word)
        assert found is not None and [counts[g] for g in found] == sorted(counts[g] for g in found)


def test_pairs_are_those_of_the_join_on_names(spark, index):
    got = {(r.a, r.b): r.similarity for r in index.similar_pairs(0.4).collect()}
    text = {i: t for i, t in TEXTS if t}
    names = {}
    for i, t in text.items():
        names.setdefault(t, []).append(i)
    by_name = {(r.a, r.b): r.similarity for r in search.trigram_join(spark.createDataFrame(TEXTS, "id long, text string"), "text", 0.4).collect()}
    want = {(min(x, y), max(x, y)): s for (a, b), s in by_name.items() for x in names[a] for y in names[b]}
    alike = {k: s for k, s in got.items() if text[k[0]] != text[k[1]]}
    assert len(want) > 20 and alike == want


def test_later_ones_are_counted_and_not_listed(spark, index):
    want = {}
    for r in index.similar_pairs(0.4).collect():
        n, s = want.get(r.a, (0, 0.0))
        want[r.a] = n + 1, s + r.similarity
    got = {r.id: (r.n, r.similarity) for r in index.similar_later(0.4).collect()}
    assert len(want) > 10 and got.keys() == want.keys() and all(got[k][0] == n and abs(got[k][1] - s) < 1e-9 for k, (n, s) in want.items())
    members, pairs = index.similar_classes(0.4)
    assert members.count() == index.postings.select("id").distinct().count() and not pairs.where("a >= b").count()


def test_the_first_are_found_lot_by_lot(spark, index, monkeypatch):
    rows = spark.createDataFrame(TEXTS, "id long, text string")
    monkeypatch.setattr(trigram_index, "LOT", 1)
    for words, most in ((["abc", "ab_1"], 3), (["票"], 2), (["a"], 5), (["a%b%c a"], 4), (["nothing here"], 2), (["-"], 1)):
        want = sorted(i for i, t in TEXTS if any(ilike(t, w) for w in words))
        got = sorted(r.id for r in index.first_holding(rows, words, "text", most).collect())
        assert got[:most] == want[:most] and set(got) <= set(want)


def test_blocks_hold_the_trigrams_of_similarity(spark, index, tmp_path, monkeypatch):
    monkeypatch.setattr(trigram_index, "BLOCK_POSTINGS", 50)
    rows = spark.createDataFrame([*TEXTS, (400, "İstanbul ﬁn 𝒜𝟙x\u00a0y—z"), (401, "  "), (402, "aa aa aa")], "id long, text string")
    want = sorted((r.id, r.g) for r in rows.select("id", F.explode(trigrams(F.col("text"))).alias("g")).collect())
    small = build_index(rows, str(tmp_path / "i"))
    assert sorted((r.id, r.gram) for r in small.postings.collect()) == want
    stored = spark.read.parquet(f"{small.path}/postings")
    assert stored.count() < len(want) and stored.where("n <> size(ids)").count() == 0
    assert {(r.gram, r.n) for r in small.counts.collect()} == set(Counter(g for _, g in want).items())

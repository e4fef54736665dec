import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from auditspark.functions import segment
from auditspark.functions.segment import Segmenter, query_words, segmented, segmenter

CHARS = "税发票单增"


def ways(text):
    if not text:
        yield []
    for i in range(1, len(text) + 1):
        for rest in ways(text[i:]):
            yield [text[:i], *rest]


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.text(CHARS, min_size=1, max_size=4), st.integers(1, 50), max_size=12), st.text(CHARS, max_size=9))
def test_the_path_is_the_most_probable_of_all(counts, text):
    total = sum(counts.values()) or 1
    score = lambda words: sum(math.log(counts.get(w, 1) / total) for w in words)
    allowed = [w for w in ways(text) if all(len(x) == 1 or x in counts for x in w)]
    got = Segmenter(counts.items()).cut(text)
    assert "".join(got) == text and score(got) >= max(map(score, allowed)) - 1e-9


def test_runs_of_other_letters_are_words_and_the_rest_goes():
    s = Segmenter([("增值税", 8), ("发票", 10), ("", 3), ("单", 0), ("报销", 2), ("报销", 3)])
    assert s.words("增值税发票ABC-12 naïve，报销单") == ["增值税", "发票", "ABC", "12", "naïve", "报销", "单"]
    assert s.words(None) == s.words("") == s.words("—— !") == [] and Segmenter([]).words("发票") == ["发", "票"]
    assert query_words("发票和发票ABC x 报销", s) == ["发票", "ABC", "报销"] and query_words("发票报销", s, 1) == ["发票"]
    assert Segmenter([("发票", 1)]).words("发票" * 3000) == ["发票"] * 3000


def test_a_column_and_a_dictionary_table(spark, monkeypatch):
    table = spark.createDataFrame([("增值税", 8), ("发票", 10), (None, 5), ("单", None), ("报销", 2), ("报销", 3)], "word string, count long")
    rows = spark.createDataFrame([(1, "增值税发票"), (2, None), (3, "")], "id long, text string")
    assert {r.id: r.w for r in rows.select("id", segmented(F.col("text"), table).alias("w")).collect()} == {1: ["增值税", "发票"], 2: [], 3: []}
    monkeypatch.setattr(segment, "MOST_CHARACTERS", 5)
    with pytest.raises(ValueError):
        segmenter(table)

import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from auditspark.functions import providers
from auditspark.functions import text as T
from auditspark.functions import validate as V
from auditspark.functions import vector as X


def col(spark, values, kind, make):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"x {kind}").select(make(F.col("x"))).collect()]


def amount_words(n: int) -> str:
    """n (below 10^12) in Chinese numerals."""
    digits = "零壹贰叁肆伍陆柒捌玖"

    def below_ten_thousand(x):
        out, zero = "", False
        for unit, size in (("仟", 1000), ("佰", 100), ("拾", 10), ("", 1)):
            d = x // size % 10
            if d:
                out += ("零" if zero and out else "") + digits[d] + unit
            zero = not d
        return out

    out = ""
    for unit, size in (("亿", 10**8), ("万", 10**4), ("", 1)):
        part = n // size % 10**4
        if part:
            out += ("零" if out and part < 1000 else "") + below_ten_thousand(part) + unit
    return out + "元整"


def test_chinese_amounts(spark):
    texts = ["壹仟贰佰叁拾肆元伍角陆分", "12.34", "N/A", None, "拾元", "無", "零元", "貳萬參仟圓", "伍角"]
    assert col(spark, texts, "string", V.chinese_amount) == [1234.56, 12.34, None, None, 10.0, None, None, 23000.0, 0.5]
    assert col(spark, texts[:1], "string", lambda c: V.chinese_amount(c, "compat")) == [1002034.56]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(1, 10**12 - 1), min_size=40, max_size=40))
def test_chinese_amounts_go_round(spark, numbers):
    assert col(spark, [amount_words(n) for n in numbers], "string", V.chinese_amount) == [float(n) for n in numbers]


def test_validation(spark):
    as_of = F.lit(datetime.date(2024, 6, 30))
    assert col(spark, [None, "N/A", "2024-3-5", "2024-13-01", "2024-07-01", "x"], "string", lambda c: V.valid_date(c, as_of)) == [True, True, True, False, False, False]
    assert col(spark, ["12.34", "12.345", "-1", "壹元", None, "12", "abc", "0"], "string", V.valid_amount) == [True, False, False, True, True, True, False, True]
    assert col(spark, ["A" * 18, "A" * 17, "a" * 18, "N/A"], "string", V.valid_credit_code) == [True, False, False, True]
    assert col(spark, ["true", "1", "YES", "no", None, "2"], "string", V.to_bool) == [True, True, True, False, False, False]


def test_scores(spark):
    row = spark.range(1).select(V.confidence(F.lit("a topic"), F.lit("s" * 11), F.lit("c" * 151), F.lit(1), F.lit("x")), V.confidence(*[F.lit(None).cast("string")] * 3, F.lit(0), F.lit("")), V.quality_score(F.lit("1"), F.lit("无"), F.lit("N/A"), F.lit("其他"), F.lit(None).cast("string"))).first()
    assert list(row) == [0.95, 0.3, 40.0]


def test_text(spark):
    assert col(spark, ["a the Ab x1 the 审计", None], "string", T.keywords) == [["the", "Ab", "x1", "审计"], []]
    assert col(spark, ["![图](a/b.png) ![](c/d e.png)", "![image](p/q.png)", "no"], "string", T.image_placeholder) == ["【图片：图】 ![](c/d e.png)", "【图片：q】", "no"]
    assert col(spark, ["第一句。第二！尾"], "string", T.sentences) == [["第一句。", "第二！", "尾"]]
    assert col(spark, ["```json\n{\"a\": 1}\n```"], "string", T.strip_fences) == ['{"a": 1}']
    assert col(spark, ["x {'a': 1} {", 'pre {"a": {"b": "}"}} post {"c": 1}', "none"], "string", T.first_object) == ['{"a": 1}', '{"a": {"b": "}"}}', None]
    assert col(spark, ["a {b} c} d", "x"], "string", T.greedy_object) == ["{b} c}", None]
    assert col(spark, ["第三章 审计", "第1节 x", "一、甲", "（二）乙", "正文"], "string", T.heading_rank) == [1, 2, 3, 4, None]
    assert col(spark, ["abc"], "string", lambda c: T.trigram_similarity(c, F.lit("abc"))) == [1.0]
    assert col(spark, [37], "int", T.bar) == ["█" * 7]
    assert col(spark, [""], "string", lambda c: T.source_label(c, c, c, F.lit(7))) == ["教材 #7"]


def test_vectors(spark):
    row = spark.range(1).select(X.l2_distance(X.literal([0, 3]), X.literal([4, 0])), X.cosine(X.literal([0, 0]), X.literal([1, 1])), X.guarded_cosine(X.literal([1, 0]), X.literal([1])), X.guarded_cosine(X.literal([2, 0]), X.literal([1, 1])), X.above_mean_bits(X.literal([1, 5, 2, 8])), F.to_json(X.parse_vector(F.lit("[1.5,2]")))).first()
    assert row[0] == 5.0 and row[1] == 0.0 and row[2] is None and row[3] == pytest.approx(0.5**0.5) and row[4] == 0b0101 and row[5] == "[1.5,2.0]"


def test_providers(spark):
    rows = spark.createDataFrame([(1, "q", "a" * 60), (2, "q", "short"), (3, "q", None)], "id long, question string, answer string")
    model = providers.echo_llm([{"topic": "t" * 300, "content": "c", "summary": "s", "category": "k"}, {"topic": "t", "content": "  "}])
    got = providers.extracted_knowledge(rows, model).collect()
    assert [(r.id, len(r.topic), r.content) for r in got] == [(1, 200, "c")]
    vectors = [r.embedding for r in providers.embedded(rows, "answer", providers.hashed_embedding(8)).orderBy("id").collect()]
    assert vectors[2] is None and sum(x * x for x in vectors[0]) == pytest.approx(1.0)
    seen = []

    def flaky(texts):
        seen.append(texts[0])
        if len(seen) < 3:
            raise ValueError
        return texts

    assert providers.with_retries(flaky, 3, repair=lambda t: t + "!")(["a"]) == ["a!!"] and providers.with_retries(flaky, 0)(["b"]) == [None]

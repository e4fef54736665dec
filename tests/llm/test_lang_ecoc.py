import random

import numpy as np

from auditspark.llm import lang_ecoc as L

WORDS = {"aa": "thing other there with that from have", "bb": "der die und nicht ein schon über", "cc": "le de que être pour était voilà", "dd": "el niño que para como más señor"}


def rows(n, seed):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choices(WORDS[lang].split(), k=rng.randint(3, 60))), lang) for i in range(n) for lang in [rng.choice(sorted(WORDS))]]


def test_codewords_keep_their_distance():
    for n in range(2, 7):
        c = L.codewords(n)
        assert c.shape == (n, 2 ** (n - 1) - 1)
        assert all((c[i] != c[j]).sum() == 2 ** (n - 2) for i in range(n) for j in range(i))
    assert min((L.codewords(12)[i] != L.codewords(12)[j]).sum() for i in range(12) for j in range(i)) >= 5


def test_one_wrong_bit_is_corrected():
    code = L.codewords(4)
    model = L.LanguageModel(list("abcd"), code, np.zeros((L.BUCKETS, 7), np.float32), np.ones(7) / 7, 1.0)
    for i in range(4):
        for bit in range(7):
            margins = code[i].copy()
            margins[bit] *= -1
            assert model.decode(margins, 100)[0] == "abcd"[i]


def test_held_out_accuracy_and_odd_texts(spark):
    data = [(i, t, lang) for i, t, lang in rows(600, 1)] + [(10_000, None, "aa"), (10_001, "", "aa"), (10_002, "123 !!", None), (None, "der die und", "bb"), (10_003, "über " * 40_000, None)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string").withColumn("Score", L.F.lit("old"))
    model = L.fit_on_documents(docs, sample_per_language=50)
    out = L.predict_languages(docs, model).withColumn("held", L.held_out(L.F.col("doc_id")))
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score", "ambiguous", "held"]
    got = out.collect()
    held = [r for r in got if r.held and r.text and r.lang]
    assert len(got) == len(data) and len(held) > 50
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    by = {r.doc_id: r for r in got}
    assert [by[k].lang_pred for k in (10_000, 10_001, 10_002)] == ["und"] * 3 and by[10_003].lang_pred == "bb"
    assert all(0 <= r.score <= 1 for r in got)
    kept = L.keep_identified(docs, model)
    assert kept.columns == docs.columns and not {10_000, 10_001, 10_002} & {r.doc_id for r in kept.collect()}
    assert kept.count() >= 595


def test_labels_of_held_out_rows_are_never_read(spark):
    data = rows(300, 2)
    frame = lambda d: spark.createDataFrame(d, "doc_id long, text string, lang string")
    held = {r.doc_id for r in frame(data).where(L.held_out(L.F.col("doc_id"))).collect()}
    a = L.fit_on_documents(frame(data))
    b = L.fit_on_documents(frame([(i, "xyzzy" if i in held else t, "aa" if i in held else lang) for i, t, lang in data]))
    assert np.allclose(a.weights, b.weights, atol=1e-4)


def test_no_labels_or_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = L.fit_on_documents(empty)
    assert L.predict_languages(empty, model).collect() == []
    assert L.predict_languages(spark.createDataFrame([("hello",)], "text string"), model).first().lang_pred == "und"
    one = L.fit_on_documents(spark.createDataFrame([(i, "some words", "en") for i in range(8)], "doc_id long, text string, lang string"))
    assert one.predict("other") == ("en", 1.0, False)


def test_only_letters_count():
    assert not len(L.ngram_buckets("½ ² Ⅷ ٣ 12 __ !")) and len(L.ngram_buckets("ª")) and (L.ngram_buckets("a½b") == L.ngram_buckets("A b")).all()


def test_predictions_are_those_of_a_plain_version(spark):
    """Counting n-grams one by one, log-odds of each bit, and the codeword of the least loss."""
    data = rows(160, 5)
    model = L.fit(spark.createDataFrame(data, "id long, text string, lang string"), sample_per_language=10**6)

    def grams(text):
        words = " ".join(L.regex.findall(r"\p{L}+", text)).lower()
        c = [ord(x) for x in f" {words} "]
        mul = lambda *x: np.array(x[0] * x[1], dtype=object) % 2**32
        two = [int(mul(a, 0x9E3779B1)) ^ int(mul(b, 0x85EBCA6B)) for a, b in zip(c, c[1:])]
        three = [int(mul(a, 0xC2B2AE35)) ^ int(mul(b, 0x27D4EB2F)) for a, b in zip(two, c[2:])]
        mixed = [int(mul(a, 0x165667B1)) for a in c if a != 32] + two + three
        return [int(mul(h ^ h >> 15, 0x2C1B3C6D)) >> 17 for h in mixed]

    langs = sorted({lang for *_, lang in data})
    freq = {k: {} for k in langs}
    for _, text, lang in data:
        g, n = grams(text), sum(x == lang for *_, x in data)
        for b in g:
            freq[lang][b] = freq[lang].get(b, 0) + 1 / len(g) / n
    assert model.languages == langs
    for _, text, lang in rows(40, 6):
        g = grams(text)
        loss = np.zeros(len(langs))
        for bit, side in enumerate(model.code.T):
            groups = [[k for k, x in zip(langs, side) if x == s] for s in (1, -1)]
            odds = lambda b: np.log(np.mean([freq[k].get(b, 0) for k in groups[0]]) + 1e-6) - np.log(np.mean([freq[k].get(b, 0) for k in groups[1]]) + 1e-6)
            expected = {k: sum(n * odds(b) for b, n in freq[k].items()) for k in langs}
            top, low = min(expected[k] for k in groups[0]), max(expected[k] for k in groups[1])
            margin = sum(map(odds, g)) / len(g) - (top + low) / 2
            loss += model.bit_weight[bit] * np.logaddexp(0, -model.scale * min(len(g), L.SUREST_LENGTH) ** 0.5 * margin * side)
        assert model.predict(text)[0] == langs[int(np.argmin(loss))]

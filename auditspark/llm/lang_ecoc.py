"""Language identification by error-correcting output codes.

Every language has a codeword of bits. For each bit a binary classifier over character n-grams decides which of two sets of
languages a text is from. A text's language is the codeword nearest to the classifiers' margins, where each bit's loss is
weighted by how reliable the bit was on the training sample (loss-weighted decoding). If the nearest two codewords are about as
far, the prediction is flagged as ambiguous.

The binary classifiers are log-odds of hashed 1- to 3-grams of lower-cased letters (words padded with a space), averaged over a
text, so that texts of any length are alike. They are fitted on a bounded sample of labelled rows: about `sample_per_language`
rows of each language, chosen by a hash of the row's id. Counts are added up in a fixed number of tasks, so the driver gets
SAMPLE_TASKS arrays a language, however large the input. Prediction reads whole texts and needs no shuffle.

Defined cases: a null text or one without letters is `und` with score 0; a text whose n-grams were all unseen gets the first
language in order, flagged as ambiguous; without any labelled row all texts are `und`. Columns of the same names are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import with_fresh

#: Rows of each language that the classifiers are fitted on, in expectation.
SAMPLE_PER_LANGUAGE = 2_000
SAMPLE_TASKS = 8
BUCKETS = 1 << 15
#: A prediction is ambiguous if the two nearest codewords' probabilities differ by less.
AMBIGUOUS_GAP = 0.2
UNDETERMINED = "und"
#: The whole text is read, but a prediction does not get surer beyond so many n-grams: they are no independent draws.
SUREST_LENGTH = 400

NOT_LETTERS = regex.compile(r"\P{L}+")


def ngram_buckets(text: str | None) -> np.ndarray:
    """Hashed 1- to 3-grams of the text's letters, one entry for each occurrence."""
    letters = NOT_LETTERS.sub(" ", text or "").strip().lower()
    if not letters:
        return np.zeros(0, dtype=np.int64)
    c = np.frombuffer(f" {letters} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    two = c[:-1] * np.uint32(0x9E3779B1) ^ c[1:] * np.uint32(0x85EBCA6B)
    three = two[:-1] * np.uint32(0xC2B2AE35) ^ c[2:] * np.uint32(0x27D4EB2F)
    one = c[c != 32] * np.uint32(0x165667B1)
    mixed = np.concatenate([one, two, three])
    return ((mixed ^ mixed >> np.uint32(15)) * np.uint32(0x2C1B3C6D) >> np.uint32(17)).astype(np.int64)


def codewords(n: int) -> np.ndarray:
    """n codewords of +1 and -1, one column a bit: all two-way splits up to six languages, else seeded random ones.

    With all splits (2^(n-1) - 1 bits) any two codewords differ in 2^(n-2) bits. Beyond, of 64 seeded codes of 10 log2 n bits
    the one with the largest least distance is taken.
    """
    if n == 1:
        return np.ones((1, 1))
    if n <= 6:
        sets = [s for k in range(1, n) for s in combinations(range(n), k) if 0 in s]
        return np.array([[1.0 if i in s else -1.0 for s in sets] for i in range(n)])
    rng, bits = np.random.default_rng(42), int(np.ceil(10 * np.log2(n)))
    codes = [rng.choice([-1.0, 1.0], (n, bits)) for _ in range(64)]
    codes = [c for c in codes if (np.abs(c.sum(axis=0)) < n).all()] or codes
    return max(codes, key=lambda c: min((c[i] != c[j]).sum() for i, j in combinations(range(n), 2)))


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # BUCKETS x bits: log-odds of each bit
    bit_weight: np.ndarray  # reliability of each bit
    scale: float

    def margins(self, buckets: np.ndarray) -> np.ndarray:
        return np.bincount(buckets, minlength=BUCKETS).astype(np.float32) @ self.weights / len(buckets)

    def decode(self, margins: np.ndarray, length: int) -> tuple[str, float, bool]:
        """Language, its probability among the codewords, and whether the nearest two are about as far."""
        loss = (self.bit_weight * np.logaddexp(0, -self.scale * min(length, SUREST_LENGTH) ** 0.5 * margins * self.code)).sum(axis=1)
        p = np.exp(loss.min() - loss)
        p /= p.sum()
        order = np.argsort(-p, kind="stable")
        gap = p[order[0]] - (p[order[1]] if len(p) > 1 else 0.0)
        return self.languages[order[0]], float(p[order[0]]), bool(gap < AMBIGUOUS_GAP)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        buckets = ngram_buckets(text)
        if not len(buckets) or not self.languages:
            return UNDETERMINED, 0.0, False
        return self.decode(self.margins(buckets), len(buckets))


def _sample(labelled: DataFrame, per_language: int) -> DataFrame:
    """About per_language rows of each language, by a hash of (id, lang).

    The rows of each language are counted over the labels alone; the driver holds one number for each language.
    """
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().toLocalIterator()}
    if not counts:
        return labelled.select("text", "lang")
    share = F.element_at(F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, float(per_language) / n)]), F.col("lang"))
    draw = F.pmod(F.xxhash64("id", "lang", F.lit(1)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return labelled.where(draw < share).select("text", "lang")


def fit(labelled: DataFrame, sample_per_language: int = SAMPLE_PER_LANGUAGE) -> LanguageModel:
    """A model from labelled(id, text, lang); rows with a null text or lang are left out."""
    labelled = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    sample = _sample(labelled, sample_per_language).repartition(SAMPLE_TASKS)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Per language the n-gram counts of one task; each text weighs as much as any other."""
        sums: dict[str, np.ndarray] = {}
        texts: dict[str, int] = {}
        for batch in batches:
            for text, lang in zip(batch["text"], batch["lang"]):
                buckets = ngram_buckets(text)
                if len(buckets):
                    own = sums.setdefault(lang, np.zeros(BUCKETS))
                    own += np.bincount(buckets, minlength=BUCKETS) / len(buckets)
                    texts[lang] = texts.get(lang, 0) + 1
        if sums:
            yield pd.DataFrame({"lang": list(sums), "texts": [texts[k] for k in sums], "counts": [v.astype("<f4").tobytes() for v in sums.values()]})

    total: dict[str, np.ndarray] = {}
    texts: dict[str, int] = {}
    for row in sample.mapInPandas(count, "lang string, texts long, counts binary").toLocalIterator():
        total[row.lang] = total.get(row.lang, 0) + np.frombuffer(row.counts, dtype="<f4").astype(np.float64)
        texts[row.lang] = texts.get(row.lang, 0) + row.texts
    languages = sorted(total)
    code = codewords(len(languages)) if languages else np.zeros((0, 0))
    if len(languages) < 2:
        bits = code.shape[1] if languages else 0
        return LanguageModel(languages, code, np.zeros((BUCKETS, bits), dtype=np.float32), np.ones(bits), 1.0)
    freq = np.array([total[k] / texts[k] for k in languages])  # mean relative frequency of each bucket in each language
    smooth = 1e-6
    weights = np.stack([np.log(freq[side > 0].mean(axis=0) + smooth) - np.log(freq[side < 0].mean(axis=0) + smooth) for side in code.T], axis=1)
    # A bit is centred between the languages nearest to its border, and weighs as much as it keeps them apart.
    expected = freq @ weights
    positive, negative = np.where(code > 0, expected, np.inf).min(axis=0), np.where(code < 0, expected, -np.inf).max(axis=0)
    weights -= (positive + negative) / 2  # a text's frequencies add up to one
    apart = np.maximum(positive - negative, 1e-6)
    return LanguageModel(languages, code, weights.astype(np.float32), apart / apart.sum(), 4.0 / float(apart.mean()))


def predict_languages(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """docs with lang_pred, score and ambiguous."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.predict(t) for t in texts], columns=["lang_pred", "score", "ambiguous"])

    found = with_fresh(docs, {"__language": predict(F.col(text))})
    return with_fresh(found, {k: F.col(f"__language.{k}") for k in ("lang_pred", "score", "ambiguous")}).drop("__language")


def held_out(doc_id: Column) -> Column:
    """Documents that no model may learn from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def fit_on_documents(docs: DataFrame, sample_per_language: int = SAMPLE_PER_LANGUAGE) -> LanguageModel:
    """A model from the documents that are not held out."""
    learn = docs.where(~held_out(F.col("doc_id")))
    return fit(learn.select(F.col("doc_id").alias("id"), "text", "lang"), sample_per_language)


def keep_identified(docs: DataFrame, model: LanguageModel, least_score: float = 0.4) -> DataFrame:
    """docs without those of no language: no letters, or an ambiguous prediction below least_score. Columns stay as they are."""
    marked = docs.withColumn("__row", F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    found = predict_languages(marked.select("__row", F.col("text")), model)
    rejected = (F.col("lang_pred") == UNDETERMINED) | (F.col("ambiguous") & (F.col("score") < least_score))
    return found.where(~rejected).select("__row.*")

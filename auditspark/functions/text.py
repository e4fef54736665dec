"""Text functions as Columns."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases of advertisements, and the punctuation that ends a sentence.
AD_ANYWHERE = "恭喜您解锁新章节"
AD_IF_SHORT = "听作者好课"
AD_STARTS = ("（STEP1）听作者好课", "免费（STEP1）听作者好课")
SENTENCE_ENDS = "。！？；"
CHAPTER = r"^(?:第[一二三四五六七八九十百千\d]+章|附录)"
SECTION = r"^第[一二三四五六七八九十百千\d]+节"
SUBSECTION = r"^[一二三四五六七八九十]+[、．.]"
SUBSUBSECTION = r"^（[一二三四五六七八九十百千\d]+）"


def keywords(text: Column, most: int = 10) -> Column:
    """Distinct words of two or more letters or digits, the first `most` in order of the text."""
    return F.slice(F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[\p{L}\p{N}]{2,}"), 0)), 1, most)


def coverage(content: Column, words: list[str]) -> Column:
    """The share of the words that content holds, case and all."""
    hits = sum((F.contains(content, F.lit(w)).cast("int") for w in words), F.lit(0))
    return hits / F.lit(float(max(1, len(words))))


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the lower-cased words, each padded with two spaces before and one behind."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), 0)
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    grams = F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substr(w, i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams of both; 0 if neither has any."""
    both = F.size(F.array_union(trigrams(a), trigrams(b)))
    return F.when(both == 0, 0.0).otherwise(F.size(F.array_intersect(trigrams(a), trigrams(b))) / both)


def char_overlap(a: Column, b: Column) -> Column:
    """Shared distinct characters over those of the larger set."""
    chars = lambda s: F.array_distinct(F.regexp_extract_all(s, F.lit("(?s)."), 0))
    return F.size(F.array_intersect(chars(a), chars(b))) / F.greatest(F.size(chars(a)), F.size(chars(b)), F.lit(1))


def sanitize_filename(name: Column) -> Column:
    return F.regexp_replace(name, r'[\\/:*?"<>|]', "_")


def image_placeholder(markdown: Column) -> Column:
    """![alt](path) as 【图片：alt】, or with the file's stem where alt is blank or "image"."""
    stem = r"!\[\s*(?:image)?\s*\]\((?:[^)\s]*/)?([^)/\s]*?)(?:\.[A-Za-z0-9]+)?\)"
    return F.regexp_replace(F.regexp_replace(markdown, stem, "【图片：$1】"), r"!\[([^\]]+)\]\([^)]*\)", "【图片：$1】")


def clean_text(text: Column) -> Column:
    """Without image placeholders and display formulas; three or more line ends become two."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "【图片：[^】]*】", ""), r"(?s)\$\$.*?\$\$", ""), r"\n{3,}", "\n\n")


def is_garbage(text: Column) -> Column:
    """Advertisements, and texts with no or hardly any Chinese characters."""
    n, chinese = F.length(text), F.regexp_count(text, F.lit("[一-鿿]"))
    short = n < 150
    return (
        F.contains(text, F.lit(AD_ANYWHERE)) | (F.contains(text, F.lit(AD_IF_SHORT)) & short) | text.startswith(AD_STARTS[0]) | text.startswith(AD_STARTS[1])
        | (F.contains(text, F.lit("STEP")) & short) | ((n > 0) & (chinese == 0) & (n < 100)) | ((n >= 20) & (chinese / F.greatest(n, F.lit(1)) < 0.1))
    )


def sentences(text: Column, ends: str = SENTENCE_ENDS) -> Column:
    return F.filter(F.split(text, f"(?<=[{ends}])"), lambda s: s != "")


def summary(text: Column, ends: str = "。！？", enough: int = 80, most: int = 150, least: int = 5) -> Column:
    """Sentences of at least `least` characters until `enough` are gathered, at most `most`; else the text's beginning. Line ends
    count as spaces."""
    text = F.trim(F.translate(text, "\n", " "))
    usable = F.filter(F.transform(sentences(text, ends), lambda s: F.trim(s)), lambda s: F.length(s) >= least)
    gathered = F.aggregate(usable, F.lit(""), lambda acc, s: F.when(F.length(acc) >= enough, acc).otherwise(F.concat(acc, s)))
    return F.when(F.length(gathered) > 0, F.left(gathered, F.lit(most))).otherwise(F.left(text, F.lit(enough)))


def brief(text: Column, most: int = 80) -> Column:
    return F.left(F.regexp_replace(text, r"\s+", ""), F.lit(most))


def strip_fences(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"(?s)^\s*```[A-Za-z]*\s*", ""), r"\s*```\s*$", ""))


def greedy_object(text: Column) -> Column:
    """From the first { to the last }; null without."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


def first_object(text: Column) -> Column:
    """The first balanced JSON object, with single quotes turned to double ones if it does not parse otherwise; null without."""

    @F.pandas_udf("string")
    def find(texts: pd.Series) -> pd.Series:
        decoder = json.JSONDecoder()

        def one(s: str | None) -> str | None:
            for candidate in (s or "", (s or "").replace("'", '"')):
                at = candidate.find("{")
                while at >= 0:
                    try:
                        return candidate[at : decoder.raw_decode(candidate, at)[1]]
                    except json.JSONDecodeError:
                        at = candidate.find("{", at + 1)
            return None

        return texts.map(one)

    return find(text)


def source_label(course: Column, book: Column, heading: Column, source_id: Column) -> Column:
    """course > book > heading without the blank ones; the source's number if all are blank."""
    label = F.concat_ws(" > ", *[F.nullif(c, F.lit("")) for c in (course, book, heading)])
    return F.when(label == "", F.concat(F.lit("教材 #"), source_id.cast("string"))).otherwise(label)


def field_type(name: Column) -> Column:
    return F.when(name.rlike("amount|price|total|sum|fee|tax|salary|cost"), "amount").when(name.rlike("date|time|period"), "date").otherwise("text")


def heading_rank(text: Column) -> Column:
    """1 to 4 for chapter, section, subsection and below; null for body text."""
    return F.when(text.rlike(CHAPTER), 1).when(text.rlike(SECTION), 2).when(text.rlike(SUBSECTION), 3).when(text.rlike(SUBSUBSECTION), 4)


def bar(percent: Column) -> Column:
    return F.repeat(F.lit("█"), F.floor(percent / 5).cast("int"))


def qa_text(question: Column, answer: Column, most: int = 500) -> Column:
    """What is embedded of a question and its answer."""
    return F.concat(F.lit("问题："), question, F.lit("\n答案："), F.left(answer, F.lit(most)))


def knowledge_text(topic: Column, summary: Column, content: Column) -> Column:
    """What is embedded of archived knowledge."""
    return F.concat(F.lit("知识点："), topic, F.lit("\n摘要："), summary, F.lit("\n内容："), content)


def money(amount: Column, sign: str = "¥") -> Column:
    """An amount with thousands separators and two decimals."""
    return F.concat(F.lit(sign), F.format_number(amount, 2))


def account_number(digits: Column) -> Column:
    """Digits in groups of four."""
    return F.trim(F.regexp_replace(digits, "([0-9]{4})", "$1 "))


def percent(share: Column) -> Column:
    return F.concat(F.format_number(share * 100, 0), F.lit("%"))


def tolerant_map(text: Column) -> Column:
    """A JSON object as a map of strings; empty if it is missing or does not parse."""
    return F.coalesce(F.from_json(text, "map<string,string>"), F.create_map().cast("map<string,string>"))


def append_unique(values: Column, more: Column, kind: str = "string") -> Column:
    """Both arrays, each value once; a missing one is empty."""
    none = F.array().cast(f"array<{kind}>")
    return F.array_union(F.coalesce(values, none), F.coalesce(more, none))

"""Model-backed steps behind providers: a provider works on a batch of strings inside a task. The stubs are deterministic."""

from __future__ import annotations

import json
import time
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import qa_text

Provider = Callable[[list[str]], list]


def hashed_embedding(width: int = 64) -> Provider:
    """A stub: signed hashes of character trigrams, as a unit vector."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = np.zeros(width)
            for i in range(max(1, len(t) - 2)):
                h = zlib.crc32(t[i : i + 3].encode("utf-8", "surrogatepass"))
                v[h % width] += 1 if h >> 31 else -1
            out.append([float(x) for x in v / (np.linalg.norm(v) or 1.0)])
        return out

    return embed


def echo_llm(answer: dict | None = None) -> Provider:
    """A stub that answers every prompt with the same object, or with the prompt's length."""
    return lambda prompts: [json.dumps(answer if answer is not None else {"n_chars": len(p)}, ensure_ascii=False) for p in prompts]


def with_retries(provider: Provider, attempts: int = 3, wait: float = 0.0, repair: Callable[[str], str] | None = None) -> Provider:
    """provider again on what it fails on, up to `attempts` times with the prompt repaired; then null."""

    def call(texts: list[str]) -> list:
        out: list = []
        for text in texts:
            result = None
            for i in range(attempts):
                try:
                    result = provider([text])[0]
                    break
                except Exception:  # noqa: BLE001 - whatever a provider raises is a failed attempt
                    time.sleep(wait * 2**i)
                    text = repair(text) if repair else text
            out.append(result)
        return out

    return call


def provided(column: Column, provider: Provider, kind: str) -> Column:
    """The provider's answers as a column of type `kind`; nulls are not asked about."""

    @F.pandas_udf(kind)
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            there = batch.notna()
            answers = iter(provider(batch[there].tolist()))
            yield pd.Series([next(answers) if ok else None for ok in there], dtype=object)

    return ask(column)


def embedded(rows: DataFrame, text: str, provider: Provider) -> DataFrame:
    return rows.withColumn("embedding", provided(F.col(text), provider, "array<double>"))


def extracted_knowledge(answers: DataFrame, provider: Provider) -> DataFrame:
    """id, topic, content, summary, category of answers(id, question, answer) of at least 50 characters, by a model that
    answers with a JSON array; blank contents are skipped and texts are cut to what the table holds."""
    shape = "array<struct<topic:string,content:string,summary:string,category:string>>"
    prompt = qa_text(F.col("question"), F.col("answer"))
    found = answers.where(F.length("answer") >= 50).select("id", F.explode(F.from_json(provided(prompt, provider, "string"), shape)).alias("k"))
    cut = lambda c, n: F.left(F.col(f"k.{c}"), F.lit(n)).alias(c)
    return found.where(F.trim("k.content") != "").select("id", cut("topic", 200), F.col("k.content").alias("content"), cut("summary", 500), cut("category", 50))

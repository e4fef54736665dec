"""The corpus pipeline: each stage works on what its predecessor kept, which is written as Parquet and read again.

Stages take (spark, docs, sf_dir) and return a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditspark.llm.cgk_decontam import drop_contaminated
from auditspark.llm.common import materialize, table
from auditspark.llm.lang_ecoc import fit_on_documents, keep_identified
from auditspark.llm.near_dedup import drop_near_copies
from auditspark.llm.pii_feistel import configured_key, pseudonymize
from auditspark.llm.sp_chunks import encode_and_decode

#: Rows of an Arrow batch: of Spark's 10,000 texts, some of them long, each task would hold several copies at once.
BATCH_ROWS = 2_000


def _small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters go, and those whose language stays open between several."""
    _small_batches(spark)
    return keep_identified(docs, fit_on_documents(docs))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of copies that share 0.8 or more of their five-word shingles, the document of the least doc_id stays: SimHash groups first,
    then an exact search for the rest."""
    _small_batches(spark)
    return drop_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, exactly or nearly, go."""
    _small_batches(spark)
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to pseudonyms; n_chars follows the text."""
    _small_batches(spark)
    out = pseudonymize(docs, configured_key(spark), any_plan=True)
    return out.select(*[F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and digests of the ids and of the text that they decode to."""
    _small_batches(spark)
    return encode_and_decode(docs.select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model")).drop("text")


STAGES = [("language_id", language_id), ("simhash_dedup", simhash_dedup), ("decontaminate", decontaminate), ("pii", pii), ("sentencepiece", sentencepiece)]

#: SQL has none of n-gram classifiers, SimHash, CGK embedding, Feistel networks and SentencePiece; tests/llm/test_llm_queries.py holds
#: each stage, and run(), against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

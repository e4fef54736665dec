"""Logical views of the library's data model over the test tables, and the same views as SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CATEGORIES = ("STANDARD", "PROMO", "ECONOMY", "MEDIUM", "SMALL", "LARGE")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def four_digits(file: Column) -> Column:
    """The name of a numbered file as the SQL beside its query shows it, whose lpad leaves four digits of a longer number. The files
    themselves keep the whole number, so no two have one name."""
    return F.regexp_replace(file, r"^(\d{4})\d*_", "$1_")


def audit_results(spark: SparkSession, d: str) -> DataFrame:
    level = F.left("o_orderpriority", F.lit(1))
    risk = F.when(level.isin("1", "2"), "高风险").when(level == "3", "中风险").otherwise("低风险")
    conclusion = F.when(F.col("o_orderstatus") == "F", "通过").when(F.col("o_orderstatus") == "O", "不通过").otherwise("人工复核")
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.select(F.col("o_orderkey").alias("id"), F.col("c_mktsegment").alias("image_type"), F.col("o_orderdate").cast("date").alias("date"), F.col("o_totalprice").alias("total_amount"), F.col("c_name").alias("relevant_party"), risk.alias("risk_rating"), conclusion.alias("audit_conclusion"))


AUDIT = """audit AS (SELECT o_orderkey AS id, c_mktsegment AS image_type, o_orderdate::DATE AS date, o_totalprice AS total_amount, c_name AS relevant_party,
  CASE WHEN left(o_orderpriority, 1) IN ('1', '2') THEN '高风险' WHEN left(o_orderpriority, 1) = '3' THEN '中风险' ELSE '低风险' END AS risk_rating,
  CASE o_orderstatus WHEN 'F' THEN '通过' WHEN 'O' THEN '不通过' ELSE '人工复核' END AS audit_conclusion
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def extracts(spark: SparkSession, d: str, categories: tuple[str, ...] = CATEGORIES) -> DataFrame:
    """The typed extracts of all categories: one table with the category as a column, so one scan and one join."""
    kinds = table(spark, d, "part").where(F.col("p_type").isin(*categories))
    rows = table(spark, d, "lineitem").join(kinds, F.col("l_partkey") == F.col("p_partkey"))
    return rows.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_shipdate").cast("date").alias("f_date"), F.when(F.col("l_quantity") > 1, F.col("l_extendedprice")).alias("f_amount"), F.col("p_name").alias("f_party"), F.col("l_returnflag").alias("risk"), F.col("p_type").alias("category"))


EXTRACTS = "extracts AS (" + " UNION ALL ".join(
    f"SELECT l_orderkey * 10 + l_linenumber AS id, l_shipdate::DATE AS f_date, CASE WHEN l_quantity > 1 THEN l_extendedprice END AS f_amount, p_name AS f_party, l_returnflag AS risk, '{c}' AS category FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_type = '{c}'" for c in CATEGORIES
) + ")"


def classify_results(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("l_id"), "quality", "toxic")
    rows = table(spark, d, "documents").select("doc_id", "source").join(labels, F.col("doc_id") == F.col("l_id"), "left")
    return rows.select("doc_id", "source", (F.col("doc_id") % 4).alias("batch"), (F.col("quality") == 1 - F.col("toxic")).alias("is_correct"))


CLASSIFY = "classified AS (SELECT d.doc_id, d.source, d.doc_id % 4 AS batch, quality = 1 - toxic AS is_correct FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"


def chunks(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("e_id"), "embedding", "label")
    docs = table(spark, d, "documents")
    return docs.join(vectors, F.col("doc_id") == F.col("e_id"), "left").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.col("doc_id").alias("source_id"), F.col("lang").alias("course"), F.col("source").alias("book"), "embedding", "label")


CHUNKS = "chunks AS (SELECT doc_id AS id, text AS content, doc_id AS source_id, lang AS course, source AS book, embedding::DOUBLE[] AS embedding, label FROM documents LEFT JOIN embeddings ON doc_id = vec_id)"


def entities(spark: SparkSession, d: str) -> DataFrame:
    """Regions from 1000000, nations from 2000000, suppliers from 3000000, customers from 4000000 on."""
    kinds = (("region", "r_regionkey", "r_name", 1), ("nation", "n_nationkey", "n_name", 2), ("supplier", "s_suppkey", "s_name", 3), ("customer", "c_custkey", "c_name", 4))
    return reduce(DataFrame.union, [table(spark, d, t).select((F.col(k).cast("long") + n * 1000000).alias("id"), F.col(v).alias("name"), F.lit(t).alias("entity_type")) for t, k, v, n in kinds])


def edges(spark: SparkSession, d: str) -> DataFrame:
    kinds = (("nation", "n_nationkey", "n_regionkey", 2, 1), ("supplier", "s_suppkey", "s_nationkey", 3, 2), ("customer", "c_custkey", "c_nationkey", 4, 2))
    return reduce(DataFrame.union, [table(spark, d, t).select((F.col(a).cast("long") + x * 1000000).alias("src"), (F.col(b).cast("long") + y * 1000000).alias("dst"), F.lit("belongs_to").alias("type")) for t, a, b, x, y in kinds])


GRAPH = """entities AS (SELECT r_regionkey::BIGINT + 1000000 AS id, r_name AS name, 'region' AS entity_type FROM region UNION ALL SELECT n_nationkey::BIGINT + 2000000, n_name, 'nation' FROM nation
  UNION ALL SELECT s_suppkey + 3000000, s_name, 'supplier' FROM supplier UNION ALL SELECT c_custkey + 4000000, c_name, 'customer' FROM customer),
edges AS (SELECT n_nationkey::BIGINT + 2000000 AS src, n_regionkey::BIGINT + 1000000 AS dst, 'belongs_to' AS type FROM nation
  UNION ALL SELECT s_suppkey + 3000000, s_nationkey::BIGINT + 2000000, 'belongs_to' FROM supplier UNION ALL SELECT c_custkey + 4000000, c_nationkey::BIGINT + 2000000, 'belongs_to' FROM customer)"""


def qa_history(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    q = c.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("question"))
    a = c.where(F.col("role") == "assistant").select(F.col("conv_id").alias("a_conv"), F.col("turn").alias("a_turn"), F.col("text").alias("answer"))
    return q.join(a, (F.col("conv_id") == F.col("a_conv")) & (F.col("turn") + 1 == F.col("a_turn"))).select("conv_id", "turn", "question", "answer")


QA = "qa AS (SELECT q.conv_id, q.turn, q.text AS question, a.text AS answer FROM conversations q JOIN conversations a ON q.conv_id = a.conv_id AND q.turn + 1 = a.turn WHERE q.role = 'user' AND a.role = 'assistant')"


def dream(spark: SparkSession, d: str) -> DataFrame:
    """Archived knowledge: vectors with a category and a confidence of the text's length."""
    c = chunks(spark, d).where(F.col("embedding").isNotNull())
    confidence = F.round(F.lit(0.3) + F.when(F.length("content") > 150, 0.2).otherwise(0.0) + F.when(F.length("content") > 2000, 0.4).otherwise(0.0), 2)
    return c.select("id", F.col("label").cast("string").alias("category"), confidence.alias("confidence"), "embedding")


DREAM = CHUNKS + """,
dream AS (SELECT id, label::VARCHAR AS category, round(0.3::DOUBLE + CASE WHEN length(content) > 150 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN length(content) > 2000 THEN 0.4::DOUBLE ELSE 0 END, 2) AS confidence, embedding FROM chunks WHERE embedding IS NOT NULL)"""

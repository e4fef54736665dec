"""Files as DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pixels import measured
from ..functions.text import money
from ..operators.graph import arrow_rows, cut
from ..operators.quality import normalized_extension

#: Files that Python holds at a time in a task, whole.
FILES_AT_ONCE = 64
IMAGE_EXTENSIONS = ("png", "jpg", "jpeg", "webp", "gif")
CONTENT_ITEM = "array<struct<type:string,text:string,text_level:int,page_idx:int>>"
RULE_BASE = "struct<version:string,categories:array<struct<category:string,rules:array<struct<id:string,name:string,content:string,risk_level:string>>>>>"


def book_files(files: DataFrame, books: DataFrame) -> DataFrame:
    """book, path, kind of the file to read for each of books(book) among files(path).

    The content list of the book's name, else of the name without spaces, else Markdown (without images first); null if there
    is none.
    """
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"(_content_list\.json|_noimg\.md|\.md)$", "")
    kind = F.when(F.col("path").endswith("_content_list.json"), "json").when(F.col("path").endswith(".md"), "md")
    known = files.select("path", name.alias("name"), kind.alias("kind")).where("kind IS NOT NULL")
    wanted = books.select("book", F.explode(F.array_distinct(F.array("book", F.replace("book", F.lit(" "), F.lit(""))))).alias("name"))
    spelled = F.when(F.col("name") == F.col("book"), 0).otherwise(1)
    rank = F.struct((F.col("kind") == "md").alias("md"), spelled.alias("spelled"), (~F.col("path").endswith("_noimg.md")).alias("images"), "path", "kind")
    best = wanted.join(known, "name").groupBy("book").agg(F.min(rank).alias("best"))
    return books.select(F.col("book").alias("b")).join(best, F.col("b") == F.col("book"), "left").select(F.col("b").alias("book"), "best.path", "best.kind")


def markdown(spark: SparkSession, path: str, pattern: str = "*.md") -> DataFrame:
    """id, text of whole Markdown files; where a folder's file has a twin ending in _noimg.md, the twin alone."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path, wholetext=True)
    named = files.select(F.input_file_name().alias("path"), F.col("value").alias("text")).withColumn("stem", F.regexp_replace("path", r"(_noimg)?\.md$", ""))
    best = named.groupBy("stem").agg(F.max_by("path", F.col("path").endswith("_noimg.md").cast("int")).alias("path"))
    return named.join(best.select("path"), "path", "left_semi").select(F.col("path").alias("id"), "text")


def content_list(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """id, no, type, text, text_level, page_idx of files that hold a JSON array of items."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path, wholetext=True)
    rows = files.select(F.input_file_name().alias("id"), F.posexplode(F.from_json("value", CONTENT_ITEM)).alias("no", "item"))
    return rows.select("id", "no", "item.*")


def rule_base(spark: SparkSession, path: str) -> DataFrame:
    """category, id, name, content, risk_level of a nested rule base."""
    base = spark.read.text(path, wholetext=True).select(F.from_json("value", RULE_BASE).alias("x"))
    rules = base.select(F.explode("x.categories").alias("c")).select("c.category", F.explode("c.rules").alias("r"))
    return rules.select("category", "r.*")


def images(spark: SparkSession, path: str, known_md5: DataFrame | None = None, least_kb: int = 10, most_mb: int = 20) -> DataFrame:
    """path, category (its folder), name, extension, size, md5 of image files within the size window, sorted by nothing.

    Files whose content is in known_md5(md5) already are left out.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return image_rows(files.select("path", F.col("length").alias("size"), F.md5("content").alias("md5")), known_md5, least_kb, most_mb)


def image_rows(files: DataFrame, known_md5: DataFrame | None = None, least_kb: int = 10, most_mb: int = 20) -> DataFrame:
    """images() of files(path, size, md5)."""
    kept = files.where(F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).isin(*IMAGE_EXTENSIONS) & F.col("size").between(least_kb << 10, most_mb << 20))
    part = lambda i: F.element_at(F.split("path", "/"), i)
    rows = kept.select("path", part(-2).alias("category"), part(-1).alias("name"), normalized_extension(F.col("path")).alias("extension"), "size", "md5")
    return rows if known_md5 is None else rows.join(known_md5.select(F.col("md5").alias("k")), F.col("md5") == F.col("k"), "left_anti")


def measured_images(spark: SparkSession, path: str) -> DataFrame:
    """path, name, size (bytes), width, height, variance, hash of image files below path, decoded in the tasks.

    One that cannot be decoded has neither sides nor measures. Of empty files there are no rows: Spark passes over them.
    """
    read = spark.read.format("image").option("recursiveFileLookup", True).load(path)
    side = lambda c: F.when(F.col(f"image.{c}") > 0, F.col(f"image.{c}")).alias(c)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    rows = read.select(F.col("_metadata.file_path").alias("path"), name.alias("name"), F.col("_metadata.file_size").alias("size"), side("width"), side("height"), measured(F.col("image")).alias("m"))
    with arrow_rows(spark, FILES_AT_ONCE):  # pixels are many times the size of a row of measures, which are written here
        return cut(rows.select("path", "name", "size", "width", "height", "m.variance", "m.hash"))


def jsonl(spark: SparkSession, path: str) -> DataFrame:
    """line, value (variant), ok: lines that do not parse are kept and marked."""
    parsed = spark.read.text(path).withColumn("v", F.try_parse_json("value"))
    return parsed.select(F.col("value").alias("line"), F.col("v").alias("value"), F.col("v").isNotNull().alias("ok"))


def fan_in(tables: dict[str, DataFrame], tag: str = "category") -> DataFrame:
    """Tables of one shape as one, with the name of each."""
    return reduce(DataFrame.unionByName, [t.withColumn(tag, F.lit(name)) for name, t in tables.items()])


def columns_of(spark: SparkSession, database: str = "default") -> DataFrame:
    """table, column, type of every table of a database of the catalog."""
    rows = [(t.name, c.name, c.dataType) for t in spark.catalog.listTables(database) for c in spark.catalog.listColumns(t.name if t.isTemporary else f"{database}.{t.name}")]
    return spark.createDataFrame(rows, "table string, column string, type string")


def synthetic_vouchers(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """n vouchers with the mix of risks 70, 20 and 10 in a hundred, and conclusions that follow the risk."""
    draw = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(100))
    risk = F.when(draw < 70, "低风险").when(draw < 90, "中风险").otherwise("高风险")
    amount = F.round(F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(10_000_000)) / 100, 2)
    date = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.xxhash64("id", F.lit(seed + 2)), F.lit(366)).cast("int"))
    conclusion = F.when(risk == "高风险", "不通过").when(risk == "中风险", "人工复核").otherwise("通过")
    return spark.range(n).select("id", risk.alias("risk_rating"), amount.alias("total_amount"), date.alias("date"), conclusion.alias("audit_conclusion"))


def captions(vouchers: DataFrame) -> DataFrame:
    """id, question, answer: what a model is taught to say about each of vouchers(id, image_type, risk_rating, total_amount)."""
    told = F.concat(F.lit("这是一张"), "image_type", F.lit("，金额"), money(F.col("total_amount")), F.lit("，风险等级为"), "risk_rating", F.lit("。"))
    return vouchers.select("id", F.lit("请识别这张票据的类型、金额和风险。").alias("question"), told.alias("answer"))

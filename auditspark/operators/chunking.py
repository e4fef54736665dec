"""Chunking of documents: one row in, many rows out."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_text, heading_rank, is_garbage, sentences

#: Documents whose pieces Python holds at a time in a task.
DOCS_AT_ONCE = 200


def fixed_chunks(docs: DataFrame, size: int = 600, overlap: int = 100) -> DataFrame:
    """id, chunk_no, chunk: pieces of `size` characters, each but the first with the `overlap` before it; blank ones go."""
    starts = F.sequence(F.lit(0), F.greatest(F.length("text") - 1, F.lit(0)), F.lit(size))
    piece = F.transform(starts, lambda s: F.when(s == 0, F.substr("text", F.lit(1), F.lit(size))).otherwise(F.substr("text", s - overlap + 1, F.lit(size + overlap))))
    rows = docs.where(F.col("text").isNotNull()).select("id", F.posexplode(piece).alias("chunk_no", "chunk"))
    return rows.select("id", "chunk_no", F.trim("chunk").alias("chunk")).where(F.col("chunk") != "")


def markdown_sections(docs: DataFrame, least: int = 50) -> DataFrame:
    """id, chapter, section, body: the lines below each heading, cleaned; sections of fewer characters go.

    Lines are numbered by posexplode; headings are carried down by windows within a document.
    """
    lines = docs.select("id", F.posexplode(F.split("text", "\n")).alias("no", "line")).withColumn("line", F.trim("line")).where(F.col("line") != "")
    down = Window.partitionBy("id").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    chapter = F.when(F.col("line").rlike(r"^#\s*第[一二三四五六七八九十百千\d]+章"), F.regexp_replace("line", r"^#+\s*", ""))
    section = F.when(F.col("line").rlike(r"^##+\s*\S"), F.regexp_replace("line", r"^#+\s*", ""))
    marked = lines.withColumn("is_chapter", chapter).withColumn("is_section", section).withColumn("chapter", F.last("is_chapter", True).over(down))
    in_chapter = Window.partitionBy("id", "chapter").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    marked = marked.withColumn("section", F.last("is_section", True).over(in_chapter)).withColumn("part", F.count(F.coalesce("is_chapter", "is_section")).over(down))
    body = marked.where(F.col("is_chapter").isNull() & F.col("is_section").isNull())
    joined = body.groupBy("id", "part").agg(F.max("chapter").alias("chapter"), F.max("section").alias("section"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "line"))), lambda x: x["line"]), "\n").alias("body"))
    return joined.select("id", "part", "chapter", "section", F.trim(clean_text(F.col("body"))).alias("body")).where(F.length("body") >= least)


def content_sections(items: DataFrame, least: int = 50) -> DataFrame:
    """id, chapter, section, subsection, page_start, has_table, has_equation, body from items(id, no, type, text, page_idx)."""
    items = items.withColumn("text", F.trim(F.coalesce("text", F.lit(""))))
    rank = F.when(F.col("type") == "text", heading_rank(F.col("text")))
    title = F.regexp_replace("text", r"\s*\d+$", "")
    down = Window.partitionBy("id").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    rows = items.withColumn("rank", rank).withColumn("chapter", F.last(F.when(F.col("rank") == 1, title), True).over(down)).withColumn("c", F.count(F.when(F.col("rank") == 1, 1)).over(down))
    down = Window.partitionBy("id", "c").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("section", F.last(F.when(F.col("rank") == 2, title), True).over(down)).withColumn("s", F.count(F.when(F.col("rank") == 2, 1)).over(down))
    down = Window.partitionBy("id", "c", "s").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("subsection", F.last(F.when(F.col("rank") == 3, F.left(title, F.lit(60))), True).over(down)).withColumn("u", F.count(F.when(F.col("rank") == 3, 1)).over(down))
    body = rows.where(F.col("rank").isNull() | (F.col("rank") == 4)).groupBy("id", "c", "s", "u").agg(
        F.max("chapter").alias("chapter"), F.max("section").alias("section"), F.max("subsection").alias("subsection"), F.min("page_idx").alias("page_start"),
        F.max(F.col("type") == "table").alias("has_table"), F.max(F.col("type") == "equation").alias("has_equation"),
        F.array_join(F.transform(F.filter(F.array_sort(F.collect_list(F.struct("no", "text"))), lambda x: x["text"] != ""), lambda x: x["text"]), "\n").alias("body"),
    )
    return body.drop("c", "s", "u").where(F.length("body") >= least)


def _merged(parts: list[str], least: int, most: int) -> list[str]:
    """Neighbours joined while they fit; a short last piece goes to the one before it."""
    out: list[str] = []
    for p in parts:
        if out and len(out[-1]) + len(p) + 1 <= most:
            out[-1] = f"{out[-1]}\n{p}"
        else:
            out.append(p)
    if len(out) > 1 and len(out[-1]) < least:
        out[-2:] = [f"{out[-2]}\n{out[-1]}"]
    return out


def semantic_chunks(docs: DataFrame, least: int = 300, most: int = 700, keep: int = 50) -> DataFrame:
    """id, chunk_no, chunk: paragraphs merged up to `most` characters; longer paragraphs are packed from their sentences.

    Splitting and filtering are Columns; the merge, which depends on what was merged before, is a short Arrow UDF.
    """
    paragraphs = F.filter(F.transform(F.split("text", r"\n\s*\n"), lambda p: F.trim(p)), lambda p: F.length(p) >= 10)
    pieces = F.flatten(F.transform(paragraphs, lambda p: F.when(F.length(p) <= most, F.array(p)).otherwise(sentences(p))))

    @F.arrow_udf("array<string>")
    def merged(batch: pa.Array) -> pa.Array:
        # A batch stays as Arrow holds it; of so many documents at a time the pieces are Python's.
        kind, done = pa.list_(pa.string()), []
        for i in range(0, len(batch), DOCS_AT_ONCE):
            done.append(pa.array([None if parts is None else _merged(parts, least, most) for parts in batch.slice(i, DOCS_AT_ONCE).to_pylist()], kind))
        return pa.concat_arrays(done) if done else pa.array([], kind)

    chunks = F.when(F.length("text") <= most, F.array(F.trim("text"))).otherwise(merged(pieces))
    rows = docs.where(F.col("text").isNotNull()).select("id", F.posexplode(chunks).alias("chunk_no", "chunk"))
    return rows.where((F.length("chunk") >= keep) & ~is_garbage(F.col("chunk")))


def rule_chunks(docs: DataFrame, least: int = 30) -> DataFrame:
    """rule_id, id, heading, risk, body of rule documents: a risk level holds until the next one is given."""
    lines = docs.select("id", F.posexplode(F.split("text", "\n")).alias("no", "line")).withColumn("line", F.trim("line")).where(F.col("line") != "")
    heading = F.when(F.col("line").rlike(r"^(?:[一二三四五六七八九十]+、|（[一二三四五六七八九十]+）|##)"), F.regexp_replace("line", r"^#+\s*", ""))
    risk = F.nullif(F.regexp_extract("line", "风险等级[：:]\\s*([高中低])风险", 1), F.lit(""))
    down = Window.partitionBy("id").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("h", heading).withColumn("r", risk)
    rows = rows.withColumn("heading", F.last("h", True).over(down)).withColumn("risk", F.last("r", True).over(down)).withColumn("part", F.count("h").over(down))
    body = rows.where(F.col("h").isNull() & F.col("r").isNull()).groupBy("id", "part").agg(
        F.max("heading").alias("heading"), F.max_by("risk", "no").alias("risk"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "line"))), lambda x: x["line"]), "\n").alias("body")
    )
    kept = body.where(F.length("body") >= least)
    number = F.row_number().over(Window.partitionBy("id").orderBy("part"))
    return kept.select(F.format_string("MD-%03d", number).alias("rule_id"), "id", "heading", F.coalesce("risk", F.lit("中")).alias("risk"), "body")

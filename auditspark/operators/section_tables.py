"""Sections of documents by a table function: the same rows as chunking's, from one walk down each document.

Lines of a document come together, in order, in one exchange; a state machine carries chapter, section and subsection down and tells
each section when the next heading comes, so it holds no more than one. What is a heading, its title and its level are worked out
before, as Columns.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import Row

from ..functions.text import clean_text, heading_rank

TOLD = "id long, part int, chapter string, section string, subsection string, mark string, page_start int, has_table boolean, has_equation boolean, body string"
COLUMNS = ("id", "no", "level", "title", "mark", "text", "page", "is_table", "is_equation")


class Sections:
    """Rows of COLUMNS, in order: a level (1, 2, 3) makes a heading, a mark holds until the next one, a text is part of the body."""

    def __init__(self):
        self.id, self.part, self.mark = None, 0, None
        self.titles: list[str | None] = [None, None, None]
        self.lines: list[str] = []
        self.last_mark, self.page, self.flags, self.has_body = None, None, [False, False], False

    def _told(self) -> Iterator[tuple]:
        if self.has_body:
            yield (self.id, self.part, *self.titles, self.last_mark, self.page, *self.flags, "\n".join(self.lines))
        self.lines, self.page, self.flags, self.has_body = [], None, [False, False], False

    def eval(self, row: Row) -> Iterator[tuple]:
        self.id = row["id"]
        if row["mark"] is not None:
            self.mark = row["mark"]
        level = row["level"]
        if level is not None:
            yield from self._told()
            self.part += 1
            self.titles[level - 1 :] = [row["title"], *[None] * (3 - level)]
        elif row["text"] is not None:
            self.has_body, self.last_mark = True, self.mark
            if row["text"] != "":
                self.lines.append(row["text"])
            if row["page"] is not None:
                self.page = row["page"] if self.page is None else min(self.page, row["page"])
            self.flags = [self.flags[0] or bool(row["is_table"]), self.flags[1] or bool(row["is_equation"])]

    def terminate(self) -> Iterator[tuple]:
        yield from self._told()


def walked(rows: DataFrame) -> DataFrame:
    """TOLD of rows(id, no, ...) of which the other COLUMNS may be missing."""
    given = {c.lower() for c in rows.columns}
    kinds = {"level": "int", "page": "int", "is_table": "boolean", "is_equation": "boolean"}
    full = rows.select("id", "no", *[F.col(c).cast(kinds.get(c, "string")).alias(c) if c in given else F.lit(None).cast(kinds.get(c, "string")).alias(c) for c in COLUMNS[2:]])
    return F.udtf(Sections, returnType=TOLD)(full.asTable().partitionBy("id").orderBy("no"))


def _lines(docs: DataFrame) -> DataFrame:
    return docs.select("id", F.posexplode(F.split("text", "\n")).alias("no", "line")).withColumn("line", F.trim("line")).where(F.col("line") != "")


def markdown_sections(docs: DataFrame, least: int = 50) -> DataFrame:
    """id, part, chapter, section, body: as chunking.markdown_sections; a chapter that comes again begins without a section."""
    line = F.col("line")
    level = F.when(line.rlike(r"^#\s*第[一二三四五六七八九十百千\d]+章"), 1).when(line.rlike(r"^##+\s*\S"), 2)
    rows = _lines(docs).select("id", "no", level.alias("level"), F.when(level.isNotNull(), F.regexp_replace(line, r"^#+\s*", "")).alias("title"), F.when(level.isNull(), line).alias("text"))
    return walked(rows).select("id", "part", "chapter", "section", F.trim(clean_text(F.col("body"))).alias("body")).where(F.length("body") >= least)


def content_sections(items: DataFrame, least: int = 50) -> DataFrame:
    """id, chapter, section, subsection, page_start, has_table, has_equation, body: as chunking.content_sections."""
    text = F.trim(F.coalesce("text", F.lit("")))
    rank = F.when(F.col("type") == "text", heading_rank(text))
    title = F.regexp_replace(text, r"\s*\d+$", "")
    rows = items.select(
        "id", "no", F.when(rank <= 3, rank).alias("level"), F.when(rank == 3, F.left(title, F.lit(60))).when(rank <= 2, title).alias("title"), F.when(rank.isNull() | (rank == 4), text).alias("text"),
        F.col("page_idx").alias("page"), (F.col("type") == "table").alias("is_table"), (F.col("type") == "equation").alias("is_equation"),
    )
    return walked(rows).select("id", "chapter", "section", "subsection", "page_start", "has_table", "has_equation", "body").where(F.length("body") >= least)


def rule_chunks(docs: DataFrame, least: int = 30) -> DataFrame:
    """rule_id, id, heading, risk, body: as chunking.rule_chunks."""
    line = F.col("line")
    is_heading = line.rlike(r"^(?:[一二三四五六七八九十]+、|（[一二三四五六七八九十]+）|##)")
    risk = F.nullif(F.regexp_extract("line", "风险等级[：:]\\s*([高中低])风险", 1), F.lit(""))
    rows = _lines(docs).select("id", "no", F.when(is_heading, 1).alias("level"), F.when(is_heading, F.regexp_replace(line, r"^#+\s*", "")).alias("title"), risk.alias("mark"), F.when(~is_heading & risk.isNull(), line).alias("text"))
    kept = walked(rows).where(F.length("body") >= least)
    number = F.size(F.filter("all", lambda p: p <= F.col("part")))
    numbered = kept.join(kept.groupBy(F.col("id").alias("a_id")).agg(F.collect_list("part").alias("all")), F.col("id") == F.col("a_id"))
    return numbered.select(F.format_string("MD-%03d", number).alias("rule_id"), "id", F.col("chapter").alias("heading"), F.coalesce("mark", F.lit("中")).alias("risk"), "body")

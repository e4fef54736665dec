"""A stored inverted index of trigrams: from a trigram to the ids of the rows whose text has it.

The trigrams are those of similarity(): of lower-cased words, with two blanks before and one behind. A task inverts its texts block
by block, so that what is dealt out and written is a row for each trigram of a block, with the ids that have it. Rows are dealt by
trigram, a frequent one to several files, and lie in the order of trigrams within a file, so that a lookup reads the few row groups
that hold it; how often each trigram stands is written beside them. The index narrows a search for parts of texts, in any case, to rows that have the
rarest trigrams of what is looked for; what is found is still held against the pattern itself. Pairs of similar texts are found from
the same postings.

Defined cases: a null text has no postings; a part of less than three letters is looked up by all trigrams that hold it; one
without letters and digits cannot be narrowed, and all rows are candidates.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .graph import arrow_rows, cut
from .search import any_ilike, similar_by_grams
from .vouchers import numbered

#: Trigrams of one word that are looked up, the rarest first, and how many times as frequent as the rarest they may be.
MOST_GRAMS = 3
MOST_TIMES = 8
#: Postings of a block (of 12 bytes, and sorted once), texts that are handed to Python at a time, and files that a trigram is dealt to.
BLOCK_POSTINGS = 1_000_000
TEXTS_AT_ONCE = 2_000
FILES_OF_GRAM = 8
#: Candidates that are read for each of the first rows that are asked for, and how many times as many each time after.
LOT = 4
MORE = 8
#: Three code points of 21 bits are one number.
BITS = 21


@dataclass
class TrigramIndex:
    spark: SparkSession
    path: str

    @property
    def postings(self) -> DataFrame:
        """gram, id."""
        return self.spark.read.parquet(f"{self.path}/postings").select("gram", F.explode("ids").alias("id"))

    @property
    def counts(self) -> DataFrame:
        """gram, n."""
        return self.spark.read.parquet(f"{self.path}/counts")

    def _lookups(self, word: str) -> list[str] | None:
        """Trigrams that every text with a part like `word` has, the rarest; none if no text has one of them; None if any may."""
        runs = [run for piece in regex.split(r"\\.|[%_]", word) for run in regex.findall(r"[\p{L}\p{N}]+", piece.lower())]
        grams = {run[i : i + 3] for run in runs for i in range(len(run) - 2)}
        if not grams:
            return None
        known = self.counts.where(F.col("gram").isin(*grams)).orderBy("n", "gram").collect()  # no more than the word is long
        if len(known) < len(grams):
            return []
        return [r.gram for r in known[:MOST_GRAMS] if r.n <= MOST_TIMES * known[0].n]

    def _short(self, word: str) -> DataFrame | None:
        """id of texts that have a trigram with the longest run of a word that is too short for one of its own."""
        runs = [run for piece in regex.split(r"\\.|[%_]", word) for run in regex.findall(r"[\p{L}\p{N}]+", piece.lower())]
        if not runs:
            return None
        return self.postings.where(F.contains("gram", F.lit(max(runs, key=len)))).select("id")

    def candidates(self, words: list[str]) -> DataFrame | None:
        """id of the texts that may hold any of the words as ILIKE '%word%' would find them; None if that may be all."""
        wanted, found = [], []
        for no, word in enumerate(words):
            grams = self._lookups(word)
            if grams is None:
                ids = self._short(word)
                if ids is None:
                    return None
                found.append(ids)
            else:
                wanted += [(g, no, len(grams)) for g in grams]
        if wanted:
            asked = self.spark.createDataFrame(wanted, "g string, word int, need int")
            rows = self.postings.where(F.col("gram").isin(*{g for g, _, _ in wanted})).join(F.broadcast(asked), F.col("gram") == F.col("g"))
            found.append(rows.groupBy("word", "id", "need").agg(F.count("*").alias("have")).where("have = need").select("id"))
        ids = self.postings.select("id").limit(0)
        for more in found:
            ids = ids.union(more)
        return ids.distinct()

    def narrowed(self, rows: DataFrame, words: list[str], id_column: str = "id") -> DataFrame:
        """The rows that may hold any of the words."""
        ids = self.candidates(words)
        return rows if ids is None else rows.join(ids.select(F.col("id").alias("__id")), F.col(id_column) == F.col("__id"), "left_semi")

    def holding(self, rows: DataFrame, words: list[str], text: str, id_column: str = "id") -> DataFrame:
        """The rows whose text holds any of the words, in any case."""
        return self.narrowed(rows, words, id_column).where(any_ilike(F.col(text), words))

    def first_holding(self, rows: DataFrame, words: list[str], text: str, most: int, id_column: str = "id") -> DataFrame:
        """Of the rows whose text holds any of the words, in any case, the `most` of least id and maybe more: candidates are read in the
        order of their ids, lot by lot, until so many are found or all are read."""
        ids = self.candidates(words)
        if ids is None:
            return rows.where(any_ilike(F.col(text), words))
        ids, found, lot, after = cut(ids.select(F.col("id").alias("__id"))), None, LOT * most, None
        while True:
            some = cut((ids if after is None else ids.where(F.col("__id") > F.lit(after))).orderBy("__id").limit(lot))
            n, after = some.agg(F.count("*"), F.max("__id")).first()
            held = cut(rows.join(some, F.col(id_column) == F.col("__id"), "left_semi").where(any_ilike(F.col(text), words)))
            found = held if found is None else found.union(held)
            if n < lot or found.count() >= most:
                return found
            lot *= MORE

    def similar_classes(self, least: float = 0.3) -> tuple[DataFrame, DataFrame]:
        """(id, class) of all texts with postings, and a, b, similarity of the classes a < b that share `least` of their trigrams or more.

        Texts of the same trigrams are a class, named by its least id: copies meet nothing by themselves.
        """
        grams = self.postings.groupBy("id").agg(F.sort_array(F.collect_set("gram")).alias("grams"))
        first = grams.groupBy("grams").agg(F.min("id").alias("class"))
        members, first = cut(grams.join(first, "grams").select("id", "class")), cut(first)
        listed = first.select(F.col("class").alias("name"), F.explode("grams").alias("gram"))
        return members, similar_by_grams(listed, listed.groupBy("gram").agg(F.count("*").alias("n")), least)

    def similar_pairs(self, least: float = 0.3) -> DataFrame:
        """a, b, similarity: ids a < b of texts that share `least` of their trigrams or more; copies are spread into all of their pairs."""
        members, pairs = self.similar_classes(least)
        of = lambda x: members.select(F.col("id").alias(f"{x}_id"), F.col("class").alias(x))
        both = pairs.union(members.select(F.col("class").alias("a"), F.col("class").alias("b"), F.lit(1.0).alias("similarity")).distinct())
        met = both.join(of("a"), "a").join(of("b"), "b").where((F.col("a") != F.col("b")) | (F.col("a_id") < F.col("b_id")))
        return met.select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b"), "similarity")

    def similar_later(self, least: float = 0.3) -> DataFrame:
        """id, n, similarity: of each text how many of greater id are that similar, and the sum of their similarities; those that have some.

        Counted and not listed: a text's place in its class, and in each similar class put in one order with its own, tells how many come later.
        """
        members, pairs = self.similar_classes(least)
        pairs = cut(pairs)
        sizes = members.groupBy("class").agg(F.count("*").alias("size"))
        own = cut(numbered(members, "class", "id").select("id", "class", F.col("number").alias("own")))
        ends = pairs.select(F.concat_ws(" ", "a", "b").alias("pair"), "similarity", F.explode(F.array(F.struct(F.col("a").alias("class"), F.col("b").alias("other")), F.struct(F.col("b").alias("class"), F.col("a").alias("other")))).alias("x"))
        met = own.join(ends.select("pair", "similarity", "x.class", "x.other"), "class")
        met = numbered(met, "pair", "id").join(sizes.select(F.col("class").alias("other"), "size"), "other")
        # Of the texts before it in both classes, those that are not of its own are of the other.
        across = met.select("id", (F.col("size") - (F.col("number") - F.col("own"))).alias("n"), "similarity")
        within = own.join(sizes, "class").select("id", (F.col("size") - F.col("own")).alias("n"), F.lit(1.0).alias("similarity"))
        return across.union(within).where("n > 0").groupBy("id").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("similarity")).alias("similarity"))


def gram_codes(words: str) -> np.ndarray:
    """The distinct trigrams, as numbers in ascending order, of words with one blank between them."""
    own = words.strip(" ")
    if not own:
        return np.zeros(0, dtype=np.int64)
    c = np.frombuffer(f"  {own.replace(' ', '   ')} ".encode("utf-32-le"), dtype="<u4").astype(np.int64)
    inner = (c[1:-1] != 32) | (c[2:] != 32)  # the others span two words
    return np.unique(((c[:-2] << 2 * BITS) | (c[1:-1] << BITS) | c[2:])[inner])


def gram_of(code: int) -> str:
    return "".join(chr(code >> k * BITS & (1 << BITS) - 1) for k in (2, 1, 0))


def _inverted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (id, words) to a row for each trigram of a block of texts: gram, the ids that have it, and their number."""

    def told(codes: list[np.ndarray], ids: list[pa.Array]) -> pa.RecordBatch:
        every = np.concatenate(codes)
        order = np.argsort(every, kind="stable")
        text = np.repeat(np.arange(len(codes)), [len(c) for c in codes])[order]
        grams, begin, n = np.unique(every[order], return_index=True, return_counts=True)
        of = pa.ListArray.from_arrays(pa.array(np.append(begin, len(every)), pa.int32()), pa.concat_arrays(ids).take(pa.array(text)))
        return pa.RecordBatch.from_arrays([pa.array([gram_of(g) for g in grams.tolist()], pa.string()), of, pa.array(n, pa.int32())], names=["gram", "ids", "n"])

    codes, ids, held = [], [], 0
    for batch in batches:
        for i, words in enumerate(batch.column(1)):
            codes.append(gram_codes(words.as_py()))
            ids.append(batch.column(0).slice(i, 1))
            held += len(codes[-1])
            if held >= BLOCK_POSTINGS:
                yield told(codes, ids)
                codes, ids, held = [], [], 0
    if held:
        yield told(codes, ids)


def build_index(rows: DataFrame, path: str, id_column: str = "id", text: str = "text") -> TrigramIndex:
    """Write the index of rows below path, which must not be there."""
    words = F.regexp_replace(F.lower(F.col(text)), r"[^\p{L}\p{N}]+", " ")
    given = rows.where(F.col(text).isNotNull()).select(F.col(id_column).alias("id"), words.alias("words"))
    kind = StructType([StructField("gram", StringType()), StructField("ids", ArrayType(given.schema["id"].dataType)), StructField("n", IntegerType())])
    part = F.pmod(F.xxhash64(F.element_at("ids", 1)), F.lit(FILES_OF_GRAM))
    with arrow_rows(rows.sparkSession, TEXTS_AT_ONCE):
        given.mapInArrow(_inverted, kind).repartition("gram", part).sortWithinPartitions("gram").write.parquet(f"{path}/postings")
    index = TrigramIndex(rows.sparkSession, path)
    counts = index.spark.read.parquet(f"{path}/postings").groupBy("gram").agg(F.sum("n").alias("n"))
    counts.repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(f"{path}/counts")
    return index

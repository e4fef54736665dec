"""SentencePiece encoding and decoding by a distinct-chunk table.

SentencePiece turns spaces into a marker (U+2581). If no piece of a vocabulary has a marker behind another character, no merge
crosses from a character to a marker, and a text's ids are those of its marked words (a run of markers and what follows up to
the next) one after the other. So words are segmented once and their ids are joined back at every position of the word.

`chunk_table` counts the distinct marked words of all texts, added up before the shuffle. Those met most often, as many as
TABLE_BYTES hold, are segmented once for the whole job and broadcast; they are joined at each position by a look-up. Of what
is left most words stand in one text alone: these are segmented where they stand, once a task (a table of `tail_words`, begun
anew when full). To join them by a shuffle as well would cost one row for each text and rare word, twice, and the texts once.

A vocabulary that has a piece across a marker, or whose model does not say that normalization is the identity with a marker in
front, is encoded text by text instead. The results are those of the library in both cases.

Defined cases: null counts as the empty text, which has the begin and end ids alone; a marker character in a text is taken for
a space, as the library does; no rows give no table. Columns of the same names are replaced, all others kept.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, with_fresh

MARK = "▁"
#: Bytes of the broadcast table at most: words in UTF-8, and four bytes for each id.
TABLE_BYTES = 16 << 20
#: Distinct words of a task's own table: some 250 bytes each.
TAIL_WORDS = 200_000
#: Rows that are encoded before they leave the task.
SLICE_ROWS = 256


def words_are_independent(model: sentencepiece.SentencePieceProcessor) -> bool:
    """Whether marked words can be segmented one by one, by the model's own settings and pieces."""
    try:
        from sentencepiece import sentencepiece_model_pb2
    except ImportError:  # without it the settings cannot be read
        return False
    told = sentencepiece_model_pb2.ModelProto.FromString(model.serialized_model_proto())
    norm = told.normalizer_spec
    plain = norm.add_dummy_prefix and norm.escape_whitespaces and not norm.remove_extra_whitespaces and not norm.precompiled_charsmap and not norm.normalization_rule_tsv
    return plain and not told.trainer_spec.treat_whitespace_as_suffix and not any(MARK in p.piece.lstrip(MARK) for p in told.pieces)


def marked_words(text: Column) -> Column:
    """ChunkTable.marked_words as a Column."""
    spaced = F.replace(F.coalesce(text, F.lit("")), F.lit(MARK), F.lit(" "))
    runs = F.transform(F.regexp_extract_all(F.concat(F.lit(" "), spaced), F.lit(" +[^ ]*"), 0), lambda w: F.substr(w, F.lit(2)))
    return F.when(F.contains(spaced, F.lit("  ")) | F.startswith(spaced, F.lit(" ")), runs).otherwise(F.split(spaced, " ", -1))


def chunk_table(docs: DataFrame, model_file: str, text: str = "text", table_bytes: int = TABLE_BYTES) -> dict[str, bytes]:
    """Ids of the words that docs hold most often, each segmented once; at most table_bytes of words and ids.

    The words are counted over all texts. Of their counts the driver gets one sum for each number of binary digits, which
    gives the least count that still fits.
    """
    words = docs.where(F.col(text).isNotNull() & (F.col(text) != "")).select(F.explode(marked_words(F.col(text))).alias("word"))
    counted = materialize(words.groupBy("word").agg(F.count("*").alias("n")).where("n > 1"), "words")
    # A word has at most one id a byte and one for the marker, so this is the most that it takes.
    sizes = counted.groupBy(F.length(F.bin("n")).alias("digits")).agg(F.sum(5 * F.octet_length("word") + 4).alias("bytes")).collect()  # 64 rows at most
    room, least = table_bytes, None
    for row in sorted(sizes, key=lambda r: -r["digits"]):
        room -= row["bytes"]
        if room < 0:
            break
        least = row["digits"]
    if least is None:
        return {}

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ChunkTable(model_file)
        for batch in batches:
            found = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(table.segmented(found), pa.binary())], names=["word", "ids"])

    chosen = counted.where(F.length(F.bin("n")) >= least).select("word").mapInArrow(segment, "word string, ids binary").toArrow()
    return dict(zip(chosen["word"].to_pylist(), chosen["ids"].to_pylist()))


class ChunkTable:
    """Ids of texts as little-endian unsigned 32-bit integers, by tables of distinct marked words."""

    def __init__(self, model_file: str, tail_words: int = TAIL_WORDS, shared: dict[str, bytes] | None = None):
        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.independent = words_are_independent(self.model)
        self.tail_words = tail_words
        self.shared = shared or {}
        self.tail: dict[str, bytes] = {}

    @staticmethod
    def _bytes(ids: Iterable[int]) -> bytes:
        return np.array(ids, dtype="<u4").tobytes()

    def segmented(self, words: list[str]) -> list[bytes]:
        """words: without their first marker, which the library puts in front."""
        marker = self._bytes([self.model.piece_to_id(MARK)])  # the marker alone; the library puts none in front of nothing
        return [self._bytes(ids) if word else marker for word, ids in zip(words, self.model.encode(words, num_threads=1))]

    @staticmethod
    def marked_words(text: str) -> list[str]:
        """The marked words in order, each without its first marker; further markers of a run are spaces in front."""
        text = text.replace(MARK, " ")
        if "  " not in text and not text.startswith(" "):
            return text.split(" ")
        return [w[1:] for w in re.findall(" +[^ ]*", f" {text}")]

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Without begin and end ids."""
        if not self.independent:
            yield from (self._bytes(self.model.encode(t or "", num_threads=1)) for t in texts)
            return
        for text in texts:
            if not text:
                yield b""
                continue
            words = self.marked_words(text)
            found = list(map(self.shared.get, words))
            if None in found:
                rare = dict.fromkeys(w for w, ids in zip(words, found) if ids is None)
                fresh = [w for w in rare if w not in self.tail]
                if len(self.tail) + len(fresh) > self.tail_words:
                    self.tail.clear()
                    fresh = list(rare)
                self.tail.update(zip(fresh, self.segmented(fresh)))
                found = [self.tail[w] if ids is None else ids for w, ids in zip(words, found)]
            yield b"".join(found)


def encode_and_decode(docs: DataFrame, model_file: str, text: str = "text", table_bytes: int = TABLE_BYTES, tail_words: int = TAIL_WORDS, ids_column: str | None = "ids") -> DataFrame:
    """docs with n_tokens, ids_sha256 and decoded_sha256, and with the ids (array of int) under ids_column if that is named.

    ids have the begin and end ids; the decoded text is the library's decode(ids). docs is read twice, first for its words.
    """
    independent = words_are_independent(sentencepiece.SentencePieceProcessor(model_file=model_file))
    shared = docs.sparkSession.sparkContext.broadcast(chunk_table(docs, model_file, text, table_bytes) if independent else {})
    new = {"n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()} | ({ids_column: T.ArrayType(T.IntegerType())} if ids_column else {})
    kept = [c for c in docs.columns if c.lower() not in {n.lower() for n in new}]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(n, t) for n, t in new.items()])
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ChunkTable(model_file, tail_words, shared.value)
        begin, end = table._bytes([table.model.bos_id()]), table._bytes([table.model.eos_id()])
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(lo, SLICE_ROWS)
                counts, digests, decoded, offsets, ids_of = [], [], [], [0], []
                for ids in table.encode(part.column(at).to_pylist()):
                    ids = begin + ids + end
                    numbers = np.frombuffer(ids, dtype="<i4")
                    counts.append(len(numbers))
                    digests.append(hashlib.sha256(ids).hexdigest())
                    decoded.append(hashlib.sha256(table.model.decode(numbers.tolist()).encode("utf-8")).hexdigest())
                    offsets.append(offsets[-1] + len(numbers))
                    ids_of.append(numbers)
                made = [pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
                if ids_column:
                    made.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(ids_of), pa.int32())))
                old = [part.column(i) for i, c in enumerate(batch.schema.names) if c in kept]
                yield pa.RecordBatch.from_arrays(old + made, names=schema.names)

    return docs.mapInArrow(run, schema)


def decode(frame: DataFrame, model_file: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """frame with the library's text of the array of ids in out; null ids give null."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        for batch in batches:
            yield pd.Series([None if x is None else model.decode([int(i) for i in x]) for x in batch], dtype=object)

    return with_fresh(frame, {out: run(F.col(ids))})


__all__ = ["ChunkTable", "chunk_table", "decode", "encode_and_decode", "words_are_independent"]

"""Token ids in a binary format of shuffled bit or byte planes, compressed with zstandard, with a chunk index.

Documents are dealt out by ranges of doc_id and sorted; each partition becomes one file (`file_no`, in ascending order of
doc_id), a run of chunks of a fixed number of ids, the last one shorter. A chunk's ids are transposed into 32 bit planes or
4 byte planes, and each plane is compressed on its own. The index of a chunk is stored beside it: its place in the file, the
length of each plane, the number and doc_id of the documents that begin in it, where they begin, and whether the last one goes
on in the next chunk. Chunks are rows of a Parquet table, so that any store that Spark can write to holds them, and any chunk
can be read without the others.

Texts are encoded with the tokenizers library. For byte-level BPE of the usual splitting pattern, each distinct word is encoded
once a Python worker by the library's model and its ids are looked up from then on; texts that hold characters on whose class two regex
libraries might not agree, or an added token, and all texts for any other tokenizer, are encoded whole by the library.

Defined cases: a null text is empty and yields the end id alone; rows of one doc_id are ordered by text; a null doc_id comes
first. Other columns of the documents are not written.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

CHUNK_IDS = 1 << 16
TABLE_WORDS = 1_000_000
ZSTD_LEVEL = 3
CHUNKS = "file_no int, chunk_no int, first_id long, n_ids int, plane_bytes array<int>, planes binary, first_doc long, doc_ids array<long>, doc_starts array<int>, goes_on boolean"

# The splitting pattern of byte-level BPE for texts without a character of ODD, and the bytes that it shows as themselves.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"  # all letters among the characters that are not ODD
WORDS = re.compile(rf"""'(?:[sdmt]|ll|ve|re)| ?[{LETTERS}]+| ?[0-9]+| ?[^{LETTERS}0-9\t\n\x0b\x0c\r ]+|\s+(?!\S)|\s+""")
ODD = re.compile("[^\t\n\x0b\x0c\r -~¡-¬®-±´-¸º»¿-ɏ‐-‧€]")
SHOWN_BYTES = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]


def byte_characters() -> dict[int, int]:
    """Byte to the character that stands for it: itself if it is shown, else the next one from U+0100 on."""
    hidden = [b for b in range(256) if b not in SHOWN_BYTES]
    return {b: b for b in SHOWN_BYTES} | {b: 0x100 + i for i, b in enumerate(hidden)}


class WordTable:
    """Ids of texts as little-endian unsigned 32-bit integers."""

    def __init__(self, tokenizer_file: str, table_words: int = TABLE_WORDS):
        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        told = json.loads(self.tokenizer.to_str())
        split, model = told["pre_tokenizer"] or {}, told["model"]
        self.by_word = (
            (told["normalizer"], told["post_processor"], told["truncation"], told["padding"]) == (None,) * 4
            and (split.get("type"), split.get("add_prefix_space"), split.get("use_regex")) == ("ByteLevel", False, True)
            and model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
        )
        self.added = [t["content"] for t in told["added_tokens"]]
        self.model, self.characters = self.tokenizer.model, byte_characters()
        self.table_words, self.table = table_words, {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _word(self, word: str) -> bytes:
        plain = word.isascii() and word.isprintable()
        shown = word.replace(" ", chr(self.characters[32])) if plain else word.encode("utf-8").decode("latin-1").translate(self.characters)
        ids = [t.id for t in self.model.tokenize(shown)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.by_word or ODD.search(text) or any(a in text for a in self.added):
            return self._whole(text)
        words = WORDS.findall(text)
        try:
            return b"".join(map(self.table.__getitem__, words))
        except KeyError:
            fresh = {w for w in words if w not in self.table}
        if len(self.table) + len(fresh) > self.table_words:
            self.table.clear()
            fresh = set(words)
        self.table.update({w: self._word(w) for w in fresh})
        return b"".join(map(self.table.__getitem__, words))


@lru_cache(maxsize=1)
def word_table(tokenizer_file: str, table_words: int) -> WordTable:
    """The table of this Python worker, which its tasks use one after the other."""
    return WordTable(tokenizer_file, table_words)


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """The planes of unsigned 32-bit ids, the least significant first."""
    octets = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if not bits:
        return [np.ascontiguousarray(p).tobytes() for p in octets.T]
    return [np.packbits(p, bitorder="little").tobytes() for p in np.unpackbits(octets, axis=1, bitorder="little").T]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    """The ids of 4 byte planes or 32 bit planes."""
    if len(planes) == 4:
        octets = np.stack([np.frombuffer(p, dtype=np.uint8) for p in planes], axis=1) if n else np.zeros((0, 4), np.uint8)
    else:
        rows = np.stack([np.unpackbits(np.frombuffer(p, dtype=np.uint8), count=n, bitorder="little") for p in planes], axis=1)
        octets = np.packbits(rows, axis=1, bitorder="little")
    return np.ascontiguousarray(octets).view("<u4").reshape(-1)


def _chunk_writer(file_no: int, chunk_ids: int, bits: bool):
    """A function from a run of (doc_id, id bytes) to chunk rows, a list at a time."""
    squeeze = zstandard.ZstdCompressor(level=ZSTD_LEVEL).compress
    width = 4 * chunk_ids

    def chunks(docs: Iterable[tuple[int | None, bytes]]) -> Iterator[dict]:
        held, chunk_no, doc_no, doc_ids, starts = bytearray(), 0, 0, [], []

        def row(size: int, goes_on: bool) -> dict:
            nonlocal held, chunk_no, doc_no, doc_ids, starts
            planes = [squeeze(p) for p in to_planes(np.frombuffer(bytes(held[:size]), dtype="<u4"), bits)]
            done = {"file_no": file_no, "chunk_no": chunk_no, "first_id": chunk_no * chunk_ids, "n_ids": size // 4, "plane_bytes": [len(p) for p in planes], "planes": b"".join(planes), "first_doc": doc_no, "doc_ids": doc_ids, "doc_starts": starts, "goes_on": goes_on}
            held, chunk_no, doc_no, doc_ids, starts = held[size:], chunk_no + 1, doc_no + len(doc_ids), [], []
            return done

        for doc_id, ids in docs:
            if len(held) == width:
                yield row(width, False)
            doc_ids.append(doc_id)
            starts.append(len(held) // 4)
            held += ids
            while len(held) > width:
                yield row(width, True)
        if held:
            yield row(len(held), False)

    return chunks


def write_chunks(docs: DataFrame, path: str, tokenizer_file: str, end_id: int = 0, chunk_ids: int = CHUNK_IDS, bits: bool = False, table_words: int = TABLE_WORDS) -> None:
    """Write the token ids of docs(doc_id, text), an end id behind each document, to path."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(docs.sparkSession.createDataFrame([], CHUNKS).schema)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, end = word_table(tokenizer_file, table_words), np.array([end_id], dtype="<u4").tobytes()
        rows = ((d.as_py(), table.encode(t.as_py()) + end) for b in batches for d, t in zip(b.column(0), b.column(1)))
        for row in _chunk_writer(TaskContext.get().partitionId(), chunk_ids, bits)(rows):
            yield pa.RecordBatch.from_pylist([row], schema=schema)

    # Of very many rows with one doc_id, ranges over the text's hash still deal out those that differ.
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    ordered.mapInArrow(encode, CHUNKS).write.option("compression", "none").parquet(path)


def read_segments(chunks: DataFrame) -> DataFrame:
    """file_no, doc_no, chunk_no, doc_id, local_start, n, crc, whole: the part of each document in each chunk, from its ids."""
    fields = "file_no int, doc_no long, chunk_no int, doc_id long, local_start long, n long, crc long, whole boolean"

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        for c in (r for b in batches for r in b.to_pylist()):
            cuts = np.concatenate(([0], np.cumsum(c["plane_bytes"]))).tolist()
            ids = from_planes([expand(c["planes"][x:y]) for x, y in zip(cuts, cuts[1:])], c["n_ids"])
            # The first part belongs to a document that began in an earlier chunk, if none begins at 0.
            carried = [(None, 0)] if not c["doc_starts"] or c["doc_starts"][0] else []
            parts = carried + list(zip(c["doc_ids"], c["doc_starts"]))
            stops = [p for _, p in parts[1:]] + [c["n_ids"]]
            out = []
            for i, ((doc_id, start), stop) in enumerate(zip(parts, stops)):
                whole = not (carried and i == 0) and not (c["goes_on"] and i == len(parts) - 1)
                out.append((c["file_no"], c["first_doc"] + i - len(carried), c["chunk_no"], doc_id, c["first_id"] + start, stop - start, zlib.crc32(ids[start:stop].tobytes()), whole))
            names = [x.split()[0] for x in fields.split(", ")]
            kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(x, type=k) for x, k in zip(zip(*out), kinds)], names=names)

    return chunks.mapInArrow(segments, fields)


def join_crc(parts: list[tuple[int, int]]) -> int:
    """The CRC-32 of joined data from (bytes, CRC-32) of its parts: CRC is affine, so zeros in place of a part shift what was before."""
    total = 0
    for size, crc in parts:
        zeros = bytes(size)
        total = zlib.crc32(zeros, total) ^ crc ^ zlib.crc32(zeros)
    return total


def read_documents(chunks: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the chunk table; start counts the ids of all documents before."""
    segments = read_segments(chunks)

    @F.pandas_udf("long")
    def joined(parts: pd.Series) -> pd.Series:
        return pd.Series([join_crc([(4 * p["n"], p["crc"]) for p in one]) for one in parts], dtype="int64")

    whole = segments.where("whole").select("file_no", "doc_id", "local_start", F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))
    split = (
        segments.where("not whole").groupBy("file_no", "doc_no")
        .agg(F.max("doc_id").alias("doc_id"), F.min("local_start").alias("local_start"), F.sum("n").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("chunk_no", "n", "crc"))).alias("parts"))
        .select("file_no", "doc_id", "local_start", "n_tokens", joined("parts").alias("ids_crc32"))
    )
    # One row for each file: the only numbers that are added up across files.
    files = chunks.groupBy("file_no").agg(F.sum(F.col("n_ids").cast("long")).alias("ids"))
    before = files.select(F.col("file_no").alias("f_no"), F.coalesce(F.sum("ids").over(Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return whole.union(split).join(before, F.col("file_no") == F.col("f_no")).select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")

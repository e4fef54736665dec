import uuid
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from auditspark.llm import bitplane_tokens as B
from auditspark.llm.common import shared_dir

FILE = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(FILE)
TABLE = B.WordTable(FILE, table_words=200)
ODD = ["", " ", "\n\n a", "a  b ", "it's we'll I'D 'x", "x²³ ½ ª 日本語", "\x85a\xa0b\x1cc", "<|endoftext|> a", "😀", "été ça Ñandú_1 2,5", "a" * 3000, "a\tb\r\nc \n", "\x00"]


def ids_of(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


def test_odd_texts_and_other_tokenizers():
    assert TABLE.by_word
    assert not B.WordTable(public_tokenizers.path("word_bpe_49k.json")).by_word
    for t in ODD:
        assert np.frombuffer(TABLE.encode(t), "<u4").tolist() == ids_of(t), t


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab  \n.,'stéß_1²")) | st.characters(codec="utf-8"), max_size=40))
def test_any_text_is_encoded_as_the_library_does(text):
    assert np.frombuffer(TABLE.encode(text), "<u4").tolist() == ids_of(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=70), st.booleans())
def test_planes_go_round(ids, bits):
    planes = B.to_planes(np.array(ids, dtype=np.uint32), bits)
    assert len(planes) == (32 if bits else 4) and B.from_planes(planes, len(ids)).tolist() == ids


@given(st.lists(st.binary(max_size=20)))
def test_crcs_are_joined(parts):
    assert B.join_crc([(len(p), zlib.crc32(p)) for p in parts]) == zlib.crc32(b"".join(parts))


@pytest.mark.parametrize(("chunk_ids", "bits"), [(7, False), (64, True), (1 << 16, False)])
def test_documents_come_back_whole_whatever_the_chunks(spark, chunk_ids, bits):
    texts = {i: t for i, t in enumerate([*ODD, None, "word " * 500, "x"])}
    rows = [(i, t) for i, t in texts.items()][::-1]
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    B.write_chunks(spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_ids", B.F.lit(1)), path, FILE, chunk_ids=chunk_ids, bits=bits)
    start, want = 0, []
    for i in sorted(texts):
        ids = [*ids_of(texts[i]), 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, B.read_documents(spark.read.parquet(path)).collect())) == want


def test_null_and_repeated_ids_and_no_rows(spark):
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    B.write_chunks(spark.createDataFrame([(2, "b"), (None, "n"), (2, "a"), (2, "a")], "doc_id long, text string"), path, FILE, chunk_ids=3)
    got = B.read_documents(spark.read.parquet(path)).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 2, 2, 2] and [r.start for r in got] == [0, 2, 4, 6]
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    B.write_chunks(spark.createDataFrame([], "doc_id long, text string"), path, FILE)
    assert B.read_documents(spark.read.schema(B.CHUNKS).parquet(path)).collect() == []

import hashlib

import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from auditspark.llm import sp_chunks as C

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SP = sentencepiece.SentencePieceProcessor(model_file=MODEL)
TABLE = C.ChunkTable(MODEL, tail_words=300, shared=dict(zip(["", "a", "b", "the"], C.ChunkTable(MODEL).segmented(["", "a", "b", "the"]))))
ODD = ["", " ", "  ", "a", " a", "a ", "a  b", "\ta\n\nb ", "▁", "a▁b", " ▁ ", "<s>", "</s> x", "<0x41>", "日本語 テキスト", "😀😀", "​", "a b", "ﬁ Å", "x" * 5000, "\x00", "\x00a b", "\r\n"]


def check(texts):
    for t, ids in zip(texts, TABLE.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == SP.encode(t), t


def test_this_vocabulary_is_segmented_word_by_word():
    assert TABLE.independent


def test_odd_texts_are_encoded_as_the_library_does():
    check(ODD)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab  ▁\n.,é日😀\t'")) | st.characters(codec="utf-8"), max_size=40), max_size=6))
def test_any_texts_are_encoded_as_the_library_does(texts):
    check(texts)


def test_rows(spark):
    texts = [*ODD, None, "the same", "the same", "long text " * 30_000]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, N_TOKENS string")
    out = C.encode_and_decode(docs, MODEL)
    assert out.columns == ["doc_id", "text", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    for r in C.decode(out, MODEL).collect():
        ids = [SP.bos_id(), *SP.encode(texts[r.doc_id] or ""), SP.eos_id()]
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded == SP.decode(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(SP.decode(ids).encode()).hexdigest()
    assert C.encode_and_decode(docs.limit(0), MODEL).collect() == []


def test_table_holds_the_most_frequent_words_within_its_bytes(spark):
    texts = [*ODD, *["the cat  sat", "the dog", " the"] * 40, *[f"x{i} y{i} y{i}" for i in range(50)], None]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    words = [w for r in docs.select(C.marked_words(docs["text"]).alias("w")).collect() for w in r.w]
    assert words == [w for t in texts for w in (C.ChunkTable.marked_words(t or ""))]
    whole, small = C.chunk_table(docs, MODEL), C.chunk_table(docs, MODEL, table_bytes=150)
    assert {"the", "cat", "dog", " sat", "y7", ""} <= set(whole) and "x7" not in whole
    assert "the" in small and "y7" not in small and C.chunk_table(docs, MODEL, table_bytes=1) == {}
    assert all(whole[w] == C.ChunkTable(MODEL).segmented([w])[0] for w in whole)
    numbered = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for size in (1, 150, 1 << 20):
        got = {r.doc_id: r.ids for r in C.encode_and_decode(numbered, MODEL, table_bytes=size, tail_words=5).collect()}
        assert got == {i: [SP.bos_id(), *SP.encode(t or ""), SP.eos_id()] for i, t in enumerate(texts)}


def test_settings_that_are_not_the_identity_are_seen():
    from sentencepiece import sentencepiece_model_pb2

    for change in ("remove_extra_whitespaces", "precompiled_charsmap"):
        told = sentencepiece_model_pb2.ModelProto.FromString(SP.serialized_model_proto())
        setattr(told.normalizer_spec, change, True if change.startswith("remove") else b"x")

        class Model:
            def serialized_model_proto(self, told=told):
                return told.SerializeToString()

        assert not C.words_are_independent(Model())

"""The agenda against the sentencepiece library."""

from __future__ import annotations

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from tessella.llm import piece_bpe, queries

PATH = public_tokenizers.path("piece_bpe_32k.model")
PARTS = [*" ▁ab\n\t.é日本́\U0001f600\x00<s>theion", "  ", "\n\n", "the ", "<s>", "</s>", "<0x0A>", "﷽", "ﬁ"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def _texts(n: int) -> list[str]:
    draw = random.Random(11)
    return ["".join(draw.choices(PARTS, k=draw.randint(0, 25))) for _ in range(n)]


def test_encodes_and_decodes_as_the_library(spark, library):
    texts = [*_texts(3000), "", " ", "  a", "a" * 30_000, "ab " * 20_000, "\U0001f9ff" * 500, None]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string").repartition(3)
    encoded = piece_bpe.encode_documents(docs, PATH)
    got = {r.doc_id: r.ids for r in encoded.collect()}
    assert [got[i] for i in range(len(texts))] == [library.encode(t or "") for t in texts]
    back = {r.doc_id: r.text for r in piece_bpe.decode_documents(encoded, PATH).collect()}
    assert [back[i] for i in range(len(texts))] == [library.decode(library.encode(t or "")) for t in texts]


def test_decodes_any_ids_as_the_library(spark, library):
    draw = random.Random(12)
    pool = [0, 1, 2, *range(3, 290), 28705, 28797, 31999]
    lists = [draw.choices(pool, k=draw.randint(0, 8)) for _ in range(3000)] + [None]
    rows = spark.createDataFrame(list(enumerate(lists)), "doc_id long, ids array<int>")
    got = {r.doc_id: r.text for r in piece_bpe.decode_documents(rows, PATH).collect()}
    assert [got[i] for i in range(len(lists))] == [library.decode(x) if x else "" for x in lists]


def test_query_over_documents(spark, library, tmp_path):
    texts = [*_texts(200), None, "", "the same", "the same"]
    spark.createDataFrame([(i if i else None, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, queries.op11_piece_bpe(spark, str(tmp_path)).collect()), key=lambda r: -1 if r[0] is None else r[0])
    for (name, n, ids, text), (i, t) in zip(got, enumerate(texts), strict=True):
        own = library.encode(t or "")
        assert (name, n) == (i if i else None, len(own))
        assert ids == hashlib.sha256(",".join(map(str, own)).encode()).hexdigest()
        assert text == hashlib.sha256(library.decode(own).encode()).hexdigest()


def test_empty_table_and_what_the_check_does(spark):
    assert piece_bpe.digests(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
    model = piece_bpe.PieceModel(PATH)
    del model.piece[" the"]  # no longer the vocabulary of the library
    with pytest.raises(ValueError, match="library"):
        model.encode_units([b" the"])

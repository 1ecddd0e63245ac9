import hashlib
import random
import zlib

import numpy as np
import pytest


pt = pytest.importorskip("public_tokenizers")
import tiktoken  # noqa: E402

from tessella.llm import byte_bpe, packing, token_counts, units  # noqa: E402
from tessella.llm.tokenizers_io import ranks, word_tokenizer  # noqa: E402

WORDS, BYTES = pt.path("word_bpe_49k.json"), pt.path("byte_bpe_multi_50k.tiktoken")
ODD = [
    None, "", " ", "\n\n  \n", "don't STOP", "a  b   c ", "x\t\ty  \n z", "é ́a é", "a b  c　d", "\x1c a\x1fb", "<|endoftext|>", "a <|endoftext|>b c<|startoftext|>!", "<|ENDOFTEXT|> x.", "Mr.Smith,1999;ok:yes!no?", "漢字 かな 한국어", "🙂🙂 ok", "y" * 5000, "word " * 3000, "12345 6,789.01", "trailing  ", "ſtrange K",
]


def table(spark, texts, kind="bigint"):
    rows = [(None if i == 3 else i, t, "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, f"doc_id {kind}, text string, n_tokens string")


@pytest.fixture(scope="module")
def tik():
    return tiktoken.Encoding("own", pat_str=pt.PATTERN, mergeable_ranks=ranks(BYTES), special_tokens={})


def test_counts_as_the_library(spark):
    docs = table(spark, ODD + ODD[:6])
    got = {(r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(docs, WORDS, block=64).collect()}
    want = {(None if i == 3 else i, len((t or "").encode()), len(word_tokenizer(WORDS).encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(ODD + ODD[:6])}
    assert got == want
    assert token_counts.count_tokens(docs.where("false"), WORDS).count() == 0
    assert {r.over_limit for r in token_counts.count_tokens(docs.where("doc_id = 17"), WORDS, limit=2999).collect()} == {True}


def test_numbers_pack_and_unpack():
    a = np.array([0, 1, 255, 256, 70_000, 2**31], np.int64)
    assert token_counts.unpacked(token_counts.packed(a)).tolist() == a.tolist()
    assert len(token_counts.unpacked(token_counts.packed(a[:0]))) == 0


def test_units_of_random_texts_encode_as_whole_texts(tik):
    rng = random.Random(5)
    texts = ["".join(rng.choice(" \n\t ab'selvth12é漢️!?-.  \x1c") for _ in range(rng.randint(0, 60))) for _ in range(2000)]
    import pyarrow as pa

    buf, offs = units.buffer(pa.array(texts))
    known = units.Encoded(byte_bpe.encoder(BYTES, pt.PATTERN), limit=1000)
    ids, ends = known.texts(buf, offs, units.SPACE, units.MAY_BE_WHITE)
    assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == [tik.encode_ordinary(t) for t in texts]
    from tessella.llm.tokenizers_io import encode_words

    known = units.Encoded(lambda w: encode_words(WORDS, w), limit=1000)
    ids, ends = known.texts(buf, offs, units.WHITE, units.NONE, units.marks(buf))
    assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == [e.ids for e in word_tokenizer(WORDS).encode_batch(texts, add_special_tokens=False)]


def test_prefix_table(tik):
    bpe, rng = byte_bpe.opened(BYTES), random.Random(2)
    for _ in range(300):
        piece = bytes(rng.choice(b"theandinglyouerc\xc3\xa9") for _ in range(rng.randint(1, 60)))
        t = bpe.table(piece)
        assert bpe.decode(t.ids()) == piece
        n = rng.randint(0, len(piece))
        grown = bpe.table(piece[:n])
        grown.append(piece[n:])
        assert grown.last == t.last
        a, b = sorted((rng.randint(0, len(piece)), rng.randint(0, len(piece))))
        new = bytes(rng.choice(b"theand") for _ in range(rng.randint(0, 5)))
        t.replace(a, b, new)
        assert t.last == bpe.table(piece[:a] + new + piece[b:]).last
        t.turn(piece)
        assert t.last == bpe.table(piece).last
    long = b"thequickbrownfox" * 200
    t = bpe.table(long)
    assert t.replace(100, 101, b"zz") < 200 and t.last == bpe.table(long[:100] + b"zz" + long[101:]).last
    assert t.ids(50) == bpe.table(bytes(t.piece[:50])).ids()


def test_encode_and_decode_as_the_library(spark, tik):
    docs = table(spark, ODD)
    got = {r.doc_id: r for r in byte_bpe.digests(docs, BYTES, pt.PATTERN).collect()}
    for i, t in enumerate(ODD):
        ids, r = tik.encode_ordinary(t or ""), got[None if i == 3 else i]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    encoded = byte_bpe.encode_documents(docs, BYTES, pt.PATTERN)
    back = {r.doc_id: bytes(r.bytes) for r in byte_bpe.decode_documents(encoded, BYTES).collect()}
    assert back[8] == ODD[8].encode() and back[0] == b""
    assert byte_bpe.digests(docs.where("false"), BYTES, pt.PATTERN).count() == 0


def test_packing_is_whole_and_gapless(spark):
    docs = table(spark, ODD * 3 + ["word " * 200] * 40)
    rows = packing.pack_documents(docs, WORDS, capacity=512, shard=40).toPandas()
    ids = [np.array([*e.ids, 1], "<u4") for e in word_tokenizer(WORDS).encode_batch([r.text or "" for r in docs.collect()], add_special_tokens=False)]
    want = sorted((a, min(512, len(x) - a), zlib.crc32(x[a : a + 512].tobytes())) for x in ids for a in range(0, len(x), 512))
    assert sorted(zip(rows.start, rows.length, rows.ids_crc32)) == want
    assert (rows.start == 512 * rows.piece).all()
    for _, g in rows.sort_values("offset").groupby("sequence_id"):
        assert g.length.sum() <= 512 and g.offset.tolist() == [0, *g.length.cumsum()[:-1]]
    least = -(-rows.length.sum() // 512)
    assert rows.sequence_id.nunique() <= least * 1.1 + 2
    assert packing.pack_documents(docs.where("false"), WORDS).count() == 0


def test_offspring_hold_each_document_once():
    rng = random.Random(1)
    lengths = [rng.randint(1, 90) for _ in range(200)]
    order = sorted(range(200), key=lambda i: -lengths[i])
    one = packing.best_fit([], order, lengths, 100)
    other = packing.best_fit([], rng.sample(order, 200), lengths, 100)
    for child in (packing.crossover(one, other, lengths, 100, rng), packing.mutate(one, lengths, 100, rng)):
        assert sorted(i for b in child for i in b) == list(range(200))
        assert max(sum(lengths[i] for i in b) for b in child) <= 100
    best = packing.evolve(lengths, 100, rng, [])
    assert len(best) <= len(one)


def test_search_finds_what_best_fit_misses():
    # 6 + 4, 6 + 4, 5 + 5, 3 + 3 + 4: best fit decreasing alone needs a bin more in such cases.
    rng = random.Random(3)
    lengths = [44, 43, 42, 41, 39, 38, 37, 36, 21, 20, 19, 20] * 6
    least = -(-sum(lengths) // 100)
    assert len(packing.evolve(lengths, 100, rng, [])) <= least + 3

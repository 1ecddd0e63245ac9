"""The corpus pipeline's stages on planted rows."""

import random
from collections import Counter

import pytest

import corpus_pipeline as cp

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n=80):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(3, 9))) for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in rows], SCHEMA)


def bag(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def test_one_full_text_is_left_of_repeated_rows_and_rows_without_id(spark):
    a, b, c, d, e = (prose(i) for i in range(5))
    rows = [(1, a)] * 3 + [(None, b)] * 3 + [(2, c), (3, c), (None, c), (None, d), (4, e), (4, None), (4, None), (None, None), (None, None), (5, "")]
    left = cp.near_copies(spark, frame(spark, rows), "")
    assert left.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    want = Counter([(1, a), (None, b), (2, c), (None, d), (4, e), (4, None), (None, None), (None, None), (5, "")])
    assert bag(left) == want
    # No copy is left that the next stage would cut out of both.
    assert bag(cp.repeats(spark, left, "")) == want
    assert bag(cp.near_copies(spark, left.where("false"), "")) == Counter()


CLASHING = SCHEMA + ", key string, kept string, is_null boolean, blob string, found int, digest string"


def _planted(spark):
    """Clean and toxic prose, near copies, a passage of two documents, a secret, nulls, repeated rows; columns that clash."""
    rng = random.Random(7)
    clean = [prose(100 + i, 60) + "." for i in range(60)]
    toxic = [prose(300 + i, 40) + ". you vilefool are scumtrash. " + prose(400 + i, 20) for i in range(30)]
    passage = prose(500, 60)
    texts = [(i, t) for i, t in enumerate(clean + toxic)]
    texts += [(200, clean[0] + " end"), (201, passage + " " + prose(501)), (202, prose(502) + " " + passage), (203, 'say password = "hunter22x" now ' + prose(503)), (204, None), (205, ""), (206, prose(504)), (206, prose(504)), (None, prose(505)), (None, None)]
    rng.shuffle(texts)
    docs = spark.createDataFrame([(i, t, "en", "web", len(t or ""), "k", "x", False, "b", 1, "d") for i, t in texts], CLASHING)
    labels = [(i, 1, int(i >= 60)) for i in range(90)]
    return docs, labels, passage


def test_stages_on_planted_rows(spark, tmp_path):
    docs, labels, passage = _planted(spark)
    folder = str(tmp_path)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    before = bag(docs)
    left = cp.toxic(spark, docs, folder)
    gone = before - bag(left)
    assert left.columns == docs.columns and {i for i, _ in gone} == set(range(60, 90)) and not bag(left) - before
    once = cp.near_copies(spark, left, folder)
    assert bag(left) - bag(once) == Counter([k for k in bag(left) if k[0] in (200, 206)])
    cut = cp.repeats(spark, once, folder)
    by_id = {i: t for i, t in bag(cut)}
    # Strings of 200 bytes that stand twice, taken out plainly.
    raw = {i: (t or "").encode() for i, t in bag(once)}
    starts = Counter(t[a : a + 200] for t in raw.values() for a in range(len(t) - 199))
    for i, t in raw.items():
        off = {b for a in range(len(t) - 199) if starts[t[a : a + 200]] > 1 for b in range(a, a + 200)}
        assert (by_id[i] or "").encode() == bytes(c for a, c in enumerate(t) if a not in off)
    assert len(by_id[201]) + 400 < len(raw[201]) and cut.columns == docs.columns
    safe = cp.secrets(spark, cut, folder)
    was, now = bag(cut), bag(safe)
    ((i, t),) = (was - now).elements()
    assert i == 203 and (now - was) == Counter([(203, t.replace('password = "hunter22x', "[SECRET]"))])
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in safe.collect())
    packed = cp.pack(spark, safe, folder).collect()
    assert Counter(r.doc_id for r in packed) == Counter(r.doc_id for r in safe.collect())
    ran = cp.run(spark, folder).select("doc_id", "piece", "start", "length", "ids_crc32")
    assert Counter(map(tuple, ran.collect())) == Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed)


def test_stages_on_an_empty_table(spark, tmp_path):
    folder = str(tmp_path)
    frame(spark, []).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    assert cp.run(spark, folder).count() == 0


def test_a_pair_that_stands_twice_in_the_ledger_counts_once(spark, tmp_path):
    from tessella.llm import secret_scan

    rows = frame(spark, [(1, "token=abcdefgh"), (2, "token=abcdefgh"), (3, "none")])
    ledger = str(tmp_path / "ledger")
    secret_scan.scan(rows, ledger).count()
    once = spark.read.parquet(ledger).toArrow()
    spark.createDataFrame(once).write.mode("append").parquet(ledger)
    assert secret_scan.scan(rows, ledger).count() == 3
    assert spark.read.parquet(ledger).count() == 4  # nothing was scanned again

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import ann, quality, secret_scan, topk, toxicity, vectors

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


ODD = [(1, None), (2, ""), (3, " .!?\n "), (None, "plain words here"), (4, "x" * 100_000), (4, "x" * 100_000), (5, "é. É! 漢字")]


def odd(spark):
    return spark.createDataFrame([(i, t, "clash") for i, t in ODD], "doc_id long, text string, score string")


def test_toxicity_learns_from_documents_and_names_sentences(spark, docs, labels):
    held = toxicity.held_out("doc_id", 3, 1)
    model = toxicity.train(docs, labels.where(~held))
    scored = toxicity.score(docs, model)
    rows = scored.join(labels, "doc_id").where(held).select("score", "toxic").collect()
    right = sum((r.score >= 0.7) == (r.toxic == 1) for r in rows)
    assert right >= 0.93 * len(rows)
    hit = scored.where("score >= 0.7 AND size(sentences) > 0").join(docs, "doc_id").first()
    s = hit.sentences[0]
    assert 0 <= s.start < s.end <= len(hit.text) and s.score >= 0.5
    none = toxicity.train(docs, labels.where("false"))
    for m in (model, none):
        got = toxicity.score(odd(spark), m).collect()
        assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(odd(spark).where("false"), model).count() == 0
    clean = toxicity.keep_clean(docs, model)
    assert clean.columns == docs.columns and clean.count() == scored.where("score < 0.7").count()


def test_noisy_or_by_hand():
    import pyarrow as pa

    from tessella.llm import units

    buf, offs = units.buffer(pa.array(["Bad word. good one! Bad", "", None, "fine"]))
    feature, bounds, firsts, places = toxicity.sentences(buf, offs)
    assert firsts.tolist() == [0, 3, 3, 3, 4] and places.tolist() == [[0, 8], [10, 18], [20, 23], [23, 27]]
    w = np.zeros(1 << toxicity.BITS, np.float32)
    w[feature[0]] = 3
    z = toxicity._sentence_scores(toxicity.Model(w, -1.0), feature, bounds)
    p = 1 / (1 + np.exp(-z))
    want = [1 - np.prod(1 - p[:3]), 0, 0, p[3]]
    assert np.allclose(-np.expm1(-toxicity._noisy_or(z, firsts)), want)


def test_quality_votes(spark, docs, labels):
    held = toxicity.held_out("doc_id", 5, 0)
    model = quality.train(docs, labels.where(~held))
    rows = quality.score(docs, model).join(labels, "doc_id").where(held).select("score", "quality").collect()
    assert sum((r.score >= 0.3) == (r.quality == 1) for r in rows) >= 0.95 * len(rows)
    none = quality.train(docs, labels.where("false"))
    for m in (model, none):
        got = quality.score(odd(spark), m).collect()
        assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert [r.score for r in quality.score(odd(spark).where("doc_id IN (1, 2)"), model).collect()] == pytest.approx([model.prior] * 2)


def test_cosines_are_exact(docs, labels):
    import pyarrow as pa

    from tessella.llm import units

    model = quality.train(docs, labels)
    texts = [r.text for r in docs.orderBy("doc_id").limit(50).collect()]
    buf, offs = units.buffer(pa.array(texts))
    f, c, b = quality.features(buf, offs)
    w = quality._weights(f, c, b, model.idf)
    dense = np.zeros((50, 1 << quality.BITS))
    for i in range(50):
        dense[i, f[b[i] : b[i + 1]]] = w[b[i] : b[i + 1]]
    assert np.allclose(quality._times(f, w, b, model.space), dense @ model.space, atol=1e-4)
    n, total = quality.document_frequencies(docs)
    assert total == docs.count() and n.max() <= total


def secrets_by_hand(text):
    out = []
    for place, (kind, pattern, least, group) in enumerate([("assign", secret_scan.ASSIGN.pattern, 6, 2), ("access", r"AKIA[A-Z0-9]+", 20, 0), ("hex", r"[0-9a-f]+", 24, 0)]):
        for m in re.finditer(pattern, text, re.ASCII | (re.IGNORECASE if place == 0 else 0)):
            if len(m[group]) >= least:
                out.append((m.start(), place, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x for *_, x in sorted(out))


def test_secrets_as_by_hand_and_each_blob_once(spark, tmp_path):
    rng = random.Random(8)
    parts = ["password", "PassWD", "api_key", "apikey", "token", '"', "'", " = ", ":", "  ", "AKIA", "ABCDEFGHIJKLMNOPQ", "deadbeef", "0123456789abcdef", "é", "x", "=", "secret", "\n", "ſecret"]
    texts = [None, "", *("".join(rng.choice(parts) for _ in range(rng.randint(1, 25))) for _ in range(400))]
    texts += texts[:100]
    paths = spark.createDataFrame([(None if i == 7 else i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, blob string")
    ledger = f"file://{tmp_path}/ledger"
    got = secret_scan.digest(secret_scan.scan(paths, ledger)).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.spans) for r in got) == sorted((i == 7, None if i == 7 else i, secrets_by_hand(t or "")) for i, t in enumerate(texts))
    assert all(r.n_assign + r.n_access + r.n_hex == len(r.spans.split(",")) if r.spans else True for r in got)
    held = spark.read.parquet(ledger)
    blobs = len({t or "" for t in texts})
    assert held.count() == held.select("blob", "version").distinct().count() == blobs
    # The same content again is not scanned; new content and new rules are.
    more = paths.unionByName(spark.createDataFrame([(9999, "token=abcdefgh", "x")], paths.schema))
    assert secret_scan.scan(more, ledger).count() == len(texts) + 1
    assert spark.read.parquet(ledger).count() == blobs + 1
    other = (*secret_scan.BASE, secret_scan.Rule("mail", r"[a-z]+@[a-z.]+", 5))
    secret_scan.scan(more, ledger, other).count()
    assert spark.read.parquet(ledger).count() == 2 * (blobs + 1)
    assert secret_scan.scan(paths.where("false"), ledger).count() == 0


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "a token=abcdefgh z", 5), (2, "clean", 1), (3, None, 0), (4, "é password: 0123456789abcdef0123456789abcdef!", 2)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: r.text for r in secret_scan.redact(docs, secret_scan.scan(docs)).collect()}
    assert got == {1: "a [SECRET] z", 2: "clean", 3: None, 4: "é [SECRET]!"}


def points(spark, rng, n=700, d=20):
    x = rng.normal(size=(n, d)).round(2)
    x[50:200] = x[0]  # a very common vector
    x[300:400] = x[300] + rng.normal(size=(100, d)).round(3) * 0.05
    rows = [(i, v.tolist(), "x") for i, v in enumerate(x)]
    rows += [(n, None, "x"), (n + 1, [], "x"), (n + 2, [None] * d, "x"), (n + 3, [float("nan")] * d, "x"), (n + 4, [float("inf")] * d, "x"), (n + 5, [0.0] * d, "x"), (None, [1.0] * d, "x"), (n + 6, [1.0, 2.0], "x")]
    return x, spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")


def test_exact_top_k(spark):
    rng = np.random.default_rng(2)
    x, table = points(spark, rng)
    rows = topk.quantised(table)
    got = topk.top_k(rows, rows.where("id % 7 = 0"), 9, shard=100, block=30).toPandas()
    q = np.floor(64 * np.vstack([x, np.zeros((6, x.shape[1]))])).astype(int)
    ids = [*range(700), 705]
    for i in (i for i in ids if i % 7 == 0):
        best = sorted(((-int(q[i] @ q[j]), j) for j in ids if j != i))[:9]
        mine = got[got.query_id == i].sort_values("rank")
        assert list(zip(-mine.score, mine.vec_id)) == best and mine["rank"].tolist() == list(range(1, 10))
    assert topk.top_k(rows.where("id < 5"), rows.where("id = 0"), 9).count() == 4
    assert topk.top_k(rows.where("false"), rows.where("id = 0"), 9).count() == 0
    assert topk.top_k(rows, rows.where("false"), 9).count() == 0


def test_repeated_rows_among_equal_vectors(spark):
    """A query leaves out all rows of its own id; of other ids each row counts."""
    k, same = 20, [3.0, 4.0]
    held = [(0, same)] * 5 + [(i, same) for i in range(1, 31)] + [(2, same)] * 30 + [(40 + i, [3.0, 3.0 - i]) for i in range(30)]
    asked = [0, 1, 2]
    floats = spark.createDataFrame(held, "id long, vec array<double>")
    for find, rows in ((topk.top_k, floats.withColumn("vec", F.col("vec").cast("array<long>"))), (ann.search, floats)):
        got = find(rows, rows.where("id < 3"), k).toPandas()
        for q in asked:
            best = sorted((-(3 * v[0] + 4 * v[1]), i) for i, v in held if i != q)[:k]
            mine = got[got.query_id == q].sort_values("rank")
            assert list(zip(-mine.score, mine.vec_id)) == best, (find, q)


def test_tree_boxes_are_tight():
    rng = np.random.default_rng(4)
    x = rng.integers(-9, 9, (500, 6))
    t = topk.Tree(x, 20)
    assert sorted(t.order) == list(range(500))
    for (a, b), low, high, child in zip(t.span, t.low, t.high, t.child):
        own = x[t.order[a:b]]
        assert (own.min(0) == low).all() and (own.max(0) == high).all() and (child or b - a <= 20 or (low == high).all())


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(3)
    x, table = points(spark, rng, 1500)
    rows = vectors.usable(table, "vec_id", "embedding")
    got = ann.search(rows, rows.where("id % 10 = 0"), 9).toPandas()
    hit = total = 0
    for i in range(0, 1500, 10):
        s = x @ x[i]
        best = [j for j in np.lexsort((np.arange(1500), -s)) if j != i][:9]
        mine = got[got.query_id == i].sort_values("rank")
        assert len(mine) == 9 and np.allclose(mine.score, s[mine.vec_id.to_numpy()]) and i not in set(mine.vec_id)
        assert (np.diff(mine.score) <= 0).all()
        hit += len(set(best) & set(mine.vec_id))
        total += 9
    assert hit >= 0.9 * total
    assert 1505 not in set(got.vec_id) | set(got.query_id)  # zero takes no part
    assert ann.search(rows.where("false"), rows.where("id = 0"), 9).count() == 0
    assert ann.search(rows.where("id < 3"), rows.where("id = 0"), 9).count() == 2


def test_whole_recall_on_the_given_vectors(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = vectors.usable(table, "vec_id", "embedding")
    got = ann.search(rows, rows.where("id % 20 = 0"), 20).toPandas()
    e = rows.toPandas()
    x = np.stack(e.vec)
    hit = total = 0
    for i in np.flatnonzero(e.id % 20 == 0):
        s = x @ x[i]
        s[i] = -np.inf
        best = set(e.id.to_numpy()[np.lexsort((e.id, -s))[:20]])
        hit += len(best & set(got.vec_id[got.query_id == e.id[i]]))
        assert (got.query_id == e.id[i]).sum() == 20
        total += 20
    assert hit >= 0.9 * total


def test_held_out_rows(spark):
    import zlib

    got = spark.range(50).select("id", toxicity.held_out("id", 3, 1).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 3 == 1) for r in got)
    assert spark.sql("select cast(null as long) id").select(toxicity.held_out(F.col("id"), 3, 1).alias("h")).first().h is False

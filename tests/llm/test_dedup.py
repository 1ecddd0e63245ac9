import hashlib
import random

import numpy as np
import pytest

from tessella.llm import near_dup, suffix_dedup


def repeats_by_hand(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for b in raw:
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] = seen.get(b[i : i + length], 0) + 1
    out = []
    for b in raw:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((gone[:-1] & ~np.append(False, gone[:-1])[: len(b)]).sum())
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])).hexdigest()))
    return sorted(out)


def corpus(rng, n=60, alphabet="abcdefgh é漢"):
    """Texts that share passages, begin and end with them, repeat themselves, or nearly do."""
    word = lambda k: "".join(rng.choice(alphabet) for _ in range(k))
    shared = [word(rng.randint(30, 90)) for _ in range(6)]
    texts = [None, "", "a", "z" * 300, "xy" * 90, shared[0], shared[0], word(39) + "é", word(40)]
    for _ in range(n):
        parts = [rng.choice([word(rng.randint(0, 50)), rng.choice(shared), rng.choice(shared)[: rng.randint(1, 80)], rng.choice(shared)[rng.randint(0, 40) :]]) for _ in range(rng.randint(1, 5))]
        texts.append("".join(parts))
    texts[20] = texts[21] = word(25) + shared[1] + word(25)
    texts[22] = shared[2] + word(5) + shared[2]
    return texts


@pytest.mark.parametrize("hot", [False, True])
def test_repeated_strings_as_by_hand(spark, monkeypatch, hot):
    rng = random.Random(11 + hot)
    if hot:
        monkeypatch.setattr(suffix_dedup, "HOT", 1)
    texts = corpus(rng)
    docs = spark.createDataFrame([(None if i == 4 else i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, kept string").repartition(5)
    rows = suffix_dedup.remove_repeats(docs, 40).collect()
    assert sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows) == repeats_by_hand(texts, 40)
    assert suffix_dedup.remove_repeats(docs.where("false"), 40).count() == 0
    kept = suffix_dedup.without_repeats(docs, 40)
    assert kept.columns == docs.columns and kept.count() == len(texts)
    assert kept.where("text IS NULL").count() == 1


def test_long_texts_go_in_pieces(spark, monkeypatch):
    rng = random.Random(4)
    monkeypatch.setattr(suffix_dedup, "PIECE", 64)
    monkeypatch.setattr(suffix_dedup.units, "CHUNK", 50)
    import pyarrow as pa

    texts = ["".join(rng.choice("abcdefghij") for _ in range(700)) for _ in range(2)]
    texts.append(texts[0][100:400] + texts[1][300:500])
    whole, parts = {}, {}
    for name, into in (("whole", whole), ("parts", parts)):
        if name == "whole":
            monkeypatch.setattr(suffix_dedup.units, "CHUNK", 1 << 20)
        else:
            monkeypatch.setattr(suffix_dedup.units, "CHUNK", 50)
        for t in texts:
            rb = pa.RecordBatch.from_arrays([pa.array([b"k"]), pa.array([t])], ["key", "text"])
            for out in suffix_dedup._anchors([rb], 40):
                for r in out.to_pylist():
                    for s in range(r["lo"], r["lo"] + r["size"] - 39):
                        into[t, s] = r["anchor"]
    assert whole == parts and len(whole) == sum(len(t) - 39 for t in texts)


def test_interleave_of_shards(spark):
    rng = random.Random(9)
    bodies = [bytes(rng.choice(b"ab") for _ in range(rng.randint(10, 40))) for _ in range(80)]
    bodies += bodies[:5]
    offs = np.append(0, np.cumsum([len(b) for b in bodies]))
    got = suffix_dedup.interleave(np.frombuffer(b"".join(bodies), np.uint8), offs, 16)
    count = {}
    for b in bodies:
        for i in range(len(b) - 15):
            count[b[i : i + 16]] = count.get(b[i : i + 16], 0) + 1
    for b, ranges in zip(bodies, got):
        want = np.zeros(len(b), bool)
        for i in range(len(b) - 15):
            if count[b[i : i + 16]] > 1:
                want[i : i + 16] = True
        have = np.zeros(len(b), bool)
        for a, e in ranges.reshape(-1, 2):
            have[a:e] = True
        assert (want == have).all()


def sets_by_hand(texts, size):
    import re

    out = []
    for t in texts:
        low = "".join(c.lower() if c.isascii() else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        out.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    return out


def classes_by_hand(ids, texts, size, percent):
    sets = sets_by_hand(texts, size)
    parent = {i: i for i in ids if i is not None}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in zip(ids, sets):
        for j, b in zip(ids, sets):
            if i is not None and j is not None and i < j and a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = top(i), top(j)
                parent[max(x, y)] = min(x, y)
    return [(i, len(s), None if i is None else top(i), i is None or top(i) == i) for i, s in zip(ids, sets)]


def near_texts(rng, groups, copies, words=40):
    vocabulary = ["w%d" % i for i in range(400)]
    texts = [None, "", "  \n", "One two", "one TWO", "one two three", "é É", "É é"]
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(3, words))]
        for _ in range(rng.randint(1, copies)):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            texts.append(" ".join(own))
    return texts


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_as_by_hand(spark, monkeypatch, size, percent):
    rng = random.Random(size)
    # Short lists and small cells, so that long lists and large groups are met too.
    monkeypatch.setattr(near_dup, "SHORT", 4)
    monkeypatch.setattr(near_dup, "CELL", 8)
    texts = near_texts(rng, 12, 25)
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    ids[0] = ids[9] = None
    docs = spark.createDataFrame([(i, t, 0) for i, t in zip(ids, texts)], "doc_id long, text string, component_id int").repartition(4)
    got = near_dup.near_duplicates(docs, size, percent).collect()
    key = lambda r: (r[0] is None, r[0], r[1])
    assert sorted(map(tuple, got), key=key) == sorted(classes_by_hand(ids, texts, size, percent), key=key)


def test_near_duplicates_of_repeated_rows_and_none(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "a b c d e f g"), (5, "x y z p q r s"), (2, "x y z p q r s"), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.component_id, r.kept) for r in near_dup.near_duplicates(docs).collect()}
    # Both texts of id 2 tie their classes.
    assert got == {(1, 1, True), (2, 1, False), (5, 1, False), (9, 9, True)}
    assert near_dup.near_duplicates(docs.where("false")).count() == 0
    assert near_dup.near_duplicates(docs.where("doc_id = 9")).count() == 1

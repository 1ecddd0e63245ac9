"""Block-max search against scores computed plainly."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np

from tessella.llm import lexical


def terms(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", low)


def plain(docs, queries, k):
    held = [(i, Counter(terms(t))) for i, t in docs]
    n = sum(bool(c) for _, c in held)
    length = sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in dict.fromkeys(queries):
        scores = []
        for i, c in held:
            m = 25 + 75 * c.total() * n // length if length else 0
            s = sum(x * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, x in Counter(terms(text)).items() if c[t])
            if s > 0 and i is not None:
                scores.append((-s, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return out


def got(spark, docs, queries, k=5, **how):
    d = spark.createDataFrame([(i, t, 0, "x") for i, t in docs], "doc_id long, text string, df int, term string").repartition(3)
    q = spark.createDataFrame([(i, t, "x") for i, t in queries], "item_id long, text string, uses string")
    return sorted(map(tuple, lexical.search(d, q, k, **how).collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


def _rows():
    draw = random.Random(5)
    vocabulary = [f"w{int(draw.paretovariate(0.7))}" for _ in range(200)] + ["É", "日本", "The"]
    docs = [(i, " ".join(draw.choices(vocabulary, k=int(draw.paretovariate(0.9)) % 400)).replace("w7", "W7;")) for i in range(700)]
    docs += [(9000 - i, "the same text w1 w2") for i in range(40)] + [(1, "w1 w1"), (1, "w1 w1"), (None, "w3 w2"), (5000, None), (5001, ""), (5002, " ".join(["w2 w9"] * 4000))]
    queries = [(i, " ".join(draw.choices(vocabulary, k=draw.randint(1, 30)))) for i in range(90)]
    return docs, queries + [(200, None), (201, "nothing-known"), (202, "w1 W1 w1 the SAME text"), (202, "w1 W1 w1 the SAME text"), (None, "w2 the")]


def test_search_as_scored_plainly(spark):
    docs, queries = _rows()
    expected = sorted(plain(docs, queries, 5), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    for how in ({}, {"shard": 3000, "block": 4, "stretch": 16}):
        assert got(spark, docs, queries, **how) == expected


def test_empty_tables(spark):
    docs, queries = _rows()
    assert got(spark, [], queries[:3]) == []
    assert got(spark, docs[:5], []) == []
    assert got(spark, [(1, None), (2, ";")], queries[:3]) == []


def test_block_maxima_spare_blocks():
    """Blocks of a non-essential list that cannot reach the kth score stay compressed."""
    n = 4096
    lengths = np.arange(n) // 8 + 10
    score = lambda tf, m: lexical.impact(tf, m, n, int(lengths.sum()))

    def inverted(weight, docs, tf):
        starts = np.arange(0, len(docs), 8)
        ends = np.minimum(starts + 8, len(docs))
        gaps = np.diff(docs, prepend=0)
        gaps[starts] = docs[starts]
        body, bounds = lexical._varints(gaps, tf, starts, ends)
        blocks = [body[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        return lexical._List(weight, docs[ends - 1], np.maximum.reduceat(tf, starts), lengths[docs[starts]], blocks, score)

    common = inverted(10, np.arange(n), np.ones(n, np.int64))
    rare = inverted(9000, np.arange(5, n, 97), 1 + np.arange(len(range(5, n, 97))) % 7)
    every = np.ones(n, bool)
    docs, scores = lexical.block_max([(common, 1), (rare, 2)], lengths, 3, every, np.arange(n), 64)
    exact = common.weight * score(np.ones(n, np.int64), lengths)
    at = np.arange(5, n, 97)
    exact[at] += 2 * rare.weight * score(1 + np.arange(len(at)) % 7, lengths[at])
    first = np.lexsort((np.arange(n), -exact))[:3]
    assert docs.tolist() == first.tolist() and scores.tolist() == exact[first].tolist()
    assert len(common.read) < len(common.blocks) / 4

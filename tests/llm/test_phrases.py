"""Collocations against a plain count of all phrases."""

from __future__ import annotations

import random
import re
from collections import Counter

from tessella.llm import phrases


def plain(rows, least, keep, percent):
    counts, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    counts[lang, tuple(words[i : i + k])] += 1
    frequent = {p: a for p, a in counts.items() if a >= least}
    out = []
    for (lang, p), a in frequent.items():
        if len(p) < 2:
            continue
        inside = any(la == lang and len(q) > len(p) and 100 * b >= percent * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (la, q), b in frequent.items())
        if inside:
            continue
        score, k = min((1000 * a * total[lang] // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p)))
        out.append((lang, " ".join(p), a, counts[lang, p[:k]], counts[lang, p[k:]], total[lang], score))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    seen, ranked = Counter(), []
    for r in out:
        seen[r[0]] += 1
        if seen[r[0]] <= keep:
            ranked.append((r[0], seen[r[0]], *r[1:]))
    return ranked


def got(spark, rows, **how):
    docs = spark.createDataFrame([(t, la, 1, "x") for t, la in rows], "text string, lang string, block int, number string").repartition(4)
    return sorted(map(tuple, phrases.collocations(docs, **how).collect()), key=lambda r: (r[0], r[1]))


def test_phrases_as_counted_plainly(spark):
    draw = random.Random(3)
    vocabulary = ["of", "The", "the", "é", "Éa", "x1", "\x00", "in-a", "ab"]
    rows = []
    for _ in range(120):
        words = draw.choices(vocabulary, k=draw.randint(0, 60))
        if draw.random() < 0.6:
            words[3:3] = "once upon a time there".split()
        rows.append(("".join(w + draw.choice([" ", " ", "  ", "\t", ". ", "\n", ",", "\x0b"]) for w in words), draw.choice(["en", "fr", None, "und"])))
    rows += [(None, "en"), ("", None), *[("same words again and again", "en")] * 12]
    for least, percent, block in ((10, 100, 1 << 20), (4, 80, 500)):
        assert got(spark, rows, least=least, keep=50, percent=percent, block=block) == plain(rows, least, 50, percent)


def test_no_rows_and_no_frequent_words(spark):
    assert got(spark, []) == []
    assert got(spark, [("a b c", "en"), (None, None)]) == []


def test_products_past_64_bits(spark):
    found = spark.createDataFrame([(1, "en", 4_000_000_000_000, "a b", "b", [4_000_000_000_000] * 2, [5_000_000_000_000, 4_000_000_000_000])], "id long, lang string, f long, phrase string, last string, firsts array<long>, rests array<long>")
    total = spark.createDataFrame([("en", 90_000_000_000_000)], "lang string, n long")
    (row,) = phrases._ranked(found, total, 5).collect()
    assert (row.l, row.r, row.score) == (4 * 10**12, 5 * 10**12, 1000 * 90 * 10**12 // (5 * 10**12))

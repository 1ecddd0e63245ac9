"""N07_similar_lines: long lines without a blank, and pairs of unlike texts."""

import random
import re
import time
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from tessella.functions import texts
from tessella.operators import textblocks as tb


def test_comparable_on_runs_of_letters(spark):
    rng = random.Random(5)
    rows = ["".join(rng.choices(["b", "f", "bf", "a", "pi", "sum", "mathbf", "mathbb", "1", "é", " ", "{", "."], k=rng.randrange(14))) for _ in range(3000)]
    got = spark.createDataFrame([(t,) for t in rows], "t string").select("t", texts.comparable(F.col("t"))).collect()
    old = re.compile(r"[a-z]+bf|mathbf|frac|theta|pi|approx|sum|mathbb")
    for t, c in got:
        assert c == old.sub("", re.sub(r"[\s$\\{}\[\]]", "", t.lower())), t


def test_comparable_is_not_quadratic(spark):
    start = time.time()
    n = spark.range(4).select(F.length(texts.comparable(F.concat(F.repeat(F.lit("word "), 40_000), F.col("id").cast("string")))).alias("n")).agg(F.min("n")).first()[0]
    assert n == 160_001 and time.time() - start < 15


def test_ratios_are_those_of_difflib():
    rng = random.Random(7)
    pairs = []
    for _ in range(400):
        a = "".join(rng.choices("abcde é", k=rng.randrange(1, 260)))
        b = list(a)
        for _ in range(rng.randrange(1 + len(a) // 2)):
            b[rng.randrange(len(b))] = rng.choice("abcdefé")
        pairs.append((a, "".join(b)))
    for (a, b), r in zip(pairs, tb.ratios(*zip(*pairs), 0.8), strict=True):
        want = SequenceMatcher(None, a, b).ratio()
        assert r == want if want > 0.8 else r <= 0.8

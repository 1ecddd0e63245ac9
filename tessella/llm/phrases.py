"""Phrase collocations by set-oriented relational mining.

The relation of length k holds the occurrences of phrases of k words, sorted by piece and position, and is kept
block by block of texts. Positions skip one at each end of a piece: adjacent positions are adjacent words of one piece.

1. Group-count: each block gives the distinct phrases of its relation with their numbers of occurrences, packed by ranges
   of names; a range adds them up over all blocks and keeps the frequent ones.
2. Semi-join: the frequent phrases of a block go back to it; occurrences of others go.
3. Merge-join: of the sorted occurrences that are left, two at adjacent positions make one of length k + 1. Pairs of words
   are made of all words, so single words and pairs are counted together.

A common phrase is one entry of a block's list, so no key is hot. A phrase is named by a hash of 64 bits of its language and
words; two phrases share a name with a probability of 2^-64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.taskcontext import TaskContext

from tessella.llm import hashing, units
from tessella.llm.suffix_dedup import release
from tessella.session import scratch, small_batches

#: Bytes of text of a block.
BLOCK = 12 << 20
LONGEST = 5
NO_LANGUAGE = "und"

_ENDS = units.table(b".,;:!?\n\x0b\x0c\r")
_OUTSIDE = _ENDS | units.table(b" \t")
#: A block's relation is one row: places and numbers of its frequent phrases (or of all words), those phrases, and names and counts
#: of what they make at adjacent places. Phrases that are told by a block are rows of their own.
_RELATION = "block long, lang string, places binary, numbers binary, words binary, phrases binary, names binary, counts binary"
_TOLD = "name long, left long, right long, f long, word string"


def collocations(docs: DataFrame, least: int = 100, keep: int = 2000, percent: int = 100, text_col: str = "text", lang_col: str = "lang", block: int = BLOCK) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``keep`` first phrases of each language.

    Texts are A-Z lower-cased, cut at ``.,;:!?`` and line ends into pieces and those at spaces and tabs into words.
    Phrases are 2 to 5 words of a piece with at least ``least`` occurrences in their language, overlaps included. The
    score is the least of all cuts, floor(1000 * a * n / (l * r)), the first cut of equal ones. A phrase within a longer one with
    ``percent`` of its occurrences goes. Order: score, then a, both descending, then phrase by bytes.

    A null language is ``und``, a null text is empty, repeated rows count each time, other columns are not read, an empty
    table gives an empty result. A text over ``block`` bytes is a block of its own.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit(NO_LANGUAGE)).alias("lang"), F.col(text_col).alias("text"))
    stored = _written(rows.mapInArrow(lambda b: _blocks(b, block), f"{_RELATION}, n long"))
    total = stored.groupBy("lang").agg(F.sum("n").alias("n"))
    ranges = 16
    while ranges < stored.count():  # so that a range's lists are like a block's, however many blocks there are
        ranges *= 2
    told = _written(_extended(stored, _frequent(stored, ranges, least)))
    phrases = told.where("name IS NOT NULL AND left IS NULL").select("name", "lang", "f", F.col("word").alias("phrase"), F.col("word").alias("last"), F.array("f").alias("firsts"), F.array("f").alias("rests"))
    found = []
    for k in range(2, LONGEST + 1):
        longer = _written(_longer(phrases, told.where("left IS NOT NULL").select("name", "left", "right", "f")))
        within = longer.select(F.explode(F.array("left", "right")).alias("name"), F.col("f").alias("of")).groupBy("name").agg(F.max("of").alias("of"))
        if found:  # of all longer phrases around one, those of one word more are the most frequent
            shorter = found.pop()
            found.append(shorter.join(within, "name", "left").where(F.col("of").isNull() | (100 * F.col("of") < percent * F.col("f"))).select(shorter.columns))
        phrases = longer.drop("left", "right")
        found.append(phrases)
        if k < LONGEST:
            stored = told.where("places IS NOT NULL")
            told = _written(_extended(stored, _frequent(stored, ranges, least)))
    every = found[0]
    for part in found[1:]:
        every = every.unionByName(part)
    return _ranked(every, total, keep)


def _written(df: DataFrame) -> DataFrame:
    """Written as it is: relations are compressed already, and a codec would hold a page of many such rows, twice, outside the heap."""
    folder = scratch(df.sparkSession)
    df.write.option("compression", "uncompressed").parquet(folder)
    release(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def _frequent(stored: DataFrame, ranges: int, least: int) -> DataFrame:
    """(block, names, counts, own): frequent phrases of each block and range; ``own`` marks those that the block tells of."""
    dealt = stored.select("block", "names", "counts").mapInArrow(lambda b: _dealt(b, ranges), "range int, block long, names binary, counts binary")
    return dealt.groupBy("range").applyInArrow(lambda t: _counted(t, least), "block long, names binary, counts binary, own binary")


def _extended(stored: DataFrame, frequent: DataFrame) -> DataFrame:
    """Phrases that are told, and the relation of phrases of one word more."""
    relation = stored.select(F.col("block").alias("of"), "lang", "places", "numbers", "words", "phrases")
    return relation.groupBy("of").cogroup(frequent.groupBy("block")).applyInArrow(_extend, f"{_RELATION}, {_TOLD}")


def _longer(phrases: DataFrame, frequent: DataFrame) -> DataFrame:
    """Frequent phrases of one word more: text, and occurrences of every first and last part."""
    left = phrases.select(F.col("name").alias("left"), "lang", F.col("phrase").alias("start"), "firsts")
    right = phrases.select(F.col("name").alias("right"), "last", "rests")
    both = frequent.join(left, "left").join(right, "right")
    own = F.array("f")
    return both.select("name", "left", "right", "lang", "f", F.concat_ws(" ", "start", "last").alias("phrase"), "last", F.concat("firsts", own).alias("firsts"), F.concat("rests", own).alias("rests"))


def _ranked(phrases: DataFrame, total: DataFrame, keep: int) -> DataFrame:
    scored = phrases.join(total, "lang").withColumn("words", F.size("firsts")).withColumn(
        "cut",
        F.expr(
            """array_min(transform(sequence(1, words - 1), k -> struct(
                 cast((cast(1000 AS decimal(4,0)) * cast(f AS decimal(19,0)) * cast(n AS decimal(19,0)))
                      div (cast(firsts[k - 1] AS decimal(19,0)) * cast(rests[words - k - 1] AS decimal(19,0))) AS long) AS score,
                 k AS k, firsts[k - 1] AS l, rests[words - k - 1] AS r)))"""
        ),
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    flat = scored.select("lang", "phrase", F.col("f").alias("a"), F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
    ranked = flat.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _packed(a: np.ndarray) -> bytes:
    """Unsigned numbers, byte planes apart, compressed."""
    planes = np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpacked(b: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def _steps(a: np.ndarray) -> bytes:
    """Ascending numbers by their distances."""
    a = a.astype(np.uint64)
    return _packed(np.append(a[:1], a[1:] - a[:-1]))


def _walked(b: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(b), dtype=np.uint64)


def _word_names(words: list[bytes], lang: str) -> np.ndarray:
    buf = np.frombuffer(b"\n".join([lang.encode(), *words]), np.uint8)
    ends = np.append(np.flatnonzero(buf == 10), len(buf))
    sums = hashing.running(buf)
    whole = hashing.ranges(sums, np.append(0, ends[:-1] + 1), ends)
    return hashing.mix(whole[1:] + hashing.mix(whole[:1], 11), 12)


def _pair_names(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return hashing.mix(left * hashing.B + right, 13)


def _merged(names: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct names and their sums."""
    if counts is None:
        return np.unique(names, return_counts=True)
    order = np.argsort(names)
    names, counts = names[order], counts[order]
    first = np.flatnonzero(np.append(True, names[1:] != names[:-1]))[: len(names)]
    return names[first], np.add.reduceat(counts, first) if len(first) else counts


def _blocks(batches, limit: int):
    """The relation of single words, and the names of words and pairs: a block for each language of about ``limit`` bytes of texts."""
    task, made = TaskContext.get().partitionId() << 32, 0
    held: dict[str, list] = {}
    size = 0
    for rb, buf, offs in units.chunks(batches, "text"):
        low = hashing.LOWER[buf]
        starts, ends = hashing.runs(~_OUTSIDE[low], offs)
        code, words = units.distinct_ranges(low, starts, ends)
        text = np.searchsorted(offs, starts, "right") - 1
        passed = np.append(0, np.cumsum(_ENDS[low]))[starts]
        fresh = np.append(True, (passed[1:] != passed[:-1]) | (text[1:] != text[:-1]))[: len(starts)]
        langs = rb.column(0).dictionary_encode()
        of = langs.indices.to_numpy()[text]
        for i, lang in enumerate(langs.dictionary.to_pylist()):
            own = np.flatnonzero(of == i)
            used, number = np.unique(code[own], return_inverse=True)
            held.setdefault(lang, []).append((fresh[own], number, words.take(pa.array(used))))
        size += len(buf)
        if size >= limit:
            for lang, parts in held.items():
                yield _block(task + made, lang, parts)
                made += 1
            held, size = {}, 0
    for lang, parts in held.items():
        yield _block(task + made, lang, parts)
        made += 1


def _block(block: int, lang: str, parts: list) -> pa.RecordBatch:
    coded = pa.concat_arrays([w for *_, w in parts]).dictionary_encode()
    renamed, at, numbers = coded.indices.to_numpy(), 0, []
    for _, number, words in parts:
        numbers.append(renamed[at : at + len(words)][number])
        at += len(words)
    numbers = np.concatenate(numbers)
    fresh = np.concatenate([f for f, *_ in parts])
    words = coded.dictionary.to_pylist()
    name = _word_names(words, lang)
    left = np.flatnonzero(~fresh[1:])
    pairs, n = _merged(_pair_names(name[numbers[left]], name[numbers[left + 1]]))
    names, counts = _merged(np.append(name, pairs), np.append(np.bincount(numbers, minlength=len(words)), n))
    row = {"block": block, "lang": lang, "places": _steps(np.arange(len(fresh)) + np.cumsum(fresh)), "numbers": _packed(numbers), "words": zstandard.ZstdCompressor(level=3).compress(b"\n".join(words)), "phrases": None, "names": _steps(names), "counts": _packed(counts), "n": len(numbers)}
    return pa.RecordBatch.from_pylist([row], _BLOCKS)


_BINARY = ("places", "numbers", "words", "phrases", "names", "counts")
_PLAIN = [("block", pa.int64()), ("lang", pa.string()), *((c, pa.binary()) for c in _BINARY)]
_BLOCKS = pa.schema([*_PLAIN, ("n", pa.int64())])
_STEP = pa.schema([*_PLAIN, ("name", pa.int64()), ("left", pa.int64()), ("right", pa.int64()), ("f", pa.int64()), ("word", pa.string())])


def _dealt(batches, ranges: int):
    """Each block's list in ranges of names."""
    edges = np.arange(1, ranges, dtype=np.uint64) * np.uint64((1 << 64) // ranges)
    kind = pa.schema([("range", pa.int32()), ("block", pa.int64()), ("names", pa.binary()), ("counts", pa.binary())])
    for rb in batches:
        for block, names, counts in zip(*rb.columns, strict=True):
            names, counts = _walked(names.as_py()), _unpacked(counts.as_py())
            at = np.append(0, np.append(np.searchsorted(names, edges), len(names)))
            used = np.flatnonzero(at[1:] > at[:-1])
            rows = [{"range": int(i), "block": block.as_py(), "names": _steps(names[at[i] : at[i + 1]]), "counts": _packed(counts[at[i] : at[i + 1]])} for i in used]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, kind)


def _counted(t: pa.Table, least: int) -> pa.Table:
    """Frequent names of a range, back to the blocks that have them; the first of these tells of the phrase."""
    blocks = t.column("block").to_numpy()
    lists = [_walked(x) for x in t.column("names").to_pylist()]
    of = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    names, counts = np.concatenate(lists), np.concatenate([_unpacked(x) for x in t.column("counts").to_pylist()])
    order = np.lexsort((blocks[of], names))
    names, counts, of = names[order], counts[order].astype(np.int64), of[order]
    first = np.flatnonzero(np.append(True, names[1:] != names[:-1]))
    size = np.diff(np.append(first, len(names)))
    sums = np.add.reduceat(counts, first)
    own = np.zeros(len(names), bool)
    own[first] = True
    keep = np.repeat(sums >= least, size)
    names, counts, own, of = names[keep], np.repeat(sums, size)[keep], own[keep], of[keep]
    order = np.argsort(of, kind="stable")
    names, counts, own, of = names[order], counts[order], own[order], of[order]
    at = np.searchsorted(of, np.arange(len(lists) + 1))
    used = np.flatnonzero(at[1:] > at[:-1])
    part = lambda f, x: pa.array([f(x[at[i] : at[i + 1]]) for i in used], pa.binary())
    return pa.table({"block": pa.array(blocks[used]), "names": part(_steps, names), "counts": part(_packed, counts), "own": part(lambda x: np.packbits(x).tobytes(), own)})


def _extend(relation: pa.Table, frequent: pa.Table) -> pa.Table:
    (row,) = relation.to_pylist()
    parts = [(_walked(n), _unpacked(c), np.frombuffer(o, np.uint8)) for n, c, o in zip(*(frequent.column(c).to_pylist() for c in ("names", "counts", "own")), strict=True)]
    flat = lambda xs, kind: np.concatenate([np.zeros(0, kind), *xs])
    names = flat([n for n, *_ in parts], np.uint64)
    order = np.argsort(names)
    names, f = names[order], flat([c for _, c, _ in parts], np.uint64)[order].astype(np.int64)
    own = flat([np.unpackbits(o, count=len(n)).astype(bool) for n, _, o in parts], bool)[order]

    def known(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in the list of frequent names, and whether a name is in it."""
        at = np.minimum(np.searchsorted(names, x), max(len(names) - 1, 0))
        return at, names[at] == x if len(names) else np.zeros(len(x), bool)

    places, numbers = _walked(row["places"]).astype(np.int64), _unpacked(row["numbers"]).astype(np.int64)
    told = []

    def tell(name: np.ndarray, left: np.ndarray | None, right: np.ndarray | None, words: list | None) -> None:
        at, is_known = known(name)
        mine = np.flatnonzero(is_known)
        mine = mine[own[at[mine]]]
        as_long = lambda x: pa.nulls(len(mine), pa.int64()) if x is None else pa.array(x[mine].view(np.int64))
        word = pa.nulls(len(mine), pa.string()) if words is None else pa.array([words[i].decode() for i in mine], pa.string())
        blank = [pa.nulls(len(mine), pa.binary())] * len(_BINARY)
        told.append(pa.RecordBatch.from_arrays([pa.array(np.full(len(mine), row["of"])), pa.array([row["lang"]] * len(mine), pa.string()), *blank, as_long(name), as_long(left), as_long(right), pa.array(f[at[mine]]), word], schema=_STEP))

    if row["words"] is not None:
        words = zstandard.ZstdDecompressor().decompress(row["words"]).split(b"\n")
        phrase = _word_names(words, row["lang"])
        tell(phrase, None, None, words)
    else:
        phrase = _walked(row["phrases"])
    name, left, right, at, places = _joined(places, phrase[numbers])
    tell(name, left, right, None)
    stays = known(name)[1][at]  # semi-join
    places, phrase = places[stays], name[at[stays]]
    longer = _joined(places, phrase)
    phrase, numbers = np.unique(phrase, return_inverse=True)
    row = {"block": row["of"], "lang": row["lang"], "places": _steps(places), "numbers": _packed(numbers), "phrases": _steps(phrase), "names": _steps(longer[0]), "counts": _packed(np.bincount(longer[3], minlength=len(longer[0])))}
    return pa.Table.from_batches([pa.RecordBatch.from_pylist([row], _STEP), *told], _STEP)


def _joined(places: np.ndarray, phrase: np.ndarray) -> tuple[np.ndarray, ...]:
    """Merge-join of a sorted relation with itself at adjacent places: distinct names, both parts of each, and number and place of each occurrence."""
    start = np.flatnonzero(places[1:] == places[:-1] + 1)
    left, right = phrase[start], phrase[start + 1]
    name, first, number = np.unique(_pair_names(left, right), return_index=True, return_inverse=True)
    return name, left[first], right[first], number, places[start]

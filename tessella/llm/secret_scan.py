"""Secret scans over a ledger of blobs: every content is scanned once by every version of the rules.

A path (here a document) is one place of a content; the content's SHA-256 is the blob. The ledger
holds two kinds of rows in one Parquet folder: ``blob, version`` for each pair that was scanned, with the
findings of that pair. A run content-addresses all rows, drops the pairs that the ledger has, scans one copy of
each blob that is left, appends the outcome, and joins findings to all paths of a blob.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tessella.llm.units import unused
from tessella.session import scratch


@dataclass(frozen=True)
class Rule:
    """``group`` of a match must have ``least`` characters; shorter matches are passed over, not searched again."""

    kind: str
    pattern: str
    least: int
    group: int = 0
    any_case: bool = False

    def spans(self, text: str):
        found = re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0)).finditer(text)
        return [(m.start(), m.end()) for m in found if m.end(self.group) - m.start(self.group) >= self.least]


#: The three kinds of the base scan, in their order.
ASSIGN = Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, True)
ACCESS = Rule("access", r"AKIA[A-Z0-9]+", 20)
HEX = Rule("hex", r"[0-9a-f]+", 24)
BASE = (ASSIGN, ACCESS, HEX)

#: A run of at least the wanted length is searched: it holds the same matches as all runs, filtered.
_FAST = {ACCESS: r"AKIA[A-Z0-9]{16,}", HEX: r"[0-9a-f]{24,}"}

FINDINGS = "array<struct<kind:string,start:int,end:int>>"


def version_of(rules) -> str:
    """Rules that differ in any way are another version."""
    return hashlib.sha256(repr([(r.kind, r.pattern, r.least, r.group, r.any_case) for r in rules]).encode()).hexdigest()[:16]


def scan_text(text: str, rules=BASE) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then in the order of the rules; code points, end exclusive."""
    out = []
    for k, rule in enumerate(rules):
        if rule in _FAST:
            spans = [m.span() for m in re.finditer(_FAST[rule], text)]
        else:
            spans = rule.spans(text)
        out += [(a, k, rule.kind, b) for a, b in spans]
    return [(kind, a, b) for a, _, kind, b in sorted(out)]


def scan(paths: DataFrame, ledger: str | None = None, rules=BASE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, blob, findings) for each row of ``paths``; ``ledger`` is a Parquet folder that grows with each run.

    Without a ledger a fresh one is kept in the shared folder. A pair that two runs at once have both appended counts once. A null text is the empty blob and has no
    findings. Repeated rows and null ids keep their rows; other columns are not read; an empty table gives an
    empty result. Texts are scanned whole, whatever their length.
    """
    spark = paths.sparkSession
    rules, version = tuple(rules), version_of(rules)
    ledger = ledger or scratch(spark)
    # The hash is the key that is shuffled; it names the content, so one copy of each is enough below.
    held = paths.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("blob", F.unhex(F.sha2("text", 256)))
    schema = T.StructType([T.StructField("blob", T.BinaryType()), T.StructField("version", T.StringType()), T.StructField("findings", T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))])
    fresh = held.select("blob", "text").groupBy("blob").agg(F.first("text").alias("text"))
    seen = _opened(spark, ledger, schema)
    if seen is not None:
        fresh = fresh.join(seen.where(F.col("version") == version).select("blob").distinct(), "blob", "left_anti")
    fresh.mapInArrow(lambda b: _scan(b, rules, version), schema).write.mode("append").parquet(ledger)
    found = spark.read.schema(schema).parquet(ledger).where((F.col("version") == version) & (F.size("findings") > 0)).groupBy("blob").agg(F.first("findings").alias("findings"))
    return held.select("id", "blob").join(found, "blob", "left").select(F.col("id").alias(id_col), F.lower(F.hex("blob")).alias("blob"), F.coalesce("findings", F.array().cast(FINDINGS)).alias("findings"))


def _opened(spark, folder: str, schema) -> DataFrame | None:
    """The ledger so far; none before the first run."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(schema).parquet(folder) if there else None


def _scan(batches, rules, version: str):
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    for rb in batches:
        found = [[{"kind": k, "start": a, "end": b} for k, a, b in scan_text(t.as_py(), rules)] for t in rb.column(1)]
        yield pa.RecordBatch.from_arrays([rb.column(0), pa.array([version] * rb.num_rows), pa.array(found, kind)], ["blob", "version", "findings"])


def digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans) from the findings of ``scan`` with the base rules."""
    listed = F.array_join(F.transform("findings", lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")
    count = lambda k: F.size(F.filter("findings", lambda f: f["kind"] == k)).cast("long").alias(f"n_{k}")
    return scanned.select(id_col, count("assign"), count("access"), count("hex"), F.sha2(listed, 256).alias("base_sha256"), listed.alias("spans"))


def redact(docs: DataFrame, scanned: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every found span replaced by ``mark``; rows are matched by id and content.

    Columns stay as they are, in their order, whatever their names. Overlapping spans are replaced as one.
    """
    blob_col, found_col = unused("blob", docs.columns), unused("found", docs.columns)
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = scanned.where(F.size("findings") > 0).groupBy("blob").agg(F.first("findings").alias(found_col)).withColumnRenamed("blob", blob_col)
    joined = docs.withColumn(blob_col, F.sha2(text, 256)).join(found, blob_col, "left")

    def step(acc, f):
        from_ = F.greatest(acc["at"], f["start"])
        more = F.when(f["start"] >= acc["at"], F.concat(F.substring(text, acc["at"] + 1, f["start"] - acc["at"]), F.lit(mark))).otherwise(F.lit(""))
        return F.struct(F.concat(acc["out"], more).alias("out"), F.greatest(from_, f["end"]).cast("int").alias("at"))

    clean = F.aggregate(found_col, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return joined.withColumn(text_col, F.when(F.col(found_col).isNull(), F.col(text_col)).otherwise(clean)).select(*docs.columns)

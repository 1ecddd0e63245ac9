"""op12_phrase_collocations: how much text a Python worker gets at a time."""

from __future__ import annotations

import pyarrow as pa

from tessella.llm import phrases

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
SMALL = "/root/testdata/sf0.001"


def largest(spark) -> int:
    """Bytes of the largest batch of 20 MB of texts in one partition."""

    def sizes(batches):
        for rb in batches:
            yield pa.RecordBatch.from_arrays([pa.array([rb.nbytes])], ["n"])

    texts = spark.range(0, 2000, 1, 1).selectExpr("repeat('0123456789', 1000) AS text")
    return texts.mapInArrow(sizes, "n long").agg({"n": "max"}).first()[0]


def test_collocations_hand_over_few_bytes_at_a_time(spark):
    spark.conf.unset(KEY)
    phrases.collocations(spark.read.parquet(f"{SMALL}/documents.parquet"), least=20)
    assert largest(spark) < 5 << 20


def test_relations_are_written_without_a_codec(spark):
    """A codec's buffers outside the heap are as large as a page, and a page holds a hundred rows at least, however large."""
    import os

    import pyarrow.parquet as pq

    (path,) = {os.path.dirname(f) for f in phrases._written(spark.range(9)).inputFiles()}
    local = path.removeprefix("file://")
    files = [f for f in os.listdir(local) if f.endswith(".parquet")]
    assert files and {pq.read_metadata(f"{local}/{f}").row_group(0).column(0).compression for f in files if pq.read_metadata(f"{local}/{f}").num_rows} == {"UNCOMPRESSED"}

"""Queries on rows of larger tables: long ids, and values next to a half. Compared with SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tessella.functions import paths as pa
from tessella.functions.rules import half_up
from tessella.plans import load, registry
from tessella.sources import annotations as an

NAMES = "l_orderkey long, l_linenumber int, l_returnflag string, l_linestatus string, l_extendedprice double, l_partkey long, l_suppkey long, l_quantity double, l_shipdate string"


def both(spark, folder, name, rows):
    """The query's rows and its SQL's, sorted, on one small lineitem table."""
    load()
    spark.createDataFrame(rows, NAMES).coalesce(1).write.mode("overwrite").parquet(f"{folder}/lineitem.parquet")
    got = registry.QUERIES[name](spark, str(folder))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{folder}/lineitem.parquet/*.parquet'")
    cur = con.execute(registry.ORACLES[name])
    cols = [c[0] for c in cur.description]
    return sorted(tuple(r) for r in got.select(*cols).collect()), sorted(cur.fetchall())


def row(order, line, part=10, supp=4, quantity=45.0):
    return (order, line, "A", "F", 1000.0, part, supp, quantity, "1996-01-01")


def test_lengths_next_to_a_half(spark, tmp_path):
    got, want = both(spark, tmp_path, "P17_path_length_and_thinning", [row(129886, 5), row(417099, 3, 47, 3, 32.0), row(26126, 7, 20, 6, 39.0), row(7, 1)])
    assert got == want


def test_path_that_returns_to_its_start(spark, tmp_path):
    got, want = both(spark, tmp_path, "P17_path_length_and_thinning", [row(12006377, 4, 7978, 40, 49.0), row(7, 1)])
    assert got == want and (12006377401, 9.152982, 1) in got


def test_thinning_keeps_a_path_of_one_place_whole(spark):
    pts = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]
    p = spark.createDataFrame([(pts,), (pts[:1],)], "pts array<struct<x double, y double>>")
    sizes = p.select(F.size(pa.far_points(F.col("pts"), 4.0)), F.size(pa.drop_near_points(F.col("pts"), 4.0))).collect()
    assert [tuple(r) for r in sizes] == [(1, 4), (1, 1)]


@pytest.mark.parametrize("value", [129.9107695, 232.69352849999999, -0.0000005, 0.0, 2.5, -129.9107695, 1e-9])
def test_half_up_like_sql(spark, value):
    got = spark.range(1).select(half_up(F.lit(value), 6)).first()[0]
    assert got == duckdb.connect().execute("SELECT round(?::DOUBLE, 6)", [value]).fetchone()[0]


def test_ids_beyond_32_bits(spark, tmp_path):
    got, want = both(spark, tmp_path, "S06_tracking_text", [row(8_999_999, line) for line in range(1, 8)])
    assert got == want and len(got) == 4


def test_ids_below_zero(spark):
    lines = spark.createDataFrame([("1,-1,a",), ("1,-0.5,a",), ("1,0,a",), ("1,1e30,a",), ("1,9000000000,a",)], "value string")
    rows, _ = an.tracking_rows(an.tracking_fields(lines, "value"), 0, 1)
    assert [r.cells[1] for r in rows.collect()] == ["-0.5", "0", "1e30", "9000000000"]


def test_ids_that_repeat_digits(spark, tmp_path):
    rows = [row(o, line, part) for o in (4_444_444, 1_414_141, 1_111_111_111_111, 15) for part, line in enumerate((1, 4, 6), 1)]
    got, want = both(spark, tmp_path, "J05_fuse_text_sources", rows)
    assert got == want and any("{4444444401}" in r[2] for r in got)

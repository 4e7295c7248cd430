"""SQL names of the scalar functions give what the column expressions give."""

import pytest
from pyspark.sql import functions as F

from orrery.functions import scalars as sc
from orrery.functions.sql import register


def test_sql_functions(spark):
    register(spark)
    df = spark.createDataFrame([(55.75, 37.62, 59.94, 30.31, 24299, 0.0123456), (0.0, 0.0, 0.0, 180.0, 23990, -2.5)], "a double, b double, c double, d double, m long, x double")
    df.createOrReplaceTempView("t")
    got = spark.sql("SELECT haversine_km(a, b, c, d), proximity(a, 300D), quarter_key(m), round_cut(x), month_number(timestamp'2024-12-05 00:00:00') FROM t ORDER BY m").collect()
    want = df.orderBy("m").select(sc.haversine(*map(F.col, "abcd")), sc.proximity(F.col("a"), 300.0), sc.quarter_key(F.col("m")), sc.round_cut(F.col("x")), F.lit(2024 * 12 + 11)).collect()
    for a, b in zip(got, want, strict=True):
        assert a[2] == b[2] and a[4] == b[4] and [a[0], a[1], a[3]] == pytest.approx([b[0], b[1], b[3]])
    assert got[0][0] == pytest.approx(20015.09, abs=0.1) and got[1][0] == pytest.approx(634, abs=3)


def test_unescape(spark):
    df = spark.createDataFrame([("a\\u0434b",), ('q"x',), ("plain",)], "t string")
    assert [r[0] for r in df.select(sc.unescape_unicode(F.col("t"))).collect()] == ["aдb", 'q"x', "plain"]

"""Intermediate tables in sessions with and without a shared folder, and joins of hot keys."""

import os
import subprocess
import sys
import textwrap

import pytest
from pyspark.sql import functions as F

from orrery import tables
from orrery.operators.components import components
from orrery.skew import hot_keys, salted_join

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def in_plain_session(tmp_path, body, master="local[2]"):
    """Runs body in a process of its own whose Spark has no settings at all."""
    head = f"""
    from pyspark.sql import SparkSession
    spark = SparkSession.builder.master("{master}").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
    assert spark.conf.get("spark.checkpoint.dir", None) is None
    """
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": ROOT}
    done = subprocess.run([sys.executable, "-c", textwrap.dedent(head) + textwrap.dedent(body)], env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]


def test_without_a_shared_folder(tmp_path):
    in_plain_session(
        tmp_path,
        """
        import __spark_entry__ as e
        d = "/root/testdata/sf0.001"
        for name in ("connected_components", "kruskal_wallis", "threshold_graph"):
            assert e.queries()[name](spark, d).count() > 0
        """,
    )


def test_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master, applicationId = "spark://host:7077", "app"

    class Conf:
        get = staticmethod(lambda name, default=None: default)

    class Session:
        sparkContext, conf = Context, Conf

    with pytest.raises(RuntimeError, match="checkpoint"):
        tables.folder(Session)


def test_drop(spark):
    t = tables.written(spark.range(10))
    path = tables._paths[id(t)][1]
    assert t.count() == 10
    tables.drop(t, spark.range(3))
    assert not os.path.exists(path.removeprefix("file://")) and id(t) not in tables._paths


def test_hot_keys_and_salted_join(spark):
    rows = tables.written(spark.range(3000).select("id", F.when(F.col("id") < 1000, 7).when(F.col("id") < 1500, F.lit(None)).otherwise(F.col("id") % 900).cast("int").alias("k")))
    hot = hot_keys(rows, ["k"])
    found = {r["k"]: r["_parts"] for r in hot.collect()}
    assert set(found) == {None, 7} and found[7] > 8
    groups = spark.range(0, 900, 2).select(F.col("id").cast("int").alias("k"), (F.col("id") * 10).alias("v")).union(spark.sql("SELECT 7, 70L"))
    for how in ("inner", "left", "left_semi"):
        got = salted_join(rows, groups, ["k"], how)
        want = rows.join(groups, "k", how)
        assert sorted(map(repr, got.select(*want.columns).collect())) == sorted(map(repr, want.collect()))

def test_components_of_hubs_and_chains(spark):
    star = [(0, i) for i in range(1, 200)]
    chain = [(i, i + 1) for i in range(1000, 1060)]
    edges = spark.createDataFrame(star + chain + [(5000, 4000)], "src long, dst long")
    nodes = spark.createDataFrame([(i,) for i in [*range(200), *range(1000, 1061), 4000, 5000, 9999]], "id long")
    got = {r["id"]: r["component"] for r in components(edges, nodes).collect()}
    assert got == {**dict.fromkeys(range(200), 0), **dict.fromkeys(range(1000, 1061), 1000), 4000: 4000, 5000: 4000, 9999: 9999}

"""Connected components of a distributed edge table by least labels with shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.skew import hot_keys, salted_join
from orrery.tables import drop, written


def least_labels(links: DataFrame) -> DataFrame:
    """links (u, v), in one direction or both: (u, l), the least node that links reach, for every node that has one.

    Each round takes the least label among a node and its neighbours, then the label of that label; rounds grow with
    the logarithm of the longest path. A hub's links are dealt over several tasks, and so are the nodes of a large
    component when they ask for their common label's label; sums combine before the shuffle. Labels are written to
    the shared folder in each round, and the last round's are dropped."""
    both = written(links.select("u", "v").union(links.select("v", "u")).filter("u <> v").distinct(), "edges")
    hubs = hot_keys(both, ["v"])
    label = written(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("l")), "labels")
    while True:
        seen = salted_join(both, label.select(F.col("u").alias("v"), "l"), ["v"], hot=hubs).groupBy("u").agg(F.min("l").alias("m"))
        near = written(label.join(seen, "u").select("u", "l", F.least("l", "m").alias("m")), "labels")
        far = label.select(F.col("u").alias("m"), F.col("l").alias("far"))
        step = written(salted_join(near, far, ["m"]).select("u", F.least("m", "far").alias("l"), (F.least("m", "far") < F.col("l")).alias("changed")), "labels")
        drop(near, label)
        if step.filter("changed").isEmpty():
            drop(both)
            return step
        label = step


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, component): the least id that edges reach; nodes without edges are their own component."""
    found = least_labels(edges.select(F.col("src").alias("u"), F.col("dst").alias("v")))
    own = nodes.select("id").join(found.withColumnRenamed("u", "id"), "id", "left")
    return own.select("id", F.coalesce("l", "id").alias("component"))

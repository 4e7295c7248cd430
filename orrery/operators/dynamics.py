"""Refinement of partitions and their smoothing over windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.operators.measures import long_form


def refine_costs(nodes: DataFrame, edges: DataFrame, labels: DataFrame, weight: float) -> DataFrame:
    """(id, cluster, cost): n * [(1 - w) * |x - c|^2 / T_x + w * |p - l|^2 / T_p], where p is a node's row of links less
    what its strength explains (w_ij - d_i d_j / S) and l the mean of p over the cluster. The rows p are never built:
    norms and products follow from sums over edges."""
    n = nodes.count()
    ids = labels.select("id", "label")
    size = ids.groupBy(F.col("label").alias("k")).agg(F.count(F.lit(1)).cast("double").alias("nk"))
    # Attributes.
    x = long_form(nodes.select("id", "features").join(ids, "id"), "id", "label")
    g = x.groupBy("dim").agg(F.avg("x").alias("g"))
    tx = x.join(F.broadcast(g), "dim").agg(F.sum(F.pow(F.col("x") - F.col("g"), 2)).alias("tx"))
    c = x.groupBy(F.col("label").alias("k"), "dim").agg(F.avg("x").alias("c"))
    dx = x.select("id", "dim", "x").join(F.broadcast(c), "dim").groupBy("id", "k").agg(F.sum(F.pow(F.col("x") - F.col("c"), 2)).alias("dx"))
    # Links.
    d = ids.select("id").join(edges.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("d")), "id", "left").fillna(0.0, ["d"])
    tot = d.agg(F.sum("d").alias("s"), F.sum(F.pow("d", 2)).alias("q"))
    e = edges.join(d.select(F.col("id").alias("dst"), F.col("d").alias("dj")), "dst")
    node = d.join(e.groupBy(F.col("src").alias("id")).agg(F.sum(F.col("w") * F.col("dj")).alias("a"), F.sum(F.pow("w", 2)).alias("w2")), "id", "left").fillna(0.0, ["a", "w2"])
    link = edges.join(ids.select(F.col("id").alias("src"), F.col("label").alias("k")), "src").groupBy("k", F.col("dst").alias("j")).agg(F.sum("w").alias("l"))
    dk = d.join(ids, "id").groupBy(F.col("label").alias("k")).agg(F.sum("d").alias("dk"))
    lk = link.join(d.select(F.col("id").alias("j"), F.col("d").alias("dj")), "j").groupBy("k").agg(F.sum(F.col("dj") * F.col("l")).alias("dl"), F.sum(F.pow("l", 2)).alias("l2"))
    k = size.join(dk, "k").join(lk, "k", "left").fillna(0.0, ["dl", "l2"])
    wl = edges.withColumnRenamed("dst", "j").join(link, "j").groupBy(F.col("src").alias("id"), "k").agg(F.sum(F.col("w") * F.col("l")).alias("wl"))
    every = node.withColumn("k", F.explode(F.array(*[F.lit(r["k"]) for r in size.select("k").orderBy("k").collect()])))
    t = every.join(F.broadcast(k), "k").join(wl, ["id", "k"], "left").fillna(0.0, ["wl"]).crossJoin(F.broadcast(tot))
    p2 = F.col("w2") - 2 * F.col("d") * F.col("a") / F.col("s") + F.pow("d", 2) * F.col("q") / F.pow("s", 2)
    pl = (F.col("wl") - F.col("a") * F.col("dk") / F.col("s") - F.col("d") * F.col("dl") / F.col("s") + F.col("d") * F.col("dk") * F.col("q") / F.pow("s", 2)) / F.col("nk")
    l2 = (F.col("l2") - 2 * F.col("dk") / F.col("s") * F.col("dl") + F.pow("dk", 2) * F.col("q") / F.pow("s", 2)) / F.pow("nk", 2)
    t = t.select("id", "k", p2.alias("p2"), (p2 - 2 * pl + l2).alias("dp"))
    tp = t.groupBy("id").agg(F.first("p2").alias("p2")).agg(F.sum("p2").alias("tp"))
    cost = n * ((1 - weight) * F.col("dx") / F.col("tx") + weight * F.col("dp") / F.col("tp"))
    return t.join(dx, ["id", "k"]).crossJoin(F.broadcast(tx.crossJoin(tp))).select("id", F.col("k").alias("cluster"), cost.alias("cost"))


def refine_step(costs: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, label): the cheapest cluster (ties: the lower one), or the old labels if a cluster would be left empty."""
    best = costs.groupBy("id").agg(F.min(F.struct("cost", "cluster")).alias("m")).select("id", F.col("m.cluster").alias("new"))
    both = labels.select("id", F.col("label").alias("old")).join(best, "id")
    kinds = both.agg(F.countDistinct("new").alias("kn"), F.countDistinct("old").alias("ko"))
    return both.crossJoin(F.broadcast(kinds)).select("id", F.when(F.col("kn") == F.col("ko"), F.col("new")).otherwise(F.col("old")).alias("label"))


def temporal_smoothing(costs: DataFrame, factor: float) -> DataFrame:
    """costs (id, t, cluster, cost): weighted means over windows with weights factor ** |t - s|, and the cheapest cluster."""
    a = costs.select("id", "cluster", F.col("t").alias("s"), "cost")
    now = costs.select("id", "t", "cluster")
    w = F.pow(F.lit(factor), F.abs(F.col("t") - F.col("s")))
    return now.join(a, ["id", "cluster"]).groupBy("id", "t", "cluster").agg((F.sum(w * F.col("cost")) / F.sum(w)).alias("cost"))


def cheapest(costs: DataFrame, *by: str) -> DataFrame:
    return costs.groupBy(*by).agg(F.min(F.struct("cost", "cluster")).alias("m")).select(*by, F.col("m.cluster").alias("cluster"))


def affect_weight(past: DataFrame, now: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: the weight of the past from block means and variances of the current layer, given labels (id, label)."""
    size = labels.groupBy("label").agg(F.count(F.lit(1)).cast("double").alias("n"))
    pairs = size.select(F.col("label").alias("ci"), F.col("n").alias("ni")).crossJoin(F.broadcast(size.select(F.col("label").alias("cj"), F.col("n").alias("nj"))))
    cells = pairs.withColumn("c", F.col("ni") * F.col("nj") - F.when(F.col("ci") == F.col("cj"), F.col("ni")).otherwise(0.0))

    def by_block(e: DataFrame, *aggs) -> DataFrame:
        a = labels.select(F.col("id").alias("src"), F.col("label").alias("ci"))
        b = labels.select(F.col("id").alias("dst"), F.col("label").alias("cj"))
        return e.join(a, "src").join(b, "dst").groupBy("ci", "cj").agg(*aggs)

    cur = by_block(now, F.sum("w").alias("w1"), F.sum(F.pow("w", 2)).alias("w2"))
    old = by_block(past, F.sum("w").alias("s1"), F.sum(F.pow("w", 2)).alias("s2"))
    t = cells.join(cur, ["ci", "cj"], "left").join(old, ["ci", "cj"], "left").fillna(0.0, ["w1", "w2", "s1", "s2"]).filter("c > 0")
    mean = F.col("w1") / F.col("c")
    var = F.greatest(F.coalesce(F.try_divide(F.col("w2") - F.col("c") * F.pow(mean, 2), F.col("c") - 1), F.lit(0.0)), F.lit(0.0))
    s = t.agg(F.sum(F.col("c") * var).alias("noise"), (F.sum("s2") - 2 * F.sum(mean * F.col("s1")) + F.sum(F.col("c") * F.pow(mean, 2))).alias("bias"))
    return s.select(F.try_divide("noise", F.col("bias") + F.col("noise")).alias("a"))


def nearest_centre(nodes: DataFrame, centres: DataFrame) -> DataFrame:
    """(id, label): the nearest of few centres (label, features)."""
    c = long_form(centres, "label").withColumnRenamed("x", "c")
    d = long_form(nodes, "id").join(F.broadcast(c), "dim").groupBy("id", "label").agg(F.round(F.sum(F.pow(F.col("x") - F.col("c"), 2)), 9).alias("cost"))
    return cheapest(d.withColumnRenamed("label", "cluster"), "id").withColumnRenamed("cluster", "label")


def relabel(labels: DataFrame) -> DataFrame:
    """Labels by falling cluster size; ties go to the lower old label."""
    n = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    new = n.select("label", (F.row_number().over(Window.orderBy(F.desc("n"), "label")) - 1).alias("new"))
    return labels.join(F.broadcast(new), "label").select("id", F.col("new").alias("label"))


def aligned(df: DataFrame, jaccard: bool = False) -> DataFrame:
    """df (id, x, y): x renumbered to have most nodes in common with y (or the largest overlap, in shares of both). Only
    the table of counts by x and y leaves the cluster."""
    from orrery.operators.clustering import best_match

    cells = df.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")).collect()  # clusters by clusters
    to = best_match({(r["x"], r["y"]): r["n"] for r in cells}, jaccard)
    if not to:
        return df.select("id", F.col("x").cast("int").alias("label"))
    table = df.sparkSession.createDataFrame([(int(k), int(v)) for k, v in to.items()], "x int, label int")
    return df.select("id", F.col("x").cast("int").alias("x")).join(F.broadcast(table), "x").select("id", "label")

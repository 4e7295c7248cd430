"""Graph measures and cluster-quality metrics as joins and aggregations over edge and node tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def block_sums(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(ci, cj, s): sums of weights between clusters; labels (id, label)."""
    a = labels.select(F.col("id").alias("src"), F.col("label").alias("ci"))
    b = labels.select(F.col("id").alias("dst"), F.col("label").alias("cj"))
    return edges.join(a, "src").join(b, "dst").groupBy("ci", "cj").agg(F.sum("w").alias("s"))


def cluster_scores(sums: DataFrame, sizes: DataFrame) -> DataFrame:
    """One row: avi, avu, anui, mq, dm, within. sizes (label, n)."""
    total = sums.agg(F.sum("s").alias("m2"))
    rows = sums.groupBy(F.col("ci").alias("label")).agg(F.sum("s").alias("t"), F.sum(F.when(F.col("ci") == F.col("cj"), F.col("s")).otherwise(0.0)).alias("own"))
    per = sizes.join(rows, "label", "left").fillna(0.0, ["t", "own"]).crossJoin(F.broadcast(total)).withColumn("o", F.col("t") - F.col("own"))
    first = per.agg(
        F.avg(F.coalesce(F.try_divide("own", "t"), F.lit(0.0))).alias("avi"),
        F.sum(F.col("own") / F.col("m2") - F.pow(F.col("t") / F.col("m2"), 2)).alias("mq"),
        F.sum((F.col("own") / 2 - F.pow("t", 2) / (2 * F.col("m2"))) / F.col("n")).alias("dm"),
        F.sum(F.col("own") / F.col("m2")).alias("within"),
        F.count(F.lit(1)).alias("k"),
    )
    out = per.select("label", "o")
    pairs = sums.filter("ci <> cj").join(out.select(F.col("label").alias("ci"), F.col("o").alias("oi")), "ci").join(out.select(F.col("label").alias("cj"), F.col("o").alias("oj")), "cj")
    rest = F.col("oi") + F.col("oj") - F.col("s")
    shared = pairs.agg(F.coalesce(F.sum(F.when(rest > 0, F.col("s") / rest).otherwise(0.0)), F.lit(0.0)).alias("u"))
    both = first.crossJoin(shared).withColumn("avu", F.coalesce(F.try_divide("u", F.col("k") * (F.col("k") - 1)), F.lit(0.0)))
    return both.select("avi", "avu", (F.col("avi") / (1 + F.col("avi") * F.col("avu"))).alias("anui"), "mq", "dm", "within")


def mixing(sums: DataFrame) -> DataFrame:
    """One row: within share and the share expected from strengths alone."""
    total = sums.agg(F.sum("s").alias("m2"))
    rows = sums.groupBy("ci").agg(F.sum("s").alias("t"), F.sum(F.when(F.col("ci") == F.col("cj"), F.col("s")).otherwise(0.0)).alias("own")).crossJoin(F.broadcast(total))
    return rows.agg(F.sum(F.col("own") / F.col("m2")).alias("within"), F.sum(F.pow(F.col("t") / F.col("m2"), 2)).alias("expected"))


def type_affinity(sums: DataFrame, sizes: DataFrame) -> DataFrame:
    """(ci, cj, affinity): mean weight between members, scaled so that each type with itself is 1."""
    n = sizes.select("label", "n")
    b = sums.join(n.select(F.col("label").alias("ci"), F.col("n").alias("ni")), "ci").join(n.select(F.col("label").alias("cj"), F.col("n").alias("nj")), "cj").withColumn("b", F.col("s") / (F.col("ni") * F.col("nj")))
    own = b.filter("ci = cj").select(F.col("ci").alias("c"), "b")
    return b.join(own.select(F.col("c").alias("ci"), F.col("b").alias("bi")), "ci").join(own.select(F.col("c").alias("cj"), F.col("b").alias("bj")), "cj").select("ci", "cj", (F.col("b") / F.sqrt(F.col("bi") * F.col("bj"))).alias("affinity"))


def participation(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, participation, own_share, other_type, other_share); ties of the main other type go to the lower type."""
    b = labels.select(F.col("id").alias("dst"), F.col("label").alias("cj"))
    by = edges.join(b, "dst").groupBy(F.col("src").alias("id"), "cj").agg(F.sum("w").alias("s"))
    share = by.withColumn("share", F.try_divide(F.col("s"), F.sum("s").over(Window.partitionBy("id")))).join(labels, "id")
    other = F.when(F.col("cj") != F.col("label"), F.struct("share", (-F.col("cj")).alias("neg")))
    out = share.groupBy("id").agg((1 - F.sum(F.pow("share", 2))).alias("participation"), F.sum(F.when(F.col("cj") == F.col("label"), F.col("share")).otherwise(0.0)).alias("own_share"), F.max(other).alias("o"))
    return out.select("id", "participation", "own_share", (-F.col("o.neg")).alias("other_type"), F.coalesce("o.share", F.lit(0.0)).alias("other_share"))


def moran(edges: DataFrame, values: DataFrame, by: list[str]) -> DataFrame:
    """values (*by, id, x): Moran's I of each group of values on the row-normalised graph; isolated nodes have no row."""
    mean = values.groupBy(*by).agg(F.avg("x").alias("m"), F.count(F.lit(1)).alias("n"))
    z = values.join(mean, by).select(*by, "id", "n", (F.col("x") - F.col("m")).alias("z"))
    d = edges.groupBy("src").agg(F.sum("w").alias("d"))
    r = edges.join(d, "src").select("src", "dst", F.try_divide("w", "d").alias("r"))
    pairs = r.join(z.withColumnRenamed("id", "src"), "src").join(z.select(*by, F.col("id").alias("dst"), F.col("z").alias("zj")), [*by, "dst"])
    top = pairs.groupBy(*by).agg(F.sum(F.col("r") * F.col("z") * F.col("zj")).alias("num"), F.sum("r").alias("rows"))
    low = z.groupBy(*by).agg(F.sum(F.pow("z", 2)).alias("den"), F.first("n").alias("n"))
    return top.join(low, by).select(*by, (F.col("n") / F.col("rows") * F.try_divide("num", "den")).alias("moran"))


def clustering_coefficient(edges: DataFrame) -> DataFrame:
    """One row: the mean over nodes of the share of neighbour pairs that are linked (0 for degree below 2)."""
    e = edges.select("src", "dst")
    d = e.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("d"))
    low = e.filter("src < dst")
    wedge = low.join(low.select(F.col("src"), F.col("dst").alias("third")), "src").filter("dst < third")
    closed = wedge.join(low.select(F.col("src").alias("dst"), F.col("dst").alias("third")), ["dst", "third"])
    corner = reduce(DataFrame.union, [closed.select(F.col(c).alias("id")) for c in ("src", "dst", "third")]).groupBy("id").agg(F.count(F.lit(1)).alias("t"))
    share = F.when(F.col("d") > 1, 2 * F.coalesce("t", F.lit(0)) / (F.col("d") * (F.col("d") - 1))).otherwise(0.0)
    return d.join(corner, "id", "left").agg(F.avg(share).alias("clustering"))


def assortativity(edges: DataFrame) -> DataFrame:
    d = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).cast("double").alias("d"))
    pairs = edges.join(d.select(F.col("id").alias("src"), F.col("d").alias("x")), "src").join(d.select(F.col("id").alias("dst"), F.col("d").alias("y")), "dst")
    return pairs.agg(F.corr("x", "y").alias("assortativity"))


def edge_jaccard(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: common edges, all edges and their ratio."""
    one = lambda e, c: e.filter("src < dst").select("src", "dst", F.lit(1).alias(c))
    both = one(a, "x").join(one(b, "y"), ["src", "dst"], "full_outer")
    counts = both.agg(F.count(F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), 1)).alias("common"), F.count(F.lit(1)).alias("either"))
    return counts.withColumn("jaccard", F.try_divide(F.col("common").cast("double"), F.col("either").cast("double")))


# Feature-space metrics on (id, label, features array<double>), worked in long form (id, label, dim, x).


def long_form(nodes: DataFrame, *keep: str) -> DataFrame:
    return nodes.select(*keep, F.posexplode("features").alias("dim", "x"))


def calinski_harabasz(nodes: DataFrame) -> DataFrame:
    x = long_form(nodes, "id", "label")
    c = x.groupBy("label", "dim").agg(F.avg("x").alias("m"), F.count(F.lit(1)).alias("n"), F.var_pop("x").alias("v"))
    g = x.groupBy("dim").agg(F.avg("x").alias("g"))
    s = c.join(g, "dim").agg(F.sum(F.col("n") * F.pow(F.col("m") - F.col("g"), 2)).alias("b"), F.sum(F.col("n") * F.col("v")).alias("w"))
    k = nodes.agg(F.countDistinct("label").alias("k"), F.count(F.lit(1)).alias("n"))
    return s.crossJoin(k).select((F.col("b") / (F.col("k") - 1) / (F.col("w") / (F.col("n") - F.col("k")))).alias("ch"))


def _centres(nodes: DataFrame) -> DataFrame:
    return long_form(nodes, "id", "label").groupBy("label", "dim").agg(F.avg("x").alias("m"), F.var_pop("x").alias("v"))


def davies_bouldin(nodes: DataFrame) -> DataFrame:
    c = _centres(nodes)
    d = long_form(nodes, "id", "label").join(c, ["label", "dim"]).groupBy("label", "id").agg(F.sqrt(F.sum(F.pow(F.col("x") - F.col("m"), 2))).alias("d"))
    s = d.groupBy("label").agg(F.avg("d").alias("s"))
    pairs = c.join(c.select(F.col("label").alias("l2"), "dim", F.col("m").alias("m2")), "dim").filter("label <> l2").groupBy("label", "l2").agg(F.sqrt(F.sum(F.pow(F.col("m") - F.col("m2"), 2))).alias("sep"))
    r = pairs.join(s, "label").join(s.select(F.col("label").alias("l2"), F.col("s").alias("s2")), "l2")
    return r.groupBy("label").agg(F.max((F.col("s") + F.col("s2")) / F.col("sep")).alias("r")).agg(F.avg("r").alias("db"))


def s_dbw(nodes: DataFrame) -> DataFrame:
    """Scatter plus density between clusters, with ddof 0 variances."""
    x = long_form(nodes, "id", "label")
    c = _centres(nodes)
    norms = c.groupBy("label").agg(F.sqrt(F.sum(F.pow("v", 2))).alias("v"))
    whole = x.groupBy("dim").agg(F.var_pop("x").alias("v")).agg(F.sqrt(F.sum(F.pow("v", 2))).alias("g"))
    base = norms.agg(F.avg("v").alias("mean"), F.sum("v").alias("sum"), F.count(F.lit(1)).alias("k")).crossJoin(whole).select((F.col("mean") / F.col("g")).alias("scat"), (F.sqrt("sum") / F.col("k")).alias("radius"), "k")
    pairs = c.join(c.select(F.col("label").alias("l2"), "dim", F.col("m").alias("m2")), "dim").filter("label < l2")
    spots = F.explode(F.array(*[F.struct(F.lit(n).alias("at"), v.alias("p")) for n, v in ((0, F.col("m")), (1, F.col("m2")), (2, (F.col("m") + F.col("m2")) / 2))]))
    spots = pairs.select("label", "l2", "dim", spots.alias("q")).select("label", "l2", "dim", "q.at", "q.p")
    ends = F.explode(F.array("label", "l2")).alias("of")
    member = spots.select("label", "l2", "dim", "at", "p", ends).join(x.select(F.col("label").alias("of"), "dim", "id", "x"), ["of", "dim"])
    near = member.groupBy("label", "l2", "at", "id").agg(F.sqrt(F.sum(F.pow(F.col("x") - F.col("p"), 2))).alias("d")).crossJoin(F.broadcast(base)).filter("d <= radius")
    dens = near.groupBy("label", "l2").agg(*[F.count(F.when(F.col("at") == i, 1)).alias(f"d{i}") for i in range(3)])
    ratio = F.when(F.greatest("d0", "d1") > 0, F.col("d2") / F.greatest("d0", "d1")).otherwise(0.0)
    total = dens.agg(F.coalesce(F.sum(2 * ratio), F.lit(0.0)).alias("bw"))
    return base.crossJoin(total).select((F.col("scat") + F.coalesce(F.try_divide("bw", F.col("k") * (F.col("k") - 1)), F.lit(0.0))).alias("s_dbw"))


def silhouette(mean_distances: DataFrame, sizes: DataFrame) -> DataFrame:
    """mean_distances (id, label, cj, total): the sum of distances from a node to cluster cj. One row: the mean silhouette."""
    d = mean_distances.join(sizes.select(F.col("label").alias("cj"), "n"), "cj")
    own = F.when(F.col("cj") == F.col("label"), F.try_divide("total", F.col("n") - 1))
    other = F.when(F.col("cj") != F.col("label"), F.col("total") / F.col("n"))
    ab = d.groupBy("id", "label").agg(F.max(own).alias("a"), F.min(other).alias("b")).join(sizes, "label")
    s = F.when(F.col("n") > 1, F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))).otherwise(0.0)
    return ab.agg(F.avg(s).alias("silhouette"))


# Comparisons of two labelings, from a table (x, y) with a row for each node.


def _pairs2(n: Column) -> Column:
    return n * (n - 1) / 2


def adjusted_rand(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """ari, by group if asked for."""
    by = by or []
    cells = df.groupBy(*by, "x", "y").agg(F.count(F.lit(1)).cast("double").alias("n"))
    rows = cells.groupBy(*by, "x").agg(F.sum("n").alias("n")).groupBy(*by).agg(F.sum(_pairs2(F.col("n"))).alias("a"), F.sum("n").alias("t"))
    cols = cells.groupBy(*by, "y").agg(F.sum("n").alias("n")).groupBy(*by).agg(F.sum(_pairs2(F.col("n"))).alias("b"))
    both = cells.groupBy(*by).agg(F.sum(_pairs2(F.col("n"))).alias("c"))
    j = rows.join(cols, by).join(both, by) if by else rows.crossJoin(cols).crossJoin(both)
    e = F.col("a") * F.col("b") / _pairs2(F.col("t"))
    return j.select(*by, F.coalesce(F.try_divide(F.col("c") - e, (F.col("a") + F.col("b")) / 2 - e), F.lit(1.0)).alias("ari"))


def agreement(partitions: DataFrame) -> DataFrame:
    """partitions (name, id, label): (one, two, ari) for each two names, in either order."""
    a = partitions.select("id", F.col("name").alias("one"), F.col("label").alias("x"))
    b = partitions.select("id", F.col("name").alias("two"), F.col("label").alias("y"))
    return adjusted_rand(a.join(b, "id").filter("one <> two"), ["one", "two"])


def nmi(df: DataFrame) -> DataFrame:
    """Mutual information over the mean of both entropies."""
    cells = df.groupBy("x", "y").agg(F.count(F.lit(1)).cast("double").alias("n"))
    t = cells.agg(F.sum("n").alias("t"))
    rows, cols = (cells.groupBy(c).agg(F.sum("n").alias(f"n{c}")) for c in "xy")
    mi = cells.join(rows, "x").join(cols, "y").crossJoin(F.broadcast(t)).agg(F.sum(F.col("n") / F.col("t") * F.ln(F.col("n") * F.col("t") / (F.col("nx") * F.col("ny")))).alias("mi"))
    h = lambda d, c: d.crossJoin(F.broadcast(t)).agg((-F.sum(F.col(f"n{c}") / F.col("t") * F.ln(F.col(f"n{c}") / F.col("t")))).alias(f"h{c}"))
    return mi.crossJoin(h(rows, "x")).crossJoin(h(cols, "y")).select(F.coalesce(F.try_divide("mi", (F.col("hx") + F.col("hy")) / 2), F.lit(1.0)).alias("nmi"))


def nesting(df: DataFrame) -> DataFrame:
    """Share of nodes in the largest y of their x."""
    cells = df.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))
    return cells.groupBy("x").agg(F.max("n").alias("m"), F.sum("n").alias("t")).agg((F.sum("m") / F.sum("t")).alias("nesting"))

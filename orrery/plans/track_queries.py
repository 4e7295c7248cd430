"""Tracking over windows, panels of metrics, sweeps, ablations, resampling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.operators import clustering as cl
from orrery.operators import graph as g
from orrery.operators import measures as ms
from orrery.operators import ranking as rk
from orrery.operators import relational as rl
from orrery.operators import series
from orrery.operators import timewin as tw
from orrery.operators import tracking as tr
from orrery.operators import transform as tf
from orrery.plans.cluster_queries import grid
from orrery.plans.graph_queries import PAIRS, edges, knn_sql, labels, nodes
from orrery.plans.panel_queries import FIRST, LAST, TYPES, P, panel, quarters
from orrery.plans.registry import query, r6, rounded, table
from orrery.tables import written

def window_features(spark, d: str) -> DataFrame:
    """Suppliers' log ratios and level in calendar years: (t, id, features), of the suppliers that have all years."""
    p = panel(spark, d).withColumn("t", F.floor(F.col("m") / 12)).filter(F.col("t") < 2001)
    w = written(rl.wide(p, ["id", "t"], "cat", TYPES, F.sum("v")), "years").withColumn("total", sum((F.col(t) for t in TYPES), F.lit(0.0)))
    w = tw.with_relative_level(w, "total", ["t"])
    s = rl.shares(w, TYPES, "total").select("id", "t", *(c.alias(t) for t, c in zip(TYPES, tf.centred_log_ratio(TYPES), strict=True)), "rel")
    z = tf.block_weighted(tf.clipped_scores(s, [*TYPES, "rel"]), [TYPES, ["rel"]])
    return written(rl.complete(z, "id", "t", 6).select("t", "id", F.array(*TYPES, "rel").alias("features")), "windows")


@query()
def track_types(spark, d):
    """Types over time: graph of all windows, spectral clusters, refinement smoothed over windows."""
    return tr.track(window_features(spark, d), ["refined"], 6).select("t", "id", "label")


APPROACHES = ["independent", *(f"evolved {a}" for a in (0.3, 0.5, 0.7, 0.8, 0.9)), "affect", *(f"supra {c}" for c in (0.1, 0.3, 1.0, 3.0, 10.0)), "refined 1.0", "fixed"]


@query()
def compare_dynamics(spark, d):
    """Quality and steadiness of all approaches to types over time, on the suppliers that all windows have."""
    return rounded(tr.evaluate(window_features(spark, d), APPROACHES, 6), *tr.EVALUATION)


@query()
def dynamics_changes(spark, d):
    """Change shares of six approaches."""
    out = tr.track(window_features(spark, d), ["independent", "evolved", "affect", "supra", "refined", "fixed"], 6)
    return rounded(tr.change_shares(out), "changed", "first_last")


@query()
def monthly_schemes(spark, d):
    """Four schemes of types over time: single months or rolling years, each window apart or all together."""
    return rounded(tr.scheme_changes(panel(spark, d), TYPES, 6), "changed", "flip_back")


@query()
def sensitivity(spark, d):
    """Seventy-two settings of neighbours, weight of the graph, number of types and coupling, against the chosen one."""
    cells = [(g_, a, k, c) for g_ in (10, 15) for a in (0.2, 0.3, 0.4) for k in (5, 6, 7) for c in (0.5, 1.0, 2.0, 3.0)]
    return rounded(tr.sensitivity(window_features(spark, d), cells, (10, 0.3, 6, 1.0)), *tr.SENSITIVITY)


def wide_grid(spark, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "config long, method string, k int, alpha double, seed int, weight double, block string")


@query()
def metric_panel(spark, d):
    """All metrics with their lifts over permuted labels, by configuration."""
    rows = [(m, k, a, 0, None, None) for m, a in (("kmeans", None), ("ward", None), ("spectral", None), ("fused_spectral", 0.3), ("refined_spectral", 0.3)) for k in (5, 10)]
    out = tr.panel_grid(nodes(spark, d), edges(spark, d), wide_grid(spark, rows))
    return rounded(out.select("config", "method", "k", "alpha", *tr.METRICS), *tr.METRICS)


@query()
def method_ranking(spark, d):
    """Methods ranked by thirds of six indices."""
    rows = [(m, 10, a, 0, None, None) for m, a in (("kmeans", None), ("ward", None), ("spectral", None), ("fused_spectral", 0.2), ("fused_spectral", 0.5), ("refined_spectral", 0.2), ("refined_spectral", 0.5))]
    p = tr.panel_grid(nodes(spark, d), edges(spark, d), wide_grid(spark, rows)).withColumn("name", F.concat_ws(" ", "method", F.col("alpha").cast("string")))
    return rk.tercile_ranking(p, "name", {"SW": 1, "CH": 1, "S_Dbw": -1, "AVI": 1, "AVU": -1, "MQ": 1})


@query()
def refinement_sweep(spark, d):
    """Metrics of the refined method by the weight of links, each graded as if it stood in the methods' ranking."""
    rows = [("refined_spectral", 10, 0.3, 0, w, None) for w in (0.0, 0.3, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)]
    base = [(m, 10, a, 0, None, None) for m, a in (("kmeans", None), ("ward", None), ("spectral", None), ("fused_spectral", 0.2), ("fused_spectral", 0.5), ("kefrin", 0.3))]
    p = written(tr.panel_grid(nodes(spark, d), edges(spark, d), wide_grid(spark, rows + base)))
    signs = {"SW": 1, "CH": 1, "S_Dbw": -1, "AVI": 1, "AVU": -1, "MQ": 1}
    graded = rk.graded_against(p.filter("weight IS NOT NULL"), p.filter("weight IS NULL"), signs)
    return rounded(graded.select("weight", "SW", "MQ", "within", "worst", "best"), "SW", "MQ", "within")


@query()
def block_ablation(spark, d):
    """Metrics with one block of features left out."""
    blocks = {"all": list(range(64)), "without_first": list(range(16, 64)), "without_second": [*range(16), *range(40, 64)], "without_third": list(range(40))}
    rows = [("refined_spectral", 10, 0.3, 0, None, b) for b in blocks]
    return rounded(tr.panel_grid(nodes(spark, d), edges(spark, d), wide_grid(spark, rows), blocks).select("block", "SW", "MQ", "within"), "SW", "MQ", "within")


@query()
def hierarchy(spark, d):
    """How far clusters of k + 1 lie within clusters of k."""
    g3 = grid(spark, [("refined_spectral", k, 0.3) for k in (3, 4, 5)])
    out = cl.run_grid(nodes(spark, d), edges(spark, d), g3)
    rows = []
    for i in (0, 1):
        pair = out.filter(F.col("config") == i + 1).select("id", F.col("label").alias("x")).join(out.filter(F.col("config") == i).select("id", F.col("label").alias("y")), "id")
        rows.append(ms.nesting(pair).select(F.lit(3 + i).alias("k"), r6("nesting").alias("nesting")))
    return rows[0].unionByName(rows[1])


@query()
def type_rules(spark, d):
    """A describing rule for each region of nations, by beam search on customers, with its precision and recall there and
    on the suppliers, which the search doesn't see."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_regionkey").alias("type"))
    rows = lambda name, p: table(spark, d, name).select(F.col(f"{p}_nationkey").alias("key"), F.col(f"{p}_acctbal").alias("balance")).join(F.broadcast(n), "key").select("type", "balance", F.col("key").cast("double").alias("code"))  # nations are fixed in number
    seen, other = written(rows("customer", "c")), written(rows("supplier", "s"))
    out = []
    for t in sorted(r["type"] for r in seen.select("type").distinct().collect()):  # regions are fixed in number
        rule = rk.rule_search(seen, ["balance", "code"], F.col("type") == t, [i / 10 for i in range(1, 10)])
        scores = [rk.rule_score(df, rule, F.col("type") == t) for df in (seen, other)]
        out.append((t, rk.rule_text(rule), *(float(v) for s in scores for v in s)))
    return rounded(spark.createDataFrame(out, "type int, rule string, precision double, recall double, f1 double, precision_other double, recall_other double, f1_other double"), *(c + e for e in ("", "_other") for c in ("precision", "recall", "f1")))


@query("""WITH r AS (SELECT run::INTEGER AS run, vec_id AS id, row_number() OVER (PARTITION BY run ORDER BY md5(run || ':' || vec_id), vec_id) AS r FROM embeddings, (SELECT unnest(range(1, 6)) AS run))
SELECT run, id FROM r WHERE r <= (SELECT CAST(floor(0.9 * count(*)) AS BIGINT) FROM embeddings)""")
def subsamples(spark, d):
    """Five subsamples of 90 % without replacement, by seeded order."""
    ids = labels(spark, d).select("id")
    n = int(0.9 * ids.count())
    run = ids.withColumn("run", F.explode(F.sequence(F.lit(1), F.lit(5))))
    order = F.md5(F.concat_ws(":", F.col("run").cast("string"), F.col("id").cast("string")).cast("binary"))
    return run.withColumn("r", F.row_number().over(Window.partitionBy("run").orderBy(order, "id"))).filter(F.col("r") <= n).select("run", "id")


@query()
def network_summary(spark, d):
    """Small-world ratio: clustering and paths against degree-preserving rewirings."""
    e = edges(spark, d)
    c = ms.clustering_coefficient(e)
    r = series.rewired(e, [1, 2, 3]).agg(F.avg("clustering").alias("random"))
    path = series.path_lengths(e, nodes(spark, d)).agg((F.sum("total") / F.sum("reached")).alias("mean_path"))
    return c.crossJoin(r).crossJoin(path).select(r6("clustering").alias("clustering"), r6("random").alias("random"), r6(F.col("clustering") / F.col("random")).alias("ratio"), r6("mean_path").alias("mean_path"))


@query()
def leaf_order(spark, d):
    """Order of the labels by average linkage of their centres."""
    import numpy as np

    c = ms.long_form(nodes(spark, d), "label").groupBy("label", "dim").agg(F.avg("x").alias("x")).groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("f")).orderBy("label").collect()  # a row a label
    x = np.array([r["f"] for r in c])
    order = tr.leaf_order(np.sqrt(cl.squared_distances(x, x)))
    return spark.createDataFrame([(i, int(c[j]["label"])) for i, j in enumerate(order)], "place int, label int")


# With SQL twins.

RULES_SQL = f"""WITH {PAIRS}, {knn_sql(5, 'a')}, {knn_sql(10, 'b')}, {knn_sql(20, 'c')}, m AS (SELECT x.i AS src, x.j AS dst, least(x.w, y.w) AS w FROM b_d x JOIN b_d y ON x.i = y.j AND x.j = y.i),
u AS (SELECT 'knn5' AS rule, * FROM a UNION ALL SELECT 'knn10', * FROM b UNION ALL SELECT 'knn20', * FROM c UNION ALL SELECT 'mutual10', * FROM m)
SELECT rule, count(*) AS links, count(DISTINCT src) AS nodes, round(count(*) / count(DISTINCT src), 6) AS mean_degree, round(sum(CASE WHEN p.label = q.label THEN w ELSE 0 END) / sum(w), 6) AS same FROM u JOIN e p ON p.id = src JOIN e q ON q.id = dst GROUP BY 1"""


@query(RULES_SQL)
def edge_variants(spark, d):
    """Graphs of several rules, described alike."""
    n, lab = nodes(spark, d), labels(spark, d)
    every = [("knn5", g.knn(n, 5)), ("knn10", g.knn(n, 10)), ("knn20", g.knn(n, 20)), ("mutual10", g.knn(n, 10, mutual=True))]
    e = every[0][1].withColumn("rule", F.lit("knn5"))
    for name, one in every[1:]:
        e = e.unionByName(one.withColumn("rule", F.lit(name)))
    e = e.join(lab.select(F.col("id").alias("src"), F.col("label").alias("p")), "src").join(lab.select(F.col("id").alias("dst"), F.col("label").alias("q")), "dst")
    return e.groupBy("rule").agg(F.count(F.lit(1)).alias("links"), F.countDistinct("src").alias("nodes"), r6(F.count(F.lit(1)) / F.countDistinct("src")).alias("mean_degree"), r6(F.sum(F.when(F.col("p") == F.col("q"), F.col("w")).otherwise(0.0)) / F.sum("w")).alias("same"))


@query(f"WITH {P}, n AS (SELECT m // 12 AS y, count(DISTINCT id) AS n FROM f GROUP BY 1) SELECT y, n, (coalesce(sum(n) OVER (ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS first FROM n")
def layer_offsets(spark, d):
    """Place of each window's first node in the graph of all windows."""
    n = panel(spark, d, "id", "m").groupBy(F.floor(F.col("m") / 12).alias("y")).agg(F.countDistinct("id").alias("n"))
    before = Window.orderBy("y").rowsBetween(Window.unboundedPreceding, -1)  # a row a window
    return n.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))


@query("SELECT o_custkey AS id FROM orders WHERE year(o_orderdate) = 1995 UNION SELECT o_custkey FROM orders WHERE year(o_orderdate) = 2000")
def union_of_ids(spark, d):
    o = table(spark, d, "orders")
    ids = lambda y: o.filter(F.year("o_orderdate") == y).select(F.col("o_custkey").alias("id"))
    return ids(1995).union(ids(2000)).distinct()


OUT = f"""WITH {P}, e AS (SELECT unnest(range({FIRST + 11}, {LAST + 1})) AS w), k AS (SELECT w FROM e WHERE w % 3 = 2), r AS (SELECT id, w, sum(v) AS total, count(DISTINCT m) AS months FROM f JOIN k ON m BETWEEN w - 11 AND w GROUP BY 1, 2),
s AS (SELECT id, w, months = 12 AND (id + w) % 9 <> 0 AS ok, ln(total / median(total) OVER (PARTITION BY w)) AS rel FROM r), t AS (SELECT s.id, w, ok, n_regionkey AS reg, s_nationkey AS nat, CASE WHEN ok THEN rel END AS x FROM s JOIN supplier ON s_suppkey = s.id JOIN nation ON n_nationkey = s_nationkey),
a AS (SELECT *, coalesce(last_value(x IGNORE NULLS) OVER (PARTITION BY id ORDER BY w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(x IGNORE NULLS) OVER (PARTITION BY id ORDER BY w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS y FROM t),
b AS (SELECT *, coalesce(y, median(y) OVER (PARTITION BY w, reg)) AS z FROM a) SELECT id, CAST(w // 12 AS VARCHAR) || 'Q' || CAST(w % 12 // 3 + 1 AS VARCHAR) AS period, ok AS complete, round(z, 6) AS rel FROM b"""


@query(OUT)
def rolling_features(spark, d):
    """The rolling table's final assembly: levels of incomplete windows are missing, filled along time and then from peers."""
    p = tw.in_windows(panel(spark, d, "id", "m"), "m", tw.window_ends(FIRST, LAST))
    w = tw.with_relative_level(p.groupBy("id", "window").agg(F.sum("v").alias("total"), F.countDistinct("m").alias("months")), "total", ["window"])
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").alias("reg"))
    s = table(spark, d, "supplier").join(F.broadcast(n), "s_nationkey").select(F.col("s_suppkey").alias("id"), "reg")  # nations are fixed in number
    w = w.withColumn("complete", (F.col("months") == 12) & ((F.col("id") + F.col("window")) % 9 != 0)).withColumn("rel", F.when(F.col("complete"), F.col("rel"))).join(s, "id")
    filled = rl.fill_from_peers(rl.fill_along(w, "id", "window", ["rel"]), "rel", [["window", "reg"]])
    return filled.select("id", tw.quarter_key(F.col("window")).alias("period"), "complete", r6("rel").alias("rel"))


@query()
def edge_drift(spark, d):
    """How far neighbour graphs and their communities change from year to year."""
    return rounded(tr.edge_drift(window_features(spark, d)), "edge_jaccard", "community_ari")


def supplier_graphs(spark, d: str, k: int = 10) -> dict[str, DataFrame]:
    """Suppliers' graphs by eleven rules: neighbours in spending (several numbers, mutual, threshold), in all features, on
    the map, in spending near by, in growth, in growth with a lag, in the course of levels."""
    f = window_features(spark, d)
    last = f.filter(F.col("t") == f.agg(F.max("t")).first()[0])
    full = written(last.select("id", "features"))
    spend = full.select("id", F.slice("features", 1, len(TYPES)).alias("features"))
    where = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.array(-50.0 + (F.col("s_nationkey") * 37 % 100) + F.col("s_suppkey") % 17 / 10, -170.0 + (F.col("s_nationkey") * 53 % 340) + F.col("s_suppkey") % 13 / 10).alias("place"))
    place = full.join(where, "id").select("id", F.col("place").alias("features"))
    both = spend.join(where, "id").select("id", F.concat("features", "place").alias("features"))
    q = written(quarters(spark, d), "quarters").join(full.select("id"), "id", "left_semi")
    course = lambda df, v: written(rl.complete(df, "id", "t", df.select("t").distinct().count()).groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("t", v))), lambda s: s[v]).alias("features")))
    growth = course(tw.residual_growth(q, "id", "t", "v").select("id", "t", "growth"), "growth")
    level = course(tw.standardized(tw.residual_level(q, "t", "v"), "id", "level").select("id", "t", "z"), "z")
    near = written(g.top_pairs(spend, 2 * k, copies=True), "near")  # for four rules
    knn = written(g.knn_of(near, k))
    degree = knn.count() / max(1, full.count())
    return {
        f"spend_knn{k // 2}": g.knn_of(near, k // 2), f"spend_knn{k}": knn, f"spend_knn{2 * k}": g.knn_of(near, 2 * k), f"spend_mutual{k}": g.knn_of(near, k, mutual=True),
        "spend_threshold": g.threshold(spend, degree, copies=True), f"full_knn{k}": g.knn(full, k, copies=True),
        f"geo_knn{k}": g.geographic_knn(place, k, copies=True), f"hybrid_knn{k}": g.hybrid_knn(both, k, len(TYPES), copies=True), f"growth_knn{k}": g.knn(growth, k, similarity=series.pearson, copies=True),
        f"lagged_knn{k}": g.knn(growth, k, similarity=series.lagged(3), copies=True), f"dtw_knn{k}": series.dtw_knn(level, k, copies=True),
    }


@query()
def edge_rules(spark, d):
    """Graphs of eleven rules, described alike."""
    region = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("region"))
    graphs = supplier_graphs(spark, d)
    links = written(reduce(DataFrame.unionByName, [e.select(F.lit(name).alias("rule"), "src", "dst", "w") for name, e in graphs.items()]))
    e = links.join(region.toDF("src", "p"), "src").join(region.toDF("dst", "q"), "dst")
    n = links.filter(F.col("rule") == next(iter(graphs))).select("src").distinct().count()
    out = e.groupBy("rule").agg((F.count(F.lit(1)) / 2).cast("long").alias("edges"), F.countDistinct("src").alias("nodes"), (F.count(F.lit(1)) / F.countDistinct("src")).alias("mean_degree"), (F.sum(F.when(F.col("p") == F.col("q"), F.col("w")).otherwise(0.0)) / F.sum("w")).alias("same_region"))
    return rounded(out.withColumn("isolated", F.lit(n) - F.col("nodes")), "mean_degree", "same_region")


@query()
def edge_rule_overlap(spark, d):
    """Common edges of each two of eleven rules in all edges of either."""
    e = written(reduce(DataFrame.unionByName, [e.filter("src < dst").select(F.lit(name).alias("rule"), "src", "dst") for name, e in supplier_graphs(spark, d).items()]))
    size = e.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
    both = e.toDF("one", "src", "dst").join(e.toDF("two", "src", "dst"), ["src", "dst"]).groupBy("one", "two").agg(F.count(F.lit(1)).alias("both"))
    pairs = size.toDF("one", "a").join(F.broadcast(size.toDF("two", "b")), F.col("one") < F.col("two")).join(both, ["one", "two"], "left")  # a row a rule
    share = F.coalesce("both", F.lit(0))
    return pairs.select("one", "two", r6(share / (F.col("a") + F.col("b") - share)).alias("jaccard"))

"""Statistical tests, rankings, rules, refinement and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.operators import dynamics as dy
from orrery.operators import graph as g
from orrery.operators import measures as ms
from orrery.operators import ranking as rk
from orrery.operators import relational as rl
from orrery.operators import stats as st
from orrery.plans.graph_queries import G, PAIRS, edges, knn_sql, labels, nodes
from orrery.plans.panel_queries import FIRST, TYPES, P, panel
from orrery.plans.registry import query, r6, rounded, table

AVG_RANK = "rank() OVER ({p}ORDER BY {v}) + (count(*) OVER (PARTITION BY {q}{v}) - 1) / 2.0"


def rank_sql(v: str, part: str = "") -> str:
    return AVG_RANK.format(v=v, p=f"PARTITION BY {part} " if part else "", q=f"{part}, " if part else "")


KW = f"""r AS (SELECT c_mktsegment AS g, c_acctbal AS x, {rank_sql('c_acctbal')} AS r FROM customer),
g AS (SELECT g, sum(r) AS s, count(*)::DOUBLE AS m FROM r GROUP BY g), a AS (SELECT sum(s * s / m) AS q, count(*) AS k, sum(m) AS n FROM g),
t AS (SELECT sum(t ** 3 - t) AS ties FROM (SELECT count(*)::DOUBLE AS t FROM r GROUP BY x)), h AS (SELECT (12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - ties / (n ** 3 - n)) AS h, k, n FROM a, t)"""


@query(f"WITH {KW} SELECT round(h, 6) AS h, round((h - k + 1) / (n - k), 6) AS eta2, k, n::BIGINT AS n FROM h")
def kruskal_wallis(spark, d):
    return rounded(st.kruskal_wallis(table(spark, d, "customer"), "c_mktsegment", "c_acctbal"), "h", "eta2")


@query(f"""WITH j AS (SELECT doc_id, toxic, n_chars::DOUBLE AS x FROM labels JOIN documents USING (doc_id)), r AS (SELECT toxic, x, {rank_sql('x')} AS r FROM j),
a AS (SELECT sum(r) FILTER (toxic = 1) AS s, (count(*) FILTER (toxic = 1))::DOUBLE AS n1, (count(*) FILTER (toxic = 0))::DOUBLE AS n0 FROM r), t AS (SELECT sum(t ** 3 - t) AS ties FROM (SELECT count(*)::DOUBLE AS t FROM r GROUP BY x)),
u AS (SELECT *, s - n1 * (n1 + 1) / 2 AS u FROM a, t)
SELECT round(u / (n1 * n0), 6) AS auc, round(u, 6) AS u, round((u - n1 * n0 / 2) / sqrt(n1 * n0 / 12 * (n1 + n0 + 1 - ties / ((n1 + n0) * (n1 + n0 - 1)))), 6) AS z, n1::BIGINT AS n1, n0::BIGINT AS n0 FROM u""")
def roc_auc(spark, d):
    """AUC and Mann-Whitney U of text length for a binary outcome."""
    j = table(spark, d, "labels").select("doc_id", "toxic").join(table(spark, d, "documents").select("doc_id", F.col("n_chars").cast("double").alias("x")), "doc_id")
    return rounded(st.roc_auc(j, "toxic", "x"), "auc", "u", "z")


@query(f"WITH r AS (SELECT c_mktsegment AS seg, {rank_sql('c_acctbal', 'c_mktsegment')} AS a, {rank_sql('c_nationkey', 'c_mktsegment')} AS b FROM customer) SELECT seg, round(corr(a, b), 6) AS rho FROM r GROUP BY seg")
def spearman(spark, d):
    c = table(spark, d, "customer").select(F.col("c_mktsegment").alias("seg"), "c_acctbal", "c_nationkey")
    return rounded(st.spearman(c, "c_acctbal", "c_nationkey", ["seg"]), "rho")


CV = "c AS (SELECT c_mktsegment AS x, n_regionkey AS y, count(*)::DOUBLE AS n FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2)"


def cells(spark, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("y"))
    return rl.contingency(table(spark, d, "customer").join(n, "c_nationkey").withColumnRenamed("c_mktsegment", "x"), "x", "y")


@query(f"""WITH {CV}, a AS (SELECT x, sum(n) AS a FROM c GROUP BY x), b AS (SELECT y, sum(n) AS b FROM c GROUP BY y), t AS (SELECT sum(n) AS t FROM c),
q AS (SELECT sum((coalesce(n, 0) - a * b / t) ** 2 / (a * b / t)) AS chi2, min(t) AS t FROM (SELECT a.x, b.y, a, b, t FROM a, b, t) e LEFT JOIN c USING (x, y))
SELECT round(chi2, 6) AS chi2, round(sqrt(chi2 / (t * (least((SELECT count(*) FROM a), (SELECT count(*) FROM b)) - 1))), 6) AS v FROM q""")
def cramers_v(spark, d):
    return rounded(st.cramers_v(cells(spark, d), "x", "y"), "chi2", "v")


@query(f"WITH r AS (SELECT {rank_sql('p_size')} AS a, {rank_sql('p_retailprice')} AS b FROM part) SELECT round(corr(a, b), 6) AS rho FROM r")
def spearman_all(spark, d):
    return rounded(st.spearman(table(spark, d, "part"), "p_size", "p_retailprice"), "rho")


@query(f"WITH {CV} SELECT x, y, n::BIGINT AS n, round(n / sum(n) OVER (PARTITION BY x), 6) AS share FROM c")
def contingency_table(spark, d):
    return cells(spark, d).withColumn("share", r6(F.col("n") / F.sum("n").over(Window.partitionBy("x"))))


@query("SELECT round(quantile_cont(c_acctbal, 0.05), 4) AS p5, round(quantile_cont(c_acctbal, 0.95), 4) AS p95, round(avg(CASE WHEN c_acctbal >= 5000 THEN 1.0 ELSE 0.0 END), 6) AS high, round(stddev_pop(c_acctbal), 6) AS sd FROM customer")
def percentiles(spark, d):
    c = table(spark, d, "customer")
    p = c.agg(F.percentile("c_acctbal", F.array(F.lit(0.05), F.lit(0.95))).alias("p"), F.avg((F.col("c_acctbal") >= 5000).cast("double")).alias("high"), F.stddev_pop("c_acctbal").alias("sd"))
    return p.select(F.round(F.col("p")[0], 4).alias("p5"), F.round(F.col("p")[1], 4).alias("p95"), r6("high").alias("high"), r6("sd").alias("sd"))


@query("SELECT c_mktsegment AS seg, round(corr(c_acctbal, c_nationkey), 6) AS r FROM customer GROUP BY 1")
def pearson(spark, d):
    return table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("seg")).agg(r6(F.corr("c_acctbal", "c_nationkey")).alias("r"))


# Ranking: part types by brand as configurations with signed indices.
SIGNS = {"price": 1, "size": -1, "n": 1}
CONF = "c AS (SELECT p_brand AS name, avg(p_retailprice) AS price, avg(p_size)::DOUBLE AS size, count(*)::DOUBLE AS n FROM part GROUP BY 1)"


def configurations(spark, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("name")).agg(F.avg("p_retailprice").alias("price"), F.avg("p_size").alias("size"), F.count(F.lit(1)).cast("double").alias("n"))


@query(f"""WITH {CONF}, s AS (SELECT name, round(price, 9) AS price, -round(size, 9) AS size, n FROM c), q AS (SELECT {', '.join(f'quantile_cont({x}, 1/3.0::DOUBLE) AS l_{x}, quantile_cont({x}, 2/3.0::DOUBLE) AS h_{x}' for x in SIGNS)} FROM s),
g AS (SELECT name, {', '.join(f'CASE WHEN {x} >= h_{x} THEN 3 WHEN {x} >= l_{x} THEN 2 ELSE 1 END AS g_{x}, {rank_sql(x)} AS r_{x}' for x in SIGNS)} FROM s, q),
k AS (SELECT name, {' + '.join(f'(g_{x} = 1)::INT' for x in SIGNS)} AS worst, {' + '.join(f'(g_{x} = 2)::INT' for x in SIGNS)} AS middle, {' + '.join(f'(g_{x} = 3)::INT' for x in SIGNS)} AS best, {' + '.join(f'r_{x}' for x in SIGNS)} AS borda FROM g)
SELECT name, worst, middle, best, borda::DOUBLE AS borda, rank() OVER (ORDER BY 10 * worst + middle)::INT AS place FROM k""")
def tercile_ranking(spark, d):
    c = configurations(spark, d).withColumns({"price": F.round("price", 9), "size": F.round("size", 9)})
    return rk.tercile_ranking(c, "name", SIGNS)


@query(f"WITH r AS (SELECT p_partkey AS id, {rank_sql('p_retailprice')} AS r FROM part) SELECT id, round_even(100 * r / count(*) OVER (), 0)::DOUBLE AS pct FROM r")
def percent_ranks(spark, d):
    p = rl.globally_ranked(table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_retailprice"), "p_retailprice", "r")
    return p.crossJoin(F.broadcast(p.agg(F.count(F.lit(1)).alias("n")))).select("id", F.rint(100 * F.col("r") / F.col("n")).alias("pct"))


QS = [round(0.1 * i, 1) for i in range(1, 10)]
CUT = "CASE WHEN x = 0 THEN 0 ELSE round_even(x * 10.0 ** greatest(2 - floor(log10(abs(x))), 0), 0) / 10.0 ** greatest(2 - floor(log10(abs(x))), 0) END"
RULES = f"""q AS (SELECT 'c_acctbal' AS feature, unnest(quantile_cont(c_acctbal, {QS})) AS x FROM customer UNION ALL SELECT 'c_nationkey', unnest(quantile_cont(c_nationkey::DOUBLE, {QS})) FROM customer),
u AS (SELECT DISTINCT feature, {CUT} AS cut FROM q), rules AS (SELECT feature, cut, unnest(['<=', '>']) AS sign FROM u)"""


def rule_base(spark, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_acctbal", F.col("c_nationkey").cast("double").alias("c_nationkey"), (F.col("c_mktsegment") == "BUILDING").alias("y"))


@query(f"WITH {RULES} SELECT feature, round(cut, 6) AS cut, sign FROM rules")
def rule_candidates(spark, d):
    return rounded(rk.rule_conditions(rule_base(spark, d), ["c_acctbal", "c_nationkey"], QS), "cut")


@query(f"""WITH {RULES}, l AS (SELECT 'c_acctbal' AS feature, c_acctbal AS x, (c_mktsegment = 'BUILDING')::INT AS y FROM customer UNION ALL SELECT 'c_nationkey', c_nationkey, (c_mktsegment = 'BUILDING')::INT FROM customer),
n AS (SELECT l.feature, cut, sign, sum((CASE WHEN sign = '<=' THEN x <= cut ELSE x > cut END)::INT)::BIGINT AS hits, sum((CASE WHEN sign = '<=' THEN x <= cut ELSE x > cut END)::INT * y)::BIGINT AS good, sum(y)::BIGINT AS total FROM l JOIN rules r ON r.feature = l.feature GROUP BY 1, 2, 3)
SELECT feature, round(cut, 6) AS cut, sign, hits, good, round(CASE WHEN hits = 0 THEN 0 ELSE good / hits END, 6) AS "precision", round(good / total, 6) AS recall, round(CASE WHEN good = 0 THEN 0 ELSE 2.0 * good / (hits + total) END, 6) AS f1 FROM n""")
def rule_scores(spark, d):
    base = rule_base(spark, d)
    rules = rk.rule_conditions(base, ["c_acctbal", "c_nationkey"], QS)
    out = rk.rule_scores(base, rules, ["c_acctbal", "c_nationkey"], F.col("y"))
    return rounded(out.select("feature", "cut", "sign", "hits", "good", "precision", "recall", "f1"), "cut", "precision", "recall", "f1")


@query()
def rule_search(spark, d):
    """The best conjunction that describes a segment (beam search; held against brute force in tests)."""
    p = table(spark, d, "part").select(F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"), (F.col("p_partkey") % 97).cast("double").alias("code"), ((F.col("p_size") > 30) & (F.col("p_retailprice") < 1200)).alias("y"))
    rule = rk.rule_search(p, ["size", "price", "code"], F.col("y"), [0.2, 0.4, 0.6, 0.8], depth=2, beam=10)
    return spark.createDataFrame([(i, *map(str, r[:2]), float(r[2])) for i, r in enumerate(rule)], "place int, feature string, sign string, cut double")


# Refinement and smoothing.
COSTS = f"""WITH {PAIRS}, {knn_sql()}, x AS (SELECT id, label, unnest(range(0, 64)) AS dim, unnest(v) AS x FROM e), n AS (SELECT count(*) AS n FROM e),
sz AS (SELECT label AS k, count(*)::DOUBLE AS nk FROM e GROUP BY 1), gm AS (SELECT dim, avg(x) AS g FROM x GROUP BY 1), tx AS (SELECT sum((x - g) ** 2) AS tx FROM x JOIN gm ON gm.dim = x.dim),
c AS (SELECT label AS k, dim, avg(x) AS c FROM x GROUP BY 1, 2), dx AS (SELECT id, k, sum((x - c) ** 2) AS dx FROM x JOIN c ON c.dim = x.dim GROUP BY 1, 2),
d AS (SELECT e.id, e.label, coalesce(sum(w), 0) AS d FROM e LEFT JOIN g ON g.src = e.id GROUP BY 1, 2), tot AS (SELECT sum(d) AS s FROM d),
pm AS (SELECT a.id AS i, b.id AS j, coalesce(w, 0) - a.d * b.d / s AS p FROM d a JOIN d b ON true JOIN tot ON true LEFT JOIN g ON src = a.id AND dst = b.id),
lm AS (SELECT label AS k, j, avg(p) AS l FROM pm JOIN d ON d.id = i GROUP BY 1, 2), dp AS (SELECT i AS id, k, sum((p - l) ** 2) AS dp FROM pm JOIN lm ON lm.j = pm.j GROUP BY 1, 2), tp AS (SELECT sum(p * p) AS tp FROM pm),
cost AS (SELECT dx.id, dx.k AS cluster, n * (0.3 * dx / tx + 0.7 * dp / tp) AS cost FROM dx JOIN dp ON dp.id = dx.id AND dp.k = dx.k, tx, tp, n)"""


@query(COSTS + " SELECT id, cluster, round(cost, 6) AS cost FROM cost")
def refine_costs(spark, d):
    return rounded(dy.refine_costs(nodes(spark, d), edges(spark, d), labels(spark, d), 0.7), "cost")


@query(COSTS + ", b AS (SELECT id, cluster FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY cost, cluster) AS r FROM cost) WHERE r = 1) SELECT b.id, CASE WHEN (SELECT count(DISTINCT cluster) FROM b) = (SELECT count(DISTINCT label) FROM e) THEN cluster ELSE label END AS label FROM b JOIN e ON e.id = b.id")
def refine_step(spark, d):
    lab = labels(spark, d)
    return dy.refine_step(dy.refine_costs(nodes(spark, d), edges(spark, d), lab, 0.7), lab)


TC = "k AS (SELECT c_custkey AS id, t, cluster, (c_custkey * 7 + t * 13 + cluster * 29) % 31 + c_acctbal / 1e4 AS cost FROM customer, (SELECT unnest([0, 1, 2]) AS t), (SELECT unnest([0, 1, 2, 3]) AS cluster) WHERE (c_custkey + t) % 5 <> 0)"


def window_costs(spark, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_acctbal", F.explode(F.array(*map(F.lit, range(3)))).alias("t")).filter((F.col("id") + F.col("t")) % 5 != 0)
    c = c.withColumn("cluster", F.explode(F.array(*map(F.lit, range(4)))))
    return c.select("id", "t", "cluster", ((F.col("id") * 7 + F.col("t") * 13 + F.col("cluster") * 29) % 31 + F.col("c_acctbal") / 1e4).alias("cost"))


@query(f"WITH {TC} SELECT a.id, a.t, a.cluster, round(sum(0.3 ** abs(a.t - b.t) * b.cost) / sum(0.3 ** abs(a.t - b.t)), 6) AS cost FROM k a JOIN k b ON a.id = b.id AND a.cluster = b.cluster GROUP BY 1, 2, 3")
def temporal_smoothing(spark, d):
    return rounded(dy.temporal_smoothing(window_costs(spark, d), 0.3), "cost")


@query(f"""WITH {PAIRS}, {knn_sql(10, 'a')}, {knn_sql(5, 'b')}, sz AS (SELECT label, count(*)::DOUBLE AS n FROM e GROUP BY 1),
cl AS (SELECT x.label AS ci, y.label AS cj, x.n * y.n - CASE WHEN x.label = y.label THEN x.n ELSE 0 END AS c FROM sz x, sz y),
w AS (SELECT x.label AS ci, y.label AS cj, sum(w) AS w1, sum(w * w) AS w2 FROM b JOIN e x ON x.id = src JOIN e y ON y.id = dst GROUP BY 1, 2), s AS (SELECT x.label AS ci, y.label AS cj, sum(w) AS s1, sum(w * w) AS s2 FROM a JOIN e x ON x.id = src JOIN e y ON y.id = dst GROUP BY 1, 2),
t AS (SELECT c, coalesce(w1, 0) AS w1, coalesce(w2, 0) AS w2, coalesce(s1, 0) AS s1, coalesce(s2, 0) AS s2 FROM cl LEFT JOIN w USING (ci, cj) LEFT JOIN s USING (ci, cj) WHERE c > 0),
z AS (SELECT sum(c * greatest((w2 - c * (w1 / c) ** 2) / (c - 1), 0)) AS noise, sum(s2) - 2 * sum(w1 / c * s1) + sum(c * (w1 / c) ** 2) AS bias FROM t) SELECT round(noise / (bias + noise), 6) AS a FROM z""")
def affect_weights(spark, d):
    return rounded(dy.affect_weight(edges(spark, d, 10), edges(spark, d, 5), labels(spark, d)), "a")


@query("""WITH e AS (SELECT vec_id AS id, label, unnest(range(0, 64)) AS dim, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings), c AS (SELECT label, dim, avg(x) AS c FROM e GROUP BY 1, 2),
d AS (SELECT e.id, c.label, round(sum((x - c) ** 2), 9) AS d FROM e JOIN c ON c.dim = e.dim GROUP BY 1, 2) SELECT id, label FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, label) AS r FROM d) WHERE r = 1""")
def nearest_center(spark, d):
    n = nodes(spark, d)
    c = ms.long_form(n, "label").groupBy("label", "dim").agg(F.avg("x").alias("x")).groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("features"))
    return dy.nearest_centre(n, c)


@query(G + """, n AS (SELECT id, id % 7 AS old FROM e), s AS (SELECT old, count(*) AS n FROM n GROUP BY 1), r AS (SELECT old, row_number() OVER (ORDER BY n DESC, old)::INT - 1 AS label FROM s) SELECT id, label FROM n JOIN r USING (old)""".replace(", n AS", " , n AS"))
def relabel(spark, d):
    return dy.relabel(labels(spark, d).select("id", (F.col("id") % 7).alias("label")))


LAYERS = f"""{PAIRS}, {knn_sql(5, 'a')}, {knn_sql(10, 'b')}, l AS (SELECT 0 AS t, src, dst, w FROM a UNION ALL SELECT 1, src, dst, w FROM b WHERE src % 9 <> 0 AND dst % 9 <> 0), nn AS (SELECT id, 0 AS t FROM e UNION ALL SELECT id, 1 FROM e WHERE id % 9 <> 0)"""


def layers(spark, d: str) -> DataFrame:
    b = edges(spark, d, 10).filter("src % 9 <> 0 AND dst % 9 <> 0")
    return edges(spark, d, 5).withColumn("t", F.lit(0)).unionByName(b.withColumn("t", F.lit(1)))


@query(f"""WITH {LAYERS}, m AS (SELECT avg(n) AS m FROM (SELECT count(*) AS n FROM nn GROUP BY t)), k AS (SELECT x.id, x.t AS t0, y.t AS t1, 1.0 / m AS w FROM nn x JOIN nn y ON x.id = y.id AND y.t = x.t + 1, m)
SELECT t AS src_t, src, t AS dst_t, dst, round(w, 6) AS w FROM l UNION ALL SELECT t0, id, t1, id, round(w, 6) FROM k UNION ALL SELECT t1, id, t0, id, round(w, 6) FROM k""")
def supra_edges(spark, d):
    ids = labels(spark, d).select("id")
    n = ids.withColumn("t", F.lit(0)).unionByName(ids.filter("id % 9 <> 0").withColumn("t", F.lit(1)))
    return rounded(g.supra(layers(spark, d), n, 1.0), "w")


@query(f"""WITH {LAYERS} SELECT t, src, dst, round(sum(w), 6) AS w FROM (SELECT 0 AS t, src, dst, w FROM l WHERE t = 0 UNION ALL SELECT 1, src, dst, 0.3 * w FROM l WHERE t = 0 UNION ALL SELECT 1, src, dst, 0.7 * w FROM l WHERE t = 1) GROUP BY 1, 2, 3""")
def evolved_graph(spark, d):
    return rounded(g.evolved(layers(spark, d), 0.3, [0, 1]), "w")


# Reports on the supplier panel: types are nations' regions, levels are yearly sales.
SUP = "s AS (SELECT s_suppkey AS id, s_name AS name, n_regionkey AS type, n_name AS region, s_acctbal AS bal FROM supplier JOIN nation ON n_nationkey = s_nationkey)"
YR = f"{P}, y AS (SELECT id, m // 12 AS y, sum(v) AS v, sum(CASE WHEN cat = 'PROMO' THEN v ELSE 0 END) AS promo FROM f GROUP BY 1, 2), {SUP}"


def suppliers(spark, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").alias("type"), F.col("n_name").alias("region"))
    return table(spark, d, "supplier").join(F.broadcast(n), "s_nationkey").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), "type", "region", F.col("s_acctbal").alias("bal"))  # nations are fixed in number


def yearly(spark, d: str) -> DataFrame:
    return panel(spark, d).groupBy("id", F.floor(F.col("m") / 12).alias("y")).agg(F.sum("v").alias("v"), F.sum(F.when(F.col("cat") == "PROMO", F.col("v")).otherwise(0.0)).alias("promo"))


@query(f"WITH {YR} SELECT type, y, count(*) AS n, round(median(v), 6) AS v, round(exp(median(ln(v))), 6) AS typical, round(median(bal), 6) AS bal, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY y), 6) AS share FROM y JOIN s USING (id) GROUP BY 1, 2")
def type_summary(spark, d):
    t = yearly(spark, d).join(suppliers(spark, d), "id").groupBy("type", "y").agg(F.count(F.lit(1)).alias("n"), F.round(F.median("v"), 6).alias("v"), F.round(F.exp(F.median(F.ln("v"))), 6).alias("typical"), F.round(F.median("bal"), 6).alias("bal"))
    return t.withColumn("share", r6(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("y"))))


@query(f"WITH {YR}, z AS (SELECT id, y, type, (ln(v) - avg(ln(v)) OVER ()) / stddev_samp(ln(v)) OVER () AS z FROM y JOIN s USING (id)) SELECT type, round(avg(z), 6) AS z FROM z GROUP BY 1")
def type_profiles(spark, d):
    x = yearly(spark, d).withColumn("l", F.ln("v"))
    s = x.agg(F.avg("l").alias("m"), F.stddev_samp("l").alias("sd"))
    return x.join(suppliers(spark, d), "id").crossJoin(F.broadcast(s)).groupBy("type").agg(r6(F.avg((F.col("l") - F.col("m")) / F.col("sd"))).alias("z"))


@query(f"""WITH {SUP}, a AS (SELECT type, string_agg(name, ', ' ORDER BY bal DESC, id) AS top FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY bal DESC, id) AS r FROM s) WHERE r <= 3 GROUP BY 1),
b AS (SELECT type, region, count(*) AS n FROM s GROUP BY 1, 2), c AS (SELECT type, string_agg(region || ' (' || n || ')', ', ' ORDER BY n DESC, region) AS regions FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY n DESC, region) AS r FROM b) WHERE r <= 3 GROUP BY 1) SELECT type, top, regions FROM a JOIN c USING (type)""")
def type_examples(spark, d):
    """Largest members and most frequent regions of each type."""
    s = suppliers(spark, d)
    top = s.withColumn("r", F.row_number().over(Window.partitionBy("type").orderBy(F.desc("bal"), "id"))).filter("r <= 3")
    names = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", c))), lambda x: x[c]), ", ")
    n = s.groupBy("type", "region").agg(F.count(F.lit(1)).alias("n")).withColumn("r", F.row_number().over(Window.partitionBy("type").orderBy(F.desc("n"), "region"))).filter("r <= 3")
    n = n.withColumn("t", F.concat("region", F.lit(" ("), F.col("n").cast("string"), F.lit(")")))
    return top.groupBy("type").agg(names("name").alias("top")).join(n.groupBy("type").agg(names("t").alias("regions")), "type")


@query(f"WITH {YR}, k AS (SELECT id, arg_min(v, y) AS a, arg_max(v, y) AS b, max(y) AS y FROM y GROUP BY 1) SELECT type, count(*) AS n, round(median(b / a - 1), 6) AS growth FROM k JOIN s USING (id) GROUP BY 1")
def period_changes(spark, d):
    k = yearly(spark, d).groupBy("id").agg(F.min_by("v", "y").alias("a"), F.max_by("v", "y").alias("b"))
    return k.join(suppliers(spark, d), "id").groupBy("type").agg(F.count(F.lit(1)).alias("n"), r6(F.median(F.col("b") / F.col("a") - 1)).alias("growth"))


@query(f"WITH {P}, {SUP}, t AS (SELECT id, m, sum(CASE WHEN cat = 'PROMO' THEN v ELSE 0 END) / sum(v) AS share, sum(v) AS v FROM f GROUP BY 1, 2) SELECT m, type, round(median(share), 6) AS share, round(median(v), 6) AS level FROM t JOIN s USING (id) GROUP BY 1, 2")
def market_share_by_type(spark, d):
    t = panel(spark, d).groupBy("id", "m").agg((F.sum(F.when(F.col("cat") == "PROMO", F.col("v")).otherwise(0.0)) / F.sum("v")).alias("share"), F.sum("v").alias("v"))
    return t.join(suppliers(spark, d), "id").groupBy("m", "type").agg(r6(F.median("share")).alias("share"), F.round(F.median("v"), 6).alias("level"))


@query(f"""WITH {P}, {SUP}, t AS (SELECT id, m, sum(CASE WHEN cat = 'PROMO' THEN v ELSE 0 END) / sum(v) AS share FROM f GROUP BY 1, 2), x AS (SELECT m, type, median(share) AS share FROM t JOIN s USING (id) GROUP BY 1, 2),
w AS (SELECT type, avg(share) FILTER (m < {FIRST + 12}) AS a, avg(share) FILTER (m > {FIRST + 70}) AS b FROM x GROUP BY 1), z AS (SELECT a AS a0, b AS b0 FROM w WHERE type = 0)
SELECT type, round(a, 6) AS first, round(b, 6) AS last, round(100 * (b - a), 6) AS gain, round(a / a0, 6) AS ratio_first, round(b / b0, 6) AS ratio_last FROM w, z""")
def catch_up(spark, d):
    """Mean of the first and the last twelve months by type, gain in points, ratios to the base type."""
    t = panel(spark, d).groupBy("id", "m").agg((F.sum(F.when(F.col("cat") == "PROMO", F.col("v")).otherwise(0.0)) / F.sum("v")).alias("share"))
    x = t.join(suppliers(spark, d), "id").groupBy("m", "type").agg(F.median("share").alias("share"))
    w = x.groupBy("type").agg(F.avg(F.when(F.col("m") < FIRST + 12, F.col("share"))).alias("a"), F.avg(F.when(F.col("m") > FIRST + 70, F.col("share"))).alias("b"))
    base = w.filter("type = 0").select(F.col("a").alias("a0"), F.col("b").alias("b0"))
    return w.crossJoin(F.broadcast(base)).select("type", r6("a").alias("first"), r6("b").alias("last"), r6(100 * (F.col("b") - F.col("a"))).alias("gain"), r6(F.col("a") / F.col("a0")).alias("ratio_first"), r6(F.col("b") / F.col("b0")).alias("ratio_last"))


@query("""WITH c AS (SELECT c_mktsegment AS type, c_acctbal, CASE WHEN c_nationkey IN (3, 4) THEN 'north' WHEN c_acctbal > 7500 THEN 'rich' WHEN c_acctbal > 2500 THEN 'middle' ELSE 'poor' END AS grp FROM customer)
SELECT type, grp, count(*) AS n, round(sum(c_acctbal), 2) AS people FROM c GROUP BY 1, 2""")
def regroup_contingency(spark, d):
    """Rule-based groups (later rules win) against types, with counts and sums."""
    b = F.col("c_acctbal")
    grp = F.when(F.col("c_nationkey").isin(3, 4), "north").when(b > 7500, "rich").when(b > 2500, "middle").otherwise("poor")
    return table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("type"), grp.alias("grp")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("people"))


@query("""WITH o AS (SELECT o_custkey AS id, o_totalprice AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders)
SELECT id, round(ln(1 + v / nullif(c_nationkey, 0)), 6) AS x FROM o JOIN customer ON c_custkey = id WHERE r = 1""")
def external_values(spark, d):
    """Latest value of an indicator per head; nothing where the divisor is 0."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("id"), "o_orderkey", "o_orderdate", F.col("o_totalprice").alias("v"))
    last = rl.latest(o, ["id"], [F.desc("o_orderdate"), F.desc("o_orderkey")])
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_nationkey")
    return last.join(c, "id").select("id", r6(F.ln(1 + F.try_divide("v", "c_nationkey"))).alias("x"))


@query("""WITH c AS (SELECT c_custkey AS id, (c_custkey % 11) / 10.0 AS conf, (c_custkey % 7 < 2)::INT AS changed FROM customer)
SELECT CASE WHEN conf <= 0.7 THEN '[0, 0.7]' WHEN conf <= 0.9 THEN '(0.7, 0.9]' ELSE '(0.9, 1]' END AS band, count(*) AS n, round(avg(changed), 6) AS changed FROM c GROUP BY 1""")
def confidence_bands(spark, d):
    c = table(spark, d, "customer").select(((F.col("c_custkey") % 11) / 10.0).alias("conf"), (F.col("c_custkey") % 7 < 2).cast("double").alias("changed"))
    band = F.when(F.col("conf") <= 0.7, "[0, 0.7]").when(F.col("conf") <= 0.9, "(0.7, 0.9]").otherwise("(0.9, 1]")
    return c.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("changed")).alias("changed"))


@query("""WITH n AS (SELECT n_name, count(*) AS k, min(n_nationkey) AS id FROM nation GROUP BY 1 HAVING count(*) = 1), c AS (SELECT c_nationkey AS id, avg(c_acctbal) AS v, count(*) AS m FROM customer GROUP BY 1)
SELECT n_name AS name, round(v, 4) AS v, m FROM n JOIN c USING (id) WHERE m >= 55""")
def unique_name_join(spark, d):
    """Join by names that occur once, then groups of a least size."""
    n = table(spark, d, "nation").groupBy("n_name").agg(F.count(F.lit(1)).alias("k"), F.min("n_nationkey").alias("id")).filter("k = 1")
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("id")).agg(F.avg("c_acctbal").alias("v"), F.count(F.lit(1)).alias("m"))
    return n.join(c, "id").filter("m >= 55").select(F.col("n_name").alias("name"), F.round("v", 4).alias("v"), "m")


@query("SELECT 'supplier' AS kind, max(s_suppkey) AS id, round(max(s_acctbal), 4) AS best, coalesce(NULL::BIGINT, -1) AS size FROM supplier UNION ALL SELECT 'part', max(p_partkey), round(max(p_retailprice), 4), max(p_size)::BIGINT FROM part")
def union_missing_columns(spark, d):
    s = table(spark, d, "supplier").agg(F.lit("supplier").alias("kind"), F.max("s_suppkey").alias("id"), F.round(F.max("s_acctbal"), 4).alias("best"))
    p = table(spark, d, "part").agg(F.lit("part").alias("kind"), F.max("p_partkey").alias("id"), F.round(F.max("p_retailprice"), 4).alias("best"), F.max("p_size").cast("long").alias("size"))
    return s.unionByName(p, allowMissingColumns=True).fillna(-1, ["size"])


@query("SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 400000")
def set_difference(spark, d):
    busy = table(spark, d, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("id"))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id")).join(busy, "id", "left_anti")


@query(f"WITH {P}, w AS (SELECT id, {', '.join(f'''sum(CASE WHEN cat = '{t}' THEN v ELSE 0 END) AS {t}''' for t in TYPES)} FROM f GROUP BY 1), u AS (UNPIVOT w ON {', '.join(TYPES)} INTO NAME category VALUE value) SELECT id, category, round(value, 4) AS value FROM u")
def unpivot_panel(spark, d):
    w = rl.wide(panel(spark, d), ["id"], "cat", TYPES, F.sum("v"))
    return rounded(rl.long(w, ["id"], TYPES), "value", digits=4)


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, upper(event_type) AS kind FROM events WHERE json_extract_string(props, '$.k') LIKE '1%'")
def json_fields(spark, d):
    ev = table(spark, d, "events").select("event_id", "event_type", F.from_json("props", "k bigint").alias("p"))
    return ev.filter(F.col("p.k").cast("string").startswith("1")).select("event_id", F.col("p.k").alias("k"), F.upper("event_type").alias("kind"))


@query("SELECT to_json({'id': s_suppkey, 'name': s_name, 'nation': s_nationkey}) AS payload FROM supplier")
def json_payload(spark, d):
    return table(spark, d, "supplier").select(F.to_json(F.struct(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))).alias("payload"))

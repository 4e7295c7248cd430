"""Scalars, agreement of partitions, alignment, paths and checks, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.functions import scalars as sc
from orrery.operators import clustering as cl
from orrery.operators import dynamics as dy
from orrery.operators import graph as g
from orrery.operators import measures as ms
from orrery.operators import models, series
from orrery.operators import stats as st
from orrery.operators import timewin as tw
from orrery.plans.graph_queries import PLACE, G, edges, knn_sql, labels, places
from orrery.plans.panel_queries import QSUM, P, panel, quarters
from orrery.plans.registry import query, r6, rounded, table
from orrery.sources.readers import MONTHS
from orrery.tables import written

# Scalars.


@query("SELECT n_nationkey AS id, n_name AS unescaped, n_name AS untagged, n_nationkey + 0.5::DOUBLE AS number, (n_nationkey % 12 + 1)::INTEGER AS month FROM nation")
def text_scalars(spark, d):
    """Escaped, tagged and decimal-comma text, and names of months, read back."""
    n = table(spark, d, "nation")
    escaped = F.concat(F.lit("\\u00"), F.lower(F.hex(F.substring("n_name", 1, 1))), F.expr("substring(n_name, 2)"))
    tagged = F.concat(F.lit("__string__"), F.base64(F.col("n_name").cast("binary")))
    number = F.concat(F.lit(" "), F.col("n_nationkey").cast("string"), F.lit(",5"))
    months = F.array(*[F.lit(m) for m in MONTHS])
    name = F.element_at(months, (F.col("n_nationkey") % 12 + 1).cast("int"))
    return n.select(F.col("n_nationkey").alias("id"), sc.unescape_unicode(escaped).alias("unescaped"), sc.untagged(tagged).alias("untagged"), sc.decimal(number).alias("number"), F.array_position(months, F.lower(name)).cast("int").alias("month"))


@query("""WITH s AS (SELECT s_suppkey AS id, s_acctbal AS x, power(10.0, greatest(2 - floor(log10(abs(s_acctbal))), 0)) AS k FROM supplier)
SELECT id, CASE WHEN x = 0 THEN 0.0 ELSE round_even(x * k, 0) / k END AS cut FROM s""")
def rounded_cuts(spark, d):
    """Values rounded to three significant digits, whole numbers stay whole."""
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), sc.round_cut(F.col("s_acctbal")).alias("cut"))


@query(f"SELECT n_nationkey AS id, {', '.join(f'(n_regionkey = {i})::INTEGER AS m{i}' for i in range(5))} FROM nation")
def membership(spark, d):
    """Regions as columns of zeros and ones."""
    return sc.one_hot(table(spark, d, "nation").withColumnRenamed("n_nationkey", "id"), "n_regionkey", range(5), "m").select("id", *(f"m{i}" for i in range(5)))


@query("""WITH o AS (SELECT o_custkey AS id, string_agg(DISTINCT (month(o_orderdate))::VARCHAR, ', ' ORDER BY (month(o_orderdate))::VARCHAR) AS months FROM orders GROUP BY 1)
SELECT id, months, list_sum(list_transform(string_split(months, ','), lambda x: trim(x)::INTEGER))::BIGINT AS total FROM o""")
def comma_lists(spark, d):
    """Lists written as text with commas, and read again."""
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(sc.comma_list(F.sort_array(F.collect_set(F.month("o_orderdate").cast("string")))).alias("months"))
    return o.withColumn("total", F.aggregate(sc.from_comma_list("months"), F.lit(0).cast("long"), lambda a, x: a + x.cast("long")))


@query("""SELECT p_partkey AS id, lower(p_type) || CASE WHEN p_size > 25 THEN ' α ' || (p_size % 10 / 10.0)::DECIMAL(3, 1)::VARCHAR ELSE '' END AS name,
CASE WHEN p_size > 25 THEN 'p_size > 25' ELSE 'p_size <= 25' END || ' and p_retailprice > 1000' AS rule FROM part""")
def label_formats(spark, d):
    """Names of configurations with their weight, and rules as text."""
    p = table(spark, d, "part")
    alpha = F.when(F.col("p_size") > 25, F.col("p_size") % 10 / 10)
    rule = sc.conditions_text([(F.lit("p_size"), F.when(F.col("p_size") > 25, ">").otherwise("<="), F.lit("25")), (F.lit("p_retailprice"), F.lit(">"), F.lit("1000"))])
    return p.select(F.col("p_partkey").alias("id"), sc.configuration_name(F.lower("p_type"), alpha).alias("name"), rule.alias("rule"))


@query(f"""WITH n AS ({PLACE}), q AS (SELECT a.id, b.id AS nearest, (b.lat - a.lat) ** 2 + ((b.lon - a.lon) * cos(radians(a.lat))) ** 2 AS s FROM n a JOIN n b ON b.id % 5 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(s, 6), nearest) AS r FROM q) SELECT id, nearest, round(s, 6) AS square FROM r WHERE r = 1""")
def planar_nearest(spark, d):
    """Nearest of a set by squared planar distance, longitudes shortened by latitude."""
    n = places(spark, d)
    capital = n.filter("id % 5 = 0").select(F.col("id").alias("nearest"), F.col("lat").alias("la"), F.col("lon").alias("lo"))
    square = sc.planar_square(F.col("lat"), F.col("lon"), F.col("la"), F.col("lo"))
    pairs = n.join(F.broadcast(capital), F.lit(True)).withColumn("square", square)  # capitals are fixed in number
    return pairs.groupBy("id").agg(F.min(F.struct(F.round("square", 6).alias("r"), "nearest", "square")).alias("m")).select("id", "m.nearest", F.round("m.square", 6).alias("square"))


# Graphs.


@query(G + """, m AS (SELECT id, CASE WHEN id % 10 < 5 THEN id - id % 10 ELSE id END AS parent FROM e)
SELECT a.parent AS src, b.parent AS dst, round(sum(w), 6) AS w FROM g JOIN m a ON a.id = src JOIN m b ON b.id = dst WHERE a.parent <> b.parent GROUP BY 1, 2""")
def relabelled_edges(spark, d):
    """Edges of parts become edges of the whole: ends go through a map to parents, loops go, weights add up."""
    parents = labels(spark, d).select("id", F.when(F.col("id") % 10 < 5, F.col("id") - F.col("id") % 10).otherwise(F.col("id")).alias("parent"))
    return rounded(g.relabelled(edges(spark, d), parents), "w")


@query(G + """, d AS (SELECT src AS id, sum(w) AS d FROM g GROUP BY 1), t AS (SELECT sum(d) AS t, sum(d * d) AS dd FROM d)
SELECT src, dst, round(w - a.d * b.d / t, 6) AS p FROM g JOIN d a ON a.id = src JOIN d b ON b.id = dst, t""")
def standardised_links(spark, d):
    """Weights of edges less what the strengths of their ends explain."""
    return rounded(g.less_expected(edges(spark, d)), "p")


@query(G.replace("WITH ", "WITH RECURSIVE ", 1) + """, h AS (SELECT DISTINCT src AS s, src AS v, 0 AS n FROM g UNION SELECT h.s, g.dst, n + 1 FROM h JOIN g ON g.src = h.v WHERE n < 14),
m AS (SELECT s, v, min(n) AS n FROM h GROUP BY 1, 2) SELECT n AS hops, count(*) AS pairs FROM m WHERE n > 0 GROUP BY 1""")
def path_hops(spark, d):
    """Number of pairs by hops between them."""
    return series.hop_counts(edges(spark, d), labels(spark, d))


GROWTH = f"""{QSUM}, x AS (SELECT id, t, ln(v) - lag(ln(v)) OVER (PARTITION BY id ORDER BY t) AS g FROM q), r AS (SELECT id, t, g - median(g) OVER (PARTITION BY t) AS g FROM x WHERE g IS NOT NULL),
c AS (SELECT count(DISTINCT t) AS n FROM r), k AS (SELECT id FROM r GROUP BY id HAVING count(*) = (SELECT n FROM c)), s AS (SELECT * FROM r WHERE id IN (SELECT id FROM k))"""


@query(f"""WITH {GROWTH}, p AS (SELECT a.id AS i, b.id AS j, round(corr(a.g, b.g), 9) AS s FROM s a JOIN s b ON a.t = b.t AND a.id <> b.id GROUP BY 1, 2), {knn_sql(5)}
SELECT src, dst, round(w, 6) AS w FROM g""")
def growth_knn(spark, d):
    """Suppliers joined to the five whose growth goes with theirs most."""
    r = tw.residual_growth(quarters(spark, d), "id", "t", "v").select("id", "t", "growth")
    n = r.select("t").distinct().count()
    rows = r.groupBy(F.col("id").cast("long").alias("id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("t", "growth"))), lambda s: s["growth"]).alias("features")).filter(F.size("features") == n)
    return rounded(g.knn(rows, 5, similarity=series.pearson), "w")


@query(G + """, v AS (SELECT src AS id, e.label AS kind, sum(w) AS s FROM g JOIN e ON e.id = dst GROUP BY 1, 2), a AS (SELECT id, 1 - sum((s / t) ** 2) AS p FROM (SELECT *, sum(s) OVER (PARTITION BY id) AS t FROM v) GROUP BY id)
SELECT label, count(*) AS bridges, round(avg(p), 6) AS participation FROM a JOIN e USING (id) WHERE round(p, 9) >= 0.62 GROUP BY label""")
def bridges(spark, d):
    """Nodes whose weight is spread over types, by their own type."""
    p = ms.participation(edges(spark, d), labels(spark, d)).select("id", "participation").filter(F.round("participation", 9) >= 0.62)
    return p.join(labels(spark, d), "id").groupBy("label").agg(F.count(F.lit(1)).alias("bridges"), r6(F.avg("participation")).alias("participation"))


# Partitions.

PARTITIONS = """q AS (SELECT 'given' AS name, vec_id AS id, label::BIGINT AS label FROM embeddings UNION ALL SELECT 'signs', vec_id, (embedding[1] > 0)::BIGINT * 4 + (embedding[2] > 0)::BIGINT * 2 + (embedding[3] > 0)::BIGINT FROM embeddings
UNION ALL SELECT 'merged', vec_id, label // 2 FROM embeddings UNION ALL SELECT 'mixed', vec_id, CASE WHEN vec_id % 4 = 0 THEN vec_id % 3 ELSE label END FROM embeddings)"""
ARI = """c AS (SELECT one, two, x, y, count(*)::DOUBLE AS n FROM z GROUP BY ALL), a AS (SELECT one, two, sum(n * (n - 1) / 2) AS a, sum(n) AS t FROM (SELECT one, two, x, sum(n) AS n FROM c GROUP BY ALL) GROUP BY ALL),
b AS (SELECT one, two, sum(n * (n - 1) / 2) AS b FROM (SELECT one, two, y, sum(n) AS n FROM c GROUP BY ALL) GROUP BY ALL), i AS (SELECT one, two, sum(n * (n - 1) / 2) AS c FROM c GROUP BY ALL),
r AS (SELECT one, two, (c - a * b / (t * (t - 1) / 2)) / ((a + b) / 2 - a * b / (t * (t - 1) / 2)) AS ari FROM a JOIN b USING (one, two) JOIN i USING (one, two))"""
PAIRED = f"{PARTITIONS}, z AS (SELECT k.name AS one, l.name AS two, k.label AS x, l.label AS y FROM q k JOIN q l ON k.id = l.id AND k.name <> l.name), {ARI}"


def partitions(spark, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("label"), F.col("embedding").alias("v"))
    sign = lambda i: (F.col("v")[i] > 0).cast("long")
    each = {"given": F.col("label"), "signs": sign(0) * 4 + sign(1) * 2 + sign(2), "merged": F.floor(F.col("label") / 2), "mixed": F.when(F.col("id") % 4 == 0, F.col("id") % 3).otherwise(F.col("label"))}
    return e.select("id", F.inline(F.array(*[F.struct(F.lit(n).alias("name"), c.cast("long").alias("label")) for n, c in each.items()]))).select("name", "id", "label")


@query(f"WITH {PAIRED} SELECT one, two, round(ari, 6) AS ari FROM r")
def partition_agreement(spark, d):
    """Agreement of each two of four partitions."""
    return rounded(ms.agreement(partitions(spark, d)), "ari")


@query(f"WITH {PAIRED} SELECT one AS name, round(avg(ari), 6) AS agreement FROM r GROUP BY one")
def partition_consensus(spark, d):
    """Mean agreement of each partition with the others."""
    return ms.agreement(partitions(spark, d)).groupBy(F.col("one").alias("name")).agg(r6(F.avg("ari")).alias("agreement"))


RUNS = f"""n AS (SELECT unnest(range(1, 31)) AS run), z AS (SELECT run::VARCHAR AS one, '' AS two, label AS x, CASE WHEN vec_id * 7919 % 101 < run THEN (label + run) % 10 ELSE label END AS y FROM embeddings, n WHERE vec_id * 31 % 10 <> run % 10), {ARI}"""


@query(f"WITH {RUNS} SELECT round(avg(ari), 6) AS mean, round(stddev_pop(ari), 6) AS std, round(quantile_cont(ari, 0.05), 6) AS p5, round(quantile_cont(ari, 0.95), 6) AS p95, round(avg((ari >= 0.85)::INTEGER), 6) AS share_above_085 FROM r")
def stability_from_runs(spark, d):
    """Stability of written runs: their agreement with the whole, summed up."""
    run = labels(spark, d).withColumn("run", F.explode(F.sequence(F.lit(1), F.lit(30)))).filter(F.col("id") * 31 % 10 != F.col("run") % 10)
    both = run.select("run", F.col("label").alias("x"), F.when(F.col("id") * 7919 % 101 < F.col("run"), (F.col("label") + F.col("run")) % 10).otherwise(F.col("label")).alias("y"))
    out = cl.stability_summary(ms.adjusted_rand(both, ["run"]).withColumn("config", F.lit(0))).drop("config")
    return rounded(out, "mean", "std", "p5", "p95", "share_above_085")


ALIGNED = """a AS (SELECT vec_id AS id, label % 4 AS y, CASE WHEN vec_id % 11 < 3 THEN (vec_id // 11) % 4 ELSE (label * 3 + 2) % 4 END AS x FROM embeddings),
f AS (SELECT unnest([0, 1, 2, 3]) AS v), perm AS (SELECT p.v AS p0, q.v AS p1, r.v AS p2, s.v AS p3 FROM f p, f q, f r, f s WHERE p.v <> q.v AND p.v <> r.v AND p.v <> s.v AND q.v <> r.v AND q.v <> s.v AND r.v <> s.v),
c AS (SELECT i.v AS x, j.v AS y, (SELECT count(*) FROM a WHERE a.x = i.v AND a.y = j.v) AS both_, (SELECT count(*) FROM a WHERE a.x = i.v OR a.y = j.v) AS any_ FROM f i, f j),
g AS (SELECT p0, p1, p2, p3, (SELECT sum({gain}) FROM c WHERE y = CASE x WHEN 0 THEN p0 WHEN 1 THEN p1 WHEN 2 THEN p2 ELSE p3 END) AS gain FROM perm), b AS (SELECT * FROM g ORDER BY gain DESC LIMIT 1)
SELECT id, (CASE x WHEN 0 THEN p0 WHEN 1 THEN p1 WHEN 2 THEN p2 ELSE p3 END)::INTEGER AS label FROM a, b"""


def relabelled(spark, d: str) -> DataFrame:
    e = labels(spark, d)
    odd = F.floor(F.col("id") / 11) % 4
    return e.select("id", F.when(F.col("id") % 11 < 3, odd).otherwise((F.col("label") * 3 + 2) % 4).cast("int").alias("x"), (F.col("label") % 4).cast("int").alias("y"))


@query("WITH " + ALIGNED.format(gain="both_"))
def align_by_counts(spark, d):
    """Labels renumbered to share most nodes with others."""
    return dy.aligned(relabelled(spark, d))


@query("WITH " + ALIGNED.format(gain="CASE WHEN any_ > 0 THEN both_ / any_::DOUBLE ELSE 0 END"))
def align_by_jaccard(spark, d):
    """Labels renumbered to overlap most with others, in shares of both."""
    return dy.aligned(relabelled(spark, d), jaccard=True)


# Tests and models.

TAIL = "(0.254829592 * k - 0.284496736 * k ** 2 + 1.421413741 * k ** 3 - 1.453152027 * k ** 4 + 1.061405429 * k ** 5) * exp(-z * z / 2)"


@query(f"""WITH r AS (SELECT CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS y, c_acctbal AS x, rank() OVER (ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_acctbal) - 1) / 2.0 AS r FROM customer),
s AS (SELECT sum(r) FILTER (y = 1) AS s, count(*) FILTER (y = 1)::DOUBLE AS n1, count(*) FILTER (y = 0)::DOUBLE AS n0 FROM r), t AS (SELECT sum(t ** 3 - t) AS ties FROM (SELECT count(*)::DOUBLE AS t FROM r GROUP BY x)),
u AS (SELECT s - n1 * (n1 + 1) / 2 AS u, n1, n0, sqrt(n1 * n0 / 12 * (n1 + n0 + 1 - ties / ((n1 + n0) * (n1 + n0 - 1)))) AS sd FROM s, t), z AS (SELECT u, abs(u - n1 * n0 / 2) / sd AS z FROM u),
k AS (SELECT u, z, 1 / (1 + 0.3275911 * z / sqrt(2)) AS k FROM z) SELECT round(u, 6) AS u, round({TAIL}, 5) AS p FROM k""")
def mann_whitney(spark, d):
    """Do two groups differ? U and its two-sided p-value by the normal approximation."""
    c = table(spark, d, "customer").select((F.col("c_mktsegment") == "BUILDING").cast("int").alias("y"), F.col("c_acctbal").alias("x"))
    return st.roc_auc(c, "y", "x").select(r6("u").alias("u"), F.round(st.two_sided(F.col("z")), 5).alias("p"))


@query("""WITH v AS (SELECT s_name AS name, max(s_acctbal) AS x FROM supplier GROUP BY 1 HAVING count(*) = 1), j AS (SELECT n_nationkey % 9 AS g, x FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN v ON name = s_name),
f AS (SELECT * FROM j WHERE g IN (SELECT g FROM j GROUP BY g HAVING count(*) >= 5)), r AS (SELECT g, x, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS r FROM f),
s AS (SELECT g, sum(r) AS s, count(*)::DOUBLE AS m FROM r GROUP BY g), a AS (SELECT sum(s * s / m) AS q, count(*) AS k, sum(m) AS n FROM s), t AS (SELECT sum(t ** 3 - t) AS ties FROM (SELECT count(*)::DOUBLE AS t FROM r GROUP BY x))
SELECT round((12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - ties / (n ** 3 - n)), 6) AS h, k, n::BIGINT AS n FROM a, t""")
def mobility_check(spark, d):
    """Does an outside value, known by unique names, differ between types that have five members or more?"""
    s = table(spark, d, "supplier")
    outside = s.groupBy(F.col("s_name").alias("name")).agg(F.max("s_acctbal").alias("x"), F.count(F.lit(1)).alias("n")).filter("n = 1").drop("n")
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), (F.col("n_nationkey") % 9).alias("g"))
    joined = s.join(F.broadcast(n), "s_nationkey").join(outside, s["s_name"] == outside["name"]).select("g", "x")  # nations are fixed in number
    return st.kruskal_wallis(st.large_groups(joined, "g", 5), "g", "x").select(r6("h").alias("h"), "k", "n")


OUT = """f AS (SELECT p_partkey AS id, p_partkey % 5 AS fold, p_size // 10 AS code, ln(p_retailprice * CASE WHEN {half} = 1 AND p_size % 5 = 0 THEN 1.3 ELSE 1 END) AS y FROM part),
o{half} AS (SELECT a.id, a.y, exp(a.y - sum(b.s) / sum(b.n)) - 1 AS gap FROM f a JOIN (SELECT fold, code, sum(y) AS s, count(*) AS n FROM f GROUP BY 1, 2) b ON a.code = b.code AND a.fold <> b.fold GROUP BY a.id, a.y)"""


def fold_means(spark, d: str, half: int) -> DataFrame:
    """A model that SQL can say: the mean of the other folds' rows with the same code."""
    p = table(spark, d, "part")
    y = F.ln(F.col("p_retailprice") * F.when(F.lit(half == 1) & (F.col("p_size") % 5 == 0), 1.3).otherwise(1.0))
    rows = p.select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 5).alias("fold"), F.floor(F.col("p_size") / 10).alias("code"), y.alias("y"))
    own = rows.groupBy("fold", "code").agg(F.sum("y").alias("s"), F.count(F.lit(1)).alias("n"))
    other = own.alias("a").join(own.alias("b"), (F.col("a.code") == F.col("b.code")) & (F.col("a.fold") != F.col("b.fold"))).groupBy(F.col("a.fold").alias("fold"), F.col("a.code").alias("code")).agg((F.sum("b.s") / F.sum("b.n")).alias("m"))
    return rows.join(other, ["fold", "code"]).select("id", "y", (F.exp(F.col("y") - F.col("m")) - 1).alias("gap"))


RANKED = "rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"


@query(f"""WITH {OUT.format(half=0)}, {OUT.format(half=1).replace('f AS', 'f1 AS').replace('FROM f a', 'FROM f1 a').replace('FROM f GROUP', 'FROM f1 GROUP')}, m AS (SELECT avg(y) AS m FROM o1),
s AS (SELECT 1 - sum(ln(1 + gap) ** 2) / sum((y - m) ** 2) AS r2, count(*) FILTER (gap >= 0.15) AS above, count(*) FILTER (gap <= -0.15) AS below FROM o1, m),
r AS (SELECT {RANKED.format(c='a.gap')} AS x, {RANKED.format(c='b.gap')} AS y FROM o0 a JOIN o1 b USING (id))
SELECT round(r2, 6) AS r2_out_of_fold, above, below, (SELECT round(corr(x, y), 6) FROM r) AS spearman_first_last, (SELECT count(*) FROM r) AS nodes FROM s""")
def gap_summary(spark, d):
    """Out-of-fold R2 of a model, large gaps, and agreement of gaps between two windows."""
    early, late = (written(fold_means(spark, d, h)) for h in (0, 1))
    return rounded(models.gap_stability(early, late), "r2_out_of_fold", "spearman_first_last")


@query(f"""WITH {P}, s AS (SELECT id, m, sum(v) AS v FROM f GROUP BY 1, 2) SELECT n_regionkey AS region, m, count(*) AS n, round(sum(v), 4) AS v FROM s JOIN supplier ON s_suppkey = id JOIN nation ON n_nationkey = s_nationkey GROUP BY 1, 2""")
def spending_by_region(spark, d):
    """The spending panel with its territories' dimension."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").alias("region"))
    s = table(spark, d, "supplier").join(F.broadcast(n), "s_nationkey").select(F.col("s_suppkey").alias("id"), "region")  # nations are fixed in number
    return panel(spark, d, "id", "m").join(s, "id").groupBy("region", "m").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 4).alias("v"))

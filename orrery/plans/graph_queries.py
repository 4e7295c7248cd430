"""Queries on the nearest-neighbour graph of the embeddings and on their given labels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.operators import graph as g
from orrery.operators import measures as ms
from orrery.plans.registry import query, r6, rounded, table
from orrery.tables import written


def nodes(spark, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("features"))


def edges(spark, d: str, k: int = 10, **kw) -> DataFrame:
    """The neighbour graph, written once for all that a query reads of it."""
    return written(g.knn(nodes(spark, d), k, **kw), "edges")


def labels(spark, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")


PAIRS = """e AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
p AS (SELECT a.id AS i, b.id AS j, round(list_cosine_similarity(a.v, b.v), 9) AS s FROM e a JOIN e b ON a.id <> b.id)"""


def knn_sql(k: int = 10, name: str = "g") -> str:
    return f"""{name}_t AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY s DESC, j) AS r FROM p),
{name}_d AS (SELECT i, j, greatest(s, 1e-6) AS w FROM {name}_t WHERE r <= {k}),
{name} AS (SELECT src, dst, max(w) AS w FROM (SELECT i AS src, j AS dst, w FROM {name}_d UNION ALL SELECT j, i, w FROM {name}_d) GROUP BY src, dst)"""


G = f"WITH {PAIRS}, {knn_sql()}"
S = G + ", s AS (SELECT a.label AS ci, b.label AS cj, sum(w) AS s FROM g JOIN e a ON a.id = src JOIN e b ON b.id = dst GROUP BY 1, 2)"


@query(G + " SELECT src, dst, round(w, 6) AS w FROM g")
def knn_edges(spark, d):
    return rounded(edges(spark, d), "w")


@query(f"""WITH {PAIRS}, {knn_sql()}
SELECT a.i AS src, a.j AS dst, round(least(a.w, b.w), 6) AS w FROM g_d a JOIN g_d b ON a.i = b.j AND a.j = b.i""")
def knn_mutual_edges(spark, d):
    return rounded(edges(spark, d, mutual=True), "w")


@query(f"""WITH {PAIRS}, m AS (SELECT count(*) AS n FROM e), q AS (SELECT *, row_number() OVER (ORDER BY s DESC) AS r FROM p WHERE i < j),
c AS (SELECT min(s) AS eps FROM q, m WHERE r <= CAST(floor(12.0 * n / 2) AS BIGINT)),
k AS (SELECT i, j, s FROM q, c WHERE s >= eps)
SELECT i AS src, j AS dst, round(s, 6) AS w FROM k UNION ALL SELECT j, i, round(s, 6) FROM k""")
def threshold_graph(spark, d):
    return rounded(g.threshold(nodes(spark, d), 12.0), "w")


@query(S + " SELECT ci, cj, round(s, 6) AS s FROM s")
def graph_block_sums(spark, d):
    return rounded(ms.block_sums(edges(spark, d), labels(spark, d)), "s")


SCORES = """, t AS (SELECT sum(s) AS m2 FROM s),
n AS (SELECT label, count(*) AS n FROM e GROUP BY label),
r AS (SELECT ci, sum(s) AS t, sum(CASE WHEN ci = cj THEN s ELSE 0 END) AS own FROM s GROUP BY ci),
x AS (SELECT n.label, n.n, coalesce(r.t, 0) AS t, coalesce(r.own, 0) AS own, m2 FROM n LEFT JOIN r ON r.ci = n.label, t),
f AS (SELECT avg(CASE WHEN t = 0 THEN 0 ELSE own / t END) AS avi, sum(own / m2 - (t / m2) ** 2) AS mq,
  sum((own / 2 - t * t / (2 * m2)) / n) AS dm, sum(own / m2) AS within, count(*) AS k FROM x),
u AS (SELECT coalesce(sum(CASE WHEN a.t - a.own + b.t - b.own - s > 0 THEN s / (a.t - a.own + b.t - b.own - s) ELSE 0 END), 0) AS u
  FROM s JOIN x a ON a.label = ci JOIN x b ON b.label = cj WHERE ci <> cj),
z AS (SELECT *, CASE WHEN k > 1 THEN u / (k * (k - 1)) ELSE 0 END AS avu FROM f, u)
SELECT round(avi, 6) AS avi, round(avu, 6) AS avu, round(avi / (1 + avi * avu), 6) AS anui, round(mq, 6) AS mq, round(dm, 6) AS dm, round(within, 6) AS within FROM z"""


@query(S + SCORES)
def cluster_graph_scores(spark, d):
    lab = labels(spark, d)
    sizes = lab.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return rounded(ms.cluster_scores(ms.block_sums(edges(spark, d), lab), sizes), "avi", "avu", "anui", "mq", "dm", "within")


@query(S + """, t AS (SELECT sum(s) AS m2 FROM s), r AS (SELECT ci, sum(s) AS t, sum(CASE WHEN ci = cj THEN s ELSE 0 END) AS own FROM s GROUP BY ci)
SELECT round(sum(own / m2), 6) AS within, round(sum((t / m2) ** 2), 6) AS expected FROM r, t""")
def mixing_matrix(spark, d):
    return rounded(ms.mixing(ms.block_sums(edges(spark, d), labels(spark, d))), "within", "expected")


@query(S + """, n AS (SELECT label, count(*) AS n FROM e GROUP BY label),
b AS (SELECT ci, cj, s / (x.n * y.n) AS b FROM s JOIN n x ON x.label = ci JOIN n y ON y.label = cj)
SELECT a.ci, a.cj, round(a.b / sqrt(x.b * y.b), 6) AS affinity FROM b a JOIN b x ON x.ci = a.ci AND x.cj = a.ci JOIN b y ON y.ci = a.cj AND y.cj = a.cj""")
def type_affinity(spark, d):
    lab = labels(spark, d)
    return rounded(ms.type_affinity(ms.block_sums(edges(spark, d), lab), lab.groupBy("label").agg(F.count(F.lit(1)).alias("n"))), "affinity")


@query(G + """, d AS (SELECT src, count(*) AS degree, sum(w) AS strength FROM g GROUP BY src)
SELECT count(*) AS nodes, (SELECT count(*) FROM g WHERE src < dst) AS edges, min(degree) AS least, median(degree) AS middle, max(degree) AS most,
  round(avg(degree), 6) AS mean_degree, (SELECT count(*) FROM e) - count(*) AS isolated, round(sum(strength) / 2, 6) AS weight FROM d""")
def degree_summary(spark, d):
    e, n = edges(spark, d), nodes(spark, d).agg(F.count(F.lit(1)).alias("all"))
    deg = g.degrees(e).agg(F.count(F.lit(1)).alias("nodes"), (F.sum("degree") / 2).cast("long").alias("edges"), F.min("degree").alias("least"), F.median("degree").alias("middle"), F.max("degree").alias("most"), r6(F.avg("degree")).alias("mean_degree"), r6(F.sum("strength") / 2).alias("weight"))
    return deg.crossJoin(F.broadcast(n)).withColumn("isolated", F.col("all") - F.col("nodes")).drop("all")


@query(G + """, d AS (SELECT src AS id, count(*) AS d FROM g GROUP BY src), l AS (SELECT src, dst FROM g WHERE src < dst),
t AS (SELECT a.src AS x, a.dst AS y, b.dst AS z FROM l a JOIN l b ON a.src = b.src AND a.dst < b.dst JOIN l c ON c.src = a.dst AND c.dst = b.dst),
c AS (SELECT id, count(*) AS t FROM (SELECT x AS id FROM t UNION ALL SELECT y FROM t UNION ALL SELECT z FROM t) GROUP BY id)
SELECT round(avg(CASE WHEN d > 1 THEN 2.0 * coalesce(t, 0) / (d * (d - 1)) ELSE 0 END), 6) AS clustering FROM d LEFT JOIN c USING (id)""")
def clustering_coefficient(spark, d):
    return rounded(ms.clustering_coefficient(edges(spark, d)), "clustering")


@query(G + """, d AS (SELECT src AS id, count(*)::DOUBLE AS d FROM g GROUP BY src)
SELECT round(corr(a.d, b.d), 6) AS assortativity FROM g JOIN d a ON a.id = src JOIN d b ON b.id = dst""")
def degree_assortativity(spark, d):
    return rounded(ms.assortativity(edges(spark, d)), "assortativity")


@query(G + """, v AS (SELECT id, unnest(range(0, len(v))) AS dim, unnest(v) AS x FROM e),
m AS (SELECT dim, avg(x) AS m, count(*) AS n FROM v GROUP BY dim), z AS (SELECT v.dim, id, n, x - m AS z FROM v JOIN m ON m.dim = v.dim),
d AS (SELECT src, sum(w) AS d FROM g GROUP BY src),
q AS (SELECT a.dim, sum(w / d * a.z * b.z) AS num, sum(w / d) AS rows_ FROM g JOIN d USING (src) JOIN z a ON a.id = src JOIN z b ON b.id = dst AND b.dim = a.dim GROUP BY a.dim),
l AS (SELECT dim, sum(z * z) AS den, min(n) AS n FROM z GROUP BY dim)
SELECT q.dim::INTEGER AS dim, round(n / rows_ * num / den, 6) AS moran FROM q JOIN l ON l.dim = q.dim""")
def moran_by_feature(spark, d):
    """Moran's I of every feature."""
    return rounded(ms.moran(edges(spark, d), ms.long_form(nodes(spark, d), "id"), ["dim"]), "moran")


@query(G + """, b AS (SELECT src AS id, label AS cj, sum(w) AS s FROM g JOIN e ON e.id = dst GROUP BY 1, 2),
h AS (SELECT b.id, cj, e.label, s / sum(s) OVER (PARTITION BY b.id) AS share FROM b JOIN e ON e.id = b.id),
o AS (SELECT id, cj AS other_type, share AS other_share FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY share DESC, cj) AS r FROM h WHERE cj <> label) WHERE r = 1)
SELECT h.id, round(1 - sum(share * share), 6) AS participation, round(sum(CASE WHEN cj = label THEN share ELSE 0 END), 6) AS own_share,
  min(other_type) AS other_type, round(coalesce(min(other_share), 0), 6) AS other_share FROM h LEFT JOIN o ON o.id = h.id GROUP BY h.id""")
def participation(spark, d):
    return rounded(ms.participation(edges(spark, d), labels(spark, d)), "participation", "own_share", "other_share")


@query(f"""WITH {PAIRS}, {knn_sql(5, 'a')}, {knn_sql(10, 'b')}
SELECT count(x) FILTER (y = 1) AS common, count(*) AS either, round(count(x) FILTER (y = 1) / count(*), 6) AS jaccard
FROM (SELECT src, dst, 1 AS x FROM a WHERE src < dst) a FULL JOIN (SELECT src, dst, 1 AS y FROM b WHERE src < dst) b USING (src, dst)""")
def edge_jaccard(spark, d):
    return rounded(ms.edge_jaccard(edges(spark, d, 5), edges(spark, d, 10)), "jaccard")


FUSED = f"""WITH {PAIRS}, {knn_sql(5, 'a')}, {knn_sql(10, 'b')},
f AS (SELECT src, dst, sum(w) AS w FROM (SELECT src, dst, 0.3 * w / (SELECT sum(w) FROM a) AS w FROM a UNION ALL SELECT src, dst, 0.7 * w / (SELECT sum(w) FROM b) FROM b) GROUP BY src, dst)"""


@query(FUSED + " SELECT src, dst, round(w * 1e4, 6) AS w FROM f")
def graph_fuse(spark, d):
    return g.fuse(edges(spark, d, 5), edges(spark, d, 10), 0.3).withColumn("w", r6(F.col("w") * 1e4))


@query(G + """, d AS (SELECT src, sum(w) AS d FROM g GROUP BY src)
SELECT g.src, g.dst, round(w / sqrt(a.d * b.d), 6) AS w FROM g JOIN d a ON a.src = g.src JOIN d b ON b.src = g.dst""")
def gcn_normalized(spark, d):
    return rounded(g.normalized(edges(spark, d)), "w")


@query(G + """ SELECT count(*) AS edges, round(sum(CASE WHEN a.label = b.label THEN w ELSE 0 END) / sum(w), 6) AS same_label_share, round(median(w), 6) AS median_weight
FROM g JOIN e a ON a.id = src JOIN e b ON b.id = dst WHERE src < dst""")
def graph_description(spark, d):
    lab = labels(spark, d)
    e = edges(spark, d).filter("src < dst").join(lab.select(F.col("id").alias("src"), F.col("label").alias("a")), "src").join(lab.select(F.col("id").alias("dst"), F.col("label").alias("b")), "dst")
    return e.agg(F.count(F.lit(1)).alias("edges"), r6(F.sum(F.when(F.col("a") == F.col("b"), F.col("w")).otherwise(0.0)) / F.sum("w")).alias("same_label_share"), r6(F.median("w")).alias("median_weight"))


@query(G + """ SELECT src, dst, round(w, 6) AS w FROM g WHERE src % 10 <> 0 AND dst % 10 <> 0""")
def induced_subgraph(spark, d):
    ids = labels(spark, d).filter("id % 10 <> 0").select("id")
    return rounded(g.induced(edges(spark, d), ids), "w")


@query(f"""WITH RECURSIVE {PAIRS}, {knn_sql(2)}, m AS (SELECT src, dst FROM g),
r AS (SELECT id AS v, id AS root FROM e UNION SELECT m.dst, r.root FROM r JOIN m ON m.src = r.v)
SELECT v AS id, min(root) AS component FROM r GROUP BY v""")
def connected_components(spark, d):
    from orrery.operators.components import components

    return components(edges(spark, d, 2), nodes(spark, d))


# Places: nations on a made-up grid, the same in both engines.
PLACE = "SELECT n_nationkey::BIGINT AS id, n_regionkey AS region, -50.0 + (n_nationkey * 37 % 100) AS lat, -170.0 + (n_nationkey * 53 % 340) AS lon FROM nation"
HAVERSINE = "2 * 6371.0 * asin(sqrt(least(sin((radians({b}.lat) - radians({a}.lat)) / 2) ** 2 + cos(radians({a}.lat)) * cos(radians({b}.lat)) * sin((radians({b}.lon) - radians({a}.lon)) / 2) ** 2, 1.0)))"
KM = HAVERSINE.format(a="a", b="b")


def places(spark, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    return n.select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_regionkey").alias("region"), (-50.0 + (F.col("n_nationkey") * 37 % 100)).alias("lat"), (-170.0 + (F.col("n_nationkey") * 53 % 340)).alias("lon"))


@query(f"""WITH n AS ({PLACE}), q AS (SELECT a.id, b.id AS nearest, {KM} AS km, row_number() OVER (PARTITION BY a.id ORDER BY round({KM}, 6), b.id) AS r
FROM n a JOIN n b ON b.id % 5 = 0) SELECT id, nearest, round(km, 4) AS km FROM q WHERE r = 1""")
def haversine_nearest(spark, d):
    """Nearest of a set (the capitals: every fifth nation)."""
    n = places(spark, d)
    capital = n.filter("id % 5 = 0").select(F.col("id").alias("nearest"), F.col("lat").alias("la"), F.col("lon").alias("lo"))
    km = g.haversine(F.col("lat"), F.col("lon"), F.col("la"), F.col("lo"))
    pairs = n.join(F.broadcast(capital), F.lit(True)).withColumn("km", km)
    return pairs.groupBy("id").agg(F.min(F.struct(F.round("km", 6).alias("r"), "nearest", "km")).alias("m")).select("id", "m.nearest", F.round("m.km", 4).alias("km"))


ROADS = """n AS (SELECT * FROM ({place})), b AS (SELECT a.id AS src, b.id AS dst, {km} AS straight FROM n a JOIN n b ON a.id < b.id),
k AS (SELECT src, dst, straight, CASE WHEN (src * 7 + dst * 3) % 4 <> 0 THEN straight * (1.1 + (src * dst % 7) / 10.0) END AS road FROM b)"""


@query("WITH " + ROADS.format(place=PLACE, km=KM) + ", t AS (SELECT median(road / straight) AS detour FROM k WHERE road IS NOT NULL AND straight > 1) SELECT src, dst, round(coalesce(road, straight * detour), 4) AS km FROM k, t")
def road_detour_fill(spark, d):
    n = places(spark, d)
    a, b = (n.select(F.col("id").alias(i), F.col("lat").alias(f"t{i}"), F.col("lon").alias(f"n{i}")) for i in ("src", "dst"))
    straight = a.join(b, F.col("src") < F.col("dst")).withColumn("s", g.haversine(F.col("tsrc"), F.col("nsrc"), F.col("tdst"), F.col("ndst")))
    roads = straight.filter((F.col("src") * 7 + F.col("dst") * 3) % 4 != 0).select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("s") * (1.1 + (F.col("src") * F.col("dst") % 7) / 10.0)).alias("km"))
    return g.detour_filled(roads, n).select("src", "dst", F.round("km", 4).alias("km"))


@query(f"""WITH n AS ({PLACE}), p AS (SELECT a.id AS i, b.id AS j, round({KM}, 6) AS km FROM n a JOIN n b ON a.id <> b.id),
t AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY km, j) AS r FROM p), c AS (SELECT median(km) AS scale FROM t WHERE r = 4),
k AS (SELECT i, j, greatest(exp(-km / scale), 1e-6) AS w FROM t, c WHERE r <= 4)
SELECT src, dst, round(max(w), 6) AS w FROM (SELECT i AS src, j AS dst, w FROM k UNION ALL SELECT j, i, w FROM k) GROUP BY 1, 2""")
def geographic_knn(spark, d):
    n = places(spark, d).select("id", F.array("lat", "lon").alias("features"))
    return rounded(g.geographic_knn(n, 4), "w")


@query(f"""WITH n AS ({PLACE}), e AS (SELECT n.*, v.v FROM n JOIN (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) v ON v.vec_id = n.id),
p AS (SELECT a.id AS i, b.id AS j, round(greatest(round(list_cosine_similarity(a.v, b.v), 9), 0) * exp(-({KM}) / 300.0), 9) AS s FROM e a JOIN e b ON a.id <> b.id),
{knn_sql(3)} SELECT src, dst, round(w, 6) AS w FROM g""")
def hybrid_knn(spark, d):
    n = places(spark, d).join(nodes(spark, d).select("id", "features"), "id")
    n = n.select("id", F.concat("features", F.array("lat", "lon")).alias("features"))
    return rounded(g.hybrid_knn(n, 3, 64), "w")


# Feature-space metrics


@query("""WITH e AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), n AS (SELECT label, count(*) AS n FROM e GROUP BY label),
t AS (SELECT a.id, a.label, b.label AS cj, sum(CASE WHEN a.id = b.id THEN 0 ELSE list_distance(a.v, b.v) END) AS total FROM e a JOIN e b ON true GROUP BY 1, 2, 3),
x AS (SELECT id, t.label, max(CASE WHEN cj = t.label THEN total / nullif(n.n - 1, 0) END) AS a, min(CASE WHEN cj <> t.label THEN total / n.n END) AS b FROM t JOIN n ON n.label = cj GROUP BY 1, 2)
SELECT round(avg(CASE WHEN n.n > 1 THEN (b - a) / greatest(a, b) ELSE 0 END), 6) AS silhouette FROM x JOIN n ON n.label = x.label""")
def silhouette(spark, d):
    import pyarrow as pa

    def sums(left: pa.Table, right: pa.Table) -> pa.Table:
        x, y, lab = g.matrix(left), g.matrix(right), right.column("label").to_numpy()
        kinds = np.unique(lab)
        dist = np.sqrt(np.maximum((x * x).sum(1)[:, None] - 2 * x @ y.T + (y * y).sum(1)[None, :], 0)) if len(x) and len(y) else np.zeros((len(x), len(y)))
        dist[left.column("id").to_numpy()[:, None] == right.column("id").to_numpy()[None, :]] = 0
        out = np.stack([dist[:, lab == k].sum(axis=1) for k in kinds], axis=1) if len(kinds) else np.zeros((len(x), 0))
        i, j = (m.ravel() for m in np.indices(out.shape))
        return pa.table([left.column("id").take(pa.array(i)), left.column("label").take(pa.array(i)), pa.array(kinds[j].astype(np.int32), pa.int32()), pa.array(out.ravel(), pa.float64())], names=["id", "label", "cj", "total"])

    n = nodes(spark, d)
    parts = g.block_pairs(n.withColumn("id", F.col("id").cast("long")).withColumn("label", F.col("label").cast("int")), sums, "id long, label int, cj int, total double", columns=("id", "label", "features"))
    total = parts.groupBy("id", "label", "cj").agg(F.sum("total").alias("total"))
    return rounded(ms.silhouette(total, n.groupBy(F.col("label").cast("int").alias("label")).agg(F.count(F.lit(1)).alias("n"))), "silhouette")


LONG = "WITH x AS (SELECT vec_id AS id, label, unnest(range(0, 64)) AS dim, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings), c AS (SELECT label, dim, avg(x) AS m, var_pop(x) AS v, count(*) AS n FROM x GROUP BY label, dim)"


@query(LONG + """, g AS (SELECT dim, avg(x) AS g FROM x GROUP BY dim), s AS (SELECT sum(n * (m - g) ** 2) AS b, sum(n * v) AS w FROM c JOIN g USING (dim)),
k AS (SELECT count(DISTINCT label) AS k, count(DISTINCT id) AS n FROM x) SELECT round(b / (k - 1) / (w / (n - k)), 6) AS ch FROM s, k""")
def calinski_harabasz(spark, d):
    return rounded(ms.calinski_harabasz(nodes(spark, d)), "ch")


@query(LONG + """, d AS (SELECT x.label, id, sqrt(sum((x - m) ** 2)) AS d FROM x JOIN c ON c.label = x.label AND c.dim = x.dim GROUP BY 1, 2),
s AS (SELECT label, avg(d) AS s FROM d GROUP BY label),
p AS (SELECT a.label, b.label AS l2, sqrt(sum((a.m - b.m) ** 2)) AS sep FROM c a JOIN c b ON a.dim = b.dim AND a.label <> b.label GROUP BY 1, 2),
r AS (SELECT p.label, max((s.s + t.s) / sep) AS r FROM p JOIN s ON s.label = p.label JOIN s t ON t.label = p.l2 GROUP BY 1) SELECT round(avg(r), 6) AS db FROM r""")
def davies_bouldin(spark, d):
    return rounded(ms.davies_bouldin(nodes(spark, d)), "db")


@query(LONG + """, norms AS (SELECT label, sqrt(sum(v * v)) AS v FROM c GROUP BY label), w AS (SELECT sqrt(sum(v * v)) AS g FROM (SELECT dim, var_pop(x) AS v FROM x GROUP BY dim)),
base AS (SELECT avg(v) / min(g) AS scat, sqrt(sum(v)) / count(*) AS radius, count(*) AS k FROM norms, w),
pt AS (SELECT a.label, b.label AS l2, a.dim, unnest([0, 1, 2]) AS pos, unnest([a.m, b.m, (a.m + b.m) / 2]) AS p FROM c a JOIN c b ON a.dim = b.dim AND a.label < b.label),
nr AS (SELECT pt.label, l2, pos, id FROM pt JOIN x ON x.dim = pt.dim AND (x.label = pt.label OR x.label = l2) GROUP BY 1, 2, 3, 4 HAVING sqrt(sum((x - p) ** 2)) <= (SELECT radius FROM base)),
dn AS (SELECT label, l2, count(*) FILTER (pos = 0) AS d0, count(*) FILTER (pos = 1) AS d1, count(*) FILTER (pos = 2) AS d2 FROM nr GROUP BY 1, 2)
SELECT round(min(scat) + coalesce((SELECT sum(CASE WHEN greatest(d0, d1) > 0 THEN 2.0 * d2 / greatest(d0, d1) ELSE 0 END) FROM dn), 0) / (min(k) * (min(k) - 1)), 6) AS s_dbw FROM base""")
def s_dbw(spark, d):
    return rounded(ms.s_dbw(nodes(spark, d)), "s_dbw")


TWO = "WITH p AS (SELECT label AS x, vec_id % 10 AS y FROM embeddings)"


def two_labelings(spark, d: str) -> DataFrame:
    return labels(spark, d).select(F.col("label").alias("x"), (F.col("id") % 10).alias("y"))


@query(TWO + """, c AS (SELECT x, y, count(*)::DOUBLE AS n FROM p GROUP BY 1, 2), a AS (SELECT sum(n * (n - 1) / 2) AS a, sum(n) AS t FROM (SELECT sum(n) AS n FROM c GROUP BY x)),
b AS (SELECT sum(n * (n - 1) / 2) AS b FROM (SELECT sum(n) AS n FROM c GROUP BY y)), k AS (SELECT sum(n * (n - 1) / 2) AS c FROM c)
SELECT round((c - a * b / (t * (t - 1) / 2)) / ((a + b) / 2 - a * b / (t * (t - 1) / 2)), 6) AS ari FROM a, b, k""")
def adjusted_rand(spark, d):
    return rounded(ms.adjusted_rand(two_labelings(spark, d)), "ari")


@query(TWO + """, c AS (SELECT x, y, count(*)::DOUBLE AS n FROM p GROUP BY 1, 2), t AS (SELECT sum(n) AS t FROM c), a AS (SELECT x, sum(n) AS nx FROM c GROUP BY x), b AS (SELECT y, sum(n) AS ny FROM c GROUP BY y),
m AS (SELECT sum(n / t * ln(n * t / (nx * ny))) AS mi FROM c JOIN a USING (x) JOIN b USING (y), t), h AS (SELECT -sum(nx / t * ln(nx / t)) AS h FROM a, t), i AS (SELECT -sum(ny / t * ln(ny / t)) AS i FROM b, t)
SELECT round(mi / ((h + i) / 2), 6) AS nmi FROM m, h, i""")
def nmi(spark, d):
    return rounded(ms.nmi(two_labelings(spark, d)), "nmi")


@query(TWO + ", c AS (SELECT x, y, count(*) AS n FROM p GROUP BY 1, 2), m AS (SELECT max(n) AS m, sum(n) AS t FROM c GROUP BY x) SELECT round(sum(m) / sum(t), 6) AS nesting FROM m")
def nesting(spark, d):
    return rounded(ms.nesting(two_labelings(spark, d)), "nesting")


@query("WITH n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label) SELECT label, n, round(n / sum(n) OVER (), 6) AS share FROM n")
def cluster_sizes(spark, d):
    n = labels(spark, d).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("t")))).select("label", "n", r6(F.col("n") / F.col("t")).alias("share"))


@query(G + """, x AS (SELECT src AS id, dst AS other, w, row_number() OVER (PARTITION BY src ORDER BY round(w, 9) DESC, dst) AS r FROM g)
SELECT x.id, string_agg(other::VARCHAR, ',' ORDER BY r) AS nearest, round(avg(CASE WHEN a.label = b.label THEN 1.0 ELSE 0.0 END), 6) AS own_share
FROM x JOIN e a ON a.id = x.id JOIN e b ON b.id = x.other WHERE r <= 10 GROUP BY x.id""")
def nearest_list(spark, d):
    """Ten nearest neighbours of each node and the share of them with its own label."""
    from pyspark.sql import Window

    lab = labels(spark, d)
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc(F.round("w", 9)), "dst"))
    top = edges(spark, d).withColumn("r", rank).filter("r <= 10")
    top = top.join(lab.select(F.col("id").alias("src"), F.col("label").alias("a")), "src").join(lab.select(F.col("id").alias("dst"), F.col("label").alias("b")), "dst")
    names = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "dst"))), lambda x: x["dst"].cast("string")), ",")
    return top.groupBy(F.col("src").alias("id")).agg(names.alias("nearest"), r6(F.avg((F.col("a") == F.col("b")).cast("double"))).alias("own_share"))

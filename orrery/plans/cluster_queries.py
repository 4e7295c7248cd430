"""Queries that run clustering methods, grids and models; stochastic or iterative, so held by properties and tests."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.operators import clustering as cl
from orrery.operators import models, series, stats
from orrery.operators import measures as ms
from orrery.plans.graph_queries import edges, labels, nodes
from orrery.plans.panel_queries import quarters
from orrery.plans.registry import QUERIES, query, r6, rounded, table
from orrery.tables import written


def grid(spark, rows: list[tuple[str, int, float | None]], seeds: int = 1, runs: int = 1) -> DataFrame:
    cells = [(i, m, k, a, s, r) for i, ((m, k, a), s) in enumerate(itertools.product(rows, range(seeds))) for r in range(runs)]
    return spark.createDataFrame(cells, "config long, method string, k int, alpha double, seed int, run int")


def method_query(name: str, alpha: float | None = None):
    def run(spark, d):
        out = cl.run_grid(nodes(spark, d), edges(spark, d), grid(spark, [(name, 10, alpha)]))
        return out.select("id", "label")

    run.__name__ = f"cluster_{name}"
    run.__doc__ = f"Labels of {name} with ten clusters on the embeddings and their neighbour graph."
    query()(run)


for _name, _alpha in (("kmeans", None), ("ward", None), ("mixture", None), ("spectral", None), ("louvain", None), ("leiden", None), ("fused_spectral", 0.3), ("refined_spectral", 0.3), ("kefrin", 0.3), ("kefrin_cosine", 0.3), ("canus", 0.3), ("canus_cosine", 0.3), ("dmon", 0.3)):
    method_query(_name, _alpha)


@query()
def compare_methods(spark, d):
    """Grid of methods, numbers of clusters and weights of the graph: agreement with the given labels, sizes."""
    ks, alphas = (4, 6, 8), (0.0, 0.3, 0.5, 1.0)
    rows = [(m, k, None) for m in ("kmeans", "ward", "mixture", "spectral", "louvain_k", "leiden_k") for k in ks] + [(m, k, a) for m in cl.JOINT for k in ks for a in alphas]
    g = grid(spark, rows)
    out = cl.run_grid(nodes(spark, d), edges(spark, d), g).filter(F.col("label").isNotNull()).join(labels(spark, d).withColumnRenamed("label", "y"), "id")
    out = written(out.select("config", F.col("label").alias("x"), "y"))
    ari = ms.adjusted_rand(out, ["config"])
    n = out.groupBy("config", "x").agg(F.count(F.lit(1)).alias("n")).groupBy("config").agg((F.max("n") / F.sum("n")).alias("largest"), (F.min("n") / F.sum("n")).alias("smallest"))
    return g.select("config", "method", "k", "alpha").join(ari, "config").join(n, "config").select("config", "method", "k", "alpha", r6("ari").alias("ari"), r6("largest").alias("largest"), r6("smallest").alias("smallest"))


@query()
def bootstrap_confidence(spark, d):
    """Share of 300 runs on 90 % of the nodes in which a node keeps its type."""
    runs = cl.run_grid(nodes(spark, d), edges(spark, d), grid(spark, [("refined_spectral", 10, 0.3)], runs=301))
    return cl.bootstrap(runs)[0].select("id", r6("confidence").alias("confidence"), "runs")


def curve(spark, d: str, rows: list[tuple[str, int, float | None]], runs: int = 50) -> DataFrame:
    """Agreement of each configuration's partition with those of subsamples."""
    g = grid(spark, rows, runs=runs + 1)
    stable = cl.bootstrap(cl.run_grid(nodes(spark, d), edges(spark, d), g).filter(F.col("label").isNotNull()))[1]
    return cl.stability_summary(stable).join(g.filter("run = 0").select("config", "method", "k", "alpha"), "config")


@query()
def stability(spark, d):
    """Stability over 50 subsamples by number of clusters for two methods, and of the others with one number."""
    rows = [(m, k, a) for k in range(3, 11) for m, a in (("kmeans", None), ("refined_spectral", 0.3))]
    best = [("ward", None), ("spectral", None), ("fused_spectral", 0.2), ("refined_spectral", 0.2), ("kefrin", 0.6), ("kefrin_cosine", 0.7)]
    out = curve(spark, d, rows + [(m, 6, a) for m, a in best])
    return rounded(out.select("method", "k", "alpha", "mean", "std", "p5", "p95", "share_above_085"), "mean", "std", "p5", "p95", "share_above_085")


FAMILY = [("kmeans", None), ("ward", None), ("mixture", None), ("spectral", None), ("louvain_k", None), ("leiden_k", None)] + [(m, a) for m in ("kefrin", "kefrin_cosine", "fused_spectral", "refined_spectral") for a in (0.3, 0.5)]


def family(spark, d: str) -> DataFrame:
    """Partitions of a family of methods into six: (name, id, label)."""
    g = grid(spark, [(m, 6, a) for m, a in FAMILY])
    name = F.concat_ws(" ", "method", F.col("alpha").cast("string")).alias("name")
    return cl.run_grid(nodes(spark, d), edges(spark, d), g).filter(F.col("label").isNotNull()).join(g.select("config", name), "config").select("name", "id", "label")


@query()
def family_agreement(spark, d):
    """Agreement of each two methods of the family."""
    out = ms.agreement(written(family(spark, d)))
    return rounded(out, "ari")


@query()
def consensus(spark, d):
    """Mean agreement of each method's partition with the others', and its agreement with the partition that the methods'
    votes for pairs make (spectral clusters of the shares of methods that put two nodes together)."""
    out = written(family(spark, d))
    mean = ms.agreement(out).groupBy(F.col("one").alias("name")).agg(F.avg("ari").alias("agreement"))
    votes = cl.consensus_labels(out, 6).withColumnRenamed("label", "y")
    joint = ms.adjusted_rand(out.withColumnRenamed("label", "x").join(votes, "id"), ["name"]).withColumnRenamed("ari", "with_votes")
    return rounded(mean.join(joint, "name"), "agreement", "with_votes")


@query()
def dtw_distance(spark, d):
    """Dynamic time warping between suppliers' quarterly z-scores (band 2)."""
    return series.dtw_pairs(series.z_series(quarters(spark, d), "id", "t", "v"), band=2).select("src", "dst", r6("dist").alias("dist"))


@query()
def dtw_knn(spark, d):
    return series.dtw_knn(series.z_series(quarters(spark, d), "id", "t", "v"), k=5, band=2).select("src", "dst", r6("w").alias("w"))


@query()
def mean_path(spark, d):
    """Mean shortest path from all sources, by breadth-first search in tasks of some sources each."""
    return series.path_lengths(edges(spark, d), nodes(spark, d)).agg(r6(F.sum("total") / F.sum("reached")).alias("mean_path"), F.sum("reached").alias("pairs"))


@query()
def rewired_clustering(spark, d):
    """Clustering of degree-preserving rewirings of the graph, one task a seed."""
    return series.rewired(edges(spark, d), [1, 2, 3]).select("seed", r6("clustering").alias("clustering"))


@query()
def moran_permutation(spark, d):
    """Moran's I of every feature with a p-value of 499 permutations."""
    return series.moran_tests(edges(spark, d), nodes(spark, d), 499).select("dim", r6("moran").alias("moran"), r6("p").alias("p"))


def part_gap(spark, d: str, half: int) -> DataFrame:
    """Out-of-fold gaps of boosted trees for retail prices; the halves' prices differ by a known change."""
    c = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.ln(F.col("p_retailprice") * F.when(F.lit(half == 1) & (F.col("p_size") % 5 == 0), 1.3).otherwise(1.0)).alias("y"), F.col("p_size").cast("double").alias("size"), (F.col("p_partkey") % 100).cast("double").alias("code"))
    return models.out_of_fold_gap(c, "id", "y", ["size", "code"], trees=60, step=0.2)


@query()
def gbt_gap(spark, d):
    """Out-of-fold gap exp(y - prediction) - 1 of 60 boosted trees over five folds."""
    return part_gap(spark, d, 0).select("id", "fold", F.round("gap", 4).alias("gap"))


@query()
def gap_stability(spark, d):
    """How well the gaps' model predicts, how many gaps are large, and how far two windows' gaps agree."""
    early, late = (written(part_gap(spark, d, h).select("id", "y", "gap")) for h in (0, 1))
    return rounded(models.gap_stability(early, late), "r2_out_of_fold", "spearman_first_last")


@query()
def rf_importance(spark, d):
    """Accuracy lost when one feature is shuffled, for every feature, random forest over folds."""
    n = nodes(spark, d)
    dims = n.agg(F.max(F.size("features"))).first()[0] or 0
    n = n.select("id", "label", *(F.get("features", F.lit(i)).alias(f"f{i}") for i in range(dims)))
    return models.permutation_importance(n, "id", "label", [f"f{i}" for i in range(dims)], trees=100)


SPEND = 16  # the first block of features


def truths(spark, d: str) -> dict[str, models.Types]:
    """Types of three sources: the refined method, k-means and the spectral method on the graph."""
    arrays = cl.snapshot_rows(nodes(spark, d), edges(spark, d))
    s = cl.unpack(arrays)
    return {name: models.types_of(s.x, cl.cluster(s, m, 6, a), SPEND) for name, m, a in (("model", "refined_spectral", 0.3), ("kmeans", "kmeans", None), ("spectral", "spectral", None))}


METHODS = [("kmeans", "kmeans", None, None), ("ward", "ward", None, None), ("mixture", "mixture", None, None), ("spectral", "spectral", None, None)]
METHODS += [(f"{m} 0.3", m, 0.3, None) for m in cl.JOINT if m != "refined_spectral"] + [(f"refined_spectral {a}", "refined_spectral", a, 0.7) for a in (0.0, 0.1, 0.2, 0.3, 0.5, 0.7, 1.0)]


def recovery(spark, d: str, methods: list[tuple], indices: bool = False) -> DataFrame:
    return models.synthetic_grid(spark, {"model": truths(spark, d)["model"]}, methods, list(models.SCENARIOS), 5, indices=indices)


@query()
def synthetic_recovery(spark, d):
    """All methods on six scenarios drawn from the refined method's types, five data sets each: mean agreement with the truth."""
    out = recovery(spark, d, METHODS).groupBy("method", "scenario").agg(F.avg("ari").alias("ari"), F.count(F.lit(1)).alias("repeats"))
    return rounded(out, "ari")


@query()
def index_recovery(spark, d):
    """Spearman correlation of each index with the agreement with the truth, over methods of one data set, mean by scenario."""
    quick = [m for m in METHODS if m[1] not in ("canus", "canus_cosine", "dmon")]
    long = written(recovery(spark, d, quick, indices=True)).unpivot(["method", "scenario", "repeat", "ari"], models.INDICES, "index", "value").filter(~F.isnan("value"))
    rho = stats.spearman(long, "value", "ari", ["scenario", "index", "repeat"])
    return rounded(rho.groupBy("scenario", "index").agg(F.avg("rho").alias("spearman")), "spearman")


TRUTH_METHODS = [("kmeans", "kmeans", None, None), ("ward", "ward", None, None), ("mixture", "mixture", None, None), ("spectral", "spectral", None, None), ("kefrin", "kefrin", 0.3, None), ("kefrin_cosine", "kefrin_cosine", 0.3, None), ("fused_spectral", "fused_spectral", 0.3, None)]
TRUTH_METHODS += [(f"refined_spectral w{w}", "refined_spectral", 0.3, w) for w in (0.0, 0.3, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)]


def other_truths(spark, d: str) -> DataFrame:
    return models.synthetic_grid(spark, truths(spark, d), TRUTH_METHODS, ["calibrated", "pairs_by_spending"], 5)


@query()
def truth_recovery(spark, d):
    """Mean agreement with the truth where the truth comes from other methods' types."""
    out = other_truths(spark, d).groupBy("source", "scenario", "method").agg(F.avg("ari").alias("ari"), F.count(F.lit(1)).alias("repeats"))
    return rounded(out, "ari")


@query()
def truth_wins(spark, d):
    """In how many data sets of each truth the refined method is nearer to it than each other one."""
    return models.win_counts(other_truths(spark, d), "refined_spectral w0.7")


assert QUERIES

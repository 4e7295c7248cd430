"""Supervised models over folds and synthetic data for the recovery of planted clusters."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators import clustering as cl
from orrery.operators.sparse import Links, nearest
from orrery.shipping import apart, ship

#: The scenarios' names, and the indices that are compared with recovery.
SCENARIOS = ("calibrated", "pairs_by_spending", "spending_only", "noisier", "independent_graph", "no_spending")
INDICES = ["SW", "CH", "S_Dbw", "DB", "AVI", "AVU", "MQ", "within"]


def with_folds(df: DataFrame, key: str, folds: int = 5) -> DataFrame:
    return df.withColumn("fold", F.pmod(F.xxhash64(F.lit(17), F.col(key)), F.lit(folds)).cast("int"))


def out_of_fold_gap(df: DataFrame, key: str, y: str, features: list[str], folds: int = 5, trees: int = 300, depth: int = 3, step: float = 0.05) -> DataFrame:
    """exp(y - prediction) - 1 with the model of the other folds."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    data = VectorAssembler(inputCols=features, outputCol="_x").transform(with_folds(df, key, folds)).cache()
    parts = []
    for f in range(folds):
        model = GBTRegressor(featuresCol="_x", labelCol=y, maxIter=trees, maxDepth=depth, stepSize=step, seed=1).fit(data.filter(F.col("fold") != f))
        parts.append(model.transform(data.filter(F.col("fold") == f)))
    out = reduce(DataFrame.unionByName, parts)
    return out.select(key, "fold", F.col(y).alias("y"), (F.exp(F.col(y) - F.col("prediction")) - 1).alias("gap"))


def permutation_importance(df: DataFrame, key: str, label: str, features: list[str], trees: int = 400, folds: int = 5, repeats: int = 3) -> DataFrame:
    """(feature, importance, accuracy): mean loss of held-out accuracy when a feature's values are exchanged. All features
    and exchanges of a fold are scored in one pass."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector
    from pyspark.sql import Window

    spark = df.sparkSession
    data = with_folds(df, key, folds).select(key, "fold", F.col(label).cast("double").alias("_y"), F.array(*features).alias("_v")).cache()
    got: dict[str, list[float]] = {f: [] for f in features}
    base = []
    right = F.avg((F.col("prediction") == F.col("_y")).cast("double"))
    for fold in range(folds):
        model = RandomForestClassifier(featuresCol="_x", labelCol="_y", numTrees=trees, seed=1).fit(data.filter(F.col("fold") != fold).withColumn("_x", array_to_vector("_v")))
        test = data.filter(F.col("fold") == fold)
        base.append(model.transform(test.withColumn("_x", array_to_vector("_v"))).agg(right).first()[0] or 0.0)
        a = test.withColumn("_n", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn("_r", F.row_number().over(Window.partitionBy("fold", "_n").orderBy(F.xxhash64(F.col("_n"), F.col(key)))))
        b = test.select(F.col("_v").alias("_w"), F.row_number().over(Window.partitionBy("fold").orderBy(key)).alias("_r"))
        each = a.join(b, "_r").withColumn("_f", F.explode(F.sequence(F.lit(0), F.lit(len(features) - 1))))
        changed = F.transform("_v", lambda x, i: F.when(i == F.col("_f"), F.get("_w", i)).otherwise(x))
        rows = model.transform(each.select("_n", "_f", "_y", array_to_vector(changed).alias("_x"))).groupBy("_n", "_f").agg(right.alias("a")).collect()  # repeats * features rows
        accuracy = {(r["_f"], r["_n"]): r["a"] for r in rows}
        for i, f in enumerate(features):
            got[f] += [base[-1] - (accuracy.get((i, n)) or 0.0) for n in range(repeats)]
    return spark.createDataFrame([(f, round(float(np.mean(v)), 6), round(float(np.mean(base)), 6)) for f, v in got.items()], "feature string, importance double, accuracy double")


@dataclass
class Types:
    """What data sets are drawn from: types' centres, rows' residuals, types' sizes; the first `spend` features are spending."""

    centres: np.ndarray
    residuals: np.ndarray
    sizes: np.ndarray
    spend: int


def types_of(x: np.ndarray, labels: np.ndarray, spend: int) -> Types:
    labels = np.unique(labels, return_inverse=True)[1]
    k = int(labels.max()) + 1
    centres = cl.means(x, labels, k)
    return Types(centres, x - centres[labels], np.bincount(labels, minlength=k), spend)


def laid_out(t: Types, scenario: str) -> np.ndarray:
    """Centres of a scenario: outside or inside of spending they may all be the mean of the types, by size; or each second
    type may be like the one before it but for spending."""
    out, mean, spending = t.centres.copy(), t.sizes @ t.centres / t.sizes.sum(), np.arange(t.centres.shape[1]) < t.spend
    if scenario == "spending_only":
        out[:, ~spending] = mean[~spending]
    if scenario == "no_spending":
        out[:, spending] = mean[spending]
    if scenario == "pairs_by_spending":
        second = np.arange(1, len(out), 2)
        out[np.ix_(second, ~spending)] = out[np.ix_(second - 1, ~spending)]
    return out


def planted(truth: np.ndarray, degree: int, inside: float, rng: np.random.Generator) -> Links:
    """A graph of n * degree / 2 draws, each with probability `inside` within the type of its first node, else outside;
    repeated draws are one edge of weight one."""
    n = len(truth)
    first = rng.integers(n, size=n * degree // 2)
    within = rng.random(len(first)) < inside
    by_type = np.argsort(truth, kind="stable")  # a type's nodes stand together: the others follow them around the circle
    size = np.bincount(truth)
    begin = np.concatenate([[0], np.cumsum(size)])[:-1][truth[first]]
    own = size[truth[first]]
    room = np.where(within, own, n - own)
    step = np.where(within, 0, own) + (rng.random(len(first)) * room).astype(np.int64)
    second = by_type[(begin + step) % n]
    ok = (first != second) & (room > 0)
    w = Links(n, np.concatenate([first[ok], second[ok]]), np.concatenate([second[ok], first[ok]]), np.ones(2 * int(ok.sum())))
    return w.like(np.ones(len(w.values)))


def dataset(types: Types, scenario: str, rng: np.random.Generator, noise: float = 1.5, inside: float = 0.8, neighbours: int = 10) -> tuple[cl.Snapshot, np.ndarray]:
    """As many nodes as the types have, with residuals drawn from all rows; the graph joins neighbours in spending, the
    attributes' own graph neighbours in all features. `noisier` and `independent_graph` have `noise` times the residuals,
    the latter a planted graph of as many neighbours."""
    if scenario not in SCENARIOS:
        raise ValueError(f"scenario {scenario!r} is none of {', '.join(SCENARIOS)}")
    truth = rng.permutation(np.repeat(np.arange(len(types.sizes)), types.sizes))
    loud = noise if scenario in ("noisier", "independent_graph") else 1.0
    x = laid_out(types, scenario)[truth] + loud * types.residuals[rng.integers(len(types.residuals), size=len(truth))]
    w = nearest(x[:, : types.spend], neighbours)
    if scenario == "independent_graph":
        w = planted(truth, int(np.median(np.diff(w.start))), inside, rng)
    return cl.Snapshot(np.arange(len(x)), x, w, nearest(x, neighbours)), truth


def synthetic_grid(spark: SparkSession, sources: dict[str, Types], methods: list[tuple], scenarios: list[str], repeats: int = 5, seed: int = 0, indices: bool = False, **settings) -> DataFrame:
    """(source, scenario, repeat, method, ari, and INDICES if asked for): a task for each data set and method that takes long, and
    one for a data set's other methods. methods: (name, method, alpha, weight of the refinement). Methods that find no partition into so many types have no row."""
    ship(spark)
    names = list(sources)
    sent = spark.sparkContext.broadcast(sources)
    long = [[m] for m in methods if m[1] in ("canus", "canus_cosine", "dmon")]
    parts = [p for p in [*long, [m for m in methods if [m] not in long]] if p]
    cells = [(s, c, r, p) for p in range(len(parts)) for s in names for c in scenarios for r in range(repeats)]
    kinds = [("source", pa.string()), ("scenario", pa.string()), ("repeat", pa.int32()), ("method", pa.string()), ("ari", pa.float64()), *((i, pa.float64()) for i in INDICES if indices)]

    def work(t: pa.Table) -> pa.Table:
        from orrery.operators import tracking as tr

        out = []
        for r in t.drop_columns("place").to_pylist():
            part = parts[r.pop("part")]
            types = sent.value[r["source"]]
            rng = np.random.default_rng([seed, SCENARIOS.index(r["scenario"]), r["repeat"], names.index(r["source"])])
            s, truth = dataset(types, r["scenario"], rng, **settings)
            for name, method, alpha, weight in part:
                labels = cl.cluster(s, method, len(types.sizes), alpha, r["repeat"], **({} if weight is None else {"weight": weight}))
                if labels is not None:
                    scores = tr.panel(s, labels, repeats=1) if indices else {}
                    out.append({**r, "method": name, "ari": cl.adjusted_rand(labels, truth), **{i: scores[i] for i in INDICES if indices}})
        return pa.Table.from_pylist(out, pa.schema(kinds))

    schema = "source string, scenario string, repeat int, method string, ari double" + "".join(f", `{i}` double" for i in INDICES if indices)
    return apart(spark, cells, "source string, scenario string, repeat int, part int").applyInArrow(work, schema)


def win_counts(rows: DataFrame, reference: str) -> DataFrame:
    """(source, scenario, method, wins, repeats): in how many data sets the reference method is nearer to the truth."""
    key = ["source", "scenario", "repeat"]
    ref = rows.filter(F.col("method") == reference).select(*key, F.col("ari").alias("_ref"))
    both = rows.filter(F.col("method") != reference).join(ref, key)
    return both.groupBy("source", "scenario", "method").agg(F.sum((F.col("_ref") > F.col("ari")).cast("long")).alias("wins"), F.count(F.lit(1)).alias("repeats"))


def gap_stability(early: DataFrame, late: DataFrame, limit: float = 0.15) -> DataFrame:
    """early and late (id, y, gap, of two windows): R2 of the late window's out-of-fold predictions, rows at least `limit`
    above and below prediction, Spearman correlation of the gaps of rows that both have, and how many these are."""
    from orrery.operators import stats

    miss = F.log1p("gap")  # y less its prediction
    total = late.agg(F.avg("y").alias("m"))
    fit = late.crossJoin(F.broadcast(total)).agg(  # one row
        (1 - F.sum(miss * miss) / F.sum((F.col("y") - F.col("m")) ** 2)).alias("r2_out_of_fold"),
        F.sum((F.col("gap") >= limit).cast("long")).alias("above"), F.sum((F.col("gap") <= -limit).cast("long")).alias("below"))
    both = early.select("id", F.col("gap").alias("a")).join(late.select("id", F.col("gap").alias("b")), "id")
    rho = stats.spearman(both, "a", "b").select(F.col("rho").alias("spearman_first_last"))
    return fit.crossJoin(rho).crossJoin(both.agg(F.count(F.lit(1)).alias("nodes")))

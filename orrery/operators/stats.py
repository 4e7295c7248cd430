"""Rank tests and other statistics as windows and aggregates."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.operators.relational import average_rank, globally_ranked


def chi2_sf(x: float, df: float) -> float:
    """Upper tail of the chi-squared distribution (regularised incomplete gamma)."""
    a, x = df / 2, x / 2
    if x <= 0:
        return 1.0
    log = -x + a * math.log(x) - math.lgamma(a)
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1 - total * math.exp(log)
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        step = d * c
        h *= step
        if abs(step - 1) < 1e-15:
            break
    return math.exp(log) * h


def normal_sf(z: float) -> float:
    return math.erfc(z / math.sqrt(2)) / 2


def two_sided(z: Column) -> Column:
    """Two-sided tail of the standard normal distribution (error below 2e-7; Abramowitz and Stegun 7.1.26)."""
    z = F.abs(z)
    k = 1 / (1 + 0.3275911 * z / math.sqrt(2))
    #: The formula's coefficients, by falling power.
    series = reduce(lambda a, c: (a + c) * k, (1.061405429, -1.453152027, 1.421413741, -0.284496736, 0.254829592), F.lit(0.0))
    return series * F.exp(-z * z / 2)


def large_groups(df: DataFrame, group: str, least: int) -> DataFrame:
    """Rows of groups that have `least` rows or more."""
    return df.join(df.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least).select(group), group, "left_semi")


def kruskal_wallis(df: DataFrame, group: str, value: str) -> DataFrame:
    """One row: h (corrected for ties), eta2 = (h - k + 1) / (n - k), k, n."""
    r = globally_ranked(df.select(group, value).filter(F.col(value).isNotNull() & F.col(group).isNotNull()), value)
    g = r.groupBy(group).agg(F.sum("_r").alias("s"), F.count(F.lit(1)).cast("double").alias("m")).agg(F.sum(F.pow("s", 2) / F.col("m")).alias("q"), F.count(F.lit(1)).cast("double").alias("k"), F.sum("m").alias("n"))
    ties = r.groupBy(value).agg(F.count(F.lit(1)).cast("double").alias("t")).agg(F.sum(F.pow("t", 3) - F.col("t")).alias("ties"))
    h = (12 / (F.col("n") * (F.col("n") + 1)) * F.col("q") - 3 * (F.col("n") + 1)) / (1 - F.col("ties") / (F.pow("n", 3) - F.col("n")))
    return g.crossJoin(ties).withColumn("h", h).select("h", ((F.col("h") - F.col("k") + 1) / (F.col("n") - F.col("k"))).alias("eta2"), F.col("k").cast("long").alias("k"), F.col("n").cast("long").alias("n"))


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """One row: auc from average ranks, u (Mann-Whitney), its normal approximation z (corrected for ties), n1, n0."""
    r = globally_ranked(df.select(label, score).filter(F.col(score).isNotNull()), score)
    one = r.agg(F.sum(F.when(F.col(label) == 1, F.col("_r"))).alias("s"), F.count(F.when(F.col(label) == 1, 1)).cast("double").alias("n1"), F.count(F.when(F.col(label) == 0, 1)).cast("double").alias("n0"))
    ties = r.groupBy(score).agg(F.count(F.lit(1)).cast("double").alias("t")).agg(F.sum(F.pow("t", 3) - F.col("t")).alias("ties"))
    u = F.col("s") - F.col("n1") * (F.col("n1") + 1) / 2
    n = F.col("n1") + F.col("n0")
    sd = F.sqrt(F.col("n1") * F.col("n0") / 12 * (n + 1 - F.col("ties") / (n * (n - 1))))
    return one.crossJoin(ties).select(F.try_divide(u, F.col("n1") * F.col("n0")).alias("auc"), u.alias("u"), F.try_divide(u - F.col("n1") * F.col("n0") / 2, sd).alias("z"), F.col("n1").cast("long").alias("n1"), F.col("n0").cast("long").alias("n0"))


def spearman(df: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    by = by or []
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    if not by:
        return globally_ranked(globally_ranked(both.select(x, y), x, "_x"), y, "_y").agg(F.corr("_x", "_y").alias("rho"))
    return both.withColumns({"_x": average_rank(x, by), "_y": average_rank(y, by)}).groupBy(*by).agg(F.corr("_x", "_y").alias("rho"))


def cramers_v(cells: DataFrame, x: str, y: str, n: str = "n") -> DataFrame:
    """cells (x, y, n), one row each: chi2 and v; empty cells of the table count with their expected values."""
    a, b = cells.groupBy(x).agg(F.sum(n).cast("double").alias("_a")), cells.groupBy(y).agg(F.sum(n).cast("double").alias("_b"))
    t = cells.agg(F.sum(n).cast("double").alias("t"))
    e = F.col("_a") * F.col("_b") / F.col("t")
    # Sum over all cells of (o - e)^2 / e = sum of o^2 / e over filled cells, less the total.
    q = cells.join(a, x).join(b, y).crossJoin(F.broadcast(t)).agg(F.sum(F.pow(F.col(n), 2) / e).alias("q"))
    k = a.agg(F.count(F.lit(1)).alias("ka")).crossJoin(b.agg(F.count(F.lit(1)).alias("kb")))
    out = q.crossJoin(t).crossJoin(k).withColumn("chi2", F.col("q") - F.col("t"))
    return out.select("chi2", F.sqrt(F.try_divide(F.greatest("chi2", F.lit(0.0)), F.col("t") * (F.least("ka", "kb") - 1))).alias("v"))

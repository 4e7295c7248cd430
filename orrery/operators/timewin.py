"""Windows over monthly panels. Months are integers (year * 12 + month - 1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.scalars import month_number, quarter_key  # noqa: F401


def window_ends(first: int, last: int, length: int = 12) -> list[int]:
    """Quarter ends with `length` months of history."""
    return [m for m in range(first + length - 1, last + 1) if m % 3 == 2]


def in_windows(df: DataFrame, month: str, ends: list[int], length: int = 12, name: str = "window") -> DataFrame:
    """Each row once for every window that holds its month: at most length / 3 copies, made before the aggregation."""
    lo = F.lit(min(ends, default=0))
    first = F.col(month) + F.pmod(F.lit(2) - F.col(month), F.lit(3))  # the quarter end at or after the month
    span = F.sequence(F.lit(0), F.lit(length // 3 - 1))
    out = df.withColumn(name, F.explode(F.transform(span, lambda i: (first + 3 * i).cast("int"))))
    return out.filter(F.col(name).between(lo, F.lit(max(ends, default=-1))))


def with_median(df: DataFrame, value: Column, by: list[str], name: str) -> DataFrame:
    """Adds the exact median of the period's rows. Values combine before they meet, and no row is sorted or carried with them."""
    return df.join(df.groupBy(*by).agg(F.median(value).alias(name)), by)


def with_relative_level(df: DataFrame, value: str, by: list[str], name: str = "rel") -> DataFrame:
    """Adds the log of the value over the median of its period."""
    return with_median(df, F.col(value), by, "_median").withColumn(name, F.ln(F.col(value) / F.col("_median"))).drop("_median")


def trailing_year(df: DataFrame, key: list[str], year: str, quarter: str, ytd: str) -> DataFrame:
    """Trailing twelve months from year-to-date means: the fourth quarter as it is, else
    (3 q Y(y, q) + 12 Y(y - 1, 4) - 3 q Y(y - 1, q)) / 12, and the year-to-date value where history is missing (`fallback`)."""
    last = df.select(*key, (F.col(year) + 1).alias(year), quarter, F.col(ytd).alias("_same"))
    full = df.filter(F.col(quarter) == 4).select(*key, (F.col(year) + 1).alias(year), F.col(ytd).alias("_full"))
    out = df.join(last, [*key, year, quarter], "left").join(full, [*key, year], "left")
    q = 3 * F.col(quarter)
    value = (q * F.col(ytd) + 12 * F.col("_full") - q * F.col("_same")) / 12
    return out.withColumns({"trailing": F.when(F.col(quarter) == 4, F.col(ytd)).otherwise(F.coalesce(value, F.col(ytd))), "fallback": (F.col(quarter) != 4) & value.isNull()}).drop("_same", "_full")


def interpolate_stock(stocks: DataFrame, ends: DataFrame, key: str, year: str, value: str) -> DataFrame:
    """Stocks at the start of years, read at the middle of twelve-month windows (column `end`, a month number)."""
    mid = F.col("end") - 5.5
    base = F.floor(mid / 12)
    at = ends.withColumn("_y", base.cast("int")).withColumn("_w", F.greatest(F.lit(0.0), F.least(F.lit(1.0), (mid - base * 12) / 12)))
    a = stocks.select(key, F.col(year).alias("_y"), F.col(value).alias("_a"))
    b = stocks.select(key, (F.col(year) - 1).alias("_y"), F.col(value).alias("_b"))
    out = at.join(a, [key, "_y"], "left").join(b, [key, "_y"], "left")
    start, stop = F.coalesce("_a", "_b"), F.coalesce("_b", "_a")
    return out.withColumn(value, start + F.col("_w") * (stop - start)).drop("_a", "_b", "_y", "_w")


def residual_growth(df: DataFrame, key: str, period: str, value: str) -> DataFrame:
    """Difference of logs along time, less the median of its period."""
    w = Window.partitionBy(key).orderBy(period)
    d = df.withColumn("growth", F.ln(value) - F.lag(F.ln(value)).over(w)).filter(F.col("growth").isNotNull())
    return with_median(d, F.col("growth"), [period], "_median").withColumn("growth", F.col("growth") - F.col("_median")).drop("_median")


def residual_level(df: DataFrame, period: str, value: str) -> DataFrame:
    return with_median(df, F.ln(value), [period], "_median").withColumn("level", F.ln(value) - F.col("_median")).drop("_median")


def standardized(df: DataFrame, key: str, value: str) -> DataFrame:
    """z-scores of each series (ddof 0, spread at least 1e-12)."""
    w = Window.partitionBy(key)
    return df.withColumn("z", (F.col(value) - F.avg(value).over(w)) / F.greatest(F.stddev_pop(value).over(w), F.lit(1e-12)))


def lagged_correlation(z: DataFrame, key: str, t: str, max_lag: int, length: int) -> DataFrame:
    """z (key, t, z) with t from 0 and `length` periods: for each ordered pair the lag with the largest correlation
    (mean product over length - |lag| periods); the smallest |lag| wins, plus before minus. A positive lag at (i, j)
    means that j leads i."""
    lags = F.explode(F.sequence(F.lit(-max_lag), F.lit(max_lag))).alias("lag")
    a = z.select(F.col(key).alias("i"), (F.col(t)).alias("t"), F.col("z").alias("a"), lags).withColumn("u", F.col("t") - F.col("lag"))
    b = z.select(F.col(key).alias("j"), F.col(t).alias("u"), F.col("z").alias("b"))
    c = a.join(b, "u").filter("i <> j").groupBy("i", "j", "lag").agg(F.round(F.sum(F.col("a") * F.col("b")) / (length - F.abs(F.first("lag"))), 9).alias("corr"))
    best = F.max(F.struct("corr", (-F.abs("lag")).alias("near"), F.sign("lag").alias("plus"), "lag")).alias("m")
    return c.groupBy("i", "j").agg(best).select("i", "j", "m.corr", "m.lag")

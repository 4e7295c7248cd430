"""Relational building blocks: shares, versions, fallback lookups, fills, ranks, roll-ups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.scalars import round_cut  # noqa: F401
from orrery.tables import written


def shares(df: DataFrame, cols: list[str], total: str, rest: str | None = None) -> DataFrame:
    """Each column over the total, and the remainder as `rest`."""
    out = df.withColumns({c: F.try_divide(c, total) for c in cols})
    return out.withColumn(rest, 1 - reduce(lambda a, b: a + b, [F.col(c) for c in cols])) if rest else out


def wide(df: DataFrame, keys: list[str], category: str, values: list[str], measure: Column) -> DataFrame:
    """Long to wide with an explicit list of categories (no pass to find them); missing cells are 0."""
    return df.groupBy(*keys).pivot(category, values).agg(measure).fillna(0, values)


def long(df: DataFrame, keys: list[str], cols: list[str], name: str = "category", value: str = "value") -> DataFrame:
    return df.unpivot(keys, cols, name, value)


def latest(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_r = 1").drop("_r")


def match_fallback(facts: DataFrame, lookup: DataFrame, direct: str, stable: str, code: str = "code", target: str = "id") -> DataFrame:
    """The target of the direct code, else of the stable code; `matched` says which. Facts without either go."""
    a = lookup.select(F.col(code).alias(direct), F.col(target).alias("_a"))
    b = lookup.select(F.col(code).alias(stable), F.col(target).alias("_b"))
    out = facts.join(a, direct, "left").join(b, stable, "left")
    how = F.when(F.col("_a").isNotNull(), "direct").when(F.col("_b").isNotNull(), "stable")
    return out.withColumns({target: F.coalesce("_a", "_b"), "matched": how}).drop("_a", "_b").filter(F.col(target).isNotNull())


def mutual_fill(a: DataFrame, b: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Full outer join in which each side fills the other's nulls; a comes first."""
    right = b.select(*keys, *(F.col(c).alias(f"_{c}") for c in cols))
    return a.join(right, keys, "full_outer").select(*keys, *(F.coalesce(c, f"_{c}").alias(c) for c in cols))


def complete(df: DataFrame, entity: str, period: str, n_periods: int) -> DataFrame:
    """Rows of entities that have every period."""
    whole = df.groupBy(entity).agg(F.countDistinct(period).alias("_n")).filter(F.col("_n") == n_periods).select(entity)
    return df.join(whole, entity, "left_semi")


def fill_along(df: DataFrame, key: str, order: str, cols: list[str]) -> DataFrame:
    """Forward and then backward fill within a key."""
    w = Window.partitionBy(key).orderBy(order)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    return df.withColumns({c: F.coalesce(F.last(c, True).over(back), F.first(c, True).over(ahead)) for c in cols})


def fill_from_peers(df: DataFrame, col: str, levels: list[list[str]]) -> DataFrame:
    """Nulls become the median of peers, level by level, each level after the fill of the one before."""
    for keys in levels:
        if keys:
            peers = df.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(F.median(col).alias("_m"))
            same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
            df = df.join(peers, same, "left").withColumn(col, F.coalesce(col, "_m")).drop("_m", *(f"_{k}" for k in keys))
        else:
            df = df.crossJoin(F.broadcast(df.agg(F.median(col).alias("_m")))).withColumn(col, F.coalesce(col, "_m")).drop("_m")
    return df


def average_rank(value: str, by: list[str] | None = None) -> Column:
    """Rank with ties averaged."""
    part = by or []
    return F.rank().over(Window.partitionBy(*part).orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*part, value)) - 1) / 2


def counted_values(df: DataFrame, value: str, times: str | None = None) -> DataFrame:
    """(value, n, before): each distinct value with its count (or the sum of a column that says how often rows count) and the number of rows with smaller values. Values are dealt
    by range and written once; running sums then stay within a range, and only one row a range is summed in one place."""
    counts = df.groupBy(value).agg((F.sum(times) if times else F.count(F.lit(1))).alias("n")).repartitionByRange(value).withColumn("_p", F.spark_partition_id())
    counts = written(counts)
    total = counts.groupBy("_p").agg(F.sum("n").alias("_t"))
    offset = total.select("_p", F.coalesce(F.sum("_t").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("_p").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counts.join(F.broadcast(offset), "_p").select(value, "n", (F.col("_o") + inside).alias("before"))  # a row a range


def globally_ranked(df: DataFrame, value: str, name: str = "_r") -> DataFrame:
    """Adds the average rank over all rows, without sorting them in one task. Rows must have a value."""
    r = counted_values(df, value).select(value, (F.col("before") + (F.col("n") + 1) / 2).alias(name))
    return df.join(r, value)


def kth_largest(df: DataFrame, value: str, k: int, times: str | None = None):
    """The k-th largest value (the least one if there are fewer rows); rows count `times` where that is given."""
    c = counted_values(df, value, times)
    n = (df.agg(F.sum(times)).first()[0] or 0) if times else df.count()
    return c.filter(n - F.col("before") >= min(k, n)).agg(F.max(value)).first()[0]


def merge_children(df: DataFrame, parent: list[str], weight: str, means: list[str], sums: list[str], complete_col: str, coverage: float) -> DataFrame:
    """Roll-up of entities into parents: means weighted by the weight of complete children, sums over all children, and
    `complete` if the complete children hold `coverage` of the weight."""
    ok = F.when(F.col(complete_col), F.col(weight))
    mean = [F.try_divide(F.sum(F.col(c) * ok), F.sum(F.when(F.col(c).isNotNull(), ok))).alias(c) for c in means]
    out = df.groupBy(*parent).agg(*mean, *[F.sum(c).alias(c) for c in sums], F.sum(weight).alias(weight), F.sum(ok).alias("_ok"), F.count(F.lit(1)).alias("children"))
    return out.withColumn("complete", F.coalesce(F.col("_ok") >= coverage * F.col(weight), F.lit(False))).drop("_ok")


def contingency(df: DataFrame, x: str, y: str, value: Column | None = None) -> DataFrame:
    return df.groupBy(x, y).agg((F.count(F.lit(1)) if value is None else F.sum(value)).alias("n"))

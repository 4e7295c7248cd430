"""Joins of many rows with few groups, where one group may hold a third of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_PARTS = 32


def hot_keys(rows: DataFrame, keys: list[str], sizes: DataFrame | None = None) -> DataFrame | None:
    """Keys with more than an even share of the rows (the count over the number of shuffle partitions), with _parts, the
    number of such shares they hold. There are fewer of them than partitions, whatever the input. sizes: rows by key
    (_n), if they are known already."""
    spark = rows.sparkSession
    parts = max(LEAST_PARTS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    share = -(-rows.count() // parts)
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")) if sizes is None else sizes
    found = sizes.filter(F.col("_n") > share).select(*keys, F.ceil(F.col("_n") / share).cast("int").alias("_parts"))
    local = found.collect()
    return spark.createDataFrame(local, found.schema) if local else None


def salted_join(rows: DataFrame, groups: DataFrame, keys: list[str], how: str = "inner", hot: DataFrame | None = None) -> DataFrame:
    """rows ⋈ groups on keys (inner, left or left_semi), with the rows of hot keys and of null keys dealt over several
    parts; groups, with one row a key, is repeated for hot keys alone. rows must come straight from a table, so that a
    task that is run again numbers its rows alike. hot: from hot_keys, if it is known already."""
    hot = hot_keys(rows, keys) if hot is None else hot
    spread = max(LEAST_PARTS, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    none = F.col(keys[0]).isNull()
    for k in keys[1:]:
        none = none | F.col(k).isNull()
    number = F.monotonically_increasing_id()
    if hot is None:
        many = rows.withColumn("_part", F.when(none, F.pmod(number, F.lit(spread))).otherwise(0).cast("int"))
        few = groups.withColumn("_part", F.lit(0))
    else:
        many = rows.join(F.broadcast(hot), keys, "left")
        many = many.withColumn("_part", F.pmod(number, F.when(none, F.lit(spread)).otherwise(F.coalesce("_parts", F.lit(1)))).cast("int")).drop("_parts")
        few = groups.join(F.broadcast(hot), keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return many.join(few.hint("merge"), [*keys, "_part"], how).drop("_part")  # a few repeated rows look small; they are not sent to all

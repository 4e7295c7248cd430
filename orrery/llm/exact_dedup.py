"""Exact deduplication by progressive refinement, in DataFrame functions only.

Groups are refined in three steps: by length of the normalised text, then by a hash of its first characters, then by
SHA-256 of all of it. After each of the first two steps only rows whose group may still hold two rows or more go on;
what remains is told by a bitmap of hashed groups, of bounded size, which goes to the workers with the plan. A row of a
group alone may pass it (then the next step tells it apart), a row with a copy always does. So no row is shuffled to
refine groups: counts combine before they travel, full contents are read for survivors alone, and texts never move, but
for those of survivors in drop_copies.

Defined results: a null text counts as empty; a null id sorts after all others; of repeated rows with the
same id and text one is kept and the others are dropped (they count in group_size); an empty table
gives an empty result; columns of the input other than id and text are ignored, whatever their names (drop_copies
returns them). Which of several rows with equal id and text stays: any one in exact_dedup, which says nothing else of
them; in drop_copies the one whose other columns have the least hash.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.marks import Marked, marked
from orrery.llm.store import materialise
from orrery.skew import salted_join

#: Always true of the row number beside a computed text. The optimizer moves no condition on it below that column, where
#: the text would be computed again for each of its uses.
ONCE = "row >= 0"
SPACE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """Each run of white space becomes one space; null becomes empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def row_hash(docs: DataFrame) -> Column:
    """A hash of all columns that can be hashed."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema if not re.search("map<|variant", f.dataType.simpleString())])


def repeated(df: DataFrame, columns: list[str]) -> Marked:
    """The keys that two rows or more have."""
    return marked(materialise(df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*columns), "dedup-groups"), columns)


def refined(text: DataFrame, prefix: int) -> Column:
    """text (t, ...): a condition on len and pre, true for all rows whose length and prefix hash another row shares."""
    keys = materialise(text.select(*sketch(prefix)), "dedup-keys")
    by_length = repeated(keys, ["len"]).may_hold()
    return by_length & repeated(keys.filter(by_length), ["len", "pre"]).may_hold()


def sketch(prefix: int) -> list[Column]:
    return [F.length("t").alias("len"), F.xxhash64(F.substring("t", 1, prefix)).alias("pre")]


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = 128, digest_all: bool = False) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256 (null for rows that dropped out
    before the last step, unless digest_all, which takes their digest afterwards and for nothing but this column)."""
    text = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("t"), F.monotonically_increasing_id().alias("row"))
    passes = refined(text, prefix)
    rows = text.select("*", *sketch(prefix)).filter(ONCE)
    full = materialise(rows.filter(passes).select("doc_id", "row", "len", "pre", F.unhex(F.sha2("t", 256)).alias("sha")), "dedup-survivors")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    groups = full.groupBy("len", "pre", "sha").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"), F.min(order)["row"].alias("first")).filter("n > 1")
    found = salted_join(full, groups, ["len", "pre", "sha"], "left")
    alone = F.col("n").isNull()
    out = found.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("least")).alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), (alone | (F.col("row") == F.col("first"))).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
    digest = F.sha2("t", 256) if digest_all else F.lit(None).cast("string")
    rest = rows.filter(~passes).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), digest.alias("text_sha256"))
    return out.unionByName(rest)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = 128) -> DataFrame:
    """Of rows with equal texts the one with the smallest id, with all their columns. Rows that the refinement finds
    alone are passed on where they are; the others meet by digest, one of a group leaving each task."""
    whole = docs.select(F.struct(*docs.columns).alias("whole"), F.monotonically_increasing_id().alias("row"), normalised(F.col(text_col)).alias("t"), F.struct(F.col(id_col).isNull(), F.col(id_col), row_hash(docs)).alias("rank"))
    passes = refined(whole.select("t"), prefix)
    rows = whole.select("*", *sketch(prefix)).filter(ONCE)
    copies = rows.filter(passes).select("whole", "rank", "len", "pre", F.unhex(F.sha2("t", 256)).alias("sha"))
    one = copies.groupBy("len", "pre", "sha").agg(F.min_by("whole", "rank").alias("whole"))
    return rows.filter(~passes).select("whole.*").unionByName(one.select("whole.*"))


def op8_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return exact_dedup(docs, digest_all=True)


OP8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
h AS (SELECT doc_id, sha256(t) AS text_sha256 FROM d)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM h WINDOW w AS (PARTITION BY text_sha256)
"""

"""The corpus pipeline: quality rules, toxicity, exact dedup, near-duplicate join, packing.

Each stage takes (spark, docs, sf_dir) and all that the stage before kept, and returns a table that is written
as Parquet and read again as the next stage's docs. All but the last return the columns of their input.

Defined results: a null text counts as empty, so the quality rules reject it. A row is known by its columns, not by
its id: rows with a null id, or with an id that other rows have too, are judged each by its own text, and of rows with
equal texts, or that links connect, the one with the smallest id stays (null ids last; then the one whose text, or
whose columns, have the least hash). Texts are read whole at any length. Rows that a stage keeps come out once for
each time they came in, until exact dedup keeps one of them. Columns that the operators don't know are carried,
whatever their names; an empty table gives an empty result. A document with several labels is toxic if one says so,
and labels without a document, or null, are skipped; without labels of both kinds no document is called toxic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import exact_dedup, jaccard_join, packing, quality_rules, toxicity
from orrery.llm.store import materialise
from orrery.shipping import ship

KEEP = 0.5  # documents with a toxicity score below this stay


def whole(docs: DataFrame) -> DataFrame:
    """The rows as one column beside the text, so that no column's name meets one of an operator's."""
    return docs.select(F.struct(*docs.columns).alias("_row"), "text")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail no rule of policy v1."""
    ship(spark)
    return quality_rules.apply_policy(quality_rules.ledger(whole(docs), keep=["_row"]), "v1").filter("kept").select("_row.*")


def non_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels of those that came this far, doesn't call toxic."""
    ship(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    net = toxicity.fit(docs, labels)
    return toxicity.score(whole(docs), net, keep=["_row"]).filter(F.col("toxic_score") < KEEP).select("_row.*")


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id."""
    return exact_dedup.drop_copies(docs)


def one_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that Jaccard links connect the one with the smallest id."""
    ship(spark)
    return jaccard_join.drop_near_copies(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents with their places in sequences of 2048 tokens."""
    ship(spark)
    return packing.pack(packing.split_pieces(docs, packing.byte_bpe))


STAGES = [("quality_rules", quality), ("toxicity", non_toxic), ("exact_dedup", distinct_texts), ("jaccard_join", one_of_group), ("packing", packed)]
#: The classifier cannot be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

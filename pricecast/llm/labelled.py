"""A bounded sample of labelled documents to learn from."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricecast.llm.common import held_out


def training_labels(labels: DataFrame, label: str) -> DataFrame:
    """doc_id and y (0 or 1) of the rows that may be learnt from, one row per id: 1 if any of its rows says so."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col("doc_id")))
    return usable.groupBy("doc_id").agg(F.max(F.col(label)).cast("int").alias("y"))


def sample(docs: DataFrame, train: DataFrame, per_class: int, text: str = "text") -> DataFrame:
    """doc_id, text, y of at most ``per_class`` documents of each label, chosen by a hash of the id."""
    order = Window.partitionBy("y").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = train.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= per_class).drop("_n")
    # At most 2 * per_class rows.
    met = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    return met.groupBy("doc_id", "y").agg(F.min("text").alias("text"))


def class_sizes(train: DataFrame) -> dict[int, int]:
    """Training rows of each label, all of them counted."""
    return {0: 0, 1: 0} | {r.y: r.n for r in train.groupBy("y").agg(F.count("*").alias("n")).collect()}

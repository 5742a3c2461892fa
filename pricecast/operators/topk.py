"""Ranking, positional and best-of selections, set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def top_hours(df: DataFrame, count: int, keys: Sequence[str] = ("product",), value: str = "point_forecast") -> DataFrame:
    """The dearest hours per key, the earlier one first on ties.

    Spark keeps only the first ``count`` rows of each key per input partition before the shuffle.
    """
    w = W.partitionBy(*keys).orderBy(F.desc(value), "timestamp")
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= count)


def nth_hour(df: DataFrame, position: int, keys: Sequence[str] = ("product",)) -> DataFrame:
    """Row number ``position`` (from 0) of each forecast in time order; limited per partition as above."""
    w = W.partitionBy(*keys).orderBy("timestamp")
    ranked = df.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= position + 1)
    return ranked.where(F.col("_place") == position + 1).drop("_place")


def best(df: DataFrame, metric: str, label: str, groups: Sequence[str] = ()) -> DataFrame:
    """The label with the best mean metric: highest for r2, least absolute for bias, else lowest."""
    scored = df.groupBy(*groups, label).agg(F.avg(metric).alias("score"))
    cost = {"r2": -F.col("score"), "bias": F.abs("score")}.get(metric, F.col("score"))
    order = F.struct(cost, F.col(label))
    return scored.where("score is not null").groupBy(*groups).agg(
        F.min_by(label, order).alias(label), F.min_by("score", order).alias("score")
    )


def concat(*frames: DataFrame) -> DataFrame:
    result = frames[0]
    for df in frames[1:]:
        result = result.unionByName(df, allowMissingColumns=True)
    return result


def difference(expected: DataFrame, actual: DataFrame, columns: Sequence[str]) -> DataFrame:
    return expected.select(*columns).distinct().join(actual.select(*columns), list(columns), "left_anti")


def common_times(*frames: DataFrame) -> DataFrame:
    """Distinct times of several feeds with the number of feeds that have them: one shuffle for both
    the intersection (all feeds) and the union (any feed)."""
    marked = [df.select("timestamp", F.lit(1 << i).alias("_feed")) for i, df in enumerate(frames)]
    flags = concat(*marked).groupBy("timestamp").agg(F.bit_or("_feed").alias("_feeds"))
    return flags.select("timestamp", F.bit_count("_feeds").alias("feeds"))

"""Percentiles and intervals of forecast samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricecast import config
from pricecast.functions import arrays


def percentile_columns(df: DataFrame, percentiles: Sequence[float]) -> DataFrame:
    """``p10``, ``p50`` … of each row's samples; sorted once per row."""
    ordered = df.withColumn("_ordered", F.sort_array("samples"))
    made = {f"p{q:g}": arrays.sorted_percentile(F.col("_ordered"), q / 100) for q in percentiles}
    return ordered.withColumns(made).drop("_ordered")


def confidence_interval(df: DataFrame, level: float) -> DataFrame:
    low, high = arrays.interval(F.col("samples"), level)
    return df.withColumns({"interval_low": low, "interval_high": high})


def display_frame(df: DataFrame, percentiles: tuple[float, float] = config.DISPLAY_PERCENTILES) -> DataFrame:
    """Bounds instead of samples; the fallback flag defaults to false."""
    flag = F.coalesce("is_fallback", F.lit(False)) if "is_fallback" in df.columns else F.lit(False)
    low, high = percentiles
    return df.select(
        F.col("timestamp"),
        F.col("product"),
        F.col("point_forecast"),
        arrays.percentile(F.col("samples"), low / 100).alias("lower_bound"),
        arrays.percentile(F.col("samples"), high / 100).alias("upper_bound"),
        flag.alias("is_fallback"),
    )


def uncertainty_band(df: DataFrame, product: str, percentiles: tuple[float, float] = config.DISPLAY_PERCENTILES) -> DataFrame:
    shown = display_frame(df.where(F.col("product") == product), percentiles)
    return shown.select("timestamp", "point_forecast", "lower_bound", "upper_bound")


def distribution_markers(df: DataFrame, percentiles: Sequence[float] = (10, 50, 90)) -> DataFrame:
    """One row per forecast hour and percentile."""
    ordered = F.sort_array("samples")
    marks = F.array(
        *[
            F.struct(F.lit(float(q)).alias("percentile"), arrays.sorted_percentile(ordered, q / 100).alias("value"))
            for q in percentiles
        ]
    )
    return df.select("timestamp", "product", F.inline(marks))

"""Tables as a reader sees them: labels, formatted prices, ranges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricecast import config
from pricecast.functions import arrays, calendar
from pricecast.operators.uncertainty import lookup
from pricecast.sources.scratch import Settle, as_is


def _signed() -> Column:
    return lookup({row[0]: row[4] for row in config.PRODUCT_ATTRIBUTES}, F.col("product"), False)


def known_products(products: Sequence[str]) -> list[str]:
    unknown = [p for p in products if p not in config.PRODUCTS]
    if unknown:
        raise ValueError(f"unknown products: {unknown}")
    return list(products)


def by_product(df: DataFrame, product: str) -> DataFrame:
    return df.where(F.col("product") == known_products([product])[0])


def by_products(df: DataFrame, products: Sequence[str]) -> DataFrame:
    return df.where(F.col("product").isin(known_products(products)))


def by_date_range(df: DataFrame, start: Column, end: Column) -> DataFrame:
    """Closed range; an end at midnight includes that day."""
    return df.where(F.col("timestamp").between(start, calendar.closed_end(end)))


def time_series_table(df: DataFrame, product: str | None = None) -> DataFrame:
    """Display rows with labels, formatted prices and range."""
    signed = _signed()
    rows = df if product is None else by_product(df, product)
    low, high = F.col("lower_bound"), F.col("upper_bound")
    return rows.select(
        "timestamp",
        "product",
        "point_forecast",
        calendar.date_hour_label(F.col("timestamp")).alias("x_label"),
        calendar.money(F.col("point_forecast"), signed).alias("point_text"),
        calendar.money(low, signed).alias("lower_text"),
        calendar.money(high, signed).alias("upper_text"),
        (high - low).alias("range"),
        calendar.money_range(low, high, signed).alias("range_text"),
    )


def hourly_table(df: DataFrame, percentiles: Sequence[int] = config.DISPLAY_PERCENTILES) -> DataFrame:
    """One row per hour: point, percentiles and the range between the outer ones."""
    signed = _signed()
    ordered = df.withColumn("_s", F.sort_array("samples"))
    at = {q: arrays.sorted_percentile(F.col("_s"), q / 100) for q in percentiles}
    low, high = at[min(percentiles)], at[max(percentiles)]
    return ordered.select(
        "timestamp",
        "product",
        calendar.date_hour_label(F.col("timestamp")).alias("hour_label"),
        "point_forecast",
        calendar.money(F.col("point_forecast"), signed).alias("point_text"),
        *[c.alias(f"percentile_{q}") for q, c in at.items()],
        *[calendar.money(c, signed).alias(f"percentile_{q}_text") for q, c in at.items()],
        (high - low).alias("range"),
        calendar.money_range(low, high, signed).alias("range_text"),
    )


def comparison_table(df: DataFrame, products: Sequence[str]) -> DataFrame:
    return by_products(df, products).select(
        "timestamp",
        "product",
        "point_forecast",
        calendar.date_hour_label(F.col("timestamp")).alias("x_label"),
        calendar.money(F.col("point_forecast"), _signed()).alias("point_text"),
    )


def price_spikes(df: DataFrame, multiple: float = 2.0, settle: Settle = as_is) -> DataFrame:
    """Points above mean + multiple × deviation (n − 1) of their product."""
    figures = df.groupBy("product").agg(
        F.avg("point_forecast").alias("_mean"), F.stddev_samp("point_forecast").alias("_std")
    )
    threshold = F.col("_mean") + multiple * F.col("_std")
    point = F.col("point_forecast")
    return (
        df.join(settle(figures), "product")
        .withColumn("threshold", threshold)
        .where(point > F.col("threshold"))
        .select(
            "timestamp",
            "product",
            "point_forecast",
            "threshold",
            (point - F.col("_mean")).alias("deviation"),
            ((point / F.nullif("_mean", F.lit(0.0)) - 1) * 100).alias("deviation_percent"),
            calendar.date_hour_label(F.col("timestamp")).alias("hour_label"),
        )
    )

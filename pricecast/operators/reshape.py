"""Pivots, unpivots and changes between wide and array samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricecast import config
from pricecast.functions import arrays
from pricecast.functions.timeline import fill


def pivot_generation(
    df: DataFrame, fuels: Sequence[str], keys: Sequence[str] = ("timestamp",), missing: float | None = 0.0
) -> DataFrame:
    """One ``generation_<fuel>`` column per fuel: the sum per key."""
    wide = df.groupBy(*keys).pivot("fuel_type", list(fuels)).agg(F.sum("generation_mw"))
    named = wide.select(*keys, *[F.col(f"`{f}`").alias(f"generation_{f}") for f in fuels])
    return named if missing is None else named.fillna(missing, [f"generation_{f}" for f in fuels])


def pivot_prices(
    df: DataFrame, products: Sequence[str], keys: Sequence[str] = ("timestamp",)
) -> DataFrame:
    """One ``price_<product>`` column per product: the mean per key."""
    wide = df.groupBy(*keys).pivot("product", list(products)).agg(F.avg("price"))
    return wide.select(*keys, *[F.col(f"`{p}`").alias(f"price_{p}") for p in products])


def price_matrix(
    df: DataFrame, products: Sequence[str] | None = None, series: Sequence[str] = ()
) -> DataFrame:
    """Price pivot filled forward, then backward; a product without rows is a null column."""
    names = list(products or config.PRODUCTS)
    wide = pivot_prices(df, names, [*series, "timestamp"])
    return fill(wide, series, "timestamp", [f"price_{p}" for p in names], ("forward", "backward"))


def heatmap(df: DataFrame, product: str) -> DataFrame:
    """Date × hour matrix of the point forecast of one product (earliest row of each cell)."""
    cells = df.where(F.col("product") == product).select(
        F.to_date("timestamp").alias("date"), F.hour("timestamp").alias("hour"), "timestamp", "point_forecast"
    )
    wide = cells.groupBy("date").pivot("hour", list(range(24))).agg(F.min_by("point_forecast", "timestamp"))
    return wide.select("date", *[F.col(f"`{h}`").alias(f"hour_{h:02d}") for h in range(24)])


def long_metrics(df: DataFrame, ids: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """One row per id and metric."""
    return df.unpivot(list(ids), list(metrics), "metric", "value")


def distribution(df: DataFrame) -> DataFrame:
    """One row per sample of a forecast."""
    kept = [c for c in df.columns if c != "samples"]
    return df.select(*kept, F.posexplode("samples").alias("sample_index", "sample_value"))


def wide_to_array(df: DataFrame, prefix: str = "sample_") -> DataFrame:
    columns = [c for c in df.columns if c.startswith(prefix)]
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, arrays.from_wide(columns).alias("samples"))


def array_to_wide(df: DataFrame, count: int = config.SAMPLE_COUNT) -> DataFrame:
    kept = [c for c in df.columns if c != "samples"]
    return df.select(*kept, *arrays.to_wide(F.col("samples"), count))

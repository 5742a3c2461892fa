"""Spread of a point forecast: methods are columns over the residual summary of (product, hour)."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricecast import config

Estimate = tuple[Column, Column]

LEAST_SHARE = 0.05
NO_HISTORY_SHARE = 0.10


def from_residuals(point: Column) -> Estimate:
    size = F.abs(point)
    mean = point + F.coalesce(F.col("res_mean"), F.lit(0.0))
    std = F.greatest(F.col("res_std"), size * LEAST_SHARE)
    return mean, F.when(F.col("res_std").isNull(), size * NO_HISTORY_SHARE).otherwise(std)


def from_percentage(point: Column) -> Estimate:
    mean = point * (1 + F.coalesce(F.col("pct_mean"), F.lit(0.0)))
    share = F.when(F.col("pct_std").isNull(), NO_HISTORY_SHARE).otherwise(
        F.greatest(F.col("pct_std"), F.lit(LEAST_SHARE))
    )
    return mean, F.abs(point) * share


def lookup(values: dict[str, object], key: Column, default: object) -> Column:
    table = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in values.items()))
    return F.coalesce(F.try_element_at(table, key), F.lit(default))


def fixed(point: Column) -> Estimate:
    return point, lookup(config.FIXED_STD, F.col("product"), config.DEFAULT_FIXED_STD)


def error_trend() -> Column:
    """Growth of the mean error size, last three against the three before; 0 with too few errors."""
    older = F.col("older_abs")
    trend = (F.col("recent_abs") - older) / F.greatest(older, F.lit(1.0))
    return F.when((F.col("errors") < 3) | older.isNull(), 0.0).otherwise(trend)


def adaptive(point: Column) -> Estimate:
    mean, std = from_residuals(point)
    grown = std * (1 + F.greatest(F.lit(0.0), error_trend()))
    return mean, F.when(F.col("recent_abs").isNull(), std).otherwise(grown)


METHODS: dict[str, Callable[[Column], Estimate]] = {
    "residuals": from_residuals,
    "percentage": from_percentage,
    "fixed": fixed,
    "adaptive": adaptive,
}


def with_method(name: str, method: Callable[[Column], Estimate]) -> dict[str, Callable[[Column], Estimate]]:
    """The known methods plus one of your own: a function of the point column over the joined summary."""
    return {**METHODS, name: method}


def estimate(
    rows: DataFrame,
    summary: DataFrame,
    chosen: dict[str, str] | None = None,
    default: str = "residuals",
    factors: dict[str, float] | None = None,
    methods: dict[str, Callable[[Column], Estimate]] | None = None,
    groups: Sequence[str] = ("product", "hour"),
) -> DataFrame:
    """Add ``mean`` and ``std`` to point forecasts, by the method chosen for each product.

    The summary has one row per (product, hour); rows without history keep nulls there.
    """
    known = methods or METHODS
    used = {p: m if m in known else default for p, m in (chosen or {}).items()}
    point = F.col("point_forecast")
    mean, std = known[default](point)
    for product, name in used.items():
        m, s = known[name](point)
        mean = F.when(F.col("product") == product, m).otherwise(mean)
        std = F.when(F.col("product") == product, s).otherwise(std)
    factor = lookup(factors or config.STD_FACTORS, F.col("product"), 1.0)
    joined = rows.join(summary, list(groups), "left")
    return joined.select(*rows.columns, mean.alias("mean"), (std * factor).alias("std"))

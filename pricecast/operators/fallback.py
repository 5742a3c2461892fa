"""Replacing a failed forecast by an earlier one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricecast import config
from pricecast.operators.joins import days_back


def suitable(allow_cascading: bool = True, min_hours: int = config.FALLBACK_MIN_HOURS) -> Column:
    """Whether an index row may serve as a source."""
    known = F.col("product").isNotNull() & F.col("first_hour").isNotNull() & F.col("generation_timestamp").isNotNull()
    long_enough = F.coalesce(F.col("horizon_hours") >= min_hours, F.lit(True))
    fresh = F.lit(True) if allow_cascading else ~F.coalesce("is_fallback", F.lit(False))
    return known & long_enough & fresh


def find_source(
    targets: DataFrame, index: DataFrame, max_days: int = config.FALLBACK_DAYS, allow_cascading: bool = True
) -> DataFrame:
    """The newest suitable forecast dated 1..max_days before each (product, target_date)."""
    return days_back(targets, index.where(suitable(allow_cascading)), max_days)


def shift_to_target(rows: DataFrame, as_of: Column) -> DataFrame:
    """Rows with ``forecast_date`` and ``target_date``: moved by whole days, marked and restamped."""
    days = F.datediff("target_date", "forecast_date")
    return rows.withColumns(
        {
            "timestamp": F.col("timestamp") + F.make_dt_interval(days),
            "generation_timestamp": as_of,
            "is_fallback": F.lit(True),
        }
    )


def retrieve(
    targets: DataFrame,
    index: DataFrame,
    store: DataFrame,
    as_of: Column,
    max_days: int = config.FALLBACK_DAYS,
    allow_cascading: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """(fallback rows for all targets, targets without a source)."""
    sources = find_source(targets, index, max_days, allow_cascading)
    wanted = sources.select("product", "forecast_date", "target_date")
    rows = shift_to_target(store.join(wanted, ["product", "forecast_date"]), as_of)
    keys = ["product", "target_date"]
    return rows.drop("forecast_date").withColumnRenamed("target_date", "forecast_date"), targets.join(
        sources.select(*keys), keys, "left_anti"
    )


def lineage(sources: DataFrame) -> DataFrame:
    """Where each fallback comes from."""
    return sources.select(
        "product",
        F.col("forecast_date").alias("source_date"),
        "target_date",
        F.col("age_days").alias("fallback_age_days"),
        F.coalesce("is_fallback", F.lit(False)).alias("is_cascading_fallback"),
        F.col("generation_timestamp").alias("original_generation_time"),
        "horizon_hours",
    )


def fill_in(fresh: DataFrame, failed: DataFrame, substitute: DataFrame, keys=("forecast_date", "product")) -> DataFrame:
    """The new forecast, but for failed (date, product) pairs the substitute."""
    pairs = failed.select(*keys).distinct()
    good = fresh.join(pairs, list(keys), "left_anti")
    used = substitute.join(pairs, list(keys), "left_semi")
    return good.unionByName(used.select(*good.columns))

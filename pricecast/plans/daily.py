"""The forecasting job: features → point forecasts → spread → samples → checks → store, or an earlier forecast.

Runs are rows: one run date gives the daily job, many give a backfill, in the same plan.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricecast.config import RunSettings
from pricecast.functions import calendar
from pricecast.operators import align, fallback, features, models, sampling, uncertainty, validate
from pricecast.sources import scratch
from pricecast.sources import store as forecast_store


@dataclass
class Feeds:
    load: DataFrame
    prices: DataFrame
    generation: DataFrame


def feature_table(feeds: Feeds, settings: RunSettings, keys: Sequence[str] = ()) -> DataFrame:
    """Base features of every hour of the feeds: computed once, whatever the number of runs."""
    return scratch.settle(
        features.base_features(
            feeds.load, feeds.prices, feeds.generation, settings.products, settings.fuels, keys, scratch.settle
        )
    )


def training_rows(table: DataFrame, settings: RunSettings) -> DataFrame:
    """One row per (product, hour of day, timestamp) with the price to learn."""
    prices = F.create_map(*[x for p in settings.products for x in (F.lit(p), F.col(f"price_{p}"))])
    long = table.withColumn("product", F.explode(F.array(*[F.lit(p) for p in settings.products])))
    return long.withColumn("price", F.try_element_at(prices, F.col("product"))).where("price is not null")


def train(table: DataFrame, names: Sequence[str], settings: RunSettings, created_at: Column | None = None) -> DataFrame:
    rows = training_rows(table, settings).dropna(subset=list(names))
    return models.train(rows, names, "price", created_at=created_at)


def horizon_rows(runs: DataFrame, settings: RunSettings) -> DataFrame:
    """Runs with ``run_time`` → one row per run, product and forecast hour."""
    dated = runs.withColumns(
        {
            "start": calendar.next_midnight(F.col("run_time")),
            "forecast_date": F.date_add(F.to_date("run_time"), 1),
        }
    )
    return align.hour_grid(dated, "start", settings.horizon_hours).withColumn(
        "product", F.explode(F.array(*[F.lit(p) for p in settings.products]))
    )


def point_forecasts(
    runs: DataFrame, table: DataFrame, trained: DataFrame, names: Sequence[str], settings: RunSettings
) -> DataFrame:
    wanted = horizon_rows(runs, settings)
    rows = wanted.join(table.select("timestamp", *[n for n in names if n != "hour"]), "timestamp", "left")
    scored = models.predict(rows.withColumn("hour", F.hour("timestamp")), trained, names)
    return scored.select("run_time", "forecast_date", "timestamp", "product", "hour", "point_forecast")


def with_samples(points: DataFrame, summary: DataFrame, settings: RunSettings) -> DataFrame:
    """Point forecasts → forecast rows with samples. Rows that cannot be sampled are left out: the
    completeness check then finds them missing."""
    spread = uncertainty.estimate(points, summary, settings.methods, settings.method)
    usable, _ = sampling.split_inputs(spread)
    drawn = sampling.draw(
        usable, settings.sample_count, settings.seed, settings.distribution, settings.distributions
    )
    return drawn.select(
        "forecast_date",
        "timestamp",
        "product",
        "point_forecast",
        "samples",
        F.col("run_time").cast("timestamp").alias("generation_timestamp"),
        F.lit(False).alias("is_fallback"),
    )


def forecasts(
    runs: DataFrame,
    table: DataFrame,
    trained: DataFrame,
    summary: DataFrame,
    names: Sequence[str],
    settings: RunSettings,
) -> DataFrame:
    """Probabilistic forecasts of all runs, products and hours in one plan."""
    return with_samples(point_forecasts(runs, table, trained, names, settings), summary, settings)


def failed_pairs(fresh: DataFrame, runs: DataFrame, settings: RunSettings) -> DataFrame:
    """(forecast_date, product) pairs that lack hours or break the schema."""
    expected = horizon_rows(runs, settings).select("forecast_date", "product").distinct()
    whole = (
        fresh.where(F.size("samples") == settings.sample_count)
        .groupBy("forecast_date", "product")
        .agg(F.count_distinct("timestamp").alias("_hours"))
        .where(F.col("_hours") == settings.horizon_hours)
    )
    return expected.join(whole, ["forecast_date", "product"], "left_anti")


def with_fallback(
    fresh: DataFrame, runs: DataFrame, earlier: DataFrame, settings: RunSettings
) -> tuple[DataFrame, DataFrame]:
    """(forecasts with failed ones replaced from the store, pairs that have no source either)."""
    failed = failed_pairs(fresh, runs, settings)
    targets = failed.select("product", F.col("forecast_date").alias("target_date"))
    as_of = F.date_sub("target_date", 1).cast("timestamp")
    # Only the folders that can hold a source are read.
    dates = horizon_rows(runs, settings)
    oldest = dates.select(F.date_sub(F.min("forecast_date"), settings.fallback_days)).scalar()
    newest = dates.select(F.max("forecast_date")).scalar()
    earlier = earlier.where(F.col("forecast_date").between(oldest, newest))
    index = forecast_store.index_of(earlier)
    rows, without = fallback.retrieve(targets, index, earlier, as_of, settings.fallback_days)
    return fallback.fill_in(fresh, failed, rows), without


def run(
    spark,
    path: str,
    runs: DataFrame,
    table: DataFrame,
    trained: DataFrame,
    summary: DataFrame,
    names: Sequence[str],
    settings: RunSettings,
    as_of: Column,
) -> tuple[DataFrame, DataFrame]:
    """Run and store; returns the validation summary by forecast date, and the (date, product) pairs left without.

    Each forecast date is checked on its own, so many runs (a backfill) are told apart. A failed pair is replaced
    by an earlier forecast; without one nothing is stored for it, and it is reported.

    The new forecasts are written to the shared folder first: they are read several times, and a lost
    executor then costs a re-read instead of the whole job.
    """
    final = scratch.settle(forecasts(runs, table, trained, summary, names, settings))
    earlier = stored_before(spark, path)
    if earlier is not None:
        # Fallbacks are read from the store that is about to be rewritten, so they are staged as well.
        final, without = with_fallback(final, runs, earlier, settings)
        final, without = scratch.settle(final), scratch.settle(without.withColumnRenamed("target_date", "forecast_date"))
    else:
        without = scratch.settle(failed_pairs(final, runs, settings))
        final = scratch.settle(final.join(without, ["forecast_date", "product"], "left_anti"))
    forecast_store.write(final, path, as_of)
    starts = horizon_rows(runs, settings).select("forecast_date", "start").distinct()
    found = validate.forecast(
        final, starts, "start", as_of, settings.sample_count, settings.products, settings.horizon_hours, ["forecast_date"]
    )
    return validate.summary(found, keys=["forecast_date"], forecasts=starts), without


def stored_before(spark, path: str) -> DataFrame | None:
    """Forecasts stored so far, without storage metadata; None before the first run. Any other fault is raised."""
    try:
        return forecast_store.read(spark, path).drop(*validate.STORED_FIELDS)
    except AnalysisException as problem:
        if problem.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise

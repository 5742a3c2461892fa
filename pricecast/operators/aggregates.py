"""Summaries of feeds and forecasts: plain grouped aggregates with map-side combine."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricecast import config
from pricecast.functions import arrays
from pricecast.functions.quantiles import exact_quantiles
from pricecast.functions.timeline import trailing
from pricecast.operators import align, topk
from pricecast.sources.scratch import Settle, as_is


def attach(df: DataFrame, summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Put per-key figures on the rows of each key.

    The size of the summary decides the plan: that of the file if it was settled, else the one found at run time,
    beyond which skewed keys are split.
    """
    return df.join(summary, list(keys))


def total_generation(df: DataFrame, keys: Sequence[str] = ("timestamp",)) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum("generation_mw").alias("total_generation_mw"))


def price_statistics(df: DataFrame, settle: Settle = as_is) -> DataFrame:
    """Mean, deviation, least and greatest price per product, on each distinct hour of the product."""
    figures = df.groupBy("product").agg(
        F.avg("price").alias("price_mean"),
        F.stddev_samp("price").alias("price_std"),
        F.min("price").alias("price_min"),
        F.max("price").alias("price_max"),
    )
    return attach(df.select("product", "timestamp").distinct(), settle(figures), ["product"])


def rolling_price_statistics(df: DataFrame, seconds: int, settle: Settle = as_is) -> DataFrame:
    """The same figures over a trailing time window per product."""
    return trailing(
        df,
        ["product"],
        "timestamp",
        {
            "price_mean": (seconds, lambda: F.avg("price")),
            "price_std": (seconds, lambda: F.stddev_samp("price")),
            "price_min": (seconds, lambda: F.min("price")),
            "price_max": (seconds, lambda: F.max("price")),
        },
        settle,
    )


def forecast_statistics(df: DataFrame, settle: Settle = as_is) -> DataFrame:
    """Per product: extremes, mean, exact median, deviation and the three dearest hours."""
    figures = df.groupBy("product").agg(
        F.min("point_forecast").alias("min_price"),
        F.max("point_forecast").alias("max_price"),
        F.avg("point_forecast").alias("mean_price"),
        F.stddev_samp("point_forecast").alias("std_price"),
    )
    median = exact_quantiles(df, ["product"], "point_forecast", {"median_price": 0.5}, settle)
    peaks = (
        topk.top_hours(df, 3)
        .groupBy("product")
        .agg(*[F.max(F.when(F.col("rank") == r, F.col("timestamp"))).alias(f"peak_hour_{r}") for r in (1, 2, 3)])
    )
    return figures.join(median, "product").join(peaks, "product")


def forecast_summary(df: DataFrame) -> DataFrame:
    """Per product: range of time, mean price and bounds, fallback use, unit."""
    from pricecast.operators.joins import attach_product

    figures = df.groupBy("product").agg(
        F.min("timestamp").alias("start_time"),
        F.max("timestamp").alias("end_time"),
        F.count(F.lit(1)).alias("hours"),
        F.avg("point_forecast").alias("mean_price"),
        F.avg("lower_bound").alias("mean_lower"),
        F.avg("upper_bound").alias("mean_upper"),
        F.avg(F.col("upper_bound") - F.col("lower_bound")).alias("mean_range"),
        F.bool_or("is_fallback").alias("has_fallback"),
    )
    named = attach_product(figures)
    return named.select(*figures.columns, "display_name", "unit")


def forecast_metadata(df: DataFrame) -> DataFrame:
    """One row about a whole forecast: times, flag, distinct hours and products."""
    # The product set is bounded by the configured list, so it fits one array.
    return df.agg(
        F.max("generation_timestamp").alias("generation_timestamp"),
        F.bool_or("is_fallback").alias("is_fallback"),
        F.min("timestamp").alias("start_time"),
        F.max("timestamp").alias("end_time"),
        F.count_distinct("timestamp").alias("hours"),
        F.array_sort(F.collect_set("product")).alias("products"),
    )


def resample_forecast(df: DataFrame, frequency: str) -> DataFrame:
    return align.resample(
        df,
        ["product"],
        frequency,
        {
            "point_forecast": ("point_forecast", "avg"),
            "lower_bound": ("lower_bound", "min"),
            "upper_bound": ("upper_bound", "max"),
        },
    )


def ensemble_statistics(df: DataFrame, keys: Sequence[str] = ("product",)) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("forecast_count"),
        F.avg("point_forecast").alias("mean_point"),
        F.min("point_forecast").alias("min_point"),
        F.max("point_forecast").alias("max_point"),
        (F.avg(F.col("is_fallback").cast("int")) * 100).alias("fallback_percent"),
    )


def ensemble_header(df: DataFrame, keys: Sequence[str] = ("product",)) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.min("timestamp").alias("start_time"),
        F.max("timestamp").alias("end_time"),
        F.max("generation_timestamp").alias("ensemble_generation_timestamp"),
        F.bool_or("is_fallback").alias("ensemble_is_fallback"),
    )


def assemble_ensembles(df: DataFrame, keys: Sequence[str] = ("product",), settle: Settle = as_is) -> DataFrame:
    """Forecast rows with the header of their ensemble."""
    return attach(df, settle(ensemble_header(df, keys)), keys)


def sample_statistics(df: DataFrame) -> DataFrame:
    """The eight statistics of each row's samples."""
    figures = arrays.statistics(F.col("samples"))
    return df.select("timestamp", "product", *[c.alias(f"sample_{n}") for n, c in figures.items()])


# Samples of a row, at most; and copies of one hour whose arrays may meet in one row.
MOST_SAMPLES = 1 << 30
MOST_COPIES = 1000


def aggregate_forecasts(df: DataFrame, how: str = "mean", settle: Settle = as_is, most_copies: int = MOST_COPIES) -> DataFrame:
    """Several forecasts of one (product, hour) as one: elementwise mean or median of points and samples.

    Point and samples travel in one array, and the copies of an hour meet as arrays: each task sends one block
    per product and hour. Hours with more than ``most_copies`` copies are merged element by element instead, in groups
    (product, hour, element), so that no block grows without bound. A null element does not count.
    """
    keys = ["product", "timestamp"]
    if how not in ("mean", "median"):
        raise ValueError(f"unknown method: {how}")
    packed = df.select(*keys, "is_fallback", F.concat(F.array("point_forecast"), "samples").alias("_all"))
    packed = settle(packed)
    many = settle(packed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most_copies).drop("_n"))
    merged = _merged_blocks(packed.join(many, keys, "left_anti"), keys, how)
    if settle is as_is or not many.isEmpty():
        merged = merged.unionByName(_merged_elements(packed.join(many, keys, "left_semi"), keys, how, settle))
    return merged.select(
        *keys,
        F.get("_all", F.lit(0)).alias("point_forecast"),
        F.slice("_all", F.lit(2), F.size("_all") - 1).alias("samples"),
        "is_fallback",
    )


def _merged_blocks(packed: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """All copies of an hour in one row, looked at position by position."""
    blocks = packed.groupBy(*keys).agg(F.collect_list("_all").alias("_blocks"), F.bool_or("is_fallback").alias("is_fallback"))
    middle = arrays.mean if how == "mean" else lambda x: arrays.percentile(x, 0.5)

    def at(position: Column) -> Column:
        cell = F.filter(F.transform("_blocks", lambda b: F.get(b, position)), lambda x: x.isNotNull())
        return arrays.bound(cell, lambda x: F.when(F.size(x) > 0, middle(x)))

    longest = F.array_max(F.transform("_blocks", F.size))
    return blocks.select(*keys, "is_fallback", F.transform(F.sequence(F.lit(0), longest - 1), at).alias("_all"))


def _merged_elements(packed: DataFrame, keys: Sequence[str], how: str, settle: Settle) -> DataFrame:
    """A row per element, combined on the map side: for hours with very many copies."""
    elements = packed.select(*keys, "is_fallback", F.posexplode("_all").alias("_pos", "_x"))
    cell = [*keys, "_pos"]
    merged = elements.groupBy(*cell).agg(F.avg("_x").alias("_x"), F.bool_or("is_fallback").alias("is_fallback"))
    if how == "median":
        merged = merged.drop("_x").join(exact_quantiles(elements, cell, "_x", {"_x": 0.5}, settle), cell, "left")
    # One array per (product, hour): as long as the sample count.
    return merged.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_x"))), lambda e: e["_x"]).alias("_all"),
        F.bool_or("is_fallback").alias("is_fallback"),
    )


def fallback_figures(df: DataFrame) -> DataFrame:
    span = (F.unix_micros(F.max(F.col("timestamp").cast("timestamp"))) - F.unix_micros(
        F.min(F.col("timestamp").cast("timestamp"))
    )) / 3_600_000_000
    return df.groupBy("product").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.round(span).cast("bigint").alias("horizon_hours"),
        F.bool_or("is_cascading").alias("any_cascading"),
        F.min("original_generation").alias("original_generation"),
    )


def fallback_rate(index: DataFrame) -> DataFrame:
    """Share of fallback forecasts per month, in percent."""
    return index.groupBy(F.date_trunc("month", F.col("forecast_date").cast("timestamp")).alias("month")).agg(
        F.count(F.lit(1)).alias("forecasts"),
        (F.avg(F.col("is_fallback").cast("int")) * 100).alias("fallback_percent"),
    )


def availability(index: DataFrame, by_hour: int = 8) -> DataFrame:
    """Per month: percent of forecast days whose first forecast was there by the given hour of the day before."""
    deadline = F.date_sub("forecast_date", 1).cast("timestamp") + F.expr(f"interval {by_hour} hours")
    days = index.groupBy("forecast_date").agg(F.min("generation_timestamp").alias("first_at"))
    return (
        days.withColumn("in_time", (F.col("first_at") <= deadline).cast("int"))
        .groupBy(F.date_trunc("month", F.col("forecast_date").cast("timestamp")).alias("month"))
        .agg(F.count(F.lit(1)).alias("days"), (F.avg("in_time") * 100).alias("available_percent"))
    )


def completeness(df: DataFrame, products: Sequence[str], hours: int = 24) -> DataFrame:
    """Percent of the expected (product, hour) cells present on each day."""
    present = (
        df.where(F.col("product").isin(list(products)))
        .select(F.to_date("timestamp").alias("forecast_date"), "product", F.hour("timestamp").alias("_h"))
        .distinct()
    )
    share = F.count(F.lit(1)) / F.lit(float(len(products) * hours)) * 100
    return present.groupBy("forecast_date").agg(
        F.count(F.lit(1)).alias("present"), share.alias("complete_percent")
    )


def histogram(df: DataFrame, bins: int = config.HISTOGRAM_BINS) -> DataFrame:
    """Density of the samples per forecast row, in equal bins between the least and the greatest.

    Each row counts its own samples: the array never leaves its row, only the bins come out. Null samples count nowhere.
    """
    low, high = F.array_min("samples"), F.array_max("samples")
    width = (F.col("_high") - F.col("_low")) / bins
    place = F.transform(
        "samples",
        lambda x: F.least(
            F.when(F.col("_width") > 0, F.floor((x - F.col("_low")) / F.col("_width"))).otherwise(0), F.lit(bins - 1)
        ).cast("int"),
    )
    edges = df.select("timestamp", "product", "samples", low.alias("_low"), high.alias("_high")).withColumn(
        "_width", width
    )
    # The places are sorted once and cut at the bins by binary search.
    up_to = arrays.bound(
        F.sort_array(place), lambda p: F.transform(F.sequence(F.lit(0), F.lit(bins)), lambda b: arrays.count_below(p, b, MOST_SAMPLES))
    )
    counted = edges.select("timestamp", "product", "_low", "_width", F.size("samples").alias("_n"), up_to.alias("_up_to"))
    placed = counted.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    count = F.get("_up_to", F.col("bin") + 1) - F.get("_up_to", F.col("bin"))
    return placed.select(
        "timestamp",
        "product",
        "bin",
        (F.col("_low") + F.col("bin") * F.col("_width")).alias("bin_start"),
        count.alias("sample_count"),
        F.when(F.col("_width") > 0, count / (F.col("_n") * F.col("_width"))).alias("density"),
    )


def load_summary(df: DataFrame) -> DataFrame:
    return df.agg(
        F.min("load_mw").alias("min_load"), F.max("load_mw").alias("max_load"), F.avg("load_mw").alias("mean_load")
    )

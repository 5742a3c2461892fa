"""Time grids, resampling and alignment of series on a common grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricecast import config
from pricecast.functions.timeline import Chunks, fill, interpolate
from pricecast.sources.scratch import Settle, as_is

HOUR = "1 hour"


def hour_grid(df: DataFrame, start: str, hours: int = config.HORIZON_HOURS) -> DataFrame:
    """``hours`` hourly timestamps from the start time of each row."""
    end = F.col(start) + F.expr(f"interval {hours - 1} hours")
    return df.withColumn("timestamp", F.explode(F.sequence(start, end, F.expr("interval 1 hour"))))


def day_range_grid(df: DataFrame, start: str, end: str) -> DataFrame:
    """Every hour from 00:00 of the start date through 23:00 of the end date."""
    first = F.date_trunc("day", start)
    last = F.date_trunc("day", end) + F.expr("interval 23 hours")
    return df.withColumn("timestamp", F.explode(F.sequence(first, last, F.expr("interval 1 hour"))))


def shift_time(df: DataFrame, delta: Column, column: str = "timestamp") -> DataFrame:
    return df.withColumn(column, F.col(column) + delta)


def bin_start(ts: Column, frequency: str) -> Column:
    return F.window(ts, frequency).getField("start")


def series_grid(bounds: DataFrame, frequency: str = HOUR) -> DataFrame:
    """Rows with ``_from`` and ``_to`` → one row per step of the frequency, as ``timestamp``."""
    step = F.expr(f"interval {frequency}")
    return bounds.select(
        *[c for c in bounds.columns if c not in ("_from", "_to")],
        F.explode(F.sequence("_from", "_to", step)).alias("timestamp"),
    )


def resample(
    df: DataFrame,
    keys: Sequence[str],
    frequency: str,
    aggregates: dict[str, tuple[str, str]],
    fill_sums: bool = True,
    settle: Settle = as_is,
) -> DataFrame:
    """``{new: (column, function)}`` per bin, with every bin between the first and the last of a key.

    Empty bins get 0 for sums and null otherwise.
    """
    binned = df.withColumn("timestamp", bin_start(F.col("timestamp").cast("timestamp"), frequency))
    found = settle(
        binned.groupBy(*keys, "timestamp").agg(
            *[getattr(F, how)(F.col(c)).alias(new) for new, (c, how) in aggregates.items()]
        )
    )
    # The bounds come from the already reduced bins, not from a second pass over the rows.
    bounds = found.groupBy(*keys).agg(F.min("timestamp").alias("_from"), F.max("timestamp").alias("_to"))
    grid = series_grid(bounds, frequency)
    full = grid.join(found, [*keys, "timestamp"], "left")
    sums = [new for new, (_, how) in aggregates.items() if how in ("sum", "count")]
    return full.fillna(0, sums) if fill_sums and sums else full


def to_grid(df: DataFrame, grid: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Reindex: grid rows with the values found there; rows off the grid are dropped."""
    return grid.join(df, [*keys, "timestamp"], "left")


def union_bounds(frames: Sequence[DataFrame], keys: Sequence[str] = ()) -> DataFrame:
    """First and last time over several frames, per key."""
    ends = None
    for df in frames:
        part = df.groupBy(*keys).agg(F.min("timestamp").alias("_from"), F.max("timestamp").alias("_to"))
        ends = part if ends is None else ends.unionByName(part)
    return ends.groupBy(*keys).agg(F.min("_from").alias("_from"), F.max("_to").alias("_to"))


def align(
    frames: dict[str, tuple[DataFrame, Sequence[str]]], frequency: str = HOUR, settle: Settle = as_is
) -> dict[str, DataFrame]:
    """Put several frames on one grid over the union of their ranges.

    Each frame comes with its series keys (product, fuel, region …); numeric columns
    are interpolated in time, others repeat the last value.
    """
    bounds = settle(union_bounds([df for df, _ in frames.values()]))
    result = {}
    for name, (df, keys) in frames.items():
        # Every distinct series of the frame gets the same grid; the bounds are a scalar subquery.
        series = df.select(*keys).distinct() if keys else bounds.select()
        span = bounds.select(F.struct("_from", "_to")).scalar()
        spans = series.withColumn("_span", span)
        grid = series_grid(spans.select(*keys, "_span._from", "_span._to"), frequency)
        placed = to_grid(df, grid, keys)
        values = [c for c in df.columns if c not in (*keys, "timestamp")]
        kinds = dict(df.dtypes)
        numeric = [c for c in values if kinds[c] in ("double", "float", "int", "bigint")]
        other = [c for c in values if c not in numeric]
        chunks = Chunks.by_count(grid, keys, "timestamp", settle)
        if numeric:
            placed = interpolate(placed, keys, "timestamp", numeric, chunks=chunks)
        if other:
            placed = fill(placed, keys, "timestamp", other, chunks=chunks)
        result[name] = placed
    return result


def missing_hours(df: DataFrame, expected: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Expected (key, hour) rows that the feed does not have."""
    columns = [*keys, "timestamp"]
    return expected.select(*columns).join(df.select(*columns), columns, "left_anti")

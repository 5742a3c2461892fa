"""Joins of feeds, forecasts and actuals."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricecast import config
from pricecast.functions.timeline import Chunks, neighbours
from pricecast.operators import align, reshape
from pricecast.sources.scratch import Settle, as_is


def merge_frames(
    frames: Sequence[DataFrame],
    how: str = "outer",
    suffixes: Sequence[str] | None = None,
    keys: Sequence[str] = ("timestamp",),
) -> DataFrame:
    """Fold frames with an equi-join; a column that exists already gets ``_<suffix>``."""
    if not frames:
        raise ValueError("no frames to merge")
    tags = list(suffixes) if suffixes is not None else [f"df{i}" for i in range(1, len(frames))]
    if len(tags) != len(frames) - 1:
        raise ValueError("one suffix per frame after the first is needed")

    def add(left: DataFrame, step: tuple[str, DataFrame]) -> DataFrame:
        tag, right = step
        clash = {c: f"{c}_{tag}" for c in right.columns if c in left.columns and c not in keys}
        return left.join(right.withColumnsRenamed(clash), list(keys), how)

    return reduce(add, zip(tags, frames[1:]), frames[0])


def merge_features(frames: dict[str, DataFrame], keys: Sequence[str] = ("timestamp",)) -> DataFrame:
    """Full outer join of feature frames; a duplicate column is named after its frame."""
    names = list(frames)
    return merge_frames([frames[n] for n in names], "outer", names[1:], keys)


def combined_dataset(
    load: DataFrame,
    prices: DataFrame,
    generation: DataFrame,
    fuels: Sequence[str],
    products: Sequence[str],
    settle: Settle = as_is,
) -> DataFrame:
    """One row per hour: load, a column per product and a column per fuel, on a common grid."""
    grid = align.align(
        {
            "load": (load, ()),
            "price": (prices, ("product",)),
            "generation": (generation, ("fuel_type",)),
        },
        settle=settle,
    )
    wide = merge_frames(
        [
            grid["load"],
            reshape.pivot_prices(grid["price"], products),
            reshape.pivot_generation(grid["generation"], fuels),
        ]
    )
    return wide.dropna("all", subset=[c for c in wide.columns if c != "timestamp"])


def forecast_vs_actual(
    forecast: DataFrame, actual: DataFrame, keys: Sequence[str] = ("product", "timestamp"), how: str = "inner"
) -> DataFrame:
    return forecast.join(actual, list(keys), how)


def pair_ensembles(df: DataFrame, first: str, second: str, id_column: str = "ensemble_id") -> DataFrame:
    """Two named ensembles side by side at equal (product, timestamp)."""

    def one(name: str, alias: str) -> DataFrame:
        rows = df.where(F.col(id_column) == name)
        return rows.select("product", "timestamp", F.col("point_forecast").alias(alias))

    return one(first, "first_point").join(one(second, "second_point"), ["product", "timestamp"])


def pair_all_ensembles(df: DataFrame, id_column: str = "ensemble_id") -> DataFrame:
    """All ordered pairs of different ensembles at equal (product, timestamp)."""

    def side(alias: str) -> DataFrame:
        return df.select("product", "timestamp", F.col(id_column).alias(alias), F.col("point_forecast").alias(f"{alias}_point"))

    return side("first").join(side("second"), ["product", "timestamp"]).where(F.col("first") != F.col("second"))


def nearest(
    targets: DataFrame, rows: DataFrame, keys: Sequence[str], value: str, target_time: str = "target", settle: Settle = as_is
) -> DataFrame:
    """The row closest in time to each target; the earlier row wins a tie.

    Targets and rows are put on one timeline and each target looks at its two
    neighbours: cost is linear, however many rows share a key.
    """
    marks = targets.select(*targets.columns, F.col(target_time).alias("_at"), F.lit(True).alias("_target"))
    points = rows.select(
        *keys, F.col("timestamp").alias("_at"), F.struct(F.col("timestamp"), F.col(value)).alias("_row")
    )
    # Rows at one time are reduced to one before they are ordered.
    single = points.groupBy(*keys, "_at").agg(F.min("_row").alias("_row"))
    line = marks.unionByName(single, allowMissingColumns=True)
    line = settle(line)
    chunks = Chunks.by_count(line, keys, "_at", settle)
    near = neighbours(line, keys, "_at", ["_row"], times=True, chunks=chunks).where("_target")
    earlier = F.col("_t") - F.col("prev__row_at")
    later = F.col("next__row_at") - F.col("_t")
    use_next = F.col("prev__row").isNull() | (later < earlier)
    pick = F.when(use_next, F.col("next__row")).otherwise(F.col("prev__row"))
    return near.withColumn("_pick", pick).select(
        *targets.columns,
        F.col("_pick.timestamp").alias("nearest_time"),
        F.col(f"_pick.{value}").alias(value),
    )


def days_back(
    targets: DataFrame,
    index: DataFrame,
    max_days: int = config.FALLBACK_DAYS,
    keys: Sequence[str] = ("product",),
    settle: Settle = as_is,
) -> DataFrame:
    """The newest index row dated 1..``max_days`` before each distinct ``target_date``.

    Targets and index rows are put on one line and each target looks at the last row before its day: the cost does
    not depend on ``max_days``. Of several index rows of one key and date the greatest counts; null keys match nothing.
    """
    rest = [c for c in index.columns if c not in keys]
    known = [F.col(k).isNotNull() for k in keys]
    sources = index.where(reduce(lambda a, b: a & b, known, F.col("forecast_date").isNotNull()))
    single = sources.groupBy(*keys, F.col("forecast_date").cast("timestamp").alias("_at")).agg(F.max(F.struct(*rest)).alias("_source"))
    # A target stands right before its own day.
    before = F.col("target_date").cast("timestamp") - F.expr("interval 1 microsecond")
    marks = targets.distinct().select(*targets.columns, before.alias("_at"), F.lit(True).alias("_target"))
    line = settle(marks.unionByName(single, allowMissingColumns=True))
    chunks = Chunks.by_count(line, keys, "_at", settle)
    near = neighbours(line, keys, "_at", ["_source"], backward=False, chunks=chunks).where("_target")
    age = F.datediff("target_date", F.col("prev__source.forecast_date"))
    return (
        near.withColumn("age_days", age)
        .where(F.col("age_days").between(1, max_days))
        .select(*targets.columns, "age_days", *[F.col(f"prev__source.{c}").alias(c) for c in rest])
    )


def product_table(spark) -> DataFrame:
    """The product attributes: a fixed list of six rows, so always small enough to broadcast."""
    return spark.createDataFrame(
        config.PRODUCT_ATTRIBUTES,
        "product string, display_name string, unit string, category string, can_be_negative boolean, sort_order int",
    )


def attach_product(df: DataFrame) -> DataFrame:
    """Product attributes by a lookup in the projection; unknown products get the defaults."""

    def look(position: int, default) -> Column:
        pairs = [F.lit(x) for row in config.PRODUCT_ATTRIBUTES for x in (row[0], row[position])]
        found = F.try_element_at(F.create_map(*pairs), F.col("product"))
        return F.coalesce(found, default if isinstance(default, Column) else F.lit(default))

    return df.withColumns(
        {
            "display_name": look(1, F.col("product")),
            "unit": look(2, config.DEFAULT_UNIT),
            "category": look(3, "unknown"),
            "can_be_negative": look(4, False),
            "sort_order": look(5, 999),
        }
    )

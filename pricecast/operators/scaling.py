"""Scalers as a table: one row per series key and column, fitted by aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricecast.functions.quantiles import exact_quantiles
from pricecast.sources.scratch import Settle, as_is

# A scale that is no more than this share of the largest value is what rounding leaves of a constant.
ROUNDING = 1e-12

METHODS = ("standard", "minmax", "robust", "none")
_NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def numeric_columns(df: DataFrame, columns: Sequence[str] | None = None) -> list[str]:
    return [c for c, kind in df.dtypes if kind in _NUMERIC and (columns is None or c in columns)]


def _long(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    as_double = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns])
    return as_double.unpivot(list(keys), list(columns), "column", "value")


def column_figures(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Count, mean, population deviation, least and greatest per key and column, in long form.

    The aggregate is wide (one row per key, no row is multiplied); only its result is unpivoted.
    """
    parts = {
        "count": F.count,
        "mean": F.avg,
        "std": F.stddev_pop,
        "min": lambda c: F.min(F.col(c).cast("double")),
        "max": lambda c: F.max(F.col(c).cast("double")),
    }
    wide = df.groupBy(*keys).agg(*[f(c).alias(f"{part}|{c}") for c in columns for part, f in parts.items()])
    rows = F.array(
        *[
            F.struct(F.lit(c).alias("column"), *[F.col(f"`{part}|{c}`").alias(part) for part in parts])
            for c in columns
        ]
    )
    return wide.select(*keys, F.inline(rows))


def fit(
    df: DataFrame,
    columns: Sequence[str],
    method: str = "standard",
    keys: Sequence[str] = (),
    normalizer_id: str = "default",
    settle: Settle = as_is,
) -> DataFrame:
    """Scaler table. Columns that are not numeric or hold only nulls are left out.

    A zero scale counts as 1, and so does one that is zero but for rounding errors: the values are one and the same
    number to twelve digits, and dividing by what is left would only enlarge the noise.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method: {method}")
    used = numeric_columns(df, columns)
    figures = column_figures(df, keys, used).where(F.col("count") > 0)
    if method == "robust":
        spread = exact_quantiles(
            _long(df, keys, used), [*keys, "column"], "value", {"_q1": 0.25, "_q2": 0.5, "_q3": 0.75}, settle
        )
        figures = figures.join(spread, [*keys, "column"])
    centre, scale = {
        "standard": (F.col("mean"), F.col("std")),
        "minmax": (F.col("min"), F.col("max") - F.col("min")),
        "robust": (F.col("_q2"), F.col("_q3") - F.col("_q1")) if method == "robust" else (None, None),
        "none": (F.lit(0.0), F.lit(1.0)),
    }[method]
    return figures.select(
        F.lit(normalizer_id).alias("normalizer_id"),
        *keys,
        "column",
        F.lit(method).alias("method"),
        centre.alias("center"),
        F.when(scale <= ROUNDING * F.greatest(F.abs("min"), F.abs("max")), 1.0).otherwise(scale).alias("scale"),
        "mean",
        "std",
        "min",
        "max",
    )


def _on_rows(df: DataFrame, scalers: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    wide = scalers.where(F.col("column").isin(list(columns))).groupBy(*keys).agg(
        *[
            F.max(F.when(F.col("column") == c, F.struct("center", "scale"))).alias(f"_s_{c}")
            for c in columns
        ]
    )
    if keys:
        return df.join(wide, list(keys), "left")
    # Without keys the scalers are one row, read as a scalar subquery.
    whole = df.withColumn("_scalers", wide.select(F.struct(*wide.columns)).scalar())
    return whole.withColumns({f"_s_{c}": F.col(f"_scalers._s_{c}") for c in columns})


def apply(df: DataFrame, scalers: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(x − center) / scale; a column without a scaler stays as it is.

    Scalers come from a table (saved or settled): its known size lets Spark choose the join.
    """
    rows = _on_rows(df, scalers, columns, keys)

    def scaled(c: str):
        return F.when(F.col(f"_s_{c}").isNull(), F.col(c).cast("double")).otherwise(
            (F.col(c) - F.col(f"_s_{c}.center")) / F.col(f"_s_{c}.scale")
        )

    return rows.select(*[scaled(c).alias(c) if c in columns else F.col(c) for c in df.columns])


def invert(df: DataFrame, scalers: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    rows = _on_rows(df, scalers, columns, keys)

    def raw(c: str):
        return F.when(F.col(f"_s_{c}").isNull(), F.col(c).cast("double")).otherwise(
            F.col(c) * F.col(f"_s_{c}.scale") + F.col(f"_s_{c}.center")
        )

    return rows.select(*[raw(c).alias(c) if c in columns else F.col(c) for c in df.columns])


def feature_report(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Mean, deviation (n), least and greatest of each column."""
    return column_figures(df, keys, numeric_columns(df, columns)).drop("count")


def save(scalers: DataFrame, path: str) -> None:
    """Write scalers; rows of the same normalizer_id are replaced, others stay."""
    (
        scalers.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("normalizer_id")
        .parquet(path)
    )


def load(spark, path: str, normalizer_id: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("normalizer_id") == normalizer_id)

"""Accuracy of forecasts against actuals: one grouped aggregate for any set of metrics."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricecast import config
from pricecast.functions import arrays

_A, _F = "actual", "forecast"


def rmse(actual: Column, forecast: Column) -> Column:
    return F.sqrt(F.avg(F.pow(actual - forecast, F.lit(2.0))))


def mae(actual: Column, forecast: Column) -> Column:
    return F.avg(F.abs(actual - forecast))


def mape(actual: Column, forecast: Column) -> Column:
    share = F.abs((actual - forecast) / F.nullif(actual, F.lit(0.0)))
    return F.when(F.bool_or(actual == 0), None).otherwise(F.avg(share) * 100)


def r2(actual: Column, forecast: Column) -> Column:
    error = F.sum(F.pow(actual - forecast, F.lit(2.0)))
    total = F.var_pop(actual) * F.count(actual)
    constant = F.min(actual) == F.max(actual)
    return (
        F.when(F.count(actual) < 2, None)
        .when(constant, F.when(error == 0, 1.0).otherwise(0.0))
        .otherwise(1 - error / total)
    )


def bias(actual: Column, forecast: Column) -> Column:
    return F.avg(forecast - actual)


def pinball(actual: Column, forecast: Column, q: float) -> Column:
    if not 0 < q < 1:
        raise ValueError("q must lie between 0 and 1")
    e = actual - forecast
    return F.avg(F.greatest(e * q, e * (q - 1)))


POINT_METRICS = {
    "rmse": rmse,
    "mae": mae,
    "mape": mape,
    "r2": r2,
    "bias": bias,
    "pinball": lambda a, f: pinball(a, f, 0.5),
}


def accuracy(
    df: DataFrame, groups: Sequence[str] = (), metrics: Sequence[str] = tuple(POINT_METRICS)
) -> DataFrame:
    """Point metrics per group from rows with ``actual`` and ``forecast``."""
    a, f = F.col(_A), F.col(_F)
    return df.groupBy(*groups).agg(*[POINT_METRICS[m](a, f).alias(m) for m in metrics])


def covered(actual: Column, samples: Column, level: float) -> Column:
    low, high = arrays.interval(samples, level)
    return actual.between(low, high).cast("int")


def coverage(df: DataFrame, level: float, groups: Sequence[str] = ()) -> DataFrame:
    """Share of actuals inside the central interval of the samples."""
    return df.groupBy(*groups).agg(F.avg(covered(F.col(_A), F.col("samples"), level)).alias("coverage"))


def probabilistic(
    df: DataFrame,
    groups: Sequence[str] = (),
    levels: Sequence[float] = tuple(config.CONFIDENCE_LEVELS),
    quantiles: Sequence[float] = tuple(config.PINBALL_LEVELS),
) -> DataFrame:
    """Point metrics, interval coverage and pinball losses of sample quantiles, in one pass.

    The per-row quantities come first, so samples are sorted once and never shuffled.
    """
    a = F.col(_A)
    ordered = df.withColumn("_s", F.sort_array("samples"))
    n = F.size("_s")
    rows = {}
    for c in levels:
        tail = (1 - c) / 2
        low = arrays.sorted_percentile(F.col("_s"), tail)
        high = arrays.sorted_percentile(F.col("_s"), 1 - tail)
        rows[f"coverage_{c * 100:g}"] = a.between(low, high).cast("int")
    for q in quantiles:
        at = F.get("_s", F.least((n * F.lit(q)).cast("int"), n - 1))
        e = a - at
        rows[f"pinball_{q * 100:g}"] = F.greatest(e * q, e * (q - 1))
    made = ordered.withColumns(rows).select(*groups, _A, _F, *rows)
    points = [m(a, F.col(_F)).alias(name) for name, m in POINT_METRICS.items()]
    return made.groupBy(*groups).agg(*points, *[F.avg(name).alias(name) for name in rows])


def compare_methods(df: DataFrame, metrics: Sequence[str] = ("rmse", "mae", "r2", "bias")) -> DataFrame:
    """Metrics per ``method`` on rows (method, actual, forecast)."""
    return accuracy(df, ["method"], metrics)


def improvement(df: DataFrame, metric: str, first: str = "forecast_1", second: str = "forecast_2", groups: Sequence[str] = ()) -> DataFrame:
    """Improvement of the second forecast over the first, in percent; 0 without a base."""
    score = POINT_METRICS[metric]
    both = df.groupBy(*groups).agg(
        score(F.col(_A), F.col(first)).alias("metric_1"), score(F.col(_A), F.col(second)).alias("metric_2")
    )
    gain = F.col("metric_2") - F.col("metric_1") if metric == "r2" else F.col("metric_1") - F.col("metric_2")
    percent = gain / F.nullif(F.abs("metric_1"), F.lit(0.0)) * 100
    return both.withColumn("improvement", F.coalesce(percent, F.lit(0.0)))


def ensemble_accuracy(
    forecast: DataFrame,
    actual: DataFrame,
    keys: Sequence[str] = ("product",),
    levels: Sequence[float] = tuple(config.CONFIDENCE_LEVELS),
) -> DataFrame:
    """Metrics of an ensemble against actuals; a key for which an actual has no forecast is left out."""
    joined = actual.join(forecast, [*keys, "timestamp"], "left")
    inside = {f"coverage_{100 * c:.10g}": covered(F.col(_A), F.col("samples"), c) for c in levels}
    rows = joined.select(
        *keys, _A, F.col("point_forecast").alias(_F), *[c.alias(name) for name, c in inside.items()]
    )
    a, f = F.col(_A), F.col(_F)
    scores = [metric(a, f).alias(name) for name, metric in POINT_METRICS.items()]
    found = rows.groupBy(*keys).agg(
        *scores, *[F.avg(name).alias(name) for name in inside], F.count_if(f.isNull()).alias("_missing")
    )
    return found.where("_missing = 0").drop("_missing")


def pairwise(df: DataFrame, ids: Sequence[str], id_column: str = "ensemble_id", keys: Sequence[str] = ("product", "timestamp")) -> DataFrame:
    """RMSE, MAE and bias of every ordered pair of the listed ensembles, per product.

    Ensembles become columns of one row per (product, hour) and all pairs are scored in one
    aggregate, so no pair of rows is ever formed.
    """
    if len(ids) < 2:
        raise ValueError("at least two ensembles are needed")
    wide = (
        df.groupBy(*keys).pivot(id_column, list(ids)).agg(F.min("point_forecast"))
        .select("product", *[F.col(f"`{i}`").alias(f"_e{n}") for n, i in enumerate(ids)])
    )
    cells = []
    for (i, a), (j, b) in permutations(enumerate(ids), 2):
        x, y = F.col(f"_e{i}"), F.col(f"_e{j}")
        gap = x - y
        cells.append(
            F.struct(
                F.lit(a).alias("ensemble"),
                F.lit(b).alias("comparison"),
                F.sqrt(F.avg(gap * gap)).alias("rmse"),
                F.avg(F.abs(gap)).alias("mae"),
                F.avg(gap).alias("bias"),
                F.count(gap).alias("hours"),
            )
        )
    return wide.groupBy("product").agg(F.array(*cells).alias("_cells")).select("product", F.inline("_cells")).where("hours > 0")

"""Linear models, one per group (product and hour), trained by one aggregate over all groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pricecast.functions import least_squares
from pricecast.functions.arrays import bound

GROUP = ("product", "hour")


# Up to so many columns each pair is an aggregate of its own, in one pass.
FEW_COLUMNS = 8


def moments(df: DataFrame, features: Sequence[str], target: str, groups: Sequence[str] = GROUP) -> DataFrame:
    """Means and central cross products (upper triangle) of features and target per group.

    Sums combine on the map side, so a group of any size costs one row of (k+1)(k+4)/2 numbers in the shuffle. Few
    columns take one pass of ``covar_pop``. For many, whose pairs would be thousands of expressions, one aggregate
    finds the means as a vector, and a second pass sums the products of the centred columns as a vector.
    """
    columns = [*features, target]
    n = len(columns)
    as_double = df.select(*groups, *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(columns)])
    gaps = F.size(F.filter(F.array(*[F.col(f"_x{i}") for i in range(n)]), lambda x: x.isNull()))
    counts = [F.count(F.lit(1)).alias("row_count"), F.sum(gaps).alias("null_count")]
    if n <= FEW_COLUMNS:
        means = F.array(*[F.avg(f"_x{i}") for i in range(n)])
        products = F.array(*[F.covar_pop(f"_x{i}", f"_x{j}") for i in range(n) for j in range(i, n)])
        return as_double.groupBy(*groups).agg(*counts, means.alias("means"), products.alias("cross"))

    def mean_of(vectors: Column) -> Column:
        return vector_to_array(Summarizer.mean(array_to_vector(vectors)))

    # Nulls count as zero here; a group that has any is an error later.
    rows = as_double.select(*groups, F.array(*[F.coalesce(f"_x{i}", F.lit(0.0)) for i in range(n)]).alias("_x"), gaps.alias("_gaps"))
    first = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("row_count"), F.sum("_gaps").alias("null_count"), mean_of(F.col("_x")).alias("means"))
    centred = rows.join(first.select(*groups, "means"), list(groups)).select(*groups, F.zip_with("_x", "means", lambda x, m: x - m).alias("_c"))
    every = F.sequence(F.lit(0), F.lit(n - 1))
    products = F.flatten(F.transform(every, lambda i: F.transform(F.slice("_c", i + 1, F.lit(n)), lambda x: x * F.get("_c", i))))
    second = centred.groupBy(*groups).agg(mean_of(products).alias("cross"))
    return first.join(second, list(groups))


def train(
    df: DataFrame, features: Sequence[str], target: str, groups: Sequence[str] = GROUP, created_at: Column | None = None
) -> DataFrame:
    """Least squares with intercept per group; a null in the data is an error.

    The normal equations of a group are solved inside its row (``least_squares``); features that depend on each other get
    the solution of least norm.
    """
    k = len(features)
    summed = moments(df, features, target, groups)
    message = F.concat(F.lit("nulls in training data: "), F.col("null_count").cast("string"))
    checked = summed.withColumn(
        "row_count", F.when(F.col("null_count") > 0, F.raise_error(message).cast("bigint")).otherwise(F.col("row_count"))
    )
    every = F.sequence(F.lit(0), F.lit(k - 1))

    def fitted(c: Column) -> Column:
        def told(slope: Column) -> Column:
            to_target = F.get(c, k)
            explained = F.aggregate(every, F.lit(0.0), lambda s, i: s + F.get(slope, i) * least_squares.dot(slope, F.get(c, i)))
            total = F.get(to_target, k)
            error = F.greatest(total - 2 * least_squares.dot(slope, to_target) + explained, F.lit(0.0))
            return F.struct(
                slope.alias("coefficients"),
                (F.get("means", F.lit(k)) - least_squares.dot(slope, F.col("means"))).alias("intercept"),
                F.sqrt(error).alias("rmse"),
                F.when(total > 0, 1 - error / total).otherwise((error <= 1e-12).cast("double")).alias("r2"),
            )

        return bound(least_squares.slopes(c, k), told)

    found = checked.select(*groups, "row_count", bound(least_squares.unpacked(F.col("cross"), k + 1), fitted).alias("_fit"))
    return found.select(
        *groups,
        F.array(*[F.lit(f) for f in features]).alias("feature_names"),
        "_fit.coefficients",
        "_fit.intercept",
        F.create_map(F.lit("rmse"), F.col("_fit.rmse"), F.lit("r2"), F.col("_fit.r2")).alias("metrics"),
        "row_count",
        (created_at if created_at is not None else F.lit(None).cast("timestamp")).alias("created_at"),
    )


def train_single(df: DataFrame, feature: str, target: str, groups: Sequence[str] = GROUP) -> DataFrame:
    """One feature: the regression aggregates of Spark, no Python at all."""
    x, y = F.col(feature), F.col(target)
    return df.groupBy(*groups).agg(
        F.regr_slope(y, x).alias("coefficient"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"),
        F.sqrt((F.regr_syy(y, x) - F.pow(F.regr_sxy(y, x), F.lit(2.0)) / F.regr_sxx(y, x)) / F.regr_count(y, x)).alias("rmse"),
    )


def linear(coefficients: Column, values: Column, intercept: Column) -> Column:
    terms = F.zip_with(coefficients, values, lambda c, x: c * x)
    return F.aggregate(terms, intercept, lambda acc, x: acc + x)


def predict(rows: DataFrame, models: DataFrame, features: Sequence[str], groups: Sequence[str] = GROUP) -> DataFrame:
    """Point forecast of each row by the model of its group; rows without a model get null."""
    values = F.array(*[F.col(f).cast("double") for f in features])
    joined = rows.join(models.select(*groups, "coefficients", "intercept"), list(groups), "left")
    return joined.select(
        *rows.columns, linear(F.col("coefficients"), values, F.col("intercept")).alias("point_forecast")
    )


def coefficient_report(models: DataFrame, groups: Sequence[str] = GROUP) -> DataFrame:
    parts = F.arrays_zip(F.col("feature_names").alias("feature"), F.col("coefficients").alias("coefficient"))
    return models.select(*groups, "intercept", F.inline(parts)).withColumn("importance", F.abs("coefficient"))


def evaluate(rows: DataFrame, models: DataFrame, features: Sequence[str], target: str, groups: Sequence[str] = GROUP) -> DataFrame:
    """RMSE and R² of held-out rows per model."""
    from pricecast.operators import metrics

    scored = predict(rows, models, features, groups)
    pairs = scored.select(*groups, F.col(target).alias("actual"), F.col("point_forecast").alias("forecast"))
    return metrics.accuracy(pairs, groups, ("rmse", "r2"))


# --- the model table ---------------------------------------------------------------------------


def latest(models: DataFrame, groups: Sequence[str] = GROUP) -> DataFrame:
    """The newest entry per group."""
    rest = [c for c in models.columns if c not in groups]
    newest = F.max_by(F.struct(*rest), "created_at").alias("_m")
    return models.groupBy(*groups).agg(newest).select(*groups, "_m.*")


def register(models: DataFrame, added: DataFrame, groups: Sequence[str] = GROUP) -> DataFrame:
    """Added models replace those of the same group."""
    return models.join(added, list(groups), "left_anti").unionByName(added)


def delete(models: DataFrame, removed: DataFrame, groups: Sequence[str] = GROUP) -> DataFrame:
    return models.join(removed.select(*groups), list(groups), "left_anti")


def has(wanted: DataFrame, models: DataFrame, groups: Sequence[str] = GROUP) -> DataFrame:
    known = models.select(*groups).distinct().withColumn("available", F.lit(True))
    return wanted.join(known, list(groups), "left").fillna(False, ["available"])


def info(models: DataFrame, groups: Sequence[str] = GROUP) -> DataFrame:
    """The index: group, feature count, metrics, creation time."""
    return models.select(*groups, F.size("feature_names").alias("feature_count"), "metrics", "created_at")


def save(models: DataFrame, path: str) -> None:
    models.write.mode("overwrite").parquet(path)


def load(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)


# --- residual history --------------------------------------------------------------------------


def residuals(pairs: DataFrame) -> DataFrame:
    """Residual (actual − forecast) and its share of the forecast, per forecast hour."""
    gap = F.col("actual") - F.col("forecast")
    return pairs.select(
        "product",
        F.hour("timestamp").alias("hour"),
        "timestamp",
        gap.alias("residual"),
        (gap / F.nullif("forecast", F.lit(0.0))).alias("pct_error"),
    )


RECENT = 3


def residual_summary(history: DataFrame, groups: Sequence[str] = GROUP) -> DataFrame:
    """What the uncertainty methods need, per group: moments, and the mean size of the last and previous three errors.

    Ranking is limited to six rows per group, which Spark cuts to before the shuffle.
    """
    figures = history.groupBy(*groups).agg(
        F.avg("residual").alias("res_mean"),
        F.stddev_pop("residual").alias("res_std"),
        F.avg("pct_error").alias("pct_mean"),
        F.stddev_pop("pct_error").alias("pct_std"),
        F.count("residual").alias("errors"),
    )
    w = W.partitionBy(*groups).orderBy(F.desc("timestamp"))
    ranked = (
        history.where("residual is not null")
        .select(*groups, "timestamp", "residual")
        .withColumn("_r", F.row_number().over(w))
        .where(F.col("_r") <= 2 * RECENT)
    )
    recent = ranked.groupBy(*groups).agg(
        F.avg(F.when(F.col("_r") <= RECENT, F.abs("residual"))).alias("recent_abs"),
        F.avg(F.when(F.col("_r") > RECENT, F.abs("residual"))).alias("older_abs"),
    )
    return figures.join(recent, list(groups), "left")

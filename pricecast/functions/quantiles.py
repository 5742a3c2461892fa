"""Exact linear quantiles of any number of rows per key, without gathering a key in one task.

Values are first counted per (key, value). Approximate quantiles of each key cut its values into buckets of about
equal size, wherever they lie, and only the few buckets that hold the wanted ranks are ordered. NaN comes after all
numbers, as in Spark's own ordering; infinities are values like others.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# A bucket holds about this share of a key's values.
BUCKETS = 256


def bucketed(df: DataFrame, counted: DataFrame, keys: Sequence[str], settle: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The counted values with ``_bucket``, which grows with the value."""
    v = F.col("_v")
    number = F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)
    steps = [i / BUCKETS for i in range(1, BUCKETS)]
    cuts = settle(df.groupBy(*keys).agg(F.array_distinct(F.percentile_approx(number, steps, 10 * BUCKETS)).alias("_cuts")))
    joined = counted.join(cuts, list(keys)) if keys else counted.join(F.broadcast(cuts))  # one row without keys
    inside = F.size(F.filter(F.coalesce("_cuts", F.array().cast("array<double>")), lambda c: c < v))
    return joined.withColumn("_bucket", inside).drop("_cuts")


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    wanted: dict[str, float],
    settle: Callable[[DataFrame], DataFrame] = lambda found: found,
) -> DataFrame:
    """One row per key with a column per entry of ``wanted`` (name → q in [0, 1]); nulls are skipped.

    ``settle`` may write the wanted ranks (two rows per key and quantile), so that their size is known when the
    values are joined to them and the values are not shuffled again.
    """
    values = df.select(*keys, F.col(value).cast("double").alias("_v")).where("_v is not null")
    counted = values.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n"))
    counted = bucketed(values, counted, keys, settle)
    by_bucket = counted.groupBy(*keys, "_bucket").agg(F.sum("_n").alias("_n"))
    whole = W.partitionBy(*keys)
    before = whole.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    located = by_bucket.select(
        *keys,
        "_bucket",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.col("_n").alias("_inside"),
        F.sum("_n").over(whole).alias("_total"),
    )
    ranks = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(q)).alias("q")) for n, q in wanted.items()])
    place = (F.col("_total") - 1) * F.col("_w.q")
    ends = (
        located.withColumn("_w", F.explode(ranks))
        .withColumn("_place", place)
        .withColumn("_rank", F.explode(F.array_distinct(F.array(F.floor("_place"), F.ceil("_place")))))
        .where("_rank >= _before and _rank < _before + _inside")
        .select(*keys, "_bucket", "_before", "_place", "_rank", F.col("_w.name").alias("_name"))
    )
    ends = settle(ends)
    running = W.partitionBy(*keys, "_bucket").orderBy("_v")
    ordered = counted.join(ends.select(*keys, "_bucket").distinct(), [*keys, "_bucket"], "left_semi").select(
        *keys, "_bucket", "_v", "_n", (F.sum("_n").over(running)).alias("_upto")
    )
    hit = ordered.join(ends, [*keys, "_bucket"]).where(
        "_rank >= _before + _upto - _n and _rank < _before + _upto"
    )
    weight = F.when(F.col("_rank") == F.ceil("_place"), F.col("_place") - F.floor("_place"))
    low_share = F.lit(1.0) - (F.col("_place") - F.floor("_place"))
    share = F.when(F.col("_rank") == F.floor("_place"), low_share).otherwise(weight)
    cells = hit.groupBy(*keys).agg(
        *[F.sum(F.when(F.col("_name") == n, F.col("_v") * share)).alias(n) for n in wanted]
    )
    return cells

"""Samples around a point forecast. Draws are hashed from (seed, key, number), so they repeat."""

from __future__ import annotations

from collections.abc import Callable
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricecast import config
from pricecast.functions import arrays, gauss, randomness

Sampler = Callable[[Column, Column, Column, int, int], Column]


def _draws(seed: int, key: Column, count: int, one: Callable[[Column], Column]) -> Column:
    return F.transform(randomness.digests(seed, key, count), one)


def normal(point: Column, std: Column, key: Column, seed: int, count: int) -> Column:
    return _draws(seed, key, count, lambda d: point + std * randomness.normal(d))


def lognormal(point: Column, std: Column, key: Column, seed: int, count: int, cv: Column | float | None = None) -> Column:
    """Lognormal around the point; the coefficient of variation is 0.1 unless given."""
    level = F.when(point <= 0, F.lit(0.01)).otherwise(point)
    share = F.lit(0.1) if cv is None else (F.lit(cv) if isinstance(cv, float) else cv)
    variance = F.log(1 + share * share)
    centre = F.log(level) - variance / 2
    return _draws(seed, key, count, lambda d: F.exp(centre + F.sqrt(variance) * randomness.normal(d)))


def skewed(point: Column, std: Column, key: Column, seed: int, count: int, shape: float = 2.0) -> Column:
    delta = shape / (1 + shape * shape) ** 0.5
    rest = (1 - delta * delta) ** 0.5

    sizes = randomness.digests(seed, key, count)
    others = randomness.digests(seed, F.concat(key, F.lit("|b")), count)

    def one(first: Column, second: Column) -> Column:
        return point + std * (delta * F.abs(randomness.normal(first)) + rest * randomness.normal(second))

    return F.zip_with(sizes, others, one)


# Probabilities nearer to 0 or 1 count as this.
EDGE = 1e-15
DEVIATIONS = 3.0


def truncated(
    point: Column, std: Column, key: Column, seed: int, count: int, low: Column | None = None, high: Column | None = None
) -> Column:
    """Normal cut to [low, high], by default three deviations either side."""
    least = (low - point) / std if low is not None else F.lit(-DEVIATIONS)
    most = (high - point) / std if high is not None else F.lit(DEVIATIONS)
    # Probabilities of the default bounds are known beforehand.
    start = gauss.below(least) if low is not None else F.lit(NormalDist().cdf(-DEVIATIONS))
    end = gauss.below(most) if high is not None else F.lit(NormalDist().cdf(DEVIATIONS))

    def drawn(ends: Column) -> Column:
        def one(digest: Column) -> Column:
            p = ends["start"] + randomness.uniform(digest) * (ends["end"] - ends["start"])
            z = gauss.quantile(F.least(F.greatest(p, F.lit(EDGE)), F.lit(1 - EDGE)))
            return point + std * F.least(F.greatest(z, ends["least"]), ends["most"])

        return _draws(seed, key, count, one)

    return arrays.bound(F.struct(start.alias("start"), end.alias("end"), least.alias("least"), most.alias("most")), drawn)


DISTRIBUTIONS: dict[str, Sampler] = {
    "normal": normal,
    "lognormal": lognormal,
    "truncated_normal": truncated,
    "skewed_normal": skewed,
}


def with_distribution(name: str, sampler: Sampler) -> dict[str, Sampler]:
    """The known distributions plus one of your own."""
    return {**DISTRIBUTIONS, name: sampler}


def constrain(
    samples: Column, product: Column, low: Column | None = None, high: Column | None = None
) -> Column:
    """Ancillary products are not negative; optional bounds on top."""
    ancillary = product.isin(config.ANCILLARY)

    def one(x: Column) -> Column:
        y = F.when(ancillary, F.greatest(x, F.lit(0.0))).otherwise(x)
        y = F.greatest(y, low) if low is not None else y
        return F.least(y, high) if high is not None else y

    return F.transform(samples, one)


def usable(point: Column, std: Column, product: Column) -> Column:
    """Why a row cannot be sampled; null if it can."""

    def finite(c: Column) -> Column:
        return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))

    return (
        F.when(~finite(point), "point not finite")
        .when(~finite(std), "std not finite")
        .when(std <= 0, "std not positive")
        .when(~product.isin(config.PRODUCTS) | product.isNull(), "unknown product")
    )


def split_inputs(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to sample, rejected rows with a ``reason``)."""
    judged = df.withColumn("reason", usable(F.col("point_forecast"), F.col("std"), F.col("product")))
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null")


def draw(
    df: DataFrame,
    count: int = config.SAMPLE_COUNT,
    seed: int = 1,
    default: str = "normal",
    chosen: dict[str, str] | None = None,
    distributions: dict[str, Sampler] | None = None,
    bounds: dict[str, tuple[float | None, float | None]] | None = None,
) -> DataFrame:
    """Add ``samples`` by the distribution chosen for each product; an unknown name means normal.

    ``bounds`` limits the samples of a product, on top of the rule for ancillary products.

    Rows are small before they get their samples, and adaptive execution would gather many of them in few
    tasks; they are spread by hash over all shuffle partitions first, where a draw costs most.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = df.repartition(tasks, "product", "timestamp")
    known = distributions or DISTRIBUTIONS
    point, std, product = F.col("point_forecast"), F.col("std"), F.col("product")
    key = F.concat_ws("|", product, F.date_format("timestamp", "yyyy-MM-dd HH:mm"))

    def by(name: str) -> Column:
        return known.get(name, normal)(point, std, key, seed, count)

    samples = by(default)
    for p, name in (chosen or {}).items():
        samples = F.when(product == p, by(name)).otherwise(samples)
    samples = constrain(samples, product)
    for p, (low, high) in (bounds or {}).items():
        held = constrain(
            samples, product, None if low is None else F.lit(low), None if high is None else F.lit(high)
        )
        samples = F.when(product == p, held).otherwise(samples)
    return spread.withColumn("samples", samples)

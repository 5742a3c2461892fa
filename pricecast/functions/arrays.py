"""Column expressions on the sample array of a forecast row; nothing here explodes."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(items: Column) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda acc, x: acc + x)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once per row, however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def mean(items: Column) -> Column:
    return _sum(items) / F.size(items)


def sorted_percentile(ordered: Column, q: float) -> Column:
    """Linear percentile of an array that is sorted already; q in [0, 1]."""
    place = (F.size(ordered) - 1) * F.lit(float(q))
    low = F.floor(place).cast("int")
    below = F.get(ordered, low)
    above = F.get(ordered, F.ceil(place).cast("int"))
    return below + (above - below) * (place - low)


def count_below(ordered: Column, value: Column, most: int) -> Column:
    """How many items of a rising array of at most ``most`` items lie below the value, by binary search."""
    steps = [1 << i for i in reversed(range(most.bit_length()))]

    def step(found: Column, size: Column) -> Column:
        return F.when(F.get(ordered, found + size - 1) < value, found + size).otherwise(found)

    # Beyond the end of the array ``get`` is null, and the step is not taken.
    return F.when(ordered.isNotNull(), F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), step))


def percentile(items: Column, q: float) -> Column:
    return sorted_percentile(F.sort_array(items), q)


def interval(items: Column, level: float) -> tuple[Column, Column]:
    """Central interval of the samples at a confidence level."""
    tail = (1.0 - level) / 2.0
    ordered = F.sort_array(items)
    return sorted_percentile(ordered, tail), sorted_percentile(ordered, 1.0 - tail)


def step_quantile(items: Column, q: float) -> Column:
    """The sample at index int(q·n) of the sorted samples, without interpolation."""
    n = F.size(items)
    place = F.least((n * F.lit(float(q))).cast("int"), n - 1)
    return F.get(F.sort_array(items), place)


def _moment(items: Column, centre: Column, power: int) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda acc, x: acc + F.pow(x - centre, F.lit(float(power)))) / F.size(items)


STATISTICS = ("mean", "median", "std", "min", "max", "range", "skew", "kurtosis")


def statistics(items: Column) -> dict[str, Column]:
    """The eight sample statistics: spread and shape are the population forms."""
    n = F.size(items)
    centre = mean(items)
    variance = _moment(items, centre, 2)
    std = F.sqrt(variance)
    low, high = F.array_min(items), F.array_max(items)
    flat = std == 0
    return {
        "mean": centre,
        "median": percentile(items, 0.5),
        "std": std,
        "min": low,
        "max": high,
        "range": high - low,
        "skew": F.when((n <= 2) | flat, 0.0).otherwise(_moment(items, centre, 3) / F.pow(std, F.lit(3.0))),
        "kurtosis": F.when((n <= 3) | flat, 0.0).otherwise(
            _moment(items, centre, 4) / F.pow(variance, F.lit(2.0)) - 3.0
        ),
    }


def from_wide(columns: Sequence[str]) -> Column:
    """Sample columns, in name order, as one array."""
    return F.array(*[F.col(c).cast("double") for c in sorted(columns)])


def to_wide(items: Column, count: int) -> list[Column]:
    return [F.get(items, F.lit(i)).alias(sample_name(i + 1)) for i in range(count)]


def sample_name(number: int) -> str:
    return f"sample_{number:03d}"

"""Repeatable random numbers as columns: the same key gives the same number under any partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# 13 hex digits of a digest make 52 bits, what a double holds.
_DIGITS = 13
_RANGE = float(2**52)


def _uniform(digest: Column, start: int) -> Column:
    whole = F.conv(F.substring(digest, start, _DIGITS), 16, 10).cast("double")
    return (whole + 0.5) / _RANGE


def digests(seed: int, key: Column, count: int) -> Column:
    """One digest per draw, as an array: each is computed once and can feed two numbers."""
    return F.transform(
        F.sequence(F.lit(1), F.lit(count)),
        lambda draw: F.md5(F.concat_ws("|", F.lit(str(seed)), key, draw.cast("string"))),
    )


def uniform(digest: Column) -> Column:
    return _uniform(digest, 1)


def normal(digest: Column) -> Column:
    """Box–Muller on the two halves of one digest."""
    radius = F.sqrt(F.lit(-2.0) * F.log(_uniform(digest, 1)))
    return radius * F.cos(F.lit(2.0) * F.pi() * _uniform(digest, 1 + _DIGITS))

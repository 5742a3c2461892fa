"""Calendar and text columns. Local fields follow the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricecast import config


def localize(naive: Column, zone: str = config.MARKET_ZONE) -> Column:
    """Wall-clock time in ``zone`` → the same moment as UTC wall-clock time."""
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), naive.cast("timestamp_ntz"))


def to_zone(utc: Column, zone: str = config.MARKET_ZONE) -> Column:
    """UTC wall-clock time → wall-clock time in ``zone``."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc.cast("timestamp_ntz"))


def next_midnight(run_time: Column) -> Column:
    """Start of the forecast horizon for a run: 00:00 on the next local day."""
    return F.date_add(F.to_date(run_time), 1).cast("timestamp")


def parse(text: Column, pattern: str | None = None) -> Column:
    """Text → timestamp, null where it cannot be read."""
    return F.try_to_timestamp(text, F.lit(pattern)) if pattern else F.try_to_timestamp(text)


def closed_end(end: Column) -> Column:
    """A range that ends exactly at midnight means the whole of that day."""
    midnight = F.date_trunc("day", end)
    return F.when(end == midnight, end + F.expr("interval 86399 seconds")).otherwise(end)


def plain_price(value: Column, can_be_negative: Column | bool = True) -> Column:
    """Two decimals, half up; negatives become 0 where not allowed."""
    allowed = F.lit(can_be_negative) if isinstance(can_be_negative, bool) else can_be_negative
    shown = F.when(~allowed & (value < 0), F.lit(0.0)).otherwise(value)
    return F.format_string("%.2f", F.round(shown, 2))


def money(value: Column, can_be_negative: Column | bool = True) -> Column:
    """``$1234.50``; null becomes ``-``."""
    text = F.concat(F.lit("$"), plain_price(value, can_be_negative))
    return F.when(value.isNull(), F.lit("-")).otherwise(text)


def money_range(low: Column, high: Column, can_be_negative: Column | bool = True) -> Column:
    """``$10.00 - 12.00``; ``-`` if either end is missing."""
    text = F.concat(money(low, can_be_negative), F.lit(" - "), plain_price(high, can_be_negative))
    return F.when(low.isNull() | high.isNull(), F.lit("-")).otherwise(text)


def date_hour_label(ts: Column) -> Column:
    return F.date_format(ts, "MMM d, HH:mm")

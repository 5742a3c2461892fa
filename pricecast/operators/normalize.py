"""Raw feed rows → typed, localised, cleaned rows; what does not parse is kept apart with a reason."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricecast import config
from pricecast.functions import calendar

REQUIRED = {
    "load": ["timestamp", "load_mw", "region"],
    "price": ["timestamp", "product", "price", "node"],
    "generation": ["timestamp", "fuel_type", "generation_mw", "region"],
}
MEASURE = {"load": "load_mw", "price": "price", "generation": "generation_mw"}


def standard_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip().lower().replace(" ", "_") for c in df.columns])


def require(df: DataFrame, columns: Sequence[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")


def canonical_product(product: Column, products: Sequence[str] | None = None) -> Column:
    """The configured spelling of a product name in any case; null if it is not configured."""
    names = list(products or config.PRODUCTS)
    spelling = F.create_map(*[F.lit(x) for p in names for x in (p.upper(), p)])
    return F.try_element_at(spelling, F.upper(F.trim(product)))


def _moment(df: DataFrame, pattern: str | None) -> Column:
    if dict(df.dtypes)["timestamp"] == "string":
        return calendar.parse(F.col("timestamp"), pattern)
    return F.col("timestamp").cast("timestamp")


def _shaped(df: DataFrame, feed: str, products: Sequence[str] | None, pattern: str | None) -> DataFrame:
    """All rows of a feed in their typed form; a value that cannot be read is null."""
    named = standard_names(df)
    require(named, REQUIRED[feed])
    text = {
        "load": {"region": F.upper("region")},
        "price": {"product": canonical_product(F.col("product"), products), "node": F.upper("node")},
        "generation": {"fuel_type": F.lower("fuel_type"), "region": F.upper("region")},
    }[feed]
    measure = MEASURE[feed]
    number = F.expr(f"try_cast({measure} as double)")
    return named.withColumns({"timestamp": _moment(named, pattern), measure: number, **text})


def _keep(feed: str) -> Column:
    ok = F.col("timestamp").isNotNull() & F.col(MEASURE[feed]).isNotNull()
    return ok & F.col("product").isNotNull() if feed == "price" else ok


def normalize(
    df: DataFrame, feed: str, products: Sequence[str] | None = None, pattern: str | None = None
) -> DataFrame:
    """Clean rows of a ``load``, ``price`` or ``generation`` feed.

    The order of rows is left to the writer or reader: a global sort here would
    be a shuffle of the whole feed that the next operator throws away.
    """
    return _shaped(df, feed, products, pattern).where(_keep(feed))


def split_records(
    df: DataFrame, feed: str, products: Sequence[str] | None = None, pattern: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): rejected rows are typed too and carry a ``reason``."""
    shaped = _shaped(df, feed, products, pattern)
    measure = F.col(MEASURE[feed])
    place = {"load": "region", "price": "node", "generation": "region"}[feed]
    reasons = [(F.col("timestamp").isNull(), "bad timestamp"), (measure.isNull(), "bad value")]
    if feed == "price":
        reasons.append((F.col("product").isNull(), "unknown product"))
    if feed == "load":
        reasons.append((measure <= 0, "load not positive"))
    if feed == "generation":
        reasons.append((measure < 0, "negative generation"))
        reasons.append((F.coalesce(F.trim("fuel_type"), F.lit("")) == "", "empty fuel_type"))
    reasons.append((F.coalesce(F.trim(place), F.lit("")) == "", f"empty {place}"))
    first = F.coalesce(*[F.when(test, F.lit(why)) for test, why in reasons])
    judged = shaped.withColumn("reason", first)
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null")

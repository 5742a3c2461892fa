"""Schemas of the feeds, the forecasts and the tables derived from them."""

from pyspark.sql import types as T

_TS, _S, _D, _B = T.TimestampType(), T.StringType(), T.DoubleType(), T.BooleanType()


def _table(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


LOAD = _table(timestamp=_TS, load_mw=_D, region=_S)
PRICE = _table(timestamp=_TS, product=_S, price=_D, node=_S)
GENERATION = _table(timestamp=_TS, fuel_type=_S, generation_mw=_D, region=_S)
FEEDS = {"load": LOAD, "price": PRICE, "generation": GENERATION}

FORECAST = _table(
    timestamp=_TS,
    product=_S,
    point_forecast=_D,
    samples=T.ArrayType(_D),
    generation_timestamp=_TS,
    is_fallback=_B,
)
METADATA = _table(storage_timestamp=_TS, storage_version=_S, schema_version=_S)
DISPLAY = _table(
    timestamp=_TS, product=_S, point_forecast=_D, lower_bound=_D, upper_bound=_D, is_fallback=_B
)
MODEL = _table(
    product=_S,
    hour=T.IntegerType(),
    feature_names=T.ArrayType(_S),
    coefficients=T.ArrayType(_D),
    intercept=_D,
    metrics=T.MapType(_S, _D),
    created_at=_TS,
)
VIOLATION = _table(category=_S, check=_S, product=_S, timestamp=_TS, value=_D, message=_S)

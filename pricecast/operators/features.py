"""Feature columns for hourly market data.

``keys`` are the series columns (node, region …) besides time; an empty list means one series.
Price columns are named ``price_<product>`` and fuel columns ``generation_<fuel>``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricecast import config
from pricecast.functions.timeline import DAY, HOUR, Chunks, fill, neighbours, row_windows, shift_rows, trailing
from pricecast.operators import reshape
from pricecast.operators.joins import merge_features
from pricecast.sources.scratch import Settle, as_is

RENEWABLE = ("wind", "solar", "hydro")


def temporal(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    day = F.weekday(ts)
    return df.withColumns(
        {
            "hour": F.hour(ts),
            "day_of_week": day,
            "month": F.month(ts),
            "is_weekend": (day >= 5).cast("int"),
            "is_holiday": F.lit(0),
        }
    )


def quotient(a: Column, b: Column) -> Column:
    """a / b as floating point has it: signed infinity for b = 0, null for 0 / 0."""
    unbounded = F.when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf")))
    return F.when(b != 0, a / b).when(b == 0, unbounded)


def load_features(df: DataFrame, keys: Sequence[str] = (), settle: Settle = as_is) -> DataFrame:
    """Change against the row before, and the share of the day's peak and mean; gaps filled back, then forward."""
    made = ["load_rate_of_change", "load_daily_peak", "load_daily_average"]
    # The change is taken between known values: a gap repeats the value before it.
    chunks = Chunks.by_count(df, keys, "timestamp", settle)
    lagged = neighbours(df, keys, "timestamp", ["load_mw"], backward=False, strict=True, chunks=chunks)
    before = F.col("prev_load_mw")
    date = F.to_date("timestamp")
    daily = df.groupBy(*keys, date.alias("_date")).agg(
        F.max("load_mw").alias("_peak"), F.avg("load_mw").alias("_mean")
    )
    wide = lagged.withColumn("_date", date).join(daily, [*keys, "_date"])
    load = F.col("load_mw")
    featured = wide.select(
        *df.columns,
        ((quotient(F.coalesce(load, before), before) - 1) * 100).alias(made[0]),
        quotient(load, F.col("_peak")).alias(made[1]),
        quotient(load, F.col("_mean")).alias(made[2]),
    )
    return fill(settle(featured), keys, "timestamp", ["load_mw", *made], ("backward", "forward"), chunks=chunks)


def _total(columns: Sequence[str]) -> Column:
    return sum((F.coalesce(F.col(c), F.lit(0.0)) for c in columns), F.lit(0.0))


def mix_entropy(columns: Sequence[str]) -> Column:
    """Normalised entropy of the fuel mix: 0 for one fuel, no generation or an unknown fuel, 1 for equal shares."""
    values = F.array(*[F.col(c) for c in columns])
    unknown = F.exists(values, lambda x: x.isNull())
    total = sum((F.col(c) for c in columns), F.lit(0.0))
    terms = F.transform(
        F.filter(values, lambda x: x > 0), lambda x: -(x / total) * F.log(x / total)
    )
    entropy = F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x)
    few = F.size(terms) <= 1
    return F.when(unknown | (total <= 0) | few, 0.0).otherwise(entropy / F.lit(math.log(max(len(columns), 2))))


def generation_features(
    df: DataFrame, fuels: Sequence[str], keys: Sequence[str] = (), settle: Settle = as_is
) -> DataFrame:
    """Fuel columns, total, renewable share and diversity of the mix; gaps filled back, forward, then 0."""
    wide = reshape.pivot_generation(df, fuels, [*keys, "timestamp"], missing=None)
    fuel_columns = [f"generation_{f}" for f in fuels]
    green = [c for c in fuel_columns if any(r in c.lower() for r in RENEWABLE)]
    total = _total(fuel_columns)
    made = {"total_generation": total, "fuel_mix_diversity": mix_entropy(fuel_columns)}
    if green:
        made["renewable_ratio"] = quotient(_total(green), total)
    names = [*fuel_columns, *made]
    wide = settle(wide.withColumns(made))
    filled = fill(wide, keys, "timestamp", names, ("backward", "forward"), chunks=Chunks.by_count(wide, keys, "timestamp", settle))
    return filled.fillna(0.0, names)


def price_features(
    df: DataFrame, products: Sequence[str], keys: Sequence[str] = (), settle: Settle = as_is
) -> DataFrame:
    """Price columns with 24 h deviation, 24 h and 7 d means and the day-ahead spread; filled back, then forward."""
    wide = reshape.pivot_prices(df, products, [*keys, "timestamp"])
    columns = [f"price_{p}" for p in products]
    rolled = {}
    for c in columns:
        rolled[f"{c}_volatility_24h"] = (DAY, lambda c=c: F.stddev_samp(c))
        rolled[f"{c}_ma_24h"] = (DAY, lambda c=c: F.avg(c))
        rolled[f"{c}_ma_7d"] = (7 * DAY, lambda c=c: F.avg(c))
    made = trailing(wide, keys, "timestamp", rolled, settle)
    names = [*columns, *rolled]
    if "DALMP" in products and "RTLMP" in products:
        made = made.withColumn("price_spread_DA_RT", F.col("price_DALMP") - F.col("price_RTLMP"))
        names.append("price_spread_DA_RT")
    made = settle(made)
    return fill(made, keys, "timestamp", names, ("backward", "forward"), chunks=Chunks.by_count(made, keys, "timestamp", settle))


def base_features(
    load: DataFrame,
    prices: DataFrame,
    generation: DataFrame,
    products: Sequence[str],
    fuels: Sequence[str],
    keys: Sequence[str] = (),
    settle: Settle = as_is,
) -> DataFrame:
    """Temporal, load, generation and price features of one hour (and series) in one row.

    ``settle`` is applied to frames that are read more than once; the default keeps one lazy plan.
    """
    load_side = temporal(load_features(load.select(*keys, "timestamp", "load_mw"), keys, settle))
    frames = {
        "load": load_side,
        "generation": generation_features(generation, fuels, keys, settle),
        "price": price_features(prices, products, keys, settle),
    }
    return merge_features(frames, [*keys, "timestamp"])


def _at_least(column: str) -> Column:
    return F.when(F.col(column) > config.RATIO_FLOOR, F.col(column)).otherwise(config.RATIO_FLOOR)


def load_generation_ratio(load: str = "load_mw", generation: str = "total_generation") -> Column:
    return F.least(F.col(load) / _at_least(generation), F.lit(10.0))


def spread_columns(columns: Sequence[str], prefix: str = "price_") -> dict[str, Column]:
    """Differences of the configured product pairs for which both columns exist."""
    return {
        f"spread_{a.lower()}_{b.lower()}": F.col(prefix + a) - F.col(prefix + b)
        for a, b in config.SPREAD_PAIRS
        if prefix + a in columns and prefix + b in columns
    }


def volatility(
    df: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    windows: Sequence[int] = tuple(config.VOLATILITY_ROWS),
    settle: Settle = as_is,
) -> DataFrame:
    """Deviation over the last w rows: gaps filled forward, then by the mean of the series.

    A window longer than a series gives null for that series.
    """
    names = {f"volatility_{c}_{w}h": (c, w) for c in columns for w in windows}
    rolled = row_windows(
        df,
        keys,
        "timestamp",
        max(windows),
        lambda w: {n: F.stddev_samp(c).over(w(size)) for n, (c, size) in names.items()},
        columns,
        settle=settle,
    )
    rolled = settle(rolled)
    forward = settle(fill(rolled, keys, "timestamp", list(names), chunks=Chunks.by_count(rolled, keys, "timestamp", settle)))
    means = forward.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_rows"), *[F.avg(n).alias(f"_mean_{n}") for n in names]
    )
    if keys:
        whole = forward.join(means, list(keys))
        size, mean = F.col("_rows"), (lambda n: F.col(f"_mean_{n}"))
    else:
        whole = forward.withColumn("_all", means.select(F.struct(*means.columns)).scalar())
        size, mean = F.col("_all._rows"), (lambda n: F.col(f"_all._mean_{n}"))
    final = {n: F.when(size >= w, F.coalesce(F.col(n), mean(n))) for n, (_, w) in names.items()}
    return whole.select(*df.columns, *[v.alias(n) for n, v in final.items()])


def renewable_columns(
    columns: Sequence[str], wind: str = "generation_wind", solar: str = "generation_solar"
) -> dict[str, Column]:
    """Renewable totals and ratios, and their weight by hour of day."""
    if wind not in columns or solar not in columns:
        return {}
    total = F.col(wind) + F.col(solar)
    made = {"total_renewable": total}
    if "total_generation" in columns:
        made["renewable_ratio"] = F.least(total / _at_least("total_generation"), F.lit(1.0))
    if "load_mw" in columns:
        made["renewable_to_load"] = F.least(total / _at_least("load_mw"), F.lit(1.5))
    if "hour" in columns:
        angle = F.pi() * F.col("hour") / 12
        made["solar_hour_impact"] = F.col(solar) * F.sin(angle)
        made["wind_hour_impact"] = F.col(wind) * (1 - F.cos(angle))
    return made


def interaction_columns(columns: Sequence[str], wanted: Sequence[str] | None = None) -> dict[str, Column]:
    """Hour, hour angle, weekend and weekday times each wanted column."""
    chosen = [c for c in (wanted or ["load_mw", "total_generation"]) if c in columns]
    if wanted is None:
        chosen += [c for c in columns if any(p.lower() in c.lower() for p in config.PRODUCTS)]
    made = {}
    angle = 2 * F.pi() * F.col("hour") / 24
    for c in chosen:
        value = F.col(c)
        if "hour" in columns:
            made[f"hour_x_{c}"] = F.col("hour") * value
            made[f"hour_sin_x_{c}"] = F.sin(angle) * value
            made[f"hour_cos_x_{c}"] = F.cos(angle) * value
        if "is_weekend" in columns:
            made[f"weekend_x_{c}"] = F.col("is_weekend") * value
        if "day_of_week" in columns:
            made[f"day_of_week_x_{c}"] = F.col("day_of_week") * value
    return made


def derived_features(
    df: DataFrame,
    keys: Sequence[str] = (),
    price_columns: Sequence[str] | None = None,
    windows: Sequence[int] = tuple(config.VOLATILITY_ROWS),
    settle: Settle = as_is,
) -> DataFrame:
    """Ratio, spreads, volatility, renewable impact and interactions on top of the base features."""
    missing = [c for c in ("load_mw", "hour", "day_of_week", "is_weekend") if c not in df.columns]
    if missing:
        raise ValueError(f"missing base features: {missing}")
    prices = list(price_columns or [c for c in df.columns if c in {f"price_{p}" for p in config.PRODUCTS}])
    first = {}
    if "total_generation" in df.columns:
        first["load_generation_ratio"] = load_generation_ratio()
    first.update(spread_columns(df.columns))
    out = df.withColumns(first) if first else df
    if prices:
        out = volatility(settle(out), keys, prices, windows, settle)
    green = renewable_columns(out.columns)
    out = out.withColumns(green) if green else out
    crossed = interaction_columns(out.columns, ["load_mw", "total_generation", *prices])
    return out.withColumns(crossed)


def lags(
    df: DataFrame,
    columns: Sequence[str],
    periods: Sequence[int] = tuple(config.LAGS),
    keys: Sequence[str] = (),
    ties: Sequence[str] = (),
    step_seconds: int = HOUR,
    settle: Settle = as_is,
) -> DataFrame:
    """``<column>_lag_<k>``: the value k rows before, for all columns and k in one pass."""
    if any(not isinstance(k, int) or k <= 0 for k in periods):
        raise ValueError("lag periods are positive integers")
    wanted = {f"{c}_lag_{k}": (c, k) for c in columns for k in periods}
    return shift_rows(df, keys, "timestamp", wanted, ties, step_seconds, settle)


def pair_columns(columns: Sequence[str], pairs: Sequence[tuple[str, str]] | None = None) -> dict[str, Column]:
    return {
        f"{a}_x_{b}": F.col(a) * F.col(b)
        for a, b in (pairs or config.INTERACTION_PAIRS)
        if a in columns and b in columns
    }


def hour_categories(hour: Column) -> Column:
    """The categories of an hour of day; an hour can be in several."""

    def inside(ranges) -> Column:
        tests = [hour.between(a, b) for a, b in ranges]
        return tests[0] if len(tests) == 1 else tests[0] | tests[1]

    return F.array_compact(
        F.array(*[F.when(inside(r), F.lit(name)) for name, r in config.HOUR_CATEGORIES.items()])
    )


def feature_list(product: str, hour: int, available: Sequence[str]) -> list[str]:
    """Names of the features of one product and hour that are available, each once."""
    wanted = [*config.BASE_FEATURES, *config.PRODUCT_FEATURES.get(product, [])]
    for name, ranges in config.HOUR_CATEGORIES.items():
        if any(a <= hour <= b for a, b in ranges):
            wanted += config.HOUR_FEATURES[name]
    return list(dict.fromkeys(c for c in wanted if c in available))


def select_features(df: DataFrame, product: str, hour: int) -> DataFrame:
    if product not in config.PRODUCTS or not 0 <= hour <= 23:
        raise ValueError(f"no such product and hour: {product}, {hour}")
    return df.where(F.col("hour") == hour).select("timestamp", *feature_list(product, hour, df.columns))


def product_hour_vectors(
    df: DataFrame, products: Sequence[str] | None = None, extra: Sequence[str] = ()
) -> DataFrame:
    """All (product, hour) feature sets as one long table: (product, hour, keys, feature map).

    The list of names is a constant per product and hour, so it is looked up in the projection;
    a row is repeated once per product, never shuffled.
    """
    names = list(products or config.PRODUCTS)
    listed = {(p, h): [*feature_list(p, h, df.columns), *extra] for p in names for h in range(24)}
    used = list(dict.fromkeys(c for cols in listed.values() for c in cols))
    by_pair = F.create_map(
        *[x for (p, h), cols in listed.items() for x in (F.lit(f"{p}|{h}"), F.array(*[F.lit(c) for c in cols]))]
    )
    values = F.create_map(*[x for c in used for x in (F.lit(c), F.col(c).cast("double"))])
    rows = df.withColumn("product", F.explode(F.array(*[F.lit(p) for p in names])))
    pair = F.concat_ws("|", "product", "hour")
    features = F.try_element_at(by_pair, pair)
    return rows.withColumn("feature_names", features).select(
        "timestamp",
        "product",
        "hour",
        "feature_names",
        F.transform("feature_names", lambda n: F.try_element_at(values, n)).alias("features"),
    )

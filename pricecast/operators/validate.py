"""Validation: every check gives rows (category, check, product, timestamp, value, message).

No rows means valid. Row checks of one frame run in one pass: failed checks of a row are
collected in an array that is unfolded, instead of one scan per check.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricecast import config
from pricecast.functions.timeline import shift_rows
from pricecast.operators import normalize, topk
from pricecast.operators.aggregates import attach
from pricecast.operators.uncertainty import lookup
from pricecast.sources.scratch import Settle, as_is

COLUMNS = ["category", "check", "product", "timestamp", "value", "message"]


def _row(category: str, check: str, product: Column, timestamp: Column, value: Column, message: Column) -> Column:
    return F.struct(
        F.lit(category).alias("category"),
        F.lit(check).alias("check"),
        product.cast("string").alias("product"),
        timestamp.cast("timestamp").alias("timestamp"),
        value.cast("double").alias("value"),
        message.alias("message"),
    )


def _null(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


def failures(
    df: DataFrame,
    category: str,
    rules: Sequence[tuple[str, Column, Column | None, str]],
    product: Column | None = None,
    timestamp: Column | None = None,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Rules are (check, failed?, value, message); one pass over the rows for all of them.

    ``keys`` are columns that tell forecasts apart; they stay in front of each violation.
    """
    who = F.col("product") if product is None else product
    when = F.col("timestamp") if timestamp is None else timestamp
    cells = [
        F.when(F.coalesce(failed, F.lit(False)), _row(category, check, who, when, _null() if value is None else value, F.lit(text)))
        for check, failed, value, text in rules
    ]
    return df.select(*keys, F.inline(F.array_compact(F.array(*cells))))


def _stale(as_of: Column | None) -> list[tuple[str, Column, Column | None, str]]:
    """Times more than a year away from the reference time."""
    missing = ("timestamp", F.col("timestamp").isNull(), None, "timestamp is null")
    if as_of is None:
        return [missing]
    far = F.abs(F.datediff(F.col("timestamp"), as_of)) > 365
    return [missing, ("timestamp_range", far, None, "timestamp more than 365 days from the run")]


def _blank(column: str) -> tuple[str, Column, None, str]:
    return (column, F.coalesce(F.trim(column), F.lit("")) == "", None, f"{column} is empty")


def load_feed(df: DataFrame, as_of: Column | None = None) -> DataFrame:
    normalize.require(df, normalize.REQUIRED["load"])
    rules = [
        *_stale(as_of),
        ("load_mw", F.col("load_mw").isNull(), None, "load_mw is null"),
        ("load_positive", F.col("load_mw") <= 0, F.col("load_mw"), "load_mw must be positive"),
        _blank("region"),
    ]
    return failures(df, "load", rules, _null())


def price_feed(df: DataFrame, as_of: Column | None = None, products: Sequence[str] | None = None) -> DataFrame:
    normalize.require(df, normalize.REQUIRED["price"])
    unknown = ~F.coalesce(F.col("product").isin(list(products or config.PRODUCTS)), F.lit(False))
    rules = [
        *_stale(as_of),
        ("product", unknown, None, "product is not known"),
        ("price", F.col("price").isNull(), None, "price is null"),
        _blank("node"),
    ]
    return failures(df, "price", rules)


def generation_feed(df: DataFrame, as_of: Column | None = None) -> DataFrame:
    normalize.require(df, normalize.REQUIRED["generation"])
    rules = [
        *_stale(as_of),
        ("generation_mw", F.col("generation_mw").isNull(), None, "generation_mw is null"),
        ("generation_sign", F.col("generation_mw") < 0, F.col("generation_mw"), "generation_mw is negative"),
        _blank("fuel_type"),
        _blank("region"),
    ]
    return failures(df, "generation", rules, _null())


def time_coverage(df: DataFrame, start: Column, end: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Whether the rows reach from start to end."""
    ends = df.groupBy(*keys).agg(F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))
    covered = (F.col("first") <= start) & (F.col("last") >= end)
    return ends.withColumn("covered", F.coalesce(covered, F.lit(False)))


def feed_coverage(feeds: dict[str, DataFrame], limit: float = config.COVERAGE_LIMIT) -> DataFrame:
    """Distinct times of each feed as a share of the times of any feed."""
    marked = [
        df.select("timestamp", *[F.lit(other == name).alias(other) for other in feeds]) for name, df in feeds.items()
    ]
    flags = topk.concat(*marked).groupBy("timestamp").agg(*[F.bool_or(n).alias(n) for n in feeds])
    counts = flags.agg(*[F.count_if(F.col(n)).alias(n) for n in feeds], F.count(F.lit(1)).alias("_all"))
    cells = F.array(*[F.struct(F.lit(n).alias("feed"), F.col(n).alias("times")) for n in feeds])
    shares = counts.select("_all", F.inline(cells))
    share = F.col("times") / F.nullif("_all", F.lit(0))
    return shares.select("feed", "times", F.col("_all").alias("all_times"), share.alias("coverage"), (share >= limit).alias("covered"))


def all_feeds(
    load: DataFrame, prices: DataFrame, generation: DataFrame, as_of: Column | None = None
) -> DataFrame:
    """Feed checks and cross-feed coverage in one table."""
    gaps = feed_coverage({"load": load, "price": prices, "generation": generation}).where(~F.col("covered"))
    low = gaps.select(
        F.lit("coverage").alias("category"),
        F.col("feed").alias("check"),
        _null().alias("product"),
        _null("timestamp").alias("timestamp"),
        F.col("coverage").alias("value"),
        F.lit("feed covers too few times").alias("message"),
    )
    return topk.concat(load_feed(load, as_of), price_feed(prices, as_of), generation_feed(generation, as_of), low)


def forecast_schema(
    df: DataFrame,
    as_of: Column | None = None,
    count: int = config.SAMPLE_COUNT,
    products: Sequence[str] | None = None,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Required columns up front, then values, nulls, product list, sample count and generation time per row."""
    normalize.require(df, ["timestamp", "product", "point_forecast", "samples", "generation_timestamp", "is_fallback"])
    point, samples = F.col("point_forecast"), F.col("samples")
    unknown = ~F.coalesce(F.col("product").isin(list(products or config.PRODUCTS)), F.lit(False))
    rules = [
        *_stale(as_of),
        ("product", unknown, None, "product is not known"),
        ("point_forecast", point.isNull() | F.isnan(point), point, "point forecast is missing"),
        ("sample_count", samples.isNull() | (F.size(samples) != count), F.size(samples), "wrong number of samples"),
        ("sample_values", F.exists(samples, lambda x: x.isNull() | F.isnan(x)), None, "samples have gaps"),
        ("is_fallback", F.col("is_fallback").isNull(), None, "is_fallback is null"),
        ("generation_timestamp", F.col("generation_timestamp").isNull(), None, "generation time is null"),
    ]
    if as_of is not None:
        late = F.col("generation_timestamp").cast("timestamp") > as_of
        rules.append(("generation_future", late, None, "generated after the run"))
    return failures(df, "schema", rules, keys=keys)


def expected_cells(starts: DataFrame, start: str, products: Sequence[str], hours: int = config.HORIZON_HOURS) -> DataFrame:
    """All (product, hour) cells of the horizons that begin at ``start``: unfolded lists, no join."""
    end = F.col(start) + F.expr(f"interval {hours - 1} hours")
    return starts.withColumn("product", F.explode(F.array(*[F.lit(p) for p in products]))).withColumn(
        "timestamp", F.explode(F.sequence(F.col(start), end, F.expr("interval 1 hour")))
    )


def missing_cells(df: DataFrame, expected: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    columns = [*keys, "product", "timestamp"]
    return expected.select(*columns).join(df.select(*columns), columns, "left_anti")


def completeness(
    df: DataFrame,
    starts: DataFrame,
    start: str,
    products: Sequence[str] | None = None,
    hours: int = config.HORIZON_HOURS,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Missing cells with their kind: a whole product, a whole hour, or a single cell.

    A cell can be of two kinds; groups are at most one horizon long or one product list wide.
    """
    names = list(products or config.PRODUCTS)
    missing = missing_cells(df, expected_cells(starts, start, names, hours), keys)
    by_product = missing.groupBy(*keys, "product").agg(F.count(F.lit(1)).alias("_hours"))
    by_hour = missing.groupBy(*keys, "timestamp").agg(F.count(F.lit(1)).alias("_products"))
    counted = missing.join(by_product, [*keys, "product"]).join(by_hour, [*keys, "timestamp"])
    kinds = F.array_compact(
        F.array(
            F.when(F.col("_hours") == hours, "missing_products").otherwise("partial_missing"),
            F.when(F.col("_products") == len(names), "missing_timestamps"),
        )
    )
    return counted.select(*keys, "product", "timestamp", F.explode(kinds).alias("kind"))


def completeness_violations(df: DataFrame, starts: DataFrame, start: str, **options) -> DataFrame:
    found = completeness(df, starts, start, **options)
    cell = _row("completeness", "", F.col("product"), F.col("timestamp"), _null(), F.lit("no forecast"))
    return found.select(*options.get("keys", ()), F.inline(F.array(cell.withField("check", F.col("kind")))))


def missing_values(df: DataFrame, group: str, column: str, expected: Column) -> DataFrame:
    """Per group, the expected values it lacks. ``expected`` is an array column, such as a literal list or a
    ``sequence``: each group unfolds it, so no join multiplies rows."""
    have = df.select(group, column).distinct()
    wanted = have.select(group).distinct().withColumn(column, F.explode(expected))
    return wanted.join(have, [group, column], "left_anti")


def value_ranges(
    df: DataFrame, limits: dict[str, tuple[float, float, float]] | None = None, keys: Sequence[str] = ()
) -> DataFrame:
    """Point and samples against the product's limits; null is a violation, unlisted products are skipped."""
    table = limits or config.PLAUSIBLE_LIMITS
    low = lookup({p: v[0] for p, v in table.items()}, F.col("product"), None)
    high = lookup({p: v[1] for p, v in table.items()}, F.col("product"), None)
    known = df.where(F.col("product").isin(list(table))).withColumns({"_low": low, "_high": high})
    inside = lambda x: F.coalesce(x.between(F.col("_low"), F.col("_high")) & ~F.isnan(x), F.lit(False))
    point = F.col("point_forecast")
    text = F.lit("outside the allowed range")
    product, ts = F.col("product"), F.col("timestamp")
    bad_point = _row("plausibility", "point_range", product, ts, point, text)
    cells = F.filter(F.array(bad_point), lambda _: ~inside(point))
    if "samples" in df.columns:
        numbered = F.transform("samples", lambda x, i: F.struct(i.alias("i"), x.alias("x")))
        bad = F.filter(numbered, lambda s: ~inside(s["x"]))
        rows = F.transform(
            bad,
            lambda s: _row(
                "plausibility", "sample_range", product, ts, s["x"], F.format_string("sample_%03d outside the allowed range", s["i"] + 1)
            ),
        )
        cells = F.concat(cells, rows)
    return known.select(*keys, F.inline(cells))


def column_ranges(df: DataFrame, limits: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """How many values of each column lie below and above its bounds."""
    counts = []
    for c, (low, high) in limits.items():
        below = F.count_if(F.col(c) < low) if low is not None else F.lit(0).cast("bigint")
        above = F.count_if(F.col(c) > high) if high is not None else F.lit(0).cast("bigint")
        counts.append(F.struct(F.lit(c).alias("column"), below.alias("below"), above.alias("above")))
    return df.agg(F.array(*counts).alias("_c")).select(F.inline("_c"))


def _with_spread(df: DataFrame, keys: Sequence[str], value: str, settle: Settle = as_is) -> DataFrame:
    """Mean and deviation (n − 1) per key on each row. Groups are reduced before the shuffle and joined
    back at run time by size, so a hot key does not have to fit a window."""
    figures = df.groupBy(*keys).agg(
        F.avg(value).alias("_mean"), F.stddev_samp(value).alias("_std"), F.count(value).alias("_rows")
    )
    if keys:
        return attach(df, settle(figures), keys)
    whole = df.withColumn("_all", figures.select(F.struct("_mean", "_std", "_rows")).scalar())
    return whole.withColumns({c: F.col(f"_all.{c}") for c in ("_mean", "_std", "_rows")})


def forecast_outliers(
    df: DataFrame, limits: dict[str, tuple[float, float, float]] | None = None, keys: Sequence[str] = ()
) -> DataFrame:
    """Points further from the product's mean than its threshold of deviations."""
    table = limits or config.PLAUSIBLE_LIMITS
    threshold = lookup({p: v[2] for p, v in table.items()}, F.col("product"), None)
    point = F.col("point_forecast")
    known = df.where(F.col("product").isin(list(table)))
    spread = _with_spread(known, [*keys, "product"], "point_forecast").where(F.col("_std") >= 1e-8)
    far = spread.where(F.abs(point - F.col("_mean")) > threshold * F.col("_std"))
    cell = _row("plausibility", "outlier", F.col("product"), F.col("timestamp"), point, F.lit("far from the mean"))
    return far.select(*keys, F.inline(F.array(cell)))


def outliers(
    df: DataFrame, column: str, threshold: float = 3.0, keys: Sequence[str] = (), settle: Settle = as_is
) -> DataFrame:
    """Rows whose z-score exceeds the threshold; none if all values are equal."""
    spread = _with_spread(df, keys, column, settle=settle).where(F.col("_std") > 0)
    z = (F.col(column) - F.col("_mean")) / F.col("_std")
    return spread.withColumn("z_score", z).where(F.abs("z_score") > threshold).select(*df.columns, "z_score")


_COMPARE: dict[str, Callable[[Column, Column], Column]] = {
    "greater_than": lambda a, b: a > b,
    "less_than": lambda a, b: a < b,
    "equal_to": lambda a, b: a == b,
}


def product_order(
    df: DataFrame, rules: Sequence[tuple[str, str, str]] | None = None, keys: Sequence[str] = ()
) -> DataFrame:
    """Products that must lie above, below or at one another at the same time; absent products are skipped.

    One aggregate turns each hour into a row of product values; the rules are read from that row.
    """
    listed = list(rules or config.ORDER_RULES)
    names = list(dict.fromkeys(p for a, b, _ in listed for p in (a, b)))
    is_product = {p: F.col("product") == p for p in names}
    wide = df.groupBy(*keys, "timestamp").agg(
        *[F.max(F.when(is_product[p], F.col("point_forecast"))).alias(f"_v{i}") for i, p in enumerate(names)],
        *[F.bool_or(is_product[p]).alias(f"_h{i}") for i, p in enumerate(names)],
    )
    place = {p: i for i, p in enumerate(names)}
    cells = []
    for first, second, relation in listed:
        i, j = place[first], place[second]
        a, b = F.col(f"_v{i}"), F.col(f"_v{j}")
        holds = F.coalesce(_COMPARE[relation](a, b) & ~F.isnan(a) & ~F.isnan(b), F.lit(False))
        broken = F.col(f"_h{i}") & F.col(f"_h{j}") & ~holds
        text = F.lit(f"{first} {relation} {second} does not hold")
        cells.append(F.when(broken, _row("consistency", "product_order", F.lit(first), F.col("timestamp"), a, text)))
    return wide.select(*keys, F.inline(F.array_compact(F.array(*cells))))


def smoothness(df: DataFrame, limit: float = config.SMOOTHNESS_LIMIT, keys: Sequence[str] = ("product",)) -> DataFrame:
    """Relative change against the row before beyond the limit; a previous value of 0 is skipped."""
    lagged = shift_rows(df.select(*keys, "timestamp", "point_forecast"), keys, "timestamp", {"_before": ("point_forecast", 1)})
    before, now = F.col("_before"), F.col("point_forecast")
    change = F.abs(now - before) / F.abs(F.nullif(before, F.lit(0.0)))
    jumped = lagged.withColumn("_change", change).where(F.col("_change") > limit)
    cell = _row(
        "consistency", "smoothness", F.col("product"), F.col("timestamp"), F.col("_change"), F.lit("change too large")
    )
    return jumped.select(*[k for k in keys if k != "product"], F.inline(F.array(cell)))


def plausibility(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return value_ranges(df, keys=keys).unionByName(forecast_outliers(df, keys=keys))


def consistency(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return product_order(df, keys=keys).unionByName(smoothness(df, keys=(*keys, "product")))


def forecast(
    df: DataFrame,
    starts: DataFrame,
    start: str,
    as_of: Column | None = None,
    count: int = config.SAMPLE_COUNT,
    products: Sequence[str] | None = None,
    hours: int = config.HORIZON_HOURS,
    keys: Sequence[str] = (),
) -> DataFrame:
    """All checks of a forecast: schema, completeness, plausibility, consistency.

    With ``keys``, such as the forecast date, rows and starts of several forecasts are checked each on its own.
    """
    return topk.concat(
        forecast_schema(df, as_of, count, products, keys),
        completeness_violations(df, starts, start, products=products, hours=hours, keys=keys),
        plausibility(df, keys),
        consistency(df, keys),
    )


CATEGORIES = ("schema", "completeness", "plausibility", "consistency")


def summary(
    violations: DataFrame,
    categories: Sequence[str] = CATEGORIES,
    keys: Sequence[str] = (),
    forecasts: DataFrame | None = None,
) -> DataFrame:
    """One row per category (and forecast, with ``keys``) with its number of violations and whether it is valid.

    ``forecasts`` lists the keys of all forecasts, so that those without violations are told too.
    """
    found = violations.groupBy(*keys).agg(
        *[F.count_if(F.col("category") == c).alias(c) for c in categories], F.count(F.lit(1)).alias("all")
    )
    if forecasts is not None:
        found = forecasts.select(*keys).distinct().join(found, list(keys), "left").fillna(0, [*categories, "all"])
    cells = F.array(
        *[F.struct(F.lit(c).alias("category"), F.col(f"`{c}`").alias("violations")) for c in [*categories, "all"]]
    )
    return found.select(*keys, F.inline(cells)).withColumn("is_valid", F.col("violations") == 0)


def sample_bounds(df: DataFrame, absolute: bool = False) -> DataFrame:
    """Rows whose point lies outside [least sample × 0.9, greatest sample × 1.1].

    With ``absolute`` the margins are a tenth of the sizes, which also suits negative samples.
    """
    low, high = F.array_min("samples"), F.array_max("samples")
    floor, ceiling = (low - F.abs(low) * 0.1, high + F.abs(high) * 0.1) if absolute else (low * 0.9, high * 1.1)
    point = F.col("point_forecast")
    rule = ("sample_bounds", (point < floor) | (point > ceiling), point, "point outside the samples")
    return failures(df, "storage", [rule])


STORED_FIELDS = ("storage_timestamp", "storage_version", "schema_version")


def storage_integrity(df: DataFrame, shown: int | None = None) -> DataFrame:
    """Missing metadata, wrong time types, and all points outside their samples.

    With ``shown``, for a message to a reader, only the first so many points and one row that counts the rest.
    """
    notes = [("missing_metadata", f"missing {c}") for c in STORED_FIELDS if c not in df.columns]
    kinds = dict(df.dtypes)
    notes += [
        ("data_type", f"{c} is not a time")
        for c in ("timestamp", "generation_timestamp", "storage_timestamp")
        if c in kinds and not kinds[c].startswith("timestamp")
    ]
    bad = sample_bounds(df)
    result = bad
    if shown is not None:
        rest = _row("storage", "more", _null(), _null("timestamp"), F.col("_n"), F.lit("more rows"))
        more = bad.agg((F.count(F.lit(1)) - shown).alias("_n")).where("_n > 0").select(F.inline(F.array(rest)))
        result = bad.orderBy("timestamp", "product").limit(shown).unionByName(more)
    if notes:
        cells = [_row("storage", check, _null(), _null("timestamp"), _null(), F.lit(text)) for check, text in notes]
        one = df.sparkSession.range(1).select(F.inline(F.array(*cells)))
        result = result.unionByName(one)
    return result


def price_bounds(df: DataFrame) -> DataFrame:
    """Per product: negative prices where not allowed, and points outside their bounds."""
    allowed = lookup({row[0]: row[4] for row in config.PRODUCT_ATTRIBUTES}, F.col("product"), False)
    negative = (F.col("point_forecast") < 0) & ~allowed
    outside = ~F.col("point_forecast").between(F.col("lower_bound"), F.col("upper_bound"))
    return df.groupBy("product").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(negative).alias("negative_prices"),
        F.count_if(outside).alias("outside_bounds"),
    )


def version_compatible(version: Column, current: str = config.SCHEMA_VERSION) -> Column:
    """Same major version; a missing version is not compatible."""
    return F.coalesce(F.split(version, r"\.")[0] == current.split(".")[0], F.lit(False))


def apply_rules(df: DataFrame, rules: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """User rules, each a function from rows to violations; a rule that cannot be planned is itself a violation."""
    found = []
    for name, rule in rules.items():
        try:
            found.append(rule(df).select(*COLUMNS))
        except Exception as problem:  # the rule is user code: whatever it raises is reported
            text = F.lit(f"rule failed: {type(problem).__name__}")
            cell = _row("rule", name, _null(), _null("timestamp"), _null(), text)
            found.append(df.sparkSession.range(1).select(F.inline(F.array(cell))))
    return topk.concat(*found)


def ensembles(df: DataFrame, keys: Sequence[str] = ("ensemble_id",)) -> DataFrame:
    """Rows with ``start_time`` and ``end_time`` of their ensemble: one product each, times inside, points present."""
    products = df.groupBy(*keys).agg(F.min("product").alias("_a"), F.max("product").alias("_b"))
    mixed = products.where("_a <> _b").select(
        F.inline(
            F.array(_row("ensemble", "single_product", F.col("_a"), _null("timestamp"), _null(), F.lit("more than one product")))
        )
    )
    ts = F.col("timestamp")
    rules = [
        ("time_range", (ts < F.col("start_time")) | (ts > F.col("end_time")), None, "outside the range of the ensemble"),
        ("point_forecast", F.col("point_forecast").isNull(), None, "point forecast is missing"),
    ]
    return failures(df, "ensemble", rules).unionByName(mixed)

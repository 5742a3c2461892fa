"""The forecast table: Parquet partitioned by forecast date and product, and the index derived from it."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricecast import config
from pricecast.operators import topk, validate
from pricecast.operators.uncertainty import lookup

KEYS = ["forecast_date", "product"]


# --- storing -----------------------------------------------------------------------------------


def add_metadata(df: DataFrame, as_of: Column) -> DataFrame:
    return df.withColumns(
        {
            "storage_timestamp": as_of,
            "storage_version": F.lit(config.STORAGE_VERSION),
            "schema_version": F.lit(config.SCHEMA_VERSION),
        }
    )


def write(df: DataFrame, path: str, as_of: Column) -> None:
    """Store forecasts; a (date, product) that is written again replaces the old rows.

    The rebalance hint gives each partition few files and splits a partition that grew large.
    """
    stamped = add_metadata(df, as_of)
    (
        stamped.hint("rebalance", *KEYS)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "snappy")
        .partitionBy(*KEYS)
        .parquet(path)
    )


def upgrade(df: DataFrame, columns: dict[str, str] | None = None) -> DataFrame:
    """Restamp to the current schema version; columns new in it are filled with null."""
    added = {c: F.lit(None).cast(kind) for c, kind in (columns or {}).items() if c not in df.columns}
    return df.withColumns({**added, "schema_version": F.lit(config.SCHEMA_VERSION)})


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", False).parquet(path)


def read_one(store: DataFrame, forecast_date: Column, product: str) -> DataFrame:
    """One forecast: both conditions are on partition columns, so other folders are not listed."""
    return upgrade(store.where((F.col("forecast_date") == forecast_date) & (F.col("product") == product)))


def read_range(store: DataFrame, start: str, end: str, product: str | None = None) -> DataFrame:
    """All forecasts dated in the closed range, of one or all products."""
    if start > end:
        raise ValueError("start lies after end")
    rows = store.where(F.col("forecast_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return rows if product is None else rows.where(F.col("product") == product)


def read_products(store: DataFrame, products: Sequence[str]) -> DataFrame:
    """Several products in one scan; a product without rows is simply absent."""
    return store.where(F.col("product").isin(list(products)))


def read_latest(store: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """The rows of the newest generation of each product.

    With an index only the folders it points to are read: the newest (date, product) pairs are found in
    the index and joined on the partition columns.
    """
    if index is not None:
        newest = index.groupBy("product").agg(F.max_by("forecast_date", "generation_timestamp").alias("forecast_date"))
        return store.join(newest, KEYS)
    newest = store.groupBy("product").agg(F.max("generation_timestamp").alias("generation_timestamp"))
    return store.join(newest, ["product", "generation_timestamp"])


def stored_metadata(store: DataFrame) -> DataFrame:
    return store.groupBy(*KEYS).agg(
        F.min("storage_timestamp").alias("storage_timestamp"),
        F.min("storage_version").alias("storage_version"),
        F.min("schema_version").alias("schema_version"),
        F.min("generation_timestamp").alias("generation_timestamp"),
        F.bool_or("is_fallback").alias("is_fallback"),
        F.count(F.lit(1)).alias("row_count"),
    )


def copy_to(store: DataFrame, source: DataFrame, as_fallback: bool | None = None) -> DataFrame:
    """Forecasts moved to another date: ``source`` has (product, forecast_date, target_date)."""
    moved = store.join(source, ["product", "forecast_date"])
    days = F.datediff("target_date", "forecast_date")
    shifted = moved.withColumn("timestamp", F.col("timestamp") + F.make_dt_interval(days))
    if as_fallback is not None:
        shifted = shifted.withColumn("is_fallback", F.lit(as_fallback))
    return shifted.withColumn("forecast_date", F.col("target_date")).drop("target_date")


# What Spark's writer replaces by % and two hexadecimal digits in the names of partition folders.
_ESCAPED = re.compile(r"[\x01-\x1f\x7f\"#%'*/:=?\\{\[\]^]")


def folder_name(value: str) -> str:
    """A partition value as it stands in the name of its folder."""
    return _ESCAPED.sub(lambda c: f"%{ord(c[0]):02X}", value)


def _delete_folders(spark: SparkSession, path: str, pairs: Iterable[tuple]) -> int:
    """Spark has no call that drops a folder, so the file system of the session is asked, some folders at a time."""
    gateway = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()

    def drop(pair: tuple) -> bool:
        date, product = pair
        folder = gateway.org.apache.hadoop.fs.Path(f"{path}/forecast_date={date}/product={folder_name(product)}")
        return bool(folder.getFileSystem(conf).delete(folder, True))

    with ThreadPoolExecutor(16) as pool:
        return sum(pool.map(drop, pairs))


def delete(spark: SparkSession, path: str, pairs: Sequence[tuple[str, str]]) -> int:
    """Remove whole (date, product) partitions: folders are dropped, no data is rewritten."""
    return _delete_folders(spark, path, pairs)


def expired(index: DataFrame, as_of: Column, days: int = config.RETENTION_DAYS) -> DataFrame:
    """Index rows older than the retention time."""
    if not isinstance(days, int) or days <= 0:
        raise ValueError("days must be a positive integer")
    return index.where(F.col("forecast_date") < F.date_sub(as_of.cast("date"), days))


def retained(index: DataFrame, as_of: Column, days: int = config.RETENTION_DAYS) -> DataFrame:
    if not isinstance(days, int) or days <= 0:
        raise ValueError("days must be a positive integer")
    return index.where(F.col("forecast_date") >= F.date_sub(as_of.cast("date"), days))


def clean(spark: SparkSession, path: str, as_of: Column, days: int = config.RETENTION_DAYS) -> int:
    """Drop expired partitions. Only partition values reach the driver: dates × products, no rows."""
    old = expired(read(spark, path).select(*KEYS).distinct(), as_of, days)
    return _delete_folders(spark, path, [(r["forecast_date"], r["product"]) for r in old.toLocalIterator()])


# --- the index ---------------------------------------------------------------------------------


def index_of(store: DataFrame, with_paths: bool = False) -> DataFrame:
    """One row per (date, product), derived from the store."""
    first = F.min("timestamp")
    hours = F.timestamp_diff("HOUR", first, F.max("timestamp")) + 1
    rows = store.withColumn("_path", F.input_file_name() if with_paths else F.lit(None).cast("string"))
    return rows.groupBy(*KEYS).agg(
        first.alias("first_hour"),
        hours.alias("horizon_hours"),
        F.max("generation_timestamp").alias("generation_timestamp"),
        F.bool_or("is_fallback").alias("is_fallback"),
        F.count(F.lit(1)).alias("row_count"),
        F.min("_path").alias("file_path"),
    )


def upsert_index(index: DataFrame, added: DataFrame, ties: Sequence[str] = ()) -> DataFrame:
    """One row per (date, product): the newest generation wins."""
    both = topk.concat(index, added)
    rest = [c for c in both.columns if c not in KEYS]
    order = F.struct("generation_timestamp", *ties)
    newest = both.groupBy(*KEYS).agg(F.max_by(F.struct(*rest), order).alias("_r"))
    return newest.select(*KEYS, "_r.*")


PATH_PATTERN = r"(\d{4})/(\d{2})/(\d{2})_([A-Za-z]+)\.parquet$"


def parse_paths(paths: DataFrame, products: Sequence[str] | None = None) -> DataFrame:
    """Date and product read from file paths, and why a path is skipped."""
    part = lambda i: F.regexp_extract("file_path", PATH_PATTERN, i)
    day = F.try_to_timestamp(F.concat_ws("-", part(1), part(2), part(3)), F.lit("yyyy-MM-dd")).cast("date")
    named = F.col("file_path").rlike(PATH_PATTERN)
    known = part(4).isin(list(products or config.PRODUCTS))
    reason = F.when(~named, "bad name").when(~known, "unknown product").when(day.isNull(), "bad date")
    return paths.withColumns({"forecast_date": day, "product": part(4), "skipped": reason})


def rebuild_report(parsed: DataFrame) -> DataFrame:
    return parsed.agg(
        F.count(F.lit(1)).alias("found"),
        F.count_if(F.col("skipped").isNull()).alias("processed"),
        F.count_if(F.col("skipped") == "bad name").alias("bad_name"),
        F.count_if(F.col("skipped") == "unknown product").alias("unknown_product"),
        F.count_if(F.col("skipped") == "bad date").alias("bad_date"),
    )


def clean_index(index: DataFrame, present: DataFrame) -> DataFrame:
    """Entries whose data still exists."""
    return index.join(present.select(*KEYS).distinct(), KEYS, "left_semi")


def clean_report(index: DataFrame, present: DataFrame) -> DataFrame:
    marked = index.join(present.select(*KEYS).distinct().withColumn("_here", F.lit(True)), KEYS, "left")
    return marked.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("_here").isNull()).alias("removed"),
        F.count_if(F.col("_here")).alias("remaining"),
    )


def exists(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """Requested (date, product) pairs that are stored."""
    return wanted.join(index.select(*KEYS), KEYS, "left_semi")


def available_dates(index: DataFrame) -> DataFrame:
    return index.select("product", "forecast_date").distinct()


def statistics(index: DataFrame) -> DataFrame:
    """Entries, dates and newest generation: over all, per product and per fallback flag."""
    sets = [[], [F.col("product")], [F.col("is_fallback")]]
    return index.groupingSets(sets, "product", "is_fallback").agg(
        F.count(F.lit(1)).alias("entries"),
        F.min("forecast_date").alias("first_date"),
        F.max("forecast_date").alias("last_date"),
        F.max("generation_timestamp").alias("newest_generation"),
    )


def size_on_disk(spark: SparkSession, path: str) -> DataFrame:
    """Megabytes and files of the table, from the file listing; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    wanted = files.select("path", "length").where(F.col("path").endswith(".parquet"))
    return wanted.agg(F.count(F.lit(1)).alias("files"), (F.sum("length") / 1048576).alias("size_mb"))


# --- export ------------------------------------------------------------------------------------

# Column headings of an export.
DISPLAY_NAMES = {
    "timestamp": "Forecast Time",
    "product": "Product",
    "point_forecast": "Forecast Value",
    "lower_bound": "Lower Bound",
    "upper_bound": "Upper Bound",
    "is_fallback": "Is Fallback Forecast",
    "generation_timestamp": "Generated At",
}


def export_rows(df: DataFrame, with_samples: bool = False) -> DataFrame:
    """Rows as exported: unit added, display names, times as text.

    Rows are not sorted here: exports are written in parallel and sorted within each file.
    """
    unit = lookup({row[0]: row[2] for row in config.PRODUCT_ATTRIBUTES}, F.col("product"), config.DEFAULT_UNIT)
    rows = df.withColumn("unit", unit)
    kept = [c for c in rows.columns if with_samples or c != "samples"]
    text = {
        c: F.coalesce(F.date_format(c, "yyyy-MM-dd HH:mm"), F.lit("")) for c in ("timestamp", "generation_timestamp")
    }
    return rows.select(*[text.get(c, F.col(c)).alias(DISPLAY_NAMES.get(c, c)) for c in kept])


def export_csv(df: DataFrame, path: str) -> None:
    rows = export_rows(df).repartitionByRange("Forecast Time", "Product").sortWithinPartitions("Forecast Time", "Product")
    rows.write.mode("overwrite").option("header", True).csv(path)


def export_json(df: DataFrame, path: str) -> None:
    rows = export_rows(df, with_samples=True).repartitionByRange("Forecast Time", "Product")
    rows.sortWithinPartitions("Forecast Time", "Product").write.mode("overwrite").json(path)


def export_range(store: DataFrame, path: str, start: str, end: str, product: str | None = None, kind: str = "csv") -> None:
    rows = read_range(store, start, end, product).drop(*validate.STORED_FIELDS)
    (export_csv if kind == "csv" else export_json)(rows, path)

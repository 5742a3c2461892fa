"""Reading feeds of hourly records with fixed schemas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricecast import config, schemas
from pricecast.operators import align, normalize, validate
from pricecast.sources.scratch import Settle, as_is, settle


def read(spark: SparkSession, path: str, schema: T.StructType, kind: str = "parquet") -> DataFrame:
    """Parquet, CSV with header, or JSON records; the schema is never inferred."""
    if kind == "csv":
        return spark.read.schema(schema).option("header", True).csv(path)
    return spark.read.schema(schema).format(kind).load(path)


CORRUPT = "_corrupt_record"
REJECTED = ["reason", "record", "file", "block_start"]


def read_records(
    spark: SparkSession, path: str, schema: T.StructType, kind: str, header: bool = True
) -> tuple[DataFrame, DataFrame]:
    """(records, rejected) of CSV or JSON Lines files.

    A line that does not parse, lacks fields, has too many or holds a value of another type is a rejected row: why, the
    line as it stands in the file, the file, and where in the file the block begins that a task read it from. Records
    come with ``file``. Nothing is lost: each line of the files is in one of the two frames. The lines are parsed once, with
    all columns (a parser that skips columns does not see what is wrong with them), into a table in the shared folder.
    """
    if kind not in ("csv", "json"):
        raise ValueError(f"unknown kind of text feed: {kind}")
    reader = spark.read.schema(T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())]))
    reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    if kind == "csv":
        reader = reader.option("header", header)
    lines = reader.format(kind).load(path).select(
        *schema.names, CORRUPT, F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block_start")
    )
    lines = settle(lines)
    broken = lines.where(F.col(CORRUPT).isNotNull())
    rejected = broken.select(F.lit("malformed record").alias("reason"), F.col(CORRUPT).alias("record"), "file", "block_start")
    return lines.where(F.col(CORRUPT).isNull()).drop(CORRUPT, "block_start"), rejected


def read_clean(
    spark: SparkSession,
    path: str,
    feed: str,
    schema: T.StructType,
    kind: str,
    header: bool = True,
    products: Sequence[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Like ``read_records``, with the rules of the feed: cleaned records, and all rejected ones in one form.

    A record that parses but breaks a rule is kept as JSON of its fields.
    """
    records, malformed = read_records(spark, path, schema, kind, header)
    good, bad = normalize.split_records(records, feed, products)
    fields = [c for c in bad.columns if c not in ("reason", "file")]
    refused = bad.select("reason", F.to_json(F.struct(*fields)).alias("record"), "file", F.lit(None).cast("long").alias("block_start"))
    return good, malformed.unionByName(refused)


def open_envelope(text: DataFrame, schema: T.StructType, column: str = "value") -> DataFrame:
    """``{"data": [records]}`` documents, one per row → one row per record."""
    envelope = T.StructType([T.StructField("data", T.ArrayType(schema))])
    return text.select(F.inline(F.from_json(column, envelope)["data"]))


def read_envelope(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Envelope files: each file is one document and is read by one task, so keep files small."""
    return open_envelope(spark.read.text(path, wholetext=True), schema)


def in_range(df: DataFrame, start: Column, end: Column, column: str = "timestamp") -> DataFrame:
    """Closed time range. The bounds are compared to the bare column, so Parquet can skip row groups."""
    return df.where(F.col(column).between(start, end))


def latest_snapshot(df: DataFrame, keys: Sequence[str], published: str = "published_at", ties: Sequence[str] = ()) -> DataFrame:
    """The newest row per key, as an aggregate that combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    order = F.struct(published, *ties)
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def horizon(
    df: DataFrame, starts: DataFrame, start: str, keys: Sequence[str] = (), hours: int = config.HORIZON_HOURS
) -> tuple[DataFrame, DataFrame]:
    """(feed rows of [start, start + hours), expected hours that are missing), for each row of ``starts``."""
    expected = align.hour_grid(starts, start, hours)
    columns = [*keys, "timestamp"]
    found = expected.join(df, columns)
    return found, expected.join(df.select(*columns), columns, "left_anti")


def collect(
    load: DataFrame, prices: DataFrame, generation: DataFrame, as_of: Column | None = None, settle: Settle = as_is
) -> tuple[dict[str, DataFrame], DataFrame]:
    """The three feeds cleaned, and the violations found in them."""
    clean = {
        "load": settle(normalize.normalize(load, "load")),
        "price": settle(normalize.normalize(prices, "price")),
        "generation": settle(normalize.normalize(generation, "generation")),
    }
    return clean, validate.all_feeds(clean["load"], clean["price"], clean["generation"], as_of)


FEED_SCHEMAS = schemas.FEEDS

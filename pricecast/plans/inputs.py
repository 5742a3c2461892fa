"""The given tables seen as market data. Each property has a SQL twin in ``views``."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricecast.sources.scratch import settle


PRODUCTS = ["DALMP", "RTLMP", "RegUp", "RegDown", "RRS"]
FUELS = ["wind", "solar", "gas", "coal", "nuclear"]
KINDS = ["purchase", "view", "click", "signup", "error"]
SAMPLES = 64


def _named(column: str, names: list[str]) -> Column:
    out = None
    for kind, name in list(zip(KINDS, names))[:-1]:
        test = F.col(column) == kind
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(names[-1])


def hours(n: int) -> Column:
    return F.expr(f"interval {n} hours")


class Inputs:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self._kept: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def kept(self, name: str) -> DataFrame:
        """A view that a query reads several times: computed once, as a table in the shared folder."""
        if name not in self._kept:
            self._kept[name] = settle(getattr(self, name))
        return self._kept[name]

    @cached_property
    def ticks(self) -> DataFrame:
        ts = F.col("ts").cast("timestamp")
        return self.table("events").select(
            "event_id",
            ts.alias("ts"),
            "user_id",
            F.col("value").alias("price"),
            _named("event_type", PRODUCTS).alias("product"),
            _named("event_type", FUELS).alias("fuel_type"),
            F.concat(F.lit("HB_"), F.col("user_id") % 3).alias("node"),
            F.date_trunc("hour", ts).alias("timestamp"),
        )

    @cached_property
    def hourly(self) -> DataFrame:
        return self.ticks.groupBy("product", "timestamp").agg(F.round(F.avg("price"), 12).alias("price"))

    @cached_property
    def by_region(self) -> DataFrame:
        # nation and region are fixed-size dimensions; customer joins on its key.
        place = (
            self.table("customer")
            .join(self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(F.col("c_custkey").alias("user_id"), F.col("r_name").alias("region"))
        )
        return self.ticks.join(place, "user_id")

    @cached_property
    def load(self) -> DataFrame:
        return self.by_region.groupBy("region", "timestamp").agg(F.round(F.sum("price"), 2).alias("load_mw"))

    @cached_property
    def system_load(self) -> DataFrame:
        return self.ticks.groupBy("timestamp").agg(F.round(F.sum("price"), 2).alias("load_mw"))

    @cached_property
    def generation(self) -> DataFrame:
        return self.by_region.groupBy("region", "fuel_type", "timestamp").agg(
            F.round(F.sum("price"), 2).alias("generation_mw")
        )

    @cached_property
    def system_generation(self) -> DataFrame:
        """One to three times the ticks of the hour, so that generation does not follow the load."""
        made = self.ticks.groupBy("fuel_type", "timestamp").agg(F.round(F.sum("price"), 2).alias("_sum"))
        times = 1 + (F.hour("timestamp") + F.length("fuel_type")) % 3
        return made.select("fuel_type", "timestamp", (F.col("_sum") * times).alias("generation_mw"))

    @cached_property
    def pairs(self) -> DataFrame:
        """Actual price against the price a day earlier as forecast."""
        earlier = self.kept("hourly").select(
            "product", (F.col("timestamp") + hours(24)).alias("timestamp"), F.col("price").alias("forecast")
        )
        actual = self.kept("hourly").withColumnRenamed("price", "actual")
        return actual.join(earlier, ["product", "timestamp"])

    def _sampled(self, offset: Column) -> DataFrame:
        names = [*PRODUCTS, "NSRS"]
        product = F.element_at(F.array(*[F.lit(p) for p in names]), (F.col("label") % 6 + 1).cast("int"))
        base = F.lit("2024-01-01 00:00:00").cast("timestamp")
        rows = self.table("embeddings").select(
            "vec_id",
            (base + F.make_dt_interval(F.lit(0), offset.cast("int"))).alias("timestamp"),
            product.alias("product"),
            F.transform("embedding", lambda x: F.lit(30.0) + x.cast("double") * 60.0).alias("samples"),
        )
        total = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x)
        return rows.withColumns(
            {
                "point_forecast": F.round(total / F.size("samples"), 12),
                "generation_timestamp": F.date_trunc("day", "timestamp") - hours(17),
                "is_fallback": F.col("vec_id") % 7 == 0,
            }
        )

    @cached_property
    def sampled(self) -> DataFrame:
        """Forecast rows with samples, one hour each."""
        return self._sampled(F.col("vec_id"))

    @cached_property
    def copies(self) -> DataFrame:
        """Several sampled forecasts per product and hour."""
        return self._sampled(F.col("vec_id") % 24)

    @cached_property
    def shown(self) -> DataFrame:
        """Display rows: the range of an hour's ticks as bounds."""
        return self.ticks.groupBy("product", "timestamp").agg(
            F.round(F.avg("price"), 12).alias("point_forecast"),
            F.min("price").alias("lower_bound"),
            F.max("price").alias("upper_bound"),
            F.bool_or(F.col("event_id") % 50 == 0).alias("is_fallback"),
        )

    @cached_property
    def stored(self) -> DataFrame:
        """Stored forecasts: display rows under the date of their hours."""
        return self.shown.withColumns(
            {
                "forecast_date": F.to_date("timestamp"),
                "generation_timestamp": F.date_trunc("day", "timestamp") - hours(17),
            }
        )

    @cached_property
    def entries(self) -> DataFrame:
        """Index entries as they arrive: many per date and product."""
        day = F.col("timestamp")
        path = F.concat(
            F.lit("forecasts/"), F.date_format(day, "yyyy/MM/dd"), F.lit("_"), F.col("product"), F.lit(".parquet")
        )
        broken = (
            F.when(F.col("event_id") % 11 == 0, F.concat(F.lit("forecasts/tmp_"), F.col("event_id").cast("string")))
            .when(F.col("event_id") % 13 == 0, F.regexp_replace(path, "_[A-Za-z]+", "_Other"))
            .when(F.col("event_id") % 17 == 0, F.regexp_replace(path, r"/\d\d/", "/13/"))
            .otherwise(path)
        )
        return self.ticks.select(
            F.to_date("timestamp").alias("forecast_date"),
            "product",
            F.col("ts").alias("generation_timestamp"),
            "event_id",
            broken.alias("file_path"),
            (F.col("event_id") % 7 == 0).alias("is_fallback"),
        )

    @cached_property
    def raw_prices(self) -> DataFrame:
        """Ticks as text, with values, times and products that do not parse."""
        e = F.col("event_id")
        return self.ticks.select(
            F.when(e % 83 == 0, "soon").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("Timestamp"),
            F.when(e % 89 == 0, "Unknown").otherwise(F.lower("product")).alias("Product"),
            F.when(e % 97 == 0, "n/a").otherwise(F.format_string("%.2f", "price")).alias("Price"),
            F.lower("node").alias("Node"),
            e.alias("Event ID"),
        )

    @cached_property
    def raw_load(self) -> DataFrame:
        e = F.col("event_id")
        return self.by_region.select(
            F.when(e % 83 == 0, "soon").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("Timestamp"),
            F.when(e % 97 == 0, "n/a").when(e % 101 == 0, "-5.0").otherwise(F.format_string("%.2f", "price")).alias("Load MW"),
            F.when(e % 103 == 0, "").otherwise(F.lower("region")).alias("Region"),
            e.alias("Event ID"),
        )

    @cached_property
    def raw_generation(self) -> DataFrame:
        e = F.col("event_id")
        return self.by_region.select(
            F.when(e % 83 == 0, "soon").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("Timestamp"),
            F.upper("fuel_type").alias("Fuel Type"),
            F.when(e % 97 == 0, "n/a").when(e % 101 == 0, "-5.0").otherwise(F.format_string("%.2f", "price")).alias("Generation MW"),
            F.lower("region").alias("Region"),
            e.alias("Event ID"),
        )

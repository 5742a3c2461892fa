"""Exact quantiles wherever the values lie."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricecast.functions import quantiles

NAN, INF = float("nan"), float("inf")
WANTED = {"low": 0.1, "mid": 0.5, "high": 0.9}


@pytest.mark.parametrize(
    "values",
    [
        [1.0, 2.0, 3.0, 4.0, NAN],
        [NAN, NAN, 1.0],
        [-INF, 0.0, -0.0, 5.0, INF, INF],
        [7.0],
        list(np.random.default_rng(1).standard_cauchy(500)),
        list(1.7e9 + np.random.default_rng(2).random(500) * 1e-3),
    ],
)
def test_quantiles_equal_spark_percentile(spark, values):
    df = spark.createDataFrame([("k", float(v)) for v in values] + [("other", 1.0), ("k", None)], "key string, x double")
    got = quantiles.exact_quantiles(df, ["key"], "x", WANTED).where("key = 'k'").first()
    want = df.where("key = 'k'").agg(*[F.percentile("x", q).alias(n) for n, q in WANTED.items()]).first()
    for n in WANTED:
        assert got[n] == pytest.approx(want[n], rel=1e-12, nan_ok=True)


@pytest.mark.parametrize("expr", ["rand(3) * 1e-5", "1.7e9 + rand(3) * 20000", "exp(20 * rand(3))", "-rand(3)"])
def test_no_bucket_holds_more_than_a_small_share(spark, expr):
    values = spark.range(100_000).select(F.expr(expr).alias("_v"), F.lit("k").alias("key"))
    counted = values.groupBy("key", "_v").agg(F.count("*").alias("_n"))
    sizes = quantiles.bucketed(values, counted, ["key"], lambda d: d).groupBy("_bucket").count()
    assert sizes.agg(F.max("count")).first()[0] < 100_000 / 100

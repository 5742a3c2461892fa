"""Very large and very small vectors, very long texts, ids with several texts."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricecast.llm import near_dedup, nearest, surrogates


def true_distance(x, y):
    return math.dist(x, y)


@pytest.mark.parametrize("scale", [1e200, 1e-200, 1e300, 1e-300, 1.0])
def test_vectors_of_any_size(spark, scale):
    draw = np.random.default_rng(11)
    rows = [(i, [float(x) * scale for x in draw.standard_normal(5)]) for i in range(60)]
    rows += [(100 + i, [float(x) for x in draw.standard_normal(5)]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in nearest.nearest(df, F.col("vec_id") % 10 == 0, 4, query_block=5, candidate_block=30).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    for q, x in rows:
        if q % 10 == 0:
            want = sorted((true_distance(x, y), i) for i, y in rows if i != q)[:4]
            assert [s for _, s in got[q]] == [pytest.approx(d, rel=1e-12, abs=0) for d, _ in want]
            # Distances that differ in the last digit only may change places.
            assert len({i for i, _ in got[q]} & {i for _, i in want}) >= 3


def test_the_vectors_of_the_verdict(spark):
    df = spark.createDataFrame([(0, [1e200, 1.0]), (1, [2e200, 1.0]), (2, [-1e200, 3.0]), (3, [1.0, 2.0])], "vec_id long, embedding array<double>")
    got = [(r.vec_id, r.score) for r in nearest.nearest(df, F.col("vec_id") == 0, 3).orderBy("rank").collect()]
    assert got == [(1, pytest.approx(1e200)), (3, pytest.approx(1e200)), (2, pytest.approx(2e200))]


LONG = 200_000
ADVERSE = {
    "labels": "x@a" + ".a" * (LONG // 2),
    "local": "a." * (LONG // 2) + "@b.example.com",
    "no sign": "a." * (LONG // 2),
    "one label": "x@" + "a" * LONG + " end",
    "dashes": "x@a" + "-" * LONG,
    "iban": "DE12" + " ABCD" * (LONG // 5),
    "digits": "1" * LONG,
    "spaced digits": "1 " * (LONG // 2),
    "phones": "+1" + " 234" * (LONG // 4),
    "dots": "1." * (LONG // 2),
    "secret": "password=" + "x" * LONG,
    "hex": "ab" * (LONG // 2),
    "names": "Mr " + "Anna-" * (LONG // 5),
    "words": "Anna Maria " * (LONG // 11),
    "brackets": "(" * LONG,
}


@pytest.mark.parametrize("kind", ADVERSE)
def test_very_long_adverse_texts(spark, kind):
    df = spark.createDataFrame([(1, ADVERSE[kind] + " write to jo.doe@mail.example.org now")], "doc_id long, text string")
    began = time.time()
    (row,) = surrogates.pseudonymised(df, "key").collect()
    assert row.n_entities >= 1 and "jo.doe@mail.example.org" not in row.text and row.text.endswith(" now")
    assert time.time() - began < 60

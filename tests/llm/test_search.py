"""Operators that compare documents or vectors: near duplicates, nearest vectors, components."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricecast.llm import near_dedup, nearest
from pricecast.llm.components import components
from tests.llm.conftest import prose


def shingle_set(text, size=2):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    size = min(size, len(words))
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def brute_components(rows, size=2, percent=80):
    sets = {i: shingle_set(t, size) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {i: root(i) for i in ids}, {i: len(s) for i, s in sets.items()}


def edited(text, changes, seed):
    draw = random.Random(seed)
    words = text.split()
    for _ in range(changes):
        words[draw.randrange(len(words))] = f"new{draw.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def copies():
    """A star of near copies, chains at the threshold, exact copies, short and empty texts, unrelated texts."""
    rows, base = [], prose(11, 100)
    rows += [(i, edited(base, i % 6, i)) for i in range(60)]
    chain = prose(12, 100)
    for i in range(60, 80):
        rows.append((i, chain))
        chain = edited(chain, 5, i)
    rows += [(i, prose(13, 40)) for i in range(80, 95)]
    rows += [(95, "one"), (96, "ONE"), (97, "two words"), (98, ""), (99, None), (100, " \t"), (101, "two  Words")]
    rows += [(i, prose(i, 50)) for i in range(102, 150)]
    return rows


@pytest.mark.parametrize("settings", [near_dedup.Settings(shingle=2), near_dedup.Settings(shingle=2, leaf=4, hub_sample=8, hubs=2, hub_every=2, depth=4)])
def test_components_equal_brute_force(spark, copies, settings):
    want, sizes = brute_components(copies)
    got = near_dedup.deduplicated(spark.createDataFrame(copies, "doc_id long, text string"), settings).collect()
    assert len(got) == len(copies)
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.n_shingles for r in got} == sizes
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_on_awkward_and_empty_tables(awkward, no_docs):
    got = near_dedup.deduplicated(awkward).collect()
    assert len(got) == 13
    kept = {r.doc_id: r.kept for r in got if r.doc_id is not None}
    assert kept == {i: i not in (2, 3) for i in range(1, 11)}
    assert all(r.kept and r.component_id is None for r in got if r.doc_id is None)
    assert near_dedup.deduplicated(no_docs).count() == 0


def test_star_contraction(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 199), (199, 200)]
    got = {r.id: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {199: 199, 200: 199}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_nearest(rows, queries, k):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, x in good:
        if q in queries:
            found = sorted((math.dist(x, y), i) for i, y in good if i != q and len(y) == len(x))
            out[q] = [(i, pytest.approx(d)) for d, i in found[:k]]
    return out


def test_nearest_equals_brute_force(spark):
    draw = np.random.default_rng(5)
    same = [float(x) for x in draw.standard_normal(8).astype("f4")]
    rows = [(i, [float(x) for x in draw.standard_normal(8).astype("f4")]) for i in range(150)]
    rows += [(i, same) for i in range(200, 240)]  # ties
    rows += [(300, [0.0] * 8), (301, None), (302, []), (303, [None] + [1.0] * 7), (304, [math.nan] + [1.0] * 7), (305, [math.inf] + [1.0] * 7)]
    rows += [(400, [1.0, 2.0]), (401, [2.0, 1.0]), (None, same), (402, [1e-30] * 8), (403, [1e30] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    got = {}
    for r in nearest.nearest(df, F.col("vec_id") % 10 == 0, 5, query_block=7, candidate_block=20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    floats = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    want = brute_nearest(floats, set(range(0, 500, 10)), 5)
    assert got == want
    assert len(got[400]) == 1
    assert nearest.nearest(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0

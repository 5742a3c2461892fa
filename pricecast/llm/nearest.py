"""Nearest neighbours by a block matrix join with int8 products.

Queries and candidates are dealt into blocks; every (query block, candidate block) pair is one tile. In a tile the
vectors are quantised to int8, one product of two int8 matrices gives all distances, and the quantisation errors of
both sides bound how far each of them can be off (triangle inequality); a power of two per tile keeps the squares of
very large and very small components within a double. Only pairs whose lower bound does not exceed
the k-th smallest upper bound of their query survive; they are computed again from the original vectors in
double precision, and the k best of the tile go on. The tiles' heaps are merged by a limit inside each map task and
one by query. The result is exact: no pair is left out that could be among the k nearest, ties included.

Memory in a task is one tile: ``query_block`` and ``candidate_block`` rows. The shuffle carries each candidate once
per query block and each query once per candidate block. Both numbers of blocks follow from counts.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no part; vectors are
compared with those of the same length only. A row with the query's own id is not a candidate. Repeated candidate
rows are candidates each; a repeated query id is one query,
by its smallest vector. Null ids take no part. Ties go to the smaller id. With fewer than k candidates all are
returned. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RESULT = "query_id long, vec_id long, score double"
SLACK = 1e-6
"""Relative room for the rounding of the bounds themselves."""
SMALLEST = 1e-140
"""Room, in parts of the largest component of a tile, for squares too small for a double."""


def usable(vector: Column) -> Column:
    return (
        vector.isNotNull()
        & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
        & F.exists(vector, lambda x: x != 0)
    )


def quantised(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, the scale of each vector, and the norm of what the codes leave out."""
    scale = np.abs(v).max(axis=1) / 127.0
    scale[scale == 0] = 1.0  # only where the largest component is below what a double can divide
    codes = np.rint(v / scale[:, None]).astype(np.int8)
    left_out = np.sqrt(((v - codes * scale[:, None]) ** 2).sum(axis=1))
    return codes, scale, left_out


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of row pairs, the squares added in the order of the components.

    Where these leave the range of a double, components are first brought near one by a power of two.
    """
    total = np.zeros(len(x))
    with np.errstate(over="ignore", invalid="ignore"):
        for i in range(x.shape[1]):
            total += (x[:, i] - y[:, i]) ** 2
    out = np.sqrt(total)
    beyond = np.flatnonzero(~(total < 1e300) | ((total < 1e-250) & (x != y).any(axis=1)))
    if len(beyond):
        a, b = x[beyond], y[beyond]
        power = np.frexp(np.maximum(np.abs(a), np.abs(b)).max(axis=1))[1] + 1
        a, b = (np.ldexp(v, -power[:, None]) for v in (a, b))
        # Tiny differences of large vectors: once more, by the size of the difference.
        gap = a - b
        size = np.frexp(np.abs(gap).max(axis=1))[1]
        with np.errstate(over="ignore"):
            out[beyond] = np.ldexp(np.sqrt((np.ldexp(gap, -size[:, None]) ** 2).sum(axis=1)), size + power)
    return out


def tile(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one tile: query ids, candidate ids and distances of the k nearest of each query."""
    # Bounds are worked out with the largest component of the tile near one, so that no square overflows.
    power = -int(np.frexp(max(np.abs(q).max(), np.abs(c).max()))[1])
    qc, qs, qe = quantised(np.ldexp(q, power))
    cc, cs, ce = quantised(np.ldexp(c, power))
    # Products of int8 codes are whole numbers; this type holds their sums without rounding.
    exact = np.float32 if q.shape[1] * 127 * 127 < 2**24 else np.float64
    out: tuple[list, list, list] = ([], [], [])
    qn, cn = (qs**2) * (qc.astype(np.int64) ** 2).sum(1), (cs**2) * (cc.astype(np.int64) ** 2).sum(1)
    right = np.ascontiguousarray(cc.astype(exact).T)
    for at in range(0, len(q), 256):
        part = slice(at, at + 256)
        product = (qc[part].astype(exact) @ right).astype(np.float64)
        near = qn[part, None] + cn[None, :] - 2 * (qs[part, None] * cs[None, :]) * product
        scale = qn[part, None] + cn[None, :]
        near = np.sqrt(np.maximum(near, 0))
        room = qe[part, None] + ce[None, :] + SLACK * np.sqrt(scale) + SMALLEST
        own = qid[part, None] == cid[None, :]
        high = np.where(own, np.inf, near + room)
        bound = np.partition(high, k - 1, axis=1)[:, k - 1] if high.shape[1] > k else np.full(len(high), np.inf)
        i, j = np.nonzero((near - room <= bound[:, None]) & ~own)
        for first in range(0, len(i), 65536):
            a, b = i[first : first + 65536], j[first : first + 65536]
            out[0].append(a + at)
            out[1].append(b)
            out[2].append(distances(q[part][a], c[b]))
    if not out[0]:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    i, j, d = (np.concatenate(x) for x in out)
    order = np.lexsort((cid[j], d, i))
    i, j, d = i[order], j[order], d[order]
    starts = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
    rank = np.arange(len(i)) - np.repeat(starts, np.diff(np.r_[starts, len(i)]))
    best = rank < k
    return qid[i[best]], cid[j[best]], d[best]


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat if isinstance(flat, pa.Array) else pa.concat_arrays(flat.chunks)
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    query_block: int = 1024,
    candidate_block: int = 4096,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows at the smallest Euclidean distance from each query."""
    given = vectors.select(
        F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), is_query.alias("asked")
    ).where(F.col("id").isNotNull() & usable(F.col("v")))
    size = F.size("v").alias("dims")
    asked = given.where("asked").groupBy("id").agg(F.min("v").alias("v")).select("id", "v", size)
    counts = vectors.select(F.count("*"), F.count(F.when(is_query, 1))).first()
    candidate_blocks = max(1, math.ceil(counts[0] / candidate_block))
    query_blocks = max(1, math.ceil(counts[1] / query_block))

    def block(n: int) -> Column:
        return F.pmod(F.xxhash64("id"), F.lit(n))

    def numbers(n: int) -> Column:
        return F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))

    left = asked.select("id", "v", "dims", block(query_blocks).alias("q"), F.explode(numbers(candidate_blocks)).alias("c"))
    right = given.select("id", "v", size, F.explode(numbers(query_blocks)).alias("q"), block(candidate_blocks).alias("c"))

    def tiles(x: pa.Table, y: pa.Table) -> pa.Table:
        if not x.num_rows or not y.num_rows:
            empty = np.empty(0, np.int64)
            found = (empty, empty, np.empty(0))
        else:
            found = tile(x["id"].to_numpy(), matrix(x["v"]), y["id"].to_numpy(), matrix(y["v"]), k)
        return pa.table({"query_id": found[0], "vec_id": found[1], "score": found[2]})

    met = left.groupBy("dims", "q", "c").cogroup(right.groupBy("dims", "q", "c")).applyInArrow(tiles, RESULT)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

"""Small systems of normal equations solved inside a row, by folds over arrays.

Matrices are arrays of rows. Rank is judged on correlations: a column whose variance, after what the columns
before it explain, is at most a tolerance counts as a combination of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricecast.functions.arrays import bound

VECTOR, MATRIX = "array<double>", "array<array<double>>"
# Below this share of a column's variance, rounding errors decide.
RANK_TOLERANCE = 1e-10


def numbers(n: Column) -> Column:
    """0 .. n - 1, for n of at least 1."""
    return F.sequence(F.lit(0), n - 1)


def cell(matrix: Column, i: Column, j: Column) -> Column:
    return F.get(F.get(matrix, i), j)


def dot(a: Column, b: Column) -> Column:
    """Sum of products, as far as the shorter array goes."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def unpacked(upper: Column, n: int) -> Column:
    """The symmetric n × n matrix of an upper triangle in rows."""

    def at(i: Column, j: Column) -> Column:
        low, high = F.least(i, j), F.greatest(i, j)
        return F.get(upper, (low * (2 * n - 1 - low) / 2 + high).cast("int"))

    every = numbers(F.lit(n))
    return F.transform(every, lambda i: F.transform(every, lambda j: at(i, j)))


def cholesky(matrix: Column, k: int) -> Column:
    """Rows of the lower factor; a dependent column has a zero on the diagonal and below it."""

    def row(rows: Column, i: Column) -> Column:
        def entry(own: Column, j: Column) -> Column:
            pivot = cell(rows, j, j)
            left = cell(matrix, i, j) - dot(own, F.slice(F.get(rows, j), F.lit(1), F.size(own)))
            return F.concat(own, F.array(F.when(pivot > 0, left / pivot).otherwise(0.0)))

        before = F.when(i > 0, numbers(F.greatest(i, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        own = F.aggregate(before, F.array().cast(VECTOR), entry)

        def closed(r: Column) -> Column:
            left = cell(matrix, i, i) - dot(r, r)
            return F.concat(r, F.array(F.when(left > RANK_TOLERANCE, F.sqrt(left)).otherwise(0.0)))

        return bound(own, closed)

    return F.aggregate(numbers(F.lit(k)), F.array().cast(MATRIX), lambda rows, i: F.concat(rows, F.array(row(rows, i))))


def substituted(factor: Column, right: Column, k: int) -> Column:
    """Solution of L Lᵀ x = right; zero where the diagonal is zero."""

    def forth(z: Column, j: Column) -> Column:
        pivot = cell(factor, j, j)
        left = F.get(right, j) - dot(z, F.get(factor, j))
        return F.concat(z, F.array(F.when(pivot > 0, left / pivot).otherwise(0.0)))

    def back(z: Column) -> Column:
        def step(x: Column, i: Column) -> Column:
            """``x`` holds the entries after i, the last one first."""
            pivot = cell(factor, i, i)
            below = F.reverse(F.transform(F.slice(factor, i + 2, F.lit(k)), lambda r: F.get(r, i)))
            return F.concat(x, F.array(F.when(pivot > 0, (F.get(z, i) - dot(x, below)) / pivot).otherwise(0.0)))

        return F.reverse(F.aggregate(F.reverse(numbers(F.lit(k))), F.array().cast(VECTOR), step))

    return bound(F.aggregate(numbers(F.lit(k)), F.array().cast(VECTOR), forth), back)


def scaled(matrix: Column, use: Callable[[Column, Column], Column], k: int) -> Column:
    """``use(roots of the diagonal, matrix of correlations)``; an empty row and column where the diagonal is zero."""

    def over(roots: Column) -> Column:
        def entry(i: Column, j: Column) -> Column:
            size = F.get(roots, i) * F.get(roots, j)
            return F.when(size > 0, cell(matrix, i, j) / size).otherwise(0.0)

        every = numbers(F.lit(k))
        return bound(F.transform(every, lambda i: F.transform(every, lambda j: entry(i, j))), lambda r: use(roots, r))

    return bound(F.transform(numbers(F.lit(k)), lambda i: F.sqrt(F.greatest(cell(matrix, i, i), F.lit(0.0)))), over)


def quotients(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.when(y > 0, x / y).otherwise(0.0))


def slopes(covariances: Column, k: int) -> Column:
    """Least squares of the last of k + 1 columns on the others, from their covariance matrix.

    Where columns depend on each other, the solution of least norm: with B the columns that are kept and C the
    combinations of them that make up all columns, it is Cᵀ (C Cᵀ)⁻¹ times the solution for B alone.
    """
    every = numbers(F.lit(k))

    def solved(roots: Column, correlations: Column) -> Column:
        right = quotients(F.transform(every, lambda i: cell(covariances, i, F.lit(k))), roots)

        def with_factor(factor: Column) -> Column:
            def finished(plain: Column) -> Column:
                whole = F.forall(every, lambda i: cell(factor, i, i) > 0)
                return F.when(whole, plain).otherwise(least_norm(roots, correlations, factor, plain, k))

            return bound(quotients(substituted(factor, right, k), roots), finished)

        return bound(cholesky(correlations, k), with_factor)

    return scaled(covariances, solved, k)


def least_norm(roots: Column, correlations: Column, factor: Column, plain: Column, k: int) -> Column:
    every = numbers(F.lit(k))

    def column(j: Column) -> Column:
        """How column j is made of those kept, in the units of the data."""
        made = substituted(factor, F.get(correlations, j), k)
        kept = F.transform(every, lambda i: F.when(i == j, 1.0).otherwise(0.0))
        return F.when(cell(factor, j, j) > 0, kept).otherwise(
            F.transform(quotients(made, roots), lambda x: x * F.get(roots, j))
        )

    def from_columns(c: Column) -> Column:
        """``c`` has a row per column of the data: its share of each one kept."""
        products = F.transform(every, lambda a: F.transform(every, lambda b: dot(F.transform(c, lambda r: F.get(r, a)), F.transform(c, lambda r: F.get(r, b)))))

        def weighted(sizes: Column, normal: Column) -> Column:
            inner = bound(cholesky(normal, k), lambda l: quotients(substituted(l, quotients(plain, sizes), k), sizes))
            return bound(inner, lambda d: F.transform(c, lambda r: dot(r, d)))

        return bound(products, lambda p: scaled(p, weighted, k))

    return bound(F.transform(every, column), from_columns)

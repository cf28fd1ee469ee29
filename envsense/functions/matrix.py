"""Small matrices as array columns of rows (array<array<double>>), and vectors as arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import let


def literal(rows) -> Column:
    return F.array(*(F.array(*(F.lit(float(v)) for v in row)) for row in rows))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def transpose(a: Column, columns: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(columns - 1)), lambda k: F.transform(a, lambda row: F.get(row, k)))


def times_transposed(a: Column, b: Column) -> Column:
    """a times the transpose of b: all dot products of their rows."""
    return F.transform(a, lambda x: F.transform(b, lambda y: dot(x, y)))


def product(a: Column, b: Column, columns: int) -> Column:
    """a times b, which has ``columns`` columns."""
    return let(transpose(b, columns), lambda t: times_transposed(a, t))


def apply(a: Column, v: Column) -> Column:
    """a times the vector v."""
    return F.transform(a, lambda row: dot(row, v))


def combined(a: Column, b: Column, sign: int = 1) -> Column:
    """a + sign b, of matrices."""
    return F.zip_with(a, b, lambda x, y: F.zip_with(x, y, lambda u, v: u + F.lit(float(sign)) * v))


def added(a: Column, b: Column, sign: int = 1) -> Column:
    """a + sign b, of vectors."""
    return F.zip_with(a, b, lambda u, v: u + F.lit(float(sign)) * v)


def identity(n: int) -> list[list[float]]:
    return [[float(i == k) for k in range(n)] for i in range(n)]


def trace(a: Column) -> Column:
    return F.aggregate(F.transform(a, lambda row, k: F.get(row, k)), F.lit(0.0), lambda s, v: s + v)


def cofactors(a: Column, n: int) -> Column:
    """The inverse of a matrix of one to three rows by its cofactors."""
    at = lambda m, i, k: F.get(F.get(m, F.lit(i % n)), F.lit(k % n))
    if n == 1:
        return F.array(F.array(F.try_divide(F.lit(1.0), at(a, 0, 0))))
    if n == 2:
        swapped = lambda m, d: F.array(F.array(F.try_divide(at(m, 1, 1), d), F.try_divide(-at(m, 0, 1), d)), F.array(F.try_divide(-at(m, 1, 0), d), F.try_divide(at(m, 0, 0), d)))
        return let(a, lambda m: let(at(m, 0, 0) * at(m, 1, 1) - at(m, 0, 1) * at(m, 1, 0), lambda d: swapped(m, d)))
    minor = lambda m, i, k: at(m, i + 1, k + 1) * at(m, i + 2, k + 2) - at(m, i + 1, k + 2) * at(m, i + 2, k + 1)
    rows = lambda m: F.array(*(F.array(*(minor(m, k, i) for k in range(3))) for i in range(3)))
    divided = lambda m, c: let(sum((at(m, 0, k) * at(c, k, 0) for k in range(1, 3)), at(m, 0, 0) * at(c, 0, 0)), lambda d: F.transform(c, lambda row: F.transform(row, lambda v: F.try_divide(v, d))))
    return let(a, lambda m: let(rows(m), lambda c: divided(m, c)))


def inverse(a: Column, n: int) -> Column:
    """The inverse, beyond three rows by elimination with row pivots; of a singular matrix it has nulls."""
    if n <= 3:
        return cofactors(a, n)
    wide = F.zip_with(a, literal(identity(n)), lambda x, y: F.concat(x, y))

    def step(rows, k):
        column = F.transform(rows, lambda row, i: F.when(i >= k, F.abs(F.get(row, k))).otherwise(F.lit(-1.0)))
        pivot = let(column, lambda c: F.array_position(c, F.array_max(c)).cast("int") - 1)

        def eliminated(at):
            head = let(F.get(rows, at), lambda row: F.transform(row, lambda v: F.try_divide(v, F.get(row, k))))
            rest = lambda top: F.transform(rows, lambda row, i: F.when(i == k, top).otherwise(let(F.when(i == at, F.get(rows, k)).otherwise(row), lambda r: F.zip_with(r, top, lambda v, t: v - F.get(r, k) * t))))
            return let(head, rest)

        return let(pivot, eliminated)

    done = F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), wide, step)
    return F.transform(done, lambda row: F.slice(row, n + 1, F.lit(n)))

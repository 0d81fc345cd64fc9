"""Check digits as native expressions. All take digits only (see digits)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digits(c: Column) -> Column:
    return F.regexp_replace(c, r"[^0-9]", "")


def _weighted(d: Column, weights: list[int]) -> Column:
    w = F.array(*[F.lit(x) for x in weights])
    nums = F.transform(F.sequence(F.lit(1), F.lit(len(weights))), lambda i: F.substring(d, i, F.lit(1)).try_cast("int") * F.element_at(w, i))
    return F.aggregate(nums, F.lit(0), lambda a, x: a + x)


def _check(d: Column, weights: list[int]) -> Column:
    r = _weighted(d, weights) % 11
    return F.when(r < 2, 0).otherwise(11 - r)


def _same(d: Column, n: int) -> Column:
    return d == F.repeat(F.substring(d, 1, 1), F.lit(n))


def cpf(d: Column) -> Column:
    first, second = list(range(10, 1, -1)), list(range(11, 1, -1))
    ok = (_check(d, first) == F.substring(d, 10, 1).try_cast("int")) & (_check(d, second) == F.substring(d, 11, 1).try_cast("int"))
    return F.coalesce((F.length(d) == 11) & ~_same(d, 11) & ok, F.lit(False))


def cnpj(d: Column) -> Column:
    first = [5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2]
    ok = (_check(d, first) == F.substring(d, 13, 1).try_cast("int")) & (_check(d, [6, *first]) == F.substring(d, 14, 1).try_cast("int"))
    return F.coalesce((F.length(d) == 14) & ~_same(d, 14) & ok, F.lit(False))


def luhn(d: Column) -> Column:
    """13 to 19 digits; every second from the right is doubled, nines cast out."""
    nums = F.transform(F.split(F.reverse(d), ""), lambda x, i: F.when(i % 2 == 0, x.try_cast("int")).otherwise(x.try_cast("int") * 2 - F.when(x.try_cast("int") > 4, 9).otherwise(0)))
    total = F.aggregate(nums, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))
    return F.coalesce((F.length(d) >= 13) & (F.length(d) <= 19) & (total % 10 == 0), F.lit(False))

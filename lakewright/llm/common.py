"""Helpers that the operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Java and RE2 form of the separators between words: space, tab, LF, VT, FF, CR.
BLANK = r"[\x20\x09-\x0D]"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often use mentions it."""
    return F.transform(F.array(value), use)[0]


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only these columns, so that further columns of the caller can't clash with ours."""
    return df.select(*[F.col(n).alias(n) for n in names])


def same(a: DataFrame, b: DataFrame, *keys: str) -> Column:
    """Null-safe equality on all keys, usable as an equi-join condition."""
    out = F.lit(True)
    for k in keys:
        out = out & a[k].eqNullSafe(b[k])
    return out

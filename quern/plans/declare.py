"""How a plan declares itself as a query, with its SQL."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of a table reader `t(name)` as a query, with its SQL."""

    def put(f: Callable[[Callable[[str], DataFrame]], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: table(spark, sf_dir, name))
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


def hashed(c: str) -> Column:
    """An aggregate that tells sets of distinct values apart in any order: the sum of 48 bits of their hashes; null for none.

    A sum beyond a long goes round, modulo 2^64, as some 65,000 values are enough for that.
    """
    total = F.sum(F.conv(F.substring(F.md5(F.col(c).cast("string")), 1, 12), 16, 10).cast("decimal(20,0)"))
    half, whole = F.lit(Decimal(1 << 63)), F.lit(Decimal(1 << 64))
    return (F.pmod(total + half, whole) - half).cast("long")

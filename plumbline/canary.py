"""Leakage canaries: signals that have seen the answer, and a test of feature builders by truncation."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.panel import calendar, finite, shift_days


def peek(actual: DataFrame, entry: str = "peek") -> DataFrame:
    """A signal that is the answer."""
    return actual.select(F.lit(entry).alias("entry"), "date", "ticker", F.col("target").alias("value"))


def off_by_one(signals: DataFrame) -> DataFrame:
    """A signal dated one calendar day too early: each date shows the next day's value."""
    return shift_days(signals, calendar(signals), -1)


def hindsight_universe(actual: DataFrame, n: int) -> DataFrame:
    """(ticker, total) of the n names with the highest total return, of equal ones the first by name."""
    grown = actual.groupBy("ticker").agg((F.product(1 + F.coalesce("target", F.lit(0.0)))).alias("total"))
    return grown.orderBy(F.desc("total"), "ticker").limit(n)


def truncation_test(build: Callable[[DataFrame], DataFrame], prices: DataFrame, cutoff: str, keys: Sequence[str] = ("date", "ticker"), atol: float = 1e-9) -> DataFrame:
    """(column, rows, max_diff, leaks) of every number column that ``build`` makes.

    ``build`` runs on all prices and on those up to the cutoff; where both have a row they
    must agree. A column named target looks ahead by definition and is never a leak.
    """
    day = F.lit(cutoff).cast("date")
    full = build(prices).where(F.col(keys[0]) <= day)
    short = build(prices.where(F.col(keys[0]) <= day))
    columns = [c for c, t in full.dtypes if c not in keys and t in ("double", "float", "int", "bigint")]
    a = full.select(*keys, *(F.col(c).cast("double").alias(f"_a_{c}") for c in columns))
    b = short.select(*keys, *(F.col(c).cast("double").alias(f"_b_{c}") for c in columns))
    gap = lambda c: F.when(finite(F.col(f"_a_{c}")) & finite(F.col(f"_b_{c}")), F.abs(F.col(f"_a_{c}") - F.col(f"_b_{c}")))
    one = a.join(b, list(keys)).agg(F.count("*").alias("rows"), *(F.coalesce(F.max(gap(c)), F.lit(0.0)).alias(c) for c in columns))
    out = one.unpivot("rows", columns, "column", "max_diff")
    return out.select("column", "rows", "max_diff", ((F.col("column") != "target") & (F.col("max_diff") > atol)).alias("leaks"))

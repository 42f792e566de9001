"""Turnover, costs, net returns and statistics of sparse positions.

A dense matrix of dates x names is never built. Turnover is the difference from the previous
day, where absent means zero: a name's row is compared with its own previous row if that is
yesterday's, and a row after which the name is not held leaves an exit for the next day.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.sharpe import sharpe
from plumbline.operators.timeseries import TRADING_DAYS
from plumbline.panel import calendar

COST_BPS, BORROW_BPS, CAPITAL = 10.0, 50.0, 1_000_000.0
SERIES = ("gross", "turnover", "exposure", "gross_exposure", "short_exposure", "positions")


def padded_days(entries: DataFrame, actual: DataFrame) -> DataFrame:
    """(entry, date, ordinal): every entry on every day of the returns, so silent days are cash.

    The result is entries x days, one row for each row of the daily result.
    """
    days = calendar(actual).agg(F.array_sort(F.collect_list("date")).alias("_days"))
    return entries.select("entry").distinct().join(F.broadcast(days)).select("entry", F.posexplode("_days").alias("ordinal", "date"))


def shared_days(signals: DataFrame, actual: DataFrame) -> DataFrame:
    """(entry, date, ordinal): the days that both an entry and the returns have."""
    own = signals.select("entry", "date").distinct().join(F.broadcast(calendar(actual).select("date")), "date", "left_semi")
    return own.withColumn("ordinal", F.row_number().over(Window.partitionBy("entry").orderBy("date")) - 1)


def daily_books(positions: DataFrame, days: DataFrame) -> DataFrame:
    """(entry, date, ordinal) and SERIES for every row of ``days`` (entry, date, ordinal)."""
    held = positions.join(days, ["entry", "date"]).select("entry", "ticker", "ordinal", "weight", "target")
    w = Window.partitionBy("entry", "ticker").orderBy("ordinal")
    was = F.when(F.lag("ordinal").over(w) == F.col("ordinal") - 1, F.lag("weight").over(w)).otherwise(F.lit(0.0))
    leaves = F.coalesce(F.lead("ordinal").over(w) != F.col("ordinal") + 1, F.lit(True))
    rows = held.select("entry", "ordinal", "weight", "target", F.abs(F.col("weight") - was).alias("traded"), leaves.alias("leaves"))
    # The exit is a row of its own on the next day; past the last day it finds no day to stand on.
    stay = F.struct("ordinal", "weight", (F.col("weight") * F.col("target")).alias("gross"), "traded")
    exit_ = F.struct((F.col("ordinal") + 1).alias("ordinal"), F.lit(0.0).alias("weight"), F.lit(0.0).alias("gross"), F.abs("weight").alias("traded"))
    each = rows.select("entry", F.explode(F.when(F.col("leaves"), F.array(stay, exit_)).otherwise(F.array(stay))).alias("r")).select("entry", "r.*")
    per = each.groupBy("entry", "ordinal").agg(
        F.sum("gross").alias("gross"), F.sum("traded").alias("turnover"), F.sum("weight").alias("exposure"), F.sum(F.abs("weight")).alias("gross_exposure"),
        F.sum(F.greatest(-F.col("weight"), F.lit(0.0))).alias("short_exposure"), F.count_if(F.col("weight") != 0).alias("positions"),
    )
    zero = {c: F.coalesce(F.col(c), F.lit(0.0) if c != "positions" else F.lit(0)) for c in SERIES}
    return days.join(per, ["entry", "ordinal"], "left").select("entry", "date", "ordinal", *(zero[c].alias(c) for c in SERIES))


def charge(books: DataFrame, cost_bps: float | Column = COST_BPS, borrow_bps: float | Column = BORROW_BPS) -> DataFrame:
    """Adds borrow, cost (turnover and borrow together) and net."""
    per_year = float(TRADING_DAYS)
    cost_bps, borrow_bps = (c if isinstance(c, Column) else F.lit(float(c)) for c in (cost_bps, borrow_bps))
    borrow = F.col("short_exposure") * borrow_bps / 1e4 / per_year
    return books.withColumn("borrow", borrow).withColumn("cost", F.col("turnover") * cost_bps / 1e4 + F.col("borrow")).withColumn("net", F.col("gross") - F.col("cost"))


def curve(daily: DataFrame, capital: float = CAPITAL, keys: Sequence[str] = ("entry",), ret: str = "net") -> DataFrame:
    """Adds equity, the equity of the day before and drawdown from the highest equity so far."""
    w = Window.partitionBy(*keys).orderBy("ordinal")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    grown = daily.withColumn("equity", capital * F.product(1 + F.col(ret)).over(upto))
    return grown.withColumns({"equity_before": F.lag("equity", 1, capital).over(w), "drawdown": F.col("equity") / F.nullif(F.max("equity").over(upto), F.lit(0.0)) - 1})


def statistics(curved: DataFrame, capital: float = CAPITAL, keys: Sequence[str] = ("entry",)) -> DataFrame:
    """One row of statistics for each key, in one aggregation."""
    year = float(TRADING_DAYS)
    one = curved.groupBy(*keys).agg(
        F.count("*").alias("days"), (F.max_by("equity", "ordinal") / capital - 1).alias("total_return"), (F.stddev_samp("net") * year**0.5).alias("annualized_vol"),
        sharpe("net").alias("net_sharpe"), F.min("drawdown").alias("max_drawdown"), F.avg("exposure").alias("avg_exposure"), F.avg("gross_exposure").alias("avg_gross_exposure"),
        F.avg("short_exposure").alias("avg_short_exposure"), F.avg("positions").alias("avg_positions"), (F.sum("turnover") / (F.count("*") / year)).alias("annual_turnover"),
        F.sum(F.col("cost") * F.col("equity_before")).alias("total_costs"), F.sum(F.col("borrow") * F.col("equity_before")).alias("total_borrow"),
    )
    # A total loss has no root; the power of a negative base is no number.
    grown = F.when(F.col("total_return") >= -1, F.pow(1 + F.col("total_return"), year / F.col("days")) - 1)
    return one.withColumn("annualized_return", grown).withColumn("dollar_pnl", capital * F.col("total_return"))


def cost_grid(books: DataFrame, levels: Sequence[float] = (0, 5, 10, 15, 20, 25), borrow_bps: float = BORROW_BPS, keys: Sequence[str] = ("entry",)) -> DataFrame:
    """(keys, cost_bps, sharpe): net is linear in costs, so the books are made once and only their daily rows repeat."""
    each = books.withColumn("cost_bps", F.explode(F.array(*(F.lit(float(c)) for c in levels))))
    return charge(each, F.col("cost_bps"), borrow_bps).groupBy(*keys, "cost_bps").agg(sharpe("net").alias("sharpe"))


def bar_books(actual: DataFrame, entry: str = "always_long") -> DataFrame:
    """The books of holding every name equally on every day it has a return."""
    w = Window.partitionBy("date")
    every = actual.where("target is not null").select(F.lit(entry).alias("entry"), "date", "ticker", (F.lit(1.0) / F.count("*").over(w)).alias("weight"), "target")
    return daily_books(every, padded_days(every, actual))


def monthly_returns(daily: DataFrame, ret: str = "net", keys: Sequence[str] = ("entry",)) -> DataFrame:
    """(keys, month, ret): compounded by calendar month, up to the last; months without days are 0."""
    per = daily.groupBy(*keys, F.last_day("date").alias("month")).agg((F.product(1 + F.col(ret)) - 1).alias("ret"))
    months = F.sequence(F.trunc(F.min("month"), "month"), F.trunc(F.max("month"), "month"), F.expr("interval 1 month"))
    spine = per.groupBy(*keys).agg(months.alias("_m")).select(*keys, F.explode("_m").alias("_first")).select(*keys, F.last_day("_first").alias("month"))
    return spine.join(per, [*keys, "month"], "left").withColumn("ret", F.coalesce("ret", F.lit(0.0)))

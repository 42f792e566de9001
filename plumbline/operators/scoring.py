"""Scoring of entries against their bars, for all entries and windows in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.sharpe import normal_cdf, psr_argument, sharpe, sharpe_error
from plumbline.operators.backtest import BORROW_BPS, COST_BPS, charge, curve, daily_books, statistics
from plumbline.lineage import settled
from plumbline.operators.positions import refusals, require_contract, submitted_weights, weights_from_predictions
from plumbline.panel import window_rows

#: The windows of the board, both ends included.
WINDOWS = {"sealed_2022_2025": ("2022-01-01", "2025-12-31"), "post_cutoff_2026": ("2026-01-01", "2026-12-31")}
KEYS = ("window", "entry")
STRESSED_BORROW, STRESS_FROM = 500.0, 0.01
NEUTRAL_EXPOSURE, NEUTRAL_SHORT, LEAST_INVESTABLE_DAYS = 0.1, 0.05, 20


def book_of(signals: DataFrame, entries: DataFrame, actual: DataFrame) -> DataFrame:
    """Positions of all entries; ``entries`` is (entry, kind, rule, quantile), one row an entry.

    The number of entries is that of submitted files and no larger than their signals' files,
    so the broadcast is left to the planner, which knows their size.
    """
    tagged = signals.join(entries.select("entry", "kind", "rule", "quantile"), "entry")
    predicted = weights_from_predictions(tagged.where("kind = 'predictions'").select("entry", "date", "ticker", "value", "rule", "quantile"), actual, F.col("rule"), F.col("quantile"))
    given = submitted_weights(tagged.where("kind = 'weights'").select("entry", "date", "ticker", "value"), actual)
    return predicted.unionByName(given)


def window_calendar(actual: DataFrame, windows: dict[str, tuple[str, str]]) -> DataFrame:
    """(window, date, ordinal), the ordinal counted within the window."""
    days = window_rows(actual.select("date").distinct(), windows)
    return days.select("window", "date", (F.row_number().over(Window.partitionBy("window").orderBy("date")) - 1).alias("ordinal"))


def window_books(positions: DataFrame, signals: DataFrame, actual: DataFrame, windows: dict[str, tuple[str, str]]) -> DataFrame:
    """(window, entry, date, ordinal) and the daily books. An entry is scored in a window in which it has any signal, on all of its days."""
    days = window_calendar(actual, windows)
    present = window_rows(signals.select("entry", "date").distinct(), windows).select("window", "entry").distinct()
    spine = present.join(F.broadcast(days), "window")
    # The pair of window and entry is the unit whose books are kept apart.
    unit = F.concat_ws("\u0001", "window", "entry")
    inside = window_rows(positions, windows)
    books = daily_books(inside.select(unit.alias("entry"), "date", "ticker", "weight", "target"), spine.select(unit.alias("entry"), "date", "ordinal"))
    parts = F.split("entry", "\u0001")
    return books.withColumns({"window": parts[0], "entry": parts[1]})


def score(
    signals: DataFrame, entries: DataFrame, actual: DataFrame, windows: dict[str, tuple[str, str]], investable: DataFrame | None = None, cost_bps: float = COST_BPS, refused: str = "raise"
) -> tuple[DataFrame, DataFrame]:
    """(scores, daily) of all entries in all windows.

    Entries that break the contract (``positions.refusals``) raise ValueError, or are left out
    where ``refused`` is "leave out". Weights may be short here whatever their rule: it is the
    validator that faults those that did not ask for it. The daily rows are made once and settled; all statistics
    read those, a row for each entry and day.

    daily is (window, entry, date, ordinal, net, bar, ...), with bar 0 where a dollar-neutral
    book is held against cash. scores has the statistics, the bar used and its Sharpe ratio,
    the ratio at 0 and 20 bps, under stressed borrowing where a book is short, and the plain
    edge over the investable index where a book is not neutral and has 20 of its days.
    """
    if refused == "raise":
        require_contract(signals, entries, actual, allow_short=True)
    else:
        signals = signals.join(refusals(signals, entries, actual, allow_short=True).select("entry").distinct(), "entry", "left_anti")
    daily = settled(curve(charge(window_books(book_of(signals, entries, actual), signals, actual, windows), cost_bps), keys=KEYS))
    stats = statistics(daily, keys=KEYS).join(entries.select("entry", "kind", "rule"), "entry")
    neutral = (F.col("rule") == "long_short") | ((F.col("kind") == "weights") & (F.abs("avg_exposure") < NEUTRAL_EXPOSURE) & (F.col("avg_short_exposure") > NEUTRAL_SHORT))
    stats = stats.withColumn("bar_used", F.when(neutral, F.lit("cash")).otherwise(F.lit("universe")))
    # The bar trades as well, and starts anew in each window.
    always = window_rows(actual.where("target is not null"), windows)
    held = always.select(F.col("window").alias("entry"), "date", "ticker", (F.lit(1.0) / F.count("*").over(Window.partitionBy("window", "date"))).alias("weight"), "target")
    bar = charge(daily_books(held, window_calendar(actual, windows).select(F.col("window").alias("entry"), "date", "ordinal")), cost_bps).select(F.col("entry").alias("window"), "date", F.col("net").alias("_bar"))
    joined = daily.join(F.broadcast(bar), ["window", "date"], "left").join(stats.select("window", "entry", "bar_used", "avg_short_exposure"), [*KEYS])
    joined = joined.withColumn("bar", F.when(F.col("bar_used") == "cash", F.lit(0.0)).otherwise(F.coalesce("_bar", F.lit(0.0)))).drop("_bar")
    if investable is not None:
        joined = joined.join(F.broadcast(investable.select("date", F.col("ret").alias("investable"))), "date", "left")
    else:
        joined = joined.withColumn("investable", F.lit(None).cast("double"))
    at = lambda cost, borrow=BORROW_BPS: F.col("gross") - F.col("turnover") * (cost / 1e4) - F.col("short_exposure") * (borrow / 1e4 / 252)
    long_only = (F.col("bar_used") == "universe") & F.col("investable").isNotNull()
    extra = joined.groupBy(*KEYS).agg(
        sharpe("bar").alias("bar_sharpe"), sharpe(at(0)).alias("gross_sharpe"), sharpe(at(20)).alias("net_sharpe_20bps"),
        F.when(F.first("avg_short_exposure") > STRESS_FROM, sharpe(at(cost_bps, STRESSED_BORROW))).alias("net_sharpe_borrow_500bps"),
        F.count_if(long_only).alias("investable_days"), sharpe(F.when(long_only, F.col("investable"))).alias("_inv"), sharpe(F.when(long_only, F.col("net"))).alias("_own"),
        sharpe_error("net").alias("strategy_sharpe_se"), psr_argument("net").alias("_z"),
    )
    enough = F.col("investable_days") >= LEAST_INVESTABLE_DAYS
    extra = extra.withColumns({"investable_sharpe": F.when(enough, F.col("_inv")), "edge_vs_investable": F.when(enough, F.col("_own") - F.col("_inv")), "psr_vs_zero": normal_cdf("_z")}).drop("_inv", "_own", "_z")
    scores = stats.join(extra, [*KEYS]).withColumn("net_edge", F.col("net_sharpe") - F.col("bar_sharpe"))
    return scores, joined.drop("avg_short_exposure")


def pairs_of(daily: DataFrame, window: str, against: str = "bar") -> DataFrame:
    """(entry, ordinal, x, y) of one window, for the joint test."""
    rows = daily.where(F.col("window") == window)
    if against == "investable":
        rows = rows.where(F.col("investable").isNotNull() & (F.col("bar_used") == "universe"))
    return rows.select("entry", "ordinal", F.col("net").alias("x"), F.col(against).alias("y"))



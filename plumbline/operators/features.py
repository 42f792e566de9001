"""The feature panel: 17 trailing features and the next return of every name."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.timeseries import TRADING_DAYS, bollinger, change, oscillators, own, rolling, volume_z
from plumbline.panel import ratio

#: Tickers that are bars, not names of the universe.
BENCHMARKS = ("SPY", "QQQ", "RSP")
#: The features, in the order of the panel's columns.
FEATURES = ("ret_1d", "ret_5d", "ret_21d", "ret_63d", "vol_21d", "atr_14", "rsi_14", "macd_hist", "boll_pct_b", "boll_bw", "px_vs_sma10", "px_vs_sma50", "volume_z", "vix", "vix_chg_5d", "treasury_10y", "treasury_chg_21d")


def window_features() -> dict[str, Column]:
    """The features that window functions express; all share one partitioning and order."""
    b, bw = bollinger("close")
    return {
        **{f"ret_{k}d": change("close", k) for k in (1, 5, 21, 63)},
        "boll_pct_b": b,
        "boll_bw": bw,
        **{f"px_vs_sma{n}": ratio(F.col("close"), rolling("mean", "close", n)) - 1 for n in (10, 50)},
        "volume_z": volume_z("volume"),
    }


def stock_features(prices: DataFrame, smooth: bool = True) -> DataFrame:
    """(date, ticker), the 13 features of a name's own prices and target.

    One shuffle by ticker serves all windows; the recursive means take another, and are left
    out with ``smooth=False``.
    """
    w = prices.withColumns(window_features())
    w = w.withColumns({"vol_21d": rolling("std", "ret_1d", 21) * math.sqrt(TRADING_DAYS), "target": F.lead("ret_1d").over(own())})
    if not smooth:
        return w
    return oscillators(w)


def market_features(market: DataFrame) -> DataFrame:
    """(date, vix, vix_chg_5d, treasury_10y, treasury_chg_21d) over the market's own rows, one a day."""
    w = Window.orderBy("date")
    return market.select("date", "vix", (ratio(F.col("vix"), F.lag("vix", 5).over(w)) - 1).alias("vix_chg_5d"), "treasury_10y", (F.col("treasury_10y") - F.lag("treasury_10y", 21).over(w)).alias("treasury_chg_21d"))


def feature_panel(prices: DataFrame, market: DataFrame, tickers: list[str] | None = None) -> DataFrame:
    """(date, ticker, FEATURES, target) without rows where any of them is missing.

    The market has one row a day, which bounds what is broadcast.
    """
    own = prices.where(F.col("ticker").isin(tickers)) if tickers else prices.where(~F.col("ticker").isin(*BENCHMARKS))
    joined = stock_features(own).join(F.broadcast(market_features(market)), "date", "left")
    return joined.na.drop(subset=[*FEATURES, "target"]).select("date", "ticker", *FEATURES, "target")


def bar_returns_of(prices: DataFrame, bars: tuple[str, ...] = BENCHMARKS) -> DataFrame:
    """(date, bar, ret): each bar's next return, on its own days."""
    return prices.where(F.col("ticker").isin(*bars)).withColumn("ret", ratio(F.lead("close").over(own()), F.col("close")) - 1).where("ret is not null").select("date", F.col("ticker").alias("bar"), "ret")


def actual_returns(panel: DataFrame) -> DataFrame:
    return panel.select("date", "ticker", "target")



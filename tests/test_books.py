"""Positions, turnover, costs and statistics, as invariants and against wide pandas frames."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline import canary
from plumbline.operators import backtest as bt
from plumbline.operators import scoring
from plumbline.operators.positions import breaches, refusals, require_contract, submitted_weights, weights_from_predictions
from plumbline.panel import calendar

from .conftest import returns


def frame(spark, pdf, entry=None):
    df = spark.createDataFrame(pdf)
    return df.select(F.lit(entry).alias("entry"), *df.columns) if entry else df


def constant(actual, value=1.0, entry="e"):
    return actual.select(F.lit(entry).alias("entry"), "date", "ticker", F.lit(value).alias("value"))


def daily_of(positions, actual, entry="e", **kw):
    days = calendar(actual).select(F.lit(entry).alias("entry"), "date", "ordinal")
    return bt.curve(bt.charge(bt.daily_books(positions, days), **kw)).orderBy("ordinal").toPandas()


@pytest.fixture(scope="module")
def actual(spark):
    return frame(spark, returns(120, 8, 1)).persist()


def test_always_long_without_costs_is_the_mean_of_names(spark, actual):
    d = daily_of(weights_from_predictions(constant(actual), actual), actual, cost_bps=0, borrow_bps=0)
    wide = actual.toPandas().pivot(index="date", columns="ticker", values="target")
    assert np.allclose(d["net"], wide.mean(axis=1))
    assert d["turnover"].iloc[0] == pytest.approx(1) and d["turnover"].iloc[1:].abs().max() < 1e-12
    assert np.allclose(d["equity"], 1e6 * (1 + wide.mean(axis=1)).cumprod())


@pytest.mark.parametrize("rule", ["long_flat", "long_top", "long_short"])
def test_books_equal_a_dense_computation(spark, rule):
    a = returns(60, 20, 4)
    signal = returns(60, 20, 5).rename(columns={"target": "value"})
    signal.loc[::7, "value"] = np.nan
    a.loc[::11, "target"] = np.nan
    ours = daily_of(weights_from_predictions(frame(spark, signal, "e").withColumn("value", F.nanvl("value", F.lit(None))), frame(spark, a).withColumn("target", F.nanvl("target", F.lit(None))), rule), frame(spark, a))
    act = a.pivot(index="date", columns="ticker", values="target")
    v = signal.pivot(index="date", columns="ticker", values="value").where(act.notna())
    p = v.rank(axis=1, method="first").div(v.notna().sum(axis=1), axis=0)
    even = lambda m: m.div(m.sum(axis=1).replace(0, np.nan), axis=0).fillna(0.0)
    top, low = even((p > 0.9).astype(float)), even((p <= 0.1).astype(float))
    w = {"long_flat": even((v > 0).astype(float)), "long_top": top, "long_short": 0.5 * top - 0.5 * low}[rule]
    turnover = w.diff().abs().sum(axis=1)
    turnover.iloc[0] = w.iloc[0].abs().sum()
    short = -w.clip(upper=0).sum(axis=1)
    net = (w * act.fillna(0)).sum(axis=1) - turnover * 10 / 1e4 - short * 50 / 1e4 / 252
    assert np.allclose(ours["turnover"], turnover) and np.allclose(ours["short_exposure"], short) and np.allclose(ours["net"], net)
    assert np.allclose(ours["positions"], (w != 0).sum(axis=1))


def test_twenty_names_give_two_on_each_side_and_neutral_books(spark):
    a = frame(spark, returns(30, 20, 4))
    p = weights_from_predictions(a.select(F.lit("e").alias("entry"), "date", "ticker", F.col("target").alias("value")), a, "long_short").toPandas()
    by = p.groupby("date")["weight"]
    assert np.allclose(by.sum(), 0) and np.allclose(by.apply(lambda x: x.abs().sum()), 1)
    assert set(p.groupby("date")["weight"].apply(lambda x: (x > 0).sum())) == {2} == set(p.groupby("date")["weight"].apply(lambda x: (x < 0).sum()))


def test_borrowing_is_charged_on_shorts_only(spark, actual):
    half = submitted_weights(constant(actual.where("ticker = 'S00'"), -1.0), actual)
    d = daily_of(half, actual, cost_bps=0, borrow_bps=252 * 10)
    assert np.allclose(d["borrow"], 0.001)
    assert daily_of(weights_from_predictions(constant(actual), actual), actual)["borrow"].abs().max() == 0


def test_exit_and_reentry_are_charged(spark):
    days = [dt.date(2022, 1, d) for d in (3, 4, 5, 6)]
    a = spark.createDataFrame([(d, t, 0.0) for d in days for t in "AB"], "date date, ticker string, target double")
    w = spark.createDataFrame([("e", d, "A", 1.0) for d in (days[0], days[2])], "entry string, date date, ticker string, value double")
    d = daily_of(submitted_weights(w, a), a, cost_bps=0)
    assert list(d["turnover"]) == [1, 1, 1, 1] and list(d["positions"]) == [1, 0, 1, 0]


def test_last_day_leaves_no_exit_and_silence_is_cash(spark, actual):
    last = actual.agg(F.max("date")).first()[0]
    one = constant(actual.where((F.col("date") == F.lit(last)) & (F.col("ticker") == "S01")))
    d = daily_of(submitted_weights(one, actual), actual, cost_bps=0)
    assert d["turnover"].sum() == 1 and d["turnover"].iloc[-1] == 1 and (d["net"].iloc[:-1] == 0).all()


def test_name_without_return_is_not_held(spark):
    a = spark.createDataFrame([(dt.date(2022, 1, 3), "A", 0.1), (dt.date(2022, 1, 3), "B", None)], "date date, ticker string, target double")
    p = weights_from_predictions(constant(a), a).collect()
    assert [(x.ticker, x.weight) for x in p] == [("A", 1.0)]


def test_ties_go_by_ticker_and_empty_days_hold_nothing(spark):
    day = dt.date(2022, 1, 3)
    a = spark.createDataFrame([(day, f"T{k}", 0.0) for k in range(10)], "date date, ticker string, target double")
    p = weights_from_predictions(constant(a), a, "long_short").toPandas().set_index("ticker")["weight"]
    assert p.to_dict() == {"T9": 0.5, "T0": -0.5}
    assert weights_from_predictions(constant(a, None).withColumn("value", F.col("value").cast("double")), a).count() == 0
    assert weights_from_predictions(constant(a, -1.0), a).count() == 0


def test_breaches(spark, actual):
    found = lambda v, **kw: {x.reason for x in breaches(submitted_weights(constant(actual, v), actual), **kw).collect()}
    assert found(0.125) == set() and found(0.125 + 5e-8) == set()
    assert found(0.2) == {"gross exposure above one"}
    assert found(-0.1) == {"negative weights"} and found(-0.1, allow_short=True) == set()


def test_cost_grid_falls_with_costs_and_equals_separate_runs(spark, actual):
    signal = actual.select(F.lit("e").alias("entry"), "date", "ticker", F.sin(F.col("target") * 1e4).alias("value"))
    days = calendar(actual).select(F.lit("e").alias("entry"), "date", "ordinal")
    b = bt.daily_books(weights_from_predictions(signal, actual), days)
    grid = bt.cost_grid(b).orderBy("cost_bps").toPandas()["sharpe"]
    assert (grid.diff().dropna() < 0).all()
    assert bt.statistics(bt.curve(bt.charge(b, 15))).first()["net_sharpe"] == pytest.approx(grid[3])


def test_statistics_of_flat_returns_and_drawdown(spark):
    rows = [("e", dt.date(2022, 1, 3) + dt.timedelta(days=k), k, r, 0.0, 0.0, 0.0, 0.0, 0) for k, r in enumerate((0.1, -0.5, 0.0))]
    b = spark.createDataFrame(rows, "entry string, date date, ordinal int, gross double, turnover double, exposure double, gross_exposure double, short_exposure double, positions int")
    s = bt.statistics(bt.curve(bt.charge(b))).first()
    assert s["max_drawdown"] == pytest.approx(-0.5) and s["total_return"] == pytest.approx(-0.45) and s["days"] == 3
    flat = bt.statistics(bt.curve(bt.charge(b.withColumn("gross", F.lit(0.01))))).first()
    assert flat["net_sharpe"] == 0.0


def test_empty_month_is_zero(spark):
    d = spark.createDataFrame([("e", dt.date(2022, 1, 5), 0.1), ("e", dt.date(2022, 1, 6), 0.1), ("e", dt.date(2022, 3, 1), -0.2)], "entry string, date date, net double")
    got = [round(x.ret, 6) for x in bt.monthly_returns(d).orderBy("month").collect()]
    assert got == [0.21, 0.0, -0.2]


def test_peek_off_by_one_and_hindsight(spark, actual):
    sharpe = lambda s: bt.statistics(bt.curve(bt.charge(bt.daily_books(weights_from_predictions(s, actual), bt.shared_days(s, actual))))).first()["net_sharpe"]
    assert sharpe(canary.peek(actual)) > 5
    late = canary.off_by_one(actual.select(F.lit("e").alias("entry"), "date", "ticker", F.lag("target").over(Window.partitionBy("ticker").orderBy("date")).alias("value")))
    assert sharpe(late) > 5
    top = canary.hindsight_universe(actual, 3).toPandas()
    total = actual.toPandas().groupby("ticker")["target"].apply(lambda r: np.prod(1 + r)).sort_values(ascending=False)
    assert list(top["ticker"]) == list(total.index[:3])


def test_truncation_passes_trailing_and_fails_leaking_builders(spark):
    prices = frame(spark, returns(80, 3, 1).rename(columns={"target": "close"})).withColumn("close", 100 + F.col("close"))
    from plumbline.operators.timeseries import change, rolling

    trailing = lambda p: p.withColumn("f", rolling("mean", "close", 5)).withColumn("target", F.lead("close").over(Window.partitionBy("ticker").orderBy("date")))
    leaking = lambda p: p.withColumn("f", F.avg("close").over(Window.partitionBy("ticker"))).withColumn("g", change("close"))
    assert not any(x.leaks for x in canary.truncation_test(trailing, prices, "2022-03-01").collect())
    assert {x.column for x in canary.truncation_test(leaking, prices, "2022-03-01").collect() if x.leaks} == {"f"}


def test_all_entries_in_one_plan_equal_each_alone(spark, actual):
    a = actual.select(F.lit("a").alias("entry"), "date", "ticker", F.col("target").alias("value"))
    both = a.unionByName(a.select(F.lit("b").alias("entry"), "date", "ticker", -F.col("value")).toDF("entry", "date", "ticker", "value"))
    days = bt.padded_days(both, actual)
    together = bt.daily_books(weights_from_predictions(both, actual), days).where("entry = 'b'").orderBy("ordinal").toPandas()
    alone = bt.daily_books(weights_from_predictions(both.where("entry = 'b'"), actual), days.where("entry = 'b'")).orderBy("ordinal").toPandas()
    pd.testing.assert_frame_equal(together, alone)


ENTRIES = "entry string, kind string, rule string, quantile double"


def weights_entry(spark, rule="long_flat", kind="weights"):
    return spark.createDataFrame([("e", kind, rule, 0.1)], ENTRIES)


def reasons(spark, signals, actual, rule="long_flat", **kw):
    return {r.reason for r in refusals(signals, weights_entry(spark, rule), actual, **kw).collect()}


def test_weights_contract_is_enforced(spark, actual):
    assert reasons(spark, constant(actual, 0.5), actual) == {"gross exposure above one"}  # eight names, a sum of four
    assert reasons(spark, constant(actual, -0.1), actual) == {"negative weights"}
    assert reasons(spark, constant(actual, 0.125), actual) == set()
    for value in (0.5, -0.1):
        with pytest.raises(ValueError, match="refused"):
            require_contract(constant(actual, value), weights_entry(spark), actual)


def test_short_weights_need_permission_and_the_gross_cap_holds(spark):
    a = frame(spark, returns(60, 20, 4))
    short = constant(a, -0.02)
    assert reasons(spark, short, a) == {"negative weights"} and reasons(spark, short, a, allow_short=True) == reasons(spark, short, a, "long_short") == set()
    assert daily_of(submitted_weights(short, a), a)["short_exposure"].mean() == pytest.approx(0.4)
    assert reasons(spark, constant(a, -0.06), a, allow_short=True) == {"gross exposure above one"}


def test_only_held_names_count_and_predictions_are_free(spark, actual):
    silent = actual.withColumn("target", F.when(F.col("ticker") == "S00", F.col("target")))
    assert reasons(spark, constant(silent, 0.5), silent) == set()  # of eight names one has returns
    assert refusals(constant(actual, 9.0), weights_entry(spark, kind="predictions"), actual).count() == 0


def test_scores_refuse_leverage_and_rows_that_repeat(spark, actual):
    windows = {"w": ("2022-01-01", "2022-12-31")}
    fine, lever = constant(actual, 0.125), constant(actual, 0.625, "lever")
    entries = spark.createDataFrame([("e", "weights", "long_flat", 0.1), ("lever", "weights", "long_flat", 0.1)], ENTRIES)
    with pytest.raises(ValueError, match="lever: gross"):
        scoring.score(fine.unionByName(lever), entries, actual, windows)
    scores, _ = scoring.score(fine.unionByName(lever), entries, actual, windows, refused="leave out")
    assert [r.entry for r in scores.collect()] == ["e"]
    with pytest.raises(ValueError, match="duplicate rows"):
        scoring.score(fine.unionByName(fine.limit(1)), weights_entry(spark), actual, windows)
    with pytest.raises(ValueError, match="more than one return"):
        scoring.score(fine, weights_entry(spark), actual.unionByName(actual.limit(1)), windows)


def test_short_weights_are_held_against_cash_when_neutral(spark):
    a = frame(spark, returns(60, 20, 4))
    sides = a.select(F.lit("e").alias("entry"), "date", "ticker", F.when(F.col("ticker") < "S10", 0.05).otherwise(-0.05).alias("value"))
    scores, _ = scoring.score(sides, weights_entry(spark), a, {"w": ("2022-01-01", "2022-12-31")})
    one = scores.first()
    assert one["bar_used"] == "cash" and one["avg_short_exposure"] == pytest.approx(0.5) and one["net_sharpe_borrow_500bps"] < one["net_sharpe"]

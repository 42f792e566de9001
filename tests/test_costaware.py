"""Training on net returns: gradients, ranges of days, and what the training does."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.functions.net_sharpe import Adam, Rows, Shape, Sums, range_sums
from plumbline.operators import backtest as bt
from plumbline.plans import costaware

from .conftest import returns


def rows(days=40, names=7, width=3, seed=0, missing=0.2):
    rng = np.random.default_rng(seed)
    day, name = (a.ravel() for a in np.meshgrid(np.arange(days), np.arange(names), indexing="ij"))
    keep = (rng.random(len(day)) >= missing) | (name == 0)
    day, name = day[keep], name[keep]
    x = rng.normal(size=(len(day), width))
    return Rows(day, name, np.bincount(day)[day].astype(float), 0.01 * x[:, 0] + rng.normal(0, 0.01, len(day)), x)


def plain_returns(theta, shape, r, first, last, cost):
    """A dense matrix of weights, the textbook way."""
    from plumbline.functions.net_sharpe import scores

    w = np.zeros((r.day.max() + 1, r.name.max() + 1))
    y = np.zeros_like(w)
    w[r.day, r.name] = 1 / (1 + np.exp(-scores(theta, shape, r.x)[0])) / r.names
    y[r.day, r.name] = r.target
    w, y = w[first:last], y[first:last]
    return (w * y).sum(axis=1) - cost * np.abs(np.diff(w, axis=0, prepend=np.zeros((1, w.shape[1])))).sum(axis=1)


@pytest.mark.parametrize("hidden", [(), (5,), (6, 4)])
def test_the_gradient_is_that_of_finite_differences(hidden):
    r, shape = rows(), Shape(3, hidden)
    theta = shape.start(3)
    assert len(theta) == shape.size
    sums = range_sums(theta, shape, r, 0, 40, 0.002, opening=True)
    plain = plain_returns(theta, shape, r, 0, 40, 0.002)
    assert sums.ratio() == pytest.approx(plain.mean() / (plain.std(ddof=1) + 1e-8) * np.sqrt(252))
    got, h = sums.loss_gradient(), 1e-6
    for k in range(len(theta)):
        e = np.eye(len(theta))[k] * h
        up, down = (range_sums(theta + s * e, shape, r, 0, 40, 0.002, opening=True, gradient=False).ratio() for s in (1, -1))
        assert got[k] == pytest.approx(-(up - down) / (2 * h), rel=1e-5, abs=1e-6)


def test_ranges_with_the_day_before_add_up_to_the_whole():
    r, shape = rows(days=30), Shape(3, (4,), dropout=0.5)
    theta = shape.start(1)
    for draw in (None, (7, 3)):
        whole = range_sums(theta, shape, r, 4, 27, 0.001, opening=True, draw=draw).flat()
        parts = sum(range_sums(theta, shape, r, a, b, 0.001, opening=a == 4, draw=draw).flat() for a, b in ((4, 9), (9, 10), (10, 27)))
        assert np.allclose(whole, parts, rtol=1e-12, atol=1e-15)


def test_a_name_that_leaves_is_sold():
    r = Rows(np.array([0, 0, 1, 2]), np.array([0, 1, 0, 0]), np.array([2.0, 2.0, 1.0, 1.0]), np.zeros(4), np.zeros((4, 1)))
    sums = range_sums(np.zeros(2), Shape(1, ()), r, 0, 3, 1.0, opening=True)
    # Weights 1/4, 1/4 | 1/2 | 1/2: bought 1/2, then 1/4 bought and 1/4 sold, then nothing.
    assert sums.turnover == pytest.approx(1.0) and sums.r == pytest.approx(-1.0)


def test_degenerate_sums_have_no_gradient():
    assert not Sums.of(np.zeros(4 + 2 * 3)).loss_gradient().any() and Sums.of(np.zeros(10)).ratio() == 0
    theta, adam = Adam(rate=0.1).moved(np.zeros(2), np.array([3.0, -4.0]))
    assert np.allclose(theta, [-0.1, 0.1], atol=1e-6) and adam.step == 1


def panel(spark, days=90, names=12, seed=5):
    """Targets that the first feature tells; it is new every day, so using it turns the book over."""
    p = returns(days, names, seed)
    rng = np.random.default_rng(seed)
    p["x1"], p["x2"] = rng.normal(size=len(p)), rng.normal(size=len(p))
    p["target"] = p["target"] + 0.004 * p["x1"]
    p.loc[rng.random(len(p)) < 0.05, "x2"] = np.nan
    return spark.createDataFrame(p)


def test_the_same_model_from_any_partitioning(spark):
    p, got = panel(spark), []
    for parts in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got.append(costaware.fit_net(p, ["x1", "x2"], "2022-04-01", "2022-04-20", shape=Shape(2, (4,), 0.2), epochs=2, steps=2, window=30, range_rows=40 if parts == "7" else 100_000))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert np.allclose(got[0].theta, got[1].theta, rtol=1e-9, atol=1e-12) and got[0].validation == pytest.approx(got[1].validation)


def test_sums_equal_the_books(spark):
    """The ratio and turnover that training sees are those of the backtest."""
    p = panel(spark, 40, 5).where("not isnan(x2)")
    shape = Shape(2, (3,), 0.0)
    mean, scale = costaware.standard(p, ["x1", "x2"])
    model = costaware.NetModel(shape, shape.start(2), ("x1", "x2"), mean, scale)
    ranges = costaware.day_ranges(p, ["x1", "x2"], mean, scale, range_rows=20)
    assert ranges.length == 4 and ranges.rows.count() == 10
    sums = costaware.summed(ranges, model.theta, shape, 10.0)
    w = costaware.net_weights(model, p)
    daily = bt.charge(bt.daily_books(w.withColumnRenamed("value", "weight").join(p.select("date", "ticker", "target"), ["date", "ticker"]), bt.padded_days(w, p)), 10.0, 0.0).toPandas()
    assert sums.days == len(daily) == 40 and sums.turnover == pytest.approx(daily["turnover"].sum())
    assert sums.ratio() == pytest.approx(daily["net"].mean() / daily["net"].std() * np.sqrt(252), rel=1e-5)


def test_training_finds_the_signal_and_costs_hold_it_back(spark):
    p = panel(spark)
    last = p.agg(F.max("date")).first()[0]
    out = {}
    for bps in (0.0, 100.0):
        m = costaware.fit_net(p, ["x1", "x2"], "2022-04-10", "2022-04-25", cost_bps=bps, shape=Shape(2, (), 0.0), epochs=1, steps=25, window=None, rate=0.2)
        w = costaware.net_weights(m, p.where("date > '2022-04-25'")).toPandas()
        assert w["date"].min() > pd.Timestamp("2022-04-25").date() and w["date"].max() == last
        assert (w["value"] >= 0).all() and (w.groupby("date")["value"].sum() <= 1 + 1e-12).all()
        out[bps] = w.pivot(index="date", columns="ticker", values="value").fillna(0).diff().abs().sum(axis=1).mean()
        assert m.theta[0] > 0 or bps
    assert out[100.0] < 0.85 * out[0.0]


def test_an_empty_panel_gives_no_weights(spark):
    p = panel(spark).where("false")
    m = costaware.fit_net(p, ["x1", "x2"], "2022-04-10", "2022-04-25", shape=Shape(2, (3,)), epochs=1, steps=1)
    assert costaware.net_weights(m, p).count() == 0

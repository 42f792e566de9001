"""Reshapes, trailing operators against pandas, and membership."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from plumbline import panel
from plumbline.operators import crosssection as xs
from plumbline.operators import timeseries as ts
from plumbline.operators import universe as un
from plumbline.operators.features import FEATURES, feature_panel, stock_features

D = lambda m, d: dt.date(2022, m, d)


@pytest.fixture(scope="module")
def prices(spark):
    rng = np.random.default_rng(7)
    days = pd.bdate_range("2022-01-03", periods=120).date
    frames = []
    for t in ("A", "B", "FLAT", "UP"):
        close = {"FLAT": np.full(120, 50.0), "UP": np.arange(120) + 100.0}.get(t, 100 * np.cumprod(1 + rng.normal(0, 0.02, 120)))
        frames.append(pd.DataFrame({"date": days, "ticker": t, "close": close, "high": close * 1.01, "low": close * 0.99, "volume": rng.integers(100, 999, 120).astype(float)}))
    return spark.createDataFrame(pd.concat(frames)).persist()


def test_smoothed_means_equal_pandas(spark, prices):
    got = ts.atr(ts.macd_histogram(ts.rsi(prices))).toPandas().sort_values(["ticker", "date"])
    for t, g in got.groupby("ticker"):
        c, h, low = g["close"], g["high"], g["low"]
        step = c.diff()
        rs = step.clip(lower=0).ewm(alpha=1 / 14, adjust=False).mean() / (-step.clip(upper=0)).ewm(alpha=1 / 14, adjust=False).mean().replace(0, np.nan)
        assert np.allclose(g["rsi_14"], (100 - 100 / (1 + rs)).fillna(50))
        macd = c.ewm(span=12, adjust=False).mean() - c.ewm(span=26, adjust=False).mean()
        assert np.allclose(g["macd_hist"], (macd - macd.ewm(span=9, adjust=False).mean()) / c)
        tr = pd.concat([h - low, (h - c.shift()).abs(), (low - c.shift()).abs()], axis=1).max(axis=1)
        assert np.allclose(g["atr_14"], tr.ewm(alpha=1 / 14, adjust=False).mean() / c)
        if t in ("FLAT", "UP"):
            assert (g["rsi_14"] == 50).all()


def test_features(spark, prices):
    f = stock_features(prices).toPandas().sort_values(["ticker", "date"])
    a = f[f["ticker"] == "A"]
    assert np.allclose(a["vol_21d"].dropna(), (a["close"].pct_change().rolling(21).std() * np.sqrt(252)).dropna())
    assert np.allclose(a["boll_pct_b"].dropna(), ((a["close"] - a["close"].rolling(20).mean()) / (4 * a["close"].rolling(20).std()) + 0.5).dropna())
    assert np.allclose(a["target"].dropna(), a["close"].pct_change().shift(-1).dropna())
    assert f[f["ticker"] == "FLAT"]["boll_pct_b"].isna().all()
    market = prices.where("ticker = 'A'").select("date", F.col("close").alias("vix"), F.col("volume").alias("treasury_10y"))
    p = feature_panel(prices, market).toPandas()
    assert list(p.columns) == ["date", "ticker", *FEATURES, "target"] and not p.isna().any().any() and set(p["ticker"]) == {"A", "B", "UP"}


def test_holds(spark):
    days = pd.bdate_range("2022-01-03", periods=50).date
    v = pd.Series(np.arange(50.0))
    v[0] = np.nan
    dense = spark.createDataFrame(pd.DataFrame({"date": days, "ordinal": range(50), "ticker": "A", "value": v})).withColumn("value", panel.number(F.col("value")))
    m = ts.monthly_hold(dense).orderBy("date").toPandas()
    first = pd.Series(v.values, index=pd.to_datetime(days)).groupby(lambda d: (d.year, d.month)).head(1)
    assert np.allclose(m["value"].fillna(-1), first.reindex(pd.to_datetime(days)).ffill().fillna(-1))
    h = ts.hold_between(dense, 5).orderBy("date").toPandas()["value"]
    assert np.isnan(h[0]) and h[5] == h[9] == 5 and h[10] == 10
    assert ts.hold_between(dense, 1) is dense


def test_shift_is_by_calendar_not_by_row(spark):
    rows = [(D(1, 3), "A", 1.0), (D(1, 4), "B", 2.0), (D(1, 5), "A", 3.0)]
    df = spark.createDataFrame(rows, "date date, ticker string, value double")
    got = {(x.date, x.ticker): x.value for x in panel.shift_days(df, panel.calendar(df), 1).collect()}
    assert got == {(D(1, 4), "A"): 1.0, (D(1, 5), "B"): 2.0}


def test_reshapes(spark):
    rows = [(D(1, 3), "A", 1.0), (D(1, 4), "B", None), (D(1, 4), "C", float("nan")), (D(1, 4), "D", float("inf"))]
    df = spark.createDataFrame(rows, "date date, ticker string, value double")
    assert panel.only_finite(df).count() == 1
    dense = panel.densify(df, panel.calendar(df), values=("value",), fill=0.0)
    assert dense.count() == 8 and dense.where("value is null").count() == 0
    clean = panel.conform(df.withColumnRenamed("date", "Date"), panel.SIGNAL)
    assert clean.where("ticker = 'C' and value is null").count() == 1
    wide = panel.to_wide(df.where("ticker <> 'C'"), ["A", "B", "D"])
    assert panel.to_long(wide).count() == 2 and panel.to_long(wide, keep_null=True).count() == 6
    assert panel.duplicate_keys(df.union(df), "date", "ticker").first()["duplicates"] == 4
    assert panel.every_kth_day(panel.calendar(df), 2).count() == 1
    w = panel.window_rows(df, {"x": ("2022-01-03", "2022-01-03"), "y": ("2022-01-01", "2022-01-31")})
    assert sorted((x.window, x["count"]) for x in w.groupBy("window").count().collect()) == [("x", 1), ("y", 4)]


def test_ranks_equal_pandas(spark):
    v = pd.Series([3.0, 1.0, 3.0, np.nan, 2.0])
    df = spark.createDataFrame(pd.DataFrame({"date": D(1, 3), "ticker": list("EDCBA"), "value": v})).withColumn("value", panel.number(F.col("value")))
    got = df.select("ticker", xs.rank_first("value").alias("f"), xs.rank_average("value").alias("a")).toPandas().set_index("ticker")
    s = pd.Series(v.values, index=list("EDCBA")).sort_index()
    assert np.allclose(got["f"].sort_index().fillna(-1), s.rank(method="first", pct=True).fillna(-1))
    assert np.allclose(got["a"].sort_index().fillna(-1), (s.rank(pct=True) - 0.5).fillna(-1))


def test_information_coefficient_skips_thin_and_constant_days(spark):
    rows = [(D(1, 3), f"T{k}", float(k), float(k)) for k in range(12)] + [(D(1, 4), f"T{k}", 1.0, float(k)) for k in range(12)] + [(D(1, 5), "T1", 1.0, 1.0)]
    df = spark.createDataFrame(rows, "date date, ticker string, value double, target double").withColumn("entry", F.lit("e"))
    got = xs.information_coefficient(df.drop("target"), df.drop("value", "entry")).first()
    assert got["days"] == 1 and got["ic"] == pytest.approx(1.0)
    early = xs.early_information_coefficient(df.drop("target"), df.drop("value", "entry"), least_names=10).first()
    assert early["ic"] == 0.0 and early["share"] == pytest.approx(1 / 3)


@pytest.fixture(scope="module")
def membership(spark):
    rows = [(D(1, 10), ["A", "B"]), (D(2, 10), ["A", "C"]), (D(3, 10), ["A", "B"])]
    return spark.createDataFrame(rows, "date date, tickers array<string>")


def test_as_of(spark, membership):
    dates = spark.createDataFrame([(D(1, 10),), (D(2, 9),), (D(2, 10),), (D(9, 9),)], "date date")
    got = {x.date: sorted(x.tickers) for x in un.members_on(membership, dates).collect()}
    assert got == {D(1, 10): ["A", "B"], D(2, 9): ["A", "B"], D(2, 10): ["A", "C"], D(9, 9): ["A", "B"]}
    with pytest.raises(PySparkException, match="no membership"):
        un.require_covered(un.members_on(membership, spark.createDataFrame([(D(1, 1),)], "date date"))).collect()


def test_stays_mask_and_sets(spark, membership):
    stays = sorted((x.ticker, x.valid_from) for x in un.stays(membership).collect())
    assert stays == [("A", D(1, 10)), ("B", D(1, 10)), ("B", D(3, 10)), ("C", D(2, 10))]
    names = spark.createDataFrame([("A",), ("B",), ("X",)], "ticker string")
    dates = spark.createDataFrame([(D(1, 20),), (D(2, 20),)], "date date")
    got = {(x.ticker, x.date.month): x.member for x in un.mask(membership, dates, names).collect()}
    assert got == {("A", 1): True, ("A", 2): True, ("B", 1): True, ("B", 2): False, ("X", 1): False, ("X", 2): False}
    assert [x.ticker for x in un.continuous(membership, "2022-01-15", "2022-03-15").collect()] == ["A"]
    assert sorted(x.ticker for x in un.ever_members(membership, "2022-01-15", "2022-03-15").collect()) == ["A", "B", "C"]
    assert un.first_last(membership).first()["last_date"] == D(3, 10)


def test_coverage_report(spark, membership):
    spans = spark.createDataFrame([("B", D(1, 10), D(2, 9)), ("A", D(1, 10), None), ("Z", D(1, 1), D(2, 1))], "ticker string, start_date date, end_date date")
    got = un.coverage_report(membership, spans, spark.createDataFrame([("A",)], "ticker string"), "2022-01-15", "2022-02-20").first()
    assert (got["members_at_start"], got["left_during_window"], got["left_and_unavailable_tickers"], got["joined_during_window"], got["share_of_start_universe_unavailable"]) == (2, 1, ["B"], 1, 0.5)


def test_source_choice_and_aliases(spark):
    c = spark.createDataFrame([("A", "v", 0, 500, D(1, 1)), ("A", "y", 1, 500, D(5, 1)), ("B", "v", 0, 500, D(5, 1)), ("C", "v", 0, 10, D(5, 1))], "ticker string, source string, priority int, rows int, last_date date")
    exits = spark.createDataFrame([("A", D(5, 1)), ("B", None)], "ticker string, end_date date")
    assert {(x.ticker, x.source) for x in un.pick_source(c, exits).collect()} == {("A", "y"), ("B", "v")}
    t = spark.createDataFrame([("BRK.B",), ("FB",)], "ticker string")
    al = spark.createDataFrame([("FB", "META")], "ticker string, alias string")
    assert {(x.ticker, x.symbol) for x in un.with_aliases(t, al).collect()} == {("BRK.B", "BRK-B"), ("FB", "META")}


@pytest.mark.parametrize("span", [1, 7, 60, 512])
def test_smoothed_in_chunks_equals_pandas(spark, span):
    """Nulls at the start, between and over whole chunks; a name without values; a mean of means."""
    rng = np.random.default_rng(span)
    days = pd.bdate_range("2020-01-01", periods=150)
    parts = []
    for k, share in enumerate((0.0, 0.3, 0.9, 1.0)):
        x = rng.normal(10, 2, 150)
        x[rng.random(150) < share] = np.nan
        x[: 5 * k] = np.nan
        x[40 : 40 + 25 * (k == 1)] = np.nan
        parts.append(pd.DataFrame({"date": days.date, "ticker": f"n{k}", "x": x, "z": rng.normal(size=150), "_l": k}))
    frame = pd.concat(parts)
    columns = {"fast": ("x", 0.4), "slow": ("x", 0.05), "line": ("fast - slow + z", 0.2)}
    got = ts.smoothed(spark.createDataFrame(frame).drop("_l"), columns, span=span).toPandas().sort_values(["ticker", "date"])
    for name, g in frame.groupby("ticker"):
        own = got[got["ticker"] == name]
        for new, (x, alpha) in columns.items():
            g[new] = g.eval(x).astype(float).ewm(alpha=alpha, adjust=False).mean()
            assert np.allclose(own[new].astype(float), g[new], rtol=1e-10, atol=1e-12, equal_nan=True), (name, new)
    assert len(got) == len(frame)


def test_smoothing_cuts_a_history_and_refuses_weights_out_of_range(spark):
    df = spark.createDataFrame([(dt.date(2020, 1, 1), "a", 1.0)], "date date, ticker string, x double")
    plan = ts.smoothed(df, {"m": ("x", 0.5)})._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan and "_chunk" in plan
    with pytest.raises(ValueError, match="alpha"):
        ts.smoothed(df, {"m": ("x", 1.0)})


@pytest.mark.parametrize(("n", "size", "least"), [(4, 5, 4), (4, 4, 1), (1, 3, 1), (30, 7, 30), (7, 1024, 3)])
def test_windows_cut_from_blocks_equal_rolling(spark, n, size, least):
    rng = np.random.default_rng(n)
    frame = pd.concat([pd.DataFrame({"date": pd.bdate_range("2020-01-01", periods=m).date, "ticker": f"n{m}", "x": rng.normal(size=m)}) for m in (1, 4, 5, 29, 30, 60)])
    blocks = ts.context_blocks(spark.createDataFrame(frame), ["x"], n, size=size)
    total = lambda w: F.aggregate(w, F.lit(0.0), lambda a, r: a + r["x"])
    got = ts.over_windows(blocks, n, {"total": total, "oldest": lambda w: w[0]["x"]}, keep=["x"], least=least).toPandas().sort_values(["ticker", "date"]).reset_index(drop=True)
    g = frame.sort_values(["ticker", "date"]).groupby("ticker")["x"]
    frame = frame.sort_values(["ticker", "date"]).assign(bars=g.cumcount() + 1, total=g.transform(lambda x: x.rolling(n, min_periods=1).sum()), oldest=g.transform(lambda x: x.shift(n - 1).fillna(x.iloc[0]))).reset_index(drop=True)
    want = frame[frame["bars"] >= least].reset_index(drop=True)
    assert len(got) == len(want) and np.allclose(got["total"], want["total"]) and np.allclose(got["oldest"], want["oldest"]) and np.allclose(got["x"], want["x"])
    assert (got["bars"] == want["bars"].clip(upper=n)).all()
    copies = blocks.selectExpr("size(rows) as n").agg(F.sum("n")).first()[0]
    assert copies <= 2 * len(frame)

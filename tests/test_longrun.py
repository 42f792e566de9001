"""Long-run variance as a plan over blocks, against plain matrices."""

import numpy as np
import pandas as pd
import pytest

from plumbline.functions import inference as inf
from plumbline.functions import longrun

from .test_inference import ar, long


def textbook(x, y, lags=None, prewhite=True):
    """Covariance of the moments and bandwidth, one series at a time with loops over lags."""
    cash = y is None or np.ptp(y) == 0
    z = np.column_stack([x, np.zeros_like(x) if cash else y, x * x, np.zeros_like(x) if cash else y * y])
    c = z - z.mean(axis=0)

    def rho_of(v):
        den = (v[:-1] ** 2).sum()
        return float(np.clip((v[:-1] * v[1:]).sum() / den, -0.97, 0.97)) if den > 0 else 0.0

    white = prewhite and len(c) > 3
    rho = np.array([rho_of(v) for v in c.T]) if white else np.zeros(4)
    u = c[1:] - c[:-1] * rho if white else c
    n = len(u)
    if lags is None:
        h = np.array([rho_of(v) for v in u.T])
        s = ((u[1:] - h * u[:-1]) ** 2).mean(axis=0) ** 2
        num, den = (4 * h**2 * s / ((1 - h) ** 6 * (1 + h) ** 2)).sum(), (s / (1 - h) ** 4).sum()
        lags = min(max(1.1447 * np.cbrt(num / den * n if den > 0 else 0.0), 1.0), max(n - 2, 1))
    out = u.T @ u / n
    for j in range(1, int(lags) + 1 if n >= 3 else 1):
        g = u[j:].T @ u[:-j] / n
        out += (1 - j / (lags + 1)) * (g + g.T)
    d = np.diag(1 / (1 - rho))
    return (d @ out @ d if white else out), lags


SERIES = {"calm": ar(700, 0.0, 1), "slow": ar(700, 0.6, 2), "back": ar(700, -0.4, 3)}


@pytest.mark.parametrize(("size", "lags", "prewhite"), [(16, None, True), (1024, None, True), (100, 6.5, True), (100, None, False)])
def test_matrix_and_bandwidth_from_blocks(spark, size, lags, prewhite):
    bar = ar(700, 0.2, 9)
    got = longrun.long_run(long(spark, SERIES, bar), lags, prewhite, size).toPandas().set_index("entry")
    for k, x in SERIES.items():
        want, width = textbook(x, bar, lags, prewhite)
        assert got.loc[k, "bandwidth"] == pytest.approx(width, rel=1e-9)
        assert np.allclose(np.reshape(got.loc[k, "matrix"], (4, 4)), want, rtol=1e-8, atol=1e-16)
        d, s = inf.sharpe_difference(x, bar, prewhite, lags)
        assert (got.loc[k, "edge"], got.loc[k, "se"]) == pytest.approx((d[0], s[0]), rel=1e-8)


def test_cash_short_and_flat_entries(spark):
    for n in (1, 3, 4, 8):
        x = ar(n, 0.2, n)
        got = longrun.long_run(long(spark, {"a": x})).first()
        d, s = inf.sharpe_difference(x)
        assert (got["edge"], got["se"]) == pytest.approx((d[0], s[0]), rel=1e-7, abs=1e-12)
    got = longrun.long_run(long(spark, {"flat": np.full(50, 0.01), "moves": ar(50, 0, 1)}, np.full(50, 0.002))).toPandas().set_index("entry")
    assert got.loc["flat", ["edge", "se"]].tolist() == [0, 0] and got.loc["moves", "se"] == pytest.approx(inf.sharpe_difference(ar(50, 0, 1))[1][0])
    assert longrun.long_run(long(spark, {"a": ar(5, 0, 1)}).where("false")).count() == 0 == longrun.block_lengths(long(spark, {"a": ar(5, 0, 1)}).where("false")).count()


def test_ordinals_with_gaps_are_days_in_a_row(spark):
    x, bar = ar(300, 0.4, 5), ar(300, 0.1, 6)
    rows = pd.DataFrame({"entry": "a", "ordinal": np.cumsum(np.random.default_rng(0).integers(1, 40, 300)), "x": x, "y": bar})
    got = longrun.long_run(spark.createDataFrame(rows), size=32).first()
    assert got["se"] == pytest.approx(inf.sharpe_difference(x, bar)[1][0], rel=1e-8)
    assert longrun.block_lengths(spark.createDataFrame(rows), 32).first()["block"] == inf.block_length(inf.influence(x, bar))


@pytest.mark.parametrize("size", [20, 1024])
def test_block_lengths_of_every_dependence(spark, size):
    series = {f"r{k}": ar(900, rho, k) for k, rho in enumerate((-0.5, 0.0, 0.3, 0.6, 0.9))} | {"short": None}
    bar = ar(900, 0.1, 40)
    series.pop("short")
    got = longrun.block_lengths(long(spark, series, bar), size).toPandas().set_index("entry")["block"].to_dict()
    assert got == {k: inf.block_length(inf.influence(x, bar)) for k, x in series.items()} and len(set(got.values())) > 2
    few = long(spark, {"few": ar(39, 0.5, 1), "flat": np.zeros(39)})
    assert {r["block"] for r in longrun.block_lengths(few).collect()} == {5}


def test_one_entry_is_in_several_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        seen = []
        plain = longrun.block_sums
        rows = longrun.numbered(long(spark, {"a": ar(2000, 0.1, 1)}), 50)
        params = spark.createDataFrame([("a", 2000, 3, None)], "entry string, n long, lags int, rho array<double>")
        c = rows.selectExpr("entry", "pos", "array(x) as c")
        parts = longrun.lag_sums(c, params, 1, 50)
        plan = parts._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(entry" in plan and "block" in plan and "FlatMapGroupsInPandas" not in plan
        x = ar(2000, 0.1, 1)
        got = {r["lag"]: r["g"][0] for r in parts.collect()}
        assert all(got[j] == pytest.approx((x[j:] * x[: len(x) - j]).sum()) for j in range(4))
        assert got[longrun.FIRST] == pytest.approx(x[0] ** 2) and got[longrun.LAST] == pytest.approx(x[-1] ** 2) and plain and not seen
        blocks = c.selectExpr("entry", "floor(pos / 50) as block").distinct().repartition("entry", "block").selectExpr("spark_partition_id() as p").distinct().count()
        assert blocks >= 2
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_covariance_rows_are_symmetric(spark):
    rows = longrun.hac_covariance(long(spark, {"a": SERIES["slow"]}, ar(700, 0, 8)), 4).toPandas()
    m = rows.pivot(index="a", columns="b", values="value")
    assert len(rows) == 16 and np.allclose(m, m.T) and (np.diag(m) > 0).all()

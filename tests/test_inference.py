"""Standard errors, block lengths, bootstraps, stepdown and overfitting against plain computations."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.functions import inference as inf
from plumbline.functions import overfit, simulate
from plumbline.functions.sharpe import expected_max_sharpe, normal_cdf, psr_argument, sharpe, sharpe_error
from plumbline.plans import queries_inference


def ar(n, rho, seed):
    e = np.random.default_rng(seed).normal(0.0003, 0.01, n)
    for t in range(1, n):
        e[t] += rho * e[t - 1]
    return e


def long(spark, series, bar=None):
    rows = [pd.DataFrame({"entry": k, "ordinal": np.arange(len(x)), "x": x, "y": bar if bar is not None else np.zeros(len(x))}) for k, x in series.items()]
    return spark.createDataFrame(pd.concat(rows))


def plain_variance(z, grad, lags=None):
    """The long-run covariance as a matrix, the textbook way."""
    c = z - z.mean(axis=1, keepdims=True)
    rho = np.clip((c[:, 1:] * c[:, :-1]).sum(axis=1) / (c[:, :-1] ** 2).sum(axis=1), -0.97, 0.97)
    u = c[:, 1:] - rho[:, None] * c[:, :-1]
    n = u.shape[1]
    s = u @ u.T / n
    for j in range(1, int(lags) + 1):
        g = u[:, j:] @ u[:, :-j].T / n
        s += (1 - j / (lags + 1)) * (g + g.T)
    d = np.diag(1 / (1 - rho))
    assert np.allclose(s, s.T)
    return grad @ d @ s @ d @ grad


def test_directional_variance_is_the_quadratic_form():
    x, y = ar(500, 0.4, 2), ar(500, 0.2, 3)
    z, _, grad = inf._moments(x[None], y[None])
    for lags in (3.0, 7.4):
        assert inf.directional_variance(z, grad, lags=lags)[0] == pytest.approx(plain_variance(z[0], grad[0], lags))


def test_error_near_the_iid_formula_and_wider_with_autocorrelation():
    x = ar(2000, 0.0, 2)
    _, se = inf.sharpe_difference(x)
    sr = x.mean() / x.std()
    assert se[0] == pytest.approx(np.sqrt((1 + 0.5 * sr**2) / len(x) * 252), rel=0.25)
    assert inf.sharpe_difference(ar(2000, 0.4, 2))[1][0] > 1.2 * se[0]


def test_degenerate_series():
    x = ar(100, 0, 1)
    assert inf.bootstrap_t(x, x + 1e-18, 5, 50, 0)[:2] == (0.0, 0.0)
    assert inf.bootstrap_t(np.zeros(100), None, 5, 50, 0)[1] == 0
    d, s = inf.sharpe_difference(np.array([0.1, 0.2]))
    assert d[0] == s[0] == 0
    assert inf.sharpe_difference(x, np.full(100, 0.0))[0][0] == pytest.approx(inf.sharpe_difference(x)[0][0])


def test_influence_is_centred_and_blocks_grow_with_dependence():
    assert abs(inf.influence(ar(500, 0.2, 4), ar(500, 0, 5)).mean()) < 1e-12
    assert inf.block_length(ar(3000, 0.6, 15)) > inf.block_length(ar(3000, 0.0, 15))
    assert inf.block_length(ar(30, 0, 1)) == 5 == inf.block_length(np.zeros(100))


def test_circular_blocks_wrap():
    at = inf.circular(np.array([[8, 1]]), 4, 6)
    assert at.tolist() == [[2, 3, 4, 5, 1, 2]]
    assert inf.block_starts(10, 3, 0, 4, 0).shape == (4, 4) and np.array_equal(inf.block_starts(10, 3, 2, 4, 0), inf.block_starts(10, 3, 0, 4, 0)[2:])
    assert inf.block_starts(10, 5, 1, 3, (3, 4, 5)).tolist() == [[8, 2], [1, 5]] and inf.block_starts(10, 3, 2, 2, 0).shape == (0, 4)


def test_joint_test_and_stepdown(spark):
    rng = np.random.default_rng(11)
    bar = rng.normal(0.0003, 0.01, 600)
    series = {f"n{k}": bar + rng.normal(0, 0.003, 600) for k in range(4)} | {"winner": bar + rng.normal(0.0025, 0.003, 600), "same": bar.copy()}
    got = inf.joint_sharpe_tests(long(spark, series, bar), reps=199, seed=3).toPandas().set_index("entry")
    assert got.loc["winner", "clears_bar_fwe"] and not got.drop("winner")["clears_bar_fwe"].any()
    assert (got["p_value_fwe"] >= got["p_value"] - 1e-12).all()
    assert got.loc["same", ["p_value", "net_edge", "se"]].tolist() == [1.0, 0.0, 0.0]
    assert (got["ci_low"] <= got["net_edge"]).all() and (got["ci_high"] >= got["net_edge"]).all()
    # The same numbers from arrays.
    block = int(got["block_size"].iloc[0])
    found = {k: inf.bootstrap_t(x, bar, block, 199, 3) for k, x in series.items()}
    t = {k: d / s if s > 0 else 0.0 for k, (d, s, _) in found.items()}
    names = sorted(series, key=lambda k: (-t[k], k))
    running = 0.0
    for i, k in enumerate(names):
        top = np.max([found[m][2] for m in names[i:]], axis=0)
        running = max(running, ((top >= t[k]).sum() + 1) / 200)
        assert got.loc[k, "p_value_fwe"] == pytest.approx(running)
    summary = inf.board_summary(spark.createDataFrame(got.reset_index())).first()
    assert (summary["n_contestants"], summary["n_live_hypotheses"]) == (6, 5)


def test_board_needs_one_calendar(spark):
    with pytest.raises(ValueError, match="calendar"):
        inf.joint_sharpe_tests(long(spark, {"a": ar(50, 0, 1), "b": ar(60, 0, 1)}), reps=10)


def test_percentile_bootstrap_of_a_clear_winner(spark):
    bar = ar(400, 0, 9)
    got = inf.percentile_bootstrap(long(spark, {"w": bar + 0.002, "b": bar}, bar), reps=200).toPandas().set_index("entry")
    assert got.loc["w", "clears_bar"] and got.loc["w", "p_positive"] == 1.0
    assert got.loc["b", "net_edge"] == 0 and not got.loc["b", "clears_bar"]


def test_closed_forms(spark):
    x = ar(300, 0, 6)
    got = spark.createDataFrame(pd.DataFrame({"x": x})).agg(sharpe("x").alias("s"), sharpe_error("x").alias("e"), psr_argument("x").alias("z")).select("*", normal_cdf("z").alias("p")).first()
    sr = x.mean() / x.std()
    g3, g4 = ((x - x.mean()) ** 3).mean() / x.std() ** 3, ((x - x.mean()) ** 4).mean() / x.std() ** 4
    assert got["s"] == pytest.approx(sr * np.sqrt(252)) and got["e"] == pytest.approx(np.sqrt((1 + sr**2 / 2) / 300 * 252))
    assert got["z"] == pytest.approx(sr * np.sqrt(299) / np.sqrt(1 - g3 * sr + (g4 - 1) / 4 * sr**2)) and 0 < got["p"] < 1
    none = spark.createDataFrame([(0.1,), (0.1,)], "x double").agg(sharpe("x").alias("s"), sharpe_error("x").alias("e"), psr_argument("x").alias("z")).first()
    assert (none["s"], none["e"], none["z"]) == (0.0, 0.0, None)
    assert expected_max_sharpe(50, 1.0) > expected_max_sharpe(5, 1.0) > 0 and expected_max_sharpe(5, 0) == 0


def test_normal_distribution_function(spark):
    from statistics import NormalDist

    z = [-40.0, -9.5, -6.0, -3.3, -1e-9, 0.0, 0.7, 2.5, 5.5, 8.9, 30.0]
    got = spark.createDataFrame([(x,) for x in [*z, None, float("nan")]], "z double").select("z", normal_cdf("z").alias("p")).collect()
    assert [r["p"] for r in got[: len(z)]] == pytest.approx([NormalDist().cdf(x) for x in z], abs=2e-15) and got[-2]["p"] is None and got[-1]["p"] is None


def test_overfitting(spark):
    noise = simulate.variant_series(spark, 800, 8)
    real = simulate.variant_series(spark, 800, 8, edge=0.003, lucky=2)
    pbo = lambda s: overfit.overfitting_probability(s, 800, 8).first()
    assert pbo(real)["pbo"] < 0.2 and pbo(noise)["pbo"] > 0.1 and pbo(noise)["n_combinations"] == overfit.combinations(8)
    for blocks in (7, 2, 400):
        with pytest.raises(ValueError):
            overfit.check_geometry(800, blocks)


@pytest.mark.parametrize("blocks", [4, 8, 10])
def test_splits_by_halves_equal_sums_over_their_blocks(spark, blocks):
    rng = np.random.default_rng(blocks)
    rows = [(v, b, float(rng.normal()), float(rng.uniform(5, 9))) for v in ("a", "b", "c") for b in range(blocks)]
    got = overfit.split_sharpes(spark.createDataFrame(rows, "variant string, block int, s1 double, s2 double"), 3, blocks).collect()
    assert len(got) == 3 * overfit.combinations(blocks) == len({(r["split"], r["variant"]) for r in got})
    each, n = {(v, b): (x, y) for v, b, x, y in rows}, 3 * blocks // 2
    for r in got:
        for fitted, ratio in ((1, r["fit"]), (0, r["test"])):
            s1, s2 = (sum(each[r["variant"], b][k] for b in range(blocks) if r["split"] >> b & 1 == fitted) / n for k in (0, 1))
            assert ratio == pytest.approx(s1 / np.sqrt(s2 - s1 * s1), rel=1e-9)
        assert int(r["split"]).bit_count() == blocks // 2


def test_split_rows_are_joined_once(spark):
    """One joined row for each split and variant; the sums of each half's subsets are made before."""
    sums = spark.createDataFrame([(v, b, 0.1 * b, 5.0) for v in ("a", "b") for b in range(8)], "variant string, block int, s1 double, s2 double")
    assert overfit.half_sums(sums, 0, 4).count() == 2 * 16
    plan = overfit.split_sharpes(sums, 3, 8)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 2 and "Cartesian" not in plan


def test_simulated_boards_keep_their_size(spark):
    got = simulate.rejection_rates(spark, sims=40, reps=99, n=300, entries=2).first()
    assert got["sims"] == 40 and got["stepdown"] <= got["uncorrected"] <= 0.4
    power = simulate.rejection_rates(spark, sims=16, reps=99, n=300, edge=0.004).first()
    assert power["uncorrected"] > 0.5
    again = simulate.rejections(spark, 6, 49, 200).orderBy("sim").collect()
    assert again == simulate.rejections(spark, 6, 49, 200).repartition(3).orderBy("sim").collect()


def test_stepdown_counts_dead_columns(spark):
    rows = [("a", 1.0, True, r, 0.5) for r in range(9)] + [("d", 0.0, False, r, 0.0) for r in range(9)]
    got = inf.stepdown(spark.createDataFrame(rows, "entry string, t double, live boolean, rep int, t_star double")).toPandas().set_index("entry")
    assert got.loc["a", "p_value_fwe"] == pytest.approx(0.1) and got.loc["d", "p_value_fwe"] == 1.0
    assert not got.loc["d", "clears_bar_fwe"]


@pytest.mark.parametrize("at_once", [1, 3, 7, 4096])
def test_stepdown_in_ranges_equals_plain_loops(spark, at_once):
    """Many hypotheses without a t of their own among them, for two boards."""
    rng = np.random.default_rng(at_once)
    rows, want = [], {}
    for board in ("a", "b"):
        t, star = np.where(rng.random(25) < 0.4, 0.0, rng.normal(1, 1, 25).round(1)), rng.normal(0, 1.2, (25, 19))
        names = [f"h{k:02d}" for k in range(25)]
        rows += [(board, names[k], float(t[k]), bool(t[k] != 0), r, float(star[k, r])) for k in range(25) for r in range(19)]
        order, before = sorted(range(25), key=lambda k: (-t[k], names[k])), 0.0
        for k, h in enumerate(order):
            before = max(before, ((star[order[k:]].max(axis=0) >= t[h]).sum() + 1) / 20)
            want[board, names[h]] = before
    got = inf.stepdown(spark.createDataFrame(rows, "board string, entry string, t double, live boolean, rep int, t_star double"), keys=["board"], at_once=at_once).collect()
    assert {(r["board"], r["entry"]): r["p_value_fwe"] for r in got} == pytest.approx(want)


def test_hypotheses_are_sorted_by_range(spark):
    """No window that orders hypotheses holds more than a range of them."""
    rows = spark.createDataFrame([("a", 1.0, True, 0, 0.5)], "entry string, t double, live boolean, rep int, t_star double")
    windows = [x for x in inf.stepdown(rows)._jdf.queryExecution().analyzed().toString().splitlines() if "Window [" in x and "[t#" in x]
    assert len(windows) >= 2 and all("part#" in x.split("], [")[-2] for x in windows)


def test_null_bar_is_cash(spark):
    x = ar(200, 0, 3)
    rows = long(spark, {"a": x}).withColumn("y", F.lit(None).cast("double"))
    assert inf.fixed_bandwidth_errors(rows, 3).first()["edge"] == pytest.approx(x.mean() / x.std() * np.sqrt(252))


def test_stepdown_of_all_users_equals_plain_loops(spark, tmp_path):
    rng = np.random.default_rng(6)
    events = pd.DataFrame({"event_id": np.arange(900), "user_id": rng.integers(0, 30, 900), "value": rng.exponential(1.0, 900) * 0.5})
    events.loc[events["user_id"] == 25, "value"] += 3
    spark.createDataFrame(events).write.parquet(str(tmp_path / "events.parquet"))
    star = np.zeros((30, 40))
    np.maximum.at(star, (events["user_id"], events["event_id"] % 40), events["value"])
    t = 3 * star.mean(axis=1)
    order, before, want = np.argsort(-t), 0.0, {}
    for k, user in enumerate(order):
        top = star[order[k:]].max(axis=0)
        before = max(before, ((top >= t[user]).sum() + 1) / 41)
        want[str(user)] = before
    got = queries_inference.stepdown_of_all_users(spark, str(tmp_path)).toPandas().set_index("entry")["p_value_fwe"].to_dict()
    assert set(got) == set(want) and len(got) == 30
    assert all(abs(got[u] - want[u]) < 1e-5 for u in want)


def unlike(seed=21):
    """Series of different dependence, so that their block lengths differ."""
    return {f"r{int(100 * rho):02d}": ar(900, rho, seed + k) + 0.0002 for k, rho in enumerate((0.0, 0.3, 0.6, 0.85))}


def test_an_entry_alone_gets_what_it_gets_on_a_board(spark):
    series, bar = unlike(), ar(900, 0.1, 40)
    together = inf.separate_sharpe_tests(long(spark, series, bar), reps=99, seed=1).toPandas().set_index("entry")
    assert together["block_size"].nunique() > 1
    for k, x in series.items():
        alone = inf.separate_sharpe_tests(long(spark, {k: x}, bar), reps=99, seed=1).toPandas().set_index("entry")
        pd.testing.assert_frame_equal(together.loc[[k]], alone, check_like=True)
        assert alone["block_size"].iloc[0] == inf.block_length(inf.influence(x, bar))
        d, s, t = inf.bootstrap_t(x, bar, inf.block_length(inf.influence(x, bar)), 99, 1)
        assert alone["ci_low"].iloc[0] == pytest.approx(d - np.quantile(t, 0.975) * s)


def test_entries_may_have_days_of_their_own(spark):
    rows = long(spark, {"a": ar(200, 0, 1)}, ar(200, 0, 2)).unionByName(long(spark, {"b": ar(120, 0, 3)}, ar(120, 0, 4)))
    assert inf.ledoit_wolf(rows, reps=50).count() == 2


def test_ranges_of_replicates_do_not_matter(spark, monkeypatch):
    rows = long(spark, {"a": ar(200, 0.2, 1), "b": ar(200, 0.2, 2)}, ar(200, 0, 3))
    got = []
    for at_once in (7, 1000):
        monkeypatch.setattr(inf.by_replicates, "__defaults__", (at_once,))
        got.append([df.toPandas().sort_values("entry").reset_index(drop=True) for df in (inf.joint_sharpe_tests(rows, reps=40), inf.percentile_bootstrap(rows, reps=40))])
    for one, other in zip(*got, strict=True):
        pd.testing.assert_frame_equal(one, other)


def test_net_edge_by_both_methods(spark):
    x, bar = ar(300, 0, 6) + 0.001, ar(300, 0, 7)
    rows = long(spark, {"a": x}, bar)
    for method in inf.METHODS:
        one = inf.net_edge(rows, method, reps=99).first()
        assert one["method"] == method and one["net_edge"] == pytest.approx(one["strategy_sharpe"] - one["bar_sharpe"])
        assert one["ci_low"] < one["net_edge"] < one["ci_high"] and one["clears_bar"] == (one["ci_low"] > 0)
        assert one["strategy_sharpe"] == pytest.approx(x.mean() / x.std() * np.sqrt(252)) and 0 < one["psr_vs_zero"] < 1 and one["strategy_sharpe_se"] > 0
    with pytest.raises(ValueError, match="method"):
        inf.net_edge(rows, "other")


def test_influence_and_bandwidth_by_entry(spark):
    x, bar = ar(300, 0.3, 6), ar(300, 0, 7)
    rows = long(spark, {"a": x, "b": bar}, bar)
    got = inf.influences(rows).where("entry = 'a'").orderBy("ordinal").toPandas()["influence"]
    assert np.allclose(got, inf.influence(x, bar))
    assert inf.bandwidths(rows).where("entry = 'a'").first()["bandwidth"] >= 1


def test_study_has_all_parts(spark):
    rows = simulate.study(spark, simulate.Study(days=120, reps=19, sims=4, lengths=(60, 90), boards=2, entries=3)).toPandas()
    assert rows["part"].tolist() == ["size", "power", "size by length", "size by length", "familywise"]
    assert rows["days"].tolist() == [120, 120, 60, 90, 120] and rows["sims"].tolist() == [4, 4, 2, 2, 2]
    assert rows[["uncorrected", "stepdown", "percentile"]].apply(lambda c: c.between(0, 1).all()).all() and (rows["stepdown"] <= rows["uncorrected"]).all()


def test_simulated_boards_have_equal_moments():
    board, bar = simulate.simulate_board(40_000, 3, np.random.default_rng(2), market=simulate.Market(nu=30.0))
    assert np.allclose(board.std(axis=1), bar.std(), rtol=0.03) and np.allclose([np.corrcoef(x, bar)[0, 1] for x in board], 0.9, atol=0.02)

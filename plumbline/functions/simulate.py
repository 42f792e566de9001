"""Monte-Carlo study of the tests: size, power, familywise error and overfitting.

A simulation is one row of a range; a task simulates and tests its rows, so the study scales
with the cluster. Each simulation seeds a stream of its own with its number, so no result
depends on how rows are dealt.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.inference import block_length, bootstrap_t, influence, percentile_differences


@dataclass(frozen=True)
class Market:
    """How simulated returns behave; fixed values of the study."""

    mean: float = 0.0004
    vol: float = 0.011
    rho: float = 0.9
    nu: float = 5.0
    persistence: float = 0.94


@dataclass(frozen=True)
class Study:
    """The sizes of a study; the defaults are the published ones."""

    days: int = 1000
    reps: int = 250
    sims: int = 250
    #: A third of a Sharpe ratio.
    edge: float = 0.33 * 0.011 / 252**0.5
    lengths: Sequence[int] = field(default=(500, 1000, 2000, 4000))
    boards: int = 80
    entries: int = 15
    alpha: float = 0.05


def volatility(n: int, rng: np.random.Generator, market: Market) -> np.ndarray:
    """A path whose variance keeps ``persistence`` of itself and gains a gamma shock each day."""
    gains = (1 - market.persistence) * market.vol**2 * rng.gamma(2.0, 0.5, n)
    variance, level = np.empty(n), market.vol**2
    for t in range(n):
        variance[t] = level = level if t == 0 else market.persistence * level + gains[t]
    return np.sqrt(variance)


def student(shape: tuple[int, ...] | int, rng: np.random.Generator, market: Market) -> np.ndarray:
    """Student shocks of unit variance."""
    return rng.standard_t(market.nu, shape) * np.sqrt((market.nu - 2) / market.nu)


def simulate_board(n: int, entries: int, rng: np.random.Generator, edge: float = 0.0, market: Market = Market()) -> tuple[np.ndarray, np.ndarray]:
    """(entries x n strategies, bar): shocks on one volatility path.

    A strategy shares the bar's shocks with correlation ``rho`` and has its mean and variance,
    so with ``edge`` 0 its true Sharpe ratio is the bar's.
    """
    path = volatility(n, rng, market)
    common, own = student(n, rng, market), student((entries, n), rng, market)
    return market.mean + edge + path * (market.rho * common + np.sqrt(1 - market.rho**2) * own), market.mean + path * common


def _p_values(strategies: np.ndarray, bar: np.ndarray, reps: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Raw and stepdown p values of one simulated board."""
    block = int(max(np.median([block_length(influence(s, bar)) for s in strategies]), 1))
    found = [bootstrap_t(s, bar, block, reps, seed) for s in strategies]
    t = np.array([d / s if s > 0 else 0.0 for d, s, _ in found])
    stars = np.stack([b for _, _, b in found])
    raw = ((stars >= t[:, None]).sum(axis=1) + 1) / (reps + 1)
    rising = np.argsort(t)
    highest = np.maximum.accumulate(stars[rising], axis=0)
    adjusted = np.empty_like(raw)
    adjusted[rising] = np.maximum.accumulate((((highest >= t[rising, None]).sum(axis=1) + 1) / (reps + 1))[::-1])[::-1]
    return raw, adjusted


def rejections(spark: SparkSession, sims: int, reps: int, n: int, entries: int = 1, edge: float = 0.0, seed: int = 101, alpha: float = 0.05, market: Market = Market(), mean_block: float = 10.0) -> DataFrame:
    """(sim, any_raw, any_adjusted, any_percentile): whether any entry of the board was declared better than the bar.

    By the studentised test, raw and corrected for the board, and by the lower end of the
    percentile interval.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for sim in batch["id"].tolist():
                board, bar = simulate_board(n, entries, np.random.default_rng([seed, sim]), edge, market)
                raw, adjusted = _p_values(board, bar, reps, sim)
                low = [np.quantile(percentile_differences(x, bar, 0, reps, mean_block, sim), alpha / 2) for x in board]
                rows.append((sim, bool((raw <= alpha).any()), bool((adjusted <= alpha).any()), bool(max(low) > 0)))
            yield pd.DataFrame(rows, columns=["sim", "any_raw", "any_adjusted", "any_percentile"])

    parts = min(sims, 4 * spark.sparkContext.defaultParallelism)
    return spark.range(0, sims, 1, parts).mapInPandas(run, "sim long, any_raw boolean, any_adjusted boolean, any_percentile boolean")


def rejection_rates(spark: SparkSession, sims: int, reps: int, n: int, entries: int = 1, edge: float = 0.0, seed: int = 101, alpha: float = 0.05, market: Market = Market()) -> DataFrame:
    """One row: share of simulations with a rejection by each method, and the Monte-Carlo error at the nominal rate."""
    hits = rejections(spark, sims, reps, n, entries, edge, seed, alpha, market)
    rate = lambda c: F.avg(F.col(c).cast("double"))
    return hits.agg(
        F.lit(n).alias("days"), F.lit(float(edge)).alias("edge"), F.lit(entries).alias("entries"), F.count("*").alias("sims"), rate("any_raw").alias("uncorrected"), rate("any_adjusted").alias("stepdown"),
        rate("any_percentile").alias("percentile"), F.lit((alpha * (1 - alpha) / sims) ** 0.5).alias("monte_carlo_se"), F.lit(1 - (1 - alpha) ** entries).alias("independent_expectation"),
    )


def size_by_length(spark: SparkSession, sims: int, reps: int, lengths: Sequence[int], seed: int = 103) -> DataFrame:
    """A row of ``rejection_rates`` for each record length."""
    out = None
    for n in lengths:
        one = rejection_rates(spark, sims, reps, n, seed=seed)
        out = one if out is None else out.unionByName(one)
    return out


def study(spark: SparkSession, sizes: Study = Study()) -> DataFrame:
    """(part, ...) rows of ``rejection_rates``: size, power, size by length and the error over a whole board."""
    part = lambda name, df: df.select(F.lit(name).alias("part"), "*")
    rates = lambda **kw: rejection_rates(spark, kw.pop("sims", sizes.sims), sizes.reps, sizes.days, alpha=sizes.alpha, **kw)
    out = part("size", rates(seed=101)).unionByName(part("power", rates(seed=102, edge=sizes.edge)))
    out = out.unionByName(part("size by length", size_by_length(spark, sizes.sims // 2, sizes.reps, sizes.lengths)))
    return out.unionByName(part("familywise", rates(seed=104, sims=sizes.boards, entries=sizes.entries)))


def variant_series(spark: SparkSession, n: int, variants: int, seed: int = 105, edge: float = 0.0, lucky: int | None = None, market: Market = Market()) -> DataFrame:
    """(variant, ordinal, ret) of one simulated search; ``lucky`` names the variant that gets ``edge``.

    A variant is a row of a range: its task makes the common path from the seed and its own
    shocks from the seed and its number.
    """

    def run(batches):
        rng = np.random.default_rng(seed)
        path = volatility(n, rng, market)
        common = student(n, rng, market)
        for batch in batches:
            for k in batch["id"].tolist():
                own = student(n, np.random.default_rng([seed, k]), market)
                ret = market.mean + (edge if k == lucky else 0.0) + path * (market.rho * common + np.sqrt(1 - market.rho**2) * own)
                yield pd.DataFrame({"variant": f"v{k:03d}", "ordinal": np.arange(n), "ret": ret})

    return spark.range(0, variants, 1, min(variants, 4 * spark.sparkContext.defaultParallelism)).mapInPandas(run, "variant string, ordinal int, ret double")

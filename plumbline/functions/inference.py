"""Inference on Sharpe differences: HAC errors, block lengths, studentised block bootstraps.

The kernels work on stacks of resamples at once. The long-run variance is needed only along
the gradient, so the moments are first folded into one series per resample and a single
autocovariance sequence replaces the covariance matrices.

Work is dealt by entry and range of replicates: the dates a replicate draws depend on the seed and
its number alone, so all entries get the same ones and no matrix of all entries is ever in one place.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.longrun import BARTLETT, FLOOR, MOST_RHO, bandwidths, block_lengths, fixed_bandwidth_errors, hac_covariance, influences, long_run  # noqa: F401
from plumbline.functions.sharpe import normal_cdf, psr_argument, sharpe, sharpe_error
from plumbline.lineage import settled

DAYS = 252
SAME = 1e-15
#: Values held at once by a batch of resamples.
AT_ONCE = 4_000_000
#: Replicates of one entry that a task makes, and hypotheses of a replicate that the stepdown sorts together.
REPS_AT_ONCE, HYPOTHESES_AT_ONCE = 250, 4096


def _is_cash(y: np.ndarray | None) -> bool:
    return y is None or bool(np.ptp(y) == 0) or bool(np.std(y) == 0)


def _moments(x: np.ndarray, y: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of resamples in rows: series (B, k, T) of returns and squares, the Sharpe difference, its gradient (B, k).

    Resamples in which the bar happens not to vary are judged against cash.
    """
    legs = [(x, 1.0)] if y is None else [(x, 1.0), (y, -1.0)]
    z, grad, stat = [], [], 0.0
    for r, sign in legs:
        m, g = r.mean(axis=1), (r * r).mean(axis=1)
        d = np.maximum(g - m * m, FLOOR)
        flat = (r.std(axis=1) == 0) & (sign < 0)
        sign = np.where(flat, 0.0, sign)
        stat = stat + sign * m / np.sqrt(d)
        z += [r, r * r]
        grad += [sign * g / d**1.5, -sign * m / (2 * d**1.5)]
    return np.stack(z, axis=1), np.asarray(stat), np.stack(grad, axis=1)


def _first_autocorrelation(u: np.ndarray) -> np.ndarray:
    below = (u[..., :-1] ** 2).sum(axis=-1)
    return np.clip(np.divide((u[..., :-1] * u[..., 1:]).sum(axis=-1), below, out=np.zeros_like(below), where=below > 0), -MOST_RHO, MOST_RHO)


def bandwidth(u: np.ndarray) -> np.ndarray:
    """Andrews' plug-in for the Bartlett kernel; u is (B, k, n)."""
    n = u.shape[-1]
    rho = _first_autocorrelation(u)
    s4 = ((u[..., 1:] - rho[..., None] * u[..., :-1]) ** 2).mean(axis=-1) ** 2
    num = (4 * rho**2 * s4 / ((1 - rho) ** 6 * (1 + rho) ** 2)).sum(axis=-1)
    den = (s4 / (1 - rho) ** 4).sum(axis=-1)
    alpha = np.divide(num, den, out=np.zeros_like(num), where=den > 0)
    return np.clip(BARTLETT * np.cbrt(alpha * n), 1.0, max(n - 2, 1))


def directional_variance(z: np.ndarray, grad: np.ndarray, prewhite: bool = True, lags: float | None = None) -> np.ndarray:
    """grad' (long-run covariance of z) grad, for stacks: z (B, k, T), grad (B, k).

    Prewhitening is by column, so recolouring only rescales the gradient.
    """
    c = z - z.mean(axis=-1, keepdims=True)
    if prewhite and z.shape[-1] > 3:
        rho = _first_autocorrelation(c)
        u = c[..., 1:] - rho[..., None] * c[..., :-1]
        grad = grad / (1 - rho)
    else:
        u = c
    n = u.shape[-1]
    v = np.einsum("bkt,bk->bt", u, grad)
    total = (v * v).sum(axis=1) / max(n, 1)
    if n < 3:
        return total
    width = bandwidth(u) if lags is None else np.full(len(v), float(lags))
    for j in range(1, int(width.max()) + 1):
        weight = np.where(j <= np.floor(width), 1 - j / (width + 1), 0.0)
        total = total + 2 * weight * (v[:, j:] * v[:, :-j]).sum(axis=1) / n
    return total


def sharpe_difference(x: np.ndarray, y: np.ndarray | None = None, prewhite: bool = True, lags: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Annualised differences and standard errors of resamples in rows; (0, 0) where x does not vary or is too short."""
    x = np.atleast_2d(np.asarray(x, dtype=float))
    y = None if y is None else np.atleast_2d(np.asarray(y, dtype=float))
    n = x.shape[1]
    if n < 3:
        return np.zeros(len(x)), np.zeros(len(x))
    z, stat, grad = _moments(x, y)
    error = np.sqrt(np.maximum(directional_variance(z, grad, prewhite, lags) / n, 0.0))
    dead = x.std(axis=1) == 0
    year = math.sqrt(DAYS)
    return np.where(dead, 0.0, stat * year), np.where(dead, 0.0, error * year)


def influence(x: np.ndarray, y: np.ndarray | None = None) -> np.ndarray:
    """How much each day moves the Sharpe difference."""
    z, _, grad = _moments(np.atleast_2d(x), None if _is_cash(y) else np.atleast_2d(y))
    return np.einsum("bkt,bk->bt", z - z.mean(axis=-1, keepdims=True), grad)[0]


def autocorrelations(x: np.ndarray, most: int) -> np.ndarray:
    """Of a centred series, at lags 0 to ``most``."""
    products = np.array([(x[: len(x) - k] * x[k:]).mean() for k in range(1, most + 1)])
    return np.concatenate([[1.0], products / (x * x).mean()])


def dependence_cut(acf: np.ndarray, n: int, run: int) -> int:
    """The lag after which ``run`` autocorrelations in a row are too small to tell from none; 0 if there is no such run."""
    small = np.abs(acf) < 2 * math.sqrt(math.log10(n) / n)
    quiet = np.lib.stride_tricks.sliding_window_view(small[1:-1], run).all(axis=1)
    return int(quiet.argmax()) + 1 if quiet.any() else 0


def flat_top(lags: np.ndarray, top: int) -> np.ndarray:
    """Weights of one up to half of ``top``, falling to zero at it."""
    return np.clip(2 * (1 - lags / top), 0.0, 1.0)


def block_length(x: np.ndarray, default: int = 5) -> int:
    """Politis and White's block length for the circular bootstrap: the one of least mean squared error of the long-run variance.

    Under 40 values, or where the rule has no answer, ``default``.
    """
    x = np.asarray(x, dtype=float) - np.mean(x)
    n = len(x)
    if n < 40 or np.std(x) == 0:
        return default
    run = max(5, int(math.sqrt(math.log10(n))))
    acf = autocorrelations(x, min(math.ceil(math.sqrt(n)) + run, n - 3))
    top = min(max(2 * dependence_cut(acf, n, run), 1), len(acf) - 1)
    lags = np.arange(1, top + 1)
    weighted = flat_top(lags, top) * acf[lags]
    slope, level = 2 * (lags * weighted).sum(), 1 + 2 * weighted.sum()
    if level == 0 or slope == 0:
        return default
    best = (1.5 * n * (slope / level) ** 2) ** (1 / 3)
    return int(np.clip(round(best), 1, max(n // 3, 1))) if math.isfinite(best) else default


Starts = tuple[int, int, int]


def block_starts(n: int, block: int, first: int, last: int, seed: int | Starts) -> np.ndarray:
    """(replicates, blocks) first days of the circular blocks of the replicates from ``first`` up to ``last``.

    Each replicate has a stream of its own, so a task draws only what it uses. Three numbers
    (a, c, k) in place of a seed are a formula: block b of replicate r starts on day (a r + c b + k) mod n.
    """
    blocks = -(-n // block)
    if isinstance(seed, tuple):
        a, c, k = seed
        return (a * np.arange(first, last)[:, None] + c * np.arange(blocks) + k) % n
    return np.array([np.random.default_rng([seed, rep]).integers(0, n, blocks) for rep in range(first, last)]).reshape(last - first, blocks)


def circular(starts: np.ndarray, block: int, n: int) -> np.ndarray:
    return ((starts[..., None] + np.arange(block)) % n).reshape(*starts.shape[:-1], -1)[..., :n]


def bootstrap_t(
    x: np.ndarray, y: np.ndarray | None, block: int, reps: int, seed: int | Starts, prewhite: bool = True, error_floor: float = 0.0, only: tuple[int, int] | None = None
) -> tuple[float, float, np.ndarray]:
    """Difference, standard error and the studentised differences of all replicates, or of those from ``only``'s first up to its last.

    A resample whose error is at or below ``error_floor`` times the sample's is set to 0.
    """
    first, last = only or (0, reps)
    cash = _is_cash(y)
    d, s = (float(a[0]) for a in sharpe_difference(x, None if cash else y, prewhite))
    out = np.zeros(last - first)
    same = np.abs(x - (0.0 if y is None else y)).max(initial=0.0) <= SAME
    if same or s <= 0:
        return (0.0 if same else d), 0.0, out
    n = len(x)
    starts = block_starts(n, block, first, last, seed)
    step = max(1, AT_ONCE // (4 * n))
    for a in range(0, len(out), step):
        at = circular(starts[a : a + step], block, n)
        db, sb = sharpe_difference(x[at], None if cash else y[at], prewhite)
        ok = sb > error_floor * s
        out[a : a + step][ok] = (db[ok] - d) / sb[ok]
    return d, s, out


# --- as Spark jobs ------------------------------------------------------------------------


def _xy(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    rows = rows.sort_values("ordinal")
    return rows["x"].to_numpy(dtype=float), rows["y"].fillna(0.0).to_numpy(dtype=float)


def common_block(series: DataFrame) -> int:
    """The median of the entries' block lengths, rounded down; 5 if there are none."""
    m = block_lengths(series).agg(F.median("block").alias("m")).first()["m"]
    return int(max(m, 1)) if m is not None else 5


def by_replicates(series: DataFrame, reps: int, at_once: int = REPS_AT_ONCE) -> DataFrame:
    """The series once for each range of replicates (first, last), the unit of work of a task."""
    ranges = F.array(*(F.struct(F.lit(a).alias("first"), F.lit(min(a + at_once, reps)).alias("last")) for a in range(0, reps, at_once)))
    return series.withColumn("_r", F.explode(ranges)).select(*series.columns, "_r.first", "_r.last")


def replicate_statistics(series: DataFrame, block: int | DataFrame, reps: int = 2000, seed: int | Starts = 0, prewhite: bool = True, error_floor: float = 0.0) -> DataFrame:
    """(entry, block, edge, se, rep, t_star): the studentised difference of every entry in every replicate.

    ``block`` is one length for all or a table (entry, block). A task has one entry's series and
    a range of replicates; the starts of a replicate depend on seed, length and block alone.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        own = g.iloc[0]
        first, last, length = int(own["first"]), int(own["last"]), int(own["block"])
        d, s, t = bootstrap_t(*_xy(g), block=length, reps=reps, seed=seed, prewhite=prewhite, error_floor=error_floor, only=(first, last))
        return pd.DataFrame({"entry": own["entry"], "block": length, "edge": d, "se": s, "rep": np.arange(first, last), "t_star": t})

    plain = series.select("entry", "ordinal", "x", "y")
    sized = plain.withColumn("block", F.lit(block)) if isinstance(block, int) else plain.join(block, "entry")
    return by_replicates(sized, reps).groupBy("entry", "first").applyInPandas(run, "entry string, block int, edge double, se double, rep int, t_star double")


def require_one_calendar(series: DataFrame) -> None:
    """ValueError unless all entries of a board have the same number of days."""
    n = series.groupBy("entry").count().agg(F.min("count").alias("a"), F.max("count").alias("b")).first()
    if n["a"] != n["b"]:
        raise ValueError("the series of a board must share one calendar")


def _ranges(hypotheses: DataFrame, keys: Sequence[str], at_once: int) -> DataFrame:
    """(keys, entry, t, live, part): hypotheses cut into ranges of about ``at_once`` in order of keys, t and entry.

    Equal t are cut by entry, so that many dead hypotheses are no range of their own. Where there
    is more than one range it is written down, as a second run might cut elsewhere.
    """
    n = -(-hypotheses.count() // at_once)
    if n <= 1:
        return hypotheses.withColumn("part", F.lit(0))
    return settled(hypotheses.repartitionByRange(n, *keys, "t", F.desc("entry")).withColumn("part", F.spark_partition_id()))


def stepdown(long: DataFrame, alpha: float = 0.05, keys: Sequence[str] = (), at_once: int = HYPOTHESES_AT_ONCE) -> DataFrame:
    """(keys, entry, p_value_fwe, clears_bar_fwe) from (keys, entry, t, live, rep, t_star).

    Romano and Wolf: each hypothesis is held against the largest t_star of itself and of those
    with a smaller t; adjusted values never fall from one to the next. Both are running maxima, in
    two levels: hypotheses in order of t are cut into ranges, a range's own maximum is carried to
    those after it, and within a range the maximum runs over up to about ``at_once`` of them.
    """
    cut = _ranges(long.groupBy(*keys, "entry").agg(F.first("t").alias("t"), F.first("live").alias("live")), keys, at_once)
    rows = long.drop("t", "live").join(cut, [*keys, "entry"])
    earlier = Window.partitionBy(*keys, "rep").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy(*keys, "rep", "part").agg(F.max("t_star").alias("_top")).withColumn("_carry", F.max("_top").over(earlier)).drop("_top")
    rising = Window.partitionBy(*keys, "rep", "part").orderBy("t", F.desc("entry")).rowsBetween(Window.unboundedPreceding, 0)
    held = rows.withColumn("_own", F.max("t_star").over(rising)).join(carried, [*keys, "rep", "part"])
    top = F.greatest("_own", "_carry")  # a null carry, before the first range, is passed over
    p = held.groupBy(*keys, "entry", "t", "live", "part").agg(((F.count_if(top >= F.col("t")) + 1) / (F.count("*") + 1)).alias("_p"))
    # One row for each range, so this window without a key holds a 4096th of the hypotheses.
    later = Window.partitionBy(*keys).orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    least = p.groupBy(*keys, "part").agg(F.max("_p").alias("_top")).withColumn("_carry", F.max("_top").over(later)).drop("_top")
    falling = Window.partitionBy(*keys, "part").orderBy(F.desc("t"), "entry").rowsBetween(Window.unboundedPreceding, 0)
    out = p.withColumn("_own", F.max("_p").over(falling)).join(least, [*keys, "part"]).withColumn("p_value_fwe", F.greatest("_own", "_carry"))
    return out.select(*keys, "entry", "p_value_fwe", ((F.col("p_value_fwe") <= alpha) & F.col("live") & (F.col("t") > 0)).alias("clears_bar_fwe"))


def _tested(long: DataFrame, reps: int, alpha: float) -> DataFrame:
    """A row per entry from (entry, block, edge, se, rep, t_star): interval and p values of that entry alone."""
    live = F.col("se") > 0
    long = long.withColumns({"live": live, "t": F.when(live, F.col("edge") / F.nullif(F.col("se"), F.lit(0.0))).otherwise(F.lit(0.0))})
    own = long.groupBy("entry", "block", "edge", "se", "t", "live").agg(
        F.percentile("t_star", F.lit(1 - alpha / 2)).alias("_high"), F.percentile("t_star", F.lit(alpha / 2)).alias("_low"),
        F.count_if(F.col("t_star") >= F.col("t")).alias("_one"), F.count_if(F.abs("t_star") >= F.abs("t")).alias("_two"),
    )
    p = lambda c: F.when(F.col("live"), (F.col(c) + 1) / F.lit(reps + 1)).otherwise(F.lit(1.0))
    end = lambda c: F.when(F.col("live"), F.col("edge") - F.col(c) * F.col("se")).otherwise(F.col("edge"))
    out = own.select("entry", F.col("edge").alias("net_edge"), "se", F.col("t").alias("t_stat"), end("_high").alias("ci_low"), end("_low").alias("ci_high"), p("_one").alias("p_value"), p("_two").alias("p_value_two_sided"), F.col("block").alias("block_size"))
    return out.withColumns({"clears_bar": F.col("ci_low") > 0, "n_boot": F.lit(reps)})


def joint_sharpe_tests(series: DataFrame, reps: int = 1000, block: int | None = None, alpha: float = 0.05, seed: int | Starts = 0, prewhite: bool = True, error_floor: float = 0.0) -> DataFrame:
    """One row per entry: net_edge, se, t_stat, interval, p values, and those corrected for the whole board.

    ``series`` is (entry, ordinal, x, y), the daily returns of entry and bar; y null is cash.
    An entry that is its own bar is not tested: p is 1. ``error_floor`` guards against
    resamples whose error all but vanishes; 0 keeps them. Blocks have one length for the board,
    so that a replicate draws the same dates for all entries.
    """
    # Entries x days rows, read three times: for the calendar, the block length and the replicates.
    series = settled(series.select("entry", "ordinal", "x", "y"))
    require_one_calendar(series)
    block = common_block(series) if block is None else block
    long = settled(replicate_statistics(series, block, reps, seed, prewhite, error_floor))
    live = F.col("se") > 0
    ranked = long.select("entry", F.when(live, F.col("edge") / F.nullif(F.col("se"), F.lit(0.0))).otherwise(F.lit(0.0)).alias("t"), live.alias("live"), "rep", "t_star")
    return _tested(long, reps, alpha).join(stepdown(ranked, alpha), "entry")


def separate_sharpe_tests(series: DataFrame, reps: int = 2000, block: int | None = None, alpha: float = 0.05, seed: int | Starts = 0, prewhite: bool = True, error_floor: float = 0.0) -> DataFrame:
    """The same without the correction for a board: each entry by itself, with its own days and block length.

    What an entry gets does not depend on which others are there.
    """
    series = settled(series.select("entry", "ordinal", "x", "y"))
    return _tested(replicate_statistics(series, block_lengths(series) if block is None else block, reps, seed, prewhite, error_floor), reps, alpha)


def board_summary(tests: DataFrame) -> DataFrame:
    """One row about the whole board: entries, how many were tested, and the draw's settings."""
    return tests.agg(F.count("*").alias("n_contestants"), F.count_if(F.col("se") > 0).alias("n_live_hypotheses"), F.first("block_size").alias("block_size"), F.first("n_boot").alias("n_boot"))


def ledoit_wolf(series: DataFrame, reps: int = 2000, alpha: float = 0.05, seed: int = 0, block: int | None = None) -> DataFrame:
    """The studentised test of each entry by itself."""
    return separate_sharpe_tests(series, reps, block, alpha, seed)


def stationary_days(n: int, mean_block: float, rng: np.random.Generator) -> np.ndarray:
    """The days of one resample: blocks go on with probability 1 - 1 / mean, each start is uniform."""
    new = rng.random(n) < 1 / mean_block
    new[0] = True
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, n))
    return (np.repeat(rng.integers(0, n, len(first)) - first, length) + np.arange(n)) % n


def ratios(r: np.ndarray) -> np.ndarray:
    """Annualised Sharpe ratios of the last axis; 0 where it does not vary."""
    sd = r.std(axis=-1)
    return np.divide(r.mean(axis=-1), sd, out=np.zeros_like(sd), where=sd > 0) * math.sqrt(DAYS)


def percentile_differences(x: np.ndarray, y: np.ndarray, first: int, last: int, mean_block: float, seed: int) -> np.ndarray:
    """Differences of Sharpe ratios in the replicates from first up to last; each has a stream of its own."""
    out = np.empty(last - first)
    for k in range(first, last):
        at = stationary_days(len(x), mean_block, np.random.default_rng([seed, k]))
        out[k - first] = float(ratios(x[at])) - float(ratios(y[at]))
    return out


def percentile_bootstrap(series: DataFrame, reps: int = 2000, mean_block: float = 10.0, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """(entry, net_edge, ci_low, ci_high, p_positive) by the stationary bootstrap: geometric blocks, percentile interval.

    A task has one entry's series and a range of replicates.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        x, y = _xy(g)
        first, last = int(g["first"].iloc[0]), int(g["last"].iloc[0])
        return pd.DataFrame({"entry": g["entry"].iloc[0], "net_edge": float(ratios(x)) - float(ratios(y)), "d": percentile_differences(x, y, first, last, mean_block, seed)})

    each = by_replicates(series.select("entry", "ordinal", "x", "y"), reps).groupBy("entry", "first").applyInPandas(run, "entry string, net_edge double, d double")
    out = each.groupBy("entry").agg(F.first("net_edge").alias("net_edge"), F.percentile("d", F.lit(alpha / 2)).alias("ci_low"), F.percentile("d", F.lit(1 - alpha / 2)).alias("ci_high"), F.avg((F.col("d") > 0).cast("double")).alias("p_positive"))
    return out.withColumn("clears_bar", F.col("ci_low") > 0)


METHODS = ("ledoit_wolf", "percentile")


def net_edge(series: DataFrame, method: str = "ledoit_wolf", reps: int = 2000, alpha: float = 0.05, seed: int = 0, block: int | None = None) -> DataFrame:
    """One row per entry: its edge over its bar by the named method, both Sharpe ratios, the error of the first and the chance that it is above zero."""
    if method not in METHODS:
        raise ValueError(f"the method is one of {', '.join(METHODS)}")
    series = settled(series.select("entry", "ordinal", "x", "y"))
    edge = separate_sharpe_tests(series, reps, block, alpha, seed) if method == "ledoit_wolf" else percentile_bootstrap(series, reps, alpha=alpha, seed=seed)
    about = series.groupBy("entry").agg(
        sharpe("x").alias("strategy_sharpe"), sharpe(F.coalesce("y", F.lit(0.0))).alias("bar_sharpe"), sharpe_error("x").alias("strategy_sharpe_se"), psr_argument("x").alias("_z")
    )
    return edge.withColumn("method", F.lit(method)).join(about.withColumn("psr_vs_zero", normal_cdf("_z")).drop("_z"), "entry")


def formula_bootstrap(series: DataFrame, reps: int, block: int, start: tuple[int, int, int], alpha: float = 0.05) -> DataFrame:
    """(entry, ci_low, ci_high, p_positive) where block b of replicate r starts on day (a r + c b + k) mod n.

    No random numbers: each day of each replicate names its source day, and the series is
    joined by it. Every entry must have the days 0 to n - 1.
    """
    a, c, k = start
    n = series.groupBy("entry").agg(F.count("*").alias("n"))
    draws = n.select("entry", "n", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep")).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("pos"))
    begin = (F.lit(a).cast("long") * F.col("rep") + F.lit(c).cast("long") * F.floor(F.col("pos") / block) + k) % F.col("n")
    rows = draws.select("entry", "rep", ((begin + F.col("pos") % block) % F.col("n")).alias("ordinal"))
    per = rows.join(series, ["entry", "ordinal"]).groupBy("entry", "rep").agg((sharpe("x") - sharpe(F.coalesce("y", F.lit(0.0)))).alias("d"))
    return per.groupBy("entry").agg(F.percentile("d", F.lit(alpha / 2)).alias("ci_low"), F.percentile("d", F.lit(1 - alpha / 2)).alias("ci_high"), F.avg((F.col("d") > 0).cast("double")).alias("p_positive"))

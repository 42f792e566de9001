"""Sharpe ratios and their closed forms as aggregate columns."""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.panel import finite

DAYS = 252
#: Fixed value: the Euler-Mascheroni constant.
EULER = 0.5772156649015329
#: The normal distribution is worked out up to this distance, with so many terms.
FAR, TERMS = 9.0, 160


def _finite(x: str | Column) -> Column:
    c = F.col(x) if isinstance(x, str) else x
    return F.when(finite(c), c)


def sharpe(x: str | Column) -> Column:
    """Annualised mean over population deviation; 0 under two values or if they do not vary."""
    c = _finite(x)
    return F.when((F.count(c) >= 2) & (F.stddev_pop(c) > 0), F.avg(c) / F.nullif(F.stddev_pop(c), F.lit(0.0)) * math.sqrt(DAYS)).otherwise(F.lit(0.0))


def sharpe_error(x: str | Column) -> Column:
    """Standard error of the annualised ratio for independent returns."""
    c = _finite(x)
    sr = F.avg(c) / F.nullif(F.stddev_pop(c), F.lit(0.0))
    error = F.sqrt((1 + 0.5 * sr * sr) / F.nullif(F.count(c), F.lit(0))) * math.sqrt(DAYS)
    return F.when((F.count(c) >= 2) & (F.stddev_pop(c) > 0), error).otherwise(F.lit(0.0))


def psr_argument(x: str | Column, benchmark: float | Column = 0.0) -> Column:
    """What the normal distribution is asked in the probabilistic Sharpe ratio; the benchmark is annualised."""
    c = _finite(x)
    sr = F.avg(c) / F.nullif(F.stddev_pop(c), F.lit(0.0))
    bench = (benchmark if isinstance(benchmark, Column) else F.lit(float(benchmark))) / math.sqrt(DAYS)
    g3, g4 = F.skewness(c), F.kurtosis(c) + 3
    spread = F.greatest(1 - g3 * sr + (g4 - 1) / 4 * sr * sr, F.lit(1e-12))
    return F.when((F.count(c) >= 3) & (F.stddev_pop(c) > 0), (sr - bench) * F.sqrt(F.count(c) - 1.0) / F.sqrt(spread))


def normal_cdf(x: str | Column) -> Column:
    """The normal distribution function; null stays null, NaN becomes null.

    One half and the density times the series of z^(2k + 1) / (1 3 5 ... (2k + 1)). Spark has no error
    function. Beyond 9 the value is 0 or 1 to within the precision of a double.
    """
    given = F.col(x) if isinstance(x, str) else x
    z = F.greatest(F.lit(-FAR), F.least(F.lit(FAR), given))
    first = F.struct(z.alias("term"), z.alias("total"))

    def step(a: Column, k: Column) -> Column:
        term = a["term"] * z * z / (2 * k + 1)
        return F.struct(term.alias("term"), (a["total"] + term).alias("total"))

    series = F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), first, step, lambda a: a["total"])
    return F.when(given.isNotNull() & ~F.isnan(given), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 + series * F.exp(-z * z / 2) / math.sqrt(2 * math.pi))))


def expected_max_sharpe(n: int, variance: float) -> float:
    """The Sharpe ratio expected of the best of n (at least two) worthless trials, in the units of ``variance``."""
    n, ppf = max(int(n), 2), NormalDist().inv_cdf
    return math.sqrt(max(variance, 0.0)) * ((1 - EULER) * ppf(1 - 1 / n) + EULER * ppf(1 - 1 / (n * math.e)))


def deflated_sharpe(series: DataFrame, trials: int, variance: float, ret: str = "net", keys: Sequence[str] = ("entry",)) -> DataFrame:
    """(keys, threshold, dsr): the probabilistic Sharpe ratio against what the best of ``trials`` would show by luck."""
    bar = expected_max_sharpe(trials, variance)
    return series.groupBy(*keys).agg(F.lit(bar).alias("threshold"), psr_argument(ret, bar).alias("_z")).withColumn("dsr", normal_cdf("_z")).drop("_z")

"""Operators over the names of one day: ranks, sizes, equal weights, information coefficient."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from plumbline.panel import ratio

def day(*keys: str) -> WindowSpec:
    return Window.partitionBy(*keys, "date")


def ordinal_rank(value: str, w: WindowSpec | None = None, ticker: str = "ticker") -> Column:
    """1, 2, ... from the smallest value on; ties in ticker order; null values have no rank."""
    c = F.col(value)
    return F.when(c.isNotNull(), F.row_number().over((w or day()).orderBy(c.isNull(), c, ticker)))


def rank_first(value: str, w: WindowSpec | None = None, ticker: str = "ticker") -> Column:
    """The ordinal rank over the number of values."""
    return ordinal_rank(value, w, ticker) / F.count(value).over(w or day())


def mean_rank(value: str, w: WindowSpec | None = None) -> Column:
    """The rank where ties share their mean; null values have none."""
    c = F.col(value)
    order = (w or day()).orderBy(c.isNull(), c)
    peers = F.count(F.lit(1)).over(order.rangeBetween(Window.currentRow, Window.currentRow))
    return F.when(c.isNotNull(), F.rank().over(order) + (peers - 1) / 2)


def rank_average(value: str, w: WindowSpec | None = None) -> Column:
    """The mean rank over the number of values, less one half."""
    return mean_rank(value, w) / F.count(value).over(w or day()) - 0.5


def size(value: str, w: WindowSpec | None = None) -> Column:
    return F.count(value).over(w or day())


def equal_weight(chosen: Column, w: WindowSpec | None = None) -> Column:
    """1 / n for the n chosen names of the day, zero for the others."""
    return F.coalesce(F.when(chosen, F.lit(1.0) / F.nullif(F.sum(chosen.cast("int")).over(w or day()), F.lit(0))), F.lit(0.0))


def daily_correlation(df: DataFrame, a: str, b: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Pearson's correlation of two columns by day, null where one of them does not vary."""
    c = ratio(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    return df.groupBy(*keys, "date").agg(F.count("*").alias("names"), F.countDistinct("value").alias("distinct_values"), c.alias("ic"))


def information_coefficient(signals: DataFrame, actual: DataFrame, least_names: int = 10, keys: tuple[str, ...] = ("entry",)) -> DataFrame:
    """(keys, days, ic): the mean over days of the rank correlation of value and target.

    Both are ranked among the names that have both. Days with fewer names, or with a single
    value, do not count.
    """
    both = signals.where("value is not null").join(actual.where("target is not null"), ["date", "ticker"])
    w = day(*keys)
    ranked = both.select(*keys, "date", "value", mean_rank("value", w).alias("_rv"), mean_rank("target", w).alias("_rt"))
    per = daily_correlation(ranked, "_rv", "_rt", keys).where((F.col("names") >= least_names) & (F.col("distinct_values") > 1))
    return per.groupBy(*keys).agg(F.count("ic").alias("days"), F.avg("ic").alias("ic"))


def early_information_coefficient(signals: DataFrame, actual: DataFrame, most_days: int = 400, least_names: int = 20, least_share: float = 0.5, keys: tuple[str, ...] = ("entry",)) -> DataFrame:
    """(keys, ic, share) over the first ``most_days`` common days; ic is 0 where too few of them could be correlated.

    Only days with a finite correlation count towards the share.
    """
    both = signals.where("value is not null").join(actual.where("target is not null"), ["date", "ticker"])
    w = day(*keys)
    ranked = both.select(*keys, "date", "value", mean_rank("value", w).alias("_rv"), mean_rank("target", w).alias("_rt"))
    order = Window.partitionBy(*keys).orderBy("date")
    per = daily_correlation(ranked, "_rv", "_rt", keys).withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= most_days)
    good = F.col("ic").isNotNull() & (F.col("names") >= least_names)
    out = per.groupBy(*keys).agg((F.count_if(good) / F.count("*")).alias("share"), F.avg(F.when(good, F.col("ic"))).alias("_ic"))
    return out.select(*keys, F.when(F.col("share") >= least_share, F.col("_ic")).otherwise(0.0).alias("ic"), "share")

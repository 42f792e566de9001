"""Panels derived from the benchmark tables, as DataFrames and as the SQL that states the same rows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.lineage import settled
from plumbline.operators.crosssection import day
from plumbline.operators.timeseries import change, own
from plumbline.panel import ratio

DAMP = 0.02


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _prices(rows: DataFrame, date, ticker) -> DataFrame:
    each = F.col("l_extendedprice") / F.col("l_quantity")
    return rows.groupBy(date.alias("date"), ticker.alias("ticker")).agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("close"), F.max(each).alias("high"), F.min(each).alias("low"), F.sum("l_quantity").cast("double").alias("volume"))


def weekly_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1: prices by week and brand, dense."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return _prices(rows, F.date_trunc("week", "l_shipdate").cast("date"), F.col("p_brand"))


def daily_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P2: prices by day and supplier nation, sparse."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return _prices(rows, F.col("l_shipdate").cast("date"), F.col("n_name"))


def daily_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P3: values by day and user, many names over few days.

    A sum of doubles depends on its order, and means that are equal on paper decide what is held.
    So values are added in the order of the events, however the files are split.
    """
    e = table(spark, sf_dir, "events").select(F.col("ts").cast("date").alias("date"), F.col("user_id").cast("string").alias("ticker"), "event_id", "value")
    sofar = Window.partitionBy("date", "ticker").orderBy("event_id", "value").rowsBetween(Window.unboundedPreceding, 0)
    each = e.select("date", "ticker", "value", F.avg("value").over(sofar).alias("mean"), F.count("*").over(sofar).alias("at"))
    return each.groupBy("date", "ticker").agg(F.max_by("mean", "at").alias("close"), F.max("value").alias("high"), F.min("value").alias("low"), F.count("*").cast("double").alias("volume"))


def weekly_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P4: market context by week."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.date_trunc("week", "o_orderdate").cast("date").alias("date")).agg(F.avg("o_totalprice").alias("vix"), F.median("o_totalprice").alias("treasury_10y"))


def with_target(prices: DataFrame) -> DataFrame:
    """Adds the damped next return; null where a price is not positive."""
    ahead = F.lead("close").over(own())
    return prices.withColumn("target", F.when((F.col("close") > 0) & (ahead > 0), DAMP * F.ln(ahead / F.col("close"))))


def evenly_spread(actual: DataFrame) -> DataFrame:
    """Targets with a deviation of DAMP on every day; as they are on days where they do not vary.

    A price is a mean of rows, so the more rows a table has the less its prices change, while
    costs are fixed: at six times sf0.1 they outweigh even what the answer itself earns.
    """
    return actual.withColumn("target", F.coalesce(DAMP * ratio(F.col("target"), F.stddev_samp("target").over(day())), F.col("target")))


def momentum(panel: DataFrame, k: int, *entries: str) -> DataFrame:
    """(entry, date, ticker, value): the change over k rows, for each of the named entries."""
    entry = F.lit(entries[0]) if len(entries) == 1 else F.explode(F.array(*map(F.lit, entries)))
    return panel.select("date", "ticker", change("close", k).alias("value")).select(entry.alias("entry"), "date", "ticker", "value")


def momentum_variants(panel: DataFrame, ks: Iterable[int]) -> DataFrame:
    """The same for an entry ``m{k}`` of each k, all from one window."""
    named = {f"m{k}": change("close", k) for k in ks}
    wide = panel.select("date", "ticker", *(c.alias(name) for name, c in named.items()))
    return wide.unpivot(["date", "ticker"], list(named), "entry", "value").select("entry", "date", "ticker", "value")


def priced(prices: DataFrame) -> DataFrame:
    """A panel with its target, settled: names x days rows that several parts of a query read."""
    return settled(with_target(prices))


P1 = """p1 AS (
  SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS date, p_brand AS ticker, SUM(l_extendedprice)/SUM(l_quantity) AS close,
         MAX(l_extendedprice/l_quantity) AS high, MIN(l_extendedprice/l_quantity) AS low, CAST(SUM(l_quantity) AS DOUBLE) AS volume
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""
P2 = """p2 AS (
  SELECT CAST(l_shipdate AS DATE) AS date, n_name AS ticker, SUM(l_extendedprice)/SUM(l_quantity) AS close,
         MAX(l_extendedprice/l_quantity) AS high, MIN(l_extendedprice/l_quantity) AS low, CAST(SUM(l_quantity) AS DOUBLE) AS volume
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2)"""
P3 = """p3 AS (
  SELECT CAST(ts AS DATE) AS date, CAST(user_id AS VARCHAR) AS ticker, AVG(value) AS close, MAX(value) AS high, MIN(value) AS low,
         CAST(COUNT(*) AS DOUBLE) AS volume FROM events GROUP BY 1, 2)"""
P4 = """p4 AS (
  SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS date, AVG(o_totalprice) AS vix, MEDIAN(o_totalprice) AS treasury_10y FROM orders GROUP BY 1)"""


def actual_sql(panel: str) -> str:
    """CTE ``a``: the panel with its damped target."""
    return f"""a AS (
  SELECT *, CASE WHEN close > 0 AND lead(close) OVER w > 0 THEN {DAMP}::DOUBLE * ln(lead(close) OVER w / close) END AS target
  FROM {panel} WINDOW w AS (PARTITION BY ticker ORDER BY date))"""

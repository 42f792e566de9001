"""From signals to positions by a fixed rule.

Positions are sparse: only names that are held have a row (entry, date, ticker, weight, target).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.crosssection import day, ordinal_rank

RULES = ("long_flat", "long_top", "long_short")
#: Slack allowed on gross exposure and on negative weights, here and in the validator.
GROSS_SLACK, NEGATIVE_SLACK = 1e-6, 1e-12


def _match(signals: DataFrame, actual: DataFrame) -> DataFrame:
    """Values on names that have a return that day."""
    kept = [c for c in signals.columns if c not in ("date", "ticker")]
    return signals.where("value is not null").join(actual.where("target is not null"), ["date", "ticker"]).select("date", "ticker", *kept, "target")


def weights_from_predictions(signals: DataFrame, actual: DataFrame, rule: str | Column = "long_flat", quantile: float | Column = 0.1) -> DataFrame:
    """(entry, date, ticker, weight, target) of every name held.

    long_flat holds the positive values. The ranking rules order the values of the day, ties
    by ticker: long_top holds those whose ordinal over the count is above 1 - quantile,
    long_short half of that less half of those up to quantile. Each side is equally weighted;
    an empty side holds nothing. ``rule`` and ``quantile`` may be columns of ``signals``, so
    entries of all rules go through one plan: a single shuffle by (entry, date).
    """
    rows = _match(signals, actual).withColumns({"_rule": F.lit(rule) if isinstance(rule, str) else rule, "_q": F.lit(float(quantile)) if isinstance(quantile, (int, float)) else quantile})
    w = day("entry")
    share = ordinal_rank("value", w) / F.count("value").over(w)
    sides = rows.withColumn("_p", share).withColumns(
        {
            "_top": F.when(F.col("_rule") == "long_flat", F.col("value") > 0).otherwise(F.col("_p") > 1 - F.col("_q")).cast("int"),
            "_low": ((F.col("_rule") == "long_short") & (F.col("_p") <= F.col("_q"))).cast("int"),
        }
    )
    each = lambda c: F.col(c) / F.nullif(F.sum(c).over(w), F.lit(0))
    up, down = F.coalesce(each("_top"), F.lit(0.0)), F.coalesce(each("_low"), F.lit(0.0))
    weight = F.when(F.col("_rule") == "long_short", 0.5 * up - 0.5 * down).otherwise(up)
    return sides.select("entry", "date", "ticker", weight.alias("weight"), "target").where("weight != 0")


def submitted_weights(signals: DataFrame, actual: DataFrame) -> DataFrame:
    """Weights as given, without those on names that have no return that day."""
    return _match(signals, actual).select("entry", "date", "ticker", F.col("value").alias("weight"), "target").where("weight != 0")


def refusals(signals: DataFrame, entries: DataFrame, actual: DataFrame, allow_short: bool = False) -> DataFrame:
    """(entry, reason) of the entries that the engine does not take.

    A weights entry with leverage on any day, or with shorts where neither its rule is
    long_short nor ``allow_short`` is given, and any entry with more than one value for a name
    on a day, whose positions would add up.
    """
    rules = entries.select("entry", (F.col("kind") == "weights").alias("_given"), ((F.col("rule") == "long_short") | F.lit(allow_short)).alias("_short"))
    known = actual.where("target is not null").select("date", "ticker", F.lit(True).alias("_known")).dropDuplicates(["date", "ticker"])
    rows = signals.join(rules, "entry").join(known, ["date", "ticker"], "left")
    # Of weights only those count that a return meets; what repeats a key counts for all entries.
    weight = F.when(F.col("_given") & F.col("_known"), F.col("value"))
    each = rows.groupBy("entry", "_short", "date", "ticker").agg(F.count("*").alias("n"), F.sum(F.abs(weight)).alias("gross"), F.min(weight).alias("least"))
    per = each.groupBy("entry", "_short", "date").agg(F.max("n").alias("n"), F.sum("gross").alias("gross"), F.min("least").alias("least"))
    of = per.groupBy("entry", "_short").agg(F.max("n").alias("n"), F.max("gross").alias("gross"), F.min("least").alias("least"))
    found = [
        F.when(F.col("gross") > 1 + GROSS_SLACK, F.lit("gross exposure above one")), F.when(~F.col("_short") & (F.col("least") < -NEGATIVE_SLACK), F.lit("negative weights")),
        F.when(F.col("n") > 1, F.lit("duplicate rows")),
    ]
    return of.select("entry", F.explode(F.array_compact(F.array(*found))).alias("reason"))


def require_contract(signals: DataFrame, entries: DataFrame, actual: DataFrame, allow_short: bool = False) -> None:
    """ValueError if any entry is refused, or if the returns have a name twice on a day."""
    twice = actual.groupBy("date", "ticker").agg(F.count("*").alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"more than one return for {twice[0]['ticker']} on {twice[0]['date']}")
    found = refusals(signals, entries, actual, allow_short).orderBy("entry", "reason").limit(20).collect()
    if found:
        raise ValueError("refused: " + "; ".join(f"{r['entry']}: {r['reason']}" for r in found))


def breaches(positions: DataFrame, allow_short: bool = False) -> DataFrame:
    """(entry, reason) of what breaks the contract: leverage on any day, or short positions that are not allowed."""
    per = positions.groupBy("entry", "date").agg(F.sum(F.abs("weight")).alias("gross"), F.min("weight").alias("least"))
    of = per.groupBy("entry").agg(F.max("gross").alias("gross"), F.min("least").alias("least"))
    found = [F.when(F.col("gross") > 1 + GROSS_SLACK, F.lit("gross exposure above one"))]
    if not allow_short:
        found.append(F.when(F.col("least") < -NEGATIVE_SLACK, F.lit("negative weights")))
    return of.select("entry", F.explode(F.array_compact(F.array(*found))).alias("reason"))

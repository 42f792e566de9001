"""Point-in-time membership: as-of joins, masks, set operations and coverage.

A membership table is (date, tickers array): who is in from that change date on. Its form for
joins is (ticker, valid_from, valid_to), one row per stay: an equality on the ticker with a
range on the date, which a hash join takes, where an as-of join by array would scan sets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.panel import calendar

FAR = "9999-12-31"


def versions(membership: DataFrame) -> DataFrame:
    """(valid_from, valid_to, tickers): each version up to the next change date, which is outside."""
    changes = membership.select("date").distinct()
    upto = changes.select("date", F.coalesce(F.lead("date").over(Window.orderBy("date")), F.lit(FAR).cast("date")).alias("valid_to"))
    return membership.join(F.broadcast(upto), "date").select(F.col("date").alias("valid_from"), "valid_to", "tickers")


def stays(membership: DataFrame) -> DataFrame:
    """(ticker, valid_from, valid_to): unbroken stays, adjoining versions merged."""
    each = versions(membership).select(F.explode("tickers").alias("ticker"), "valid_from", "valid_to").distinct()
    w = Window.partitionBy("ticker").orderBy("valid_from")
    began = F.coalesce((F.lag("valid_to").over(w) != F.col("valid_from")).cast("int"), F.lit(1))
    runs = each.withColumn("_new", began).withColumn("_run", F.sum("_new").over(w))
    return runs.groupBy("ticker", "_run").agg(F.min("valid_from").alias("valid_from"), F.max("valid_to").alias("valid_to")).drop("_run")


def members_on(membership: DataFrame, dates: DataFrame) -> DataFrame:
    """(date, tickers): the latest version at or before each date.

    Dates before the first version have none and come with a null; ``require_covered`` makes
    that an error.
    """
    # The start of the version in force comes by one window over both kinds of dates, of which
    # there is at most one a day; the sets themselves are then joined by equality.
    changes = membership.select("date").distinct().select("date", F.col("date").alias("_from"), F.lit(False).alias("_asked"))
    asked = dates.select("date").distinct().select("date", F.lit(None).cast("date").alias("_from"), F.lit(True).alias("_asked"))
    upto = Window.orderBy("date", "_asked").rowsBetween(Window.unboundedPreceding, 0)
    begun = changes.unionByName(asked).withColumn("_begun", F.last("_from", ignorenulls=True).over(upto)).where("_asked").select("date", "_begun")
    return begun.join(membership.select(F.col("date").alias("_begun"), "tickers"), "_begun", "left").select("date", "tickers")


def require_covered(on: DataFrame) -> DataFrame:
    """The rows of ``members_on``; running it fails if a date stands before the first version."""
    message = F.concat(F.lit("no membership at or before "), F.col("date").cast("string"))
    return on.withColumn("tickers", F.when(F.col("tickers").isNull(), F.raise_error(message)).otherwise(F.col("tickers")))


def mask(membership: DataFrame, dates: DataFrame, names: DataFrame) -> DataFrame:
    """(date, ticker, member) for every date and every name."""
    spans = stays(membership)
    on = dates.select("date").distinct().agg(F.array_sort(F.collect_list("date")).alias("_days"))
    grid = names.select("ticker").distinct().join(F.broadcast(on)).select("ticker", F.explode("_days").alias("date"))
    inside = spans.select("ticker", "valid_from", "valid_to", F.lit(True).alias("_in"))
    hit = grid.join(inside, (grid["ticker"] == inside["ticker"]) & (grid["date"] >= inside["valid_from"]) & (grid["date"] < inside["valid_to"]), "left")
    return hit.select(grid["date"], grid["ticker"], F.coalesce("_in", F.lit(False)).alias("member"))


def only_members(panel: DataFrame, membership: DataFrame) -> DataFrame:
    """Panel rows of names that are members on their date."""
    s = stays(membership).withColumnRenamed("ticker", "_t")
    return panel.join(s, (F.col("ticker") == F.col("_t")) & (F.col("date") >= F.col("valid_from")) & (F.col("date") < F.col("valid_to")), "left_semi")


def in_force(membership: DataFrame, start: str | Column, end: str | Column) -> DataFrame:
    """The versions in force at any time from start to end."""
    a, b = (F.lit(x).cast("date") if isinstance(x, str) else x for x in (start, end))
    return versions(membership).where((F.col("valid_from") <= b) & (F.col("valid_to") > a))


def continuous(membership: DataFrame, start: str, end: str) -> DataFrame:
    """(ticker) that are in every version in force from start to end."""
    v = in_force(membership, start, end)
    each = v.select("valid_from", F.explode(F.array_distinct("tickers")).alias("ticker")).groupBy("ticker").agg(F.count("*").alias("n"))
    return each.join(F.broadcast(v.agg(F.count("*").alias("all"))), F.col("n") == F.col("all"), "left_semi").select("ticker")


def ever_members(membership: DataFrame, start: str, end: str) -> DataFrame:
    """(ticker) in any version in force from start to end, between month starts too."""
    return in_force(membership, start, end).select(F.explode("tickers").alias("ticker")).distinct()


def _on(membership: DataFrame, day: str) -> DataFrame:
    return in_force(membership, day, day).select(F.explode("tickers").alias("ticker")).distinct()


def first_last(membership: DataFrame) -> DataFrame:
    return membership.agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def coverage_report(membership: DataFrame, spans: DataFrame, available: DataFrame, start: str, end: str) -> DataFrame:
    """One row: members at the start, who left, who of those has no prices, who joined.

    Everything is a semi or anti join on tickers; only the list of missing names is gathered.
    """
    at_start = _on(membership, start)
    left = spans.where(F.col("end_date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).select("ticker").distinct().join(at_start, "ticker", "left_semi")
    missing = left.join(available.select("ticker").distinct(), "ticker", "left_anti")
    joined = _on(membership, end).join(at_start, "ticker", "left_anti")
    kinds = [(at_start, "member"), (left, "left"), (missing, "missing"), (joined, "joined")]
    rows = None
    for df, kind in kinds:
        one = df.select(F.lit(kind).alias("kind"), "ticker")
        rows = one if rows is None else rows.unionByName(one)
    n = lambda kind: F.count_if(F.col("kind") == kind)
    return rows.agg(
        F.lit(start).alias("window_start"), F.lit(end).alias("window_end"), n("member").alias("members_at_start"), n("left").alias("left_during_window"), n("missing").alias("left_and_unavailable"),
        F.array_sort(F.collect_list(F.when(F.col("kind") == "missing", F.col("ticker")))).alias("left_and_unavailable_tickers"), n("joined").alias("joined_during_window"),
        F.bround(n("missing") / F.greatest(n("member"), F.lit(1)), 4).alias("share_of_start_universe_unavailable"),
    )


def member_day_coverage(panel: DataFrame, membership: DataFrame) -> DataFrame:
    """One row: member-days the panel has, those defined on its dates, and their ratio."""
    days = calendar(panel).select("date")
    on = require_covered(members_on(membership, days))
    wanted = on.select("date", F.explode("tickers").alias("ticker")).distinct()
    got = wanted.join(panel.select("date", "ticker").distinct().withColumn("_has", F.lit(1)), ["date", "ticker"], "left")
    return got.agg(F.count("_has").alias("supplied"), F.count("*").alias("defined"), F.bround(F.count("_has") / F.nullif(F.count("*"), F.lit(0)), 4).alias("coverage"))


def pick_source(candidates: DataFrame, last_exit: DataFrame, slack_days: int = 7, least_rows: int = 70) -> DataFrame:
    """(ticker, source) of the first acceptable price source of each name.

    ``candidates`` is (ticker, source, priority, rows, last_date) with one row per source; the
    one of priority 0 counts only if its prices reach to within ``slack_days`` of the name's
    last exit (``last_exit``: ticker, end_date, null while it is a member).
    """
    exits = last_exit.select(F.col("ticker").alias("_t"), "end_date")
    c = candidates.join(exits, F.col("ticker") == F.col("_t"), "left")
    reaches = F.col("end_date").isNull() | (F.col("last_date") >= F.date_sub("end_date", slack_days))
    good = c.where((F.col("rows") >= least_rows) & ((F.col("priority") > 0) | reaches))
    return good.groupBy("ticker").agg(F.min_by("source", F.struct("priority", "source")).alias("source"))


def with_aliases(tickers: DataFrame, aliases: DataFrame) -> DataFrame:
    """Adds the vendor's symbol: the alias where there is one, else the ticker with dashes for dots."""
    return tickers.join(aliases.select("ticker", "alias"), "ticker", "left").withColumn("symbol", F.coalesce("alias", F.replace("ticker", F.lit("."), F.lit("-")))).drop("alias")

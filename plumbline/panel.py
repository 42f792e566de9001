"""Long panels: schemas, the null policy, calendars and reshapes.

A panel is a DataFrame of rows (date, ticker, ...), never a wide matrix. A missing row and a
null value mean the same: the name is not there that day. NaN becomes null where data enter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ACTUAL = T.StructType([T.StructField("date", T.DateType()), T.StructField("ticker", T.StringType()), T.StructField("target", T.DoubleType())])
SIGNAL = T.StructType([T.StructField("date", T.DateType()), T.StructField("ticker", T.StringType()), T.StructField("value", T.DoubleType())])
PRICES = T.StructType([T.StructField("date", T.DateType()), T.StructField("ticker", T.StringType()), *(T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume"))])
MARKET = T.StructType([T.StructField("date", T.DateType()), T.StructField("vix", T.DoubleType()), T.StructField("treasury_10y", T.DoubleType())])
SPANS = T.StructType([T.StructField("ticker", T.StringType()), T.StructField("start_date", T.DateType()), T.StructField("end_date", T.DateType())])


def number(c: Column) -> Column:
    """The value as a double; NaN becomes null."""
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def finite(c: Column) -> Column:
    """True for numbers that are neither null, NaN nor infinite."""
    return F.coalesce(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return a / F.nullif(b, F.lit(0.0))


def only_finite(df: DataFrame, column: str = "value") -> DataFrame:
    return df.where(finite(F.col(column)))


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Projects onto a schema by name, whatever the case; doubles lose NaN, timestamps become dates."""
    have = {c.lower(): c for c in df.columns}

    def one(f: T.StructField) -> Column:
        c = F.col(f"`{have[f.name]}`")
        return (number(c) if f.dataType == T.DoubleType() else c.cast(f.dataType)).alias(f.name)

    return df.select(*map(one, schema.fields))


def lower_names(df: DataFrame) -> DataFrame:
    """Date and Ticker, as files have them, in lower case; other columns as they are."""
    return df.select(*(F.col(f"`{c}`").alias(c.lower() if c in ("Date", "Ticker") else c) for c in df.columns))


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """One row: how many rows of ``df`` stand beyond the first of their key."""
    return df.groupBy(*keys).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicates"))


def calendar(df: DataFrame, date: str = "date") -> DataFrame:
    """(date, ordinal) of every date in the panel, from 0.

    A calendar has at most one row a day, some tens of thousands for any history. That bound
    comes from the DATE type and does not grow with the number of rows, which is what makes
    it safe to number in one task and to broadcast.
    """
    return df.select(F.col(date).cast("date").alias("date")).where("date is not null").distinct().withColumn("ordinal", F.row_number().over(Window.orderBy("date")) - 1)


def with_ordinal(df: DataFrame, days: DataFrame) -> DataFrame:
    """Rows on the calendar's dates, with their ordinal."""
    return df.join(F.broadcast(days), "date")


def densify(df: DataFrame, days: DataFrame, names: DataFrame | None = None, values: tuple[str, ...] = ("close",), fill: float | None = None) -> DataFrame:
    """A row for every calendar date and every name; absent values are null or ``fill``.

    The result is dates x names by definition. The names are exploded over the calendar's
    length, so that no join makes rows and the left join is by key.
    """
    names = (df if names is None else names).select("ticker").distinct()
    grid = names.join(F.broadcast(days.agg(F.array_sort(F.collect_list("date")).alias("_days")))).select("ticker", F.posexplode("_days").alias("ordinal", "date"))
    filled = (lambda c: F.coalesce(F.col(c), F.lit(fill)).alias(c)) if fill is not None else F.col
    return grid.join(df.select("date", "ticker", *values), ["date", "ticker"], "left").select("date", "ordinal", "ticker", *(filled(c) for c in values))


def shift_days(df: DataFrame, days: DataFrame, k: int) -> DataFrame:
    """Moves every row by k places on the calendar; rows moved off its ends go.

    On sparse rows this is what a shift of the dense matrix is, without the matrix.
    """
    there = days.select((F.col("ordinal") - k).alias("_from"), F.col("date").alias("_to"))
    moved = with_ordinal(df, days).join(F.broadcast(there), F.col("ordinal") == F.col("_from"))
    return moved.select(*(F.col("_to").alias("date") if c == "date" else F.col(f"`{c}`") for c in df.columns))


def window_rows(df: DataFrame, windows: dict[str, tuple[str, str]], date: str = "date") -> DataFrame:
    """Rows of each named window (both ends included), with the window's name; a row may be in several."""
    inside = [F.when(F.col(date).between(F.lit(a).cast("date"), F.lit(b).cast("date")), F.lit(n)) for n, (a, b) in windows.items()]
    return df.withColumn("window", F.explode(F.array_compact(F.array(*inside))))


def thick_dates(df: DataFrame, share: float = 0.5) -> DataFrame:
    """Without the dates that hold fewer names than ``share`` of the median date."""
    per = df.groupBy("date").agg(F.count("*").alias("n"))
    thin = per.join(F.broadcast(per.agg(F.median("n").alias("m")))).where(F.col("n") < share * F.col("m")).select("date")
    return df.join(F.broadcast(thin), "date", "left_anti")


def long_histories(df: DataFrame, rows: int = 250, keys: tuple[str, ...] = ("ticker",)) -> DataFrame:
    """Rows of names with at least ``rows`` rows. The counts are aggregated first; the panel itself is not sorted."""
    enough = df.groupBy(*keys).count().where(F.col("count") >= rows).select(*keys)
    return df.join(enough, list(keys), "left_semi")


def every_kth_day(days: DataFrame, k: int) -> DataFrame:
    return days.where(F.col("ordinal") % k == 0)


def to_wide(df: DataFrame, names: list[str], value: str = "value") -> DataFrame:
    """dates x names, for export only; the names are given, so no job looks for them."""
    return df.groupBy("date").pivot("ticker", names).agg(F.first(value))


def to_long(df: DataFrame, value: str = "value", keep_null: bool = False) -> DataFrame:
    out = df.unpivot("date", [c for c in df.columns if c != "date"], "ticker", value)
    return out if keep_null else out.where(F.col(value).isNotNull() & ~F.isnan(value))

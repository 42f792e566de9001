"""Readers. Schemas are stated, never inferred from CSV or JSON; NaN becomes null here."""

from __future__ import annotations

import os
from pathlib import Path

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.panel import ACTUAL, MARKET, PRICES, SIGNAL, SPANS, conform, number

#: Keys of an alias file that are notes, not tickers.
ALIAS_NOTES = ("_about", "_rejected")
LEAST_VENDOR_ROWS = 250


#: The session's option for files with nanoseconds; it counts when a file's columns are looked up.
NANOS = "spark.sql.legacy.parquet.nanosAsLong"


def _dated(spark: SparkSession, *path: str) -> DataFrame:
    """Parquet files whose date column may hold nanoseconds, which are read as integers and made dates.

    The session's option is set for the look at the file's columns only.
    """
    before = spark.conf.get(NANOS)
    spark.conf.set(NANOS, "true")
    try:
        df = spark.read.parquet(*path)
    finally:
        spark.conf.set(NANOS, before)
    for name, kind in df.dtypes:
        if name.lower() == "date" and kind == "bigint":
            df = df.withColumn(name, F.timestamp_micros(F.expr(f"`{name}` div 1000")))
    return df


def load_actual(spark: SparkSession, path: str) -> DataFrame:
    """(date, ticker, target). ValueError if a name has more than one return on a day."""
    return require_unique(conform(_dated(spark, path), ACTUAL), "date", "ticker")


def load_signal(spark: SparkSession, path: str, entry: str | None = None) -> DataFrame:
    """(date, ticker, value), with the entry's name in front if one is given. ValueError if a name has more than one value on a day."""
    df = require_unique(conform(_dated(spark, path), SIGNAL), "date", "ticker")
    return df.select(F.lit(entry).alias("entry"), *df.columns) if entry is not None else df


def load_prices(spark: SparkSession, path: str) -> DataFrame:
    return conform(_dated(spark, path), PRICES)


def load_market(spark: SparkSession, path: str) -> DataFrame:
    return conform(_dated(spark, path), MARKET)


def require_unique(df: DataFrame, *keys: str) -> DataFrame:
    """``df``, after ValueError if a key has more than one row. One aggregation, partly done before its shuffle."""
    twice = df.groupBy(*keys).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"more than one row for {twice[0].asDict()}")
    return df


def exists(spark: SparkSession, path: str) -> bool:
    """Whether Spark's file systems know the path."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def load_bars(spark: SparkSession, path: str) -> DataFrame | None:
    """(date, bar, ret) of a file with one column per bar; None where there is no file."""
    if not exists(spark, path):
        return None
    wide = _dated(spark, path)
    date = next(c for c in wide.columns if c.lower() == "date")
    bars = [c for c in wide.columns if c != date]
    numbers = wide.select(F.col(date).cast("date").alias("date"), *(number(F.col(f"`{c}`")).alias(c) for c in bars))
    return numbers.unpivot("date", bars, "bar", "ret").where("ret is not null")


def _folder(path: Column) -> Column:
    return F.url_decode(F.element_at(F.split(path, "/"), -2))


def _metadata(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.text(f"{root.rstrip('/')}/*/meta.json", wholetext=True).select(_folder(F.col("_metadata.file_path")).alias("entry"), F.col("value").alias("raw"))


def _entries_of(raw: DataFrame) -> DataFrame:
    value = lambda k: F.get_json_object("raw", f"$.{k}")
    return raw.select("entry", value("kind").alias("kind"), F.coalesce(value("rule"), F.lit("long_flat")).alias("rule"), F.coalesce(value("quantile").cast("double"), F.lit(0.1)).alias("quantile"))


def load_entries(spark: SparkSession, root: str) -> DataFrame:
    """(entry, kind, rule, quantile) of all folders under root."""
    return _entries_of(_metadata(spark, root))


def signal_files(spark: SparkSession, root: str) -> DataFrame:
    """(entry, path, length, modified) of every signal file under root, without reading any."""
    files = spark.read.format("binaryFile").load(f"{root.rstrip('/')}/*/signal.parquet")
    return files.select(_folder(F.col("path")).alias("entry"), "path", "length", F.col("modificationTime").alias("modified"))


def signals_from(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(entry, date, ticker, value) of the named signal files, or of those that a pattern names."""
    df = _dated(spark, *paths)
    tagged = df.withColumn("entry", _folder(F.col("_metadata.file_path")))
    have = {c.lower(): c for c in df.columns}
    return tagged.select("entry", F.col(have["date"]).cast("date").alias("date"), F.col(have["ticker"]).cast("string").alias("ticker"), number(F.col(have["value"])).alias("value"))


def load_submissions(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entries, signals, metadata) of all folders under root, in one scan each.

    entries is (entry, kind, rule, quantile); signals is (entry, date, ticker, value);
    metadata is (entry, raw, signal_digest), the text of meta.json and the SHA-256 of the
    signal file, null where that file is missing.
    """
    root = root.rstrip("/")
    raw = _metadata(spark, root)
    files = spark.read.format("binaryFile").load(f"{root}/*/signal.parquet").select(_folder(F.col("path")).alias("entry"), F.sha2("content", 256).alias("signal_digest"))
    return _entries_of(raw), signals_from(spark, [f"{root}/*/signal.parquet"]), raw.join(files, "entry", "full")


def signal_columns(spark: SparkSession, root: str) -> DataFrame:
    """(entry, columns, kinds): the column names and types of every signal file under ``root``, read from its footer where the file is read."""

    def run(batches):
        for batch in batches:
            found = [pq.read_schema(pa.BufferReader(x)) for x in batch["content"]]
            yield pd.DataFrame({"entry": batch["entry"], "columns": [s.names for s in found], "kinds": [[str(t) for t in s.types] for s in found]})

    files = spark.read.format("binaryFile").load(f"{root.rstrip('/')}/*/signal.parquet").select(_folder(F.col("path")).alias("entry"), "content")
    return files.mapInPandas(run, "entry string, columns array<string>, kinds array<string>")


def find_root(start: str | None = None, marker: str = "submissions") -> str:
    """The project's folder: what PLUMBLINE_ROOT names, else the nearest folder from ``start`` up that holds ``marker``, else ``start``."""
    here = Path(start or ".").resolve()
    return os.environ.get("PLUMBLINE_ROOT") or str(next((p for p in (here, *here.parents) if (p / marker).exists()), here))


def load_membership(spark: SparkSession, path: str) -> DataFrame:
    """(date, tickers array) of a CSV of change dates with comma-separated tickers; gzip is read as it is."""
    rows = spark.read.option("header", True).schema("date date, tickers string").csv(path)
    names = F.filter(F.transform(F.split("tickers", ","), lambda x: F.trim(x)), lambda x: x != "")
    return rows.select("date", names.alias("tickers"))


def load_spans(spark: SparkSession, path: str) -> DataFrame:
    """(ticker, start_date, end_date); a ticker may repeat and an end may be null."""
    return spark.read.option("header", True).schema(SPANS).csv(path)


def load_aliases(spark: SparkSession, path: str) -> DataFrame:
    """(ticker, alias, history_from, note) of a JSON object keyed by ticker; its notes are left out."""
    raw = spark.read.text(path, wholetext=True)
    keys = raw.select(F.explode(F.json_object_keys("value")).alias("ticker"), "value").where(~F.col("ticker").isin(*ALIAS_NOTES))
    one = F.from_json(F.call_function("get_json_object", F.col("value"), F.concat(F.lit("$['"), F.col("ticker"), F.lit("']"))), "alias string, history_from string, note string")
    return keys.select("ticker", one.alias("a")).select("ticker", "a.*")


def load_vendor_series(spark: SparkSession, path: str, least_rows: int = LEAST_VENDOR_ROWS) -> DataFrame:
    """Adjusted daily prices of a vendor's cached CSV files, one per ticker; short files are left out.

    The file's name is the ticker and the first ten characters of its date the day.
    """
    rows = spark.read.option("header", True).csv(path)  # by column name, as text; cast below
    ticker = F.regexp_extract("_metadata.file_name", r"^(.*?)\.csv", 1)
    named = rows.select(F.to_date(F.substring("date", 1, 10)).alias("date"), ticker.alias("ticker"), *(number(F.col(f"adj{c.capitalize()}")).alias(c) for c in ("open", "high", "low", "close", "volume")))
    enough = named.groupBy("ticker").count().where(F.col("count") >= least_rows).select("ticker")
    return named.join(enough, "ticker", "left_semi")


def pending(wanted: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """What a resumed sweep still has to do."""
    return wanted.join(done.select(*keys).distinct(), list(keys), "left_anti")

"""Writers: signal files, manifests, board files and series for the web."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.lineage import settled
from plumbline.operators.features import BENCHMARKS, actual_returns, bar_returns_of, feature_panel
from plumbline.panel import finite

#: Decimal places of the exported series.
PLACES = {"gross": 10, "turnover": 8, "short_exposure": 8}


def write_signals(signals: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Date, Ticker, value as 32-bit floats in zstd parquet; values that are not finite are left out."""
    rows = signals.where(finite(F.col("value"))).select(F.col("date").cast("timestamp_ntz").alias("Date"), F.col("ticker").alias("Ticker"), F.col("value").cast("float").alias("value"))
    rows.write.mode(mode).option("compression", "zstd").parquet(path)


def write_entries(signals: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """All entries at once, a folder for each (``entry=...``), which later reads prune by."""
    rows = signals.where(finite(F.col("value"))).select("entry", "date", "ticker", F.col("value").cast("float").alias("value"))
    rows.repartition("entry").write.mode(mode).option("compression", "zstd").partitionBy("entry").parquet(path)


def digests(spark: SparkSession, path: str | list[str], inside: str | None = None) -> DataFrame:
    """(path, bytes, sha256) of every file, hashed where it is read; with ``inside`` of the files of that pattern in all folders below."""
    files = spark.read.format("binaryFile")
    if inside:
        files = files.option("recursiveFileLookup", "true").option("pathGlobFilter", inside)
    return files.load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def manifest(spark: SparkSession, files: dict[str, DataFrame], path: str) -> DataFrame:
    """(file, sha256, rows, last_date) of the named files under ``path``.

    Of a file that Spark wrote as a folder, the digest is that of its parts' digests in order of their names.
    """
    each = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path.rstrip("/"))
    inside = F.split(F.substring_index(F.col("path"), path.rstrip("/") + "/", -1), "/")
    named = each.select(inside[0].alias("file"), F.struct("path", F.sha2("content", 256).alias("own"), F.size(inside).alias("depth")).alias("p"))
    whole = named.groupBy("file").agg(F.array_sort(F.collect_list("p")).alias("p"))
    hashes = whole.select("file", F.when((F.size("p") == 1) & (F.col("p")[0]["depth"] == 1), F.col("p")[0]["own"]).otherwise(F.sha2(F.array_join("p.own", ","), 256)).alias("sha256"))
    facts = None
    for name, df in files.items():
        date = next(c for c in df.columns if c.lower() == "date")
        one = df.agg(F.lit(name).alias("file"), F.count("*").alias("rows"), F.max(F.col(date).cast("date")).alias("last_date"))
        facts = one if facts is None else facts.unionByName(one)
    return facts.join(hashes, "file", "left")


def _with_digest(raw: pd.Series, digest: pd.Series) -> pd.Series:
    def one(text: str, own: str | None) -> str | None:
        try:
            known = json.loads(text)
        except (TypeError, ValueError):
            return None
        return json.dumps({**known, "signal_sha256": own}, indent=2) if isinstance(known, dict) and own else None

    return pd.Series([one(t, d) for t, d in zip(raw, digest, strict=True)], dtype=object)


def pinned(metadata: DataFrame) -> DataFrame:
    """(entry, raw): the metadata text with the digest of its signal file as signal_sha256.

    Other keys keep their order and content; an old digest is replaced where it stands. Entries
    without a signal file or without readable metadata are left out. One short text per entry.
    """
    digested = F.pandas_udf(_with_digest, "string")("raw", "signal_digest")
    return metadata.select("entry", digested.alias("raw")).where("raw is not null")


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    files, p = _file_system(spark, path)
    return files.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder in whatever file system it is."""
    files, p = _file_system(spark, path)
    files.delete(p, True)


def rename_parts(spark: SparkSession, parts: str, key: str, folder: str, ending: str) -> None:
    """Gives the one file of each partition ``key=value`` under ``parts`` the name value + ``ending`` in ``folder``; one rename for each value."""
    files, made = _file_system(spark, parts)
    _, there = _file_system(spark, folder)
    files.mkdirs(there)
    for part in files.listStatus(made):
        name = part.getPath().getName()
        if name.startswith(f"{key}="):
            found = next(f.getPath() for f in files.listStatus(part.getPath()) if f.getPath().getName().startswith("part-"))
            files.rename(found, _file_system(spark, f"{folder}/{name.removeprefix(f'{key}=')}{ending}")[1])


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file, in any file system that Spark knows."""
    files, p = _file_system(spark, path)
    out = files.create(p, True)
    try:
        out.write(bytearray(text, "utf-8"))
    finally:
        out.close()


def write_pinned(spark: SparkSession, metadata: DataFrame, root: str) -> int:
    """Writes the pinned metadata of all entries into their folders; returns how many."""
    rows = pinned(metadata).collect()
    for r in rows:
        write_text(spark, f"{root.rstrip('/')}/{r['entry']}/meta.json", r["raw"])
    return len(rows)


def write_submission(signals: DataFrame, root: str, name: str, rule: str, description: str, registered: str, kind: str = "predictions", **more) -> dict:
    """A submission's folder: signal.parquet, one file as the format asks, and meta.json with its digest. Returns the metadata."""
    spark, folder = signals.sparkSession, f"{root.rstrip('/')}/{name}"
    parts, target = f"{folder}/_parts", f"{folder}/signal.parquet"
    write_signals(signals.coalesce(1), parts, "overwrite")
    files, made = _file_system(spark, parts)
    found = next(s.getPath() for s in files.listStatus(made) if s.getPath().getName().startswith("part-"))
    _, there = _file_system(spark, target)
    files.delete(there, True)
    if not files.rename(found, there):
        raise OSError(f"{target} could not be written")
    files.delete(made, True)
    meta = {"name": name, "kind": kind, "rule": rule, "registered": registered, "description": description, "signal_sha256": digests(spark, target).first()["sha256"], **more}
    write_text(spark, f"{folder}/meta.json", json.dumps(meta, indent=2))
    return meta


def write_market_data(spark: SparkSession, prices: DataFrame, market: DataFrame, root: str, start: str = "2022-01-01") -> DataFrame:
    """From prices and market context to feature_panel.parquet, actual.parquet, bars.parquet and MANIFEST.json under ``root``; returns the manifest."""
    root = root.rstrip("/")
    panel = settled(feature_panel(prices, market))
    made = {
        "feature_panel.parquet": panel,
        "actual.parquet": actual_returns(panel).where(F.col("date") >= F.lit(start).cast("date")),
        "bars.parquet": bar_returns_of(prices).groupBy("date").pivot("bar", list(BENCHMARKS)).agg(F.first("ret")),
    }
    for name, df in made.items():
        named = df.select(*(F.col(c).alias({"date": "Date", "ticker": "Ticker"}.get(c, c)) for c in df.columns))
        named.write.mode("overwrite").parquet(f"{root}/{name}")
    facts = manifest(spark, {name: spark.read.parquet(f"{root}/{name}") for name in made}, root)
    write_text(spark, f"{root}/MANIFEST.json", json.dumps([r.asDict() for r in facts.orderBy("file").collect()], indent=1, default=str))
    return facts


def web_series(daily: DataFrame, keys: tuple[str, ...] = ("window", "entry")) -> DataFrame:
    """(keys, json): dates and rounded series in order of days, one row per key.

    A row holds one entry's days in one window, some thousands at most.
    """
    rounded = [F.bround(F.coalesce(F.nanvl(F.col(c), F.lit(0.0)), F.lit(0.0)), p).alias(c) for c, p in PLACES.items()]
    rows = daily.select(*keys, F.struct("ordinal", F.col("date").cast("string").alias("date"), *rounded).alias("d")).groupBy(*keys).agg(F.array_sort(F.collect_list("d")).alias("d"))
    field = lambda name: F.transform("d", lambda x: x[name]).alias(name)
    body = F.struct(*map(field, ("date", *PLACES)))
    return rows.select(*keys, F.to_json(body).alias("json"))

"""A board that keeps what it has scored: an entry is scored again only if its file, its rule or its inputs changed.

The daily rows and scores of an entry stand under a key, a digest of all that they follow from: the
signal's digest, the entry's rule, the digests of the returns and bars, the windows and the costs.
A key counts once it is in the list of keys, which is written last; a run that ends before leaves
rows that the next one writes over. The joint test reads the kept rows of all current entries.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.backtest import COST_BPS
from plumbline.operators.scoring import WINDOWS, score
from plumbline.sources.readers import load_entries, signal_files, signals_from
from plumbline.sources.sinks import digests, exists

#: Rows of the list of files: what a signal file looked like when its digest was taken.
FILE = "entry string, length long, modified timestamp, digest string"
KEY = "key string"


def _kept(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def digest_of(spark: SparkSession, path: str | None) -> str:
    """One digest of all files of a table; empty without a path."""
    return "" if path is None else hashlib.sha256("|".join(sorted(r["sha256"] for r in digests(spark, path).select("sha256").collect())).encode()).hexdigest()


def current_files(spark: SparkSession, store: str, root: str) -> dict[str, tuple[str, str]]:
    """{entry: (path, digest)}; only files whose length or time changed since they were listed are read."""
    listed = signal_files(spark, root)
    known = _kept(spark, f"{store}/files", FILE)
    rows = listed.join(known, ["entry", "length", "modified"], "left").groupBy("entry", "path", "length", "modified").agg(F.first("digest", ignorenulls=True).alias("digest")).collect()
    new = [r for r in rows if r["digest"] is None]
    if new:
        found = {r["path"]: r["sha256"] for r in digests(spark, [r["path"] for r in new]).select("path", "sha256").collect()}
        fresh = [(r["entry"], r["length"], r["modified"], found[r["path"]]) for r in new]
        spark.createDataFrame(fresh, FILE).coalesce(1).write.mode("append").parquet(f"{store}/files")
        rows = [r for r in rows if r["digest"] is not None]
        return {r["entry"]: (r["path"], r["digest"]) for r in rows} | {r["entry"]: (r["path"], found[r["path"]]) for r in new}
    return {r["entry"]: (r["path"], r["digest"]) for r in rows}


def _keep(rows: DataFrame, keys: DataFrame, path: str) -> None:
    """A folder for each key; one that is there is written over."""
    rows.join(keys, "entry").repartition("key").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("key").parquet(path)


def kept_scores(
    spark: SparkSession, store: str, root: str, actual: DataFrame, actual_digest: str, windows: dict[str, tuple[str, str]] = WINDOWS, investable: DataFrame | None = None, investable_digest: str = "", cost_bps: float = COST_BPS
) -> tuple[DataFrame, DataFrame, list[str]]:
    """(scores, daily, entries scored now) of all entries under ``root``, as ``scoring.score`` gives them.

    What comes to the driver is a row for each entry. Keys of entries that are gone stay in the
    store and are not read.
    """
    store = store.rstrip("/")
    files = current_files(spark, store, root)
    context = json.dumps([actual_digest, investable_digest, sorted(windows.items()), cost_bps])
    key = lambda r: hashlib.sha256(json.dumps([context, files[r["entry"]][1], r["entry"], r["kind"], r["rule"], r["quantile"]]).encode()).hexdigest()
    rows = [r for r in load_entries(spark, root).collect() if r["entry"] in files]
    keys = {r["entry"]: key(r) for r in rows}
    done = {r["key"] for r in _kept(spark, f"{store}/keys", KEY).where(F.col("key").isin(list(keys.values()))).collect()}
    changed = [r for r in rows if keys[r["entry"]] not in done]
    if changed:
        entries = spark.createDataFrame([tuple(r[c] for c in ("entry", "kind", "rule", "quantile")) for r in changed], "entry string, kind string, rule string, quantile double")
        scores, daily = score(signals_from(spark, [files[r["entry"]][0] for r in changed]), entries, actual, windows, investable, cost_bps)
        own = spark.createDataFrame([(r["entry"], keys[r["entry"]]) for r in changed], "entry string, key string")
        _keep(daily, own, f"{store}/daily")
        _keep(scores, own, f"{store}/scores")
        spark.createDataFrame([(keys[r["entry"]],) for r in changed], KEY).coalesce(1).write.mode("append").parquet(f"{store}/keys")
    held = [spark.read.parquet(f"{store}/{part}").where(F.col("key").isin(list(keys.values()))).drop("key") for part in ("scores", "daily")]
    return held[0], held[1], sorted(r["entry"] for r in changed)

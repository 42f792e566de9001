"""Queries about files: tables written as the library's inputs are, read back by its readers, and facts about them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import validate
from plumbline.functions.sharpe import deflated_sharpe, expected_max_sharpe
from plumbline.lineage import settled, shared_root
from plumbline.plans.contestants import mean_sigmoid_weights
from plumbline.plans.panels import P1, P2, P3, P4, actual_sql, daily_nations, daily_users, momentum, priced, table, weekly_brands, weekly_market, with_target
from plumbline.plans.queries import fine, r, registered, rs
from plumbline.plans.queries_inference import ANNUAL, PAIR_SQL, PHI, pair
from plumbline.plans.queries_universe import MONTHLY_SQL, THINNED, monthly_membership, thinned
from plumbline.sources.readers import load_actual, load_bars, load_membership, load_signal, load_spans, load_vendor_series, pending
from plumbline.sources.sinks import digests, manifest, pinned, remove, rename_parts, write_signals, write_text


def read_back(spark: SparkSession, name: str, write: Callable[[str], object], read: Callable[[str], DataFrame]) -> DataFrame:
    """What ``read`` makes of a folder that ``write`` has filled; the folder is removed once it is read."""
    folder = f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    write(folder)
    out = settled(read(folder))
    remove(spark, folder)
    return out


@registered(f"WITH {P1}, {actual_sql('p1')} SELECT date, ticker, {rs('target')} FROM a")
def actual_read_back(spark, sf):
    """Returns written with the columns' names in capitals and a timestamp, as files have them."""
    a = with_target(weekly_brands(spark, sf)).select(F.col("date").cast("timestamp_ntz").alias("Date"), F.col("ticker").alias("Ticker"), "target")
    return read_back(spark, "actual", a.write.parquet, lambda p: load_actual(spark, p)).select("date", "ticker", r("target"))


@registered(f"WITH {P1}, s AS (SELECT date, ticker, CAST(close / nullif(lag(close, 2) OVER (PARTITION BY ticker ORDER BY date), 0) - 1 AS FLOAT) AS value FROM p1) SELECT 'm2' AS entry, date, ticker, round(CAST(value AS DOUBLE), 4) + 0.0 AS value FROM s WHERE isfinite(value)")
def signal_read_back(spark, sf):
    rows = momentum(weekly_brands(spark, sf), 2, "m2").select("date", "ticker", "value")
    return read_back(spark, "signal", lambda p: write_signals(rows, p), lambda p: load_signal(spark, p, "m2")).select("entry", "date", "ticker", r("value", places=4))


@registered(f"WITH {P4}, w AS (SELECT date, 0.02::DOUBLE * ln(vix / lag(vix) OVER (ORDER BY date)) AS RSP, CASE WHEN month(date) > 3 THEN treasury_10y / 1e7 END AS CASH FROM p4) SELECT date, 'RSP' AS bar, round(RSP, 9) + 0.0 AS ret FROM w WHERE RSP IS NOT NULL UNION ALL SELECT date, 'CASH', round(CASH, 9) + 0.0 FROM w WHERE CASH IS NOT NULL")
def bars_read_back(spark, sf):
    """One column for each bar in the file, one row for each in the panel, without what is missing."""
    before = F.expr("lag(vix) OVER (ORDER BY date)")
    wide = weekly_market(spark, sf).select(F.col("date").cast("timestamp_ntz").alias("Date"), (0.02 * F.ln(F.col("vix") / before)).alias("RSP"), F.when(F.month("date") > 3, F.col("treasury_10y") / 1e7).alias("CASH"))
    return read_back(spark, "bars", wide.write.parquet, lambda p: load_bars(spark, p)).select("date", "bar", r("ret", places=9))


@registered(f"WITH {THINNED}, {MONTHLY_SQL.format('t2')} SELECT date, unnest(tickers) AS ticker FROM m")
def membership_read_back(spark, sf):
    """Changes of membership as a compressed CSV of dates and lists of names."""
    rows = monthly_membership(thinned(spark, sf)).select("date", F.array_join(F.array_sort("tickers"), ", ").alias("tickers"))
    return read_back(spark, "members", lambda p: rows.write.csv(p, header=True, compression="gzip"), lambda p: load_membership(spark, p)).select("date", F.explode("tickers").alias("ticker"))


@registered(f"WITH {THINNED}, s AS (SELECT ticker, quarter(date) AS q, min(date) AS start_date, CASE WHEN quarter(date) < 4 THEN max(date) END AS end_date FROM t2 GROUP BY 1, 2) SELECT ticker, start_date, coalesce(end_date, DATE '2100-01-01') AS end_date FROM s")
def spans_read_back(spark, sf):
    """Names with first and last days, some without a last one."""
    rows = thinned(spark, sf).groupBy("ticker", F.quarter("date").alias("q")).agg(F.min("date").alias("start_date"), F.max("date").alias("end_date"))
    rows = rows.select("ticker", "start_date", F.when(F.col("q") < 4, F.col("end_date")).alias("end_date"))
    return read_back(spark, "spans", lambda p: rows.write.csv(p, header=True), lambda p: load_spans(spark, p)).withColumn("end_date", F.coalesce("end_date", F.to_date(F.lit("2100-01-01"))))


@registered(f"WITH {P2}, o AS (SELECT * FROM p2 WHERE ticker <> 'CHINA' OR date < DATE '1992-06-01') SELECT date, replace(ticker, ' ', '_') AS ticker, {rs('low AS open', 'high', 'low', 'close', 'volume', places=9)} FROM o WHERE ticker IN (SELECT ticker FROM o GROUP BY 1 HAVING count(*) >= 250)")
def vendor_series_read_back(spark, sf):
    """A vendor's cached files, one for each name; a name with a short history is left out."""
    p = daily_nations(spark, sf).where("ticker != 'CHINA' or date < '1992-06-01'")
    adjusted = {"adjOpen": "low", "adjHigh": "high", "adjLow": "low", "adjClose": "close", "adjVolume": "volume"}
    rows = p.select(F.translate("ticker", " ", "_").alias("ticker"), F.concat(F.col("date").cast("string"), F.lit("T00:00:00.000Z")).alias("date"), *(F.col(c).alias(a) for a, c in adjusted.items()))

    def write(folder: str) -> None:
        rows.repartition("ticker").write.partitionBy("ticker").csv(f"{folder}/parts", header=True)
        rename_parts(spark, f"{folder}/parts", "ticker", f"{folder}/cache", ".csv")

    return read_back(spark, "vendor", write, lambda p: load_vendor_series(spark, f"{p}/cache")).select("date", "ticker", *fine("open", "high", "low", "close", "volume"))


@registered(f"WITH {P1}, {actual_sql('p1')} SELECT 'actual.parquet' AS file, count(*) AS rows, max(date) AS last_date FROM a UNION ALL SELECT 'market.parquet', count(*), max(date) FROM (SELECT DISTINCT CAST(date_trunc('week', o_orderdate) AS DATE) AS date FROM orders)")
def manifest_facts(spark, sf):
    """Rows and last days of the files of a folder, of which each has its digest."""
    files = {"actual.parquet": priced(weekly_brands(spark, sf)).select("date", "ticker", "target"), "market.parquet": weekly_market(spark, sf)}

    def write(folder: str) -> None:
        for name, df in files.items():
            df.write.parquet(f"{folder}/{name}")

    found = read_back(spark, "manifest", write, lambda p: manifest(spark, {name: spark.read.parquet(f"{p}/{name}") for name in files}, p))
    return found.where(F.length("sha256") == 64).select("file", "rows", "last_date")


@registered("SELECT CAST(octet_length(encode(t)) AS BIGINT) AS bytes, sha256(t) AS sha256 FROM (SELECT string_agg(n_name || ':' || n_regionkey::VARCHAR, chr(10) ORDER BY n_nationkey) AS t FROM nation) UNION ALL SELECT CAST(octet_length(encode(t)) AS BIGINT), sha256(t) FROM (SELECT string_agg(r_name, ',' ORDER BY r_regionkey) AS t FROM region)")
def file_digests(spark, sf):
    """Sizes and digests of files, hashed where they are read."""
    lines = lambda name, key, text, by: table(spark, sf, name).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, F.expr(text).alias("t")))), lambda s: s["t"]), by).alias("t")).first()["t"]
    texts = {"nations.txt": lines("nation", "n_nationkey", "concat(n_name, ':', n_regionkey)", "\n"), "regions.txt": lines("region", "r_regionkey", "r_name", ",")}
    return read_back(spark, "digests", lambda p: [write_text(spark, f"{p}/{name}", t) for name, t in texts.items()], lambda p: digests(spark, p)).select("bytes", "sha256")


#: Metadata of one entry for each supplier, with a fault by the remainder of its key.
FAULTS = {0: '"kind": "predictions"', 1: '"kind": "guess"', 2: '"kind": "weights", "quantile": 0.7', 3: '"kind": "weights", "rule": "other"', 4: '"kind": "predictions", "registered": "soon"'}


def entry_metadata(spark: SparkSession, sf: str) -> DataFrame:
    """(entry, raw, signal_digest)."""
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("entry"), (F.col("s_suppkey") % 5).alias("k"), F.sha2(F.col("s_name"), 256).alias("own"), (F.col("s_suppkey") % 7 == 0).alias("gone"))
    fault = F.element_at(F.create_map(*(F.lit(x) for k, v in FAULTS.items() for x in (k, v))), F.col("k").cast("int"))
    registered_on = F.when(F.col("k") == 4, "").otherwise(', "registered": "2024-01-01"')
    raw = F.concat(F.lit('{"name": "'), "entry", F.lit('", "description": "d", "source_sha256": "x", '), fault, registered_on, F.lit("}"))
    return s.select("entry", raw.alias("raw"), F.when(~F.col("gone"), F.col("own")).alias("signal_digest"))


@registered("""WITH s AS (SELECT CAST(s_suppkey AS VARCHAR) AS entry, s_suppkey % 5 AS k, s_suppkey % 7 = 0 AS gone FROM supplier)
SELECT entry, 'error' AS level, 'no_signal' AS code FROM s WHERE gone UNION ALL SELECT entry, 'warning', 'signal_not_pinned' FROM s WHERE NOT gone
UNION ALL SELECT entry, 'error', CASE k WHEN 1 THEN 'bad_kind' WHEN 2 THEN 'bad_quantile' WHEN 3 THEN 'bad_rule' ELSE 'bad_registered' END FROM s WHERE k > 0 AND NOT gone""")
def metadata_rules(spark, sf):
    return validate.metadata_findings(entry_metadata(spark, sf)).select("entry", "level", "code")


@registered("SELECT CAST(s_suppkey AS VARCHAR) AS entry, sha256(s_name) AS pinned, 'd' AS description FROM supplier WHERE s_suppkey % 7 <> 0")
def metadata_pinned(spark, sf):
    """The digest of each entry's signal, as its metadata state it once pinned, other keys kept."""
    return pinned(entry_metadata(spark, sf)).select("entry", F.get_json_object("raw", "$.signal_sha256").alias("pinned"), F.get_json_object("raw", "$.description").alias("description"))


@registered(f"WITH {P3} SELECT DISTINCT ticker FROM p3 WHERE ticker NOT IN (SELECT ticker FROM p3 WHERE day(date) = 1 AND volume > 1)")
def resumed_sweep(spark, sf):
    """Names that a sweep still has to fetch: those without several events on the first day of a month."""
    p = daily_users(spark, sf)
    return pending(p.select("ticker").distinct(), p.where("day(date) = 1 and volume > 1"), "ticker")


@registered(f"WITH {P1} SELECT date, ticker, {rs('(1 / (1 + exp(-(close / 1000 - 1))) + 1 / (1 + exp(-(high - low) / 1000)) + 1 / (1 + exp(-(volume / 100 - 1)))) / 3 / count(*) OVER (PARTITION BY date) AS value')} FROM p1")
def sigmoid_weights(spark, sf):
    """Weights from the scores of three models: the mean of their sigmoids over the day's names."""
    s = weekly_brands(spark, sf).select("date", "ticker", (F.col("close") / 1000 - 1).alias("s1"), ((F.col("high") - F.col("low")) / 1000).alias("s2"), (F.col("volume") / 100 - 1).alias("s3"))
    return mean_sigmoid_weights(s).select("date", "ticker", r("value"))


#: What the best of so many trials with that variance of annualised ratios shows by luck, by the closed form.
TRIALS, TRIAL_VARIANCE = 20, 0.25
LUCK = expected_max_sharpe(TRIALS, TRIAL_VARIANCE)


@registered(f"""WITH {PAIR_SQL}, m AS (SELECT count(*) AS n, avg(x) AS m, stddev_pop(x) AS s FROM xy), c AS (SELECT n, m / s AS sr, avg(pow((x - m) / s, 3)) AS g3, avg(pow((x - m) / s, 4)) AS g4 FROM xy CROSS JOIN m GROUP BY n, m, s),
zz AS (SELECT (sr - {LUCK!r}::DOUBLE / {ANNUAL}) * sqrt(n - 1.0::DOUBLE) / sqrt(greatest(1 - g3 * sr + (g4 - 1) / 4 * sr * sr, 1e-12)) AS z FROM c) SELECT 'momentum' AS entry, {rs(f'{LUCK!r}::DOUBLE AS threshold', f'{PHI} AS dsr')} FROM zz""")
def deflated_sharpe_ratio(spark, sf):
    """The chance that momentum's ratio is above what the best of 20 worthless trials shows."""
    return deflated_sharpe(pair(spark, sf), TRIALS, TRIAL_VARIANCE, "x").select("entry", r("threshold"), r("dsr"))

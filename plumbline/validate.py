"""Checks of submitted entries: one pass gathers facts for all entries, rules turn them into findings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators.backtest import charge, curve, daily_books, shared_days, statistics
from plumbline.operators.crosssection import information_coefficient
from plumbline.operators.positions import GROSS_SLACK, NEGATIVE_SLACK, RULES
from plumbline.operators.scoring import book_of
from plumbline.panel import finite

#: What a submission must state, and where a result stops being plausible.
REQUIRED = ("name", "kind", "description", "registered")
IC_ERROR, IC_WARNING = 0.15, 0.08
SHARPE_ERROR, SHARPE_WARNING = 5.0, 2.5
LEAST_DAYS = 120
FINDING = "entry string, level string, code string, message string"


def _findings(df: DataFrame, rules: Sequence[tuple[str, str, Column, Column]]) -> DataFrame:
    """A row for each rule (level, code, condition, message) whose condition is true."""
    each = [F.when(hit, F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"), message.alias("message"))) for level, code, hit, message in rules]
    return df.select("entry", F.explode(F.array_compact(F.array(*each))).alias("f")).select("entry", "f.*")


def _text(fmt: str, *columns: str) -> Column:
    return F.format_string(fmt, *(F.col(c) for c in columns)) if columns else F.lit(fmt)


def metadata_findings(meta: DataFrame) -> DataFrame:
    """Findings about (entry, raw, signal_digest): the folder's name, the text of its metadata and the digest of its signal file.

    A null raw text or a null digest is a missing file, and nothing more is checked then.
    """
    value = lambda k: F.get_json_object("raw", f"$.{k}")
    readable = F.try_parse_json("raw").isNotNull()
    q, rule = F.coalesce(F.expr("try_cast(get_json_object(raw, '$.quantile') as double)"), F.when(value("quantile").isNull(), F.lit(0.1))), F.coalesce(value("rule"), F.lit("long_flat"))
    m = meta.withColumns({"_both": F.col("raw").isNotNull() & F.col("signal_digest").isNotNull(), "_ok": F.coalesce(readable, F.lit(False))}).withColumns(
        {"_full": F.col("_both") & F.col("_ok"), "_q": q, "_rule": rule, "_name": value("name"), "_digest": value("signal_sha256"), "_kind": F.coalesce(value("kind"), F.lit(""))}
    )
    full = F.col("_full")
    empty = lambda k: F.coalesce(value(k), F.lit("")) == ""
    dated = F.expr("try_to_date(substr(get_json_object(raw, '$.registered'), 1, 10))")
    rules = [
        ("error", "no_metadata", F.col("raw").isNull(), _text("meta.json is missing")),
        ("error", "no_signal", F.col("signal_digest").isNull(), _text("signal.parquet is missing")),
        ("error", "bad_metadata", F.col("_both") & ~F.col("_ok"), _text("meta.json is not valid JSON")),
        *(("error", f"missing_{k}", full & empty(k), _text(f"meta.json does not state '{k}'")) for k in REQUIRED),
        ("error", "bad_kind", full & ~F.col("_kind").isin("predictions", "weights"), _text("kind is neither predictions nor weights")),
        ("error", "bad_rule", full & ~F.col("_rule").isin(*RULES), _text("unknown rule %s", "_rule")),
        ("error", "bad_quantile", full & ~F.coalesce((F.col("_q") > 0) & (F.col("_q") <= 0.5), F.lit(False)), _text("the quantile is not above zero and at most one half")),
        ("error", "bad_name", full & (F.coalesce("_name", F.lit("")) != "") & (F.col("_name") != F.col("entry")), _text("the name %s is not that of the folder", "_name")),
        ("warning", "no_provenance", full & empty("model_sha256") & empty("source_sha256"), _text("neither model_sha256 nor source_sha256 ties the entry to an artifact")),
        ("error", "signal_changed", full & (F.coalesce("_digest", F.lit("")) != "") & (F.col("_digest") != F.col("signal_digest")), _text("the signal file is not the one whose digest the metadata state")),
        ("warning", "signal_not_pinned", full & (F.coalesce("_digest", F.lit("")) == ""), _text("the metadata state no signal_sha256")),
        ("error", "bad_registered", full & ~empty("registered") & dated.isNull(), _text("registered is not a date")),
    ]
    return _findings(m, rules)


def schema_findings(entry: str, schema: T.StructType) -> list[tuple[str, str, str, str]]:
    """Findings about a signal file's columns, which must be exactly Date, Ticker, value."""
    names = schema.fieldNames()
    if names != ["Date", "Ticker", "value"]:
        return [(entry, "error", "bad_columns", f"the columns are {names}, not Date, Ticker, value")]
    out = []
    if not isinstance(schema["Date"].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        out.append((entry, "error", "bad_date", "Date is not a date"))
    if not isinstance(schema["value"].dataType, T.NumericType):
        out.append((entry, "error", "bad_value", "value is not a number"))
    return out


def column_findings(found: DataFrame) -> DataFrame:
    """The same from (entry, columns, kinds), as ``readers.signal_columns`` reads them from all files at once."""
    want = F.array(*map(F.lit, ("Date", "Ticker", "value")))
    right = F.col("columns") == want
    kind = lambda k: F.coalesce(F.col("kinds")[k], F.lit(""))
    return _findings(
        found,
        [
            ("error", "bad_columns", ~right, F.concat(F.lit("the columns are "), F.array_join("columns", ", "), F.lit(", not Date, Ticker, value"))),
            ("error", "bad_date", right & ~kind(0).rlike("^(timestamp|date)"), _text("Date is not a date")),
            ("error", "bad_value", right & ~kind(2).rlike("^(u?int|halffloat|float|double|decimal)"), _text("value is not a number")),
        ],
    )


def signal_facts(signals: DataFrame) -> DataFrame:
    """One row per entry: rows, days, tickers, window, duplicates, values that are no numbers, and daily extremes.

    Rows are first reduced by (entry, date), where the day's names and distinct values are
    counted, then by entry; both steps combine before the shuffle.
    """
    per_key = signals.groupBy("entry", "date", "ticker").agg(F.count("*").alias("n"), F.count_if(~finite(F.col("value"))).alias("bad"), F.min("value").alias("low"), F.max(F.abs("value")).alias("size"), F.first("value").alias("value"))
    per_day = per_key.groupBy("entry", "date").agg(
        F.sum("n").alias("rows"), F.sum(F.col("n") - 1).alias("duplicates"), F.sum("bad").alias("bad"), F.count("value").alias("names"), F.countDistinct("value").alias("distinct"),
        F.min("low").alias("least"), F.sum("size").alias("gross"),
    )
    per_entry = per_day.groupBy("entry").agg(
        F.sum("rows").alias("rows"), F.count("*").alias("days"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.sum("duplicates").alias("duplicates"), F.sum("bad").alias("not_finite"),
        F.min("least").alias("least_value"), F.max("gross").alias("max_gross"), F.median("names").alias("median_names"), F.median("distinct").alias("median_distinct"),
        F.median(F.col("distinct") / F.nullif(F.col("names"), F.lit(0))).alias("distinct_share"),
    )
    tickers = per_key.select("entry", "ticker").distinct().groupBy("entry").agg(F.count("*").alias("tickers"))
    return per_entry.join(tickers, "entry")


def signal_findings(facts: DataFrame, entries: DataFrame) -> DataFrame:
    """Findings about the rows of the signals; duplicates are reported, never a crash."""
    f = facts.join(entries.select("entry", "kind", "rule", "quantile"), "entry")
    weights, ranked = F.col("kind") == "weights", F.col("rule").isin("long_top", "long_short")
    return _findings(
        f,
        [
            ("error", "duplicates", F.col("duplicates") > 0, _text("%d duplicated rows", "duplicates")),
            ("error", "not_finite", F.col("not_finite") > 0, _text("%d values are missing or infinite", "not_finite")),
            ("error", "short_record", F.col("days") < LEAST_DAYS, _text(f"%d days, under the {LEAST_DAYS} that are needed", "days")),
            ("error", "short_weights", weights & (F.col("rule") != "long_short") & (F.col("least_value") < -NEGATIVE_SLACK), _text("negative weights need the rule long_short")),
            ("error", "leverage", weights & (F.col("max_gross") > 1 + GROSS_SLACK), _text("gross exposure reaches %.3f", "max_gross")),
            ("warning", "coarse_signal", ranked & (F.col("distinct_share") < 2 * F.col("quantile")), _text("too few distinct values to pick a tail cleanly; ties go by ticker")),
        ],
    )


def plausibility_facts(signals: DataFrame, entries: DataFrame, actual: DataFrame) -> DataFrame:
    """(entry, ic, net_sharpe, annual_turnover) of entries whose rows are sound."""
    ic = information_coefficient(signals, actual).select("entry", "ic")
    stats = statistics(curve(charge(daily_books(book_of(signals, entries, actual), shared_days(signals, actual)))))
    return stats.select("entry", "net_sharpe", "annual_turnover").join(ic, "entry", "left")


def plausibility_findings(facts: DataFrame) -> DataFrame:
    size = F.abs("ic")
    return _findings(
        facts,
        [
            ("error", "ic_implausible", size >= IC_ERROR, _text("information coefficient %+.3f: the signal has seen the answer", "ic")),
            ("warning", "ic_high", (size >= IC_WARNING) & (size < IC_ERROR), _text("information coefficient %+.3f is worth a second look", "ic")),
            ("error", "sharpe_implausible", F.col("net_sharpe") >= SHARPE_ERROR, _text("net Sharpe %.2f is a bug, not a result", "net_sharpe")),
            ("warning", "sharpe_high", (F.col("net_sharpe") >= SHARPE_WARNING) & (F.col("net_sharpe") < SHARPE_ERROR), _text("net Sharpe %.2f needs an explanation", "net_sharpe")),
        ],
    )


def validate(signals: DataFrame, entries: DataFrame, actual: DataFrame | None = None) -> DataFrame:
    """All findings about the rows of all entries; plausibility only of those without an error."""
    structure = signal_findings(signal_facts(signals), entries)
    if actual is None:
        return structure
    bad = structure.where("level = 'error'").select("entry").distinct()
    sound = signals.join(bad, "entry", "left_anti")
    return structure.unionByName(plausibility_findings(plausibility_facts(sound, entries, actual)))


def verdicts(findings: DataFrame, entries: DataFrame) -> DataFrame:
    """(entry, errors, warnings, passed) of every entry."""
    n = findings.groupBy("entry").agg(F.count_if(F.col("level") == "error").alias("errors"), F.count_if(F.col("level") == "warning").alias("warnings"))
    out = entries.select("entry").join(n, "entry", "left")
    return out.select("entry", F.coalesce("errors", F.lit(0)).alias("errors"), F.coalesce("warnings", F.lit(0)).alias("warnings"), (F.coalesce("errors", F.lit(0)) == 0).alias("passed"))


def first_problem(findings: DataFrame) -> DataFrame:
    """(entry, level, code): the gravest finding of each entry, errors first, then by code."""
    w = Window.partitionBy("entry").orderBy("level", "code")
    return findings.withColumn("_at", F.row_number().over(w)).where("_at = 1").select("entry", "level", "code")

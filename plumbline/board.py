"""The board: all submissions scored in all windows, tested jointly, ranked and rendered.

Only finished rows, one for each entry and window, come to the driver.
"""

from __future__ import annotations

import json
import math
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.board_store import digest_of, kept_scores
from plumbline.functions.inference import board_summary, joint_sharpe_tests, separate_sharpe_tests
from plumbline.lineage import settled
from plumbline.operators.backtest import COST_BPS
from plumbline.operators.scoring import LEAST_INVESTABLE_DAYS, WINDOWS, pairs_of, score
from plumbline.sources.readers import load_actual, load_bars, load_submissions
from plumbline.sources.sinks import digests

INVESTABLE = "RSP"
FORMATS = {"f2": "{:+.2f}", "f3": "{:.3f}", "pct": "{:+.1%}", "pct1": "{:.1%}", "int": "{:,.0f}", "t": "{:.1f}x", "usd": "{:+,.0f}"}


def shown(x: float | None, kind: str = "f2") -> str:
    """The number as text; nothing for a missing or infinite one."""
    return "" if x is None or not math.isfinite(x) else FORMATS[kind].format(x)


def index_edges(daily: DataFrame, window: str, reps: int) -> DataFrame:
    """(entry, edge, interval and verdict against the investable index) of entries with enough of its days.

    Each entry is tested by itself, on its own days and with its own block length.
    """
    long_only = pairs_of(daily, window, "investable")
    enough = long_only.groupBy("entry").count().where(F.col("count") >= LEAST_INVESTABLE_DAYS).select("entry")
    tests = separate_sharpe_tests(long_only.join(enough, "entry", "left_semi"), reps, seed=1)
    return tests.select("entry", F.col("net_edge").alias("edge_vs_investable"), F.col("ci_low").alias("ci_low_vs_investable"), F.col("ci_high").alias("ci_high_vs_investable"), F.col("clears_bar").alias("clears_investable"))


def build(spark: SparkSession, actual: DataFrame, entries: DataFrame, signals: DataFrame, windows: dict[str, tuple[str, str]] = WINDOWS, investable: DataFrame | None = None, reps: int = 2000, seed: int = 0, cost_bps: float = COST_BPS) -> tuple[DataFrame, list[dict]]:
    """(rows, summaries): a row per entry and window with statistics and test results, and one summary per window.

    The daily series are settled once and serve the scores and all tests. Entries that break
    the contract raise ValueError.
    """
    scores, daily = score(signals, entries, actual, windows, investable, cost_bps)
    return tested(scores, daily, windows, investable is not None, reps, seed)


def tested(scores: DataFrame, daily: DataFrame, windows: dict[str, tuple[str, str]], against_index: bool, reps: int = 2000, seed: int = 0) -> tuple[DataFrame, list[dict]]:
    """(rows, summaries) from scores and daily rows, made now or kept."""
    rows, summaries = None, []
    for window in windows:
        pairs = pairs_of(daily, window)
        if pairs.isEmpty():
            continue
        tests = settled(joint_sharpe_tests(pairs, reps, seed=seed))
        summaries.append({"window": window, **board_summary(tests).first().asDict()})
        own = scores.where(F.col("window") == window).drop("net_edge").join(tests, "entry")
        if against_index:
            own = own.drop("edge_vs_investable").join(index_edges(daily, window, reps), "entry", "left")
        rows = own if rows is None else rows.unionByName(own, allowMissingColumns=True)
    if rows is None:
        raise ValueError("no entry has a signal in any of the windows")
    return rows, summaries


def ranked(rows: DataFrame) -> DataFrame:
    return rows.orderBy("window", F.desc("net_edge"), "entry")


COLUMNS = (
    ("Net Edge", "net_edge", "f2"), ("CI low", "ci_low", "f2"), ("CI high", "ci_high", "f2"), ("p", "p_value", "f3"), ("p adj", "p_value_fwe", "f3"), ("Net Sharpe", "net_sharpe", "f2"), ("Gross Sharpe", "gross_sharpe", "f2"),
    ("Sharpe at 20 bps", "net_sharpe_20bps", "f2"), ("Sharpe at 500 bps borrow", "net_sharpe_borrow_500bps", "f2"), ("Max DD", "max_drawdown", "pct"), ("Turnover/yr", "annual_turnover", "t"), ("Avg exposure", "avg_exposure", "pct1"),
    ("P&amp;L", "dollar_pnl", "usd"), ("Edge vs index", "edge_vs_investable", "f2"),
)


def to_markdown(rows: list[dict], summaries: list[dict], windows: dict[str, tuple[str, str]] = WINDOWS, title: str = "Leaderboard") -> str:
    """HTML tables, one per window, sorted by edge."""
    out = [f"# {title}", ""]
    for s in summaries:
        a, b = windows[s["window"]]
        own = sorted((r for r in rows if r["window"] == s["window"]), key=lambda r: (-r["net_edge"], r["entry"]))
        out += [f"## {s['window']} ({a} to {b})", "", f"{s['n_contestants']} entries, {s['n_live_hypotheses']} of them tested; blocks of {s['block_size']} days, {s['n_boot']} resamples.", "", "<table>"]
        out.append("<tr><th>Entry</th><th>Rule</th><th>Clears bar</th>" + "".join(f"<th>{h}</th>" for h, _, _ in COLUMNS) + "</tr>")
        for r in own:
            rule = r["rule"] + (" vs cash" if r["bar_used"] == "cash" else "")
            cells = "".join(f"<td>{shown(r.get(c), kind)}</td>" for _, c, kind in COLUMNS)
            out.append(f"<tr><td>{r['entry']}</td><td>{rule}</td><td>{'yes' if r['clears_bar_fwe'] else 'no'}</td>{cells}</tr>")
        out += ["</table>", ""]
    return "\n".join(out)


def to_json(rows: list[dict], summaries: list[dict], provenance: dict | None = None, windows: dict[str, tuple[str, str]] = WINDOWS) -> str:
    return json.dumps({"windows": windows, "multiple_testing": summaries, "provenance": provenance or {}, "entries": rows}, default=str, indent=1)


def build_from_files(spark: SparkSession, actual_path: str, submissions: str, bars_path: str | None = None, reps: int = 2000, seed: int = 0, store: str | None = None) -> tuple[str, str]:
    """(JSON, markdown) of the board of all folders under ``submissions``.

    With ``store``, a folder, what was scored before is read from it and only changed entries are scored.
    """
    actual = load_actual(spark, actual_path)
    bars = load_bars(spark, bars_path) if bars_path else None
    investable = bars.where(F.col("bar") == INVESTABLE).select("date", "ret") if bars is not None else None
    if store is None:
        entries, signals, _ = load_submissions(spark, submissions)
        rows, summaries = build(spark, actual, entries, signals, investable=investable, reps=reps, seed=seed)
    else:
        scores, daily, _ = kept_scores(spark, store, submissions, actual, digest_of(spark, actual_path), investable=investable, investable_digest=digest_of(spark, bars_path))
        rows, summaries = tested(scores, daily, WINDOWS, investable is not None, reps, seed)
    found = [r.asDict() for r in ranked(rows).collect()]
    hashes = {r["path"]: r["sha256"] for r in digests(spark, actual_path).collect()}
    provenance = {"generated_at_utc": datetime.now(UTC).isoformat(), "actual": hashes, "submissions": submissions, "seed": seed}
    return to_json(found, summaries, provenance), to_markdown(found, summaries)

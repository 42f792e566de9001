"""Command line: score, board, pbo, validate, members, starter, frozen, rebuild, study."""

from __future__ import annotations

import argparse
import hashlib
import json
import sys
import time
from datetime import date
from pathlib import PurePosixPath

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from plumbline.board import INVESTABLE, build_from_files
from plumbline.functions.inference import METHODS, net_edge
from plumbline.functions.overfit import overfitting_probability
from plumbline.functions.sharpe import deflated_sharpe, sharpe
from plumbline.functions.simulate import Study, study, variant_series
from plumbline.lineage import settled
from plumbline.operators.backtest import charge, daily_books, padded_days
from plumbline.operators.positions import RULES, weights_from_predictions
from plumbline.operators.scoring import pairs_of, score
from plumbline.operators.universe import members_on, require_covered
from plumbline.panel import calendar, lower_names
from plumbline.plans.contestants import predicted_signal, starter_signal
from plumbline.sources.readers import exists, load_actual, load_bars, load_market, load_membership, load_prices, load_signal, load_submissions, signal_columns
from plumbline.sources.sinks import digests, write_market_data, write_pinned, write_submission, write_text
from plumbline.validate import column_findings, metadata_findings, validate, verdicts


def _print(rows: list[dict] | dict) -> None:
    print(json.dumps(rows, indent=1, default=str))


def run_score(spark: SparkSession, a: argparse.Namespace) -> int:
    actual, signals = load_actual(spark, a.actual), load_signal(spark, a.signal, "signal")
    ends = actual.agg(F.min("date").cast("string").alias("a"), F.max("date").cast("string").alias("b")).first()
    windows = {"all": (a.start or ends["a"], a.end or ends["b"])}
    entries = spark.createDataFrame([("signal", a.kind, a.rule, a.quantile)], "entry string, kind string, rule string, quantile double")
    bars = load_bars(spark, a.bars) if a.bars else None
    investable = bars.where(F.col("bar") == INVESTABLE).select("date", "ret") if bars is not None else None
    scores, daily = score(signals, entries, actual, windows, investable, a.cost_bps)
    pairs = pairs_of(daily, "all")
    if pairs.isEmpty():
        raise ValueError("the signal and the returns share no days in that window")
    edge = net_edge(pairs, a.method, a.n_boot)
    shared = [c for c in scores.columns if c in edge.columns and c != "entry"]
    _print(scores.drop(*shared).join(edge, "entry").first().asDict() | {"window": windows["all"]})
    return 0


def run_board(spark: SparkSession, a: argparse.Namespace) -> int:
    text, page = build_from_files(spark, a.actual, a.submissions, a.bars, a.n_boot, a.seed, a.store)
    for path, body in ((f"{a.out}.json", text), (f"{a.out}.md", page)):
        write_text(spark, path, body)
    return 0


def variant_name(path: str) -> str:
    p = PurePosixPath(path)
    return p.parent.name if p.stem == "signal" else p.stem


def run_pbo(spark: SparkSession, a: argparse.Namespace) -> int:
    actual = load_actual(spark, a.actual)
    signals = None
    for path in a.signals:
        one = load_signal(spark, path, variant_name(path))
        signals = one if signals is None else signals.unionByName(one)
    days = padded_days(signals, actual)
    series = charge(daily_books(weights_from_predictions(signals, actual, a.rule, a.quantile), days)).select(F.col("entry").alias("variant"), "ordinal", F.col("net").alias("ret")).persist()
    n = calendar(actual).count()
    ratios = series.groupBy("variant").agg(sharpe("ret").alias("sharpe")).orderBy(F.desc("sharpe"), "variant")
    best, spread = ratios.first(), ratios.agg(F.var_samp("sharpe").alias("v")).first()["v"]
    dsr = deflated_sharpe(series.where(F.col("variant") == best["variant"]), len(a.signals), spread or 0.0, "ret", ("variant",)).first()
    out = overfitting_probability(series, n, a.splits).first().asDict()
    _print(out | {"best": best["variant"], "best_sharpe": best["sharpe"], "deflated_sharpe": dsr["dsr"], "sharpe_the_search_alone_would_give": dsr["threshold"]})
    if out["pbo"] > 0.4:
        print("At this probability the best variant is about what the search alone would give.", file=sys.stderr)
    return 0


def run_validate(spark: SparkSession, a: argparse.Namespace) -> int:
    root, only = a.submissions.rstrip("/"), None
    if exists(spark, f"{root}/meta.json") or exists(spark, f"{root}/signal.parquet"):
        root, only = str(PurePosixPath(root).parent), PurePosixPath(root).name
    entries, signals, meta = load_submissions(spark, root)
    columns = signal_columns(spark, root)
    if only:
        entries, signals, meta, columns = (df.where(F.col("entry") == only) for df in (entries, signals, meta, columns))
    if a.write_hash:
        print(f"wrote the digests of {write_pinned(spark, meta, root)} signal files", file=sys.stderr)
        meta = load_submissions(spark, root)[2]
        meta = meta.where(F.col("entry") == only) if only else meta
    misshapen = settled(column_findings(columns))
    # What has other columns cannot be checked by row.
    broken = misshapen.where("code = 'bad_columns'").select("entry").distinct()
    sound = signals.join(broken, "entry", "left_anti")
    found = metadata_findings(meta).unionByName(misshapen).unionByName(validate(sound, entries, load_actual(spark, a.actual) if a.actual else None))
    rows = [r.asDict() for r in found.orderBy("entry", "level", "code").collect()]
    if a.json:
        passed = {r["entry"]: r["passed"] for r in verdicts(found, entries).collect()}
        _print([{"entry": e, "passed": ok, "findings": [r for r in rows if r["entry"] == e]} for e, ok in sorted(passed.items())])
    else:
        _print(rows)
    return int(any(r["level"] == "error" for r in rows))


def run_starter(spark: SparkSession, a: argparse.Namespace) -> int:
    signal = starter_signal(load_actual(spark, a.actual), a.signal, ranked=True)
    _print(write_submission(signal, a.out, a.name, a.rule, f"The starter's {a.signal}, ranked within each day.", date.today().isoformat(), author=a.author, source_sha256=f"starter {a.signal}"))
    return 0


def run_frozen(spark: SparkSession, a: argparse.Namespace) -> int:
    """Scores a feature panel with a model that was fitted and saved before, and writes the submission."""
    model, panel = PipelineModel.load(a.model), lower_names(spark.read.parquet(a.panel))
    rows = predicted_signal(model, panel.where(F.col("date") > F.lit(a.after).cast("date")) if a.after else panel, a.name)
    hashes = [r["sha256"] for r in digests(spark, a.model, "part-*").orderBy("path").collect()]
    _print(write_submission(rows, a.out, a.name, a.rule, "A frozen model, scored on every row of the panel.", date.today().isoformat(), model_sha256=hashlib.sha256(",".join(hashes).encode()).hexdigest()))
    return 0


def run_rebuild(spark: SparkSession, a: argparse.Namespace) -> int:
    facts = write_market_data(spark, load_prices(spark, a.prices), load_market(spark, a.market), a.out, a.start)
    _print([r.asDict() for r in facts.orderBy("file").collect()])
    return 0


def run_study(spark: SparkSession, a: argparse.Namespace) -> int:
    sizes = Study(days=a.days, reps=a.n_boot, sims=a.sims, boards=a.boards)
    began = time.monotonic()
    rows = [r.asDict() for r in study(spark, sizes).collect()]
    searched = {}
    for part, edge, lucky in (("noise", 0.0, None), ("one real variant", 0.0015, 3)):
        searched[part] = overfitting_probability(variant_series(spark, 2000, 12, edge=edge, lucky=lucky), 2000, 10).first()["pbo"]
    _print({"rates": rows, "probability_of_overfitting": searched, "minutes": round((time.monotonic() - began) / 60, 2)})
    return 0


def run_members(spark: SparkSession, a: argparse.Namespace) -> int:
    on = members_on(load_membership(spark, a.membership), spark.createDataFrame([(a.date,)], "date string").select(F.col("date").cast("date")))
    names = require_covered(on).select(F.array_sort("tickers").alias("t")).first()["t"]
    _print({"date": a.date, "members": len(names), "tickers": names})
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="plumbline", description=__doc__)
    sub = p.add_subparsers(required=True)

    def command(title, run, **options):
        c = sub.add_parser(title)
        for option, kw in options.items():
            c.add_argument(kw.pop("flag", "--" + option.replace("_", "-")), **kw)
        c.set_defaults(run=run)

    ranks = {"rule": {"choices": RULES, "default": "long_flat"}, "quantile": {"type": float, "default": 0.1}}
    boot = {"n_boot": {"type": int, "default": 2000}}
    command("score", run_score, signal={"flag": "signal"}, actual={"required": True}, kind={"choices": ("predictions", "weights"), "default": "predictions"}, start={}, end={}, cost_bps={"type": float, "default": 10.0}, bars={}, method={"choices": METHODS, "default": METHODS[0]}, **{k: dict(v) for k, v in (ranks | boot).items()})
    command("board", run_board, submissions={"flag": "submissions"}, actual={"required": True}, bars={}, seed={"type": int, "default": 0}, out={"default": "leaderboard"}, store={"help": "a folder that keeps scored entries from run to run"}, **{k: dict(v) for k, v in boot.items()})
    command("pbo", run_pbo, signals={"flag": "signals", "nargs": "+"}, actual={"required": True}, splits={"type": int, "default": 10}, **{k: dict(v) for k, v in ranks.items()})
    command("validate", run_validate, submissions={"flag": "submissions", "help": "the folder of all submissions, or that of one"}, actual={}, write_hash={"action": "store_true"}, json={"action": "store_true"})
    rule = {"choices": RULES, "default": "long_short"}
    command("starter", run_starter, name={"required": True}, signal={"choices": ("reversal", "momentum", "lowvol"), "default": "reversal"}, rule=dict(rule), actual={"required": True}, out={"default": "submissions"}, author={"default": ""})
    command("frozen", run_frozen, name={"required": True}, model={"required": True}, panel={"required": True}, after={}, rule=dict(rule), out={"default": "submissions"})
    command("rebuild", run_rebuild, prices={"required": True}, market={"required": True}, out={"default": "data"}, start={"default": "2022-01-01"})
    sizes = Study()
    command("study", run_study, days={"type": int, "default": sizes.days}, n_boot={"type": int, "default": sizes.reps}, sims={"type": int, "default": sizes.sims}, boards={"type": int, "default": sizes.boards})
    command("members", run_members, date={"flag": "date"}, membership={"required": True})
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    return a.run(spark or SparkSession.builder.appName("plumbline").getOrCreate(), a)


if __name__ == "__main__":
    sys.exit(main())

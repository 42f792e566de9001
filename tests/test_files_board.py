"""Readers, writers, validation, the board, the command line, streaming and contestants."""

import gzip
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline import board, cli, validate
from plumbline.operators import scoring
from plumbline.plans import contestants
from plumbline.sources import readers, sinks
from plumbline.streaming import daily

from .conftest import returns

META = {"kind": "predictions", "description": "d", "registered": "2024-01-01", "model_sha256": {"a": "1"}}


def write(path, pdf, **names):
    path.parent.mkdir(parents=True, exist_ok=True)
    out = pdf.rename(columns={"date": "Date", "ticker": "Ticker"} | names)
    out["Date"] = pd.to_datetime(out["Date"])
    out.to_parquet(path, index=False)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("board")
    a = returns(300, 6, 0, start="2022-01-03")
    write(root / "actual.parquet", a)
    rng = np.random.default_rng(1)
    for name, value, meta in (("always_long", 1.0, {}), ("noise", rng.normal(size=len(a)), {"rule": "long_short", "quantile": 0.2}), ("peek", a["target"].to_numpy(), {})):
        pdf = a[["date", "ticker"]].assign(value=value)
        write(root / "subs" / name / "signal.parquet", pdf)
        (root / "subs" / name / "meta.json").write_text(json.dumps(META | {"name": name} | meta))
    bars = a.groupby("date")["target"].mean().rename("RSP").reset_index().rename(columns={"date": "Date"})
    bars["Date"] = pd.to_datetime(bars["Date"])
    bars.assign(SPY=0.001).to_parquet(root / "bars.parquet", index=False)
    return root


def test_nanosecond_files_are_read_as_dates(spark, folder):
    a = readers.load_actual(spark, str(folder / "actual.parquet"))
    assert dict(a.dtypes) == {"date": "date", "ticker": "string", "target": "double"} and a.count() == 1800
    assert str(a.agg(F.min("date")).first()[0]) == "2022-01-03"
    with pytest.raises(ValueError):
        readers.require_unique(a.union(a), "date", "ticker")
    assert spark.conf.get(readers.NANOS) == "false"
    assert readers.load_bars(spark, str(folder / "none.parquet")) is None
    assert {x.bar for x in readers.load_bars(spark, str(folder / "bars.parquet")).select("bar").distinct().collect()} == {"RSP", "SPY"}


def test_submissions_and_metadata(spark, folder):
    entries, signals, meta = readers.load_submissions(spark, str(folder / "subs"))
    assert {(x.entry, x.rule, x.quantile) for x in entries.collect()} == {("always_long", "long_flat", 0.1), ("noise", "long_short", 0.2), ("peek", "long_flat", 0.1)}
    assert signals.groupBy("entry").count().where("count = 1800").count() == 3
    assert {x.code for x in validate.metadata_findings(meta).collect()} == {"signal_not_pinned"}
    again = sinks.pinned(meta).join(meta.select("entry", "signal_digest"), "entry")
    assert validate.metadata_findings(again).count() == 0
    assert sinks.pinned(again).count() == 3


def test_metadata_rules(spark):
    good = json.dumps(META | {"name": "e", "signal_sha256": "x"})
    bad = json.dumps({"kind": "guess", "rule": "r", "quantile": 0.7, "name": "other", "registered": "soon", "signal_sha256": "y"})
    rows = [("e", good, "x"), ("f", bad, "x"), ("g", None, None), ("h", "{", "x"), ("i", good, None)]
    got = validate.metadata_findings(spark.createDataFrame(rows, "entry string, raw string, signal_digest string")).toPandas().groupby("entry")["code"].apply(set).to_dict()
    assert got == {
        "f": {"missing_description", "bad_kind", "bad_rule", "bad_quantile", "bad_name", "no_provenance", "signal_changed", "bad_registered"},
        "g": {"no_metadata", "no_signal"},
        "h": {"bad_metadata"},
        "i": {"no_signal"},
    }


def test_row_rules(spark):
    a = spark.createDataFrame(returns(130, 12, 3, mean=-0.0005))
    base = a.select("date", "ticker", F.rand(1).alias("value"))
    make = lambda e, df: df.select(F.lit(e).alias("entry"), "date", "ticker", "value")
    signals = (
        make("ok", base).unionByName(make("twice", base.union(base.limit(3)))).unionByName(make("nan", base.withColumn("value", F.when(F.col("ticker") == "S01", F.lit(float("nan"))).otherwise(F.col("value")))))
        .unionByName(make("short", base.where("date < '2022-03-01'"))).unionByName(make("lever", base.withColumn("value", F.lit(0.5)))).unionByName(make("neg", base.withColumn("value", F.lit(-0.01))))
        .unionByName(make("coarse", base.withColumn("value", F.lit(1.0)))).unionByName(make("peek", a.select("date", "ticker", F.col("target").alias("value"))))
    )
    entries = spark.createDataFrame([(e, "weights" if e in ("lever", "neg") else "predictions", "long_short" if e == "coarse" else "long_flat", 0.1) for e in ("ok", "twice", "nan", "short", "lever", "neg", "coarse", "peek")], "entry string, kind string, rule string, quantile double")
    found = validate.validate(signals, entries, a).persist()
    codes = found.toPandas().groupby("entry")["code"].apply(set).to_dict()
    assert codes == {"twice": {"duplicates"}, "nan": {"not_finite"}, "short": {"short_record"}, "lever": {"leverage"}, "neg": {"short_weights"}, "coarse": {"coarse_signal"}, "peek": {"ic_implausible", "sharpe_implausible"}}
    passed = {x.entry for x in validate.verdicts(found, entries).where("passed").collect()}
    assert passed == {"ok", "coarse"}
    assert {x.code for x in validate.first_problem(found).where("entry = 'peek'").collect()} == {"ic_implausible"}


def test_schema_findings(spark):
    ok = spark.createDataFrame([], "Date timestamp, Ticker string, value float").schema
    assert validate.schema_findings("e", ok) == []
    assert [x[2] for x in validate.schema_findings("e", spark.createDataFrame([], "Date string, Ticker string, value string").schema)] == ["bad_date", "bad_value"]
    assert [x[2] for x in validate.schema_findings("e", spark.createDataFrame([], "a int").schema)] == ["bad_columns"]


def test_board_from_files(spark, folder):
    text, page = board.build_from_files(spark, str(folder / "actual.parquet"), str(folder / "subs"), str(folder / "bars.parquet"), reps=99)
    rows = {(r["window"], r["entry"]): r for r in json.loads(text)["entries"]}
    sealed = "sealed_2022_2025"
    assert rows[sealed, "peek"]["clears_bar_fwe"] and rows[sealed, "peek"]["net_sharpe"] > 5
    own = rows[sealed, "always_long"]
    assert own["net_edge"] == 0 and own["p_value"] == 1 and own["bar_used"] == "universe" and own["days"] == 300
    assert rows[sealed, "noise"]["bar_used"] == "cash" and rows[sealed, "noise"]["net_sharpe_borrow_500bps"] < rows[sealed, "noise"]["net_sharpe"]
    assert own["investable_days"] == 300 and rows[sealed, "peek"]["edge_vs_investable"] > 0
    assert "<td>peek</td>" in page and "vs cash" in page
    assert board.shown(None) == board.shown(float("nan")) == "" and board.shown(0.1234, "pct") == "+12.3%" and board.shown(1234567.0, "usd") == "+1,234,567"


def test_silence_is_cash_and_few_index_days_make_no_claim(spark):
    a = spark.createDataFrame(returns(40, 5, 2))
    s = a.where("date < '2022-01-20'").select(F.lit("e").alias("entry"), "date", "ticker", F.lit(1.0).alias("value"))
    entries = spark.createDataFrame([("e", "predictions", "long_flat", 0.1)], "entry string, kind string, rule string, quantile double")
    index = a.where("date < '2022-01-20'").groupBy("date").agg(F.avg("target").alias("ret"))
    scores, d = scoring.score(s, entries, a, {"w": ("2022-01-01", "2022-12-31")}, index)
    one = scores.first()
    assert one["days"] == 40 and one["edge_vs_investable"] is None and one["investable_days"] < 20
    assert d.where("date > '2022-01-21'").agg(F.max(F.abs("net"))).first()[0] == 0


def test_command_line(spark, folder, capsys, tmp_path):
    actual = str(folder / "actual.parquet")
    assert cli.main(["score", str(folder / "subs/always_long/signal.parquet"), "--actual", actual, "--n-boot", "50"], spark) == 0
    out = json.loads(capsys.readouterr().out)
    assert out["net_edge"] == 0 and out["days"] == 300 and out["strategy_sharpe_se"] > 0
    assert cli.main(["pbo", *(str(folder / f"subs/{n}/signal.parquet") for n in ("always_long", "noise", "peek")), "--actual", actual, "--splits", "6"], spark) == 0
    assert json.loads(capsys.readouterr().out)["best"] == "peek"
    assert cli.main(["validate", str(folder / "subs"), "--actual", actual], spark) == 1
    assert {r["code"] for r in json.loads(capsys.readouterr().out) if r["entry"] == "peek"} >= {"sharpe_implausible"}  # six names are too few for an information coefficient
    csv = tmp_path / "members.csv.gz"
    csv.write_bytes(gzip.compress(b'date,tickers\n2020-01-01,"B, A,"\n2021-01-01,"A,C"\n'))
    assert cli.main(["members", "2020-06-01", "--membership", str(csv)], spark) == 0
    assert json.loads(capsys.readouterr().out)["tickers"] == ["A", "B"]
    assert cli.main(["board", str(folder / "subs"), "--actual", actual, "--n-boot", "20", "--out", str(tmp_path / "lb")], spark) == 0
    assert (tmp_path / "lb.md").exists()


def test_reference_tables(spark, tmp_path):
    (tmp_path / "spans.csv").write_text("ticker,start_date,end_date\nA,2020-01-01,\nA,2018-01-01,2019-01-01\n")
    assert readers.load_spans(spark, str(tmp_path / "spans.csv")).where("end_date is null").count() == 1
    (tmp_path / "aliases.json").write_text(json.dumps({"_about": "x", "BRK.B": {"alias": "BRK-B", "history_from": "1996", "note": "n"}}))
    assert [(x.ticker, x.alias) for x in readers.load_aliases(spark, str(tmp_path / "aliases.json")).collect()] == [("BRK.B", "BRK-B")]
    (tmp_path / "v").mkdir()
    rows = [f"2020-01-{d:02d}T00:00:00Z,1,2,3,4,5,{d},9,8,7,6" for d in range(1, 11)]
    head = "date,close,high,low,open,volume,adjClose,adjHigh,adjLow,adjOpen,adjVolume"
    (tmp_path / "v" / "A.csv").write_text("\n".join([head, *rows]))
    (tmp_path / "v" / "B.csv").write_text("\n".join([head, *rows[:2]]))
    got = readers.load_vendor_series(spark, str(tmp_path / "v"), 5).toPandas()
    assert set(got["ticker"]) == {"A"} and len(got) == 10 and got["close"].max() == 10
    done = spark.createDataFrame([("A",)], "ticker string")
    assert readers.pending(spark.createDataFrame([("A",), ("B",)], "ticker string"), done, "ticker").count() == 1


def test_sinks(spark, folder, tmp_path):
    s = spark.createDataFrame([("e", pd.Timestamp("2022-01-03").date(), "A", 0.5), ("e", pd.Timestamp("2022-01-03").date(), "B", float("inf"))], "entry string, date date, ticker string, value double")
    sinks.write_signals(s, str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.columns == ["Date", "Ticker", "value"] and dict(back.dtypes)["value"] == "float" and back.count() == 1
    assert validate.schema_findings("e", back.schema) == []
    sinks.write_entries(s, str(tmp_path / "e"))
    assert spark.read.parquet(str(tmp_path / "e")).where("entry = 'e'").count() == 1
    m = sinks.manifest(spark, {"actual.parquet": readers.load_actual(spark, str(folder / "actual.parquet"))}, str(folder / "*.parquet").rsplit("/", 1)[0] + "/actual.parquet".rsplit("/", 1)[0])
    assert m.first()["rows"] == 1800


def test_stream_equals_batch(spark, tmp_path):
    a = returns(6, 4, 5)
    rows = spark.createDataFrame(a.assign(entry="e", weight=0.25)).select("entry", F.col("date").cast("timestamp").alias("ts"), "ticker", "weight", "target")
    rows.union(rows.limit(2)).coalesce(1).write.parquet(str(tmp_path / "in"))
    books = daily.streamed_books(daily.read_positions(spark, str(tmp_path / "in")))
    daily.write_books(books, str(tmp_path / "out"), str(tmp_path / "check")).start().awaitTermination()
    late = rows.agg(F.lit("e").alias("entry"), (F.max("ts") + F.expr("interval 30 days")).alias("ts"), F.lit("Z").alias("ticker"), F.lit(0.0).alias("weight"), F.lit(0.0).alias("target"))
    late.write.mode("append").parquet(str(tmp_path / "in"))
    daily.write_books(daily.streamed_books(daily.read_positions(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "check")).start().awaitTermination()
    got = spark.read.schema("entry string, start timestamp, gross double, exposure double, gross_exposure double, short_exposure double, positions long").parquet(str(tmp_path / "out")).orderBy("start").toPandas()
    assert np.allclose(got["gross"], a.groupby("date")["target"].mean()) and (got["positions"] == 4).all() and len(got) == 6


def test_contestants(spark):
    a = spark.createDataFrame(returns(90, 6, 8))
    s = contestants.starter_signal(a, "reversal").toPandas().pivot(index="date", columns="ticker", values="value")
    wide = a.toPandas().pivot(index="date", columns="ticker", values="target")
    assert np.allclose(s.dropna(), (-wide.rolling(5).sum()).shift(1).dropna())
    panel = a.withColumns({"f": F.col("target") * 2, "g": F.rand(3)})
    for kind in ("linear", "gbt"):
        p = contestants.predicted_signal(contestants.fit_contestant(panel, ["f", "g"], kind, iterations=3), panel, kind, hold=3)
        assert p.count() == 540 and p.select("value").distinct().count() > 5
    w = contestants.mean_sigmoid_weights(a.select("date", "ticker", *(F.lit(0.0).alias(f"s{k}") for k in (1, 2, 3))))
    assert w.agg(F.max("value")).first()[0] == pytest.approx(0.5 / 6)


def doubled(folder, tmp_path, name):
    pdf = pd.read_parquet(folder / name)
    target = tmp_path / "twice.parquet"
    pd.concat([pdf, pdf.head(1)]).to_parquet(target, index=False)
    return str(target)


def test_files_with_rows_that_repeat_are_refused(spark, folder, tmp_path):
    with pytest.raises(ValueError, match="more than one row"):
        readers.load_actual(spark, doubled(folder, tmp_path, "actual.parquet"))
    with pytest.raises(ValueError, match="more than one row"):
        readers.load_signal(spark, doubled(folder, tmp_path, "subs/noise/signal.parquet"))
    with pytest.raises(ValueError, match="more than one row"):
        cli.main(["pbo", doubled(folder, tmp_path, "subs/noise/signal.parquet"), "--actual", str(folder / "actual.parquet")], spark)


def submission(root, name, pdf, **meta):
    write(root / name / "signal.parquet", pdf)
    (root / name / "meta.json").write_text(json.dumps(META | {"name": name} | meta))


def test_leverage_is_refused_on_every_path(spark, folder, tmp_path):
    a, actual = returns(300, 6, 0, start="2022-01-03"), str(folder / "actual.parquet")
    submission(tmp_path, "lever", a[["date", "ticker"]].assign(value=0.9), kind="weights")
    with pytest.raises(ValueError, match="lever: gross exposure"):
        board.build_from_files(spark, actual, str(tmp_path), reps=10)
    with pytest.raises(ValueError, match="gross exposure"):
        cli.main(["score", str(tmp_path / "lever/signal.parquet"), "--actual", actual, "--kind", "weights", "--n-boot", "10"], spark)


def test_index_edges_do_not_depend_on_the_board(spark, folder):
    actual = readers.load_actual(spark, str(folder / "actual.parquet"))
    entries, signals, _ = readers.load_submissions(spark, str(folder / "subs"))
    bars = readers.load_bars(spark, str(folder / "bars.parquet")).where("bar = 'RSP'").select("date", (F.col("ret") - 0.0003 + 0.001 * F.rand(4)).alias("ret")).persist()
    windows = {"w": ("2022-01-01", "2023-12-31")}
    pick = ["entry", "edge_vs_investable", "ci_low_vs_investable", "ci_high_vs_investable", "clears_investable"]
    whole = board.build(spark, actual, entries, signals, windows, bars, reps=60)[0].select(*pick).toPandas().set_index("entry")
    for name in ("always_long", "peek"):
        alone = board.build(spark, actual, entries.where(F.col("entry") == name), signals.where(F.col("entry") == name), windows, bars, reps=60)[0].select(*pick).toPandas().set_index("entry")
        pd.testing.assert_frame_equal(whole.loc[[name]], alone, check_dtype=False)
        assert alone["ci_low_vs_investable"].iloc[0] <= alone["edge_vs_investable"].iloc[0] <= alone["ci_high_vs_investable"].iloc[0]
    assert np.isnan(whole.loc["noise", "edge_vs_investable"])  # held against cash


def test_pinned_metadata(spark):
    rows = [("a", "{}", "d1"), ("b", '{"signal_sha256": null, "model_sha256": {"x": "1"}}', "d2"), ("c", '{"z": 1, "signal_sha256": "old", "note": "signal_sha256"}', "d3"), ("d", "[", "d4"), ("e", "{}", None), ("f", None, "d6"), ("g", "[1]", "d7")]
    got = {r.entry: json.loads(r.raw) for r in sinks.pinned(spark.createDataFrame(rows, "entry string, raw string, signal_digest string")).collect()}
    assert got == {"a": {"signal_sha256": "d1"}, "b": {"signal_sha256": "d2", "model_sha256": {"x": "1"}}, "c": {"z": 1, "signal_sha256": "d3", "note": "signal_sha256"}}
    assert list(got["c"]) == ["z", "signal_sha256", "note"]


def test_validate_command_reads_columns_and_writes_digests(spark, folder, tmp_path, capsys):
    a, actual = returns(300, 6, 0, start="2022-01-03"), str(folder / "actual.parquet")
    rng = np.random.default_rng(3)
    submission(tmp_path, "fine", a[["date", "ticker"]].assign(value=rng.normal(size=len(a))))
    submission(tmp_path, "four", a[["date", "ticker"]].assign(value=1.0, extra=1))
    assert cli.main(["validate", str(tmp_path / "fine"), "--json"], spark) == 0
    assert json.loads(capsys.readouterr().out)[0]["findings"][0]["code"] == "signal_not_pinned"
    assert cli.main(["validate", str(tmp_path), "--actual", actual, "--write-hash", "--json"], spark) == 1
    got = {r["entry"]: r for r in json.loads(capsys.readouterr().out)}
    assert got["fine"]["passed"] and [f["code"] for f in got["fine"]["findings"]] == [] and [f["code"] for f in got["four"]["findings"]] == ["bad_columns"]
    pdf = a[["date", "ticker"]].assign(value="x").rename(columns={"date": "Date", "ticker": "Ticker"})
    pdf["Date"] = pdf["Date"].astype(str)
    (tmp_path / "text").mkdir()
    pdf.to_parquet(tmp_path / "text" / "signal.parquet", index=False)
    found = validate.column_findings(readers.signal_columns(spark, str(tmp_path))).where("entry = 'text'").collect()
    assert {r.code for r in found} == {"bad_date", "bad_value"}


def test_starter_and_frozen_submissions(spark, folder, tmp_path, capsys):
    actual = str(folder / "actual.parquet")
    assert cli.main(["starter", "--name", "mine", "--actual", actual, "--out", str(tmp_path), "--author", "me"], spark) == 0
    meta = json.loads(capsys.readouterr().out)
    assert meta["rule"] == "long_short" and json.loads((tmp_path / "mine/meta.json").read_text()) == meta
    signal = readers.load_signal(spark, str(tmp_path / "mine/signal.parquet"))
    assert signal.count() == 6 * (300 - 5) and validate.schema_findings("mine", spark.read.parquet(str(tmp_path / "mine/signal.parquet")).schema) == []
    panel = readers.load_actual(spark, actual).withColumns({"f": F.col("target") * 2 + F.rand(1) * 0.01, "g": F.rand(3)})
    panel.select(F.col("date").alias("Date"), F.col("ticker").alias("Ticker"), "f", "g").write.parquet(str(tmp_path / "panel.parquet"))
    contestants.fit_contestant(panel, ["f", "g"]).save(str(tmp_path / "model"))
    assert cli.main(["frozen", "--name", "cold", "--model", str(tmp_path / "model"), "--panel", str(tmp_path / "panel.parquet"), "--after", "2022-06-30", "--out", str(tmp_path)], spark) == 0
    assert len(json.loads(capsys.readouterr().out)["model_sha256"]) == 64
    entries, signals, meta = readers.load_submissions(spark, str(tmp_path))
    assert {r.entry for r in entries.collect()} == {"mine", "cold"} and validate.metadata_findings(meta).count() == 0
    assert str(signals.where("entry = 'cold'").agg(F.min("date")).first()[0]) == "2022-07-01"
    sinks.write_submission(signals.where("entry = 'cold'"), str(tmp_path), "cold", "long_top", "again", "2024-01-01")  # written over
    assert readers.load_submissions(spark, str(tmp_path))[0].where("entry = 'cold' and rule = 'long_top'").count() == 1


def test_rebuilt_data(spark, tmp_path, capsys):
    days = pd.bdate_range("2021-06-01", periods=260)
    rng = np.random.default_rng(5)
    rows = []
    for t in ("A", "B", "SPY", "RSP"):
        close = 100 * np.cumprod(1 + rng.normal(0, 0.01, len(days)))
        rows.append(pd.DataFrame({"Date": days, "Ticker": t, "Open": close, "High": close * 1.01, "Low": close * 0.99, "Close": close, "Volume": rng.integers(1000, 2000, len(days)).astype(float)}))
    pd.concat(rows).to_parquet(tmp_path / "prices.parquet", index=False)
    pd.DataFrame({"Date": days, "vix": rng.uniform(10, 20, len(days)), "treasury_10y": rng.uniform(1, 2, len(days))}).to_parquet(tmp_path / "market.parquet", index=False)
    assert cli.main(["rebuild", "--prices", str(tmp_path / "prices.parquet"), "--market", str(tmp_path / "market.parquet"), "--out", str(tmp_path / "data")], spark) == 0
    facts = {r["file"]: r for r in json.loads(capsys.readouterr().out)}
    assert set(facts) == {"actual.parquet", "bars.parquet", "feature_panel.parquet"} and all(len(r["sha256"]) == 64 for r in facts.values())
    assert json.loads((tmp_path / "data/MANIFEST.json").read_text()) == list(facts.values())
    actual = readers.load_actual(spark, str(tmp_path / "data/actual.parquet"))
    assert {r.ticker for r in actual.select("ticker").distinct().collect()} == {"A", "B"} and actual.count() == facts["actual.parquet"]["rows"]
    assert {r.bar for r in readers.load_bars(spark, str(tmp_path / "data/bars.parquet")).select("bar").distinct().collect()} == {"SPY", "RSP"}


def test_root_is_found(tmp_path, monkeypatch):
    monkeypatch.delenv("PLUMBLINE_ROOT", raising=False)
    (tmp_path / "submissions").mkdir()
    (tmp_path / "a" / "b").mkdir(parents=True)
    assert readers.find_root(str(tmp_path / "a" / "b")) == str(tmp_path.resolve())
    monkeypatch.setenv("PLUMBLINE_ROOT", "/x")
    assert readers.find_root(str(tmp_path)) == "/x"


def test_training_sees_no_later_day(spark):
    a = returns(120, 8, 8)
    rng = np.random.default_rng(2)
    a = a.assign(f=a["target"] + rng.normal(0, 0.01, len(a)), g=rng.normal(size=len(a)))
    days = sorted(a["date"].unique())
    cut_day, later = str(days[59]), a.copy()
    later.loc[later["date"] >= days[59], "target"] *= -5
    for model, choices in (("linear", ({"regParam": 1e-4}, {"regParam": 10.0})), ("gbt", ({"maxIter": 3},)), ("network", ({"maxIter": 5},))):
        val_end = str(days[79]) if len(choices) > 1 else None
        panel = spark.createDataFrame(a)
        got = contestants.trained_signal(panel, ["f", "g"], cut_day, model, val_end, choices, seeds=(0, 1), entry="t").orderBy("date", "ticker").toPandas()
        assert got["date"].min() == days[80 if val_end else 60] and len(got) == 8 * (40 if val_end else 60) and got["value"].nunique() > 5
        if val_end is None:
            again = contestants.trained_signal(spark.createDataFrame(later), ["f", "g"], cut_day, model, val_end, choices, seeds=(0, 1), entry="t").orderBy("date", "ticker").toPandas()
            assert np.allclose(got["value"], again["value"])
    with pytest.raises(ValueError, match="val_end"):
        contestants.trained_signal(panel, ["f"], cut_day, choices=({}, {"regParam": 1.0}))
    with pytest.raises(ValueError, match="unknown model"):
        contestants.learner("other", 2, 0)


def test_sequence_windows(spark):
    a = returns(70, 3, 8)
    a = a.assign(f=a["target"], g=np.arange(len(a)).astype(float))
    got = contestants.sequence_signal(spark.createDataFrame(a), ["f", "g"], lambda w: w[:, :, 0].sum(axis=1) + w[:, -1, 1], n=60, at_once=5).orderBy("ticker", "date").toPandas()
    wide = a.pivot(index="date", columns="ticker", values="target").rolling(60).sum() + a.pivot(index="date", columns="ticker", values="g")
    want = wide.stack().rename("v").reset_index().sort_values(["ticker", "date"])
    assert len(got) == 3 * 11 and np.allclose(got["value"], want["v"])


def test_study_command(spark, capsys):
    assert cli.main(["study", "--days", "100", "--n-boot", "9", "--sims", "2", "--boards", "2"], spark) == 0
    out = json.loads(capsys.readouterr().out)
    assert len(out["rates"]) == 7 and out["probability_of_overfitting"]["one real variant"] <= out["probability_of_overfitting"]["noise"]

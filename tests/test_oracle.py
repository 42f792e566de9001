"""Every registered query against its SQL, and the others for rows and a stable schema."""

import datetime as dt

import duckdb
import pandas as pd
import pytest

from plumbline import lineage
from plumbline.functions import inference
from plumbline.operators import scoring
from plumbline.plans import catalogue, panels

from .compare import assert_same, database
from .conftest import SMALL


@pytest.fixture(scope="module")
def con():
    return database(SMALL)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_same_rows_as_sql(spark, con, name):
    assert_same(catalogue.QUERIES[name](spark, SMALL).toPandas(), con.execute(catalogue.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_gives_rows(spark, name):
    df = catalogue.QUERIES[name](spark, SMALL)
    assert df.count() > 0 and df.columns


@pytest.mark.parametrize("name", ["backtest_daily", "cross_ranks", "pbo_cscv", "weights_long_short"])
def test_partitioning_does_not_matter(spark, name):
    results = []
    for parts in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        results.append(catalogue.QUERIES[name](spark, SMALL).toPandas())
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert_same(*results)


@pytest.mark.parametrize(("name", "most"), [("window_scores", 4), ("pbo_cscv", 2), ("backtest_daily", 2), ("bootstrap_formula_starts", 2), ("joint_stepdown", 2), ("web_export", 4), ("index_scores", 4)])
def test_the_tables_are_scanned_once(spark, monkeypatch, name, most):
    """Scans of files in the query's plan and in those of the panels it settles before."""
    plans = []

    def settled(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return lineage.settled(df)

    for module in (panels, scoring, inference):
        monkeypatch.setattr(module, "settled", settled)
    plans.append(catalogue.QUERIES[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString())
    assert sum(p.count("Relation [") for p in plans) <= most


def test_verdicts_do_not_depend_on_how_much_prices_vary(spark, tmp_path):
    """Prices that are means of many rows hardly move; the answer is still found by its Sharpe ratio."""
    parts = pd.DataFrame({"p_partkey": range(25), "p_brand": [f"Brand#{k}" for k in range(25)]})
    weeks = [dt.datetime(1996, 1, 1) + dt.timedelta(weeks=k) for k in range(130)]
    rows = [(k, 1.0, 100 + (k * k * 7 + w * w * 13 + k * w * 29) % 101 / 1000, d) for w, d in enumerate(weeks) for k in range(25)]
    con = duckdb.connect()
    lineitem = pd.DataFrame(rows, columns=["l_partkey", "l_quantity", "l_extendedprice", "l_shipdate"]).astype({"l_shipdate": "datetime64[us]"})
    for name, frame in (("part", parts), ("lineitem", lineitem)):
        con.register(f"_{name}", frame)
        con.execute(f"COPY _{name} TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
    assert_same(catalogue.QUERIES["validation_verdicts"](spark, str(tmp_path)).toPandas(), database(str(tmp_path)).execute(catalogue.ORACLE_SQL["validation_verdicts"]).df())


def test_files_do_not_decide_between_means_equal_on_paper(spark, tmp_path):
    """(28.64 + 36.51 + 88.18) / 3 is 51.11: added in another order the third day's value comes out above it."""
    values = [(1, 28.64), (1, 36.51), (1, 88.18), (2, 40.0), (3, 51.11), (4, 60.0), (5, 70.0)]
    rows = pd.DataFrame([(k, dt.datetime(2024, 1, d), 7, v) for k, (d, v) in enumerate(values)], columns=["event_id", "ts", "user_id", "value"]).astype({"ts": "datetime64[us]"})
    got = []
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    for name, cuts in (("one", [0, 7]), ("two", [0, 1, 7])):
        folder = tmp_path / name / "events.parquet"
        folder.mkdir(parents=True)
        for a, b in zip(cuts, cuts[1:]):
            rows.iloc[a:b].to_parquet(folder / f"{a}.parquet", index=False)
        got.append(catalogue.QUERIES["weights_long_flat"](spark, str(folder.parent)).toPandas())
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    one = duckdb.connect(config={"threads": 1})
    one.register("events", rows)
    want = one.execute(catalogue.ORACLE_SQL["weights_long_flat"]).df()
    assert_same(got[0], want)
    assert_same(got[1], want)


def test_entry_module_reads_without_corpus_operators():
    import __spark_entry__

    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries())

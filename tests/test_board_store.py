"""A board built again from what was kept: only changed entries are scored, and the board is that of a full run."""

import json
import shutil

import numpy as np
import pytest

from plumbline import board, board_store
from plumbline.sources import readers

from .conftest import returns
from .test_files_board import META, write


@pytest.fixture
def folder(tmp_path):
    a = returns(120, 5, 0, start="2022-01-03")
    write(tmp_path / "actual.parquet", a)
    for k in range(10):
        value = np.random.default_rng(k).normal(size=len(a)) + 0.2 * a["target"].to_numpy() * k
        write(tmp_path / "subs" / f"e{k}" / "signal.parquet", a[["date", "ticker"]].assign(value=value))
        (tmp_path / "subs" / f"e{k}" / "meta.json").write_text(json.dumps(META | {"name": f"e{k}", "rule": "long_short" if k % 2 else "long_flat"}))
    return tmp_path, a


def entries_of(text):
    return {(r["window"], r["entry"]): r for r in json.loads(text)["entries"]}


def same(one, other):
    assert one.keys() == other.keys()
    for k, row in one.items():
        for c, x in row.items():
            y = other[k][c]
            assert (x == pytest.approx(y, rel=1e-9, abs=1e-12)) if isinstance(x, float) else x == y, (k, c)


def test_one_changed_entry_of_ten_reads_one_file(spark, folder, monkeypatch):
    root, a = folder
    read, plain = [], board_store.signals_from
    monkeypatch.setattr(board_store, "signals_from", lambda s, paths: (read.append(plain(s, paths).inputFiles()), plain(s, paths))[1])
    subs, actual, store = str(root / "subs"), str(root / "actual.parquet"), str(root / "store")
    build = lambda kept=store: entries_of(board.build_from_files(spark, actual, subs, reps=30, store=kept)[0])
    first = build()
    assert len(read) == 1 and len(read[0]) == 10
    write(root / "subs" / "e3" / "signal.parquet", a[["date", "ticker"]].assign(value=np.random.default_rng(99).normal(size=len(a))))
    second = build()
    assert len(read) == 2 and len(read[1]) == 1 and read[1][0].endswith("e3/signal.parquet")
    same(second, build(None))
    window = next(iter(first))[0]
    assert second[window, "e3"]["net_sharpe"] != first[window, "e3"]["net_sharpe"] and second[window, "e4"]["net_sharpe"] == first[window, "e4"]["net_sharpe"]


def test_rules_inputs_and_leavers_count_and_a_broken_run_is_made_good(spark, folder):
    root, a = folder
    subs, store = str(root / "subs"), str(root / "store")
    for k in range(3, 10):
        shutil.rmtree(root / "subs" / f"e{k}")
    actual = readers.load_actual(spark, str(root / "actual.parquet"))
    run = lambda digest="x", cost=10.0: board_store.kept_scores(spark, store, subs, actual, digest, cost_bps=cost)
    scores, daily, now = run()
    n = daily.count()
    assert now == ["e0", "e1", "e2"] and scores.count() == 3 and run()[2] == []
    assert run("y")[2] == now == run(cost=20.0)[2]
    (root / "subs" / "e0" / "meta.json").write_text(json.dumps(META | {"name": "e0", "rule": "long_top"}))
    shutil.rmtree(root / "subs" / "e2")
    scores, daily, now = run()
    assert now == ["e0"] and scores.count() == 2 and daily.count() == n * 2 // 3
    # The list of keys is written last: without it the same rows are written once more, not twice.
    shutil.rmtree(root / "store" / "keys")
    scores, daily, now = run()
    assert now == ["e0", "e1"] and scores.count() == 2 and daily.count() == n * 2 // 3
    assert daily.select("entry", "window", "date").distinct().count() == daily.count()

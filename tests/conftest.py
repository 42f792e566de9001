import os
import sys
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    here = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(here / "checkpoint"))
        .config("spark.sql.warehouse.dir", str(here / "warehouse"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def returns(rows: int, names: int, seed: int, sd: float = 0.015, mean: float = 0.0003, start: str = "2022-01-03") -> pd.DataFrame:
    """(date, ticker, target) of seeded normal returns on business days."""
    days = pd.bdate_range(start, periods=rows).date
    draw = np.random.default_rng(seed).normal(mean, sd, (rows, names))
    return pd.DataFrame({"date": np.repeat(days, names), "ticker": np.tile([f"S{k:02d}" for k in range(names)], rows), "target": draw.ravel()})


@pytest.fixture(scope="session")
def small_dir():
    return SMALL

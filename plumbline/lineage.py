"""Rows that several parts of a plan read: run once, kept in the folder all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it.

    Only where the setting is absent and Spark runs on one machine a local folder is made; on a
    cluster without it ValueError is raised.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="plumbline-"))
    return named or context.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the plan is run once and later reads survive lost executors."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)

"""Scoring of held positions as a stream: exposure and gross return by entry and period.

Turnover needs the day before and stays with the batch scorer; everything that is a sum over
one day's rows is kept here with watermarked state, which late rows still update.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

HELD = "entry string, ts timestamp, ticker string, weight double, target double"


def read_positions(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(HELD).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def streamed_books(positions: DataFrame, period: str = "1 day", late: str = "2 days") -> DataFrame:
    """(entry, start, gross, exposure, gross_exposure, short_exposure, positions) by tumbling period.

    Rows that come again (same entry, name and time) count once.
    """
    once = positions.withWatermark("ts", late).dropDuplicatesWithinWatermark(["entry", "ticker", "ts"])
    per = once.groupBy("entry", F.window("ts", period).alias("w")).agg(
        F.sum(F.col("weight") * F.coalesce("target", F.lit(0.0))).alias("gross"), F.sum("weight").alias("exposure"), F.sum(F.abs("weight")).alias("gross_exposure"),
        F.sum(F.greatest(-F.col("weight"), F.lit(0.0))).alias("short_exposure"), F.count_if(F.col("weight") != 0).alias("positions"),
    )
    return per.select("entry", F.col("w.start").alias("start"), "gross", "exposure", "gross_exposure", "short_exposure", "positions")


def write_books(books: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Appends finished periods as parquet; restarting goes on from the checkpoint."""
    return books.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True)

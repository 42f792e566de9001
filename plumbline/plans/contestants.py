"""Signals of the built-in contestants, and models trained with pyspark.ml: linear, boosted, and a network that ranks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from plumbline.lineage import settled
from plumbline.operators.crosssection import day, information_coefficient, rank_average
from plumbline.operators.timeseries import change, context_blocks, hold_between, low_volatility, momentum_12_1, monthly_hold, own, reversal, rolling
from plumbline.operators.universe import only_members
from plumbline.panel import calendar, densify, only_finite

#: Classes of the day's ranks that the network tells apart, and its inner layers.
TIERS, LAYERS = 5, (16, 8)


def _calendar_rows() -> WindowSpec:
    return own(order="ordinal")


def factor_signals(prices: DataFrame, membership: DataFrame | None = None, skip: int = 21, back: int = 252, vol: int = 63) -> DataFrame:
    """(entry, date, ticker, value): momentum, reversal and low volatility on the calendar, held by month, of members only."""
    days, rows = calendar(prices), _calendar_rows()
    dense = densify(prices, days).withColumn("ret", change("close", 1, rows))
    factors = {"momentum_12_1": momentum_12_1("close", rows, skip, back), "reversal_1m": reversal("close", skip, rows), "low_vol_63d": low_volatility("ret", vol, rows)}
    wide = dense.select("date", "ordinal", "ticker", *(c.alias(k) for k, c in factors.items()))
    for k in factors:
        wide = monthly_hold(wide, k)
    long = wide.select("date", "ticker", *factors).unpivot(["date", "ticker"], list(factors), "entry", "value").select("entry", "date", "ticker", "value")
    kept = only_finite(long)
    return only_members(kept, membership) if membership is not None else kept


def starter_signal(actual: DataFrame, kind: str, ranked: bool = False) -> DataFrame:
    """(date, ticker, value) from realised returns, moved on one day so that it holds only what had happened.

    reversal: less the last 5 returns; momentum: the last 252 (at least 200) less the last 21;
    lowvol: less the deviation of the last 60 (at least 40).
    """
    days, rows = calendar(actual), _calendar_rows()
    dense = densify(actual, days, values=("target",))
    roll = lambda kind, n, least: rolling(kind, "target", n, rows, least)
    raw = {"reversal": -roll("sum", 5, 5), "momentum": roll("sum", 252, 200) - roll("sum", 21, 21), "lowvol": -roll("std", 60, 40)}[kind]
    moved = dense.withColumn("_raw", raw).withColumn("value", F.lag("_raw").over(rows)).where("value is not null")
    return moved.select("date", "ticker", (rank_average("value") if ranked else F.col("value")).alias("value"))


def learner(model: str, width: int, seed: int, **settings):
    """A Spark learner of the named kind over ``width`` features."""
    if model == "linear":
        return LinearRegression(featuresCol="_x", labelCol="_label", **{"regParam": 1e-4, **settings})
    if model == "gbt":
        return GBTRegressor(featuresCol="_x", labelCol="_label", seed=seed, **{"maxIter": 20, "maxDepth": 4, **settings})
    if model == "network":
        return MultilayerPerceptronClassifier(featuresCol="_x", labelCol="_tier", layers=[width, *LAYERS, TIERS], seed=seed, **{"maxIter": 40, **settings})
    raise ValueError(f"unknown model {model}")


def fit_contestant(panel: DataFrame, features: Sequence[str], model: str = "linear", label: str = "target", ranked: bool = True, seed: int = 0, iterations: int | None = None, **settings) -> PipelineModel:
    """A model of the (day-ranked) target on standardised features, fitted by Spark on the whole panel.

    The network learns in which of TIERS equal parts of its day a name ends.
    """
    if iterations is not None and model != "linear":
        settings["maxIter"] = iterations
    rank = rank_average(label, day())
    data = panel.na.drop(subset=[*features, label]).withColumn("_rank", rank).withColumns({"_label": F.col("_rank") if ranked else F.col(label), "_tier": F.least(F.floor((F.col("_rank") + 0.5) * TIERS), F.lit(TIERS - 1)).cast("double")})
    stages = [VectorAssembler(inputCols=list(features), outputCol="_raw"), StandardScaler(withMean=True, inputCol="_raw", outputCol="_x"), learner(model, len(features), seed, **settings)]
    return Pipeline(stages=stages).fit(data)


def _prediction(model: PipelineModel) -> Column:
    """The model's number for a row: a regression's prediction, or the mean tier by the network's probabilities."""
    if not model.stages[-1].hasParam("probabilityCol"):
        return F.col("prediction")
    return F.aggregate(F.transform(vector_to_array(F.col("probability")), lambda p, k: p * k), F.lit(0.0), lambda a, x: a + x)


def predicted_signal(model: PipelineModel, panel: DataFrame, entry: str, hold: int = 1) -> DataFrame:
    """(entry, date, ticker, value) of the model's predictions, renewed every ``hold`` days."""
    rows = model.transform(panel).select("date", "ticker", _prediction(model).alias("value"))
    if hold > 1:
        rows = hold_between(densify(rows, calendar(rows), values=("value",)), hold).where("value is not null")
    return rows.select(F.lit(entry).alias("entry"), "date", "ticker", "value")


def seeds_mean(signals: Sequence[DataFrame]) -> DataFrame:
    """(entry, date, ticker, value): the mean of several models' numbers for each name and day."""
    return reduce(DataFrame.unionByName, signals).groupBy("entry", "date", "ticker").agg(F.avg("value").alias("value"))


def trained_signal(
    panel: DataFrame, features: Sequence[str], train_end: str, model: str = "linear", val_end: str | None = None, choices: Sequence[dict] = ({},), seeds: Sequence[int] = (0,), entry: str | None = None, hold: int = 1
) -> DataFrame:
    """The signal of a model fitted on days up to ``train_end`` for the days after ``val_end`` (or ``train_end``).

    The last training day's target is a return of the day after, which is the first day that is
    predicted from or validated on, so that day is left out of the training. Of several
    ``choices`` of settings the one with the best information coefficient on the days between
    ``train_end`` and ``val_end`` is taken. One model is fitted per seed; their mean is returned.
    """
    entry, whole = entry or model, panel.na.drop(subset=list(features))
    upto, after = F.lit(train_end).cast("date"), F.lit(val_end or train_end).cast("date")
    train = settled(whole.where(F.col("date") < upto))
    best = choices[0]
    if len(choices) > 1:
        if val_end is None:
            raise ValueError("choices are compared on validation days, so val_end must be given")
        held = settled(whole.where((F.col("date") > upto) & (F.col("date") <= after)))
        quality = [information_coefficient(predicted_signal(fit_contestant(train, features, model, seed=seeds[0], **c), held, entry), held.select("date", "ticker", "target")).first() for c in choices]
        best = choices[int(np.argmax([-np.inf if q is None or q["ic"] is None else q["ic"] for q in quality]))]
    test = whole.where(F.col("date") > after)
    return seeds_mean([predicted_signal(fit_contestant(train, features, model, seed=s, **best), test, entry, hold) for s in seeds])


def sequence_signal(panel: DataFrame, features: Sequence[str], predict: Callable[[np.ndarray], np.ndarray], n: int = 60, entry: str = "sequence", at_once: int = 4096) -> DataFrame:
    """(entry, date, ticker, value) of a model of each name's last ``n`` rows; names with fewer have none.

    ``predict`` takes (windows, n, features) and gives a number for each window. A name's rows are
    shuffled once in blocks, and windows are views of these, handed over in batches of ``at_once``.
    """
    blocks = context_blocks(panel.na.drop(subset=list(features)).withColumns({f: F.col(f).cast("double") for f in features}), features, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rows, core = batch["rows"][k].values, max(batch["core"][k].as_py(), n - 1)
                x = np.column_stack([rows.field(f).to_numpy(zero_copy_only=False) for f in features])
                if core >= len(x):
                    continue
                windows = np.lib.stride_tricks.sliding_window_view(x, n, axis=0)[core - n + 1 :].transpose(0, 2, 1)
                for start in range(0, len(windows), at_once):
                    part = windows[start : start + at_once]
                    date = rows.field("date").slice(core + start, len(part))
                    value = np.asarray(predict(part), dtype=float).ravel()
                    yield pa.RecordBatch.from_arrays([date, pa.array([batch["ticker"][k].as_py()] * len(part), pa.string()), pa.array(value)], ["date", "ticker", "value"])

    out = blocks.mapInArrow(run, "date date, ticker string, value double")
    return out.select(F.lit(entry).alias("entry"), "date", "ticker", "value")


def mean_sigmoid_weights(scores: DataFrame, columns: Sequence[str] = ("s1", "s2", "s3")) -> DataFrame:
    """(date, ticker, value): the mean of the sigmoids of several scores over the number of names of the day."""
    mean = sum((1 / (1 + F.exp(-F.col(c))) for c in columns), F.lit(0.0)) / len(columns)
    return scores.select("date", "ticker", (mean / F.count(F.lit(1)).over(day())).alias("value"))

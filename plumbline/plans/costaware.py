"""Training on net returns: weights that maximise the Sharpe ratio after costs, by Spark passes over ranges of days.

The rows are laid out once, a row for each range of days with the day before it. A step is one pass:
each task adds up its ranges (``net_sharpe.range_sums``), the tasks' sums are added in two levels, and
the driver moves the parameters, which are all it ever holds.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.net_sharpe import Adam, Rows, Shape, Sums, range_sums, scores
from plumbline.lineage import settled
from plumbline.operators.crosssection import day
from plumbline.panel import calendar, finite, with_ordinal

#: Rows of a range that a task works on, as far as whole days allow, and groups in which the tasks' sums are added first.
RANGE_ROWS, GROUPS = 100_000, 32
#: Basis points charged where a model is judged.
EVAL_BPS = 10.0


@dataclass(frozen=True)
class NetModel:
    """Parameters and the standardisation they were fitted with."""

    shape: Shape
    theta: np.ndarray
    features: tuple[str, ...]
    mean: np.ndarray
    scale: np.ndarray
    validation: float | None = None


@dataclass(frozen=True)
class DayRanges:
    """Rows by ranges of days: how many days there are and how many a range has."""

    rows: DataFrame
    days: int
    length: int


def whole_rows(panel: DataFrame, features: Sequence[str], *more: str) -> DataFrame:
    """Rows in which all features are finite numbers."""
    for c in (*features, *more):
        panel = panel.where(finite(F.col(c)))
    return panel


def standard(panel: DataFrame, features: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Means and population deviations of the features; a feature that does not vary is left at its scale."""
    row = panel.agg(*(F.avg(f).alias(f"m{k}") for k, f in enumerate(features)), *(F.stddev_pop(f).alias(f"s{k}") for k, f in enumerate(features))).first()
    n = len(features)
    return np.array([row[k] or 0.0 for k in range(n)]), np.array([row[n + k] or 1.0 for k in range(n)])


def day_ranges(panel: DataFrame, features: Sequence[str], mean: np.ndarray, scale: np.ndarray, label: str = "target", range_rows: int = RANGE_ROWS) -> DayRanges:
    """The panel's rows in ranges of days, each with the day before its first; names are counted for each day.

    A range has as many days as hold ``range_rows`` rows of the fullest day, so what a task
    holds does not grow with the history. It is shuffled once, for all steps.
    """
    rows = whole_rows(panel, features, label)
    per = with_ordinal(rows.groupBy("date").agg(F.count("*").alias("names")), calendar(rows))
    about = per.agg(F.count("*").alias("days"), F.max("names").alias("most")).first()
    length = max(1, range_rows // max(about["most"] or 1, 1))
    x = F.array(*((F.col(f).cast("double") - float(m)) / float(s) for f, m, s in zip(features, mean, scale, strict=True)))
    each = rows.join(F.broadcast(per), "date").select("ordinal", "ticker", "names", F.col(label).cast("double").alias("target"), x.alias("x"))
    own = F.floor(F.col("ordinal") / length).cast("int")
    both = F.when((F.col("ordinal") + 1) % length == 0, F.array(own, own + 1)).otherwise(F.array(own))
    parts = int(panel.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grouped = each.withColumn("range", F.explode(both)).where(F.col("range") * length < about["days"]).repartition(parts, "range").groupBy("range").agg(F.collect_list(F.struct("ordinal", "ticker", "names", "target", "x")).alias("rows"))
    return DayRanges(settled(grouped), about["days"], length)


def _rows_of(rows: pa.StructArray, width: int) -> Rows:
    f = {c: rows.field(c) for c in ("ordinal", "ticker", "names", "target", "x")}
    _, name = np.unique(f["ticker"].to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
    ordinal = f["ordinal"].to_numpy()
    order = np.lexsort((name, ordinal))
    return Rows(ordinal[order], name[order], f["names"].to_numpy()[order].astype(float), f["target"].to_numpy()[order], f["x"].flatten().to_numpy().reshape(len(rows), width)[order])


def summed(ranges: DayRanges, theta: np.ndarray, shape: Shape, cost_bps: float, start: int = 0, end: int | None = None, draw: tuple[int, int] | None = None, gradient: bool = True) -> Sums:
    """The sums over the days from ``start`` up to ``end``, the first of which starts from cash: one job.

    A task gives one row of a length fixed by the network; rows are added by group, then the groups.
    """
    end, length = ranges.days if end is None else end, ranges.length
    width = 4 + (2 * shape.size if gradient else 0)
    if start >= end:
        return Sums.of(np.zeros(width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            for k, block in enumerate(batch["range"].to_pylist()):
                first, last = max(block * length, start), min((block + 1) * length, end)
                if first < last:
                    total += range_sums(theta, shape, _rows_of(batch["rows"][k].values, shape.inputs), first, last, cost_bps / 1e4, first == start, draw, gradient).flat()
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["s"])

    each = ranges.rows.mapInArrow(run, "s array<double>").select(array_to_vector("s").alias("s"), (F.spark_partition_id() % GROUPS).alias("g"))
    total = each.groupBy("g").agg(Summarizer.sum(F.col("s")).alias("s")).agg(Summarizer.sum(F.col("s")).alias("s")).first()["s"]
    return Sums.of(np.asarray(total.toArray()))


def fit_net(
    panel: DataFrame, features: Sequence[str], train_end: str, val_end: str | None = None, cost_bps: float = EVAL_BPS, shape: Shape | None = None, label: str = "target",
    seed: int = 0, epochs: int = 60, steps: int = 64, window: int | None = 126, patience: int = 8, rate: float = 1e-3, range_rows: int = RANGE_ROWS,
) -> NetModel:
    """The network fitted on days before ``train_end`` to maximise the Sharpe ratio net of ``cost_bps``.

    Each of ``steps`` steps of an epoch takes ``window`` days from a drawn first one (all days if
    None or if there are not that many). After an epoch the ratio on the days after ``train_end``
    up to ``val_end`` is taken, at EVAL_BPS; the best parameters stay, and ``patience`` epochs
    without a better one end the fit. Without ``val_end`` the last parameters stay. The last
    training day's target is the return of ``train_end`` itself, so that day is not trained on.
    """
    shape = shape or Shape(len(features))
    upto = F.lit(train_end).cast("date")
    train = whole_rows(panel.where(F.col("date") < upto), features, label)
    mean, scale = standard(train, features)
    ranges = day_ranges(train, features, mean, scale, label, range_rows)
    held = None if val_end is None else day_ranges(panel.where((F.col("date") > upto) & (F.col("date") <= F.lit(val_end).cast("date"))), features, mean, scale, label, range_rows)
    theta, adam = shape.start(seed), Adam(rate=rate)
    rng = np.random.default_rng([seed, 1])
    span = ranges.days if window is None else min(window, ranges.days)
    best, best_theta, bad = -np.inf, theta, 0
    for epoch in range(epochs):
        for k in range(steps):
            first = int(rng.integers(0, ranges.days - span + 1))
            draw = (seed, epoch * steps + k) if shape.dropout and shape.hidden else None
            theta, adam = adam.moved(theta, summed(ranges, theta, shape, cost_bps, first, first + span, draw).loss_gradient())
        if held is None:
            best_theta = theta
            continue
        ratio = summed(held, theta, shape, EVAL_BPS, gradient=False).ratio()
        best, best_theta, bad = (ratio, theta, 0) if ratio > best else (best, best_theta, bad + 1)
        if bad >= patience:
            break
    return NetModel(shape, best_theta, tuple(features), mean, scale, None if held is None else float(best))


def net_weights(model: NetModel, panel: DataFrame, entry: str = "costaware") -> DataFrame:
    """(entry, date, ticker, value): each name's share of the day, at most one over the number of names; the rest is cash."""
    rows = whole_rows(panel, model.features).select("date", "ticker", F.array(*(F.col(f).cast("double") for f in model.features)).alias("x"))
    theta, shape, mean, scale = model.theta, model.shape, model.mean, model.scale

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch["x"].flatten().to_numpy().reshape(batch.num_rows, shape.inputs)
            score, _ = scores(theta, shape, (x - mean) / scale)
            yield pa.RecordBatch.from_arrays([batch["date"], batch["ticker"], pa.array(1 / (1 + np.exp(-np.clip(score, -700, 700))))], ["date", "ticker", "share"])

    shares = rows.mapInArrow(run, "date date, ticker string, share double")
    return shares.select(F.lit(entry).alias("entry"), "date", "ticker", (F.col("share") / F.count(F.lit(1)).over(day())).alias("value"))


def costaware_signal(panel: DataFrame, features: Sequence[str], train_end: str, val_end: str, seeds: Sequence[int] = (42, 43, 44), entry: str = "costaware", **settings) -> DataFrame:
    """The mean weights of one fit for each seed, for the days after ``val_end``."""
    after = panel.where(F.col("date") > F.lit(val_end).cast("date"))
    parts = [net_weights(fit_net(panel, features, train_end, val_end, seed=s, **settings), after, entry) for s in seeds]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("entry", "date", "ticker").agg(F.avg("value").alias("value"))


def loss_and_gradient(panel: DataFrame, features: Sequence[str], theta: Sequence[float], shape: Shape, cost_bps: float = EVAL_BPS, label: str = "target") -> DataFrame:
    """(term, value): the ratio, the mean turnover and the gradient of the loss by each parameter, features as they are."""
    n = len(features)
    ranges = day_ranges(panel, features, np.zeros(n), np.ones(n), label)
    sums = summed(ranges, np.asarray(theta, dtype=float), shape, cost_bps)
    rows = [("sharpe", sums.ratio()), ("turnover", sums.turnover / max(sums.days, 1.0)), *((f"d{k}", float(g)) for k, g in enumerate(sums.loss_gradient()))]
    return panel.sparkSession.createDataFrame(rows, "term string, value double")

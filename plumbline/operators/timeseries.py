"""Trailing operators, each a window expression over a name's rows.

Without a window they run over the rows a name has. Calendar semantics (a missing day counts
as a step) need a densified panel or ``panel.shift_days``.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from plumbline.lineage import settled
from plumbline.panel import number, ratio

TRADING_DAYS = 252
#: Days of a name's history that are smoothed together.
CHUNK_DAYS = 512
#: Rows of a name that stand together where windows are cut.
CONTEXT_ROWS = 1024


def own(*keys: str, order: str = "date") -> WindowSpec:
    return Window.partitionBy(*(keys or ("ticker",))).orderBy(order)


def change(x: str, k: int = 1, w: WindowSpec | None = None) -> Column:
    """x over its value k rows before, less one; null where that is null or zero."""
    return ratio(F.col(x), F.lag(x, k).over(w or own())) - 1


def carried(x: str, w: WindowSpec | None = None) -> Column:
    """The last value that is not null."""
    return F.last(x, ignorenulls=True).over((w or own()).rowsBetween(Window.unboundedPreceding, 0))


def ahead(x: str, k: int = 1, w: WindowSpec | None = None) -> Column:
    return F.lead(x, k).over(w or own())


def _guarded(agg: Column, x: Column, frame: WindowSpec, least: int) -> Column:
    return F.when(F.count(x).over(frame) >= least, agg.over(frame))


def rolling(kind: str, x: str | Column, n: int, w: WindowSpec | None = None, least: int | None = None) -> Column:
    """mean, std (n - 1), sum, min or max of the last n rows; null under ``least`` values (n if not given)."""
    c = F.col(x) if isinstance(x, str) else x
    agg = {"mean": F.avg, "std": F.stddev_samp, "sum": F.sum, "min": F.min, "max": F.max}[kind](c)
    return _guarded(agg, c, (w or own()).rowsBetween(1 - n, 0), n if least is None else least)


def volume_z(x: str = "volume", n: int = 21, bound: float = 5.0, w: WindowSpec | None = None) -> Column:
    """Standardised by the last n rows, clipped to the bound; null where they do not vary."""
    z = ratio(F.col(x) - rolling("mean", x, n, w), rolling("std", x, n, w))
    return F.when(z.isNotNull(), F.greatest(F.lit(-bound), F.least(F.lit(bound), z)))


def bollinger(x: str = "close", n: int = 20, width: float = 2.0, w: WindowSpec | None = None) -> tuple[Column, Column]:
    """(%B, bandwidth)."""
    mid, sd = rolling("mean", x, n, w), rolling("std", x, n, w)
    low, span = mid - width * sd, 2 * width * sd
    return ratio(F.col(x) - low, span), ratio(span, mid)


def momentum_12_1(x: str = "close", w: WindowSpec | None = None, skip: int = 21, back: int = 252) -> Column:
    return ratio(F.lag(x, skip).over(w or own()), F.lag(x, back).over(w or own())) - 1


def reversal(x: str = "close", k: int = 21, w: WindowSpec | None = None) -> Column:
    return -change(x, k, w)


def low_volatility(ret: str = "ret", n: int = 63, w: WindowSpec | None = None) -> Column:
    return -rolling("std", ret, n, w) * F.sqrt(F.lit(float(TRADING_DAYS)))


def monthly_hold(dense: DataFrame, value: str = "value") -> DataFrame:
    """Holds the value of each month's first calendar day; where it is null that of an older month stays.

    The input has all names on all days.
    """
    first = dense.groupBy(F.trunc("date", "month")).agg(F.min("date").alias("date")).select("date", F.lit(True).alias("first_of_month"))
    tagged = dense.join(F.broadcast(first), "date", "left").withColumn("first_of_month", F.coalesce("first_of_month", F.lit(False)))
    kept = F.last(F.when(F.col("first_of_month"), F.col(value)), ignorenulls=True)
    return tagged.withColumn(value, kept.over(own().rowsBetween(Window.unboundedPreceding, 0))).drop("first_of_month")


def hold_between(dense: DataFrame, hold: int, value: str = "value") -> DataFrame:
    """Keeps every hold-th day's value and carries it over the days between; hold <= 1 changes nothing."""
    if hold <= 1:
        return dense
    kept = F.when(F.col("ordinal") % hold == 0, F.col(value))
    return dense.withColumn(value, F.last(kept, ignorenulls=True).over(own(order="ordinal").rowsBetween(1 - hold, 0)))


def context_blocks(df: DataFrame, fields: Sequence[str], n: int, keys: tuple[str, ...] = ("ticker",), order: str = "date", size: int = CONTEXT_ROWS) -> DataFrame:
    """(keys, block, core, rows): a name's rows in blocks, each with the n - 1 rows before it, for windows of n rows.

    ``rows`` are structs of ``order`` and the fields, oldest first, ``core`` is the index of the
    block's own first row. A block has at least n rows of its own, so a row is in two at most; windows
    are views of a block and are not written anywhere.
    """
    size = max(size, n)
    placed = df.withColumn("_pos", F.row_number().over(own(*keys, order=order)) - 1)
    block = F.explode(F.sequence(F.floor(F.col("_pos") / size), F.floor((F.col("_pos") + n - 1) / size)))
    each = placed.select(*keys, block.alias("block"), F.struct("_pos", order, *(f for f in fields if f != order)).alias("_r"))
    rows = F.array_sort(F.collect_list("_r"))
    whole = each.groupBy(*keys, "block").agg(rows.alias("rows")).withColumn("core", (F.col("block") * size - F.col("rows")[0]["_pos"]).cast("int"))
    return whole.where(F.col("core") < F.size("rows")).select(*keys, "block", F.greatest("core", F.lit(0)).alias("core"), "rows")


def over_windows(blocks: DataFrame, n: int, values: dict[str, Callable[[Column], Column]], keep: Sequence[str] = (), keys: tuple[str, ...] = ("ticker",), order: str = "date", least: int | None = None) -> DataFrame:
    """(keys, order, keep, bars, values) of every row with at least ``least`` rows up to it (n if not given): each value is a function of the window's array."""
    least = n if least is None else least

    def one(i: Column) -> Column:
        bars = F.least(i + 1, F.lit(n))
        window = F.slice("rows", i + 2 - bars, bars)
        row = F.get("rows", i)
        return F.struct(row[order].alias(order), *(row[c].alias(c) for c in keep), bars.alias("bars"), *(f(window).alias(name) for name, f in values.items()))

    places = F.sequence(F.greatest("core", F.lit(least - 1)), F.size("rows") - 1)
    some = blocks.where(F.size("rows") >= least)
    return some.select(*keys, F.explode(F.transform(places, one)).alias("_w")).select(*keys, "_w.*")


# --- recursive means: a scan over chunks of a name's rows -----------------------------------


def _levels(columns: dict[str, tuple[str, float]]) -> list[dict[str, tuple[str, float]]]:
    """The columns in groups, each of which uses only those of groups before it."""
    levels: list[dict[str, tuple[str, float]]] = []
    for new, (x, alpha) in columns.items():
        if not 0 < alpha < 1:
            raise ValueError("alpha must be between 0 and 1")
        needs = [k for k, level in enumerate(levels) if level.keys() & set(re.findall(r"\w+", x))]
        at = max(needs, default=-1) + 1
        levels += [{}] * (at == len(levels))
        levels[at] = {**levels[at], new: (x, alpha)}
    return levels


def _entering(chunks: str, k: int, alpha: float) -> Column:
    """For each of a name's chunks, in order: the mean it starts from and the mean at its first value.

    What is carried from chunk to chunk is the last mean and the rows since the last value, whose weight ages with them.
    """
    state = "struct<y: double, since: bigint, out: array<struct<y: double, y1: double>>>"
    start = F.struct(F.lit(None).cast("double").alias("y"), F.lit(0).cast("bigint").alias("since"), F.array().cast("array<struct<y: double, y1: double>>").alias("out")).cast(state)

    def step(s: Column, c: Column) -> Column:
        old = F.pow(F.lit(1 - alpha), (s["since"] + c[f"first{k}"]).cast("double"))
        y1 = F.coalesce((old * s["y"] + alpha * c[f"x{k}"]) / (old + alpha), c[f"x{k}"])
        some = c[f"first{k}"].isNotNull()
        y = F.when(some, c[f"scale{k}"] * (y1 + c[f"sum{k}"])).otherwise(s["y"])
        since = F.when(some, c["n"] - c[f"last{k}"]).otherwise(s["since"] + c["n"])
        return F.struct(y.alias("y"), since.alias("since"), F.concat(s["out"], F.array(F.struct(s["y"].alias("y"), y1.alias("y1")))).alias("out")).cast(state)

    return F.aggregate(chunks, start, step, lambda s: s["out"])


def _smoothed_once(df: DataFrame, columns: dict[str, tuple[str, float]], keys: tuple[str, ...], order: str, span: int) -> DataFrame:
    """One group of columns, none of which uses another.

    Within a chunk the mean after its first value y1 is exp(l) (y1 + s): l adds up the logarithms of
    what each later value leaves of the mean before it, s what it adds, over exp(l). Both are window
    sums. A chunk is so an affine map, of which one row each is scanned by name.
    """
    place = F.unix_date(order) if dict(df.dtypes)[order] == "date" else F.col(order).cast("long")
    chunk = Window.partitionBy(*keys, "_chunk").orderBy(order)
    upto, earlier = chunk.rowsBetween(Window.unboundedPreceding, 0), chunk.rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("_chunk", F.floor(place / span)).withColumns({"_row": F.row_number().over(chunk).cast("bigint"), **{f"_x{k}": number(F.expr(x)) for k, (x, _) in enumerate(columns.values())}})
    seen = lambda k: F.when(F.col(f"_x{k}").isNotNull(), F.col("_row"))
    rows = rows.withColumns({f"_p{k}": F.max(seen(k)).over(earlier) for k in range(len(columns))})
    scale, add = {}, {}
    for k, (_, alpha) in enumerate(columns.values()):
        old = F.pow(F.lit(1 - alpha), (F.col("_row") - F.col(f"_p{k}")).cast("double"))
        later = F.col(f"_x{k}").isNotNull() & F.col(f"_p{k}").isNotNull()
        scale[f"_l{k}"] = F.sum(F.when(later, F.ln(old / (old + alpha))).otherwise(0.0)).over(upto)
        add[f"_s{k}"] = F.sum(F.when(later, alpha * F.col(f"_x{k}") / (old + alpha) * F.exp(-F.col(f"_l{k}"))).otherwise(0.0)).over(upto)
    rows = settled(rows.withColumns(scale).withColumns(add))
    ends = []
    for k in range(len(columns)):
        ends += [F.min(seen(k)).alias(f"first{k}"), F.max(seen(k)).alias(f"last{k}"), F.min_by(f"_x{k}", seen(k)).alias(f"x{k}"), F.exp(F.max_by(f"_l{k}", "_row")).alias(f"scale{k}"), F.max_by(f"_s{k}", "_row").alias(f"sum{k}")]
    maps = rows.groupBy(*keys, "_chunk").agg(F.count("*").alias("n"), *ends)
    per = maps.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*(c for c in maps.columns if c not in keys)))).alias("_c"))
    into = [_entering("_c", k, alpha).alias(f"_e{k}") for k, (_, alpha) in enumerate(columns.values())]
    each = per.select(*keys, F.transform("_c", lambda c: c["_chunk"]).alias("_chunk"), *into)
    starts = each.select(*keys, F.explode(F.arrays_zip("_chunk", *(f"_e{k}" for k in range(len(columns))))).alias("_z")).select(*keys, "_z.*")
    mean = lambda k: F.when(F.col(f"_p{k}").isNotNull() | F.col(f"_x{k}").isNotNull(), F.exp(F.col(f"_l{k}")) * (F.col(f"_e{k}")["y1"] + F.col(f"_s{k}"))).otherwise(F.col(f"_e{k}")["y"])
    return rows.join(starts, [*keys, "_chunk"]).select(*df.columns, *(mean(k).alias(new) for k, new in enumerate(columns)))


def smoothed(df: DataFrame, columns: dict[str, tuple[str, float]], keys: tuple[str, ...] = ("ticker",), order: str = "date", span: int = CHUNK_DAYS) -> DataFrame:
    """Adds exponentially weighted means: ``{new: (column or sum of columns, alpha)}``, later ones may use earlier ones.

    y0 = x0 and yt = (1 - alpha) yt-1 + alpha xt. Leading nulls stay null and nulls between age the
    weights. A name's rows, one for each date, are worked on in chunks of ``span`` days, so a long
    history is in many tasks; no row comes to Python.
    """
    # So that no weight within a chunk is beyond the range of a double.
    span = max(1, min([span, *(int(600 / -math.log1p(-alpha)) for _, alpha in columns.values() if 0 < alpha < 1)]))
    for level in _levels(columns):
        df = _smoothed_once(df, level, keys, order, span)
    return df


def span_alpha(span: int) -> float:
    return 2.0 / (span + 1)


def rsi(df: DataFrame, x: str = "close", n: int = 14, out: str = "rsi_14") -> DataFrame:
    """Wilder's index: 50 where there was no loss."""
    step = F.col(x) - F.lag(x).over(own())
    moves = df.withColumns({"_up": F.greatest(step, F.lit(0.0) * step), "_down": F.greatest(-step, F.lit(0.0) * step)})
    s = smoothed(moves, {"_gain": ("_up", 1 / n), "_loss": ("_down", 1 / n)})
    return s.withColumn(out, F.coalesce(100 - 100 / (1 + ratio(F.col("_gain"), F.col("_loss"))), F.lit(50.0))).drop("_up", "_down", "_gain", "_loss")


def macd_histogram(df: DataFrame, x: str = "close", fast: int = 12, slow: int = 26, signal: int = 9, out: str = "macd_hist") -> DataFrame:
    """(macd - its signal line) / x."""
    s = smoothed(df, {"_fast": (x, span_alpha(fast)), "_slow": (x, span_alpha(slow)), "_line": ("_fast - _slow", span_alpha(signal))})
    return s.withColumn(out, ratio(F.col("_fast") - F.col("_slow") - F.col("_line"), F.col(x))).drop("_fast", "_slow", "_line")


def true_range() -> Column:
    """The widest of today's range and the distances of its ends from yesterday's close."""
    before = F.lag("close").over(own())
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def oscillators(df: DataFrame) -> DataFrame:
    """Adds rsi_14, macd_hist and atr_14 from one pass over each name's history."""
    step = F.col("close") - F.lag("close").over(own())
    moves = df.withColumns({"_up": F.greatest(step, F.lit(0.0) * step), "_down": F.greatest(-step, F.lit(0.0) * step), "_tr": true_range()})
    s = smoothed(
        moves,
        {
            "_gain": ("_up", 1 / 14), "_loss": ("_down", 1 / 14), "_atr": ("_tr", 1 / 14),
            "_fast": ("close", span_alpha(12)), "_slow": ("close", span_alpha(26)), "_line": ("_fast - _slow", span_alpha(9)),
        },
    )
    return s.withColumns(
        {
            "rsi_14": F.coalesce(100 - 100 / (1 + ratio(F.col("_gain"), F.col("_loss"))), F.lit(50.0)),
            "atr_14": ratio(F.col("_atr"), F.col("close")),
            "macd_hist": ratio(F.col("_fast") - F.col("_slow") - F.col("_line"), F.col("close")),
        }
    ).drop("_up", "_down", "_tr", "_gain", "_loss", "_atr", "_fast", "_slow", "_line")


def atr(df: DataFrame, n: int = 14, out: str = "atr_14") -> DataFrame:
    s = smoothed(df.withColumn("_tr", true_range()), {"_atr": ("_tr", 1 / n)})
    return s.withColumn(out, ratio(F.col("_atr"), F.col("close"))).drop("_tr", "_atr")

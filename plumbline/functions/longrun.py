"""Long-run variance of the moments behind a difference of Sharpe ratios, as plans over blocks of days.

A lag product needs a day and one before it. An entry's days are cut into blocks that bring as many
of the days before them as the longest lag asks; each block gives its sums of products by lag, and
these are added by entry and lag. No series is in one task, and what is shuffled after the blocks
has a row for each block and lag.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.sharpe import DAYS
from plumbline.lineage import settled

#: Fixed values of the estimators: variance floor, bound of autocorrelations, Bartlett constant.
FLOOR, MOST_RHO, BARTLETT = 1e-30, 0.97, 1.1447
#: The automatic block length where the rule has no answer, the days it needs, and quiet lags in a row that end dependence.
DEFAULT_BLOCK, LEAST_DAYS, QUIET = 5, 40, 5
#: Days of a block.
BLOCK_DAYS = 1024
#: Places of the moments in every array: returns of entry and bar, then their squares.
MOMENTS = ("x", "y", "xx", "yy")
#: Sums kept beside those by lag: products of the first and of the last row with itself.
FIRST, LAST = -1, -2


def moments(series: DataFrame) -> DataFrame:
    """(entry, n, cash, flat, mean, grad, edge) of (entry, ordinal, x, y): the means, the gradient of the Sharpe difference by them, and the difference of a day.

    A bar that is null or does not vary is cash: its moments and their gradient are 0.
    """
    y = F.coalesce("y", F.lit(0.0))
    one = series.groupBy("entry").agg(
        F.count("*").alias("n"), ((F.min(y) == F.max(y)) | (F.stddev_pop(y) == 0)).alias("cash"), ((F.min("x") == F.max("x")) | (F.stddev_pop("x") == 0)).alias("flat"),
        F.avg("x").alias("m1"), F.avg(y).alias("m2"), F.avg(F.col("x") * F.col("x")).alias("g1"), F.avg(y * y).alias("g2"),
    )
    spread = lambda g, m: F.greatest(F.col(g) - F.col(m) * F.col(m), F.lit(FLOOR))
    bar = lambda c: F.when(F.col("cash"), F.lit(0.0)).otherwise(c)
    d1, d2 = spread("g1", "m1"), spread("g2", "m2")
    grad = F.array(F.col("g1") / F.pow(d1, 1.5), bar(-F.col("g2") / F.pow(d2, 1.5)), -F.col("m1") / (2 * F.pow(d1, 1.5)), bar(F.col("m2") / (2 * F.pow(d2, 1.5))))
    edge = F.col("m1") / F.sqrt(d1) - bar(F.col("m2") / F.sqrt(d2))
    return one.select("entry", "n", "cash", "flat", F.array("m1", bar(F.col("m2")), "g1", bar(F.col("g2"))).alias("mean"), grad.alias("grad"), edge.alias("edge"))


def numbered(series: DataFrame, size: int = BLOCK_DAYS) -> DataFrame:
    """(entry, pos, ordinal, x, y): each day's place among its entry's days, from 0.

    Days are numbered within ranges of ordinals; how many come before a range is a sum over the entry's ranges.
    """
    rows = series.select("entry", "ordinal", "x", F.coalesce("y", F.lit(0.0)).alias("y"), F.floor(F.col("ordinal") / size).alias("_range"))
    before = Window.partitionBy("entry").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("entry", "_range").agg(F.count("*").alias("_n")).select("entry", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("entry", "_range").orderBy("ordinal")) - 1
    return rows.withColumn("_place", place).join(starts, ["entry", "_range"]).select("entry", (F.col("_start") + F.col("_place")).alias("pos"), "ordinal", "x", "y")


def _centred(x: Column, y: Column) -> list[Column]:
    """The moments of a day less their means; of cash 0."""
    bar = lambda c: F.when(F.col("cash"), F.lit(0.0)).otherwise(c)
    return [c - F.col("mean")[k] for k, c in enumerate((x, bar(y), x * x, bar(y * y)))]


def _influence() -> Column:
    return sum((F.col("grad")[k] * c for k, c in enumerate(_centred(F.col("x"), F.coalesce("y", F.lit(0.0))))), F.lit(0.0))


def influences(series: DataFrame) -> DataFrame:
    """(entry, ordinal, influence): how much each day moves the Sharpe difference; row by row, given the moments."""
    return series.select("entry", "ordinal", "x", "y").join(moments(series), "entry").select("entry", "ordinal", _influence().alias("influence"))


# --- sums of lag products -------------------------------------------------------------------


def block_sums(values: np.ndarray, first: int, core: int, last: int, lags: int, rho: np.ndarray | None) -> Iterator[tuple[int, np.ndarray]]:
    """(lag, sums of products) of the rows from place ``core`` up to the end; ``values`` start at place ``first``.

    With ``rho`` what is left after each column's own day before is multiplied, which leaves the series' first day out.
    ``last`` is the place of the series' last day; the first and last rows' own products come beside.
    """
    if rho is not None:
        values, first = values[1:] - rho * values[:-1], first + 1
        core = max(core, 1)
    at, n = core - first, len(values)
    for lag in range(min(lags, n - 1) + 1):
        a = max(at, lag)
        yield lag, values[a:].T @ values[a - lag : n - lag]
    if n > at and core == (rho is not None):
        yield FIRST, np.outer(values[at], values[at])
    if n > at and first + n - 1 == last:
        yield LAST, np.outer(values[-1], values[-1])


def lag_sums(rows: DataFrame, params: DataFrame, columns: int, size: int = BLOCK_DAYS) -> DataFrame:
    """(entry, lag, g): of rows (entry, pos, c) the sums over days t of c[t] c[t - lag]', as one array; lags FIRST and LAST beside.

    ``params`` has a row for each entry (entry, n, lags, rho): the days, the longest lag, and null or
    the autocorrelations to take out first. A day goes to its own block and to those after it that reach back to it.
    """
    each = rows.join(params, "entry")
    own, most = F.floor(F.col("pos") / size), F.floor((F.col("n") - 1) / size)
    block = F.explode(F.sequence(own, F.least(F.floor((F.col("pos") + F.col("lags") + 1) / size), most)))
    grouped = each.select("entry", "pos", "c", "n", "lags", "rho", block.alias("block")).groupBy("entry", "block").agg(*(F.first(c).alias(c) for c in ("n", "lags", "rho")), F.collect_list(F.struct("pos", "c")).alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            plain = {c: batch[c].to_pylist() for c in ("entry", "block", "n", "lags", "rho")}
            for k in range(batch.num_rows):
                held = batch["rows"][k].values
                pos = held.field("pos").to_numpy()
                order = np.argsort(pos)
                values = held.field("c").flatten().to_numpy().reshape(len(pos), columns)[order]
                rho = None if plain["rho"][k] is None else np.array(plain["rho"][k])
                sums = block_sums(values, int(pos.min()), plain["block"][k] * size, plain["n"][k] - 1, plain["lags"][k], rho)
                out += [(plain["entry"][k], lag, g.ravel().tolist()) for lag, g in sums]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.int32()), pa.array([r[2] for r in out], pa.list_(pa.float64()))], ["entry", "lag", "g"])

    sums = grouped.mapInArrow(run, "entry string, lag int, g array<double>")
    return sums.groupBy("entry", "lag").agg(F.array(*(F.sum(F.col("g")[k]) for k in range(columns * columns))).alias("g"))


def _at(lag: int) -> Column:
    """Of an entry's sums those at one lag; nulls where there are none."""
    return F.first(F.when(F.col("lag") == lag, F.col("g")), ignorenulls=True)


def _by_entry(sums: DataFrame) -> DataFrame:
    return sums.groupBy("entry").agg(_at(0).alias("s0"), _at(1).alias("s1"), _at(FIRST).alias("first"), _at(LAST).alias("last"))


def _each_moment(f) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(len(MOMENTS) - 1)), f)


def _diagonal(c: str, k: Column) -> Column:
    return F.coalesce(F.get(c, k * (len(MOMENTS) + 1)), F.lit(0.0))


def _autocorrelation(k: Column) -> Column:
    """Of column k from its sums at lags 0 and 1: the product with the day before over the squares of all but the last day."""
    below = _diagonal("s0", k) - _diagonal("last", k)
    rho = F.when(below > 0, _diagonal("s1", k) / F.nullif(below, F.lit(0.0))).otherwise(F.lit(0.0))
    return F.greatest(F.lit(-MOST_RHO), F.least(F.lit(MOST_RHO), rho))


def _with_bandwidth(sums: DataFrame) -> DataFrame:
    """Adds Andrews' bandwidth for the Bartlett kernel, from the sums of the whitened columns, of which there are ``m`` rows."""
    m, h = F.col("m"), lambda k: F.get("h", k)
    square = lambda k: (_diagonal("s0", k) - _diagonal("first", k) - 2 * h(k) * _diagonal("s1", k) + h(k) * h(k) * (_diagonal("s0", k) - _diagonal("last", k))) / F.nullif(m - 1, F.lit(0))
    part = lambda k: F.struct(h(k).alias("h"), (square(k) * square(k)).alias("s"))
    total = lambda f: F.aggregate("parts", F.lit(0.0), lambda t, p: t + f(p["h"], p["s"]))
    parts = sums.withColumn("h", _each_moment(_autocorrelation)).withColumn("parts", _each_moment(part))
    both = parts.withColumns({"num": total(lambda a, s: 4 * a * a * s / (F.pow(1 - a, 6.0) * F.pow(1 + a, 2.0))), "den": total(lambda a, s: s / F.pow(1 - a, 4.0))})
    alpha = F.when(F.col("den") > 0, F.col("num") / F.nullif("den", F.lit(0.0))).otherwise(F.lit(0.0))
    width = F.greatest(F.lit(1.0), F.least(BARTLETT * F.cbrt(alpha * m), F.greatest(m - 2, F.lit(1)).cast("double")))
    return both.withColumn("bandwidth", width)


def long_run(series: DataFrame, lags: float | None = None, prewhite: bool = True, size: int = BLOCK_DAYS) -> DataFrame:
    """(entry, n, edge, se, bandwidth, matrix): annualised difference and standard error, and the long-run covariance of the moments.

    The Bartlett kernel with Andrews' bandwidth, or ``lags``; prewhitened by each column's own
    autocorrelation and recoloured. Under three days, and where the entry does not vary, edge and
    error are 0. ``matrix`` is 4 x 4 in the order of MOMENTS, row by row.
    """
    about = settled(moments(series))
    rows = settled(numbered(series, size).join(about.select("entry", "cash", "mean"), "entry").select("entry", "pos", F.array(*_centred(F.col("x"), F.col("y"))).alias("c")))
    k = len(MOMENTS)
    nothing = F.lit(None).cast("array<double>")
    white = about.select("entry", "n", F.lit(1).alias("lags"), nothing.alias("rho"))
    if prewhite:
        found = about.select("entry", "n").join(_by_entry(lag_sums(rows, white, k, size)), "entry")
        white = settled(found.select("entry", "n", F.lit(1).alias("lags"), F.when(F.col("n") > 3, _each_moment(_autocorrelation)).alias("rho")))
    sized = white.withColumn("m", F.col("n") - F.col("rho").isNotNull().cast("int"))
    if lags is None:
        wide = _with_bandwidth(sized.join(_by_entry(lag_sums(rows, white, k, size)), "entry")).select("entry", "n", "rho", "m", "bandwidth")
    else:
        wide = sized.select("entry", "n", "rho", "m", F.lit(float(lags)).alias("bandwidth"))
    wide = settled(wide.withColumn("lags", F.when(F.col("m") < 3, 0).otherwise(F.floor("bandwidth").cast("int"))))
    weight = F.when(F.col("lag") == 0, 0.5).otherwise(1 - F.col("lag") / (F.col("bandwidth") + 1))
    summed = lag_sums(rows, wide.select("entry", "n", "lags", "rho"), k, size).where("lag >= 0").join(wide.select("entry", "bandwidth"), "entry").withColumn("_w", weight)
    halves = summed.groupBy("entry").agg(F.array(*(F.sum(F.col("_w") * F.col("g")[i]) for i in range(k * k))).alias("half")).join(wide, "entry")
    cells, row, column = F.sequence(F.lit(0), F.lit(k * k - 1)), lambda i: F.floor(i / k).cast("int"), lambda i: i % k
    colour = lambda i: F.coalesce(1 / (1 - F.get("rho", i)), F.lit(1.0))
    both = lambda i: (F.get("half", i) + F.get("half", column(i) * k + row(i))) * colour(row(i)) * colour(column(i)) / F.greatest(F.col("m"), F.lit(1))
    matrix = halves.select("entry", "bandwidth", F.transform(cells, both).alias("matrix"))
    form = F.aggregate(cells, F.lit(0.0), lambda t, i: t + F.get("grad", row(i)) * F.get("grad", column(i)) * F.get("matrix", i))
    year, dead = math.sqrt(DAYS), F.col("flat") | (F.col("n") < 3)
    error = F.sqrt(F.greatest(F.col("_v") / F.col("n"), F.lit(0.0))) * year
    zero = lambda c: F.when(dead, F.lit(0.0)).otherwise(c)
    whole = about.join(matrix, "entry").withColumn("_v", form)
    return whole.select("entry", "n", zero(F.col("edge") * year).alias("edge"), zero(error).alias("se"), "bandwidth", "matrix")


def bandwidths(series: DataFrame) -> DataFrame:
    """(entry, bandwidth): Andrews' plug-in for the prewhitened columns of every entry."""
    return long_run(series).select("entry", "bandwidth")


def fixed_bandwidth_errors(series: DataFrame, lags: float) -> DataFrame:
    """(entry, edge, se) with a given bandwidth instead of the estimated one."""
    return long_run(series, lags).select("entry", "edge", "se")


def hac_covariance(series: DataFrame, lags: float | None = None, prewhite: bool = True) -> DataFrame:
    """(entry, a, b, value): the long-run covariance of every two moments, named as in MOMENTS."""
    names = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in MOMENTS for b in MOMENTS))
    each = long_run(series, lags, prewhite).select("entry", F.explode(F.arrays_zip(names.alias("name"), F.col("matrix").alias("value"))).alias("r"))
    return each.select("entry", "r.name.a", "r.name.b", "r.value")


# --- automatic block length -----------------------------------------------------------------


def block_lengths(series: DataFrame, size: int = BLOCK_DAYS) -> DataFrame:
    """(entry, block): Politis and White's block length of the influence series for the circular bootstrap.

    Autocorrelations at up to root(n) lags come from blocks of days; the rule reads one array for
    each entry. Under 40 days, or where the rule has no answer, DEFAULT_BLOCK.
    """
    about = settled(moments(series))
    rows = numbered(series, size).join(about, "entry").select("entry", "pos", F.array(_influence()).alias("c"))
    n = F.col("n")
    most = F.least(F.ceil(F.sqrt(n.cast("double"))) + QUIET, n - 3).cast("int")
    params = about.select("entry", "n", F.greatest(most, F.lit(0)).alias("lags"), F.lit(None).cast("array<double>").alias("rho"))
    sums = lag_sums(rows, params, 1, size).where("lag >= 0")
    mean = F.struct("lag", (F.col("g")[0] / F.greatest(n - F.col("lag"), F.lit(1))).alias("v"))
    lists = sums.join(params.select("entry", "n"), "entry").groupBy("entry", "n").agg(F.transform(F.array_sort(F.collect_list(mean)), lambda s: s["v"]).alias("auto"))
    scaled = lists.withColumn("acf", F.when(F.col("auto")[0] > 0, F.transform("auto", lambda v: v / F.col("auto")[0])))
    bound = 2 * F.sqrt(F.log10(n.cast("double")) / n)
    small = scaled.withColumns({"small": F.transform("acf", lambda v: F.abs(v) < bound), "top": F.size("acf") - 1})
    # The first lag after which QUIET autocorrelations in a row are too small to tell from none.
    runs = F.filter(F.sequence(F.lit(1), F.greatest(F.size("acf") - QUIET - 1, F.lit(1))), lambda k: F.forall(F.slice("small", k + 1, QUIET), lambda s: s))
    ended = small.withColumn("top", F.least(F.greatest(2 * F.coalesce(F.get(runs, F.lit(0)), F.lit(0)), F.lit(1)), F.col("top")))
    flat = lambda k: F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * (1 - k / F.col("top"))))
    weighted = lambda f: F.aggregate(F.sequence(F.lit(1), F.col("top")), F.lit(0.0), lambda s, k: s + f(k) * flat(k) * F.get("acf", k))
    levels = ended.where((n >= LEAST_DAYS) & F.col("acf").isNotNull()).select("entry", "n", (2 * weighted(lambda k: k.cast("double"))).alias("slope"), (1 + 2 * weighted(lambda k: F.lit(1.0))).alias("level"))
    best = F.cbrt(1.5 * n * F.pow(F.col("slope") / F.nullif(F.col("level"), F.lit(0.0)), 2.0))
    found = levels.where("slope != 0 and level != 0").select("entry", F.least(F.greatest(F.rint(best), F.lit(1.0)), F.greatest(F.floor(n / 3), F.lit(1)).cast("double")).cast("int").alias("block"))
    return about.select("entry").join(found, "entry", "left").select("entry", F.coalesce("block", F.lit(DEFAULT_BLOCK)).alias("block"))

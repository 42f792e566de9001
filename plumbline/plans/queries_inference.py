"""Queries about Sharpe statistics, bootstraps, overfitting and the board."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline import board
from plumbline.functions import inference, longrun, overfit
from plumbline.functions.net_sharpe import Shape
from plumbline.functions.sharpe import normal_cdf, psr_argument, sharpe, sharpe_error
from plumbline.lineage import settled
from plumbline.operators import backtest as bt
from plumbline.operators import scoring
from plumbline.operators.positions import refusals, weights_from_predictions
from plumbline.operators.timeseries import change
from plumbline.panel import calendar
from plumbline.plans import costaware
from plumbline.plans.contestants import trained_signal
from plumbline.plans.panels import P1, P3, P4, actual_sql, daily_users, momentum, momentum_variants, priced, weekly_brands, weekly_market
from plumbline.plans.queries import BAR_SQL, BAR_TAIL, DAYS_SQL, MOMENTUM, NET_SQL, WEIGHT_SQL, book_sql, books_of, r, registered, rs
from plumbline.sources.sinks import web_series

ANNUAL = "sqrt(252.0::DOUBLE)"


def pair(spark: SparkSession, sf: str, rule: str = "long_flat") -> DataFrame:
    """(entry, ordinal, x, y): momentum's and the bar's net returns on P1."""
    p = priced(weekly_brands(spark, sf))
    x = bt.charge(books_of(p, rule)).select("entry", "ordinal", F.col("net").alias("x"))
    return x.join(bar_of(p), "ordinal").select("entry", "ordinal", "x", "y")


def bar_of(p: DataFrame) -> DataFrame:
    return bt.charge(bt.bar_books(p.select("date", "ticker", "target"))).select("ordinal", F.col("net").alias("y"))


PAIR_SQL = f"""{book_sql('p1', MOMENTUM, 'long_flat')}, {NET_SQL.split(',' + chr(10))[0]}, {BAR_TAIL},
xy AS (SELECT n.ordinal, n.net AS x, b.bar AS y FROM net n JOIN bar b ON n.ordinal = b.ordinal)"""


@registered(f"""WITH {PAIR_SQL}, m AS (SELECT count(*) AS n, avg(x) AS m, stddev_pop(x) AS s FROM xy), c AS (SELECT n, m / s AS sr, avg(pow((x - m) / s, 3)) AS g3, avg(pow((x - m) / s, 4)) AS g4 FROM xy CROSS JOIN m GROUP BY n, m, s)
SELECT {rs(f'sr * {ANNUAL} AS net_sharpe', f'sqrt((1 + 0.5 * sr * sr) / n) * {ANNUAL} AS sharpe_se', f'(sr - 0.5 / {ANNUAL}) * sqrt(n - 1.0::DOUBLE) / sqrt(greatest(1 - g3 * sr + (g4 - 1) / 4 * sr * sr, 1e-12)) AS psr_argument')} FROM c""")
def sharpe_moments(spark, sf):
    return pair(spark, sf).agg(r(sharpe("x"), "net_sharpe"), r(sharpe_error("x"), "sharpe_se"), r(psr_argument("x", 0.5), "psr_argument"))


#: The normal distribution function of z by its series: the density times the sum of z^(2k+1) / (2k+1)!!, plus one half.
PHI = "0.5 + sign(z) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 60 + ceil(z * z)::BIGINT), lambda k: exp((2 * k + 1) * ln(greatest(abs(z), 1e-300)) - z * z / 2 - (k + 1) * ln(2) - lgamma(k + 1.5) + 0.5 * ln(pi()))))"


@registered(f"""WITH {PAIR_SQL}, m AS (SELECT count(*) AS n, avg(x) AS m, stddev_pop(x) AS s FROM xy), c AS (SELECT n, m / s AS sr, avg(pow((x - m) / s, 3)) AS g3, avg(pow((x - m) / s, 4)) AS g4 FROM xy CROSS JOIN m GROUP BY n, m, s),
zz AS (SELECT sr * sqrt(n - 1.0::DOUBLE) / sqrt(greatest(1 - g3 * sr + (g4 - 1) / 4 * sr * sr, 1e-12)) AS z FROM c) SELECT {rs(f'{PHI} AS psr')} FROM zz""")
def probabilistic_sharpe(spark, sf):
    z = pair(spark, sf).agg(psr_argument("x").alias("z"))
    return z.select(r(normal_cdf("z"), "psr"))


LAGS = 5


COLUMNS = ("x", "y", "x * x", "y * y")
#: The gradient of the difference of Sharpe ratios by the means of these columns.
GRADIENT_SQL = """mo AS (SELECT count(*) AS t, avg(x) AS m1, avg(x * x) AS g1, avg(y) AS m2, avg(y * y) AS g2 FROM xy), d AS (SELECT *, g1 - m1 * m1 AS d1, g2 - m2 * m2 AS d2 FROM mo),
gr AS (SELECT *, g1 / pow(d1, 1.5) AS q0, -g2 / pow(d2, 1.5) AS q1, -m1 / (2 * pow(d1, 1.5)) AS q2, m2 / (2 * pow(d2, 1.5)) AS q3 FROM d)"""


def _each(template: str) -> str:
    return ", ".join(template.replace("#", str(k)) for k in range(4))


def _rho(of: str, before: str, out: str) -> str:
    return _each(f"greatest(-0.97, least(0.97, sum({of}# * {before}#) / nullif(sum({before}# * {before}#), 0))) AS {out}#")


#: The columns, centred (z), and what is left of them after their own first autocorrelation (u), with gradient entries beside.
WHITE_SQL = f"""{GRADIENT_SQL}, z AS (SELECT ordinal, {", ".join(f"{c} - avg({c}) OVER () AS z{k}" for k, c in enumerate(COLUMNS))} FROM xy), l AS (SELECT *, {_each("lag(z#) OVER (ORDER BY ordinal) AS p#")} FROM z),
rh AS (SELECT {_rho("z", "p", "r")} FROM l WHERE p0 IS NOT NULL), u AS (SELECT ordinal, {_each("z# - r# * p# AS u#")} FROM l CROSS JOIN rh WHERE p0 IS NOT NULL)"""


def _hac_sql() -> str:
    v = " + ".join(f"q{k} / (1 - r{k}) * u{k}" for k in range(4))
    auto = ", ".join(f"lag(v, {j}) OVER (ORDER BY ordinal) AS v{j}" for j in range(1, LAGS + 1))
    total = " + ".join(["sum(v * v)", *(f"2 * (1 - {j} / {LAGS + 1}.0::DOUBLE) * sum(v * v{j})" for j in range(1, LAGS + 1))])
    return f"""WITH {PAIR_SQL}, {WHITE_SQL}, vs AS (SELECT ordinal, {v} AS v FROM u CROSS JOIN rh CROSS JOIN gr), wv AS (SELECT v, {auto} FROM vs)
SELECT {rs(f'(max(m1) / sqrt(max(d1)) - max(m2) / sqrt(max(d2))) * {ANNUAL} AS edge', f'sqrt(({total}) / count(*) / max(t)) * {ANNUAL} AS se')} FROM wv CROSS JOIN gr"""


@registered(f"WITH {PAIR_SQL}, {WHITE_SQL} SELECT CAST(ordinal AS INTEGER) AS ordinal, {rs(' + '.join(f'q{k} * z{k}' for k in range(4)) + ' AS influence')} FROM z CROSS JOIN gr")
def influence_series(spark, sf):
    return inference.influences(pair(spark, sf)).select(F.col("ordinal").cast("int").alias("ordinal"), r("influence"))


#: Andrews' bandwidth of the whitened columns; ``al`` has n and alpha.
PLUG_IN_SQL = f"""k AS (SELECT *, {_each("lag(u#) OVER (ORDER BY ordinal) AS b#")} FROM u), h AS (SELECT {_rho("u", "b", "h")} FROM k WHERE b0 IS NOT NULL),
s4 AS (SELECT {_each("pow(avg(pow(u# - h# * b#, 2)), 2) AS s#")}, {_each("max(h#) AS h#")} FROM k CROSS JOIN h WHERE b0 IS NOT NULL), nu AS (SELECT count(*) AS n FROM u),
al AS (SELECT n, ({" + ".join(f"4 * h{k} * h{k} * s{k} / (pow(1 - h{k}, 6) * pow(1 + h{k}, 2))" for k in range(4))}) / ({" + ".join(f"s{k} / pow(1 - h{k}, 4)" for k in range(4))}) AS alpha FROM s4 CROSS JOIN nu),
plug AS (SELECT n, greatest(1.0, least(n - 2, 1.1447 * cbrt(alpha * n))) AS b FROM al)"""


@registered(f"WITH {PAIR_SQL}, {WHITE_SQL}, {PLUG_IN_SQL} SELECT {rs('b AS bandwidth')} FROM plug")
def andrews_bandwidth(spark, sf):
    return inference.bandwidths(pair(spark, sf)).select(r("bandwidth"))


@registered(f"""WITH {PAIR_SQL}, {WHITE_SQL}, i AS (SELECT ordinal, {" + ".join(f"q{k} * z{k}" for k in range(4))} AS v FROM z CROSS JOIN gr), n AS (SELECT count(*) AS n, avg(v) AS m, avg(v * v) - avg(v) * avg(v) AS s, least(ceil(sqrt(count(*))) + 5, count(*) - 3)::INTEGER AS most FROM i),
c AS (SELECT k.k, avg((a.v - m) * (b.v - m)) / max(s) AS acf FROM n, LATERAL (SELECT unnest(range(1, most + 1)) AS k) k JOIN i a ON true JOIN i b ON b.ordinal = a.ordinal + k.k GROUP BY 1),
f AS (SELECT k, acf, abs(acf) < 2 * sqrt(log10(n) / n) AS small, most, n FROM c CROSS JOIN n), qt AS (SELECT k, bool_and(small) OVER five AND count(*) OVER five = 5 AS quiet FROM f WHERE k < most WINDOW five AS (ORDER BY k ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
t AS (SELECT least(greatest(2 * coalesce((SELECT min(k) FROM qt WHERE quiet), 0), 1), most) AS top, n FROM n), wt AS (SELECT k, greatest(0.0, least(1.0, 2 * (1 - k / top::DOUBLE))) * acf AS x, t.n FROM c CROSS JOIN t WHERE k <= top),
lv AS (SELECT 2 * sum(k * x) AS slope, 1 + 2 * sum(x) AS level, max(n) AS n FROM wt) SELECT 'momentum' AS entry, CAST(greatest(1, least(round_even(pow(1.5 * n * pow(slope / level, 2), 1.0 / 3), 0), n // 3)) AS INTEGER) AS block FROM lv""")
def automatic_block_length(spark, sf):
    return inference.block_lengths(pair(spark, sf))


@registered(_hac_sql())
def hac_se_fixed_bandwidth(spark, sf):
    return inference.fixed_bandwidth_errors(pair(spark, sf), LAGS).select(r("edge"), r("se"))


def _automatic_sql() -> str:
    v = " + ".join(f"q{k} / (1 - r{k}) * u{k}" for k in range(4))
    return f"""WITH {PAIR_SQL}, {WHITE_SQL}, {PLUG_IN_SQL}, vs AS (SELECT ordinal, {v} AS v FROM u CROSS JOIN rh CROSS JOIN gr),
j AS (SELECT unnest(range(0, floor(b)::BIGINT + 1)) AS j, b, n FROM plug), p AS (SELECT j, max(b) AS b, max(n) AS n, sum(x.v * y.v) AS s FROM j JOIN vs x ON true JOIN vs y ON y.ordinal = x.ordinal - j GROUP BY j),
lr AS (SELECT sum(CASE WHEN j = 0 THEN s ELSE 2 * (1 - j / (b + 1)) * s END) / max(n) AS v, max(b) AS b FROM p)
SELECT 'momentum' AS entry, {rs('b AS bandwidth', f'(m1 / sqrt(d1) - m2 / sqrt(d2)) * {ANNUAL} AS edge', f'sqrt(v / t) * {ANNUAL} AS se')} FROM lr CROSS JOIN gr"""


@registered(_automatic_sql())
def hac_se_automatic(spark, sf):
    """The error with Andrews' own bandwidth."""
    return inference.long_run(pair(spark, sf)).select("entry", r("bandwidth"), r("edge"), r("se"))


def _matrix_sql() -> str:
    """Long-run covariance of every two columns over the product of their deviations."""
    lagged = ", ".join(_each(f"lag(u#, {j}) OVER (ORDER BY ordinal) AS u#_{j}") for j in range(1, LAGS + 1))
    names = ("x", "y", "xx", "yy")
    cells = []
    for a in range(4):
        for b in range(4):
            total = " + ".join([f"sum(u{a} * u{b})", *(f"(1 - {j} / {LAGS + 1}.0::DOUBLE) * (sum(u{a} * u{b}_{j}) + sum(u{b} * u{a}_{j}))" for j in range(1, LAGS + 1))])
            cells.append(f"SELECT '{names[a]}' AS a, '{names[b]}' AS b, round(({total}) / count(*) / (1 - max(r{a})) / (1 - max(r{b})) / max(k{a} * k{b}), 6) + 0.0 AS value FROM ul CROSS JOIN rh CROSS JOIN sd")
    return f"WITH {PAIR_SQL}, {WHITE_SQL}, ul AS (SELECT {_each('u#')}, {lagged} FROM u), sd AS (SELECT {', '.join(f'stddev_pop({c}) AS k{k}' for k, c in enumerate(COLUMNS))} FROM xy) {' UNION ALL '.join(cells)}"


@registered(_matrix_sql())
def hac_covariance_matrix(spark, sf):
    """The whole matrix, each cell over the product of the two columns' deviations."""
    xy = settled(pair(spark, sf))
    sd = xy.agg(*(F.stddev_pop(F.expr(c)).alias(n) for c, n in zip(COLUMNS, longrun.MOMENTS, strict=True))).unpivot([], list(longrun.MOMENTS), "name", "sd")
    cells = inference.hac_covariance(xy, LAGS).join(sd.toDF("a", "_a"), "a").join(sd.toDF("b", "_b"), "b")
    return cells.select("a", "b", r(F.col("value") / F.col("_a") / F.col("_b"), "value"))


REPS, BLOCK, STARTS = 200, 10, (7919, 104729, 31)


@registered(f"""WITH {PAIR_SQL}, n AS (SELECT count(*) AS t FROM xy), i AS (SELECT rep, pos, (({STARTS[0]} * rep + {STARTS[1]} * (pos // {BLOCK}) + {STARTS[2]}) % t + pos % {BLOCK}) % t AS src FROM n, (SELECT unnest(range({REPS})) AS rep), LATERAL (SELECT unnest(range(t)) AS pos)),
b AS (SELECT rep, avg(x) / nullif(stddev_pop(x), 0) * {ANNUAL} - avg(y) / nullif(stddev_pop(y), 0) * {ANNUAL} AS d FROM i JOIN xy ON i.src = xy.ordinal GROUP BY 1)
SELECT 'momentum' AS entry, {rs('quantile_cont(d, 0.025) AS ci_low', 'quantile_cont(d, 0.975) AS ci_high', 'avg(CASE WHEN d > 0 THEN 1.0::DOUBLE ELSE 0 END) AS p_positive')} FROM b""")
def bootstrap_formula_starts(spark, sf):
    return inference.formula_bootstrap(pair(spark, sf), REPS, BLOCK, STARTS).select("entry", r("ci_low"), r("ci_high"), r("p_positive"))


VARIANTS, BLOCKS = 8, 16


def variant_returns(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(variant, ordinal, ret) of momentum over 1 to VARIANTS rows, and the panel they are made from."""
    p = priced(weekly_brands(spark, sf))
    a, signals = p.select("date", "ticker", "target"), momentum_variants(p, range(1, VARIANTS + 1))
    days = bt.padded_days(spark.createDataFrame([(f"m{k}",) for k in range(1, VARIANTS + 1)], "entry string"), a)
    daily = bt.charge(bt.daily_books(weights_from_predictions(signals, a, "long_flat"), days))
    return daily.select(F.col("entry").alias("variant"), "ordinal", F.col("net").alias("ret")), p


PBO_SQL = f"""WITH {book_sql('p1', 1, 'long_flat').split(', s AS (')[0]}, ks AS (SELECT unnest(range(1, {VARIANTS + 1})) AS k),
s AS (SELECT 'm' || k AS variant, a.date, a.ticker, a.target, a.close / nullif(lag(a.close, k::INTEGER) OVER (PARTITION BY k, a.ticker ORDER BY a.date), 0) - 1 AS value FROM a CROSS JOIN ks),
w AS (SELECT variant, date, ticker, target, 1.0::DOUBLE / count(*) OVER (PARTITION BY variant, date) AS weight FROM s WHERE value > 0 AND target IS NOT NULL),
g AS (SELECT 'm' || k AS variant, g.ordinal, coalesce(w.weight * w.target, 0) AS gain, coalesce(w.weight, 0) - coalesce(lag(w.weight) OVER (PARTITION BY k, g.ticker ORDER BY g.ordinal), 0) AS d FROM grid g CROSS JOIN ks LEFT JOIN w ON w.variant = 'm' || k AND g.date = w.date AND g.ticker = w.ticker),
rt AS (SELECT variant, ordinal, sum(gain) - sum(abs(d)) * 10 / 1e4 AS ret FROM g GROUP BY 1, 2), z AS (SELECT (count(*) // {VARIANTS}) // {BLOCKS} AS size FROM rt),
b AS (SELECT variant, ordinal // size AS block, sum(ret) AS s1, sum(ret * ret) AS s2 FROM rt CROSS JOIN z WHERE ordinal < size * {BLOCKS} GROUP BY 1, 2), m AS (SELECT unnest(range(1 << {BLOCKS})) AS split), h AS (SELECT split FROM m WHERE bit_count(split) = {BLOCKS // 2}),
q AS (SELECT split, variant, (split >> block) & 1 AS fit, sum(s1) / (max(size) * {BLOCKS // 2}) AS m, sum(s2) / (max(size) * {BLOCKS // 2}) AS g2 FROM h CROSS JOIN b CROSS JOIN z GROUP BY 1, 2, 3),
sr AS (SELECT split, variant, fit, m / sqrt(greatest(g2 - m * m, 1e-30)) AS sr FROM q), t AS (SELECT split, variant, rank() OVER (PARTITION BY split ORDER BY sr) + (count(*) OVER (PARTITION BY split, sr) - 1) / 2.0::DOUBLE AS rk FROM sr WHERE fit = 0),
bst AS (SELECT split, variant, row_number() OVER (PARTITION BY split ORDER BY sr DESC, variant) AS k FROM sr WHERE fit = 1), lg AS (SELECT t.split, rk, ln((rk / {VARIANTS + 1}) / (1 - rk / {VARIANTS + 1})) AS lo FROM bst JOIN t ON bst.split = t.split AND bst.variant = t.variant WHERE k = 1)
SELECT {rs('avg(CASE WHEN lo <= 0 THEN 1.0::DOUBLE ELSE 0 END) AS pbo')}, count(*) AS n_combinations, {rs('median(lo) AS median_logit', 'median(rk) AS median_rank')}, {BLOCKS} AS n_splits FROM lg"""


@registered(PBO_SQL)
def pbo_cscv(spark, sf):
    series, p = variant_returns(spark, sf)
    return overfit.overfitting_probability(series, calendar(p).count(), BLOCKS).select(r("pbo"), "n_combinations", r("median_logit"), r("median_rank"), "n_splits")


def user_stepdown(events: DataFrame, at_once: int = inference.HYPOTHESES_AT_ONCE) -> DataFrame:
    """The stepdown over one hypothesis a user, with a matrix of 40 columns from the events."""
    e = events.select(F.col("user_id").cast("string").alias("entry"), (F.col("event_id") % 40).cast("long").alias("rep"), "value")
    l = e.groupBy("entry", "rep").agg(F.max("value").alias("t_star"))  # noqa: E741
    full = l.select("entry").distinct().select("entry", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(39).cast("long"))).alias("rep")).join(l, ["entry", "rep"], "left").select("entry", "rep", F.coalesce("t_star", F.lit(0.0)).alias("t_star"))
    t = full.groupBy("entry").agg((3 * F.avg("t_star")).alias("t"), F.lit(True).alias("live"))
    return inference.stepdown(full.join(t, "entry"), at_once=at_once).select("entry", r("p_value_fwe"), "clears_bar_fwe")


STEPDOWN_SQL = """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS entry, CAST(event_id % 40 AS BIGINT) AS rep, value FROM events), l AS (SELECT entry, rep, max(value) AS t_star FROM e GROUP BY 1, 2),
x AS (SELECT n.entry, r.rep, coalesce(l.t_star, 0.0) AS t_star FROM (SELECT DISTINCT entry FROM l) n CROSS JOIN (SELECT unnest(range(40)) AS rep) r LEFT JOIN l ON n.entry = l.entry AND r.rep = l.rep), t AS (SELECT entry, 3 * avg(t_star) AS t FROM x GROUP BY 1),
k AS (SELECT x.entry, rep, t, max(t_star) OVER (PARTITION BY rep ORDER BY t, x.entry DESC ROWS UNBOUNDED PRECEDING) AS top FROM x JOIN t ON x.entry = t.entry), p AS (SELECT entry, t, (count(*) FILTER (top >= t) + 1)::DOUBLE / 41 AS p FROM k GROUP BY 1, 2),
a AS (SELECT entry, t, max(p) OVER (ORDER BY t DESC, entry ROWS UNBOUNDED PRECEDING) AS p FROM p) SELECT entry, round(p, 6) + 0.0 AS p_value_fwe, p <= 0.05 AND t > 0 AS clears_bar_fwe FROM a"""


@registered(STEPDOWN_SQL)
def stepdown_from_matrix(spark, sf):
    return user_stepdown(spark.read.parquet(f"{sf}/events.parquet"))


@registered(STEPDOWN_SQL)
def stepdown_of_all_users(spark, sf):
    """The same in ranges of 64 users, whose maxima are carried from one to the next."""
    return user_stepdown(spark.read.parquet(f"{sf}/events.parquet"), at_once=64)


@registered()
def net_edge_studentized(spark, sf):
    return inference.net_edge(pair(spark, sf), "ledoit_wolf")


@registered()
def net_edge_percentile(spark, sf):
    return inference.net_edge(pair(spark, sf), "percentile")


@registered()
def joint_stepdown(spark, sf):
    series, p = variant_returns(spark, sf)
    return inference.joint_sharpe_tests(series.select(F.col("variant").alias("entry"), "ordinal", F.col("ret").alias("x")).join(bar_of(p), "ordinal"))


JOINT_REPS = 60


def _joint_sql() -> str:
    """The whole joint test: resampled series (rep -1 is the sample), whitening, bandwidth and lag sums of each, intervals, p values, stepdown."""
    a, c, k = STARTS
    each = lambda t: ", ".join(t.replace("#", str(i)) for i in range(4))
    rho = lambda of, before, out: each(f"greatest(-0.97, least(0.97, coalesce(sum({of}# * {before}#) / nullif(sum({before}# * {before}#), 0), 0))) AS {out}#")
    keys = "variant, rep"
    return f"""{PBO_SQL.split(', z AS (SELECT (count(*)')[0]}, {BAR_TAIL}, xy AS (SELECT variant, rt.ordinal, rt.ret AS x, bar.bar AS y FROM rt JOIN bar ON rt.ordinal = bar.ordinal), t AS (SELECT count(*) // {VARIANTS} AS t FROM xy),
i AS (SELECT -1 AS rep, pos, pos AS src FROM t, LATERAL (SELECT unnest(range(t)) AS pos) UNION ALL SELECT rep, pos, (({a} * rep + {c} * (pos // {BLOCK}) + {k}) % t + pos % {BLOCK}) % t FROM t, (SELECT unnest(range({JOINT_REPS})) AS rep), LATERAL (SELECT unnest(range(t)) AS pos)),
smp AS (SELECT variant, rep, pos, x AS c0, y AS c1, x * x AS c2, y * y AS c3 FROM i JOIN xy ON i.src = xy.ordinal),
mo AS (SELECT {keys}, count(*) AS t, {each("avg(c#) AS a#")} FROM smp GROUP BY 1, 2), dd AS (SELECT *, a2 - a0 * a0 AS d1, a3 - a1 * a1 AS d2 FROM mo),
gr AS (SELECT {keys}, t, a0, a1, a2, a3, a0 / sqrt(d1) - a1 / sqrt(d2) AS edge, a2 / pow(d1, 1.5) AS q0, -a3 / pow(d2, 1.5) AS q1, -a0 / (2 * pow(d1, 1.5)) AS q2, a1 / (2 * pow(d2, 1.5)) AS q3 FROM dd),
z AS (SELECT {keys}, pos, {each("c# - a# AS z#")} FROM smp JOIN gr USING ({keys})), l AS (SELECT *, {each("lag(z#) OVER w AS p#")} FROM z WINDOW w AS (PARTITION BY {keys} ORDER BY pos)),
rh AS (SELECT {keys}, {rho("z", "p", "r")} FROM l WHERE pos > 0 GROUP BY 1, 2), u AS (SELECT {keys}, pos, {each("z# - r# * p# AS u#")} FROM l JOIN rh USING ({keys}) WHERE pos > 0),
ub AS (SELECT *, {each("lag(u#) OVER w AS b#")} FROM u WINDOW w AS (PARTITION BY {keys} ORDER BY pos)), h AS (SELECT {keys}, {rho("u", "b", "h")} FROM ub WHERE pos > 1 GROUP BY 1, 2),
s4 AS (SELECT {keys}, {each("pow(avg(pow(u# - h# * b#, 2)), 2) AS s#")}, {each("max(h#) AS h#")} FROM ub JOIN h USING ({keys}) WHERE pos > 1 GROUP BY 1, 2),
plug AS (SELECT {keys}, greatest(1.0, least(t - 3, 1.1447 * cbrt((t - 1) * ({" + ".join(f"4 * h{i} * h{i} * s{i} / (pow(1 - h{i}, 6) * pow(1 + h{i}, 2))" for i in range(4))}) / ({" + ".join(f"s{i} / pow(1 - h{i}, 4)" for i in range(4))})))) AS b FROM s4 JOIN gr USING ({keys})),
v AS (SELECT {keys}, pos, {" + ".join(f"q{i} / (1 - r{i}) * u{i}" for i in range(4))} AS v FROM u JOIN rh USING ({keys}) JOIN gr USING ({keys})),
j AS (SELECT {keys}, b, unnest(range(0, floor(b)::BIGINT + 1)) AS j FROM plug), lg AS (SELECT j.variant, j.rep, j.j, max(b) AS b, sum(x.v * y.v) AS s FROM j JOIN v x ON x.variant = j.variant AND x.rep = j.rep JOIN v y ON y.variant = x.variant AND y.rep = x.rep AND y.pos = x.pos - j.j GROUP BY 1, 2, 3),
e AS (SELECT variant, rep, max(edge) * {ANNUAL} AS d, sqrt(greatest(sum(CASE WHEN j = 0 THEN s ELSE 2 * (1 - j / (b + 1)) * s END), 0) / max(t - 1) / max(t)) * {ANNUAL} AS se FROM lg JOIN gr USING ({keys}) GROUP BY 1, 2),
o AS (SELECT variant, d, se, d / se AS t FROM e WHERE rep = -1), b AS (SELECT e.variant, e.rep, o.d, o.se, o.t, (e.d - o.d) / e.se AS star FROM e JOIN o USING (variant) WHERE e.rep >= 0),
top AS (SELECT variant, rep, t, max(star) OVER (PARTITION BY rep ORDER BY t, variant DESC ROWS UNBOUNDED PRECEDING) AS top FROM b), pf AS (SELECT variant, t, (count(*) FILTER (top >= t) + 1)::DOUBLE / {JOINT_REPS + 1} AS p FROM top GROUP BY 1, 2),
fw AS (SELECT variant, max(p) OVER (ORDER BY t DESC, variant ROWS UNBOUNDED PRECEDING) AS p FROM pf), own AS (SELECT variant, d, se, t, quantile_cont(star, 0.975) AS hi, quantile_cont(star, 0.025) AS lo, count(*) FILTER (star >= t) AS n1, count(*) FILTER (abs(star) >= abs(t)) AS n2 FROM b GROUP BY 1, 2, 3, 4)
SELECT variant AS entry, {rs('d AS net_edge', 'se', 't AS t_stat', 'd - hi * se AS ci_low', 'd - lo * se AS ci_high', f'(n1 + 1)::DOUBLE / {JOINT_REPS + 1} AS p_value', f'(n2 + 1)::DOUBLE / {JOINT_REPS + 1} AS p_value_two_sided', 'fw.p AS p_value_fwe')}, d - hi * se > 0 AS clears_bar, fw.p <= 0.05 AND t > 0 AS clears_bar_fwe FROM own JOIN fw USING (variant)"""


@registered(_joint_sql())
def joint_stepdown_formula(spark, sf):
    """The joint test of all variants with blocks whose starts are a formula, so that SQL can draw the same ones."""
    series, p = variant_returns(spark, sf)
    board_series = series.select(F.col("variant").alias("entry"), "ordinal", F.col("ret").alias("x")).join(bar_of(p), "ordinal")
    found = inference.joint_sharpe_tests(board_series, JOINT_REPS, BLOCK, seed=STARTS)
    return found.select("entry", *map(r, ("net_edge", "se", "t_stat", "ci_low", "ci_high", "p_value", "p_value_two_sided", "p_value_fwe")), "clears_bar", "clears_bar_fwe")


WINDOWS = {"early": ("1992-01-01", "1995-06-30"), "late": ("1995-07-01", "1998-12-31")}


#: Weights of one half on brands whose digits add up to an even number, minus that on the others.
SIDES = "(CASE WHEN (ascii(substr(ticker, 7, 1)) + ascii(substr(ticker, 8, 1))) % 2 = 0 THEN 1 ELSE -1 END)"


def market_index(spark: SparkSession, sf: str) -> DataFrame:
    """(date, ret): the damped next change of P4's level, as an index one could have bought."""
    ahead = F.lead("vix").over(Window.orderBy("date"))
    return weekly_market(spark, sf).select("date", (0.02 * F.ln(ahead / F.col("vix"))).alias("ret")).where("ret is not null")


def submitted(p: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries, signals): momentum by three rules, the bar itself, and weights that are long and short alike."""
    rules = {"flat": "long_flat", "short": "long_short", "top": "long_top"}
    known = p.where("target is not null")
    sides = known.select(F.lit("sides").alias("entry"), "date", "ticker", (F.expr(SIDES) / F.count(F.lit(1)).over(Window.partitionBy("date"))).alias("value"))
    signals = momentum(p, MOMENTUM, *rules).unionByName(known.select(F.lit("always_long").alias("entry"), "date", "ticker", F.lit(1.0).alias("value"))).unionByName(sides)
    rows = [(e, "predictions", q, 0.1) for e, q in rules.items()] + [("always_long", "predictions", "long_flat", 0.1), ("sides", "weights", "long_flat", 0.1)]
    return p.sparkSession.createDataFrame(rows, "entry string, kind string, rule string, quantile double"), signals


def scored(spark: SparkSession, sf: str, investable: bool = False, names: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Scores and daily rows of the named entries, or of all."""
    p = priced(weekly_brands(spark, sf))
    entries, signals = (df.where(F.col("entry").isin(*names)) if names else df for df in submitted(p))
    return scoring.score(signals, entries, p.select("date", "ticker", "target"), WINDOWS, market_index(spark, sf) if investable else None)


def _window_sql() -> str:
    """The scores of ``flat`` and ``short`` written out for one window each; windows start anew."""
    parts = []
    for window, (start, end) in WINDOWS.items():
        for entry, rule in (("flat", "long_flat"), ("short", "long_short"), ("top", "long_top")):
            bar = "0.0::DOUBLE" if rule == "long_short" else f"(SELECT avg(bar) / nullif(stddev_pop(bar), 0) * {ANNUAL} FROM bar)"
            inner = book_sql("p1", MOMENTUM, rule)
            cut = f"date BETWEEN DATE '{start}' AND DATE '{end}'"
            inner = inner.replace("FROM (SELECT DISTINCT date FROM p1)", f"FROM (SELECT DISTINCT date FROM p1 WHERE {cut})").replace("value IS NOT NULL AND target", f"{cut} AND value IS NOT NULL AND target")
            net = "gross - turnover * 10 / 1e4 - short_exposure * 50 / 1e4 / 252"
            sr = lambda x: f"avg({x}) / nullif(stddev_pop({x}), 0) * {ANNUAL}"
            parts.append(f"""(WITH {inner}, {BAR_TAIL} SELECT '{window}' AS "window", '{entry}' AS entry, count(*) AS days, '{'cash' if rule == 'long_short' else 'universe'}' AS bar_used, {rs(f'{sr(net)} AS net_sharpe', f'{bar} AS bar_sharpe', f'{sr(net)} - {bar} AS net_edge', f"{sr('gross - short_exposure * 50 / 1e4 / 252')} AS gross_sharpe", f"{sr('gross - turnover * 20 / 1e4 - short_exposure * 50 / 1e4 / 252')} AS net_sharpe_20bps")} FROM daily)""")
    return " UNION ALL ".join(parts)


@registered(_window_sql())
def window_scores(spark, sf):
    scores, _ = scored(spark, sf, names=("flat", "short", "top"))
    return scores.select("window", "entry", "days", "bar_used", *map(r, ("net_sharpe", "bar_sharpe", "net_edge", "gross_sharpe", "net_sharpe_20bps")))


@registered(f"WITH {P4}, x AS (SELECT date, lead(vix) OVER (ORDER BY date) / vix AS q FROM p4), n AS (SELECT * FROM (VALUES ('early', DATE '1992-01-01', DATE '1995-06-30'), ('late', DATE '1995-07-01', DATE '1998-12-31')) t(win, s, e)), d AS (SELECT DISTINCT CAST(date_trunc('week', l_shipdate) AS DATE) AS date FROM lineitem) SELECT win AS \"window\", count(*) AS investable_days FROM n JOIN x ON x.date BETWEEN s AND e JOIN d ON d.date = x.date WHERE q IS NOT NULL GROUP BY 1")
def investable_days(spark, sf):
    scores, _ = scored(spark, sf, True, ("always_long",))
    return scores.select("window", "investable_days")


def _stress_sql() -> str:
    """Scores under stressed borrowing of momentum's short book and of weights on both sides, a part for each window."""
    parts = []
    for window, (start, end) in WINDOWS.items():
        cut = f"date BETWEEN DATE '{start}' AND DATE '{end}'"
        sides = f"SELECT date, ticker, target, {SIDES} / count(*) OVER (PARTITION BY date)::DOUBLE AS weight FROM a WHERE target IS NOT NULL AND {cut}"
        for entry, rule in (("short", "long_short"), ("sides", None)):
            inner = book_sql("p1", MOMENTUM, "long_short")
            inner = inner.replace("FROM (SELECT DISTINCT date FROM p1)", f"FROM (SELECT DISTINCT date FROM p1 WHERE {cut})").replace("value IS NOT NULL AND target", f"{cut} AND value IS NOT NULL AND target")
            inner = inner if rule else inner.replace(WEIGHT_SQL["long_short"], sides)
            net = "gross - turnover * 10 / 1e4 - short_exposure * 500 / 1e4 / 252"
            parts.append(f"""(WITH {inner} SELECT '{window}' AS "window", '{entry}' AS entry, {"'cash'" if rule else "CASE WHEN abs(avg(exposure)) < 0.1 AND avg(short_exposure) > 0.05 THEN 'cash' ELSE 'universe' END"} AS bar_used, {rs(f'avg({net}) / nullif(stddev_pop({net}), 0) * {ANNUAL} AS net_sharpe_borrow_500bps', 'avg(exposure) AS avg_exposure', 'avg(short_exposure) AS avg_short_exposure')} FROM daily)""")
    return " UNION ALL ".join(parts)


@registered(_stress_sql())
def stress_scores(spark, sf):
    scores, _ = scored(spark, sf, names=("short", "sides"))
    return scores.select("window", "entry", "bar_used", *map(r, ("net_sharpe_borrow_500bps", "avg_exposure", "avg_short_exposure")))


def _index_sql() -> str:
    """The always-long book's and the index's Sharpe ratios on the index's days of each window."""
    parts = []
    for window, (start, end) in WINDOWS.items():
        cut = f"date BETWEEN DATE '{start}' AND DATE '{end}'"
        bar = BAR_SQL.replace("FROM (SELECT DISTINCT date FROM p1)", f"FROM (SELECT DISTINCT date FROM p1 WHERE {cut})").replace("FROM a WHERE target IS NOT NULL", f"FROM a WHERE {cut} AND target IS NOT NULL")
        sr = lambda x: f"avg({x}) / nullif(stddev_pop({x}), 0) * {ANNUAL}"
        parts.append(f"""(WITH {bar}, {P4}, i AS (SELECT date, 0.02::DOUBLE * ln(lead(vix) OVER (ORDER BY date) / vix) AS ret FROM p4)
SELECT '{window}' AS "window", count(*) AS investable_days, {rs(f'{sr("i.ret")} AS investable_sharpe', f'{sr("bar")} - {sr("i.ret")} AS edge_vs_investable')} FROM bar JOIN i ON bar.date = i.date WHERE i.ret IS NOT NULL)""")
    return " UNION ALL ".join(parts)


@registered(_index_sql())
def index_scores(spark, sf):
    scores, _ = scored(spark, sf, True, ("always_long",))
    return scores.select("window", "investable_days", r("investable_sharpe"), r("edge_vs_investable"))


@registered(f"""WITH {P1}, {actual_sql('p1')}, k AS (SELECT date, ticker, {SIDES} AS side, row_number() OVER (PARTITION BY date ORDER BY ticker) AS place, count(*) OVER (PARTITION BY date)::DOUBLE AS n FROM a WHERE target IS NOT NULL),
w AS (SELECT 'even' AS entry, 'long_flat' AS rule, date, ticker, 1 / n AS value FROM k UNION ALL SELECT 'lever', 'long_flat', date, ticker, 2 / n FROM k UNION ALL SELECT 'shorts', 'long_flat', date, ticker, side / n FROM k
 UNION ALL SELECT 'allowed', 'long_short', date, ticker, side / n FROM k UNION ALL SELECT 'levered shorts', 'long_flat', date, ticker, -1.5::DOUBLE / n FROM k UNION ALL SELECT 'twice', 'long_flat', date, ticker, 0.5::DOUBLE / n FROM k UNION ALL SELECT 'twice', 'long_flat', date, ticker, 0.5::DOUBLE / n FROM k WHERE place = 1),
d AS (SELECT entry, rule, date, sum(abs(value)) AS gross, min(value) AS least FROM w GROUP BY 1, 2, 3)
SELECT DISTINCT entry, 'gross exposure above one' AS reason FROM d WHERE gross > 1 + 1e-6 UNION ALL SELECT DISTINCT entry, 'negative weights' FROM d WHERE least < -1e-12 AND rule <> 'long_short'
UNION ALL SELECT DISTINCT entry, 'duplicate rows' FROM (SELECT entry FROM w GROUP BY entry, date, ticker HAVING count(*) > 1)""")
def refused_entries(spark, sf):
    p = priced(weekly_brands(spark, sf))
    k = p.where("target is not null").select("date", "ticker", F.expr(SIDES).alias("side"), F.row_number().over(Window.partitionBy("date").orderBy("ticker")).alias("place"), F.count(F.lit(1)).over(Window.partitionBy("date")).cast("double").alias("n"))
    rules = {"even": ("long_flat", "1 / n"), "lever": ("long_flat", "2 / n"), "shorts": ("long_flat", "side / n"), "allowed": ("long_short", "side / n"), "levered shorts": ("long_flat", "-1.5D / n"), "twice": ("long_flat", "0.5D / n")}
    wide = k.select("date", "ticker", "place", *(F.expr(x).cast("double").alias(e) for e, (_, x) in rules.items()))
    signals = wide.unpivot(["date", "ticker", "place"], list(rules), "entry", "value")
    signals = signals.unionByName(signals.where("entry = 'twice' and place = 1")).select("entry", "date", "ticker", "value")
    entries = spark.createDataFrame([(e, "weights", rule, 0.1) for e, (rule, _) in rules.items()], "entry string, kind string, rule string, quantile double")
    return refusals(signals, entries, p.select("date", "ticker", "target"))


@registered()
def board_json(spark, sf):
    p = priced(weekly_brands(spark, sf))
    entries = spark.createDataFrame([("m2", "predictions", "long_flat", 0.1), ("m4", "predictions", "long_short", 0.1)], "entry string, kind string, rule string, quantile double")
    rows, _ = board.build(spark, p.select("date", "ticker", "target"), entries, momentum_variants(p, (2, 4)), WINDOWS, market_index(spark, sf))
    return board.ranked(rows).select("window", "entry", F.to_json(F.struct("rule", "bar_used", "net_edge", "ci_low", "ci_high", "p_value_fwe", "net_sharpe", "max_drawdown", "edge_vs_investable", "ci_low_vs_investable")).alias("row"))


@registered()
def web_export(spark, sf):
    _, daily = scored(spark, sf)
    return web_series(daily)


def _web_sql() -> str:
    parts = []
    for window, (start, end) in WINDOWS.items():
        cut = f"date BETWEEN DATE '{start}' AND DATE '{end}'"
        for entry, rule in (("flat", "long_flat"), ("short", "long_short"), ("top", "long_top")):
            inner = book_sql("p1", MOMENTUM, rule).replace("FROM (SELECT DISTINCT date FROM p1)", f"FROM (SELECT DISTINCT date FROM p1 WHERE {cut})").replace("value IS NOT NULL AND target", f"{cut} AND value IS NOT NULL AND target")
            parts.append(f"""(WITH {inner} SELECT '{window}' AS "window", '{entry}' AS entry, CAST(date AS VARCHAR) AS date, {rs('gross', 'turnover', 'short_exposure')} FROM daily)""")
    return " UNION ALL ".join(parts)


@registered(_web_sql())
def web_export_read_back(spark, sf):
    """The exported JSON, parsed and laid out again as rows."""
    fields = "date array<string>, gross array<double>, turnover array<double>, short_exposure array<double>"
    read = web_export(spark, sf).where("entry in ('flat', 'short', 'top')").select("window", "entry", F.from_json("json", fields).alias("j"))
    rows = read.select("window", "entry", F.explode(F.arrays_zip(*(F.col(f"j.{c}").alias(c) for c in ("date", "gross", "turnover", "short_exposure")))).alias("d"))
    return rows.select("window", "entry", F.col("d.date").alias("date"), *(r(F.col(f"d.{c}"), c) for c in ("gross", "turnover", "short_exposure")))


#: Offset last, as the network has it; the two features are changes over 1 and 4 rows.
NET_WEIGHTS, NET_LAGS = (3.0, -2.0, 0.25), (1, 4)


def net_panel(spark: SparkSession, sf: str) -> DataFrame:
    p = priced(weekly_brands(spark, sf))
    return p.select("date", "ticker", "target", *(change("close", k).alias(f"x{k}") for k in NET_LAGS))


def _gradient_sql() -> str:
    """Weights of a network without inner layers, their slopes by each parameter (k = 2 is the offset), and the days' returns and slopes."""
    a, b, c = NET_WEIGHTS
    x = ", ".join(f"close / nullif(lag(close, {k}) OVER v, 0) - 1 AS x{k}" for k in NET_LAGS)
    each = lambda t: ", ".join(t.replace("#", str(k)) for k in range(3))
    return f"""WITH {P1}, {actual_sql('p1')}, f AS (SELECT date, ticker, target, {x} FROM a WINDOW v AS (PARTITION BY ticker ORDER BY date)), g AS (SELECT * FROM f WHERE target IS NOT NULL AND x{NET_LAGS[0]} IS NOT NULL AND x{NET_LAGS[1]} IS NOT NULL),
n AS (SELECT date, count(*)::DOUBLE AS names, row_number() OVER (ORDER BY date) - 1 AS t FROM g GROUP BY 1), s AS (SELECT t, ticker, target, names, x{NET_LAGS[0]} AS f0, x{NET_LAGS[1]} AS f1, 1.0::DOUBLE AS f2, 1 / (1 + exp(-({a} * x{NET_LAGS[0]} + {b} * x{NET_LAGS[1]} + {c}))) AS p FROM g JOIN n ON g.date = n.date),
w AS (SELECT t, ticker, target, p / names AS w, {each("p * (1 - p) / names * f# AS d#")} FROM s),
m AS (SELECT w.t, w.w * w.target AS gross, abs(w.w - coalesce(o.w, 0)) AS traded, {each("w.d# * w.target AS e#, sign(w.w - coalesce(o.w, 0)) * (w.d# - coalesce(o.d#, 0)) AS h#")} FROM w LEFT JOIN w o ON o.ticker = w.ticker AND o.t = w.t - 1
 UNION ALL SELECT o.t + 1, 0, o.w, {each("0, o.d#")} FROM w o LEFT JOIN w ON w.ticker = o.ticker AND w.t = o.t + 1 WHERE w.t IS NULL AND o.t + 1 < (SELECT count(*) FROM n)),
r AS (SELECT t, sum(gross) - 0.001::DOUBLE * sum(traded) AS r, sum(traded) AS turnover, {each("sum(e#) - 0.001::DOUBLE * sum(h#) AS q#")} FROM m GROUP BY 1),
z AS (SELECT count(*)::DOUBLE AS n, avg(r) AS mean, stddev_samp(r) AS s, avg(turnover) AS turnover, {each("sum(q#) AS a#, sum(r * q#) AS b#")} FROM r)
SELECT * FROM (SELECT 'sharpe' AS term, round(mean / (s + 1e-8) * {ANNUAL}, 6) + 0.0 AS value FROM z UNION ALL SELECT 'turnover', round(turnover, 6) + 0.0 FROM z
{"".join(f" UNION ALL SELECT 'd{k}', round(-{ANNUAL} * ((1 / (n * (s + 1e-8)) + mean * mean / ((n - 1) * s * pow(s + 1e-8, 2))) * a{k} - mean / ((n - 1) * s * pow(s + 1e-8, 2)) * b{k}), 6) + 0.0 FROM z" for k in range(3))})"""


@registered(_gradient_sql())
def net_return_gradient(spark, sf):
    """The ratio after costs and its gradient by every parameter of a network without inner layers."""
    shape = Shape(len(NET_LAGS), (), 0.0)
    return costaware.loss_and_gradient(net_panel(spark, sf), [f"x{k}" for k in NET_LAGS], NET_WEIGHTS, shape).select("term", r("value"))


def _net_days(p: DataFrame) -> tuple[str, str]:
    """The days up to which the network is trained and chosen: half and three quarters of the calendar."""
    days = calendar(p)
    n = days.count()
    return tuple(str(days.where(F.col("ordinal") == n * k // 4 - 1).first()["date"]) for k in (2, 3))


@registered()
def costaware_contestant(spark, sf):
    """Trained on net returns of the first half of the days, chosen on the next quarter, and predicting the last."""
    p = net_panel(spark, sf)
    train_end, val_end = _net_days(p)
    return costaware.costaware_signal(p, [f"x{k}" for k in NET_LAGS], train_end, val_end, seeds=(42, 43), shape=Shape(2, (16, 8), 0.3), epochs=2, steps=6, rate=1e-2)


@registered()
def linear_contestant(spark, sf):
    """Fitted on the first half of the days and predicting the rest, whose targets it never sees."""
    features = ["close", "range", "volume"]
    p = priced(daily_users(spark, sf)).withColumn("range", F.col("high") - F.col("low"))
    days = calendar(p)
    middle = days.where(F.col("ordinal") == F.floor(F.lit(days.count()) / 2) - 1).first()["date"]
    return trained_signal(p, features, str(middle), "linear")


@registered(f"WITH {P3}, {DAYS_SQL.format('p3')}, m AS (SELECT date FROM days WHERE ordinal = (SELECT count(*) // 2 FROM days) - 1) SELECT ticker, count(*) AS predictions, min(date) AS first_date, max(date) AS last_date FROM p3 WHERE date > (SELECT date FROM m) GROUP BY 1")
def linear_contestant_days(spark, sf):
    """Which days are predicted: only those after the ones it was fitted on."""
    return linear_contestant(spark, sf).groupBy("ticker").agg(F.count("value").alias("predictions"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))

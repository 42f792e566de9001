"""Registered queries over the derived panels and the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.sharpe import sharpe
from plumbline.operators import backtest as bt
from plumbline.operators import crosssection as xs
from plumbline.operators import timeseries as ts
from plumbline.operators.positions import weights_from_predictions
from plumbline.panel import calendar, densify, every_kth_day, long_histories, only_finite, ratio, shift_days, thick_dates, to_long, to_wide
from plumbline.plans.panels import P1, P2, P3, actual_sql, daily_nations, daily_users, momentum, priced, weekly_brands, with_target

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
PLACES = 6


def registered(sql: str | None = None) -> Callable[[Query], Query]:
    """Adds a query under its function's name, with SQL where there is any."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r(c: str | Column, name: str | None = None, places: int = PLACES) -> Column:
    """Rounded, without negative zero."""
    col = F.col(c) if isinstance(c, str) else c
    return (F.round(col, places) + 0.0).alias(name or c)


def fine(*columns: str) -> list[Column]:
    """Rounded past the seven decimals that a quotient of one row can have, where ties would round by engine."""
    return [r(c, places=9) for c in columns]


def rs(*exprs: str, places: int = PLACES) -> str:
    """The same in SQL, for ``expression AS name`` or a plain column."""
    out = []
    for e in exprs:
        body, _, name = e.rpartition(" AS ")
        out.append(f"round({body or name}, {places}) + 0.0 AS {name}")
    return ", ".join(out)


DAYS_SQL = "days AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS ordinal FROM (SELECT DISTINCT date FROM {0}))"
GRID_SQL = "grid AS (SELECT d.date, d.ordinal, n.ticker FROM days d CROSS JOIN (SELECT DISTINCT ticker FROM {0}) n)"
DENSE_SQL = "dense AS (SELECT g.date, g.ordinal, g.ticker, p.close FROM grid g LEFT JOIN {0} p ON g.date = p.date AND g.ticker = p.ticker)"


# --- scans and reshapes -------------------------------------------------------------------


@registered(f"WITH {P2} SELECT date, ticker, {rs('close', 'high', 'low', 'volume', places=9)} FROM p2")
def panel_scan(spark, sf):
    return daily_nations(spark, sf).select("date", "ticker", *fine("close", "high", "low", "volume"))


@registered(f"WITH {P2}, {DAYS_SQL.format('p2')}, {GRID_SQL.format('p2')}, {DENSE_SQL.format('p2')} SELECT date, CAST(ordinal AS INTEGER) AS ordinal, ticker, {rs('coalesce(close, 0.0) AS close', places=9)} FROM dense")
def panel_densified(spark, sf):
    p = daily_nations(spark, sf)
    return densify(p, calendar(p), fill=0.0).select("date", F.col("ordinal").cast("int").alias("ordinal"), "ticker", *fine("close"))


@registered(f"WITH {P2}, c AS (SELECT date, count(*) AS n FROM p2 GROUP BY 1) SELECT date, ticker, {rs('close', places=9)} FROM p2 WHERE date NOT IN (SELECT date FROM c WHERE n < 0.5 * (SELECT median(n) FROM c))")
def thin_date_filter(spark, sf):
    return thick_dates(daily_nations(spark, sf)).select("date", "ticker", *fine("close"))


@registered(f"WITH {P3}, k AS (SELECT ticker FROM p3 GROUP BY 1 HAVING count(*) >= 25) SELECT date, ticker, {rs('close', places=9)} FROM p3 WHERE ticker IN (SELECT ticker FROM k)")
def min_history(spark, sf):
    return long_histories(daily_users(spark, sf), 25).select("date", "ticker", *fine("close"))


@registered(f"WITH {P1}, {DAYS_SQL.format('p1')}, n AS (SELECT 'Brand#' || a || b AS ticker FROM range(1, 6) x(a), range(1, 6) y(b)) SELECT d.date, n.ticker, {rs('p.close AS close', places=9)} FROM days d CROSS JOIN n LEFT JOIN p1 p ON d.date = p.date AND n.ticker = p.ticker")
def wide_and_long(spark, sf):
    """The panel spread out by name and gathered again, with what is missing."""
    names = [f"Brand#{a}{b}" for a in range(1, 6) for b in range(1, 6)]
    return to_long(to_wide(weekly_brands(spark, sf), names, "close"), "close", keep_null=True).select("date", "ticker", *fine("close"))


@registered(f"WITH {P2}, {DAYS_SQL.format('p2')} SELECT date, CAST(ordinal AS INTEGER) AS ordinal FROM days WHERE ordinal % 5 = 0")
def every_fifth_day(spark, sf):
    return every_kth_day(calendar(daily_nations(spark, sf)), 5).select("date", F.col("ordinal").cast("int").alias("ordinal"))


@registered(f"WITH {P3}, x AS (SELECT date, ticker, CASE CAST(ticker AS BIGINT) % 4 WHEN 0 THEN 'NaN'::DOUBLE WHEN 1 THEN 'Infinity'::DOUBLE WHEN 2 THEN NULL ELSE close END AS value FROM p3) SELECT date, ticker, {rs('value')} FROM x WHERE isfinite(value)")
def finite_values(spark, sf):
    kind = F.col("ticker").cast("bigint") % 4
    value = F.when(kind == 0, float("nan")).when(kind == 1, float("inf")).when(kind == 3, F.col("close"))
    return only_finite(daily_users(spark, sf).withColumn("value", value)).select("date", "ticker", r("value"))


# --- time series --------------------------------------------------------------------------


@registered(f"""WITH {P1} SELECT date, ticker, {rs(*(f"close / nullif(lag(close, {k}) OVER w, 0) - 1 AS ret_{k}" for k in (1, 5, 21, 63)))} FROM p1 WINDOW w AS (PARTITION BY ticker ORDER BY date)""")
def returns_multi_horizon(spark, sf):
    return weekly_brands(spark, sf).select("date", "ticker", *(r(ts.change("close", k), f"ret_{k}") for k in (1, 5, 21, 63)))


@registered(f"WITH {P1}, {actual_sql('p1')} SELECT date, ticker, {rs('target')} FROM a")
def target_lead(spark, sf):
    return with_target(weekly_brands(spark, sf)).select("date", "ticker", r("target"))


def _roll_sql(agg: str, x: str, n: int, least: int) -> str:
    return f"CASE WHEN count({x}) OVER (PARTITION BY ticker ORDER BY date ROWS {n - 1} PRECEDING) >= {least} THEN {agg}({x}) OVER (PARTITION BY ticker ORDER BY date ROWS {n - 1} PRECEDING) END"


@registered(f"""WITH {P1}, x AS (SELECT *, close / nullif(lag(close) OVER (PARTITION BY ticker ORDER BY date), 0) - 1 AS ret FROM p1),
y AS (SELECT *, {_roll_sql('avg', 'close', 20, 20)} AS mid, {_roll_sql('stddev_samp', 'close', 20, 20)} AS sd, {_roll_sql('avg', 'volume', 21, 21)} AS vm, {_roll_sql('stddev_samp', 'volume', 21, 21)} AS vs,
  {_roll_sql('avg', 'close', 10, 10)} AS m10, {_roll_sql('stddev_samp', 'ret', 21, 21)} AS s21, {_roll_sql('sum', 'ret', 60, 40)} AS sum60 FROM x)
SELECT date, ticker, {rs('(close - (mid - 2 * sd)) / nullif(4 * sd, 0) AS pct_b', '4 * sd / nullif(mid, 0) AS bandwidth', 'CASE WHEN vs > 0 THEN greatest(-5.0, least(5.0, (volume - vm) / nullif(vs, 0))) END AS volume_z', 'close / nullif(m10, 0) - 1 AS px_vs_sma10', 's21 * sqrt(252.0::DOUBLE) AS vol_21d', 'sum60')} FROM y""")
def rolling_features(spark, sf):
    p = weekly_brands(spark, sf).withColumn("ret", ts.change("close"))
    b, bw = ts.bollinger("close")
    return p.select(
        "date", "ticker", r(b, "pct_b"), r(bw, "bandwidth"), r(ts.volume_z("volume"), "volume_z"), r(ratio(F.col("close"), ts.rolling("mean", "close", 10)) - 1, "px_vs_sma10"),
        r(ts.rolling("std", "ret", 21) * F.sqrt(F.lit(252.0)), "vol_21d"), r(ts.rolling("sum", "ret", 60, least=40), "sum60"),
    )


EWM_SQL = f"""{P1}, o AS (
  SELECT *, row_number() OVER w AS k, close - lag(close) OVER w AS step, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr
  FROM p1 WINDOW w AS (PARTITION BY ticker ORDER BY date)
), e AS (
  SELECT ticker, k, date, close, close AS fast, close AS slow, 0.0::DOUBLE AS line, CAST(NULL AS DOUBLE) AS gain, CAST(NULL AS DOUBLE) AS loss, coalesce(tr, high - low) AS atr FROM o WHERE k = 1
  UNION ALL
  SELECT o.ticker, o.k, o.date, o.close, e.fast + (o.close - e.fast) * 2.0::DOUBLE / 13, e.slow + (o.close - e.slow) * 2.0::DOUBLE / 27,
         e.line + ((e.fast + (o.close - e.fast) * 2.0::DOUBLE / 13) - (e.slow + (o.close - e.slow) * 2.0::DOUBLE / 27) - e.line) * 2.0::DOUBLE / 10,
         coalesce(e.gain + (greatest(o.step, 0) - e.gain) / 14.0::DOUBLE, greatest(o.step, 0)), coalesce(e.loss + (greatest(-o.step, 0) - e.loss) / 14.0::DOUBLE, greatest(-o.step, 0)), e.atr + (o.tr - e.atr) / 14.0::DOUBLE
  FROM e JOIN o ON o.ticker = e.ticker AND o.k = e.k + 1
)"""
OSCILLATORS_SQL = "coalesce(100 - 100 / (1 + gain / nullif(loss, 0)), 50) AS rsi_14", "(fast - slow - line) / nullif(close, 0) AS macd_hist", "atr / nullif(close, 0) AS atr_14"


@registered(f"WITH RECURSIVE {EWM_SQL} SELECT date, ticker, {rs(*OSCILLATORS_SQL)} FROM e")
def ewm_indicators(spark, sf):
    return ts.oscillators(weekly_brands(spark, sf)).select("date", "ticker", r("rsi_14"), r("macd_hist"), r("atr_14"))


@registered(f"""WITH {P2}, {DAYS_SQL.format('p2')}, {GRID_SQL.format('p2')}, {DENSE_SQL.format('p2')}, f AS (SELECT min(date) AS date FROM days GROUP BY date_trunc('month', date))
SELECT date, ticker, {rs("last_value(CASE WHEN date IN (SELECT date FROM f) THEN close END IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS close", places=9)} FROM dense""")
def monthly_hold(spark, sf):
    p = daily_nations(spark, sf)
    return ts.monthly_hold(densify(p, calendar(p)), "close").select("date", "ticker", *fine("close"))


@registered(f"""WITH {P2}, {DAYS_SQL.format('p2')}, {GRID_SQL.format('p2')}, {DENSE_SQL.format('p2')}
SELECT date, ticker, {rs("last_value(CASE WHEN ordinal % 5 = 0 THEN close END IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS 4 PRECEDING) AS close", places=9)} FROM dense""")
def hold_between(spark, sf):
    p = daily_nations(spark, sf)
    return ts.hold_between(densify(p, calendar(p)), 5, "close").select("date", "ticker", *fine("close"))


@registered(f"""WITH {P1}, c AS (SELECT date, ticker, list(close) OVER (PARTITION BY ticker ORDER BY date ROWS 59 PRECEDING) AS ctx, lead(date) OVER (PARTITION BY ticker ORDER BY date) AS next_date FROM p1)
SELECT date, ticker, CAST(len(ctx) AS INTEGER) AS bars, {rs('ctx[1] AS oldest', places=9)}, {rs('list_sum(ctx) / len(ctx) AS mean_close')} FROM c WHERE len(ctx) >= 15 AND next_date IS NOT NULL""")
def context_windows(spark, sf):
    p = weekly_brands(spark, sf).withColumn("next_date", ts.ahead("date")).select("date", "ticker", "close", "next_date")
    return _contexts(p, 60, 15).select("date", "ticker", "bars", r("oldest", places=9), r("mean_close"))


@registered(f"""WITH {P2}, c AS (SELECT date, ticker, count(*) OVER v AS bars, first_value(close) OVER v AS oldest, avg(close) OVER v AS mean_close, lead(date) OVER (PARTITION BY ticker ORDER BY date) AS next_date FROM p2 WINDOW v AS (PARTITION BY ticker ORDER BY date ROWS 399 PRECEDING))
SELECT date, ticker, CAST(bars AS INTEGER) AS bars, {rs('oldest', places=9)}, {rs('mean_close')} FROM c WHERE bars >= 400 AND next_date IS NOT NULL""")
def context_of_400_bars(spark, sf):
    p = daily_nations(spark, sf).withColumn("next_date", ts.ahead("date")).select("date", "ticker", "close", "next_date")
    return _contexts(p, 400, 400).select("date", "ticker", "bars", r("oldest", places=9), r("mean_close"))


def _contexts(p: DataFrame, n: int, least: int) -> DataFrame:
    """The oldest and the mean close of each row's last n rows, for rows that another follows."""
    mean = lambda w: F.aggregate(w, F.lit(0.0), lambda a, x: a + x["close"]) / F.size(w)
    blocks = ts.context_blocks(p, ["close", "next_date"], n)
    return ts.over_windows(blocks, n, {"oldest": lambda w: w[0]["close"], "mean_close": mean}, keep=("next_date",), least=least).where("next_date is not null")


# --- cross section ------------------------------------------------------------------------


@registered(f"""WITH {P3}, s AS (SELECT date, ticker, floor(high) AS v FROM p3)
SELECT date, ticker, {rs("row_number() OVER (PARTITION BY date ORDER BY v, ticker)::DOUBLE / count(*) OVER (PARTITION BY date) AS pct_first",
"(rank() OVER (PARTITION BY date ORDER BY v) + (count(*) OVER (PARTITION BY date, v) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY date) - 0.5 AS pct_average")}, count(*) OVER (PARTITION BY date) AS names FROM s""")
def cross_ranks(spark, sf):
    s = daily_users(spark, sf).withColumn("v", F.floor("high"))
    return s.select("date", "ticker", r(xs.rank_first("v"), "pct_first"), r(xs.rank_average("v"), "pct_average"), xs.size("v").alias("names"))


SIGNAL3_SQL = f"""{P3}, {actual_sql('p3')}, s AS (
  SELECT date, ticker, target, close / nullif(lag(close, 2) OVER (PARTITION BY ticker ORDER BY date), 0) - 1 AS value FROM a
), v AS (SELECT * FROM s WHERE value IS NOT NULL AND target IS NOT NULL),
q AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY value, ticker)::DOUBLE / count(*) OVER (PARTITION BY date) AS p FROM v)"""
WEIGHT_SQL = {
    "long_flat": "SELECT date, ticker, target, 1.0::DOUBLE / count(*) OVER (PARTITION BY date) AS weight FROM q WHERE value > 0",
    "long_top": "SELECT date, ticker, target, 1.0::DOUBLE / count(*) OVER (PARTITION BY date) AS weight FROM q WHERE p > 1 - 0.1::DOUBLE",
    "long_short": """SELECT date, ticker, target, coalesce(0.5::DOUBLE * t / nullif(sum(t) OVER (PARTITION BY date), 0), 0) - coalesce(0.5::DOUBLE * b / nullif(sum(b) OVER (PARTITION BY date), 0), 0) AS weight
  FROM (SELECT *, CASE WHEN p > 1 - 0.1::DOUBLE THEN 1 ELSE 0 END AS t, CASE WHEN p <= 0.1::DOUBLE THEN 1 ELSE 0 END AS b FROM q) WHERE t + b > 0""",
}


def _weights(rule: str) -> Query:
    def query(spark, sf):
        a = with_target(daily_users(spark, sf))
        return weights_from_predictions(momentum(a, 2, "m2"), a.select("date", "ticker", "target"), rule).select("date", "ticker", r("weight"))

    query.__name__ = f"weights_{rule}"
    return query


for _rule, _sql in WEIGHT_SQL.items():
    registered(f"WITH {SIGNAL3_SQL}, w AS ({_sql}) SELECT date, ticker, {rs('weight')} FROM w WHERE weight <> 0")(_weights(_rule))


@registered(f"""WITH {SIGNAL3_SQL}, k AS (
  SELECT date, rank() OVER (PARTITION BY date ORDER BY value) + (count(*) OVER (PARTITION BY date, value) - 1) / 2.0::DOUBLE AS rv, rank() OVER (PARTITION BY date ORDER BY target) + (count(*) OVER (PARTITION BY date, target) - 1) / 2.0::DOUBLE AS rt FROM v
), d AS (SELECT date, covar_pop(rv, rt) / nullif(stddev_pop(rv) * stddev_pop(rt), 0) AS ic, count(*) AS n, count(DISTINCT rv) AS m FROM k GROUP BY 1)
SELECT 'm2' AS entry, count(ic) AS days, {rs('avg(ic) AS ic')} FROM d WHERE n >= 10 AND m > 1""")
def information_coefficient(spark, sf):
    a = with_target(daily_users(spark, sf))
    return xs.information_coefficient(momentum(a, 2, "m2"), a.select("date", "ticker", "target")).select("entry", "days", r("ic"))


# --- books --------------------------------------------------------------------------------

MOMENTUM = 4


def book_sql(panel: str, k: int, rule: str) -> str:
    """CTEs up to ``daily`` (date, ordinal, gross, turnover, exposure, gross_exposure, short_exposure, positions)."""
    src = P1 if panel == "p1" else P2
    return f"""{src}, {actual_sql(panel)}, {DAYS_SQL.format(panel)}, {GRID_SQL.format(panel)}, s AS (
  SELECT date, ticker, target, close / nullif(lag(close, {k}) OVER (PARTITION BY ticker ORDER BY date), 0) - 1 AS value FROM a
), v AS (SELECT * FROM s WHERE value IS NOT NULL AND target IS NOT NULL),
q AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY value, ticker)::DOUBLE / count(*) OVER (PARTITION BY date) AS p FROM v),
w AS ({WEIGHT_SQL[rule]}),
g AS (SELECT g.date, g.ordinal, g.ticker, coalesce(w.weight, 0) AS weight, coalesce(w.weight * w.target, 0) AS gain, coalesce(w.weight, 0) - coalesce(lag(w.weight) OVER (PARTITION BY g.ticker ORDER BY g.ordinal), 0) AS d
  FROM grid g LEFT JOIN w ON g.date = w.date AND g.ticker = w.ticker),
daily AS (SELECT date, ordinal, sum(gain) AS gross, sum(abs(d)) AS turnover, sum(weight) AS exposure, sum(abs(weight)) AS gross_exposure, sum(greatest(-weight, 0)) AS short_exposure, count(*) FILTER (weight <> 0) AS positions FROM g GROUP BY 1, 2)"""


NET_SQL = """net AS (SELECT *, short_exposure * 50 / 1e4 / 252 AS borrow, turnover * 10 / 1e4 + short_exposure * 50 / 1e4 / 252 AS cost, gross - turnover * 10 / 1e4 - short_exposure * 50 / 1e4 / 252 AS net FROM daily),
eq AS (SELECT *, product(1 + net) OVER (ORDER BY ordinal ROWS UNBOUNDED PRECEDING) * 1e6 AS equity FROM net),
cur AS (SELECT *, lag(equity, 1, 1e6) OVER (ORDER BY ordinal) AS equity_before, equity / max(equity) OVER (ORDER BY ordinal ROWS UNBOUNDED PRECEDING) - 1 AS drawdown FROM eq)"""


def books(spark: SparkSession, sf: str, rule: str = "long_short", k: int = MOMENTUM, prices=weekly_brands) -> DataFrame:
    """Daily books of the momentum signal on all days of a panel."""
    return books_of(priced(prices(spark, sf)), rule, k)


def books_of(a: DataFrame, rule: str = "long_short", k: int = MOMENTUM) -> DataFrame:
    positions = weights_from_predictions(momentum(a, k, "momentum"), a.select("date", "ticker", "target"), rule)
    days = calendar(a).select(F.lit("momentum").alias("entry"), "date", "ordinal")
    return bt.daily_books(positions, days)


@registered(f"WITH {book_sql('p2', 1, 'long_flat')} SELECT date, {rs('turnover', 'exposure')}, positions FROM daily")
def turnover_dense(spark, sf):
    return books(spark, sf, "long_flat", 1, daily_nations).select("date", r("turnover"), r("exposure"), "positions")


@registered(f"WITH {book_sql('p1', MOMENTUM, 'long_short')}, {NET_SQL} SELECT date, {rs('gross', 'turnover', 'short_exposure', 'borrow', 'cost', 'net', 'drawdown', 'equity')} FROM cur")
def backtest_daily(spark, sf):
    return bt.curve(bt.charge(books(spark, sf))).select("date", *map(r, ("gross", "turnover", "short_exposure", "borrow", "cost", "net", "drawdown", "equity")))


STATS = ("total_return", "annualized_return", "annualized_vol", "net_sharpe", "max_drawdown", "avg_exposure", "avg_gross_exposure", "avg_short_exposure", "avg_positions", "annual_turnover", "total_costs", "total_borrow", "dollar_pnl")
STATS_SQL = f"""t AS (SELECT count(*) AS days, max_by(equity, ordinal) / 1e6 - 1 AS total_return, stddev_samp(net) * sqrt(252.0::DOUBLE) AS annualized_vol, avg(net) / nullif(stddev_pop(net), 0) * sqrt(252.0::DOUBLE) AS net_sharpe, min(drawdown) AS max_drawdown,
 avg(exposure) AS avg_exposure, avg(gross_exposure) AS avg_gross_exposure, avg(short_exposure) AS avg_short_exposure, avg(positions) AS avg_positions, sum(turnover) / (count(*) / 252.0::DOUBLE) AS annual_turnover,
 sum(cost * equity_before) AS total_costs, sum(borrow * equity_before) AS total_borrow FROM cur),
u AS (SELECT *, pow(1 + total_return, 252.0::DOUBLE / days) - 1 AS annualized_return, 1e6 * total_return AS dollar_pnl FROM t)"""


def _stats(rule: str) -> Query:
    def query(spark, sf):
        return bt.statistics(bt.curve(bt.charge(books(spark, sf, rule)))).select("days", *map(r, STATS))

    query.__name__ = f"backtest_stats_{rule}"
    return query


for _rule in WEIGHT_SQL:
    registered(f"WITH {book_sql('p1', MOMENTUM, _rule)}, {NET_SQL}, {STATS_SQL} SELECT days, {rs(*STATS)} FROM u")(_stats(_rule))


@registered(f"""WITH {book_sql('p1', MOMENTUM, 'long_short')}, c AS (SELECT unnest([0, 5, 10, 15, 20, 25])::DOUBLE AS cost_bps),
n AS (SELECT cost_bps, gross - turnover * cost_bps / 1e4 - short_exposure * 50 / 1e4 / 252 AS net FROM daily CROSS JOIN c)
SELECT cost_bps, {rs('avg(net) / nullif(stddev_pop(net), 0) * sqrt(252.0::DOUBLE) AS sharpe')} FROM n GROUP BY 1""")
def cost_grid(spark, sf):
    return bt.cost_grid(books(spark, sf)).select("cost_bps", r("sharpe"))


@registered(f"""WITH {book_sql('p1', MOMENTUM, 'long_short')}, c AS (SELECT unnest([0, 50, 500])::DOUBLE AS borrow_bps),
n AS (SELECT borrow_bps, gross - turnover * 10 / 1e4 - short_exposure * borrow_bps / 1e4 / 252 AS net FROM daily CROSS JOIN c)
SELECT borrow_bps, {rs('avg(net) / nullif(stddev_pop(net), 0) * sqrt(252.0::DOUBLE) AS sharpe')} FROM n GROUP BY 1""")
def borrow_sensitivity(spark, sf):
    each = books(spark, sf).withColumn("borrow_bps", F.explode(F.array(*map(F.lit, (0.0, 50.0, 500.0)))))
    return bt.charge(each, bt.COST_BPS, F.col("borrow_bps")).groupBy("borrow_bps").agg(r(sharpe("net"), "sharpe"))


#: The bar's returns beside a book's CTEs, in CTEs of other names.
BAR_TAIL = """bw AS (SELECT date, ticker, target, 1.0::DOUBLE / count(*) OVER (PARTITION BY date) AS weight FROM a WHERE target IS NOT NULL),
bg AS (SELECT g.date, g.ordinal, coalesce(w.weight * w.target, 0) AS gain, coalesce(w.weight, 0) - coalesce(lag(w.weight) OVER (PARTITION BY g.ticker ORDER BY g.ordinal), 0) AS d FROM grid g LEFT JOIN bw w ON g.date = w.date AND g.ticker = w.ticker),
bar AS (SELECT date, ordinal, sum(gain) - sum(abs(d)) * 10 / 1e4 AS bar FROM bg GROUP BY 1, 2)"""
BAR_SQL = f"{P1}, {actual_sql('p1')}, {DAYS_SQL.format('p1')}, {GRID_SQL.format('p1')}, {BAR_TAIL}"


@registered(f"WITH {BAR_SQL} SELECT date, {rs('bar AS net')} FROM bar")
def bar_returns(spark, sf):
    a = priced(weekly_brands(spark, sf)).select("date", "ticker", "target")
    return bt.charge(bt.bar_books(a)).select("date", r("net"))


@registered(f"""WITH {book_sql('p2', 1, 'long_flat')}, {NET_SQL.split(',' + chr(10))[0]}, m AS (SELECT last_day(date) AS month, product(1 + net) - 1 AS ret FROM net GROUP BY 1),
z AS (SELECT CAST(last_day(x) AS DATE) AS month FROM (SELECT unnest(generate_series((SELECT min(date_trunc('month', month)) FROM m), (SELECT max(month) FROM m), INTERVAL 1 MONTH)) AS x))
SELECT z.month, {rs('coalesce(m.ret, 0) AS ret')} FROM z LEFT JOIN m ON z.month = m.month""")
def monthly_returns(spark, sf):
    return bt.monthly_returns(bt.charge(books(spark, sf, "long_flat", 1, daily_nations))).select("month", r("ret"))


@registered(f"""WITH {P2}, {DAYS_SQL.format('p2')} SELECT e.date, p.ticker, {rs('p.close AS close', places=9)} FROM p2 p JOIN days d ON p.date = d.date JOIN days e ON e.ordinal = d.ordinal - 1""")
def canary_off_by_one(spark, sf):
    p = daily_nations(spark, sf)
    return shift_days(p, calendar(p), -1).select("date", "ticker", *fine("close"))



"""Queries of the event, spread, test, strategy, walk-forward and summary operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairbars.functions.work import written
from pairbars.jobs import fixtures as fx
from pairbars.jobs.queries import query
from pairbars.jobs.sql import FORWARD, SESSION, corr, full, part, r, rs, sql, win
from pairbars.operators import backtest, correlation, events, features, leadlag, ratio, regimes, spread, stattests, summary, sync, walkforward

PERIODS = (1, 2, 3, 6, 12)

# events


def _walk(name: str, groups: str, source: str, order: str, start: str, end: str) -> None:
    """Numbers the candidates of each group and walks through them, keeping those that start after the last kept has ended."""
    part(f"{name}_n", source, f"SELECT *, row_number() OVER (PARTITION BY {groups} ORDER BY {order}) AS i FROM {source}")
    on = " AND ".join(f"c.{g.strip()} = w.{g.strip()}" for g in groups.split(","))
    cols = ", ".join(f"c.{g.strip()}" for g in groups.split(","))
    part(name, f"{name}_n", f"""SELECT {groups}, i, {end} AS last, true AS kept FROM {name}_n WHERE i = 1
      UNION ALL SELECT {cols}, c.i, CASE WHEN c.{start} > w.last THEN {end.replace('pos', 'c.pos')} ELSE w.last END, c.{start} > w.last FROM {name} w JOIN {name}_n c ON {on} AND c.i = w.i + 1""")
    part(f"{name}_k", f"{name} {name}_n", f"SELECT n.* FROM {name}_n n JOIN {name} USING ({groups}, i) WHERE kept")


_walk("e1", "pair_id", "cand", "rank, side, pos", "pos", "pos + 12")
_walk("e3", "pair_id, rank", "cand", "rank, side, pos", "pos", "pos + 12")
_EV = f"pair_id, bar_ts, threshold, direction, {rs('residual_zscore', 'a_log_return', 'b_log_return')}"
_cols = ["pair_id", "bar_ts", "threshold", "direction", "residual_zscore", "a_log_return", "b_log_return"]
query("e1_detect_divergences", sql("e1_k", f"SELECT {_EV} FROM e1_k", recursive=True))(lambda s, d: events.detect_divergences(fx.daily_scored(s, d), cooldown=12).select(_cols))
query("e1_detect_divergences_no_cooldown", sql("cand", f"SELECT {_EV} FROM cand"))(lambda s, d: events.detect_divergences(fx.daily_scored(s, d)).select(_cols))


def _forward(source: str, keys: str, table: str = "pb", group: str = "pair_id") -> str:
    """Statistics of the returns some bars after the rows of ``source``."""
    keyed = f"{keys}, " if keys else ""
    union = " UNION ALL ".join(f"SELECT {', '.join(group.split())}, pos, {p} AS period, '{s}' AS instrument, lead({s}_log_return, {p}) OVER w AS x, lead(1, {p}) OVER w AS has FROM {table} WINDOW w AS (PARTITION BY {', '.join(group.split())} ORDER BY bar_ts)" for p in PERIODS for s in "ab")
    using = ", ".join([*group.split(), "pos"])
    return f"SELECT pair_id, {keyed}period, instrument, {FORWARD.format(keys='')} FROM {source} JOIN ({union}) USING ({using}) WHERE has = 1 GROUP BY pair_id, {keyed}period, instrument"


query("e2_forward_returns", sql("cand pb", _forward("cand", "")))(lambda s, d: events.forward_returns(events.detect_divergences(events.with_forward(fx.daily_scored(s, d), pos="pos"))))
query("e3_divergence_by_threshold", sql("e3_k pb", _forward("e3_k", "threshold"), recursive=True))(lambda s, d: events.divergence_by_threshold(fx.daily_scored(s, d), pos="pos"))
query("e4_divergence_by_direction", sql("e1_k pb", _forward("e1_k", "direction"), recursive=True))(lambda s, d: events.divergence_by_direction(fx.daily_scored(s, d), pos="pos"))
# quarters stand for sessions here: daily bars have no hours
part("ratq", "rat", "SELECT *, 'Q' || quarter(bar_ts) AS session FROM rat")
part("candq", "ratq thr", "SELECT pair_id, session, pos FROM ratq JOIN thr ON abs(residual_zscore) >= threshold")
query("e5_conditional_divergence", sql("candq", _forward("candq", "session", "ratq", "pair_id session")))(lambda s, d: events.conditional_divergence(fx.daily_scored(s, d).withColumn("session", F.concat(F.lit("Q"), F.quarter("bar_ts")))))
part("rx", "rat thr", "SELECT rat.*, threshold, CASE WHEN ratio_zscore_100 > 0 THEN 'upper' ELSE 'lower' END AS extreme FROM (SELECT *, " + ", ".join(f"lead(ratio, {p}) OVER w AS r{p}" for p in PERIODS) + " FROM rat WINDOW w AS (PARTITION BY pair_id ORDER BY bar_ts)) rat JOIN thr ON abs(ratio_zscore_100) >= threshold")
query("e6_ratio_extremes", sql("rx", "SELECT pair_id, threshold, extreme, period, " + FORWARD.format(keys="") + " FROM (" + " UNION ALL ".join(f"SELECT pair_id, threshold, extreme, {p} AS period, (r{p} - ratio) / nullif(ratio, 0) AS x FROM rx" for p in PERIODS) + ") WHERE x IS NOT NULL GROUP BY ALL"))(lambda s, d: events.ratio_extremes(fx.daily_scored(s, d), pos="pos"))
_LV = (0.0, 0.5, 1.0)
part("rv", "rat thr", "SELECT rat.*, threshold FROM (SELECT pair_id, pos, ratio_zscore_100, " + ", ".join(f"min(CASE WHEN abs(ratio_zscore_100) <= {v} THEN pos END) OVER (PARTITION BY pair_id ORDER BY bar_ts ROWS BETWEEN 1 FOLLOWING AND 199 FOLLOWING) - pos AS t{i}" for i, v in enumerate(_LV)) + " FROM rat) rat JOIN thr ON abs(ratio_zscore_100) >= threshold")
query("e7_ratio_reversion", sql("rv", "SELECT pair_id, threshold, level, count(*) AS n_events, " + r("avg((b IS NOT NULL)::INT) * 100", "pct_reverted") + ", " + r("coalesce(avg(b), 0)", "mean_bars") + ", coalesce(max(b), 0)::INTEGER AS max_bars FROM (" + " UNION ALL ".join(f"SELECT pair_id, threshold, {v}::DOUBLE AS level, t{i} AS b FROM rv" for i, v in enumerate(_LV)) + ") GROUP BY ALL"))(lambda s, d: events.ratio_reversion(fx.daily_scored(s, d), pos="pos"))

# spreads

_SP = ", ".join([r("avg(x)", "mean"), r("median(x)", "median"), r("min(x)", "min"), r("max(x)", "max"), r("quantile_cont(x, 0.95)", "q95"), r("quantile_cont(x, 0.99)", "q99")])


def _spread(keys: str, source: str, sides: str = "ab") -> str:
    keyed = f"{keys}, " if keys else ""
    return f"SELECT pair_id, {keyed}instrument, {_SP} FROM ({' UNION ALL '.join(f'SELECT *, {chr(39)}{s}{chr(39)} AS instrument, {s}_spread::DOUBLE AS x FROM {source}' for s in sides)}) GROUP BY pair_id, {keyed}instrument"


query("p1_spread_stats", sql("ipb", _spread("", "ipb")))(lambda s, d: spread.spread_stats(fx.intraday_pairs(s, d)))
query("p2_spread_by_session", sql("ses", _spread("session", "ses")))(lambda s, d: spread.spread_stats(fx.intraday_pairs(s, d), ["session"]))
query("p3_spread_by_hour", sql("ipb", f"SELECT pair_id, hour(bar_ts)::INTEGER AS hour, {_SP} FROM (SELECT *, a_spread::DOUBLE AS x FROM ipb) GROUP BY 1, 2"))(lambda s, d: spread.spread_by_hour(fx.intraday_pairs(s, d)))
query("p4_spread_by_regime", sql("reg", _spread("volatility_regime", "reg")))(lambda s, d: spread.spread_stats(fx.intraday_regimes(s, d), ["volatility_regime"]))
query("p5_spread_cost", sql("ipb", "SELECT pair_id, " + ", ".join(x for s in "ab" for x in (r(f"avg({s}_spread)", f"{s}_mean"), r(f"median({s}_spread)", f"{s}_median"), r(f"avg({s}_spread / {s}_close * 100)", f"{s}_cost_pct"))) + " FROM ipb GROUP BY 1"))(lambda s, d: spread.spread_cost(fx.intraday_pairs(s, d)))
query("p6_transaction_cost", sql("ipb", f"SELECT pair_id, bar_ts, {r('(a_spread + b_spread) / 2.0 + 0.7', 'cost')} FROM ipb"))(lambda s, d: fx.intraday_pairs(s, d).select("pair_id", "bar_ts", spread.transaction_cost(F.col("a_spread"), F.col("b_spread"), 0.5, 0.2).alias("cost")))

# statistical tests: no SQL for the first two, whose lag search needs a solver; tests compare them with numpy. With the lag fixed both have SQL


def _lagged(name: str, source: str, x: str) -> None:
    """Changes y, levels u before them and changes v before those, where all three are there."""
    part(f"{name}_d", source, f"SELECT pair_id, bar_ts, {x} AS x, lag({x}) OVER w AS u, {x} - lag({x}) OVER w AS y FROM {source} WHERE {x} IS NOT NULL WINDOW w AS (PARTITION BY pair_id ORDER BY bar_ts)")
    part(f"{name}_v", f"{name}_d", f"SELECT * FROM (SELECT pair_id, u, y, lag(y) OVER (PARTITION BY pair_id ORDER BY bar_ts) AS v FROM {name}_d) WHERE v IS NOT NULL")


def _statistic(name: str, center: bool) -> str:
    """The ratio of the coefficient of u to its deviation, from sums of products; with a constant they are centred."""
    cells = [(a, b, f"sum({a} * {b})" + (f" - sum({a}) * sum({b}) / count(*)" if center else "")) for a, b in ("uu", "uv", "vv", "uy", "vy", "yy")]
    return f"""SELECT pair_id, n, b / sqrt((yy - b * uy - c * vy) / (n - {2 + center}) * vv / (uu * vv - uv * uv)) AS statistic FROM (SELECT *, (vv * uy - uv * vy) / (uu * vv - uv * uv) AS b, (uu * vy - uv * uy) / (uu * vv - uv * uv) AS c
      FROM (SELECT pair_id, count(*) AS n, {", ".join(f"{e} AS {a}{b}" for a, b, e in cells)} FROM {name}_v GROUP BY 1))"""


part("ratm", "rat", "SELECT pair_id, bar_ts, ratio - avg(ratio) OVER (PARTITION BY pair_id) AS ratio FROM rat")
_lagged("adf", "ratm", "ratio")
part("egl", "pb", "SELECT pair_id, bar_ts, a_close - regr_slope(a_close, b_close) OVER w * b_close - regr_intercept(a_close, b_close) OVER w AS e FROM pb WINDOW w AS (PARTITION BY pair_id)")
_lagged("eg", "egl", "e")
query("x1_adf_one_lag", sql("adf_v", f"SELECT pair_id, {r('statistic', 'statistic')}, 1::BIGINT AS lag, n AS n_obs, {r('-2.86154 - 2.8903 / n - 4.234 / (n * n) - 40.04 / (n * n * n)', 'critical_5')} FROM ({_statistic('adf', True)})"))(lambda s, d: stattests.adf_test(fx.daily_scored(s, d), "ratio", lag=1).select("pair_id", "statistic", "lag", "n_obs", "critical_5"))
query("x2_engle_granger_one_lag", sql("eg_v", f"SELECT pair_id, {r('statistic', 'statistic')} FROM ({_statistic('eg', False)})"))(lambda s, d: stattests.engle_granger(fx.daily_pairs(s, d), lag=1).select("pair_id", "statistic"))


def _verdict(statistic: str, rows: str, variables: int, holds: str) -> str:
    """p-value, critical values and verdict of a table with ``statistic`` and ``n``; the normal distribution is a series, beyond 3.9 deviations times the root of two 0 or 1 to six digits."""
    low, switch, high = stattests.SWITCH[variables]
    poly = lambda c: " + ".join(f"({x}) * pow(statistic, {k})" for k, x in enumerate(c))
    z = f"(CASE WHEN statistic <= {switch} THEN {poly(stattests.SMALL_P[variables])} ELSE {poly(stattests.LARGE_P[variables])} END) / sqrt(2)"
    erf = "CASE WHEN z > 3.9 THEN 1 WHEN z < -3.9 THEN -1 ELSE 2 / sqrt(pi()) * list_sum(list_transform(range(0, 80), lambda k: (1 - 2 * (k % 2)) * pow(z, 2 * k + 1) / (gamma(k + 1) * (2 * k + 1)))) END"
    p = f"CASE WHEN statistic > {high} THEN 1 WHEN statistic < {low} THEN 0 ELSE 0.5 * (1 + {erf}) END"
    levels = ", ".join(r(" + ".join(f"({b}) / pow({rows}, {i})" for i, b in enumerate(c)), f"critical_{k[:-1]}") for k, c in stattests.CRITICAL[variables].items())
    return f"SELECT pair_id, {r('statistic', 'statistic')}, {r('p', 'p_value')}, {levels}, p < 0.05 AS {holds} FROM (SELECT *, {p} AS p FROM (SELECT *, {z} AS z FROM ({statistic})))"


query("x1_adf_verdict_one_lag", sql("adf_v", _verdict(_statistic("adf", True), "n", 1, "stationary")))(lambda s, d: stattests.adf_test(fx.daily_scored(s, d), "ratio", lag=1).select("pair_id", "statistic", "p_value", "critical_1", "critical_5", "critical_10", "stationary"))
query("x2_engle_granger_verdict_one_lag", sql("eg_v", _verdict(_statistic("eg", False), "(n + 1)", 2, "cointegrated")))(lambda s, d: stattests.engle_granger(fx.daily_pairs(s, d), lag=1).select("pair_id", "statistic", "p_value", "critical_1", "critical_5", "critical_10", "cointegrated"))


def _x1(s: SparkSession, d: str) -> DataFrame:
    return stattests.adf_tests(fx.daily_scored(s, d), ("a_close", "b_close", "ratio", "residual"))


query("x1_adf_test")(_x1)
query("x2_engle_granger")(lambda s, d: stattests.engle_granger(fx.daily_pairs(s, d)))
query("x3_half_life", sql("rat", f"SELECT pair_id, {r('CASE WHEN n < 20 THEN 0 WHEN s < 0 THEN -ln(2) / s ELSE 1e999 END', 'half_life')}, {r('CASE WHEN n >= 20 AND s < 0 THEN -s ELSE 0 END', 'speed')} FROM (SELECT pair_id, count(*) AS n, regr_slope(x - b, b) AS s FROM (SELECT pair_id, ratio AS x, lag(ratio) OVER (PARTITION BY pair_id ORDER BY bar_ts) AS b FROM rat) GROUP BY 1)"))(lambda s, d: stattests.half_life(fx.daily_scored(s, d), "ratio"))

# strategies

_TR = f"pair_id, pos, side, entry_ts, exit_ts, {rs('entry_price', 'exit_price', 'gross_pnl', 'net_pnl')}, holding_bars"


def _lead_lag_sql(name: str, source: str, keys: str = "pair_id") -> None:
    part(name, source, f"""SELECT *, gross_pnl - ((es + xs) / 2.0::DOUBLE + 0.7) AS net_pnl FROM (SELECT {keys}, pos, bar_ts AS entry_ts, xt AS exit_ts, CASE WHEN mv > 0 THEN 'LONG' ELSE 'SHORT' END AS side, b_close AS entry_price, xc AS exit_price,
      CASE WHEN mv > 0 THEN xc - b_close ELSE b_close - xc END AS gross_pnl, b_spread AS es, xs, 6::BIGINT AS holding_bars
      FROM (SELECT *, lag(a_log_return, 1) OVER w AS mv, lead(bar_ts, 6) OVER w AS xt, lead(b_close, 6) OVER w AS xc, lead(b_spread, 6) OVER w AS xs FROM {source} WINDOW w AS (PARTITION BY {keys} ORDER BY bar_ts)) WHERE abs(mv) > 0.0005 AND xt IS NOT NULL)""")


def _reversion_sql(name: str, source: str, keys: str, entry: float) -> None:
    w = f"(PARTITION BY {keys} ORDER BY bar_ts ROWS BETWEEN 1 FOLLOWING AND 24 FOLLOWING)"
    on = " AND ".join(f"b.{k.strip()} = k.{k.strip()}" for k in keys.split(","))
    ks = ", ".join(f"k.{k.strip()}" for k in keys.split(","))
    part(f"{name}_c", source, f"""SELECT *, CASE WHEN z > 0 THEN sx ELSE lx END AS done, coalesce(CASE WHEN z > 0 THEN sx ELSE lx END, 1000000000) AS stop FROM (SELECT {keys}, pos, bar_ts, residual_zscore AS z, b_close, b_spread,
      least(min(CASE WHEN residual_zscore <= 0.5 THEN pos END) OVER {w}, lead(pos, 24) OVER (PARTITION BY {keys} ORDER BY bar_ts)) AS sx,
      least(min(CASE WHEN residual_zscore >= -0.5 THEN pos END) OVER {w}, lead(pos, 24) OVER (PARTITION BY {keys} ORDER BY bar_ts)) AS lx FROM {source}) WHERE abs(z) >= {entry}""")
    part(f"{name}_n", f"{name}_c", f"SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY pos) AS i FROM {name}_c")
    wk = " AND ".join(f"c.{k.strip()} = w.{k.strip()}" for k in keys.split(","))
    part(f"{name}_w", f"{name}_n", f"SELECT {keys}, i, stop AS last, true AS kept FROM {name}_n WHERE i = 1 UNION ALL SELECT {', '.join('c.' + k.strip() for k in keys.split(','))}, c.i, CASE WHEN c.pos > w.last THEN c.stop ELSE w.last END, c.pos > w.last FROM {name}_w w JOIN {name}_n c ON {wk} AND c.i = w.i + 1")
    part(name, f"{name}_w {name}_n", f"""SELECT *, gross_pnl - ((es + xs) / 2.0::DOUBLE + 0.7) AS net_pnl FROM (SELECT {ks}, k.pos, CASE WHEN z > 0 THEN 'SHORT' ELSE 'LONG' END AS side, k.bar_ts AS entry_ts, b.bar_ts AS exit_ts, k.b_close AS entry_price, b.b_close AS exit_price,
      CASE WHEN z > 0 THEN k.b_close - b.b_close ELSE b.b_close - k.b_close END AS gross_pnl, k.b_spread AS es, b.b_spread AS xs, (done - k.pos)::BIGINT AS holding_bars
      FROM (SELECT n.* FROM {name}_n n JOIN {name}_w USING ({keys}, i) WHERE kept AND done IS NOT NULL) k JOIN {source} b ON {on} AND b.pos = k.done)""")


_lead_lag_sql("b1", "pb")
_reversion_sql("b2", "rat", "pair_id", 2.0)
COSTS = {"commission": 0.5, "slippage": 0.2}


def _b1(s: SparkSession, d: str) -> DataFrame:
    return backtest.lead_lag_trades(fx.daily_pairs(s, d), pos="pos", **COSTS)


def _b2(s: SparkSession, d: str) -> DataFrame:
    return backtest.mean_reversion_trades(fx.daily_scored(s, d), pos="pos", **COSTS)


query("b1_lead_lag_trades", sql("b1", f"SELECT {_TR} FROM b1"))(_b1)
query("b2_mean_reversion_trades", sql("b2", f"SELECT {_TR} FROM b2", recursive=True))(_b2)
query("b3_trade_gate", sql("ll", "SELECT DISTINCT pair_id FROM (SELECT *, row_number() OVER (PARTITION BY pair_id, direction ORDER BY abs(correlation) DESC NULLS LAST, lag) AS k FROM ll) WHERE k = 1 AND direction = 'a_leads_b' AND correlation > 0.02"))(
    lambda s, d: backtest.trade_gate(fx.daily_pairs(s, d), leadlag.best_lag(leadlag.lead_lag(fx.daily_pairs(s, d), pos="pos")), "a_leads_b", 0.02).select("pair_id").distinct()
)


def _metrics_sql(name: str, trades: str, bars: str, keys: str = "pair_id") -> None:
    part(f"{name}_e", trades, f"SELECT *, sum(net_pnl) OVER w AS equity, sum((net_pnl > 0)::INT) OVER w AS run FROM {trades} WINDOW w AS (PARTITION BY {keys} ORDER BY pos ROWS UNBOUNDED PRECEDING)")
    part(f"{name}_d", f"{name}_e", f"SELECT {keys}, abs(min(equity - peak)) AS max_drawdown FROM (SELECT *, max(equity) OVER (PARTITION BY {keys} ORDER BY pos ROWS UNBOUNDED PRECEDING) AS peak FROM {name}_e) GROUP BY {keys}")
    part(f"{name}_l", f"{name}_e", f"SELECT {keys}, max(n)::BIGINT AS max_losing_run FROM (SELECT {keys}, run, sum((net_pnl <= 0)::INT) AS n FROM {name}_e GROUP BY {keys}, run) GROUP BY {keys}")
    part(f"{name}_t", trades, f"""SELECT {keys}, count(*) AS total_trades, avg((net_pnl > 0)::INT) * 100 AS win_rate, avg(net_pnl) AS avg_return, median(net_pnl) AS median_return, avg(net_pnl) FILTER (net_pnl > 0) AS avg_winner, avg(net_pnl) FILTER (net_pnl <= 0) AS avg_loser,
      CASE WHEN coalesce(sum(net_pnl) FILTER (net_pnl <= 0), 0) = 0 THEN 'Infinity'::DOUBLE ELSE abs(coalesce(sum(net_pnl) FILTER (net_pnl > 0), 0) / (sum(net_pnl) FILTER (net_pnl <= 0))) END AS profit_factor,
      avg(holding_bars) AS avg_holding_bars, max(net_pnl) AS best_trade, min(net_pnl) AS worst_trade, sum(gross_pnl) AS gross_return, sum(gross_pnl - net_pnl) AS total_costs, sum(net_pnl) AS net_return,
      CASE WHEN stddev_pop(net_pnl) > 0 THEN avg(net_pnl) / stddev_pop(net_pnl) * sqrt(36288) ELSE 0 END AS sharpe,
      CASE WHEN count(*) FILTER (net_pnl < 0) = 0 THEN 0 WHEN stddev_pop(net_pnl) FILTER (net_pnl < 0) = 0 THEN (CASE WHEN avg(net_pnl) > 0 THEN 'Infinity'::DOUBLE WHEN avg(net_pnl) < 0 THEN '-Infinity'::DOUBLE END) ELSE avg(net_pnl) / (stddev_pop(net_pnl) FILTER (net_pnl < 0)) * sqrt(36288) END AS sortino FROM {trades} GROUP BY {keys}""")
    part(f"{name}_s", bars, f"SELECT {keys}, epoch(max(bar_ts) - min(bar_ts)) / 86400 AS days FROM {bars} GROUP BY {keys}")
    part(name, f"{name}_s {name}_t {name}_d {name}_l", f"SELECT * EXCLUDE (days), avg_return AS expectancy, CASE WHEN days > 0 THEN total_trades / days END AS trades_per_day, total_costs / nullif(gross_return, 0) AS cost_to_edge FROM {name}_s LEFT JOIN {name}_t USING ({keys}) LEFT JOIN {name}_d USING ({keys}) LEFT JOIN {name}_l USING ({keys})")


_NUM = ["win_rate", "avg_return", "median_return", "avg_winner", "avg_loser", "expectancy", "avg_holding_bars", "best_trade", "worst_trade", "gross_return", "total_costs", "net_return", "profit_factor", "max_drawdown", "sharpe", "trades_per_day", "cost_to_edge"]
_MET = "coalesce(total_trades, 0) AS total_trades, coalesce(max_losing_run, 0) AS max_losing_run, " + ", ".join(r(f"coalesce({n}, 0)", n) for n in _NUM) + ", " + r("CASE WHEN total_trades IS NULL THEN 0 ELSE sortino END", "sortino")
for _id, _t, _f, _rec in (("b4_backtest_metrics", "b1", _b1, False), ("b4_backtest_metrics_reversion", "b2", _b2, True)):
    _metrics_sql(f"{_t}m", _t, "pb")
    query(_id, sql(f"{_t}m", f"SELECT pair_id, {_MET} FROM {_t}m", recursive=_rec))(lambda s, d, f=_f: backtest.backtest_metrics(f(s, d), fx.daily_pairs(s, d)))
query("b5_equity_curve", sql("b1m_e", f"SELECT pair_id, pos, {rs('equity')}, {r('max(equity) OVER w', 'peak')}, {r('equity - max(equity) OVER w', 'drawdown')} FROM b1m_e WINDOW w AS (PARTITION BY pair_id ORDER BY pos ROWS UNBOUNDED PRECEDING)"))(lambda s, d: backtest.equity_curve(_b1(s, d)).select("pair_id", "pos", "equity", "peak", "drawdown"))
query("b6_max_losing_run", sql("b1m_l", "SELECT * FROM b1m_l"))(lambda s, d: backtest.max_losing_run(_b1(s, d)))
query("b7_risk_ratios", sql("b1m_t", f"SELECT pair_id, {rs('sharpe', 'sortino')} FROM b1m_t"))(lambda s, d: backtest.risk_ratios(_b1(s, d)))

# walk-forward

part("wf0", "pb", "SELECT pair_id, n, CASE WHEN s THEN 300 ELSE floor(n * 0.6::DOUBLE)::BIGINT END AS t, CASE WHEN s THEN 100 ELSE floor(n * 0.2::DOUBLE)::BIGINT END AS v, CASE WHEN s THEN 50 ELSE floor(n * 0.1::DOUBLE)::BIGINT END AS st FROM (SELECT pair_id, count(*) AS n, floor(count(*) * 0.6::DOUBLE) < 300 AS s FROM pb GROUP BY 1)")
part("wf", "wf0", "SELECT pair_id, k AS \"window\", k * st AS train_from, k * st + t - 1 AS train_to, k * st + t AS val_from, k * st + t + v - 1 AS val_to, k * st + t + v AS test_from, k * st + t + v + st - 1 AS test_to FROM (SELECT *, unnest(range(0, greatest((n - t - v - st) // st + 1, 0)))::BIGINT AS k FROM wf0 WHERE n >= t + v + st)")
part("sl", "wf rat", """SELECT * EXCLUDE (pos), row_number() OVER (PARTITION BY pair_id, "window", split ORDER BY bar_ts) - 1 AS pos FROM (""" + " UNION ALL ".join(f"""SELECT rat.*, "window", '{x}' AS split FROM rat JOIN wf ON rat.pair_id = wf.pair_id AND rat.pos BETWEEN {x}_from AND {x}_to WHERE train_to - train_from >= 99 AND val_to - val_from >= 49 AND test_to - test_from >= 49""" for x in ("train", "val", "test")) + ")")


def _windows(s: SparkSession, d: str) -> DataFrame:
    return walkforward.walkforward_windows(fx.daily_scored(s, d), min_train=300)


def _slices(s: SparkSession, d: str) -> DataFrame:
    return walkforward.walkforward_slices(fx.daily_scored(s, d), _windows(s, d))


query("wf1_walkforward_windows", sql("wf", "SELECT * FROM wf"))(_windows)
query("wf1_window_times", sql("wf pb", 'SELECT w.pair_id, "window", ' + ", ".join(f"max(CASE WHEN p.pos = {x}_{e} THEN bar_ts END) AS {x}_{e}" for x in ("train", "val", "test") for e in ("from", "to")) + ' FROM wf w JOIN pb p ON p.pair_id = w.pair_id GROUP BY 1, 2'))(lambda s, d: walkforward.window_times(fx.daily_scored(s, d), _windows(s, d)))
query("wf2_walkforward_slices", sql("sl", f'SELECT pair_id, "window", split, pos, bar_ts, {rs("residual_zscore")} FROM sl'))(lambda s, d: _slices(s, d).select("pair_id", "window", "split", "pos", "bar_ts", "residual_zscore"))
_KW = "pair_id, window_, split"
part("slw", "sl", 'SELECT * EXCLUDE ("window"), "window" AS window_ FROM sl')
_lead_lag_sql("w1", "slw", _KW)
_metrics_sql("w1m", "w1", "slw", _KW)
for _i, _entry in enumerate((1.5, 2.0)):
    _reversion_sql(f"w2{_i}", "slw", _KW, _entry)
    _metrics_sql(f"w2{_i}m", f"w2{_i}", "slw", _KW)
_WM = 'pair_id, window_ AS "window", split, '
GRID = {"entry": (1.5, 2.0)}


def _w1(s: SparkSession, d: str) -> DataFrame:
    return walkforward.run_walkforward(_slices(s, d), backtest.lead_lag_trades, pos="pos", **COSTS)


query("wf3_run_walkforward", sql("w1m", f"SELECT {_WM}{_MET} FROM w1m"))(_w1)
_SCORE = "coalesce(net_return, 0) / greatest(abs(coalesce(max_drawdown, 0)), 1e-6::DOUBLE)"
part("best", "w20m w21m", f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pair_id, window_ ORDER BY score DESC, combo) AS k FROM ({' UNION ALL '.join(f'SELECT pair_id, window_, {i} AS combo, {_SCORE} AS score FROM w2{i}m WHERE split = {chr(39)}val{chr(39)}' for i in range(2))})) WHERE k = 1")
query("wf4_parameter_search", sql("best", f'SELECT pair_id, window_ AS "window", combo, round(score, 2) + 0.0 AS score FROM best', recursive=True))(lambda s, d: walkforward.parameter_search(_slices(s, d), backtest.mean_reversion_trades, GRID, pos="pos", **COSTS).withColumn("score", F.round("score", 2)))
query("wf5_walkforward_summary", sql("w1m", f"""SELECT pair_id, count(*) AS n_windows, {r('avg(coalesce(net_return, 0))', 'mean_net')}, {r('stddev_pop(coalesce(net_return, 0))', 'std_net')}, {r('avg(coalesce(sharpe, 0))', 'mean_sharpe')}, {r('avg(coalesce(profit_factor, 0))', 'mean_profit_factor')},
  {r('avg(coalesce(win_rate, 0))', 'mean_win_rate')}, {r('avg(coalesce(max_drawdown, 0))', 'mean_drawdown')}, sum((coalesce(net_return, 0) > 0)::INT)::BIGINT AS n_profitable, {r('avg((coalesce(net_return, 0) > 0)::INT) * 100', 'pct_profitable')} FROM w1m WHERE split = 'test' GROUP BY 1"""))(lambda s, d: walkforward.walkforward_summary(_w1(s, d)))

# summaries

part("y_h", "rat", "SELECT pair_id, CASE WHEN n < 20 THEN 0 WHEN s < 0 THEN -ln(2) / s ELSE 1e999 END AS half_life FROM (SELECT pair_id, count(*) AS n, regr_slope(x - b, b) AS s FROM (SELECT pair_id, ratio AS x, lag(ratio) OVER (PARTITION BY pair_id ORDER BY bar_ts) AS b FROM rat) GROUP BY 1)")
part("y_t10", "scored", "SELECT pair_id, avg(residual_zscore) AS mean, stddev_samp(residual_zscore) AS std, min(residual_zscore) AS \"min\", max(residual_zscore) AS \"max\" FROM scored GROUP BY 1")
query(
    "y1_research_summary",
    sql("y_t10 beta y_h lastr", "SELECT pair_id, 'residual_zscore' AS section, '' AS item, metric, round(value, 6) + 0.0 AS value FROM (UNPIVOT y_t10 ON mean, std, \"min\", \"max\" INTO NAME metric VALUE value) UNION ALL SELECT pair_id, 'beta', '', metric, round(value, 6) + 0.0 FROM (UNPIVOT (SELECT pair_id, avg(beta) AS mean, median(beta) AS median, min(beta) AS \"min\", max(beta) AS \"max\", stddev_samp(beta) AS std FROM beta GROUP BY 1) ON mean, median, \"min\", \"max\", std INTO NAME metric VALUE value)"
        " UNION ALL SELECT pair_id, 'ratio', '', metric, round(value, 6) + 0.0 FROM (UNPIVOT (SELECT pair_id, any_value(l) AS last, any_value(lz) AS last_zscore, avg(ratio) AS mean, stddev_samp(ratio) AS std, avg((ratio <= l)::INT) * 100 AS percentile FROM rat JOIN lastr USING (pair_id) GROUP BY 1) ON last, last_zscore, mean, std, percentile INTO NAME metric VALUE value)"
        " UNION ALL SELECT pair_id, 'half_life', '', 'half_life', round(half_life, 6) + 0.0 FROM y_h"),
)(lambda s, d: _y1(fx.daily_scored(s, d)))


def _y1(rows: DataFrame) -> DataFrame:
    sections = {"residual_zscore": ratio.residual_zscore_summary(rows), "beta": ratio.beta_summary(rows), "ratio": ratio.ratio_summary(rows), "half_life": stattests.half_life(rows, "ratio").select("pair_id", "half_life")}
    return summary.research_summary(sections)


def _section(name: str, select: str, metrics: Sequence[str], item: str = "''") -> str:
    """A result table as long rows: a metric for each of its numbers."""
    return f"SELECT pair_id, '{name}' AS section, {item} AS item, unnest([{', '.join(repr(m) for m in metrics)}]) AS metric, round(unnest([{', '.join(f'({chr(34)}{m}{chr(34)})::DOUBLE' for m in metrics)}]), 6) + 0.0 AS value FROM ({select})"


# sessions and regimes of the daily pairs, for the report
part("dses", "pb", f"SELECT *, {SESSION} AS session FROM pb")
part("dvol", "dses", f"SELECT *, {full('stddev_samp', 'a_log_return', 20, win(20))} AS volatility FROM dses")
part("drank", "dvol", """SELECT x.pair_id, x.pos, (sum((y.volatility < x.volatility)::INT) + (sum((y.volatility = x.volatility)::INT) + 1) / 2.0::DOUBLE) / 100 AS rank
  FROM dvol x JOIN dvol y ON y.pair_id = x.pair_id AND y.pos BETWEEN x.pos - 99 AND x.pos WHERE x.volatility IS NOT NULL AND y.volatility IS NOT NULL GROUP BY ALL HAVING count(*) = 100""")
part("dreg", "dvol drank", "SELECT dvol.*, CASE WHEN rank <= 0.2 THEN 'LOW' WHEN rank >= 0.8 THEN 'HIGH' ELSE 'NORMAL' END AS volatility_regime FROM dvol LEFT JOIN drank USING (pair_id, pos)")
_STATS = ["mean", "median", "std", "min", "max"]
_RANGE = ["mean", "median", "min", "max", "q95", "q99"]
_SIDE = [f"{s}_{c}" for s in "ab" for c in ("mean", "std", "spread_mean")]
_MONEY = ["total_trades", "win_rate", "avg_return", "median_return", "avg_winner", "avg_loser", "expectancy", "avg_holding_bars", "best_trade", "worst_trade", "gross_return", "total_costs", "net_return", "profit_factor", "max_drawdown", "max_losing_run", "sharpe", "sortino", "trades_per_day", "cost_to_edge"]
_FORWARD = ["mean", "median", "std", "pct_positive", "max", "min", "count"]
_GAIN = "coalesce(net_return, 0)"
_REPORT = [
    _section("dataset", "SELECT pair_id, n AS matched, x - n AS a_unmatched, y - n AS b_unmatched FROM (SELECT pair_id, count(*) AS n FROM pb GROUP BY 1) JOIN pb_pairs USING (pair_id) JOIN (SELECT symbol AS a_symbol, count(*) AS x FROM bars GROUP BY 1) USING (a_symbol) JOIN (SELECT symbol AS b_symbol, count(*) AS y FROM bars GROUP BY 1) USING (b_symbol)", ["matched", "a_unmatched", "b_unmatched"]),
    _section("correlation", 'SELECT pair_id, "window", count(c) AS n, avg(c) AS mean, median(c) AS median, stddev_samp(c) AS std, min(c) AS "min", max(c) AS "max", avg((c > 0)::INT) * 100 AS pct_positive, avg((c > 0.5)::INT) * 100 AS pct_over_05, avg((c > 0.7)::INT) * 100 AS pct_over_07 FROM lc GROUP BY 1, 2', ["n", *_STATS, "pct_positive", "pct_over_05", "pct_over_07"], '"window"::VARCHAR'),
    _section("ratio", "SELECT pair_id, any_value(l) AS last, any_value(lz) AS last_zscore, avg(ratio) AS mean, stddev_samp(ratio) AS std, avg((ratio <= l)::INT) * 100 AS percentile FROM rat JOIN lastr USING (pair_id) GROUP BY 1", ["last", "last_zscore", "mean", "std", "percentile"]),
    _section("beta", 'SELECT pair_id, avg(beta) AS mean, median(beta) AS median, min(beta) AS "min", max(beta) AS "max", stddev_samp(beta) AS std FROM beta GROUP BY 1', _STATS),
    _section("residual_zscore", "SELECT * FROM y_t10", ["mean", "std", "min", "max"]),
    _section("lead_lag", "SELECT pair_id, direction, CASE WHEN correlation IS NULL THEN 0 ELSE lag END AS lag, coalesce(correlation, 0) AS correlation, CASE WHEN correlation IS NULL THEN 0 ELSE lag * 10 END AS minutes, CASE WHEN correlation IS NULL THEN 0 ELSE n_rows - lag END AS sample_size FROM (SELECT *, row_number() OVER (PARTITION BY pair_id, direction ORDER BY abs(correlation) DESC NULLS LAST, lag) AS k FROM ll) WHERE k = 1", ["lag", "correlation", "minutes", "sample_size"], "direction"),
    *[_section("regimes", f"SELECT pair_id, {g} AS label, count(*) AS n_rows, {corr('a_log_return', 'b_log_return')} AS correlation, " + ", ".join(f"avg({s}_log_return) AS {s}_mean, stddev_samp({s}_log_return) AS {s}_std, avg({s}_spread) AS {s}_spread_mean" for s in "ab") + f" FROM dreg GROUP BY pair_id, {g} HAVING count(*) >= 10", ["n_rows", "correlation", *_SIDE], f"'{g}/' || label") for g in ("session", "volatility_regime")],
    _section("divergence", _forward("e3_k", "threshold"), _FORWARD, "format('{:.1f}/{}/{}', threshold, period, instrument)"),
    *[_section("strategy", f"SELECT pair_id, {', '.join(f'coalesce({m}, 0) AS {m}' for m in _MONEY if m != 'sortino')}, CASE WHEN total_trades IS NULL THEN 0 ELSE sortino END AS sortino FROM {t}", _MONEY, f"'{n}'") for t, n in (("b1m", "lead_lag"), ("b2m", "mean_reversion"))],
    _section("walk_forward", f"SELECT pair_id, count(*) AS n_windows, avg({_GAIN}) AS mean_net, stddev_pop({_GAIN}) AS std_net, avg(coalesce(sharpe, 0)) AS mean_sharpe, avg(coalesce(profit_factor, 0)) AS mean_profit_factor, avg(coalesce(win_rate, 0)) AS mean_win_rate, avg(coalesce(max_drawdown, 0)) AS mean_drawdown, sum(({_GAIN} > 0)::INT) AS n_profitable, avg(({_GAIN} > 0)::INT) * 100 AS pct_profitable FROM w1m WHERE split = 'test' GROUP BY 1", ["n_windows", "mean_net", "std_net", "mean_sharpe", "mean_profit_factor", "mean_win_rate", "mean_drawdown", "n_profitable", "pct_profitable"], "'lead_lag'"),
    _section("stationarity", _verdict(_statistic("adf", True), "n", 1, "stationary"), ["statistic", "p_value", "stationary"], "'ratio'"),
    _section("cointegration", _verdict(_statistic("eg", False), "(n + 1)", 2, "cointegrated"), ["statistic", "p_value", "cointegrated"]),
    _section("half_life", "SELECT * FROM y_h", ["half_life"]),
    *[_section("spread", f"SELECT pair_id, {g} AS label, s AS instrument, avg(x) AS mean, median(x) AS median, min(x) AS \"min\", max(x) AS \"max\", quantile_cont(x, 0.95) AS q95, quantile_cont(x, 0.99) AS q99 FROM (SELECT *, 'a' AS s, a_spread::DOUBLE AS x FROM dreg UNION ALL SELECT *, 'b' AS s, b_spread::DOUBLE AS x FROM dreg) GROUP BY ALL", _RANGE, "label || '/' || instrument") for g in ("'all'", "session", "volatility_regime")],
    _section("spread_cost", "SELECT pair_id, " + ", ".join(f"avg({s}_spread) AS {s}_mean, median({s}_spread) AS {s}_median, avg({s}_spread / {s}_close * 100) AS {s}_cost_pct" for s in "ab") + " FROM pb GROUP BY 1", [f"{s}_{c}" for s in "ab" for c in ("mean", "median", "cost_pct")]),
]


@query("y1_research_report", sql("pb_pairs lc lastr beta y_t10 ll dreg e3_k b1m b2m w1m adf_v eg_v y_h", " UNION ALL ".join(_REPORT), recursive=True))
def _report(s: SparkSession, d: str) -> DataFrame:
    """All sections of a study; the scored table is stored once, as the data set of the study."""
    bars = fx.stored(s, d)
    rows = written(regimes.session_label(features.volatility_regime(fx.scored(bars), 20, ["pair_id"], "a_log_return", pos="pos")))
    label = lambda df, *names: df.select("pair_id", F.concat_ws("/", *names).alias("item"), *[c for c in df.columns if c != "pair_id" and c not in names])
    named = lambda df, name: df.withColumn("item", F.lit(name))
    flag = lambda df, *columns: df.select("pair_id", *[F.col(c).cast("double").alias(c) for c in columns])
    found = regimes.regime_table(rows)
    correlations = written(correlation.rolling_correlation(rows, pos="pos").select("pair_id", *[f"corr_{w}" for w in correlation.WINDOWS]))
    # all bars, their session and their regime in one pass
    labelled = rows.select("pair_id", "a_spread", "b_spread", F.explode(F.array(F.lit("all"), "session", "volatility_regime")).alias("label"))
    slices = written(walkforward.walkforward_slices(rows, walkforward.walkforward_windows(rows, min_train=300)))
    strategies = {"lead_lag": backtest.lead_lag_trades(rows, pos="pos", **COSTS), "mean_reversion": backtest.mean_reversion_trades(rows, pos="pos", **COSTS)}
    every = [
        ("dataset", sync.sync_report(bars, step_seconds=86_400).select("pair_id", "matched", "a_unmatched", "b_unmatched")),
        ("correlation", label(correlation.correlation_statistics(correlations), "window")),
        ("ratio", ratio.ratio_summary(rows)), ("beta", ratio.beta_summary(rows)), ("residual_zscore", ratio.residual_zscore_summary(rows)),
        ("lead_lag", label(leadlag.best_lag(leadlag.lead_lag(rows, pos="pos")), "direction")),
        ("regimes", label(found, "grouping", "label")),
        ("divergence", label(events.divergence_by_threshold(rows, pos="pos").withColumn("threshold", F.format_number("threshold", 1)), "threshold", "period", "instrument")),
        *[("strategy", named(backtest.backtest_metrics(trades, rows), name)) for name, trades in strategies.items()],
        ("walk_forward", named(walkforward.walkforward_summary(walkforward.run_walkforward(slices, backtest.lead_lag_trades, pos="pos", **COSTS)), "lead_lag")),
        ("stationarity", named(flag(stattests.adf_test(rows, "ratio", lag=1), "statistic", "p_value", "stationary"), "ratio")),
        ("cointegration", flag(stattests.engle_granger(rows, lag=1), "statistic", "p_value", "cointegrated")),
        ("half_life", stattests.half_life(rows, "ratio").select("pair_id", "half_life")),
        ("spread", label(spread.spread_stats(labelled, ["label"]), "label", "instrument")),
        ("spread_cost", spread.spread_cost(rows)),
    ]
    out = None
    for name, df in every:
        long = summary.research_summary({name: df})
        out = long if out is None else out.unionByName(long)
    return out


def _concluded(s: SparkSession, d: str, cointegrated: Callable[[DataFrame], DataFrame]) -> DataFrame:
    rows = written(fx.daily_scored(s, d))
    stats = correlation.correlation_statistics(correlation.rolling_correlation(rows, (100,), pos="pos"), (100,)).select("pair_id", F.col("mean").alias("mean_corr"), "pct_over_05")
    best = leadlag.best_lag(leadlag.lead_lag(rows, pos="pos")).groupBy("pair_id").agg(F.max(F.when(F.col("direction") == "a_leads_b", F.col("correlation"))).alias("corr_ab"), F.max(F.when(F.col("direction") == "b_leads_a", F.col("correlation"))).alias("corr_ba"))
    z = ratio.residual_zscore_summary(rows).select("pair_id", F.col("std").alias("z_std"))
    n = events.divergence_by_threshold(rows, pos="pos").filter("instrument = 'a'").groupBy("pair_id").agg(F.sum("count").alias("n_events"))
    half = stattests.half_life(rows, "ratio").select("pair_id", "half_life")
    facts = stats
    for x in (best, z, n, cointegrated(rows), half):
        facts = facts.join(x, "pair_id", "left")
    both = [backtest.backtest_metrics(f(rows, pos="pos", **COSTS), rows).select("pair_id", F.lit(name).alias("strategy"), "net_return", "profit_factor") for name, f in (("lead_lag", backtest.lead_lag_trades), ("mean_reversion", backtest.mean_reversion_trades))]
    return summary.conclusions(facts, both[0].unionByName(both[1]))


query("y2_conclusions")(lambda s, d: _concluded(s, d, lambda rows: stattests.engle_granger(rows).select("pair_id", "cointegrated")))
# the same rules with the fact of cointegration given, here by the name of the pair, which SQL can say too
part("y_corr", "rc", "SELECT pair_id, avg(corr_100) AS mean_corr, avg((corr_100 > 0.5)::INT) * 100 AS pct_over_05 FROM rc GROUP BY 1")
part("y_best", "ll", "SELECT pair_id, max(c) FILTER (direction = 'a_leads_b') AS corr_ab, max(c) FILTER (direction = 'b_leads_a') AS corr_ba FROM (SELECT pair_id, direction, coalesce(correlation, 0) AS c, row_number() OVER (PARTITION BY pair_id, direction ORDER BY abs(correlation) DESC NULLS LAST, lag) AS k FROM ll) WHERE k = 1 GROUP BY 1")
part("y_z", "scored", "SELECT pair_id, stddev_samp(residual_zscore) AS z_std FROM scored GROUP BY 1")
part("y_n", "e3_k pb", f"SELECT pair_id, sum(\"count\") AS n_events FROM ({_forward('e3_k', 'threshold')}) WHERE instrument = 'a' GROUP BY 1")
part("y_f", "y_corr y_best y_z y_n y_h", "SELECT *, pair_id LIKE 'A%' AS cointegrated FROM y_corr LEFT JOIN y_best USING (pair_id) LEFT JOIN y_z USING (pair_id) LEFT JOIN y_n USING (pair_id) LEFT JOIN y_h USING (pair_id)")
part("y_p", "b1m b2m", "SELECT pair_id, 'profitable_' || strategy AS rule FROM (SELECT pair_id, 'lead_lag' AS strategy, net_return, profit_factor FROM b1m UNION ALL SELECT pair_id, 'mean_reversion', net_return, profit_factor FROM b2m) WHERE net_return > 0 AND profit_factor > 1.2")
_RULES = {
    "correlated": "mean_corr > 0.5", "correlation_stable": "pct_over_05 > 50", "a_leads_b": "corr_ab > 0.1", "b_leads_a": "corr_ba > 0.1", "stronger_a_to_b": "corr_ab > corr_ba", "stronger_b_to_a": "NOT corr_ab > corr_ba",
    "residual_spread": "z_std > 0.5", "enough_events": "n_events > 20", "cointegrated": "cointegrated", "mean_reverting": "half_life < 100",
}
query("y2_conclusions_given", sql("y_f y_p", " UNION ALL ".join(f"SELECT pair_id, '{n}' AS rule FROM y_f WHERE {c}" for n, c in _RULES.items()) + " UNION ALL SELECT pair_id, rule FROM y_p UNION ALL SELECT pair_id, unnest(['no_profitable_strategy', 'costs_outweigh_edge']) FROM y_f WHERE pair_id NOT IN (SELECT pair_id FROM y_p)", recursive=True))(
    lambda s, d: _concluded(s, d, lambda rows: rows.select("pair_id", F.col("pair_id").startswith("A").alias("cointegrated")).distinct())
)


query("y3_normalized_prices", sql("pb", "SELECT pair_id, bar_ts, " + ", ".join(r(f"{s}_close / first_value({s}_close) OVER w * 100", f"{s}_index") for s in "ab") + " FROM pb WINDOW w AS (PARTITION BY pair_id ORDER BY bar_ts)"))(lambda s, d: summary.normalized_prices(fx.daily_pairs(s, d)))
query("y4_return_histogram", sql("pb", f"SELECT pair_id, bin, count(*) AS n, {r('min(lo)', 'lo')}, {r('min(hi)', 'hi')} FROM (SELECT pair_id, lo, hi, coalesce(least(floor((a_log_return - lo) * 50 / nullif(hi - lo, 0)), 49), 0)::INTEGER AS bin FROM pb JOIN (SELECT pair_id, min(a_log_return) AS lo, max(a_log_return) AS hi FROM pb GROUP BY 1) USING (pair_id) WHERE a_log_return IS NOT NULL) GROUP BY 1, 2"))(lambda s, d: summary.return_histogram(fx.daily_pairs(s, d), "a_log_return", 50))
query("y5_return_pairs", sql("pb", f"SELECT pair_id, bar_ts, {rs('a_log_return', 'b_log_return')}, {r('b_log_return - a_log_return', 'difference')} FROM pb WHERE a_log_return IS NOT NULL AND b_log_return IS NOT NULL"))(lambda s, d: summary.return_pairs(fx.daily_pairs(s, d)))

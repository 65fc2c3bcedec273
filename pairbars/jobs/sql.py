"""The fixtures and results as SQL, for comparison.

Each named part is a common table expression with the parts it needs; ``sql``
puts the needed ones before a final select.
"""

from __future__ import annotations

PARTS: dict[str, tuple[list[str], str]] = {}


def part(name: str, needs: str, body: str) -> None:
    PARTS[name] = (needs.split(), body)


def sql(needs: str, select: str, recursive: bool = False) -> str:
    order: list[str] = []

    def add(name: str) -> None:
        if name not in order:
            for x in PARTS[name][0]:
                add(x)
            order.append(name)

    for x in needs.split():
        add(x)
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(f"{n} AS ({PARTS[n][1]})" for n in order) + "\n" + select


def r(e: str, name: str) -> str:
    return f"round(({e})::DOUBLE, 6) + 0.0 AS {name}"


def rs(*names: str) -> str:
    return ", ".join(r(n, n) for n in names)


def corr(x: str, y: str, over: str = "") -> str:
    o = f" OVER {over}" if over else ""
    both = f"FILTER ({x} IS NOT NULL AND {y} IS NOT NULL)"
    return f"(covar_pop({x}, {y}){o}) / nullif((stddev_pop({x}) {both}{o}) * (stddev_pop({y}) {both}{o}), 0)"


def full(agg: str, x: str, n: int, w: str) -> str:
    return f"CASE WHEN count({x}) OVER {w} = {n} THEN {agg}({x}) OVER {w} END"


def win(n: int, keys: str = "pair_id", order: str = "bar_ts") -> str:
    return f"(PARTITION BY {keys} ORDER BY {order} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


BAR = "open, high, low, close, tick_volume, spread, real_volume"
part("ticks", "", "SELECT l_returnflag || l_linestatus AS symbol, l_shipdate AS ts, l_extendedprice AS price, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem")


def bars(ticks: str, start: str, order: str) -> str:
    return f"""SELECT *, (1 + tick_volume % 4)::INTEGER AS spread, tick_volume AS real_volume FROM (
      SELECT symbol, {start} AS bar_ts, first(price ORDER BY {order}) AS open, max(price) AS high, min(price) AS low,
             last(price ORDER BY {order}) AS close, count(*) AS tick_volume FROM {ticks} GROUP BY 1, 2)"""


TICK_ORDER = "ts, l_orderkey, l_linenumber, l_partkey, l_suppkey, price"
part("bars", "ticks", bars("ticks", "date_trunc('day', ts)::TIMESTAMP", TICK_ORDER))
part("eticks", "", "SELECT event_type AS symbol, ts, value AS price, event_id FROM events")
part("ibars", "eticks", bars("eticks", "time_bucket(INTERVAL 30 MINUTE, ts)", "ts, event_id"))
for b, p in (("bars", "pb"), ("ibars", "ipb")):
    part(f"{p}_pairs", b, f"SELECT DISTINCT x.symbol || '/' || y.symbol AS pair_id, x.symbol AS a_symbol, y.symbol AS b_symbol FROM (SELECT DISTINCT symbol FROM {b}) x JOIN (SELECT DISTINCT symbol FROM {b}) y ON x.symbol < y.symbol")
    sides = ", ".join(f"{s}.{c} AS {s}_{c}" for s in "ab" for c in BAR.split(", "))
    part(f"{p}0", f"{b} {p}_pairs", f"SELECT pair_id, a.bar_ts, {sides}, row_number() OVER (PARTITION BY pair_id ORDER BY a.bar_ts) - 1 AS pos FROM {p}_pairs q JOIN {b} a ON a.symbol = q.a_symbol JOIN {b} b ON b.symbol = q.b_symbol AND b.bar_ts = a.bar_ts")
    rets = ", ".join(f"ln({s}_close / lag({s}_close) OVER w) AS {s}_log_return" for s in "ab")
    part(p, f"{p}0", f"SELECT *, {rets} FROM {p}0 WINDOW w AS (PARTITION BY pair_id ORDER BY bar_ts)")
W100 = win(100)
part("beta", "pb", f"""SELECT *, cov / nullif(var_a, 0) AS beta FROM (SELECT *,
  CASE WHEN count(*) FILTER (a_log_return IS NOT NULL AND b_log_return IS NOT NULL) OVER {W100} = 100 THEN covar_samp(a_log_return, b_log_return) OVER {W100} END AS cov,
  {full('var_samp', 'a_log_return', 100, W100)} AS var_a FROM pb)""")
part("res", "beta", "SELECT *, beta * a_log_return AS expected_b_return, b_log_return - beta * a_log_return AS residual FROM beta")
part("scored", "res", f"SELECT *, residual / nullif({full('stddev_samp', 'residual', 100, W100)}, 0) AS residual_zscore, a_close / b_close AS ratio FROM res")
stats = ", ".join(f"{full(f, 'ratio', w, win(w))} AS ratio_{n}_{w}" for w in (20, 50, 100, 200) for n, f in (("mean", "avg"), ("std", "stddev_samp")))
part("rat", "scored", f"SELECT *, (ratio - ratio_mean_100) / nullif(ratio_std_100, 0) AS ratio_zscore_100 FROM (SELECT *, {stats} FROM scored)")
SESSION = "CASE WHEN hour(bar_ts) < 7 THEN 'ASIA' WHEN hour(bar_ts) < 12 THEN 'LONDON' WHEN hour(bar_ts) < 16 THEN 'LONDON_NEW_YORK_OVERLAP' WHEN hour(bar_ts) < 21 THEN 'NEW_YORK' ELSE 'OTHER' END"
part("ses", "ipb", f"SELECT *, {SESSION} AS session FROM ipb")
part("vol", "ses", f"SELECT *, {full('stddev_samp', 'a_log_return', 20, win(20))} AS volatility FROM ses")
part("rank", "vol", """SELECT x.pair_id, x.pos, count(*) AS n, (sum((y.volatility < x.volatility)::INT) + (sum((y.volatility = x.volatility)::INT) + 1) / 2.0::DOUBLE) / 100 AS rank
  FROM vol x JOIN vol y ON y.pair_id = x.pair_id AND y.pos BETWEEN x.pos - 99 AND x.pos WHERE x.volatility IS NOT NULL AND y.volatility IS NOT NULL GROUP BY ALL HAVING count(*) = 100""")
part("reg", "vol rank", "SELECT vol.*, CASE WHEN rank <= 0.2 THEN 'LOW' WHEN rank >= 0.8 THEN 'HIGH' ELSE 'NORMAL' END AS volatility_regime FROM vol LEFT JOIN rank USING (pair_id, pos)")
part("numbered", "bars", "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar_ts) AS n FROM bars")
part("f0", "numbered", "SELECT symbol, bar_ts, CASE WHEN n % 41 = 0 THEN 0.0 ELSE open END AS open, CASE WHEN n % 37 = 0 THEN low - 1 ELSE high END AS high, low, CASE WHEN n % 43 != 0 THEN close END AS close, tick_volume, spread, real_volume, n AS seq FROM numbered")
part("faulty", "f0", """SELECT * FROM f0 UNION ALL SELECT * REPLACE (close * 1.5 AS close, seq + 1000000 AS seq) FROM f0 WHERE seq % 47 = 0
  UNION ALL SELECT * REPLACE ('XX' AS symbol, CASE WHEN seq = 5 THEN -1.0 ELSE open END AS open, CASE WHEN seq = 5 THEN -1.0 ELSE low END AS low) FROM f0 WHERE symbol = 'AF' AND seq % 41 != 0""")
part("c1", "faulty", "SELECT * FROM faulty WHERE open IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL AND close IS NOT NULL")
part("c2", "c1", "SELECT * EXCLUDE (z) FROM (SELECT *, max((open = 0 OR high = 0 OR low = 0 OR close = 0)::INT) OVER (PARTITION BY symbol) AS z FROM c1) WHERE z = 0 OR least(open, high, low, close) > 0")
part("c3", "c2", "SELECT * FROM c2 WHERE open BETWEEN low AND high AND close BETWEEN low AND high AND low <= high")
part("c4", "c3", "SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY symbol, bar_ts ORDER BY seq) AS k FROM c3) WHERE k = 1")
# a day apart, from the first bar to the last
part("gaps", "c4", "SELECT symbol, unnest(generate_series(bar_ts + INTERVAL 1 DAY, nxt - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS bar_ts FROM (SELECT symbol, bar_ts, lead(bar_ts) OVER (PARTITION BY symbol ORDER BY bar_ts) AS nxt FROM c4) WHERE nxt > bar_ts + INTERVAL 1 DAY")
part("thr", "", "SELECT * FROM (VALUES (0, 1.5::DOUBLE), (1, 2.0::DOUBLE), (2, 2.5::DOUBLE), (3, 3.0::DOUBLE)) t(rank, threshold)")
part("per", "", "SELECT unnest([1, 2, 3, 6, 12]) AS period")
part("cand", "rat thr", "SELECT rat.*, rank, threshold, (residual_zscore < 0)::INT AS side, CASE WHEN residual_zscore > 0 THEN 'B_STRONG' ELSE 'A_STRONG' END AS direction FROM rat JOIN thr ON abs(residual_zscore) >= threshold")


FORWARD = """{keys}count(*) AS "count", """ + ", ".join([r("avg(x)", "mean"), r("median(x)", "median"), r("stddev_pop(x)", "std"), r("avg((x > 0)::INT) * 100", "pct_positive"), r("max(x)", "max"), r("min(x)", "min")])

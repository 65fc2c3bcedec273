"""The registered queries of the bar operators, and the same results as SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairbars.functions.rolling import rounded
from pairbars.functions.work import work_dir
from pairbars.jobs import fixtures as fx
from pairbars.jobs.sql import BAR, SESSION, bars, corr, full, part, r, rs, sql, win
from pairbars.operators import cleaning, correlation, features, leadlag, ratio, regimes, spread, sync
from pairbars.operators.chunks import in_chunks
from pairbars.sources import bars as src

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if oracle:
            SQL[name] = oracle
        return f

    return add


# sources

query("s1_read_bars", sql("eticks", "SELECT symbol, bar_ts, " + r("open", "open") + " FROM (SELECT symbol, date_trunc('minute', ts)::TIMESTAMP AS bar_ts, min(price) AS open FROM eticks GROUP BY ALL)"))(
    lambda s, d: src.from_epoch(fx.intraday_ticks(s, d).select("symbol", (F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 60) * 60).alias("time"), F.col("price").alias("open")), ["open"])
)
query("s2_latest_n_bars", sql("bars", f"SELECT symbol, bar_ts, {rs('open', 'close')}, tick_volume FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar_ts DESC) AS k FROM bars) WHERE k <= 500"))(lambda s, d: src.latest_n_bars(fx.daily(s, d), 500).select("symbol", "bar_ts", "open", "close", "tick_volume"))
query("s3_dedupe_ticks", sql("eticks", f"SELECT symbol, ts, event_id, {r('price', 'price')} FROM (SELECT symbol, date_trunc('second', ts)::TIMESTAMP AS ts, event_id, price, row_number() OVER (PARTITION BY symbol, date_trunc('second', ts) ORDER BY ts, event_id) AS k FROM eticks) WHERE k = 1"))(
    lambda s, d: src.dedupe_ticks(fx.intraday_ticks(s, d), ["ts", "event_id"])
)


@query(
    "s4_resolve_symbols",
    sql(
        "",
        """c(asset, candidate, priority) AS (VALUES ('one', 'Customer#000000007', 0), ('one', 'customer#000000005', 1), ('two', 'Customer#0000001', 0), ('three', 'none', 0), ('three', 'CUSTOMER#000000009', 1)),
l AS (SELECT c_name AS symbol, c_custkey AS listing FROM customer),
m AS (SELECT *, CASE WHEN symbol = candidate THEN 0 WHEN lower(symbol) = lower(candidate) THEN 1 WHEN contains(lower(symbol), lower(candidate)) OR contains(lower(candidate), lower(symbol)) THEN 2 END AS kind FROM l, c)
SELECT asset, symbol FROM (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY CASE WHEN kind < 2 THEN 0 ELSE 1 END, priority, kind, CASE WHEN kind = 1 THEN -listing ELSE listing END) AS k FROM m WHERE kind IS NOT NULL) WHERE k = 1""",
    ).replace("WITH \n", "WITH "),
)
def _s4(s: SparkSession, d: str) -> DataFrame:
    listed = s.read.parquet(f"{d}/customer.parquet").select(F.col("c_name").alias("symbol"), F.col("c_custkey").alias("listing"))
    wanted = s.createDataFrame([("one", "Customer#000000007", 0), ("one", "customer#000000005", 1), ("two", "Customer#0000001", 0), ("three", "none", 0), ("three", "CUSTOMER#000000009", 1)], "asset string, candidate string, priority int")
    return src.resolve_symbols(listed, wanted)


_SOME = f"symbol, bar_ts, {rs('open', 'high', 'low', 'close')}, tick_volume, spread, real_volume"
query("s5_resample_d1", sql("bars", f"SELECT {_SOME} FROM bars"))(fx.daily)
query("s5_resample_m30", sql("ibars", f"SELECT {_SOME} FROM ibars"))(fx.intraday)
for _tf, _start in (("H4", "time_bucket(INTERVAL 4 HOUR, ts)"), ("W1", "date_trunc('week', ts)::TIMESTAMP"), ("MN1", "date_trunc('month', ts)::TIMESTAMP")):
    query(f"s5_resample_{_tf.lower()}", sql("eticks", f"SELECT {_SOME} FROM ({bars('eticks', _start, 'ts, event_id')})"))(lambda s, d, tf=_tf: src.resample(fx.intraday_ticks(s, d), tf, ["ts", "event_id"]))
query("s5_coarser", sql("bars", f"""SELECT {_SOME} FROM (SELECT symbol, date_trunc('month', bar_ts)::TIMESTAMP AS bar_ts, first(open ORDER BY bar_ts) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY bar_ts) AS close,
  sum(tick_volume)::BIGINT AS tick_volume, max(spread) AS spread, sum(real_volume)::BIGINT AS real_volume FROM bars GROUP BY symbol, date_trunc('month', bar_ts))"""))(lambda s, d: src.coarser(fx.daily(s, d), "MN1"))


@query("s1_read_bars_files", sql("bars", f"SELECT format, {_SOME} FROM bars, (VALUES ('csv'), ('parquet')) t(format)"))
def _s1_files(s: SparkSession, d: str) -> DataFrame:
    """The daily bars as files of both formats below the shared folder, each bar twice, read by the declared schema."""
    where = work_dir(s)
    rows = fx.daily(s, d).withColumn("time", F.unix_timestamp(F.col("bar_ts").cast("timestamp")))
    rows = rows.select([F.col(c.split()[0]).cast(c.split()[1]) for c in src.BAR_SCHEMA.split(", ")])
    rows = rows.unionByName(rows)
    rows.write.parquet(f"{where}/parquet")
    rows.write.option("header", True).csv(f"{where}/csv")
    each = [src.read_bars(s, f"{where}/{fmt}", fmt).select(F.lit(fmt).alias("format"), *["symbol", "bar_ts", *src.PRICES, "tick_volume", "spread", "real_volume"]) for fmt in ("csv", "parquet")]
    return each[0].unionByName(each[1])


@query("s6_write_dataset", sql("pb0", f"SELECT format, pair_id, bar_ts, {rs('a_close', 'b_close')} FROM pb0, (VALUES ('csv'), ('parquet')) t(format)"))
def _s6(s: SparkSession, d: str) -> DataFrame:
    """Written to a new folder below the shared one, and read again."""
    root = s.conf.get("spark.checkpoint.dir", None) or s.conf.get("spark.sql.warehouse.dir")
    where, rows = f"{root.rstrip('/')}/dataset-{uuid.uuid4().hex}", fx.daily_pairs(s, d).select("pair_id", "bar_ts", "a_close", "b_close")
    src.write_dataset(rows, where)
    read = {"parquet": s.read.schema(rows.schema).parquet(f"{where}/parquet"), "csv": s.read.schema(rows.schema).option("header", True).csv(f"{where}/csv")}
    each = [df.select(F.lit(name).alias("format"), *rows.columns) for name, df in read.items()]
    return each[0].unionByName(each[1])


query("s7_run_metadata", sql("pb", """SELECT pair_id, '2026-01-01T00:00:00Z' AS run_at, 50000::BIGINT AS bars_requested, count(*) AS bars_actual, '{"beta_window":"100","timeframe":"D1"}' AS parameters FROM pb GROUP BY pair_id"""))(
    lambda s, d: src.run_metadata(fx.daily_pairs(s, d), {"timeframe": "D1", "beta_window": "100"}, "2026-01-01T00:00:00Z", 50_000)
)
query("s8_require_min_bars", sql("bars", "SELECT symbol, bar_ts FROM bars WHERE symbol IN (SELECT symbol FROM bars GROUP BY 1 HAVING count(*) >= 2450)"))(lambda s, d: src.require_min_bars(fx.daily(s, d), 2450, ["symbol"]).select("symbol", "bar_ts"))

# cleaning


def _listed(df: DataFrame, times: str) -> DataFrame:
    """Times as text, which both engines compare alike."""
    return df.withColumn(times, F.array_join(F.transform(times, lambda t: F.date_format(t, "yyyy-MM-dd HH:mm:ss")), ","))


_F = f"symbol, bar_ts, {rs('open', 'high', 'low', 'close')}, tick_volume, spread, real_volume, seq"
query("c1_drop_null_bars", sql("c1", f"SELECT {_F} FROM c1"))(lambda s, d: cleaning.drop_null_bars(fx.faulty(s, d)))
query("c2_drop_zero_price", sql("c2", f"SELECT {_F} FROM c2"))(lambda s, d: cleaning.drop_zero_price(cleaning.drop_null_bars(fx.faulty(s, d))))
query("c3_drop_invalid_ohlc", sql("c3", f"SELECT {_F} FROM c3"))(lambda s, d: cleaning.drop_invalid_ohlc(cleaning.drop_zero_price(cleaning.drop_null_bars(fx.faulty(s, d)))))
query("c4_drop_duplicate_bars", sql("faulty", f"SELECT {_F} FROM (SELECT *, row_number() OVER (PARTITION BY symbol, bar_ts ORDER BY seq) AS k FROM faulty) WHERE k = 1"))(lambda s, d: cleaning.drop_duplicate_bars(fx.faulty(s, d)))
part("dts", "bars", "SELECT symbol, bar_ts, row_number() OVER w AS k, epoch(bar_ts)::BIGINT - lag(epoch(bar_ts)::BIGINT) OVER w AS dt FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar_ts)")
query("c5_infer_frequency", sql("dts", """SELECT symbol, CASE WHEN n < 3 THEN NULL WHEN a = b THEN a WHEN weekly THEN 86400 END AS step_seconds, n >= 3 AND a < b AND weekly AS weekdays_only
FROM (SELECT symbol, count(*) AS n, min(dt) AS a, max(dt) AS b, bool_and(isodow(bar_ts) < 6 AND (dt IS NULL OR dt = CASE WHEN isodow(bar_ts) = 1 THEN 259200 ELSE 86400 END)) AS weekly FROM dts WHERE k <= 100 GROUP BY symbol)"""))(
    lambda s, d: cleaning.infer_frequency(fx.daily(s, d)).select("symbol", "step_seconds", "weekdays_only")
)
# calendars of months: the bars of the first, last, first and last business days of months or quarters, with some taken out
_CALENDARS = (("MN1", 1, "start"), ("ME", 1, "end"), ("BMS", 1, "business_start"), ("BME", 1, "business_end"), ("QS", 3, "start"), ("QE", 3, "end"))
_FIRST = "date_trunc('month', bar_ts)::TIMESTAMP"
_LAST = "(date_trunc('month', bar_ts) + INTERVAL 1 MONTH - INTERVAL 1 DAY)::TIMESTAMP"
_ON = {"start": _FIRST, "end": _LAST, "business_start": f"{_FIRST} + to_days((CASE isodow({_FIRST}) WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 0 END)::INT)", "business_end": f"{_LAST} - to_days((CASE isodow({_LAST}) WHEN 6 THEN 1 WHEN 7 THEN 2 ELSE 0 END)::INT)"}
part("monthly", "bars", " UNION ALL ".join(f"SELECT symbol || '-{n}' AS symbol, {k} AS months, '{a}' AS anchor, bar_ts FROM (SELECT DISTINCT symbol, {_ON[a]} AS bar_ts FROM bars WHERE (year(bar_ts) * 12 + month(bar_ts) - 1) % {k} = 0)" for n, k, a in _CALENDARS))
part("holed", "monthly", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar_ts) AS k FROM monthly)")
query("c5_infer_frequency_months", sql("monthly", "SELECT symbol, NULL::BIGINT AS step_seconds, false AS weekdays_only, any_value(months) AS months, any_value(anchor) AS anchor FROM monthly GROUP BY symbol"))(lambda s, d: cleaning.infer_frequency(fx.calendars(s, d)))
query("c6_missing_bars_months", sql("holed", "SELECT symbol, bar_ts::TIMESTAMP AS bar_ts FROM holed WHERE k IN (16, 17, 21)"))(lambda s, d: cleaning.missing_bars(fx.calendars(s, d, (16, 17, 21)), first=12))
query("c6_missing_bars", sql("gaps", "SELECT symbol, bar_ts::TIMESTAMP AS bar_ts FROM gaps"))(lambda s, d: cleaning.missing_bars(cleaning.clean_bars(fx.faulty(s, d)), 86_400))
query(
    "c7_quality_report",
    sql(
        "c4 gaps",
        """SELECT symbol, total_bars, null_values, zero_prices, invalid_ohlc, duplicates, coalesce(missing_total, 0) AS missing_total, first_missing::TIMESTAMP AS first_missing, coalesce(least(missing_total, 10), 0) AS missing_listed, coalesce(gaps, '') AS gaps
FROM (SELECT symbol, count(*) AS total_bars, sum((open IS NULL)::INT + (high IS NULL)::INT + (low IS NULL)::INT + (close IS NULL)::INT)::BIGINT AS null_values FROM faulty GROUP BY symbol)
JOIN (SELECT symbol, sum((open = 0 OR high = 0 OR low = 0 OR close = 0)::INT)::BIGINT AS zero_prices FROM c1 GROUP BY symbol) USING (symbol)
JOIN (SELECT symbol, sum((NOT (open BETWEEN low AND high AND close BETWEEN low AND high AND low <= high))::INT)::BIGINT AS invalid_ohlc FROM c2 GROUP BY symbol) USING (symbol)
JOIN (SELECT symbol, count(*) - count(DISTINCT bar_ts) AS duplicates FROM c3 GROUP BY symbol) USING (symbol)
LEFT JOIN (SELECT symbol, max(n) AS missing_total, min(bar_ts) AS first_missing, string_agg(strftime(bar_ts, '%Y-%m-%d %H:%M:%S'), ',' ORDER BY bar_ts) FILTER (k <= 10) AS gaps
           FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar_ts) AS k, count(*) OVER (PARTITION BY symbol) AS n FROM gaps) GROUP BY symbol) USING (symbol)""",
    ),
)(lambda s, d: _listed(cleaning.quality_report(fx.faulty(s, d), step_seconds=86_400), "gaps"))
query("c8_clean_bars", sql("c4", f"SELECT {_SOME} FROM c4"))(lambda s, d: cleaning.clean_bars(fx.faulty(s, d)))

# joins

_SIDES = ", ".join(f"round({s}_{c}, 6) + 0.0 AS {s}_{c}" if c in ("open", "high", "low", "close") else f"{s}_{c}" for s in "ab" for c in BAR.split(", "))
query("j1_synchronize", sql("pb0", f"SELECT pair_id, bar_ts, pos, {_SIDES} FROM pb0"))(lambda s, d: sync.synchronize(fx.daily(s, d)))
# a list of pairs given
query("j1_synchronize_listed", sql("pb0", f"SELECT pair_id, bar_ts, pos, {_SIDES} FROM pb0 WHERE pair_id LIKE 'A%'"))(lambda s, d: sync.synchronize(fx.daily(s, d), sync.all_pairs(fx.daily(s, d)).filter("a_symbol like 'A%'")))
part("ia", "ibars ipb_pairs", "SELECT pair_id, bar_ts FROM ipb_pairs JOIN ibars ON symbol = a_symbol")
part("ib", "ibars ipb_pairs", "SELECT pair_id, bar_ts FROM ipb_pairs JOIN ibars ON symbol = b_symbol")
query("j2_unmatched", sql("ia ib", "SELECT *, 'a' AS side FROM (SELECT * FROM ia EXCEPT SELECT * FROM ib) UNION ALL SELECT *, 'b' AS side FROM (SELECT * FROM ib EXCEPT SELECT * FROM ia)"))(lambda s, d: sync.unmatched(fx.intraday(s, d)))
query(
    "j3_sync_report",
    sql(
        "ia ib ipb0",
        """SELECT pair_id, a_bars, b_bars, matched, a_bars - matched AS a_unmatched, b_bars - matched AS b_unmatched, coalesce(missing, 0)::BIGINT AS missing, first_missing, coalesce(missing_periods, '') AS missing_periods FROM (SELECT pair_id, count(*) AS a_bars FROM ia GROUP BY 1) JOIN (SELECT pair_id, count(*) AS b_bars FROM ib GROUP BY 1) USING (pair_id)
JOIN (SELECT pair_id, count(*) AS matched FROM ipb0 GROUP BY 1) USING (pair_id)
LEFT JOIN (SELECT pair_id, sum(epoch(nxt - bar_ts) / 1800 - 1) AS missing, min(bar_ts) + INTERVAL 30 MINUTE AS first_missing FROM (SELECT pair_id, bar_ts, lead(bar_ts) OVER (PARTITION BY pair_id ORDER BY bar_ts) AS nxt FROM ipb0) WHERE nxt > bar_ts + INTERVAL 30 MINUTE GROUP BY 1) USING (pair_id)
LEFT JOIN (SELECT pair_id, string_agg(strftime(t, '%Y-%m-%d %H:%M:%S'), ',' ORDER BY t) AS missing_periods FROM (SELECT pair_id, t, row_number() OVER (PARTITION BY pair_id ORDER BY t) AS k FROM (SELECT pair_id, unnest(generate_series(bar_ts + INTERVAL 30 MINUTE, nxt - INTERVAL 30 MINUTE, INTERVAL 30 MINUTE)) AS t
           FROM (SELECT pair_id, bar_ts, lead(bar_ts) OVER (PARTITION BY pair_id ORDER BY bar_ts) AS nxt FROM ipb0) WHERE nxt > bar_ts + INTERVAL 30 MINUTE)) WHERE k <= 10 GROUP BY 1) USING (pair_id)""",
    ),
)(lambda s, d: _listed(sync.sync_report(fx.intraday(s, d), step_seconds=1800), "missing_periods"))

# features, on each symbol's own bars

_KEY = ["symbol", "bar_ts"]
_W = "WINDOW w AS (PARTITION BY symbol ORDER BY bar_ts)"
part("ret", "bars", f"SELECT *, ln(close / lag(close) OVER w) AS log_return FROM bars {_W}")
query("f1_log_return", sql("ret", f"SELECT symbol, bar_ts, {rs('log_return')} FROM ret"))(lambda s, d: features.log_return(fx.stored(s, d)).select(*_KEY, "log_return"))
query("f2_pct_return", sql("bars", f"SELECT symbol, bar_ts, {r('close / lag(close) OVER w - 1', 'pct_return')} FROM bars {_W}"))(lambda s, d: features.pct_return(fx.stored(s, d)).select(*_KEY, "pct_return"))
part("bn", "bars", "SELECT symbol, bar_ts, close, row_number() OVER (PARTITION BY symbol ORDER BY bar_ts) AS k FROM bars")
part("em", "bn", "SELECT symbol, bar_ts, k, close AS e9, close AS e21, close AS e50, close AS e200 FROM bn WHERE k = 1 UNION ALL SELECT b.symbol, b.bar_ts, b.k, " + ", ".join(f"b.close * (2.0::DOUBLE / {n + 1}) + e{n} * (1 - 2.0::DOUBLE / {n + 1})" for n in (9, 21, 50, 200)) + " FROM em JOIN bn b ON b.symbol = em.symbol AND b.k = em.k + 1")


@query("f3_ema", sql("em", f"SELECT symbol, bar_ts, {', '.join(r(f'e{n}', f'ema_{n}') for n in (9, 21, 50, 200))} FROM em", recursive=True))
def _f3(s: SparkSession, d: str) -> DataFrame:
    return features.emas(fx.stored(s, d), (9, 21, 50, 200)).select(*_KEY, *[f"ema_{n}" for n in (9, 21, 50, 200)])


_S14 = win(14, "symbol")
part("chg", "bars", f"SELECT *, coalesce(close - lag(close) OVER w, 0) AS dc FROM bars {_W}")
part("ud", "chg", f"SELECT symbol, bar_ts, {full('avg', 'greatest(dc, 0)', 14, _S14)} AS u, {full('avg', 'greatest(-dc, 0)', 14, _S14)} AS dn FROM chg")
query("f4_rsi", sql("ud", f"SELECT symbol, bar_ts, {r('CASE WHEN dn = 0 AND u > 0 THEN 100 ELSE 100 - 100 / (1 + u / nullif(dn, 0)) END', 'rsi_14')} FROM ud"))(lambda s, d: features.rsi(fx.stored(s, d)).select(*_KEY, "rsi_14"))
part("tr", "bars", f"""SELECT *, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr, CASE WHEN lag(high) OVER w IS NOT NULL THEN greatest(high - lag(high) OVER w, 0) END AS pdm, abs(low - lag(low) OVER w) AS mdm FROM bars {_W}""")
part("atr", "tr", f"SELECT *, {full('avg', 'tr', 14, _S14)} AS atr_14, {full('avg', 'pdm', 14, _S14)} AS p, {full('avg', 'mdm', 14, _S14)} AS m FROM tr")
query("f5_atr", sql("atr", f"SELECT symbol, bar_ts, {rs('atr_14')} FROM atr"))(lambda s, d: features.atr(fx.stored(s, d)).select(*_KEY, "atr_14"))
part("di", "atr", "SELECT symbol, bar_ts, 100 * p / nullif(atr_14, 0) AS plus_di, 100 * m / nullif(atr_14, 0) AS minus_di FROM atr")
part("dx", "di", "SELECT *, 100 * abs(plus_di - minus_di) / nullif(plus_di + minus_di, 0) AS dx FROM di")
query("f6_adx", sql("dx", f"SELECT symbol, bar_ts, {rs('plus_di', 'minus_di')}, {r(full('avg', 'dx', 14, _S14), 'adx_14')} FROM dx"))(lambda s, d: features.adx(fx.stored(s, d)).select(*_KEY, "plus_di", "minus_di", "adx_14"))
_MOM = (1, 2, 3, 6, 12)
query("f7_momentum", sql("bars", f"SELECT symbol, bar_ts, {', '.join(r(f'close / lag(close, {p}) OVER w - 1', f'momentum_{p}') for p in _MOM)} FROM bars {_W}"))(lambda s, d: features.momentum(fx.stored(s, d)).select(*_KEY, *[f"momentum_{p}" for p in _MOM]))
_FEATURES = ["log_return", "pct_return", "rsi_14", "atr_14", "plus_di", "minus_di", "adx_14", *[f"momentum_{p}" for p in _MOM], *[f"ema_{n}" for n in (9, 21, 50, 200)]]
part("ind", "dx", f"SELECT symbol, bar_ts, plus_di, minus_di, {full('avg', 'dx', 14, _S14)} AS adx_14 FROM dx")
part("mom", "bars", f"SELECT symbol, bar_ts, close / lag(close) OVER w - 1 AS pct_return, {', '.join(f'close / lag(close, {p}) OVER w - 1 AS momentum_{p}' for p in _MOM)} FROM bars {_W}")
part("rs14", "ud", "SELECT symbol, bar_ts, CASE WHEN dn = 0 AND u > 0 THEN 100 ELSE 100 - 100 / (1 + u / nullif(dn, 0)) END AS rsi_14 FROM ud")
part("ema4", "em", "SELECT symbol, bar_ts, " + ", ".join(f"e{n} AS ema_{n}" for n in (9, 21, 50, 200)) + " FROM em")
query("f8_add_features", sql("ret atr ind mom rs14 ema4", f"SELECT symbol, bar_ts, {rs(*_FEATURES)} FROM ret JOIN (SELECT symbol, bar_ts, atr_14 FROM atr) USING (symbol, bar_ts) JOIN ind USING (symbol, bar_ts) JOIN mom USING (symbol, bar_ts) JOIN rs14 USING (symbol, bar_ts) JOIN ema4 USING (symbol, bar_ts)", recursive=True))(
    lambda s, d: features.add_features(fx.stored(s, d)).select(*_KEY, *_FEATURES)
)
query("f9_rolling_volatility", sql("ret", f"SELECT symbol, bar_ts, {r(full('stddev_samp', 'log_return', 100, win(100, 'symbol')), 'volatility')} FROM ret"))(lambda s, d: features.rolling_volatility(features.log_return(fx.daily(s, d))).select(*_KEY, "volatility"))
query("f10_volatility_regime", sql("reg", "SELECT pair_id, bar_ts, volatility_regime FROM reg"))(lambda s, d: fx.intraday_regimes(s, d).select("pair_id", "bar_ts", "volatility_regime"))
query("f11_atr_pct", sql("atr", f"SELECT symbol, bar_ts, {r('atr_14 / close * 100', 'atr_pct')} FROM atr"))(lambda s, d: features.atr_pct(features.atr(fx.daily(s, d))).select(*_KEY, "atr_pct"))

# sessions and regimes

query("r1_session_label", sql("ibars", f"SELECT symbol, bar_ts, {SESSION} AS session FROM ibars"))(lambda s, d: regimes.session_label(fx.intraday(s, d)).select(*_KEY, "session"))
query("r2_session_flags", sql("ibars", "SELECT symbol, bar_ts, " + ", ".join(f"({SESSION} = '{n}')::INT AS is_{n.lower()}" for n in ("ASIA", "LONDON", "LONDON_NEW_YORK_OVERLAP", "NEW_YORK")) + " FROM ibars"))(
    lambda s, d: regimes.session_flags(fx.intraday(s, d)).select(*_KEY, "is_asia", "is_london", "is_london_new_york_overlap", "is_new_york")
)
_REG = ", ".join([r(corr("a_log_return", "b_log_return"), "correlation"), *[x for s in "ab" for x in (r(f"avg({s}_log_return)", f"{s}_mean"), r(f"stddev_samp({s}_log_return)", f"{s}_std"), r(f"avg({s}_spread)", f"{s}_spread_mean"))]])
query("r3_regime_table", sql("reg", " UNION ALL ".join(f"SELECT pair_id, '{g}' AS \"grouping\", {g} AS label, count(*) AS n_rows, {_REG} FROM reg GROUP BY pair_id, {g} HAVING count(*) >= 10" for g in ("session", "volatility_regime"))))(lambda s, d: regimes.regime_table(fx.intraday_regimes(s, d)))
query("r4_session_spread_means", sql("ipb", f"SELECT pair_id, CASE WHEN hour(bar_ts) < 7 THEN 'ASIA' WHEN hour(bar_ts) < 12 THEN 'LONDON' WHEN hour(bar_ts) < 16 THEN 'LONDON_NEW_YORK_OVERLAP' ELSE 'NEW_YORK' END AS session, {r('avg(a_spread)', 'a_spread_mean')}, {r('avg(b_spread)', 'b_spread_mean')} FROM ipb GROUP BY 1, 2"))(
    lambda s, d: regimes.session_spread_means(fx.intraday_pairs(s, d))
)

# correlation

_WS = (20, 50, 100, 200)
_BOTH = "count(*) FILTER (a_log_return IS NOT NULL AND b_log_return IS NOT NULL)"
part("rc", "pb", "SELECT *, " + ", ".join(f"CASE WHEN {_BOTH} OVER {win(w)} = {w} THEN {corr('a_log_return', 'b_log_return', win(w))} END AS corr_{w}" for w in _WS) + " FROM pb")
_PK = ["pair_id", "bar_ts"]
query("k1_rolling_correlation", sql("rc", f"SELECT pair_id, bar_ts, {rs(*[f'corr_{w}' for w in _WS])} FROM rc"))(lambda s, d: correlation.rolling_correlation(fx.daily_pairs(s, d), pos="pos").select(*_PK, *[f"corr_{w}" for w in _WS]))
part("sw", "pb", "SELECT x.pair_id, x.pos, y.a_log_return AS a, y.b_log_return AS b FROM pb x JOIN pb y ON y.pair_id = x.pair_id AND y.pos BETWEEN x.pos - 49 AND x.pos WHERE x.pos >= 50")
part("sr", "sw", "SELECT pair_id, pos, rank() OVER (PARTITION BY pair_id, pos ORDER BY a) + (count(*) OVER (PARTITION BY pair_id, pos, a) - 1) / 2.0::DOUBLE AS ra, rank() OVER (PARTITION BY pair_id, pos ORDER BY b) + (count(*) OVER (PARTITION BY pair_id, pos, b) - 1) / 2.0::DOUBLE AS rb FROM sw")
query("k2_rolling_spearman", sql("sr", f"SELECT pair_id, bar_ts, {r('c', 'spearman_50')} FROM pb LEFT JOIN (SELECT pair_id, pos, {corr('ra', 'rb')} AS c FROM sr GROUP BY 1, 2) USING (pair_id, pos)"))(lambda s, d: correlation.rolling_spearman(fx.daily_pairs(s, d), pos="pos").select(*_PK, "spearman_50"))
part("lc", "rc", "SELECT pair_id, unnest([20, 50, 100, 200]) AS \"window\", unnest([corr_20, corr_50, corr_100, corr_200]) AS c FROM rc")
query(
    "k3_correlation_statistics",
    sql("lc", "SELECT pair_id, \"window\", count(c) AS n, " + ", ".join([r("avg(c)", "mean"), r("median(c)", "median"), r("stddev_samp(c)", "std"), r("min(c)", "min"), r("max(c)", "max"), *[r(f"avg((c > {t})::INT) * 100", n) for t, n in ((0, "pct_positive"), (0.5, "pct_over_05"), (0.7, "pct_over_07"))]]) + " FROM lc GROUP BY 1, 2"),
)(lambda s, d: correlation.correlation_statistics(correlation.rolling_correlation(fx.daily_pairs(s, d), pos="pos")))
for _id, _g in (("k4_correlation_by_session", "session"), ("k5_correlation_by_regime", "volatility_regime")):
    query(_id, sql("reg", f"SELECT pair_id, {_g}, n_rows, {rs('correlation')}, {', '.join(r(f'CASE WHEN n_rows >= {w} THEN correlation END', f'corr_{w}') for w in _WS)} FROM (SELECT pair_id, {_g}, count(*) AS n_rows, {corr('a_log_return', 'b_log_return')} AS correlation FROM reg GROUP BY 1, 2)"))(lambda s, d, g=_g: correlation.correlation_by(fx.intraday_regimes(s, d), g))
part("st", "pb", "SELECT pair_id, a_log_return AS a, b_log_return AS b, row_number() OVER (PARTITION BY pair_id ORDER BY bar_ts) - 1 AS p, count(*) OVER (PARTITION BY pair_id) AS n FROM pb WHERE a_log_return IS NOT NULL AND b_log_return IS NOT NULL")
part("stw", "st", f"SELECT pair_id, w, {corr('a', 'b')} AS c FROM (SELECT DISTINCT pair_id AS q, unnest(range(0, n - 100, 50)) AS w FROM st) JOIN st ON pair_id = q AND p BETWEEN w AND w + 99 GROUP BY 1, 2")
query("k6_correlation_stability", sql("stw", f"SELECT pair_id, {r('avg(c)', 'mean')}, {r('stddev_pop(c)', 'std')}, {r('min(c)', 'min')}, {r('max(c)', 'max')}, count(*) AS n_windows FROM stw GROUP BY 1"))(lambda s, d: correlation.correlation_stability(fx.daily_pairs(s, d)))
query("k7_autocorrelation", sql("pb", " UNION ALL ".join(f"SELECT pair_id, {k} AS lag, {r(corr('x', 'y'), 'autocorrelation')} FROM (SELECT pair_id, a_log_return AS x, lag(a_log_return, {k}) OVER (PARTITION BY pair_id ORDER BY bar_ts) AS y FROM pb) GROUP BY 1" for k in range(21))))(lambda s, d: correlation.autocorrelation(fx.daily_pairs(s, d), pos="pos"))

# lead and lag


def _lags(source: str, keys: str, max_lag: int, directions: tuple[str, ...] = ("ab", "ba")) -> str:
    return " UNION ALL ".join(
        f"SELECT {keys}, '{x}_leads_{y}' AS direction, {k} AS lag, {corr('x', 'y')} AS correlation, count(*) AS n_rows FROM (SELECT {keys}, {x}_log_return AS x, lead({y}_log_return, {k}) OVER (PARTITION BY {keys} ORDER BY bar_ts) AS y FROM {source}) GROUP BY {keys}" for x, y in directions for k in range(max_lag + 1)
    )


def _best(source: str, keys: str) -> str:
    return f"SELECT {keys}, direction, CASE WHEN correlation IS NULL THEN 0 ELSE lag END AS lag, {r('coalesce(correlation, 0)', 'correlation')}, CASE WHEN correlation IS NULL THEN 0 ELSE lag * 10 END AS minutes, (CASE WHEN correlation IS NULL THEN 0 ELSE n_rows - lag END)::BIGINT AS sample_size FROM (SELECT *, row_number() OVER (PARTITION BY {keys}, direction ORDER BY abs(correlation) DESC NULLS LAST, lag) AS k FROM {source}) WHERE k = 1"


part("ll", "pb", _lags("pb", "pair_id", 12))
query("l1_lead_lag", sql("ll", f"SELECT pair_id, direction, lag, {rs('correlation')}, n_rows FROM ll"))(lambda s, d: leadlag.lead_lag(fx.daily_pairs(s, d), pos="pos"))
query("l2_best_lag", sql("ll", _best("ll", "pair_id")))(lambda s, d: leadlag.best_lag(leadlag.lead_lag(fx.daily_pairs(s, d), pos="pos")))
for _id, _g in (("l3_lead_lag_by_session", "session"), ("l3_lead_lag_by_regime", "volatility_regime")):
    part(f"ll_{_g}", "reg", _lags("reg", f"pair_id, {_g}", 12))
    query(_id, sql(f"ll_{_g}", _best(f"(SELECT * FROM ll_{_g} WHERE n_rows > 22)", f"pair_id, {_g}")))(lambda s, d, g=_g: leadlag.lead_lag_by(fx.intraday_regimes(s, d), g))
part("lon", "ses", "SELECT * FROM ses WHERE session = 'LONDON'")
query("l4_conditional_lead_lag", sql("lon", f"SELECT pair_id, direction, lag, {rs('correlation')}, n_rows FROM ({_lags('lon', 'pair_id', 12, ('ab',))}) WHERE n_rows >= 22"))(lambda s, d: leadlag.conditional_lead_lag(fx.intraday_pairs(s, d), "session", "LONDON"))

# ratio, beta, residual


def _percentiles(s: SparkSession, d: str) -> DataFrame:
    rows = ratio.ratio(fx.daily_pairs(s, d))

    def run(rows: DataFrame, keys: list[str]) -> DataFrame:
        for w in _WS:
            rows = ratio.ratio_percentile(rows, w, keys)
        return rows

    return in_chunks(rows, ["pair_id"], run, max(_WS) - 1, pos="pos")


query("t1_ratio", sql("scored", f"SELECT pair_id, bar_ts, {rs('ratio')} FROM scored"))(lambda s, d: ratio.ratio(fx.daily_pairs(s, d)).select(*_PK, "ratio"))
_RF = [f"ratio_{n}_{w}" for w in _WS for n in ("mean", "std")]
query("t2_ratio_mean_std", sql("rat", f"SELECT pair_id, bar_ts, {rs(*_RF)} FROM rat"))(lambda s, d: fx.daily_scored(s, d).select(*_PK, *_RF))
query("t3_ratio_percentile", sql("rat", "SELECT x.pair_id, x.bar_ts, " + ", ".join(r(f"CASE WHEN count(*) FILTER (y.pos > x.pos - {w}) = {w} THEN avg((y.ratio <= x.ratio)::INT) FILTER (y.pos > x.pos - {w}) * 100 END", f"ratio_percentile_{w}") for w in _WS) + " FROM rat x JOIN rat y ON y.pair_id = x.pair_id AND y.pos BETWEEN x.pos - 199 AND x.pos GROUP BY 1, 2"))(
    lambda s, d: _percentiles(s, d).select(*_PK, *[f"ratio_percentile_{w}" for w in _WS])
)
query("t4_ratio_zscore", sql("rat", f"SELECT pair_id, bar_ts, {rs('ratio_zscore_100')} FROM rat"))(lambda s, d: fx.daily_scored(s, d).select(*_PK, "ratio_zscore_100"))
query("t5_rolling_beta", sql("beta", f"SELECT pair_id, bar_ts, {rs('cov', 'var_a', 'beta')} FROM beta"))(lambda s, d: ratio.rolling_beta(fx.daily_pairs(s, d), pos="pos").select(*_PK, "cov", "var_a", "beta"))
query("t6_residual", sql("res", f"SELECT pair_id, bar_ts, {rs('expected_b_return', 'residual')} FROM res"))(lambda s, d: fx.daily_scored(s, d).select(*_PK, "expected_b_return", "residual"))
query("t7_residual_zscore", sql("scored", f"SELECT pair_id, bar_ts, {rs('residual_zscore')} FROM scored"))(lambda s, d: fx.daily_scored(s, d).select(*_PK, "residual_zscore"))
part("lastr", "rat", "SELECT pair_id, last(ratio ORDER BY bar_ts) AS l, last(ratio_zscore_100 ORDER BY bar_ts) AS lz FROM rat GROUP BY 1")
query("t8_ratio_summary", sql("lastr", f"SELECT pair_id, {r('any_value(l)', 'last')}, {r('any_value(lz)', 'last_zscore')}, {r('avg(ratio)', 'mean')}, {r('stddev_samp(ratio)', 'std')}, {r('avg((ratio <= l)::INT) * 100', 'percentile')} FROM rat JOIN lastr USING (pair_id) GROUP BY 1"))(lambda s, d: ratio.ratio_summary(fx.daily_scored(s, d)))
query("t9_beta_summary", sql("beta", f"SELECT pair_id, {r('avg(beta)', 'mean')}, {r('median(beta)', 'median')}, {r('min(beta)', 'min')}, {r('max(beta)', 'max')}, {r('stddev_samp(beta)', 'std')} FROM beta GROUP BY 1"))(lambda s, d: ratio.beta_summary(fx.daily_scored(s, d)))
query("t10_residual_zscore_summary", sql("scored", f"SELECT pair_id, {r('avg(residual_zscore)', 'mean')}, {r('stddev_samp(residual_zscore)', 'std')}, {r('min(residual_zscore)', 'min')}, {r('max(residual_zscore)', 'max')} FROM scored GROUP BY 1"))(lambda s, d: ratio.residual_zscore_summary(fx.daily_scored(s, d)))

"""Market features and event studies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calendar as cal
from ..operators import events as ev
from ..operators import market as mk
from .proxies import EVENTS, MARKET, benchmark, clip_sql, events, market, prices
from .registry import query, rounded, table

_W = "PARTITION BY ticker ORDER BY date"


def _r(*cols: str) -> str:
    return ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in cols)


@query(f"WITH {MARKET} SELECT ticker, date, {_r('daily_return')} FROM r")
def daily_return(spark, d):
    return rounded(mk.daily_returns(prices(spark, d)).select("ticker", "date", "daily_return"))


@query(f"""WITH {MARKET}, f AS (SELECT ticker, date, {", ".join(f"lead(close, {n}) OVER ({_W}) / close - 1 AS return_{n}d" for n in (1, 3, 5, 10))} FROM px)
SELECT ticker, date, {_r(*[f"return_{n}d" for n in (1, 3, 5, 10)])} FROM f""")
def forward_returns(spark, d):
    return rounded(mk.forward_returns(prices(spark, d), [1, 3, 5, 10]).select("ticker", "date", *[f"return_{n}d" for n in (1, 3, 5, 10)]))


@query(f"WITH {MARKET} SELECT ticker, date, {_r('daily_return', 'benchmark_return')}, round(daily_return - benchmark_return, 6) + 0.0 AS abnormal_return FROM m")
def benchmark_join(spark, d):
    return rounded(mk.abnormal_returns(market(spark, d)).select("ticker", "date", "daily_return", "benchmark_return", "abnormal_return"))


_AR = ", ".join(f"lead(close, {n}) OVER ({_W}) / close - 1 - (pow(1 + benchmark_return, {n}) - 1) AS abnormal_return_{n}d" for n in (1, 2, 3, 5))


@query(f"""WITH {MARKET}, a AS (SELECT ticker, date, {_AR} FROM m)
SELECT ticker, date, {_r(*[f"abnormal_return_{n}d" for n in (1, 2, 3, 5)])} FROM a""")
def abnormal_returns(spark, d):
    out = mk.abnormal_returns(mk.forward_returns(market(spark, d), [1, 2, 3, 5]), [1, 2, 3, 5])
    return rounded(out.select("ticker", "date", *[f"abnormal_return_{n}d" for n in (1, 2, 3, 5)]))


@query(f"""WITH {MARKET}, a AS (SELECT ticker, date, {_AR} FROM m)
SELECT ticker, date, round(abnormal_return_1d + abnormal_return_2d + abnormal_return_3d, 6) + 0.0 AS car_3d,
  round(abnormal_return_1d + abnormal_return_2d + abnormal_return_3d + abnormal_return_5d, 6) + 0.0 AS car_5d FROM a""")
def car_from_horizons(spark, d):
    out = mk.abnormal_returns(mk.forward_returns(market(spark, d), [1, 2, 3, 5]), [1, 2, 3, 5])
    return rounded(mk.car_from_horizons(out, {"car_3d": [1, 2, 3], "car_5d": [1, 2, 3, 5]}).select("ticker", "date", "car_3d", "car_5d"))


@query(f"""WITH {MARKET} SELECT ticker, date, round(CASE WHEN count(daily_return) OVER f >= 10 THEN stddev_samp(daily_return) OVER f END * sqrt(252), 6) AS rolling_volatility_20d
FROM r WINDOW f AS ({_W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""")
def rolling_volatility(spark, d):
    return rounded(mk.rolling_volatility(mk.daily_returns(prices(spark, d))).select("ticker", "date", "rolling_volatility_20d"))


@query(f"""WITH {MARKET} SELECT ticker, date, round(avg(close) OVER ({_W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 6) AS sma_20, round(avg(close) OVER ({_W} ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 6) AS sma_50 FROM px""")
def sma_windows(spark, d):
    return rounded(mk.moving_averages(prices(spark, d), [20, 50]).select("ticker", "date", "sma_20", "sma_50"))


@query(f"""WITH RECURSIVE {MARKET}, n AS (SELECT ticker, date, close, row_number() OVER ({_W}) AS i FROM px),
e AS (SELECT ticker, date, i, close AS x FROM n WHERE i = 1 UNION ALL SELECT n.ticker, n.date, n.i, 2.0 / 21 * n.close + (1 - 2.0 / 21) * e.x FROM e JOIN n ON n.ticker = e.ticker AND n.i = e.i + 1)
SELECT ticker, date, round(x, 6) AS ema_20 FROM e""")
def ema_span20(spark, d):
    return rounded(mk.ema(prices(spark, d).select("ticker", "date", "adj_close"), 20).select("ticker", "date", "ema_20"))


@query(f"""WITH {MARKET}, k AS (SELECT ticker, date, close / lag(close, 5) OVER ({_W}) - 1 AS momentum_5d, close / lag(close, 20) OVER ({_W}) - 1 AS momentum_20d FROM px)
SELECT ticker, date, {_r('momentum_5d', 'momentum_20d')} FROM k""")
def momentum(spark, d):
    return rounded(mk.momentum(prices(spark, d), [5, 20]).select("ticker", "date", "momentum_5d", "momentum_20d"))


@query(f"""WITH {MARKET}, k AS (SELECT ticker, date, open / lag(close) OVER ({_W}) - 1 AS price_gap, greatest((high - low) / close, 0) AS intraday_range FROM px)
SELECT ticker, date, {_r('price_gap', 'intraday_range')} FROM k""")
def price_gap_range(spark, d):
    return rounded(mk.gap_and_range(prices(spark, d)).select("ticker", "date", "price_gap", "intraday_range"))


@query(f"""WITH {MARKET}, k AS (SELECT ticker, date, volume / lag(volume) OVER ({_W}) - 1 AS vc, volume / avg(volume) OVER ({_W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS rv FROM px),
j AS (SELECT ticker, date, {clip_sql('vc', -10, 100)} AS volume_change, {clip_sql('rv', 0, 50)} AS relative_volume FROM k)
SELECT ticker, date, {_r('volume_change', 'relative_volume')} FROM j""")
def relative_volume(spark, d):
    return rounded(mk.volume_features(prices(spark, d)).select("ticker", "date", "volume_change", "relative_volume"))


@query(f"""WITH {MARKET} SELECT ticker, round(CASE WHEN count(daily_return) FILTER (WHERE benchmark_return IS NOT NULL) < 30 THEN 1.0 ELSE covar_samp(daily_return, benchmark_return) / var_samp(benchmark_return) FILTER (WHERE daily_return IS NOT NULL) END, 6) AS beta,
  round(product(1 + coalesce(daily_return, 0)) - 1, 6) + 0.0 AS compound_return, round(coalesce(sum(daily_return - benchmark_return), 0), 6) + 0.0 AS car FROM m GROUP BY ticker""")
def beta_compound(spark, d):
    m = market(spark, d)
    return rounded(m.groupBy("ticker").agg(mk.beta().alias("beta"), mk.compound("daily_return").alias("compound_return"), F.coalesce(F.sum(F.col("daily_return") - F.col("benchmark_return")), F.lit(0.0)).alias("car")))


@query(f"""WITH {MARKET}, n AS (SELECT *, row_number() OVER ({_W}) AS i FROM m), t AS (SELECT ticker, min(i) AS i0 FROM n WHERE date >= DATE '1998-01-01' GROUP BY ticker)
SELECT n.ticker, date, i - i0 AS relative_day, round(close, 6) AS close FROM n JOIN t USING (ticker) WHERE i - i0 BETWEEN -5 AND 5""")
def event_slice(spark, d):
    return rounded(mk.event_slice(market(spark, d), "1998-01-01", 5, 5).select("ticker", "date", "relative_day", "close"))


@query("""WITH p AS (SELECT CAST(l_shipdate AS DATE) AS date, l_returnflag AS ticker, l_extendedprice AS x, l_quantity AS q FROM lineitem)
SELECT ticker, count(*) AS market_rows, min(date) AS first_date, max(date) AS last_date, round(avg(x), 4) AS mean_price, round(stddev_samp(x), 4) AS std_price, min(q) AS min_quantity, max(q) AS max_quantity FROM p GROUP BY ticker""")
def market_aggregate(spark, d):
    p = table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("date"), F.col("l_returnflag").alias("ticker"), F.col("l_extendedprice").alias("daily_return"), F.col("l_quantity").alias("volume"), F.col("l_quantity").alias("low"), F.col("l_quantity").alias("high"))
    out = mk.per_event_market(p, "ticker")
    return out.select("ticker", "market_rows", "first_date", "last_date", F.round("mean_return", 4).alias("mean_price"), F.round("std_return", 4).alias("std_price"), F.col("min_low").alias("min_quantity"), F.col("max_high").alias("max_quantity"))


_HORIZON = ["return_1d", "return_5d"]


@query(f"""WITH {MARKET}, f AS (SELECT lead(close, 1) OVER ({_W}) / close - 1 AS return_1d, lead(close, 5) OVER ({_W}) / close - 1 AS return_5d FROM px),
l AS (SELECT 'return_1d' AS metric, return_1d AS x FROM f UNION ALL SELECT 'return_5d', return_5d FROM f)
SELECT metric, count(x) AS n, count(*) - count(x) AS n_missing, round(avg(x), 6) + 0.0 AS mean, round(median(x), 6) + 0.0 AS median, round(stddev_samp(x), 6) AS std, round(min(x), 6) AS min, round(max(x), 6) AS max, round(count(*) FILTER (WHERE x > 0) / count(x), 6) AS pct_positive FROM l GROUP BY metric""")
def return_summary(spark, d):
    return rounded(mk.return_summary(mk.forward_returns(prices(spark, d), [1, 5]), _HORIZON))


def _windows(spark, d, pre=3, post=5):
    m = mk.abnormal_returns(market(spark, d))
    s = ev.number_sessions(m)
    w = ev.event_windows(ev.on_or_after(events(spark, d), s), s, pre, post)
    return w.join(m.select("ticker", "date", "daily_return", "benchmark_return", "abnormal_return"), ["ticker", "date"])


_WIN = f"""{MARKET}, {EVENTS}, o AS (SELECT unnest(range(-3, 6)) AS k),
w AS (SELECT al.transcript_id, al.ticker, al.event_date, o.k AS relative_day, s.date, m.daily_return, m.benchmark_return, m.daily_return - m.benchmark_return AS abnormal_return
 FROM al CROSS JOIN o JOIN s ON s.ticker = al.ticker AND s.session_no = al.session_no + o.k JOIN m ON m.ticker = al.ticker AND m.date = s.date)"""


@query(f"WITH {EVENTS} SELECT transcript_id, ticker, event_date, aligned_event_date, session_no FROM al")
def align_events(spark, d):
    s = ev.number_sessions(prices(spark, d))
    return rounded(ev.on_or_after(events(spark, d), s).select("transcript_id", "ticker", "event_date", "aligned_event_date", "session_no"))


@query(f"WITH {_WIN} SELECT transcript_id, ticker, date, relative_day, relative_day = 0 AS event_day_flag, count(*) OVER (PARTITION BY transcript_id) = 9 AS is_complete FROM w")
def event_windows(spark, d):
    m = prices(spark, d)
    s = ev.number_sessions(m)
    w = ev.event_windows(ev.on_or_after(events(spark, d), s), s, 3, 5)
    return rounded(w.select("transcript_id", "ticker", "date", "relative_day", "event_day_flag", "is_complete"))


_CAR = ", ".join(f"round(sum(abnormal_return) FILTER (WHERE relative_day BETWEEN 1 AND {h}), 6) + 0.0 AS car_{h}d" for h in (1, 3, 5))


@query(f"""WITH {_WIN} SELECT transcript_id, ticker, {_CAR}, count(*) FILTER (WHERE relative_day BETWEEN 1 AND 5) AS post_day_count,
 count(*) FILTER (WHERE relative_day BETWEEN 1 AND 5 AND abnormal_return IS NULL) AS nan_day_count,
 count(abnormal_return) FILTER (WHERE relative_day BETWEEN 1 AND 5) = 5 AS car_complete FROM w GROUP BY transcript_id, ticker""")
def event_car(spark, d):
    return rounded(ev.event_car(_windows(spark, d), [1, 3, 5]))


@query(f"""WITH {_WIN} SELECT transcript_id, ticker, round(sum(coalesce(abnormal_return, 0)) FILTER (WHERE relative_day BETWEEN -1 AND 3), 6) + 0.0 AS car_3d, count(*) FILTER (WHERE relative_day BETWEEN -1 AND 3) AS post_day_count,
 count(*) FILTER (WHERE relative_day BETWEEN -1 AND 3 AND abnormal_return IS NULL) AS nan_day_count, count(abnormal_return) FILTER (WHERE relative_day BETWEEN -1 AND 3) = 5 AS car_complete,
 coalesce(abs(sum(coalesce(abnormal_return, 0)) FILTER (WHERE relative_day BETWEEN -1 AND 3)) > 0.01, false) AS is_extreme FROM w GROUP BY transcript_id, ticker""")
def event_car_nan_policies(spark, d):
    return rounded(ev.event_car(_windows(spark, d), [3], start=-1, policy="zero", extreme=0.01))


@query(f"""WITH {_WIN}, g AS (SELECT *, dense_rank() OVER (PARTITION BY transcript_id ORDER BY date) AS k, abs(date_diff('day', event_date, date)) AS gap FROM w),
e AS (SELECT transcript_id, arg_min(k, (gap, k)) AS k0 FROM g GROUP BY transcript_id) SELECT transcript_id, date, k - k0 AS relative_rank FROM g JOIN e USING (transcript_id)""")
def relative_day_tag(spark, d):
    w = _windows(spark, d).select("transcript_id", "date", "event_date")
    return rounded(ev.relative_days(w).select("transcript_id", "date", F.col("relative_day").alias("relative_rank")))


@query(f"""WITH {_WIN} SELECT transcript_id, max(relative_day) - min(relative_day) + 1 = count(DISTINCT relative_day) AS continuous, count(*) FILTER (WHERE relative_day < 0) AS pre_days,
 count(*) FILTER (WHERE relative_day > 0) AS post_days, bool_or(relative_day = 0) AS has_event_day FROM w GROUP BY transcript_id""")
def window_continuity(spark, d):
    return rounded(ev.window_continuity(_windows(spark, d)))


@query(f"WITH {_WIN} SELECT transcript_id, 9 - count(DISTINCT relative_day) AS n_missing FROM w GROUP BY transcript_id")
def missing_sessions(spark, d):
    return ev.missing_sessions(_windows(spark, d), 3, 5).select("transcript_id", F.size("missing").cast("long").alias("n_missing"))


_FWD = ", ".join(f"product(1 + coalesce(daily_return, 0)) OVER f{h} - 1 AS stock_{h}d, CASE WHEN count(benchmark_return) OVER f{h} >= 1 THEN product(1 + coalesce(benchmark_return, 0)) OVER f{h} - 1 END AS benchmark_{h}d" for h in (1, 5))


@query(f"""WITH {MARKET}, k AS (SELECT ticker, date, {_FWD} FROM m WINDOW f1 AS ({_W} ROWS BETWEEN 1 FOLLOWING AND 1 FOLLOWING), f5 AS ({_W} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING))
SELECT ticker, date, {_r('stock_1d', 'benchmark_1d', 'stock_5d', 'benchmark_5d')}, round(stock_1d - benchmark_1d, 6) + 0.0 AS ar_1d, round(stock_5d - benchmark_5d, 6) + 0.0 AS ar_5d FROM k""")
def forward_compound_ar(spark, d):
    out = ev.forward_compound(market(spark, d), [1, 5])
    return rounded(out.select("ticker", "date", *[f"{p}_{h}d" for h in (1, 5) for p in ("stock", "benchmark", "ar")]))


_INC = ", ".join(f"CASE WHEN count(*) OVER f{h} = {h} THEN product(1 + coalesce(daily_return, 0)) OVER f{h} - 1 END AS r{h}, CASE WHEN count(*) OVER f{h} = {h} THEN product(1 + coalesce(benchmark_return, 0)) OVER f{h} - 1 END AS k{h}" for h in (1, 3, 5))


@query(f"""WITH {MARKET}, {EVENTS}, q AS (SELECT ticker, date, {_INC} FROM m WINDOW {", ".join(f"f{h} AS ({_W} ROWS BETWEEN CURRENT ROW AND {h - 1} FOLLOWING)" for h in (1, 3, 5))})
SELECT transcript_id, al.ticker, aligned_event_date, {", ".join(f"round(r{h}, 6) + 0.0 AS return_{h}d, round(r{h} - k{h}, 6) + 0.0 AS ar_{h}d" for h in (1, 3, 5))} FROM al JOIN q ON q.ticker = al.ticker AND q.date = al.aligned_event_date""")
def event_returns_inclusive(spark, d):
    out = ev.inclusive_returns(events(spark, d), market(spark, d), [1, 3, 5])
    return rounded(out.select("transcript_id", "ticker", "aligned_event_date", *[f"{p}_{h}d" for h in (1, 3, 5) for p in ("return", "ar")]))


@query(f"""WITH {MARKET}, {EVENTS}, x AS (SELECT transcript_id, unnest([event_date + k::INTEGER for k in range(1, 10) if isodow(event_date + k::INTEGER) < 6][1:5]) AS date FROM ev),
k AS (SELECT DISTINCT date FROM m WHERE benchmark_return IS NOT NULL), g AS (SELECT transcript_id, count(*) AS expected_days, count(k.date) AS covered_days FROM x LEFT JOIN k ON x.date = k.date GROUP BY transcript_id)
SELECT *, CASE WHEN covered_days = expected_days THEN 'full' WHEN covered_days > 0 THEN 'partial' ELSE 'uncovered' END AS coverage FROM g""")
def benchmark_coverage(spark, d):
    return ev.benchmark_coverage(events(spark, d), market(spark, d), 5)


_DAYS = "u AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem), a AS (SELECT unnest(generate_series(min(date), max(date), INTERVAL 1 DAY))::DATE AS date FROM u)"


@query(f"""WITH {_DAYS}, j AS (SELECT a.date, u.date AS s FROM a LEFT JOIN u ON a.date = u.date)
SELECT date, s IS NOT NULL AS is_session, max(s) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_session, min(s) OVER (ORDER BY date ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_session,
 min(s) OVER (ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS on_or_after FROM j""")
def next_session(spark, d):
    return cal.calendar_days(table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("date")).distinct())


@query(f"""WITH {_DAYS}, q AS (SELECT o_orderkey AS transcript_id, CAST(o_orderdate AS DATE) AS event_date FROM orders)
SELECT count(*) AS events, count(*) - count(event_date) AS null_dates, count(*) FILTER (WHERE event_date IS NOT NULL AND u.date IS NULL) AS off_calendar, count(transcript_id) - count(DISTINCT transcript_id) AS duplicate_ids FROM q LEFT JOIN u ON q.event_date = u.date""")
def validate_event_dates(spark, d):
    days = cal.calendar_days(table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("date")).distinct())
    return cal.validate_event_dates(events(spark, d), days)


@query("SELECT o_orderkey AS transcript_id, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN (CAST(o_orderdate AS DATE) + CASE isodow(o_orderdate) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END) ELSE CAST(o_orderdate AS DATE) END AS aligned FROM orders")
def align_by_timing(spark, d):
    o = table(spark, d, "orders")
    timing = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "after_market").otherwise("before_market")
    return o.select(F.col("o_orderkey").alias("transcript_id"), cal.align_by_timing(F.to_date("o_orderdate"), timing).alias("aligned"))


@query()
def market_feature_set(spark, d):
    return rounded(mk.feature_set(prices(spark, d), benchmark(spark, d)))

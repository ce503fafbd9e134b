"""Suites of checks over layers with planted faults, and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import events as ev
from ..operators import market as mk
from ..operators import models, reports, suites
from ..operators import sentiment as se
from .market_queries import _WIN, _windows
from .proxies import CHUNKS, EVENTS, MARKET, benchmark, chunks, events, market, prices
from .registry import query, rounded, table

Row = tuple[str, str, str]


def _issues(ctes: str, rows: list[Row]) -> str:
    """SQL of issue rows from (check, severity if any are found, SQL of the number found)."""
    return f"WITH {ctes} " + " UNION ALL ".join(f"""SELECT '{c}' AS "check", CASE WHEN n > 0 THEN '{s}' ELSE 'ok' END AS severity, n::BIGINT AS n FROM (SELECT ({sql}) AS n)""" for c, s, sql in rows)


def _rate(check: str, column: str, source: str, warn: float = 0.05, stop: float = 0.2) -> str:
    bad = f"count(*) FILTER (WHERE {column} IS NULL)"
    return f""" UNION ALL SELECT '{check}', CASE WHEN {bad} / count(*) >= {stop} THEN 'critical' WHEN {bad} / count(*) >= {warn} THEN 'warning' ELSE 'ok' END, {bad} FROM {source}"""


def _shown(df):
    return df.select("check", "severity", "n")


def _dups(source: str, *keys: str) -> str:
    k = ", ".join(keys)
    return f"SELECT coalesce(sum(k - 1), 0) FROM (SELECT count(*) AS k FROM {source} GROUP BY {k})"


_PX = f"{MARKET}, p0 AS (SELECT ticker, date, open, high, low, CASE WHEN day(date) = 9 THEN 0 ELSE close END AS close, CASE WHEN day(date) = 5 THEN NULL ELSE close END AS adj_close, CASE WHEN day(date) = 13 THEN -1 ELSE volume END AS volume FROM px), p AS (SELECT * FROM p0 UNION ALL SELECT * FROM p0 WHERE day(date) = 7)"


@query(_issues(_PX, [("not_empty", "critical", "SELECT (count(*) = 0)::INT FROM p"), ("required_columns", "critical", "SELECT 0"), ("null_keys", "critical", "SELECT count(*) FROM p WHERE ticker IS NULL OR date IS NULL"), ("duplicates", "critical", _dups("p", "ticker", "date")), ("close_positive", "critical", "SELECT count(*) FROM p WHERE close <= 0"),
 ("volume_not_negative", "critical", "SELECT count(*) FROM p WHERE volume < 0"), ("missing_values", "warning", "SELECT count(*) FROM p WHERE adj_close IS NULL"), ("group_size", "warning", "SELECT count(*) FROM (SELECT count(*) AS k FROM p GROUP BY ticker) WHERE k < 5")]))
def ohlcv_checks(spark, d):
    day = F.dayofmonth("date")
    p = prices(spark, d).withColumns({"close": F.when(day == 9, 0.0).otherwise(F.col("close")), "adj_close": F.when(day != 5, F.col("close")), "volume": F.when(day == 13, -1).otherwise(F.col("volume"))})
    return _shown(suites.ohlcv_suite(p.unionByName(p.filter(day == 7))))


_BX = f"{MARKET}, q0 AS (SELECT b.date, CASE WHEN day(b.date) = 3 THEN -1 ELSE bx.close END AS close, CASE WHEN day(b.date) = 4 THEN 1.5 ELSE br END AS benchmark_return FROM b JOIN bx ON b.date = bx.date), q AS (SELECT * FROM q0 UNION ALL SELECT * FROM q0 WHERE day(date) = 8)"


@query(_issues(_BX, [("not_empty", "critical", "SELECT (count(*) = 0)::INT FROM q"), ("required_columns", "critical", "SELECT 0"), ("null_keys", "critical", "SELECT count(*) FROM q WHERE date IS NULL"), ("duplicates", "critical", _dups("q", "date")), ("close_positive", "critical", "SELECT count(*) FROM q WHERE close <= 0"), ("return_below_1", "critical", "SELECT count(*) FROM q WHERE abs(benchmark_return) >= 1")]))
def benchmark_checks(spark, d):
    day = F.dayofmonth("date")
    b = benchmark(spark, d)
    li = table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("date")).distinct().select("date", F.when(F.dayofmonth("date") == 3, -1.0).otherwise(100.0).alias("close"))
    b = b.select("date", F.when(day == 4, 1.5).otherwise(F.col("benchmark_return")).alias("benchmark_return")).join(li, "date")
    return _shown(suites.benchmark_suite(b.unionByName(b.filter(day == 8))))


_CARS = f"{_WIN}, c0 AS (SELECT transcript_id, CASE WHEN transcript_id % 97 = 0 THEN NULL ELSE ticker END AS ticker, CASE WHEN transcript_id % 10 = 0 THEN 0.9 WHEN transcript_id % 4 <> 0 THEN sum(abnormal_return) FILTER (WHERE relative_day BETWEEN 1 AND 5) END AS car_5d, count(abnormal_return) FILTER (WHERE relative_day BETWEEN 1 AND 5) = 5 AS car_complete FROM w GROUP BY transcript_id, w.ticker), c AS (SELECT * FROM c0 UNION ALL SELECT * FROM c0 WHERE transcript_id % 50 = 1)"
_OVER = lambda check, cond, share, source: f""" UNION ALL SELECT '{check}', CASE WHEN count(*) FILTER (WHERE {cond}) / count(*) > {share} THEN 'critical' WHEN count(*) FILTER (WHERE {cond}) > 0 THEN 'warning' ELSE 'ok' END, count(*) FILTER (WHERE {cond}) FROM {source}"""


@query(_issues(_CARS, [("not_empty", "critical", "SELECT (count(*) = 0)::INT FROM c"), ("duplicates", "critical", _dups("c", "transcript_id")), ("null_keys", "critical", "SELECT count(*) FROM c WHERE ticker IS NULL"), ("type:car_complete", "warning", "SELECT 0")]) + _OVER("extreme:car_5d", "abs(car_5d) > 0.5", 0.02, "c") + _OVER("car_complete", "NOT car_complete", 0.2, "c") + _rate("null_rate:car_5d", "car_5d", "c"))
def car_checks(spark, d):
    k = F.col("transcript_id")
    c = ev.event_car(_windows(spark, d), [5]).select("transcript_id", F.when(k % 97 != 0, F.col("ticker")).alias("ticker"), F.when(k % 10 == 0, 0.9).when(k % 4 != 0, F.col("car_5d")).alias("car_5d"), "car_complete")
    return _shown(suites.car_suite(c.unionByName(c.filter(k % 50 == 1))))


_MG = "m0 AS (SELECT o_orderkey AS transcript_id, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE (o_custkey % 21) / 10.0 - 1 END AS sentiment_score, CASE WHEN o_orderkey % 13 = 0 THEN 1.5 ELSE 0.5 END AS tone_score, CASE o_orderkey % 7 WHEN 0 THEN 'good' WHEN 1 THEN 'negative' ELSE 'positive' END AS sentiment_label FROM orders)"


@query(_issues(_MG, [("not_empty", "critical", "SELECT (count(*) = 0)::INT FROM m0"), ("duplicates", "critical", _dups("m0", "transcript_id")), ("null_keys", "critical", "SELECT count(*) FROM m0 WHERE sentiment_score IS NULL"), ("domain:sentiment_label", "critical", "SELECT count(*) FROM m0 WHERE sentiment_label = 'good'"), ("range:sentiment_score", "critical", "SELECT count(*) FROM m0 WHERE abs(sentiment_score) > 1"), ("range:tone_score", "critical", "SELECT count(*) FROM m0 WHERE tone_score > 1")])
 + _rate("null_rate:sentiment_score", "sentiment_score", "m0") + _rate("null_rate:tone_score", "tone_score", "m0") + _rate("null_rate:sentiment_label", "sentiment_label", "m0"))
def merge_checks(spark, d):
    k = F.col("o_orderkey")
    m = table(spark, d, "orders").select(k.alias("transcript_id"), F.when(k % 11 != 0, F.pmod("o_custkey", F.lit(21)) / 10.0 - 1).alias("sentiment_score"), F.when(k % 13 == 0, 1.5).otherwise(0.5).alias("tone_score"), F.when(k % 7 == 0, "good").when(k % 7 == 1, "negative").otherwise("positive").alias("sentiment_label"))
    return _shown(suites.merge_suite(m))


_CH = f"{CHUNKS}, k0 AS (SELECT transcript_id, chunk_id, chunk_order, CASE WHEN chunk_id % 50 = 0 THEN 600 WHEN chunk_id % 51 = 0 THEN 0 ELSE token_count END AS token_count, CASE WHEN chunk_id % 40 = 0 THEN NULL ELSE speaker END AS speaker, CASE WHEN chunk_id % 70 = 0 THEN -0.1 ELSE positive_prob END AS positive_prob, neutral_prob, negative_prob, sentiment_score FROM c WHERE chunk_order <> 2 OR transcript_id % 3 <> 0), k AS (SELECT * FROM k0 UNION ALL SELECT * FROM k0 WHERE chunk_id % 90 = 0)"


@query(_issues(_CH, [("not_empty", "critical", "SELECT (count(*) = 0)::INT FROM k"), ("null_keys", "critical", "SELECT count(*) FROM k WHERE chunk_id IS NULL OR transcript_id IS NULL"), ("duplicates", "critical", _dups("k", "chunk_id")), ("ordering:chunk_order", "warning", "SELECT count(*) FROM (SELECT count(*) AS n, count(DISTINCT chunk_order) AS u, max(chunk_order) - min(chunk_order) + 1 AS w FROM k GROUP BY transcript_id) WHERE n <> u OR w <> u"),
 ("token_limit", "warning", "SELECT count(*) FROM k WHERE token_count > 512"), ("token_count", "critical", "SELECT count(*) FROM k WHERE token_count < 1"), *[(f"range:{p}", "critical", f"SELECT count(*) FROM k WHERE {p} < 0 OR {p} > 1") for p in suites.PROBS], ("range:sentiment_score", "critical", "SELECT count(*) FROM k WHERE abs(sentiment_score) > 1")]) + _rate("null_rate:speaker", "speaker", "k"))
def chunk_checks(spark, d):
    i = F.col("chunk_id")
    k = chunks(spark, d).filter((F.col("chunk_order") != 2) | (F.col("transcript_id") % 3 != 0)).select("transcript_id", "chunk_id", "chunk_order", F.when(i % 50 == 0, 600).when(i % 51 == 0, 0).otherwise(F.col("token_count")).alias("token_count"), F.when(i % 40 != 0, F.col("speaker")).alias("speaker"), F.when(i % 70 == 0, -0.1).otherwise(F.col("positive_prob")).alias("positive_prob"), "neutral_prob", "negative_prob", "sentiment_score")
    return _shown(suites.chunk_suite(k.unionByName(k.filter(i % 90 == 0))))


_HI = f"{CHUNKS}, t0 AS (SELECT transcript_id, count(*) + CASE WHEN transcript_id % 5 = 0 THEN 1 ELSE 0 END AS chunk_count, avg(sentiment_score) + CASE WHEN transcript_id % 6 = 0 THEN 0.1 ELSE 0 END AS mean_sentiment FROM c WHERE transcript_id % 9 <> 0 GROUP BY transcript_id), g AS (SELECT transcript_id, count(*) AS n, avg(sentiment_score) AS m FROM c GROUP BY 1)"


@query(_issues(_HI, [("not_empty", "critical", "SELECT (count(*) = 0)::INT FROM t0"), ("duplicates", "critical", _dups("t0", "transcript_id")), ("orphans", "critical", "SELECT count(*) FROM g WHERE transcript_id % 9 = 0"), ("counts_follow", "critical", "SELECT count(*) FROM t0 WHERE transcript_id % 5 = 0"), ("means_follow", "warning", "SELECT count(*) FROM t0 WHERE transcript_id % 6 = 0")]))
def hierarchy_checks(spark, d):
    c, t = chunks(spark, d), F.col("transcript_id")
    coarse = c.filter(t % 9 != 0).groupBy("transcript_id").agg((F.count("*") + F.when(t % 5 == 0, 1).otherwise(0)).alias("chunk_count"), (F.avg("sentiment_score") + F.when(t % 6 == 0, 0.1).otherwise(0.0)).alias("mean_sentiment"))
    return _shown(suites.hierarchy_suite(c, coarse, ["transcript_id"], "sentiment_score", "mean_sentiment", "chunk_count"))


@query(f"""WITH {CHUNKS}, z AS (SELECT *, lag(sentiment_score) OVER (PARTITION BY transcript_id ORDER BY chunk_order) IS NULL OR chunk_id % 30 = 0 AS missing FROM c) SELECT 'shift:sentiment_shift' AS "check", CASE WHEN count(*) FILTER (WHERE (chunk_order = 1) <> missing) > 0 THEN 'critical' ELSE 'ok' END AS severity, count(*) FILTER (WHERE (chunk_order = 1) <> missing) AS n FROM z""")
def shift_checks(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("transcript_id").orderBy("chunk_order")
    c = chunks(spark, d).withColumn("sentiment_shift", F.when(F.col("chunk_id") % 30 != 0, F.col("sentiment_score") - F.lag("sentiment_score").over(w)))
    return _shown(suites.shift_continuity(c, "transcript_id", "chunk_order"))


_GAP = "date_diff('day', event_date, aligned_event_date)"


@query(_issues(f"{EVENTS}, x AS (SELECT transcript_id, event_date, CASE WHEN transcript_id % 17 = 0 THEN event_date - 1 ELSE aligned_event_date END AS aligned_event_date FROM al)", [("not_empty", "critical", "SELECT (count(*) = 0)::INT FROM x"), ("duplicates", "critical", _dups("x", "transcript_id")), ("not_before_event", "critical", f"SELECT count(*) FROM x WHERE {_GAP} < 0"), ("near_event", "warning", f"SELECT count(*) FROM x WHERE {_GAP} > 7"),
 ("weekend:aligned_event_date", "warning", "SELECT count(*) FROM x WHERE isodow(aligned_event_date) > 5")]) + _rate("null_rate:aligned_event_date", "aligned_event_date", "x"))
def alignment_checks(spark, d):
    a = ev.on_or_after(events(spark, d), ev.number_sessions(prices(spark, d)))
    a = a.withColumn("aligned_event_date", F.when(F.col("transcript_id") % 17 == 0, F.date_sub("event_date", 1)).otherwise(F.col("aligned_event_date")))
    return _shown(suites.alignment_suite(a))


@query("SELECT '[WARNING] segments/long_text: ' || count(*) AS line FROM conversations WHERE length(text) > 200")
def report_lines(spark, d):
    from ..operators import quality as dq

    c = table(spark, d, "conversations")
    return suites.report_lines(dq.suite(dq.failing(c, F.length("text") > 200, "segments", "long_text"), dq.failing(c, F.col("conv_id") < 0, "segments", "negative_id")))


@query(f"""WITH {CHUNKS}, h AS (SELECT *, count(*) OVER (PARTITION BY transcript_id) AS n FROM c)
SELECT transcript_id, count(*) AS chunks, round(avg(sentiment_score), 6) + 0.0 AS mean_score, round(median(sentiment_score), 6) + 0.0 AS median_score, round(coalesce(stddev_samp(sentiment_score), 0), 6) AS std_score, round(min(sentiment_score), 6) + 0.0 AS min_score, round(max(sentiment_score), 6) + 0.0 AS max_score, round(avg((sentiment_score > 0.05)::INT), 6) AS positive_share,
 round(avg((sentiment_score < -0.05)::INT), 6) AS negative_share, round(arg_min(sentiment_score, chunk_order), 6) + 0.0 AS first_score, round(arg_max(sentiment_score, chunk_order), 6) + 0.0 AS last_score, round(avg(sentiment_score) FILTER (WHERE chunk_order <= n / 2) - avg(sentiment_score) FILTER (WHERE chunk_order > n / 2), 6) + 0.0 AS optimism_decay FROM h GROUP BY transcript_id""")
def transcript_analytics(spark, d):
    return rounded(reports.transcript_analytics(chunks(spark, d)))


@query(f"""WITH {MARKET} SELECT date, {", ".join(f'round(max(daily_return) FILTER (WHERE ticker = {t!r}), 6) + 0.0 AS "{t}"' for t in "ANR")} FROM r GROUP BY date HAVING count(daily_return) > 0""")
def wide_returns(spark, d):
    return rounded(reports.wide_returns(mk.daily_returns(prices(spark, d)), ["A", "N", "R"]))


@query(f"WITH {MARKET}, x AS (SELECT ticker, date, daily_return - benchmark_return AS a FROM m) SELECT ticker, date, round(a, 6) + 0.0 AS abnormal_return, round(sum(coalesce(a, 0)) OVER (PARTITION BY ticker ORDER BY date), 6) + 0.0 AS cumulative FROM x")
def return_timeline(spark, d):
    return rounded(reports.return_timeline(mk.abnormal_returns(market(spark, d))))


@query("SELECT CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS status, count(*) AS n FROM orders GROUP BY 1")
def status_counts(spark, d):
    return reports.status_counts(table(spark, d, "orders").select(F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("status")))


@query(f"WITH {_WIN}, g AS (SELECT count(*) AS k FROM w GROUP BY transcript_id) SELECT count(*) AS events, sum(k)::BIGINT AS rows, count(*) FILTER (WHERE k = 9) AS complete, count(*) FILTER (WHERE k <> 9) AS partial, round(avg(k), 6) AS mean_rows FROM g")
def window_summary(spark, d):
    return rounded(reports.window_summary(_windows(spark, d), 3, 5))


@query(f"WITH {MARKET} SELECT count(*) AS rows, count(DISTINCT ticker) AS groups, min(date) AS first_day, max(date) AS last_day, count(*) - count(daily_return) AS missing, round(avg(daily_return), 6) + 0.0 AS mean_value, round(stddev_samp(daily_return), 6) AS std_value FROM r")
def dataset_statistics(spark, d):
    return rounded(reports.dataset_statistics(mk.daily_returns(prices(spark, d))))


@query(" UNION ALL ".join(f"""SELECT '{c}' AS "column", count({c}) AS n, count(*) - count({c}) AS missing, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max FROM lineitem""" for c in ("l_quantity", "l_discount", "l_tax")))
def statistical_summary(spark, d):
    return rounded(reports.statistical_summary(table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"]), digits=4)


@query("WITH g AS (SELECT n_nationkey AS \"group\", count(s_acctbal) AS n, coalesce(stddev_samp(s_acctbal), 0) AS sd FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1) SELECT \"group\", n, CASE WHEN n < 5 THEN 'too_few_values' ELSE 'no_variance' END AS warning FROM g WHERE n < 5 OR sd = 0")
def t_test_warnings(spark, d):
    both = table(spark, d, "nation").join(table(spark, d, "supplier"), F.col("n_nationkey") == F.col("s_nationkey"), "left")
    return reports.t_test_warnings(both, "n_nationkey", "s_acctbal")


@query("SELECT 'ship' AS stage, (SELECT count(*) FROM orders) AS rows_in, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS rows_out, (SELECT count(*) FROM orders WHERE o_orderstatus <> 'F') AS dropped, (SELECT round(avg((o_orderstatus = 'F')::INT), 6) FROM orders) AS kept_share")
def stage_metrics(spark, d):
    o = table(spark, d, "orders")
    return rounded(reports.stage_metrics([("ship", o, o.filter("o_orderstatus = 'F'"))]))


@query("SELECT o_orderpriority, count(*) AS n, true AS near FROM orders GROUP BY 1")
def stratified_split(spark, d):
    s = models.stratified_split(table(spark, d, "orders"), "o_orderkey", "o_orderpriority", 0.3).groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_if("is_test").alias("t"))
    return s.select("o_orderpriority", "n", (F.abs(F.col("t") - 0.3 * F.col("n")) <= 1 + 0.01 * F.col("n")).alias("near"))


@query(r"""WITH p AS (SELECT doc_id, length(trim(coalesce(text, ''))) >= 3 AS ok, (length(coalesce(text, '')) % 7) / 10 AS p FROM documents)
SELECT doc_id, round(CASE WHEN ok THEN p ELSE 0 END, 8)::DOUBLE AS positive_prob, round(CASE WHEN ok THEN 0.2 ELSE 1 END, 8)::DOUBLE AS neutral_prob, round(CASE WHEN ok THEN 0.8 - p ELSE 0 END, 8)::DOUBLE AS negative_prob, round(CASE WHEN ok THEN 2 * p - 0.8 ELSE 0 END, 8)::DOUBLE + 0.0 AS sentiment_score,
 round(CASE WHEN ok THEN greatest(p, 0.2, 0.8 - p) ELSE 0 END, 8)::DOUBLE AS confidence, NOT ok AS was_skipped FROM p""")
def pluggable_scores(spark, d):
    def load():
        return lambda texts: [((len(t) % 7) / 10, 0.2, 0.8 - (len(t) % 7) / 10) for t in texts]

    return rounded(models.score_with_model(table(spark, d, "documents"), "doc_id", "text", load).drop("predicted_label"))

"""The driver's tables seen as the engine's layers, in Spark and as SQL of the same meaning.

Daily prices are those of line items by return flag; orders are events; the
event stream is a sequence of scored chunks by user; documents are transcripts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import market as mk
from .registry import table


_CENTS = "cast(round(l_extendedprice * 100) as bigint) as cents"


def prices(spark: SparkSession, d: str) -> DataFrame:
    """(ticker, date, open, high, low, close, adj_close, volume)."""
    li = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("ticker"), F.to_date("l_shipdate").alias("date"), F.expr(_CENTS), "l_quantity")
    damp = lambda x: 100 + x / 99700.0
    p = F.col("cents")  # whole numbers have the same sum in any order
    out = li.groupBy("ticker", "date").agg(damp((F.min(p) + F.max(p)) / 2).alias("open"), damp(F.max(p)).alias("high"), damp(F.min(p)).alias("low"), damp(F.sum(p) / F.count(p)).alias("close"), F.sum("l_quantity").alias("volume"))
    return out.withColumn("adj_close", F.col("close"))


def benchmark(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("date"), F.expr(_CENTS))
    return mk.benchmark_returns(li.groupBy("date").agg((100 + F.sum("cents") / F.count("cents") / 99700.0).alias("close")))


def market(spark: SparkSession, d: str) -> DataFrame:
    """Prices with daily and benchmark returns."""
    return mk.join_benchmark(mk.daily_returns(prices(spark, d)), benchmark(spark, d))


def events(spark: SparkSession, d: str) -> DataFrame:
    """(transcript_id, ticker, event_date) of every order."""
    status = F.col("o_orderstatus")
    ticker = F.when(status == "F", "A").when(status == "O", "N").otherwise("R")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("transcript_id"), ticker.alias("ticker"), F.to_date("o_orderdate").alias("event_date"))


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """Scored chunks: (transcript_id, chunk_id, chunk_order, section_type, speaker, speaker_role, score, probabilities, confidence, token_count)."""
    e = table(spark, d, "events")
    v = F.floor(F.col("value") * 100).cast("long")
    score = (F.pmod(v * 37 + F.col("event_id") * 11, F.lit(2001)) - 1000) / 1003.0
    out = e.select(
        F.col("user_id").alias("transcript_id"), F.col("event_id").alias("chunk_id"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("chunk_order"),
        F.when(F.pmod("event_id", F.lit(3)) == 0, "qa").otherwise("prepared").alias("section_type"), F.col("event_type").alias("speaker"),
        F.when(F.pmod("event_id", F.lit(4)) == 0, "analyst").otherwise("executive").alias("speaker_role"), score.alias("sentiment_score"),
        ((F.pmod("event_id", F.lit(97)) + 3) / 101.0).alias("confidence"), (F.pmod("event_id", F.lit(120)) + 5).alias("token_count"),
    )
    return out.withColumns({"positive_prob": (1 + F.col("sentiment_score")) * 0.4, "negative_prob": (1 - F.col("sentiment_score")) * 0.4, "neutral_prob": F.lit(0.2)})


def clip_sql(x: str, low: float = -0.99, high: float = 0.99) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN greatest(least({x}, {high}), {low}) END"


#: Common table expressions: px, b, r (returns), m (market).
MARKET = f"""
li AS (SELECT l_returnflag AS ticker, CAST(l_shipdate AS DATE) AS date, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, l_quantity FROM lineitem),
px AS (SELECT ticker, date, 100 + (min(cents) + max(cents)) / 2 / 99700.0::DOUBLE AS open, 100 + max(cents) / 99700.0::DOUBLE AS high,
  100 + min(cents) / 99700.0::DOUBLE AS low, 100 + sum(cents)::DOUBLE / count(*) / 99700.0::DOUBLE AS close, sum(l_quantity) AS volume FROM li GROUP BY 1, 2),
bx AS (SELECT date, 100 + sum(cents)::DOUBLE / count(*) / 99700.0::DOUBLE AS close FROM li GROUP BY 1),
b AS (SELECT date, close / lag(close) OVER (ORDER BY date) - 1 AS br FROM bx),
r0 AS (SELECT *, close AS adj_close, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS dr FROM px),
r AS (SELECT * EXCLUDE (dr), {clip_sql('dr')} AS daily_return FROM r0),
m0 AS (SELECT r.*, b.br, lag(b.br) OVER (PARTITION BY ticker ORDER BY r.date) AS pb FROM r LEFT JOIN b ON r.date = b.date),
m AS (SELECT * EXCLUDE (br, pb), {clip_sql('coalesce(br, pb)')} AS benchmark_return FROM m0)
"""

#: ev (events), s (numbered sessions), al (events with the session on or after).
EVENTS = """
ev AS (SELECT o_orderkey AS transcript_id, CASE o_orderstatus WHEN 'F' THEN 'A' WHEN 'O' THEN 'N' ELSE 'R' END AS ticker, CAST(o_orderdate AS DATE) AS event_date FROM orders),
s AS (SELECT ticker, date, row_number() OVER (PARTITION BY ticker ORDER BY date) AS session_no FROM (SELECT DISTINCT l_returnflag AS ticker, CAST(l_shipdate AS DATE) AS date FROM lineitem)),
al AS (SELECT ev.*, s.date AS aligned_event_date, s.session_no FROM ev ASOF LEFT JOIN s ON ev.ticker = s.ticker AND ev.event_date <= s.date)
"""

CHUNKS = """
c0 AS (SELECT user_id AS transcript_id, event_id AS chunk_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS chunk_order,
  CASE WHEN event_id % 3 = 0 THEN 'qa' ELSE 'prepared' END AS section_type, event_type AS speaker,
  CASE WHEN event_id % 4 = 0 THEN 'analyst' ELSE 'executive' END AS speaker_role,
  (((floor(value * 100)::BIGINT * 37 + event_id * 11) % 2001 + 2001) % 2001 - 1000) / 1003.0::DOUBLE AS sentiment_score,
  (event_id % 97 + 3) / 101.0::DOUBLE AS confidence, event_id % 120 + 5 AS token_count FROM events),
c AS (SELECT *, (1 + sentiment_score) * 0.4 AS positive_prob, (1 - sentiment_score) * 0.4 AS negative_prob, 0.2::DOUBLE AS neutral_prob FROM c0)
"""

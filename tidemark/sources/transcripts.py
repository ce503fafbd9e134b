"""Transcripts and prices as they come in: names, types, ids and windows of days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import word_count

#: Names of columns that mean the same.
ALIASES = {"symbol": "ticker", "date": "earnings_date", "transcript": "transcript_text", "content": "transcript_text", "text": "transcript_text", "company_name": "company"}


def transcript_id(ticker: Column, date: Column) -> Column:
    """TICKER_YYYYMMDD, with UNKNOWN for a missing date."""
    return F.concat_ws("_", F.upper(ticker), F.coalesce(F.date_format(date, "yyyyMMdd"), F.lit("UNKNOWN")))


def normalise(df: DataFrame, source: str, aliases: dict[str, str] = ALIASES) -> DataFrame:
    """Known names, a date or null, words counted, source and id."""
    have = set(df.columns)
    out = df.withColumnsRenamed({a: b for a, b in aliases.items() if a in have and b not in have})
    for c in ("ticker", "earnings_date", "transcript_text"):
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast("string"))
    out = out.withColumn("earnings_date", F.to_date(F.col("earnings_date").cast("string").try_cast("timestamp")))
    return out.withColumns({"word_count": word_count("transcript_text"), "source": F.lit(source), "transcript_id": transcript_id(F.col("ticker"), F.col("earnings_date"))})


def of_tickers(df: DataFrame, tickers: list[str], ticker: str = "ticker") -> DataFrame:
    return df.filter(F.upper(ticker).isin([t.upper() for t in tickers]))


def around_events(prices: DataFrame, events: DataFrame, before: int, after: int) -> DataFrame:
    """Rows of a ticker from ``before`` days before to ``after`` days after an event: days are exploded, not compared."""
    days = events.select("transcript_id", "ticker", "event_date", F.explode(F.sequence(F.date_sub("event_date", before), F.date_add("event_date", after))).alias("date"))
    return days.join(prices, ["ticker", "date"])


def across_events(benchmark: DataFrame, events: DataFrame, before: int = 30, after: int = 30) -> DataFrame:
    """The benchmark's rows within the range of all events."""
    span = events.agg(F.date_sub(F.min("event_date"), before).alias("__a"), F.date_add(F.max("event_date"), after).alias("__b"))
    return benchmark.join(F.broadcast(span), F.col("date").between(F.col("__a"), F.col("__b"))).drop("__a", "__b")

"""Trading sessions by rule, and the alignment of instants to them."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _nth(year: int, month: int, weekday: int, n: int) -> dt.date:
    """The n-th (from the end if negative) such weekday of a month."""
    if n > 0:
        first = dt.date(year, month, 1)
        return first + dt.timedelta(days=(weekday - first.weekday()) % 7 + 7 * (n - 1))
    last = dt.date(year + month // 12, month % 12 + 1, 1) - dt.timedelta(days=1)
    return last - dt.timedelta(days=(last.weekday() - weekday) % 7)


def _easter(year: int) -> dt.date:
    """Gregorian, by the anonymous computus."""
    a, b, c = year % 19, year // 100, year % 100
    h = (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30
    k = (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7
    m = (a + 11 * h + 22 * k) // 451
    month, day = divmod(h + k - 7 * m + 114, 31)
    return dt.date(year, month, day + 1)


def us_market_holidays(year: int) -> set[dt.date]:
    """Full-day closings of US stock markets by today's rules; a Saturday's is kept on Friday, a Sunday's on Monday."""
    fixed = [dt.date(year, 7, 4), dt.date(year, 12, 25), *([dt.date(year, 6, 19)] if year >= 2022 else [])]
    moved = {d - dt.timedelta(days=1) if d.weekday() == 5 else d + dt.timedelta(days=1) if d.weekday() == 6 else d for d in fixed}
    new_year = dt.date(year, 1, 1)
    moved |= {new_year + dt.timedelta(days=1)} if new_year.weekday() == 6 else {new_year} if new_year.weekday() < 5 else set()
    return moved | {_nth(year, 1, 0, 3), _nth(year, 2, 0, 3), _easter(year) - dt.timedelta(days=2), _nth(year, 5, 0, -1), _nth(year, 9, 0, 1), _nth(year, 11, 3, 4)}


def sessions(spark: SparkSession, first: str, last: str, holidays: bool = True, zone: str = "America/New_York", opens: str = "09:30:00", closes: str = "16:00:00") -> DataFrame:
    """(date, session_no, open_utc, close_utc): weekdays, less the holidays of those years."""
    days = spark.sql(f"SELECT explode(sequence(DATE'{first}', DATE'{last}')) AS date").filter(F.weekday("date") < 5)
    if holidays:
        off = sorted(d for y in range(int(first[:4]), int(last[:4]) + 1) for d in us_market_holidays(y))
        days = days.filter(~F.col("date").isin(off)) if off else days
    at = lambda t: F.to_utc_timestamp(F.concat_ws(" ", F.col("date").cast("string"), F.lit(t)).cast("timestamp"), zone)
    return days.select("date", F.row_number().over(Window.orderBy("date")).alias("session_no"), at(opens).alias("open_utc"), at(closes).alias("close_utc"))


def calendar_days(session_dim: DataFrame) -> DataFrame:
    """A row for each calendar day: whether it is a session, and the sessions before, on or after, and after it."""
    ends = session_dim.agg(F.min("date").alias("a"), F.max("date").alias("b"))
    days = ends.select(F.explode(F.sequence("a", "b")).alias("date"))
    both = days.join(session_dim.select("date", F.col("date").alias("s")), "date", "left")
    back, ahead = (Window.orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in ("date", F.col("date").desc()))
    out = both.select("date", F.col("s").isNotNull().alias("is_session"), F.last("s", True).over(back).alias("prev_session"), F.last("s", True).over(ahead).alias("next_session"))
    return out.withColumn("on_or_after", F.when(F.col("is_session"), F.col("date")).otherwise(F.col("next_session")))


def align_instants(events: DataFrame, days: DataFrame, session_dim: DataFrame, instant: str = "event_ts", date_only: str | Column = "date_only") -> DataFrame:
    """``aligned_event_date``: the day itself up to its close, else the next session; dates without a time take the next one."""
    only = F.col(date_only) if isinstance(date_only, str) else date_only
    out = events.withColumn("__d", F.to_date(instant)).join(days.withColumnRenamed("date", "__d"), "__d", "left")
    out = out.join(session_dim.select(F.col("date").alias("__d"), "close_utc"), "__d", "left")
    same = F.col("is_session") & ~only & (F.col(instant) <= F.col("close_utc"))
    aligned = F.when(same, F.col("__d")).otherwise(F.col("next_session"))
    return out.withColumn("aligned_event_date", aligned).drop("__d", "is_session", "prev_session", "next_session", "on_or_after", "close_utc")


def next_weekday(date: Column) -> Column:
    return F.date_add(date, F.when(F.weekday(date) == 4, 3).when(F.weekday(date) == 5, 2).otherwise(1))


def align_by_timing(date: Column, timing: Column) -> Column:
    """Reports after the market count for the next weekday, others for the day itself."""
    return F.when(F.lower(timing).isin("after_market", "amc", "after"), next_weekday(date)).otherwise(date)


def weekday_sessions(spark: SparkSession, first: str, last: str) -> DataFrame:
    return sessions(spark, first, last, holidays=False).select("date", "session_no")


def validate_event_dates(events: DataFrame, days: DataFrame, date: str = "event_date", key: str = "transcript_id") -> DataFrame:
    """One row of counts: events, null dates, dates off the calendar, ids that repeat."""
    e = events.join(days.select(F.col("date").alias(date), "is_session"), date, "left")
    return e.agg(
        F.count("*").alias("events"), F.count_if(F.col(date).isNull()).alias("null_dates"),
        F.count_if(F.col(date).isNotNull() & ~F.coalesce("is_session", F.lit(False))).alias("off_calendar"), (F.count(key) - F.count_distinct(key)).alias("duplicate_ids"),
    )

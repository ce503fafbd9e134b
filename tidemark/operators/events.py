"""Events on a session calendar: alignment, windows by position, abnormal returns over them.

The relation "k sessions from the event" is rewritten as an equi-join: sessions
are numbered, an event gets the number of its session, and offsets are exploded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import finite

WINDOW_KEY = ["ticker", "session_no"]


def number_sessions(market: DataFrame, by_ticker: bool = True) -> DataFrame:
    """Distinct (ticker, date) with ``session_no`` from 1; without tickers, one calendar."""
    keys = ["ticker", "date"] if by_ticker else ["date"]
    w = Window.partitionBy("ticker").orderBy("date") if by_ticker else Window.orderBy("date")
    return market.select(*keys).distinct().withColumn("session_no", F.row_number().over(w))


def on_or_after(events: DataFrame, sessions: DataFrame, date: str = "event_date") -> DataFrame:
    """Adds the first session on or after the event, ``aligned_event_date`` and ``session_no``; null past the last one.

    Each session stands for the days since the one before, so the event's day
    finds its session by an equi-join, which the planner can broadcast or split
    where one ticker has most events.  Days before the first session count as it.
    """
    before = F.lag("date").over(Window.partitionBy("ticker").orderBy("date"))
    days = F.sequence(F.coalesce(F.date_add(before, 1), F.col("date")), F.col("date"))
    by_day = sessions.select("ticker", F.col("date").alias("aligned_event_date"), "session_no", days.alias("__days")).withColumn("__day", F.explode("__days")).drop("__days")
    first = sessions.groupBy("ticker").agg(F.min("date").alias("__first"))
    at = F.date_add(F.to_date(date), (F.col(date) > F.to_date(date)).cast("int"))  # a time of day is past its day's session
    e = events.drop("aligned_event_date", "session_no").join(first, "ticker", "left").withColumn("__day", F.when(at.isNotNull(), F.greatest(at, F.col("__first"))))
    return e.join(by_day, ["ticker", "__day"], "left").select(*[F.col(c) for c in e.columns if c not in ("__day", "__first")], "aligned_event_date", "session_no")


def event_windows(events: DataFrame, sessions: DataFrame, pre: int, post: int) -> DataFrame:
    """A row for each event and session from ``pre`` before to ``post`` after, with ``relative_day`` and ``event_day_flag``.

    ``events`` has ``session_no`` (see ``on_or_after``).  Sessions that the calendar
    doesn't have are left out; ``is_complete`` tells whether all are there.
    """
    wide = events.filter(F.col("session_no").isNotNull()).withColumn("relative_day", F.explode(F.sequence(F.lit(-pre), F.lit(post)))).withColumn("session_no", F.col("session_no") + F.col("relative_day"))
    out = wide.join(sessions, WINDOW_KEY).withColumn("event_day_flag", F.col("relative_day") == 0)
    return out.withColumn("is_complete", F.count("*").over(Window.partitionBy("transcript_id")) == pre + post + 1)


def relative_days(df: DataFrame, group: str = "transcript_id", date: str = "date", event_date: str = "event_date") -> DataFrame:
    """Position of a row's day less that of the event's day, or of the nearest day (the earlier one of two)."""
    w = Window.partitionBy(group)
    out = df.withColumn("__r", F.dense_rank().over(w.orderBy(date)))
    gap = F.abs(F.datediff(F.col(date), F.col(event_date)))
    return out.withColumn("__e", F.min(F.struct(gap.alias("g"), F.col("__r").alias("r"))).over(w)).withColumn("relative_day", F.col("__r") - F.col("__e.r")).drop("__r", "__e")


def relative_days_or_calendar(df: DataFrame, group: str = "transcript_id", date: str = "date", event_date: str = "event_date") -> DataFrame:
    """By position where the event's day is in the group, else by calendar days."""
    w = Window.partitionBy(group)
    out = df.withColumn("__r", F.dense_rank().over(w.orderBy(date)))
    at = F.max(F.when(F.col(date) == F.col(event_date), F.col("__r"))).over(w)
    return out.withColumn("relative_day", F.when(at.isNotNull(), F.col("__r") - at).otherwise(F.datediff(F.col(date), F.col(event_date)))).drop("__r")


def missing_sessions(windows: DataFrame, pre: int, post: int) -> DataFrame:
    """Per event the offsets that its window lacks."""
    have = windows.groupBy("transcript_id").agg(F.collect_set("relative_day").alias("have"))
    return have.select("transcript_id", F.array_sort(F.array_except(F.sequence(F.lit(-pre), F.lit(post)), "have")).alias("missing"))


def window_continuity(windows: DataFrame) -> DataFrame:
    """Per event whether the offsets run without gaps, days before and after, and whether the event's day is there."""
    return windows.groupBy("transcript_id").agg(
        (F.max("relative_day") - F.min("relative_day") + 1 == F.count_distinct("relative_day")).alias("continuous"),
        F.count_if(F.col("relative_day") < 0).alias("pre_days"), F.count_if(F.col("relative_day") > 0).alias("post_days"),
        F.bool_or(F.col("relative_day") == 0).alias("has_event_day"),
    )


def event_car(windows: DataFrame, horizons: list[int], start: int = 1, policy: str = "skip", least: int = 1, ar: str = "abnormal_return", extreme: float | None = None) -> DataFrame:
    """``car_Nd``: the sum of abnormal returns from day ``start`` to N of each event.

    ``policy`` for missing returns: "skip" leaves them out, "zero" counts them as
    0, "raise" fails.  A sum over fewer than ``least`` values is null.
    ``car_complete``: every day up to the longest horizon has a return.
    """
    x = finite(ar)
    if policy == "zero":
        x = F.coalesce(x, F.lit(0.0))
    elif policy == "raise":
        x = F.when(x.isNull() & (F.col("relative_day") >= start), F.raise_error(F.lit("a return in the window is missing"))).otherwise(x)
    top = max(horizons)
    inside = lambda h: F.col("relative_day").between(start, h)
    sums = [F.when(F.count(F.when(inside(h), x)) >= least, F.sum(F.when(inside(h), x))).alias(f"car_{h}d") for h in horizons]
    out = windows.groupBy("transcript_id", "ticker").agg(
        *sums,
        F.count_if(inside(top)).alias("post_day_count"),
        F.count_if(inside(top) & finite(ar).isNull()).alias("nan_day_count"),
    )
    out = out.withColumn("car_complete", (F.col("post_day_count") == top - start + 1) & (F.col("nan_day_count") == 0))
    return out.withColumn("is_extreme", F.coalesce(F.abs(F.col(f"car_{top}d")) > extreme, F.lit(False))) if extreme is not None else out


def compound_frame(r: str, first: int, last: int) -> Column:
    """Window: the product of 1 + r over rows ``first`` to ``last`` ahead, less 1 (null over none)."""
    return F.product(1 + F.coalesce(finite(r), F.lit(0.0))).over(Window.partitionBy("ticker").orderBy("date").rowsBetween(first, last)) - 1


def forward_compound(market: DataFrame, horizons: list[int], least: int = 1) -> DataFrame:
    """Compound stock and benchmark returns of the h sessions strictly after each day, and their difference."""
    w = Window.partitionBy("ticker").orderBy("date")
    out = market
    for h in horizons:
        seen = F.count("benchmark_return").over(w.rowsBetween(1, h))
        out = out.withColumns({f"stock_{h}d": compound_frame("daily_return", 1, h), f"benchmark_{h}d": F.when(seen >= least, compound_frame("benchmark_return", 1, h))})
        out = out.withColumn(f"ar_{h}d", F.col(f"stock_{h}d") - F.col(f"benchmark_{h}d"))
    return out


def inclusive_returns(events: DataFrame, market: DataFrame, horizons: list[int]) -> DataFrame:
    """The other convention: h sessions from the first one on or after the event, that one included.

    Events whose ticker is unknown or that lie past the data are dropped.
    """
    sessions = number_sessions(market)
    w = Window.partitionBy("ticker").orderBy("date")
    cols: dict[str, Column] = {}
    for h in horizons:
        full = F.count("*").over(w.rowsBetween(0, h - 1)) == h
        cols |= {f"return_{h}d": F.when(full, compound_frame("daily_return", 0, h - 1)), f"market_{h}d": F.when(full, compound_frame("benchmark_return", 0, h - 1))}
    ahead = market.withColumns(cols).withColumns({f"ar_{h}d": F.col(f"return_{h}d") - F.col(f"market_{h}d") for h in horizons})
    placed = on_or_after(events, sessions).filter("session_no is not null")
    keep = [f"{p}_{h}d" for h in horizons for p in ("return", "ar")]
    return placed.join(ahead.select("ticker", F.col("date").alias("aligned_event_date"), *keep), ["ticker", "aligned_event_date"])


def benchmark_coverage(events: DataFrame, market: DataFrame, horizon: int) -> DataFrame:
    """Per event how many of the ``horizon`` weekdays after it have a benchmark return: full, partial or uncovered."""
    days = F.filter(F.sequence(F.date_add("event_date", 1), F.date_add("event_date", horizon + 2 * (horizon // 5 + 1))), lambda d: F.weekday(d) < 5)
    wide = events.select("transcript_id", F.explode(F.slice(days, 1, horizon)).alias("date"))
    known = market.filter("benchmark_return is not null").select("date").distinct().withColumn("hit", F.lit(1))
    got = wide.join(known, "date", "left").groupBy("transcript_id").agg(F.count("*").alias("expected_days"), F.count("hit").alias("covered_days"))
    return got.withColumn("coverage", F.when(F.col("covered_days") == F.col("expected_days"), "full").when(F.col("covered_days") > 0, "partial").otherwise("uncovered"))

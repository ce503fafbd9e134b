"""Summaries of runs and layers, and small choices of rows and columns that reports need."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import finite, safe_divide, truthy


def status_counts(df: DataFrame, column: str = "status") -> DataFrame:
    """(status, n); null is a status."""
    return df.groupBy(F.col(column).alias("status")).agg(F.count("*").alias("n"))


def with_status(df: DataFrame, status: str = "ok", column: str = "status", keep: bool = True) -> DataFrame:
    """Rows of the status, or all others (null among them)."""
    same = F.coalesce(F.col(column) == status, F.lit(False))
    return df.filter(same if keep else ~same)


def active_rows(df: DataFrame, flag: str = "was_skipped") -> DataFrame:
    """Rows that weren't skipped; a missing flag counts as not skipped."""
    return df.filter(~F.coalesce(truthy(flag), F.lit(False))) if flag in df.columns else df


def first_filled(df: DataFrame, columns: list[str], default: str | None = None) -> Column:
    """The first text of the columns that exist which isn't blank."""
    have = [F.when(F.trim(F.col(c).cast("string")) != "", F.col(c).cast("string")) for c in columns if c in df.columns]
    return F.coalesce(*have, F.lit(default))


def first_number(df: DataFrame, columns: list[str], default: float | None = 0.0) -> Column:
    """The first of the columns that exist and are numbers, else ``default``."""
    kinds = dict(df.dtypes)
    for c in columns:
        if c in kinds and (kinds[c] in ("double", "float", "int", "bigint", "smallint", "tinyint") or kinds[c].startswith("decimal")):
            return finite(c)
    return F.lit(default)


def horizon_columns(columns: list[str], prefix: str = "car_") -> list[str]:
    """Columns like ``car_3d`` in the order of their days."""
    found = [(int(m[1]), c) for c in columns if (m := re.fullmatch(re.escape(prefix) + r"([0-9]+)d", c))]
    return [c for _, c in sorted(found)]


def safe_median(c: str) -> Column:
    """Aggregate: the interpolated median, 0 over nothing."""
    return F.coalesce(F.median(finite(c)), F.lit(0.0))


def transcript_analytics(chunks: DataFrame, key: str = "transcript_id", order: str = "chunk_order", score: str = "sentiment_score") -> DataFrame:
    """A row for each transcript: size, centre and spread of its scores, shares of labels, first and last score, change between its halves."""
    s = finite(score)
    at = F.row_number().over(Window.partitionBy(key).orderBy(order))
    placed = chunks.select(key, order, s.alias("s")).withColumns({"__at": at, "__n": F.count("*").over(Window.partitionBy(key))})
    early = F.col("__at") <= F.col("__n") / 2
    return placed.groupBy(key).agg(
        F.count("*").alias("chunks"), F.avg("s").alias("mean_score"), safe_median("s").alias("median_score"), F.coalesce(F.stddev_samp("s"), F.lit(0.0)).alias("std_score"), F.min("s").alias("min_score"), F.max("s").alias("max_score"),
        F.avg((F.col("s") > 0.05).cast("double")).alias("positive_share"), F.avg((F.col("s") < -0.05).cast("double")).alias("negative_share"), F.min_by("s", order).alias("first_score"), F.max_by("s", order).alias("last_score"),
        (F.avg(F.when(early, F.col("s"))) - F.avg(F.when(~early, F.col("s")))).alias("optimism_decay"),
    )


def batch_summary(scores: DataFrame, label: str = "label", score: str = "sentiment_score") -> DataFrame:
    """One row: transcripts, labels' counts, mean and deviation."""
    return scores.agg(F.count("*").alias("rows"), *[F.count_if(F.col(label) == x).alias(f"{x}_rows") for x in ("positive", "neutral", "negative")], F.avg(finite(score)).alias("mean_score"), F.coalesce(F.stddev_samp(finite(score)), F.lit(0.0)).alias("std_score"))


def window_summary(windows: DataFrame, pre: int, post: int, key: str = "transcript_id") -> DataFrame:
    """One row: events, rows, complete and partial windows, mean rows of a window."""
    g = windows.groupBy(key).agg(F.count("*").alias("k"))
    return g.agg(F.count("*").alias("events"), F.sum("k").alias("rows"), F.count_if(F.col("k") == pre + post + 1).alias("complete"), F.count_if(F.col("k") != pre + post + 1).alias("partial"), F.avg("k").alias("mean_rows"))


def dataset_statistics(df: DataFrame, date: str = "date", group: str = "ticker", value: str = "daily_return") -> DataFrame:
    """One row: rows, groups, first and last day, missing values, mean and deviation."""
    v = finite(value)
    return df.agg(F.count("*").alias("rows"), F.count_distinct(group).alias("groups"), F.min(date).alias("first_day"), F.max(date).alias("last_day"), F.count_if(v.isNull()).alias("missing"), F.avg(v).alias("mean_value"), F.stddev_samp(v).alias("std_value"))


def run_summary(market: DataFrame, wanted: DataFrame, key: str = "ticker") -> DataFrame:
    """(ticker, status, rows, first_day, last_day) of every ticker asked for; "failed" without rows."""
    got = market.groupBy(key).agg(F.count("*").alias("rows"), F.min("date").alias("first_day"), F.max("date").alias("last_day"))
    out = wanted.select(key).distinct().join(got, key, "left")
    return out.select(key, F.when(F.col("rows").isNull(), "failed").otherwise("ok").alias("status"), F.coalesce("rows", F.lit(0)).alias("rows"), "first_day", "last_day")


def stage_metrics(stages: list[tuple[str, DataFrame, DataFrame]]) -> DataFrame:
    """(stage, rows_in, rows_out, dropped, kept_share) of each (name, input, output)."""
    out = None
    for name, before, after in stages:
        both = before.select(F.lit(1).alias("i"), F.lit(0).alias("o")).unionByName(after.select(F.lit(0).alias("i"), F.lit(1).alias("o")))
        row = both.agg(F.lit(name).alias("stage"), F.coalesce(F.sum("i"), F.lit(0)).alias("rows_in"), F.coalesce(F.sum("o"), F.lit(0)).alias("rows_out"))
        out = row if out is None else out.unionByName(row)
    return out.withColumns({"dropped": F.col("rows_in") - F.col("rows_out"), "kept_share": safe_divide("rows_out", "rows_in")})


def overview(master: DataFrame, score: str = "sentiment_score", ret: str = "car_5d", agree: str = "agreement") -> DataFrame:
    """(metric, value) of a dashboard's head: events, tickers, mean score and return, share of agreement."""
    cells = [("events", F.count("*")), ("tickers", F.count_distinct("ticker")), ("mean_score", F.avg(finite(score))), ("mean_return", F.avg(finite(ret))), ("agreement", F.avg(truthy(agree).cast("double")))]
    one = master.agg(*[c.cast("double").alias(n) for n, c in cells])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n, _ in cells])).alias("x")).select("x.*")


def statistical_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n, missing, mean, std, min, max) of each column, from one aggregation."""
    cells = []
    for c in columns:
        v = finite(c)
        cells.append(F.struct(F.lit(c).alias("column"), F.count(v).alias("n"), (F.count("*") - F.count(v)).alias("missing"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max")))
    return df.agg(F.array(*cells).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def t_test_warnings(df: DataFrame, group: str, value: str, least: int = 5) -> DataFrame:
    """(group, n, warning) of groups that no t test can use: too few values, or values that don't vary."""
    v = finite(value)
    g = df.groupBy(F.col(group).alias("group")).agg(F.count(v).alias("n"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("sd"))
    why = F.when(F.col("n") < least, "too_few_values").when(F.col("sd") == 0, "no_variance")
    return g.select("group", "n", why.alias("warning")).filter("warning is not null")


def wide_returns(returns: DataFrame, tickers: list[str], value: str = "daily_return") -> DataFrame:
    """A column for each ticker and a row for each day that has any value."""
    out = returns.groupBy("date").agg(*[F.max(F.when(F.col("ticker") == t, finite(value))).alias(t) for t in tickers])
    return out.filter(F.coalesce(*[F.col(t) for t in tickers]).isNotNull())


def return_timeline(returns: DataFrame, value: str = "abnormal_return") -> DataFrame:
    """(ticker, date, value, cumulative): missing values count as 0 in the running sum."""
    w = Window.partitionBy("ticker").orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    v = finite(value)
    return returns.select("ticker", "date", v.alias(value)).withColumn("cumulative", F.sum(F.coalesce(F.col(value), F.lit(0.0))).over(w))


def outcome_counts(results: DataFrame, model: str = "model", status: str = "status") -> DataFrame:
    """(status, models) of trained and untrained models."""
    return results.groupBy(status).agg(F.count(model).alias("models"))


def extreme_ids(df: DataFrame, columns: list[str], cap: float, key: str = "transcript_id") -> DataFrame:
    """Ids with any value beyond the cap."""
    bad = F.lit(False)
    for c in columns:
        bad = bad | F.coalesce(F.abs(finite(c)) > cap, F.lit(False))
    return df.filter(bad).select(key).distinct()

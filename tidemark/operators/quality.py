"""Checks that give rows (severity, stage, check, message, n, rate); suites are unions of checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import safe_divide

SCHEMA = "severity string, stage string, check string, message string, n long, rate double"


def _issue(counted: DataFrame, stage: str, check: str, message: str, severity: Column, n: str = "n", rate: Column | None = None) -> DataFrame:
    return counted.select(severity.alias("severity"), F.lit(stage).alias("stage"), F.lit(check).alias("check"), F.lit(message).alias("message"), F.col(n).cast("long").alias("n"), (rate if rate is not None else F.lit(None)).cast("double").alias("rate"))


def _found(severity: str, n: str = "n") -> Column:
    return F.when(F.col(n) > 0, severity).otherwise("ok")


def required_columns(df: DataFrame, columns: list[str], stage: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    return df.sparkSession.createDataFrame([("critical" if missing else "ok", stage, "required_columns", ", ".join(missing), len(missing), None)], SCHEMA)


def null_rates(df: DataFrame, columns: list[str], stage: str = "", warn: float = 0.05, stop: float = 0.2) -> DataFrame:
    """A row for each column: warning from ``warn`` on, critical from ``stop`` on."""
    each = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).isNull().alias("m")) for c in columns])).alias("x")).select("x.*")
    g = each.groupBy("c").agg(F.count_if("m").alias("n"), F.avg(F.col("m").cast("double")).alias("rate"))
    level = F.when(F.col("rate") >= stop, "critical").when(F.col("rate") >= warn, "warning").otherwise("ok")
    return g.select(level.alias("severity"), F.lit(stage).alias("stage"), F.concat(F.lit("null_rate:"), "c").alias("check"), F.lit("share of missing values").alias("message"), "n", "rate")


def null_keys(df: DataFrame, keys: list[str], stage: str) -> DataFrame:
    bad = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    return _issue(df.agg(F.count_if(bad).alias("n")), stage, "null_keys", ",".join(keys), _found("critical"))


def duplicates(df: DataFrame, keys: list[str], stage: str) -> DataFrame:
    """Rows beyond the first of each key."""
    g = df.groupBy(*keys).agg(F.count("*").alias("k")).agg(F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias("n"))
    return _issue(g, stage, "duplicates", ",".join(keys), _found("critical"))


def duplicate_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """All rows whose key occurs more than once."""
    return df.withColumn("__n", F.count("*").over(Window.partitionBy(*keys))).filter("__n > 1").drop("__n")


def failing(df: DataFrame, condition: Column, stage: str, check: str, message: str = "", severity: str = "warning", over: float | None = None) -> DataFrame:
    """How many rows meet a condition; ``over``: critical where their share is larger."""
    g = df.agg(F.count_if(condition).alias("n"), F.count("*").alias("all")).withColumn("rate", safe_divide("n", "all"))
    level = F.when(F.col("rate") > over, "critical").when(F.col("n") > 0, severity).otherwise("ok") if over is not None else _found(severity)
    return _issue(g, stage, check, message, level, rate=F.col("rate"))


def out_of_range(df: DataFrame, column: str, low: float, high: float, stage: str, severity: str = "critical") -> DataFrame:
    return failing(df, F.col(column).isNotNull() & ~F.col(column).between(low, high), stage, f"range:{column}", f"[{low}, {high}]", severity)


def extreme_values(df: DataFrame, column: str, cap: float) -> DataFrame:
    return df.filter(F.abs(F.col(column)) > cap)


def probability_sums(df: DataFrame, columns: list[str], stage: str, tolerance: float = 1e-4) -> DataFrame:
    total = reduce(lambda a, b: a + b, [F.col(c) for c in columns])
    return failing(df, F.abs(total - 1) > tolerance, stage, "probability_sum", ",".join(columns), "critical")


def monotonic(df: DataFrame, group: str, order: str, value: str, stage: str, step: int = 1) -> DataFrame:
    w = Window.partitionBy(group).orderBy(order)
    return failing(df.withColumn("__d", F.col(value) - F.lag(value).over(w)), F.col("__d") < step, stage, f"monotonic:{value}", f"by {group}", "critical")


def gaps(df: DataFrame, group: str, order: str, stage: str) -> DataFrame:
    g = df.groupBy(group).agg((F.count("*") != F.count_distinct(order)).alias("rep"), (F.max(order) - F.min(order) + 1 != F.count_distinct(order)).alias("gap"))
    return _issue(g.agg(F.count_if(F.col("rep") | F.col("gap")).alias("n")), stage, f"ordering:{order}", f"by {group}", _found("warning"))


def exactly_one(df: DataFrame, group: str, flag: Column, stage: str, check: str) -> DataFrame:
    g = df.groupBy(group).agg(F.count_if(flag).alias("k")).agg(F.count_if(F.col("k") != 1).alias("n"))
    return _issue(g, stage, check, f"one in each {group}", _found("critical"))


def group_sizes(df: DataFrame, group: str, stage: str, least: int | None = None, exact: int | None = None) -> DataFrame:
    g = df.groupBy(group).agg(F.count("*").alias("k"))
    bad = (F.col("k") != exact) if exact is not None else (F.col("k") < (least or 1))
    return _issue(g.agg(F.count_if(bad).alias("n")), stage, "group_size", f"by {group}", _found("warning"))


def unknown_values(df: DataFrame, column: str, allowed: list[str], stage: str) -> DataFrame:
    return failing(df, F.col(column).isNotNull() & ~F.col(column).isin(allowed), stage, f"domain:{column}", ",".join(allowed), "critical")


def weekend_dates(df: DataFrame, column: str, stage: str) -> DataFrame:
    return failing(df, F.weekday(column) >= 5, stage, f"weekend:{column}", "", "warning")


def linkage(fine: DataFrame, coarse: DataFrame, key: str, stage: str) -> DataFrame:
    o = fine.join(coarse.select(key).distinct(), key, "left_anti").agg(F.count("*").alias("n"))
    return _issue(o, stage, f"linkage:{key}", "rows without a parent", _found("critical"))


def coverage(df: DataFrame, column: str, least: float, stage: str) -> DataFrame:
    g = df.agg(F.count_if(F.col(column).isNull()).alias("n"), F.avg(F.col(column).isNotNull().cast("double")).alias("rate"))
    return _issue(g, stage, f"coverage:{column}", f"at least {least}", F.when(F.col("rate") < least, "warning").otherwise("ok"), rate=F.col("rate"))


def suite(*checks: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), checks)


def health(issues: DataFrame) -> DataFrame:
    """One row: counts by severity and 100 - 10 for each critical - 2 for each warning, not below 0."""
    e, w = F.count_if(F.col("severity") == "critical"), F.count_if(F.col("severity") == "warning")
    return issues.agg(e.alias("errors"), w.alias("warnings"), F.count_if(F.col("severity") == "ok").alias("passed"), F.greatest(100 - 10 * e - 2 * w, F.lit(0)).cast("long").alias("health_score"))


def null_report(df: DataFrame) -> DataFrame:
    """(column, type, n_null, rate) of every column, the worst first."""
    kinds = dict(df.dtypes)
    each = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(kinds[c]).alias("type"), F.col(c).isNull().alias("m")) for c in df.columns])).alias("x")).select("x.*")
    return each.groupBy("column", "type").agg(F.count_if("m").alias("n_null"), F.avg(F.col("m").cast("double")).alias("rate")).orderBy(F.col("rate").desc(), "column")


def label_distribution(df: DataFrame, column: str, expected: list[str] | None = None) -> DataFrame:
    out = df.groupBy(column).agg(F.count("*").alias("n"))
    out = out.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))
    return out.withColumn("expected", F.coalesce(F.col(column).isin(expected), F.lit(False))) if expected is not None else out


def transcript_errors(df: DataFrame, key: str, text: str, least: int = 200, most: int = 50_000) -> DataFrame:
    """(key, n_words, errors, is_valid) by the rules for whole transcripts."""
    from ..functions.text import word_count

    n = word_count(text)
    rules = F.array_compact(F.array(F.when(F.col(key).isNull(), "missing_id"), F.when(F.coalesce(F.trim(text), F.lit("")) == "", "empty_text"), F.when(n < least, "too_short"), F.when(n > most, "too_long")))
    return df.select(key, n.alias("n_words"), rules.alias("errors"), (F.size(rules) == 0).alias("is_valid"))


def chunk_errors(df: DataFrame, key: str, text: str, tokens: str) -> DataFrame:
    rules = F.array_compact(F.array(F.when(F.col(tokens) < 20, "too_few_tokens"), F.when(F.col(tokens) > 512, "too_many_tokens"), F.when(F.length(F.coalesce(F.col(text), F.lit(""))) < 20, "too_short")))
    return df.select(key, rules.alias("errors"), (F.size(rules) == 0).alias("is_valid"))


def is_transcript_id(c: str) -> Column:
    return F.col(c).rlike(r"^[A-Z]{1,5}_[0-9]{8}$")


def windows_suite(windows: DataFrame, pre: int, post: int) -> DataFrame:
    """Checks of event windows."""
    s = "windows"
    return suite(null_keys(windows, ["transcript_id", "date"], s), duplicates(windows, ["transcript_id", "relative_day"], s), exactly_one(windows, "transcript_id", F.col("relative_day") == 0, s, "event_day"), monotonic(windows, "transcript_id", "date", "relative_day", s), gaps(windows, "transcript_id", "relative_day", s), group_sizes(windows, "transcript_id", s, exact=pre + post + 1))


def returns_suite(df: DataFrame, column: str, cap: float = 0.5) -> DataFrame:
    s = "returns"
    return suite(null_rates(df, [column], s), failing(df, F.abs(F.col(column)) > cap, s, f"extreme:{column}", f"|x| > {cap}", "warning", over=0.02), coverage(df, column, 0.8, s))


def scores_suite(df: DataFrame, key: str) -> DataFrame:
    s = "scores"
    return suite(duplicates(df, [key], s), null_rates(df, ["sentiment_score"], s), out_of_range(df, "sentiment_score", -1, 1, s), *[out_of_range(df, f"{p}_prob", 0, 1, s) for p in ("positive", "neutral", "negative")], probability_sums(df, ["positive_prob", "neutral_prob", "negative_prob"], s), failing(df, F.col("token_count") > 512, s, "token_limit", "512", "warning"))


def counts_suite(df: DataFrame) -> DataFrame:
    """Lexicon counts: none negative, matched at most total, coverage between 0 and 1."""
    s = "counts"
    bad = reduce(lambda a, b: a | b, [F.col(c) < 0 for c in df.columns if c.endswith("_count")])
    return suite(failing(df, bad, s, "negative_count", "", "critical"), failing(df, F.col("matched_tokens") > F.col("total_tokens"), s, "matched_over_total", "", "critical"), out_of_range(df, "coverage_ratio", 0, 1, s))

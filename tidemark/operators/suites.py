"""Suites of checks for each layer, as issue rows; a layer without rows is critical."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import quality as dq

LABELS = ["positive", "neutral", "negative"]
SECTIONS = ["prepared_remarks", "qa", "closing_remarks", "operator", "unknown"]
PROBS = ["positive_prob", "neutral_prob", "negative_prob"]
_NUMBERS = ("double", "float", "int", "bigint", "smallint", "tinyint")


def not_empty(df: DataFrame, stage: str) -> DataFrame:
    """Critical where there is no row."""
    g = df.limit(1).agg((F.count("*") == 0).cast("long").alias("n"))
    return dq._issue(g, stage, "not_empty", "at least one row", dq._found("critical"))


def _some(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in conditions])


def dates_in_bounds(df: DataFrame, stage: str = "windows", date: str = "date", start: str = "window_start", end: str = "window_end") -> DataFrame:
    return dq.failing(df, (F.col(date) < F.col(start)) | (F.col(date) > F.col(end)), stage, "date_in_bounds", f"[{start}, {end}]", "critical")


def required_horizons(df: DataFrame, horizons: list[int], stage: str = "returns", key: str = "transcript_id", least: float = 0.8) -> DataFrame:
    """Events that lack one of the days; critical where more than 1 - ``least`` of them do."""
    have = df.groupBy(key).agg(*[F.bool_or(F.col("relative_day") == h).alias(f"h{h}") for h in horizons])
    return dq.failing(have, _some([~F.coalesce(F.col(f"h{h}"), F.lit(False)) for h in horizons]), stage, "required_horizons", ",".join(map(str, horizons)), over=1 - least)


def column_type(df: DataFrame, column: str, kind: str, stage: str) -> DataFrame:
    found = dict(df.dtypes).get(column)
    return df.sparkSession.createDataFrame([("ok" if found == kind else "warning", stage, f"type:{column}", f"{found}, expected {kind}", int(found != kind), None)], dq.SCHEMA)


def infinite_values(df: DataFrame, stage: str) -> DataFrame:
    cols = [c for c, t in df.dtypes if t in ("double", "float")]
    return dq.failing(df, _some([F.abs(F.col(c)) == float("inf") for c in cols]), stage, "infinite_values", ",".join(cols), "critical")


def missing_values(df: DataFrame, columns: list[str], stage: str) -> DataFrame:
    return dq.failing(df, _some([F.col(c).isNull() | (F.isnan(c) if dict(df.dtypes)[c] in ("double", "float") else F.lit(False)) for c in columns]), stage, "missing_values", ",".join(columns))


def ohlcv_suite(df: DataFrame, least_rows: int = 5) -> DataFrame:
    """Prices: rows, columns, dates, repeats, signs, missing values, tickers with few rows."""
    s, cols = "ohlcv", ["open", "high", "low", "close", "adj_close", "volume"]
    return dq.suite(
        not_empty(df, s), dq.required_columns(df, ["ticker", "date", *cols], s), dq.null_keys(df, ["ticker", "date"], s), dq.duplicates(df, ["ticker", "date"], s), dq.failing(df, F.col("close") <= 0, s, "close_positive", "", "critical"),
        dq.failing(df, F.col("volume") < 0, s, "volume_not_negative", "", "critical"), missing_values(df, cols, s), dq.group_sizes(df, "ticker", s, least=least_rows),
    )


def benchmark_suite(df: DataFrame) -> DataFrame:
    s = "benchmark"
    return dq.suite(
        not_empty(df, s), dq.required_columns(df, ["date", "close", "benchmark_return"], s), dq.null_keys(df, ["date"], s), dq.duplicates(df, ["date"], s), dq.failing(df, F.col("close") <= 0, s, "close_positive", "", "critical"),
        dq.failing(df, F.abs("benchmark_return") >= 1, s, "return_below_1", "", "critical"),
    )


def feature_suite(df: DataFrame, features: list[str], most_missing: float = 0.5) -> DataFrame:
    """Market features: repeats, returns of 1 and more, negative volatility and averages, infinities, mostly missing ones."""
    s = "features"
    low = [c for c in df.columns if c.startswith(("rolling_volatility", "sma_", "ema_"))]
    checks = [dq.duplicates(df, ["ticker", "date"], s), dq.failing(df, F.abs("daily_return") >= 1, s, "return_below_1", "", "critical"), infinite_values(df, s), dq.null_rates(df, features, s, warn=most_missing, stop=1.01)]
    return dq.suite(*checks, *([dq.failing(df, _some([F.col(c) < -1e-9 for c in low]), s, "not_negative", ",".join(low), "critical")] if low else []))


def market_suite(df: DataFrame) -> DataFrame:
    """The market dataset: keys, repeats, event days and days in bounds."""
    s = "market"
    return dq.suite(not_empty(df, s), dq.null_keys(df, ["transcript_id", "ticker", "date"], s), dq.duplicates(df, ["transcript_id", "date"], s), dq.exactly_one(df, "transcript_id", F.col("relative_day") == 0, s, "event_day"), infinite_values(df, s))


def alignment_suite(df: DataFrame, most_days: int = 7) -> DataFrame:
    """Aligned events: each has a session, on or after its day and not far from it; none is on a weekend."""
    s, gap = "alignment", F.datediff("aligned_event_date", "event_date")
    return dq.suite(
        not_empty(df, s), dq.duplicates(df, ["transcript_id"], s), dq.null_rates(df, ["aligned_event_date"], s), dq.failing(df, gap < 0, s, "not_before_event", "", "critical"), dq.failing(df, gap > most_days, s, "near_event", f"{most_days} days"),
        dq.weekend_dates(df, "aligned_event_date", s),
    )


def _cars(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("car_") and c != "car_complete"]


def car_suite(df: DataFrame, cap: float = 0.5) -> DataFrame:
    s, cars = "car", _cars(df)
    if not cars:
        return dq.suite(not_empty(df, s), dq.required_columns(df, ["car_1d"], s))
    return dq.suite(
        not_empty(df, s), dq.duplicates(df, ["transcript_id"], s), dq.null_keys(df, ["transcript_id", "ticker"], s), *[dq.failing(df, F.abs(c) > cap, s, f"extreme:{c}", f"|x| > {cap}", over=0.02) for c in cars],
        dq.null_rates(df, cars, s), column_type(df, "car_complete", "boolean", s), dq.failing(df, ~F.col("car_complete"), s, "car_complete", "events without all days", over=0.2),
    )


def merge_suite(df: DataFrame, scores: tuple[str, ...] = ("sentiment_score", "tone_score"), label: str = "sentiment_label") -> DataFrame:
    """Scores on events: one row an event, no missing scores, known labels, scores between -1 and 1."""
    s = "merge"
    return dq.suite(not_empty(df, s), dq.duplicates(df, ["transcript_id"], s), dq.null_keys(df, [*scores, label], s), dq.null_rates(df, [*scores, label], s), dq.unknown_values(df, label, LABELS, s), *[dq.out_of_range(df, c, -1, 1, s) for c in scores])


def final_suite(df: DataFrame, scores: tuple[str, ...] = ("sentiment_score", "tone_score"), label: str = "sentiment_label", cap: float = 0.5) -> DataFrame:
    s = "final"
    extremes = [dq.failing(df, F.abs(c) > cap, s, f"extreme:{c}", f"|x| > {cap}", over=0.02) for c in ["abnormal_return", *_cars(df)] if c in df.columns]
    return dq.suite(*[x.withColumn("stage", F.lit(s)) for x in (merge_suite(df, scores, label),)], dq.null_keys(df, ["transcript_id", "ticker", "aligned_event_date"], s), dq.weekend_dates(df, "aligned_event_date", s), *extremes)


def event_suite(df: DataFrame) -> DataFrame:
    """Any table of events: keys, repeats, missing values, weekends."""
    s = "events"
    return dq.suite(not_empty(df, s), dq.null_keys(df, ["transcript_id"], s), dq.duplicates(df, ["transcript_id"], s), dq.null_rates(df, [c for c in df.columns if c != "transcript_id"], s), *([dq.weekend_dates(df, "event_date", s)] if "event_date" in df.columns else []))


def inference_suite(df: DataFrame, key: str, stage: str = "inference", digits: float = 1e-4) -> DataFrame:
    """Predictions: ids, probabilities and their sum, score and confidence as they follow from them, labels, skipped rows."""
    s = stage
    score, top = F.abs(F.col("sentiment_score") - (F.col("positive_prob") - F.col("negative_prob"))), F.abs(F.col("confidence") - F.greatest(*PROBS))
    live = ~F.coalesce(F.col("was_skipped"), F.lit(False)) if "was_skipped" in df.columns else F.lit(True)
    return dq.suite(
        not_empty(df, s), dq.null_keys(df, [key], s), dq.duplicates(df, [key], s), *[dq.out_of_range(df, p, 0, 1, s) for p in PROBS], dq.probability_sums(df, PROBS, s, digits), dq.out_of_range(df, "sentiment_score", -1, 1, s),
        dq.failing(df, live & (score > digits), s, "score_follows", "", "critical"), dq.failing(df, live & (top > digits), s, "confidence_follows", "", "critical"), dq.unknown_values(df, "predicted_label", LABELS, s),
    )


def chunk_suite(df: DataFrame, key: str = "chunk_id", parent: str = "transcript_id", order: str = "chunk_order", most_tokens: int = 512) -> DataFrame:
    """Chunks: ids, order without gaps from their first number, tokens within the limit, texts, speakers, scores where there are any."""
    s = "chunks"
    checks = [not_empty(df, s), dq.null_keys(df, [key, parent], s), dq.duplicates(df, [key], s), dq.gaps(df, parent, order, s), dq.failing(df, F.col("token_count") > most_tokens, s, "token_limit", str(most_tokens)), dq.failing(df, F.col("token_count") < 1, s, "token_count", "at least 1", "critical")]
    checks += [dq.failing(df, F.coalesce(F.trim("chunk_text"), F.lit("")) == "", s, "empty_text", "", "critical")] if "chunk_text" in df.columns else []
    checks += [dq.null_rates(df, ["speaker"], s)] if "speaker" in df.columns else []
    checks += [dq.out_of_range(df, p, 0, 1, s) for p in PROBS if p in df.columns] + ([dq.out_of_range(df, "sentiment_score", -1, 1, s)] if "sentiment_score" in df.columns else [])
    return dq.suite(*checks)


def sentence_suite(df: DataFrame, parent: str, order: str = "sentence_order", text: str = "sentence_text", least_chars: int = 10, most_tokens: int = 512) -> DataFrame:
    """Sentences: ids, order, lengths and tokens."""
    s = "sentences"
    return dq.suite(
        not_empty(df, s), dq.null_keys(df, [parent, "sentence_id"], s), dq.duplicates(df, [parent, order], s), dq.gaps(df, parent, order, s), dq.failing(df, F.length(text) < least_chars, s, "least_length", str(least_chars), "critical"),
        dq.failing(df, F.col("token_estimate") > most_tokens, s, "token_limit", str(most_tokens)),
    )


def segment_suite(df: DataFrame, key: str, order: str = "order_index") -> DataFrame:
    """Turns: order, sections, texts; transcripts that only the operator speaks in; questions before prepared remarks end."""
    s = "segments"
    g = df.groupBy(key).agg(F.bool_and(F.col("speaker_type") == "operator").alias("only_op"), F.max(F.when(F.col("section_type") == "prepared_remarks", F.col(order))).alias("p"), F.min(F.when(F.col("section_type") == "qa", F.col(order))).alias("q"))
    return dq.suite(
        not_empty(df, s), dq.duplicates(df, [key, order], s), dq.gaps(df, key, order, s), dq.unknown_values(df, "section_type", SECTIONS, s), dq.failing(df, F.coalesce(F.trim("text"), F.lit("")) == "", s, "empty_text", "", "critical"),
        dq.failing(g, F.col("only_op"), s, "only_operator"), dq.failing(g, F.col("p") > F.col("q"), s, "sections_in_order"),
    )


def transcript_suite(df: DataFrame, key: str = "transcript_id", score: str = "mean_sentiment", chunks: str = "chunk_count") -> DataFrame:
    s = "transcripts"
    return dq.suite(not_empty(df, s), dq.null_keys(df, [key], s), dq.duplicates(df, [key], s), dq.null_rates(df, [score], s), dq.out_of_range(df, score, -1, 1, s), dq.failing(df, F.col(chunks) < 1, s, "chunk_count", "at least 1", "critical"))


def hierarchy_suite(fine: DataFrame, coarse: DataFrame, key: list[str], score: str, mean: str, count: str, tolerance: float = 1e-6) -> DataFrame:
    """A level against the one below: unique keys, no orphans, counts and mean scores that follow."""
    s = "hierarchy"
    got = fine.groupBy(*key).agg(F.count("*").alias("__n"), F.avg(score).alias("__m"))
    both = coarse.join(got, key, "left")
    orphans = got.join(coarse.select(*key).distinct(), key, "left_anti").agg(F.count("*").alias("n"))
    return dq.suite(
        not_empty(coarse, s), dq.duplicates(coarse, key, s), dq._issue(orphans, s, "orphans", ",".join(key), dq._found("critical")), dq.failing(both, ~F.col(count).eqNullSafe(F.coalesce("__n", F.lit(0))), s, "counts_follow", "", "critical"),
        dq.failing(both, F.abs(F.col(mean) - F.col("__m")) > tolerance, s, "means_follow", str(tolerance)),
    )


def tree_suite(nodes: DataFrame, node: str = "node_id", parent: str = "parent_id", level: str = "level", top: str = "transcript", group: str = "transcript_id") -> DataFrame:
    """Nodes of trees: unique, one top for each tree, parents that exist."""
    s = "tree"
    lost = nodes.filter(F.col(parent).isNotNull()).join(nodes.select(F.col(node).alias("__p")).distinct(), F.col(parent) == F.col("__p"), "left_anti").agg(F.count("*").alias("n"))
    return dq.suite(not_empty(nodes, s), dq.duplicates(nodes, [node], s), dq.exactly_one(nodes, group, F.col(level) == top, s, "one_top"), dq._issue(lost, s, "parents_exist", parent, dq._found("critical")))


def shift_continuity(df: DataFrame, group: str, order: str, column: str = "sentiment_shift", stage: str = "sentences") -> DataFrame:
    """The first value of each group is null and the others aren't."""
    n = F.row_number().over(Window.partitionBy(group).orderBy(order))
    return dq.failing(df.withColumn("__n", n), (F.col("__n") == 1) != F.col(column).isNull(), stage, f"shift:{column}", f"by {group}", "critical")


def lexicon_suite(df: DataFrame, key: str, label: str = "label", least_chunks: tuple[str, int] | None = None) -> DataFrame:
    """Lexicon scores: keys, counts, ratios, tone, coverage, labels, and a spread that isn't nothing."""
    s = "lexicon"
    checks = [not_empty(df, s), dq.null_keys(df, [key], s), dq.duplicates(df, [key], s)]
    counts, ratios = [c for c in df.columns if c.endswith("_count")], [c for c in df.columns if c.endswith("_ratio") and c != "net_ratio"]
    checks += [dq.failing(df, _some([F.col(c) < 0 for c in counts]), s, "negative_count", ",".join(counts), "critical")] if counts else []
    checks += [dq.failing(df, F.col("matched_tokens") > F.col("total_tokens"), s, "matched_over_total", "", "critical")] if {"matched_tokens", "total_tokens"} <= set(df.columns) else []
    checks += [dq.out_of_range(df, c, 0, 1, s) for c in ratios] + [dq.out_of_range(df, "tone_score", -1, 1, s), dq.unknown_values(df, label, [*LABELS, "unknown"], s)]
    flat = df.agg((F.coalesce(F.stddev_samp("tone_score"), F.lit(0.0)) == 0).cast("long").alias("n"))
    checks += [dq._issue(flat, s, "tone_varies", "deviation above 0", dq._found("warning"))]
    checks += [dq.failing(df, F.col("coverage_ratio") < 0.01, s, "low_coverage", "0.01", over=0.5)] if "coverage_ratio" in df.columns else []
    checks += [dq.group_sizes(df, least_chunks[0], s, least=least_chunks[1])] if least_chunks else []
    return dq.suite(*checks)


def master_suite(df: DataFrame, key: str, required: list[str]) -> DataFrame:
    s = "master"
    return dq.suite(not_empty(df, s), dq.required_columns(df, [key, *required], s), dq.null_keys(df, [key], s), dq.duplicates(df, [key], s), dq.null_rates(df, [c for c in required if c in df.columns], s))


def absent_tickers(wanted: DataFrame, market: DataFrame) -> DataFrame:
    """Tickers asked for that the market has no row of."""
    return wanted.select("ticker").distinct().join(market.select("ticker").distinct(), "ticker", "left_anti")


def repeated_values(df: DataFrame, column: str) -> DataFrame:
    """One row: how many distinct values repeat, and the smallest of them."""
    rep = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("k")).filter("k > 1")
    return rep.agg(F.count("*").alias("n"), F.min(column).alias("smallest"))


def report_lines(issues: DataFrame, with_ok: bool = False) -> DataFrame:
    """(line): issues as text, the gravest first."""
    rank = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    kept = issues if with_ok else issues.filter("severity != 'ok'")
    line = F.format_string("[%s] %s/%s: %d %s", F.upper("severity"), F.col("stage"), F.col("check"), F.col("n"), F.coalesce("message", F.lit("")))
    return kept.orderBy(rank, "stage", "check").select(F.btrim(line).alias("line"))

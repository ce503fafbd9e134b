"""Aggregation of chunk scores: weights, levels, drift, rolling views, dominance and the node tree."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import clip, col, finite, index_iqr, label_strict, normalise_probs, safe_divide, std_or_zero, upper_median, weighted_mean

STRATEGIES = ("uniform", "confidence", "token_count", "hybrid")
UNKNOWN = ("", "unknown", "nan", "none")


def weight_of(strategy: str | Column) -> Column:
    """uniform 1, confidence, token_count, hybrid their product."""
    s = F.lit(strategy) if isinstance(strategy, str) else strategy
    c, t = F.coalesce(finite("confidence"), F.lit(0.0)), F.greatest(F.coalesce(finite("token_count"), F.lit(1.0)), F.lit(1.0))
    return F.when(s == "uniform", 1.0).when(s == "confidence", c).when(s == "token_count", t).when(s == "hybrid", c * t)


def normalise_chunks(df: DataFrame) -> DataFrame:
    """Scores within [-1, 1], probabilities and confidence within [0, 1], at least one token, names never empty."""
    name = lambda c: F.when(F.lower(F.trim(F.coalesce(c, F.lit("")))).isin(*UNKNOWN), "unknown").otherwise(F.trim(c)).alias(c)
    out = df.withColumns({c: F.coalesce(clip(finite(c), 0.0, 1.0), F.lit(0.0)) for c in ("positive_prob", "neutral_prob", "negative_prob", "confidence") if c in df.columns})
    out = out.withColumn("sentiment_score", F.coalesce(clip(finite("sentiment_score"), -1.0, 1.0), F.lit(0.0)))
    out = out.withColumn("token_count", F.greatest(F.coalesce(finite("token_count"), F.lit(1.0)), F.lit(1.0)))
    return out.select(*[name(c) if c in ("section_type", "speaker", "speaker_role", "dominant_speaker") else F.col(c) for c in out.columns])


def aggregate(df: DataFrame, keys: list[str], strategy: str = "confidence", least: int = 1, threshold: float = 0.05) -> DataFrame:
    """A record for each group: weighted score and probabilities, label, spread, extremes, tokens.

    The median is the upper one and the quartiles are by index, so a group's
    scores are gathered: groups are documents, sections or speakers of one.
    """
    w = weight_of(strategy)
    aggs = [
        weighted_mean("sentiment_score", w).alias("score"),
        *[weighted_mean(f"{p}_prob", w).alias(f"__{p}") for p in ("positive", "neutral", "negative")],
        F.count("*").alias("chunk_count"), F.sum("token_count").cast("long").alias("total_tokens"), F.avg("confidence").alias("mean_confidence"),
        std_or_zero("sentiment_score").alias("std"), upper_median("sentiment_score").alias("median"), index_iqr("sentiment_score").alias("iqr"),
        F.min("sentiment_score").alias("min_score"), F.max("sentiment_score").alias("max_score"),
    ]
    out = df.groupBy(*keys).agg(*aggs).filter(F.col("chunk_count") >= least)
    p = normalise_probs("__positive", "__neutral", "__negative")
    return out.withColumns({"positive_prob": p[0], "neutral_prob": p[1], "negative_prob": p[2], "label": label_strict("score", threshold)}).drop("__positive", "__neutral", "__negative")


def aggregate_levels(df: DataFrame, strategy: str = "confidence", least_section: int = 1, least_speaker: int = 1) -> dict[str, DataFrame]:
    """Transcript, section and speaker records; unnamed sections and speakers are left out."""
    named = lambda c: ~F.lower(F.trim(F.coalesce(c, F.lit("")))).isin(*UNKNOWN)
    return {
        "transcript": aggregate(df, ["transcript_id"], strategy),
        "section": aggregate(df.filter(named("section_type")), ["transcript_id", "section_type"], strategy, least_section),
        "speaker": aggregate(df.filter(named("speaker")), ["transcript_id", "speaker"], strategy, least_speaker),
    }


def compare_strategies(df: DataFrame, keys: list[str]) -> DataFrame:
    """The score under each weighting, in one pass over rows times strategies."""
    each = df.withColumn("strategy", F.explode(F.array(*map(F.lit, STRATEGIES))))
    return each.groupBy(*keys, "strategy").agg(weighted_mean("sentiment_score", weight_of(F.col("strategy"))).alias("score"))


def _placed(df: DataFrame, order: str) -> DataFrame:
    w = Window.partitionBy("transcript_id")
    return df.withColumns({"__i": F.row_number().over(w.orderBy(order)) - 1, "__n": F.count("*").over(w)})


def drift(df: DataFrame, order: str = "chunk_order", score: str = "sentiment_score") -> DataFrame:
    """Per transcript: slope, intercept and fit over 0..n-1, halves, first and last quarter, range, peak and trough."""
    p = _placed(df, order)
    x, i, n = F.col(score), F.col("__i").cast("double"), F.col("__n")
    quarter = F.greatest(F.lit(1), F.floor(n / 4))
    half = F.floor(n / 2)
    part = lambda cond: F.avg(F.when(cond, x))
    out = p.groupBy("transcript_id").agg(
        F.count("*").alias("n"),
        F.coalesce(F.regr_slope(x, i), F.lit(0.0)).alias("slope"), F.coalesce(F.regr_intercept(x, i), F.avg(x)).alias("intercept"),
        F.coalesce(F.try_divide(F.pow(F.covar_pop(x, i), F.lit(2)), F.var_pop(x) * F.var_pop(i)), F.lit(0.0)).alias("r2"),
        part(F.col("__i") < quarter).alias("opening"), part(F.col("__i") >= n - quarter).alias("closing"),
        part(F.col("__i") < half).alias("first_half"), part(F.col("__i") >= half).alias("second_half"),
        F.avg(F.when((F.col("section_type") == "prepared") & x.isNotNull(), x)).alias("__prep"), F.avg(F.when(F.col("section_type") == "qa", x)).alias("__qa"),
        (F.max(x) - F.min(x)).alias("range"),
        F.max_by(F.col("__i"), F.struct(x, -F.col("__i"))).alias("peak_at"), F.min_by(F.col("__i"), F.struct(x, F.col("__i"))).alias("trough_at"),
    )
    return out.withColumns({"half_delta": F.col("second_half") - F.col("first_half"), "prepared_qa_delta": F.col("__prep") - F.col("__qa"), "opening_closing_delta": F.col("closing") - F.col("opening")}).drop("__prep", "__qa")


def acceleration(df: DataFrame, order: str = "chunk_order", score: str = "sentiment_score") -> DataFrame:
    """Slope of the second half less that of the first, and the mean of the last quarter's steps (momentum)."""
    p = _placed(df, order)
    w = Window.partitionBy("transcript_id").orderBy(order)
    p = p.withColumn("__step", F.col(score) - F.lag(score).over(w))
    i, half, quarter = F.col("__i").cast("double"), F.floor(F.col("__n") / 2), F.greatest(F.lit(1), F.floor(F.col("__n") / 4))
    slope = lambda cond: F.coalesce(F.regr_slope(F.when(cond, F.col(score)), F.when(cond, i)), F.lit(0.0))
    return p.groupBy("transcript_id").agg((slope(F.col("__i") >= half) - slope(F.col("__i") < half)).alias("acceleration"), F.coalesce(F.avg(F.when(F.col("__i") >= F.col("__n") - quarter, F.col("__step"))), F.lit(0.0)).alias("momentum"))


def rolling(df: DataFrame, order: str = "chunk_order", score: str = "sentiment_score", window: int = 5, spike: float = 0.5, key: str = "transcript_id") -> DataFrame:
    """Shift from the row before, spike flag, trailing mean and population deviation, running sum."""
    w = Window.partitionBy(key).orderBy(order)
    f = w.rowsBetween(-(window - 1), 0)
    shift = F.col(score) - F.lag(score).over(w)
    return df.withColumns({
        "local_shift": shift, "is_spike": F.coalesce(F.abs(shift) > spike, F.lit(False)),
        "rolling_mean": F.avg(score).over(f), "rolling_std": F.coalesce(F.stddev_pop(score).over(f), F.lit(0.0)),
        "cumulative": F.sum(score).over(w.rowsBetween(Window.unboundedPreceding, 0)),
    })


def smooth(df: DataFrame, alpha: float = 0.3, order: str = "chunk_order", score: str = "sentiment_score", key: str = "transcript_id") -> DataFrame:
    """Adds ``ema``: a fold over each document's rows."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        return pdf.assign(ema=pdf[score].astype("float64").ewm(alpha=alpha, adjust=False).mean())

    return df.groupBy(key).applyInPandas(fold, f"{df._jdf.schema().toDDL()}, ema double")


def prepared_qa_pivot(sections: DataFrame) -> DataFrame:
    """Section scores side by side with their difference."""
    wide = sections.groupBy("transcript_id").pivot("section_type", ["prepared", "qa"]).agg(F.first("score"))
    return wide.withColumn("delta", F.col("prepared") - F.col("qa"))


def group_contrast(df: DataFrame, column: str, left: str, right: str, score: str = "sentiment_score") -> DataFrame:
    """Means of two kinds of rows for each transcript that has one of them, and their difference."""
    mean = lambda v: F.avg(F.when(F.col(column) == v, F.col(score)))
    out = df.groupBy("transcript_id").agg(mean(left).alias(f"{left}_mean"), mean(right).alias(f"{right}_mean"))
    return out.filter(f"{left}_mean is not null or {right}_mean is not null").withColumn("delta", F.col(f"{left}_mean") - F.col(f"{right}_mean"))


def dominance(df: DataFrame, score: str = "sentiment_score") -> DataFrame:
    """Per speaker of a transcript: chunks, tokens, share of tokens, mean score, usual role, rank by score."""
    by = df.groupBy("transcript_id", "speaker", "speaker_role").agg(F.count("*").alias("k"), F.sum("token_count").alias("t"), F.sum(score).alias("s"))
    first = Window.partitionBy("transcript_id", "speaker").orderBy(F.col("k").desc(), "speaker_role")
    by = by.withColumn("__top", F.row_number().over(first))
    out = by.groupBy("transcript_id", "speaker").agg(F.max(F.when(F.col("__top") == 1, F.col("speaker_role"))).alias("role"), F.sum("k").alias("chunks"), F.sum("t").cast("long").alias("tokens"), (F.sum("s") / F.sum("k")).alias("mean_score"))
    total = F.sum("tokens").over(Window.partitionBy("transcript_id"))
    rank = F.row_number().over(Window.partitionBy("transcript_id").orderBy(F.round("mean_score", 9).desc(), "speaker"))
    return out.withColumns({"dominance": safe_divide(F.col("tokens"), total), "rank": rank})


def diagnostics(df: DataFrame, order: str = "chunk_order") -> DataFrame:
    """Per transcript: chunks, repeated and out-of-order ones, missing and extreme values, distinct names."""
    w = Window.partitionBy("transcript_id").orderBy("chunk_id")
    late = df.withColumn("__late", F.coalesce(F.col(order) < F.lag(order).over(w), F.lit(False)))
    return late.groupBy("transcript_id").agg(
        F.count("*").alias("chunks"), (F.count("*") - F.count_distinct("chunk_id")).alias("duplicates"), F.count_if("__late").alias("out_of_order"),
        F.count_if(F.col("sentiment_score").isNull()).alias("missing_scores"), F.count_if(F.abs("sentiment_score") > 0.9).alias("extreme_scores"),
        F.count_if(F.col("confidence") < 0.5).alias("low_confidence"), F.count_distinct("section_type").alias("sections"), F.count_distinct("speaker").alias("speakers"),
    )


def node_tree(df: DataFrame, score: str = "sentiment_score") -> DataFrame:
    """(node_id, parent_node_id, level, depth, score, n): root, section, speaker and chunk nodes of every transcript."""
    tid, sec, spk = F.col("transcript_id").cast("string"), F.col("section_type"), F.col("speaker")
    ids = [F.concat_ws("/", tid), F.concat_ws("/", tid, sec), F.concat_ws("/", tid, sec, spk), F.concat_ws("/", tid, sec, spk, F.col("chunk_id").cast("string"))]
    node = lambda d, level: F.struct(ids[d].alias("node_id"), (ids[d - 1] if d else F.lit(None).cast("string")).alias("parent_node_id"), F.lit(level).alias("level"), F.lit(d).alias("depth"))
    wide = df.select(F.explode(F.array(*[node(d, x) for d, x in enumerate(("transcript", "section", "speaker", "chunk"))])).alias("x"), F.col(score).alias("s"))
    return wide.groupBy("x.node_id", "x.parent_node_id", "x.level", "x.depth").agg(F.avg("s").alias("score"), F.count("*").alias("n"))


def children_of(tree: DataFrame, node_id: str) -> DataFrame:
    return tree.filter(F.col("parent_node_id") == node_id)


def ancestors_of(tree: DataFrame, node_id: str, most: int = 4) -> DataFrame:
    """The chain of parents, nearest first: a self-join for each step of the bounded depth."""
    now = tree.filter(F.col("node_id") == node_id).select(F.col("parent_node_id").alias("up"))
    out = None
    for k in range(most):
        step = now.join(tree, F.col("up") == F.col("node_id")).select(tree["*"], F.lit(k).alias("steps"))
        out = step if out is None else out.unionByName(step)
        now = step.select(F.col("parent_node_id").alias("up"))
    return out


def breadth_first(tree: DataFrame) -> DataFrame:
    """The order of a queue from the root: by depth, then by name."""
    return tree.orderBy("depth", "node_id")


def optimism_decay(df: DataFrame, order: str = "chunk_order", score: str = "sentiment_score") -> DataFrame:
    """Mean of the first half less that of the second, in the order of the position written as text."""
    w = Window.partitionBy("transcript_id")
    p = df.withColumns({"__i": F.row_number().over(w.orderBy(F.col(order).cast("string"))) - 1, "__n": F.count("*").over(w)})
    half = F.floor(F.col("__n") / 2)
    return p.groupBy("transcript_id").agg((F.coalesce(F.avg(F.when(F.col("__i") < half, F.col(score))), F.lit(0.0)) - F.coalesce(F.avg(F.when(F.col("__i") >= half, F.col(score))), F.lit(0.0))).alias("optimism_decay"))


def top_by(df: DataFrame, column: str | Column, n: int, *ties: str, absolute: bool = False) -> DataFrame:
    """The n rows with the largest value."""
    c = col(column)
    return df.orderBy((F.abs(c) if absolute else c).desc(), *ties).limit(n)


def label_counts(df: DataFrame, keys: list[str], score: str = "sentiment_score", threshold: float = 0.05) -> DataFrame:
    lab = label_strict(score, threshold)
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(score).alias("mean"), F.when(F.count("*") > 1, F.stddev_samp(score)).otherwise(0.0).alias("std"), *[F.count_if(lab == x).alias(x) for x in ("positive", "neutral", "negative")])

"""Dictionary-based tone: loading a lexicon, matching tokens, scoring and aggregating chunks.

A lexicon is a table (term, category); it is small, so tokens are matched by a
join that the planner broadcasts after checking its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import clip, finite, label_inclusive, label_strict, ratio01, safe_divide, tone

CATEGORIES = ("positive", "negative", "uncertainty", "litigious", "strong_modal", "weak_modal", "constraining")


def load(spark: SparkSession, path: str, removed_count: bool = True) -> DataFrame:
    """From a CSV with a column Word and a year or 0 for each category."""
    return from_wide(spark.read.option("header", True).csv(path), removed_count)


def from_wide(df: DataFrame, removed_count: bool = True) -> DataFrame:
    """(term, category): a value other than 0 makes a member; without ``removed_count`` only one above 0."""
    names = {c.lower().replace("_", ""): c for c in df.columns}
    pairs = [F.struct(F.lit(c).alias("category"), F.col(names[c.replace("_", "")]).cast("string").try_cast("double").alias("v")) for c in CATEGORIES if c.replace("_", "") in names]
    long = df.select(normalise_term(F.col(names["word"])).alias("term"), F.explode(F.array(*pairs)).alias("x")).select("term", "x.category", "x.v")
    member = (F.col("v") != 0) if removed_count else (F.col("v") > 0)
    return long.filter(member & (F.col("term") != "")).select("term", "category").distinct()


def from_sets(spark: SparkSession, sets: dict[str, list[str]]) -> DataFrame:
    rows = sorted({(w.lower(), c) for c, ws in sets.items() for w in ws})
    return spark.createDataFrame(rows, "term string, category string")


def normalise_term(c: Column) -> Column:
    return F.lower(F.btrim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[ \t\n\r]+", " ")))


def validate(lexicon: DataFrame) -> DataFrame:
    """Per category: terms, empty terms, repeats."""
    return lexicon.groupBy("category").agg(F.count("*").alias("terms"), F.count_if(F.coalesce(F.trim("term"), F.lit("")) == "").alias("empty"), (F.count("*") - F.count_distinct("term")).alias("repeats"))


def match(tokens: DataFrame, lexicon: DataFrame, keys: list[str], unique: bool = False) -> DataFrame:
    """Per key: tokens, matched tokens, coverage and a count for each category.

    ``tokens`` has an array ``tokens`` for each row of ``keys``.  A token in
    several categories is one matched token.  ``unique`` counts each term once.
    Tokens are counted by key and term before they meet the lexicon.
    """
    arr = F.array_distinct("tokens") if unique else F.col("tokens")
    totals = tokens.select(*keys, F.size(F.coalesce(arr, F.array().cast("array<string>"))).cast("long").alias("total_tokens"))
    sets = lexicon.groupBy("term").agg(F.collect_set("category").alias("cats"))
    each = tokens.select(*keys, F.explode(arr).alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("k"))
    hit = each.join(sets, "term")
    found = hit.groupBy(*keys).agg(F.sum("k").alias("matched_tokens"), *[F.sum(F.when(F.array_contains("cats", c), F.col("k"))).alias(f"{c}_count") for c in CATEGORIES])
    out = totals.join(found, keys, "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    out = out.select(*keys, "total_tokens", zero("matched_tokens"), *[zero(f"{c}_count") for c in CATEGORIES])
    return out.withColumn("coverage_ratio", ratio01("matched_tokens", "total_tokens"))


def top_terms(tokens: DataFrame, lexicon: DataFrame, keys: list[str], category: str, n: int = 10) -> DataFrame:
    """Per key the most frequent terms of a category, ties by term."""
    each = tokens.select(*keys, F.explode("tokens").alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("n"))
    hit = each.join(lexicon.filter(F.col("category") == category).select("term"), "term")
    return hit.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("n").desc(), "term"))).filter(F.col("rank") <= n).select(*keys, "rank", "term", "n")


def score(matched: DataFrame, alpha: float = 0.0, threshold: float = 0.02, scale: float = 1.0) -> DataFrame:
    """Adds tone, ratios, label and confidence; rows without tokens are "unknown"."""
    t = tone("positive_count", "negative_count", alpha)
    out = matched.withColumn("tone_score", t)
    out = out.withColumns({f"{c}_ratio": ratio01(f"{c}_count", "total_tokens") for c in ("positive", "negative", "uncertainty")})
    out = out.withColumn("net_ratio", clip(safe_divide(F.col("positive_count") - F.col("negative_count"), "total_tokens"), -1.0, 1.0))
    label = F.when(F.col("total_tokens") == 0, "unknown").otherwise(label_inclusive("tone_score", threshold))
    confidence = clip(F.col("coverage_ratio") * F.least(F.abs("tone_score"), F.lit(1.0)) * scale, 0.0, 1.0)
    return out.withColumns({"label": label, "confidence": confidence, "low_coverage": F.col("coverage_ratio") < 0.01})


def baseline_score(df: DataFrame, text: str, positive: list[str], negative: list[str]) -> DataFrame:
    """Words a-z of the lower-cased text against two lists, within one projection."""
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit("[a-z]+"), F.lit(0))
    count = lambda ws: F.size(F.filter("__w", lambda w: F.array_contains(F.array(*map(F.lit, ws)), w))).cast("long")
    out = df.withColumn("__w", words).withColumns({"pos": count(positive), "neg": count(negative), "words": F.size("__w").cast("long")})
    return out.withColumn("tone", tone("pos", "neg")).drop("__w")


def weight(strategy: str) -> Column:
    """uniform, token, coverage, or hybrid: tokens times coverage."""
    t, c = F.coalesce(finite("total_tokens"), F.lit(0.0)), F.coalesce(finite("coverage_ratio"), F.lit(0.0))
    return {"uniform": F.lit(1.0), "token": t, "coverage": c, "hybrid": t * c}[strategy]


def aggregate(df: DataFrame, keys: list[str], strategy: str = "token", threshold: float = 0.02) -> DataFrame:
    """Weighted mean and population deviation of the tone, median, label shares, totals.

    A group whose weights are all 0 counts its rows alike.  All are sums with
    partial aggregation, so that no group is gathered but for its median.
    """
    w, x = weight(strategy), F.col("tone_score")
    moments = lambda v, name: [F.sum(v).alias(f"__{name}0"), F.sum(F.when(x.isNotNull(), v)).alias(f"__{name}n"), F.sum(v * x).alias(f"__{name}1"), F.sum(v * x * x).alias(f"__{name}2")]
    lab = label_inclusive("tone_score", threshold, "neutral")
    out = df.groupBy(*keys).agg(
        *moments(w, "w"), *moments(F.lit(1.0), "u"), F.median("tone_score").alias("median_tone"),
        *[F.avg((lab == x).cast("double")).alias(f"{x}_share") for x in ("positive", "neutral", "negative")],
        F.count("*").alias("chunk_count"), F.sum("total_tokens").alias("total_tokens"), *[F.sum(F.coalesce(f"{c}_count", F.lit(0))).alias(f"{c}_total") for c in CATEGORIES],
    )
    pick = {k: F.when(F.col("__w0") == 0, F.col(f"__u{k}")).otherwise(F.col(f"__w{k}")) for k in ("0", "n", "1", "2")}
    mean = F.try_divide(pick["1"], pick["0"])
    spread = F.try_divide(pick["2"] - 2 * mean * pick["1"] + mean * mean * pick["n"], pick["0"])
    out = out.withColumns({"mean_tone": mean, "std_tone": F.sqrt(F.greatest(spread, F.lit(0.0)))}).drop(*[f"__{v}{k}" for v in "wu" for k in pick])
    return out.withColumn("label", label_inclusive("mean_tone", threshold, "neutral"))


def aggregate_generic(df: DataFrame, keys: list[str], scores: list[str], tokens: str = "total_tokens", carry: list[str] | None = None) -> DataFrame:
    """Mean, median, deviation and sum of each score column, and the token-weighted tone."""
    aggs: list[Column] = []
    for c in scores:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.median(c).alias(f"{c}_median"), F.stddev_samp(c).alias(f"{c}_std"), F.sum(c).alias(f"{c}_sum")]
    w = F.sum(tokens)
    weighted = F.when(w > 0, F.try_divide(F.sum(F.col("tone_score") * F.col(tokens)), w)).otherwise(F.avg("tone_score"))
    first = [F.min(c).alias(c) for c in carry or []]
    return df.groupBy(*keys).agg(*aggs, F.count(tokens).alias("chunks"), F.sum(tokens).alias("tokens"), weighted.alias("weighted_tone"), *first).withColumn("label", label_strict("weighted_tone", 0.02))


def histogram(df: DataFrame, column: str, low: float = -1.0, high: float = 1.0, bins: int = 10) -> DataFrame:
    """(bin, n): equal bins, the last one closed; values beyond the bounds are left out."""
    x = F.col(column)
    b = F.least(F.floor((x - low) / ((high - low) / bins)), F.lit(bins - 1))
    return df.filter(x.between(low, high)).groupBy(b.cast("long").alias("bin")).agg(F.count("*").alias("n"))


def coverage_summary(df: DataFrame, threshold: float = 0.05) -> DataFrame:
    """One row: mean, median and deviation of the coverage, rows below the threshold and at 0, coverage of the corpus."""
    c = F.col("coverage_ratio")
    return df.agg(F.avg(c).alias("mean"), F.median(c).alias("median"), F.stddev_samp(c).alias("std"), F.count_if(c < threshold).alias("low"), F.count_if(c == 0).alias("zero"), safe_divide(F.sum("matched_tokens"), F.sum("total_tokens")).alias("corpus"))

"""Model-backed scoring: any function from texts to probabilities, run over Arrow batches; and classifiers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import finite, safe_divide
from ..functions.text import words

#: Words that the keyword model counts.
POSITIVE = ["grew", "growth", "record", "strong", "increased", "beat", "exceeded", "margin", "raised", "guidance", "optimistic", "confident", "opportunity", "momentum", "outperform"]
NEGATIVE = ["decline", "decreased", "miss", "shortfall", "risk", "uncertainty", "headwind", "challenged", "slowdown", "concern", "pressure", "difficult", "lower", "reduced"]

Model = Callable[[list[str]], list[tuple[float, float, float]]]


def keyword_probs(text: Column, positive: list[str] = POSITIVE, negative: list[str] = NEGATIVE, step: float = 0.5, neutral: float = 1.5, head: int = 50, scale: float = 100_000.0) -> list[Column]:
    """(positive, neutral, negative) of a deterministic stand-in model.

    Each distinct keyword adds ``step`` to a weight of 1, and the MD5 of the first
    ``head`` bytes adds a hundredth part of a thousandth at most.
    """
    t = F.array_distinct(words(F.lower(text)))
    hits = lambda ws: F.size(F.array_intersect(t, F.array(*map(F.lit, ws))))
    p, n = 1.0 + step * hits(positive), 1.0 + step * hits(negative)
    total = p + n + neutral
    p, n = F.round(p / total, 6), F.round(n / total, 6)
    h = F.md5(F.substring(text.cast("binary"), 1, head))
    part = lambda at: F.conv(F.substring(h, at, 16), 16, 10).cast("decimal(20,0)") % 100
    shift = ((part(1) * 16 + part(17)) % 100).cast("double") / scale  # 2^64 leaves 16 over 100
    up = F.least(F.lit(1.0), p + shift)
    total = up + n + F.round(1.0 - p - n, 6)
    return [up / total, 1.0 - up / total - n / total, n / total]


def softmax(logits: Column) -> Column:
    """An array scaled to probabilities, shifted by its largest value first."""
    top = F.array_max(logits)
    raw = F.transform(logits, lambda x: F.exp(x - top))
    return F.transform(raw, lambda x: x / F.aggregate(raw, F.lit(0.0), lambda a, y: a + y))


def resilient(model: Model, retries: int = 3, delay: float = 1.0, wait: Callable[[float], None] | None = None) -> Model:
    """``model`` with a batch that runs out of memory halved, and other errors tried again after doubling delays."""
    import time

    pause = wait or time.sleep

    def run(texts: list[str]) -> list[tuple[float, float, float]]:
        for attempt in range(retries + 1):
            try:
                return list(model(texts))
            except MemoryError:
                if len(texts) < 2:
                    raise
                half = len(texts) // 2
                return run(texts[:half]) + run(texts[half:])
            except Exception:
                if attempt == retries:
                    raise
                pause(delay * 2**attempt)
        return []

    return run


def score_missing(df: DataFrame, cached: DataFrame, keys: list[str], score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Scores of ``df``'s rows: those that ``cached`` has by ``keys`` (such as id and model), and new ones by ``score``.

    Rows of ``cached`` for other keys are left out; of rows that repeat a key one counts.
    """
    wanted = df.dropDuplicates(keys)
    old = cached.dropDuplicates(keys).join(wanted.select(*keys), keys, "left_semi")
    return old.unionByName(score(wanted.join(cached.select(*keys).distinct(), keys, "left_anti")).select(*old.columns))


def assemble(df: DataFrame, probs: list[Column], digits: int = 8, valid: Column | None = None) -> DataFrame:
    """Score (positive less negative), confidence (largest), label, and neutral rows for texts that were skipped."""
    names = ["positive_prob", "neutral_prob", "negative_prob"]
    ok = valid if valid is not None else F.lit(True)
    out = df.withColumns({n: F.round(F.when(ok, p).otherwise(1.0 if n == "neutral_prob" else 0.0), digits) for n, p in zip(names, probs, strict=True)})
    label = F.when((F.col("positive_prob") >= F.col("neutral_prob")) & (F.col("positive_prob") >= F.col("negative_prob")), "positive").when(F.col("negative_prob") > F.col("neutral_prob"), "negative").otherwise("neutral")
    return out.withColumns({"sentiment_score": F.round(F.col("positive_prob") - F.col("negative_prob"), digits), "confidence": F.when(ok, F.greatest(*names)).otherwise(0.0), "predicted_label": F.when(ok, label).otherwise("neutral"), "was_skipped": ~ok})


def score_with_keywords(df: DataFrame, text: str, positive: list[str] = POSITIVE, negative: list[str] = NEGATIVE, least: int = 3) -> DataFrame:
    valid = F.length(F.trim(F.coalesce(F.col(text), F.lit("")))) >= least
    return assemble(df, keyword_probs(F.coalesce(F.col(text), F.lit("")), positive, negative), valid=valid)


def score_with_model(df: DataFrame, key: str, text: str, load: Callable[[], Model], batch: int = 64, least: int = 3) -> DataFrame:
    """(key, probabilities, score, confidence, label): ``load`` builds the model once for each task."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for pdf in batches:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                texts = [t or "" for t in part[text]]
                got = iter(model([t for t in texts if len(t.strip()) >= least]))
                probs = [next(got) if len(t.strip()) >= least else (None, None, None) for t in texts]
                yield pd.DataFrame({key: part[key].to_numpy(), "p": [x[0] for x in probs], "u": [x[1] for x in probs], "n": [x[2] for x in probs]})

    raw = df.select(key, text).mapInPandas(run, f"{key} {kind}, p double, u double, n double")
    return assemble(raw, [F.col("p"), F.col("u"), F.col("n")], valid=finite("p").isNotNull()).drop("p", "u", "n")


def split(df: DataFrame, key: str, share: float = 0.3, seed: int = 42) -> DataFrame:
    """Adds ``is_test`` by a seeded hash of the key, so that reruns and larger tables agree."""
    return df.withColumn("is_test", F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(10_000)) < int(share * 10_000))


def train_classifiers(df: DataFrame, features: list[str], target: str, key: str, least: int = 10) -> DataFrame:
    """(model, status, accuracy, precision, recall, f1): three kinds of classifiers, or why they weren't trained."""
    from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    from .joins import classification_report

    spark = df.sparkSession
    seen = df.filter(F.col(target).isNotNull()).agg(F.count("*").alias("n"), F.count_distinct(target).alias("k")).first()
    names = ["logistic_regression", "random_forest", "gradient_boosting"]
    status = "insufficient_sample_size" if seen["n"] < least else "single_class_target" if seen["k"] < 2 else "trained"
    if status != "trained":
        return spark.createDataFrame([(m, status, None, None, None, None) for m in names], "model string, status string, accuracy double, precision double, recall double, f1 double")
    data = VectorAssembler(inputCols=features, outputCol="features").transform(split(df.filter(F.col(target).isNotNull()), key, 0.3 if seen["n"] >= 20 else 0.25)).withColumn("label", F.col(target).cast("double"))
    train, test = data.filter(~F.col("is_test")), data.filter("is_test")
    out = None
    for name, m in zip(names, (LogisticRegression(maxIter=50), RandomForestClassifier(numTrees=20, seed=42), GBTClassifier(maxIter=10, seed=42)), strict=True):
        got = m.fit(train).transform(test).select(F.col("prediction").cast("int").alias("p"), F.col("label").cast("int").alias("a"))
        row = classification_report(got, "p", "a").select(F.lit(name).alias("model"), F.lit("trained").alias("status"), "accuracy", "precision", "recall", "f1")
        out = row if out is None else out.unionByName(row)
    return out


def stratified_split(df: DataFrame, key: str, label: str, share: float = 0.3, seed: int = 42) -> DataFrame:
    """Adds ``is_test`` so that about ``share`` of each label's rows are in the test: those with the least seeded hashes."""
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 40))
    cut = df.groupBy(label).agg(F.percentile_approx(draw, share, 10_000).alias("__cut"))
    return df.join(cut.withColumnRenamed(label, "__label"), F.col(label).eqNullSafe(F.col("__label"))).withColumn("is_test", draw <= F.col("__cut")).drop("__cut", "__label")


def binary_target(c: Column | str) -> Column:
    """1 above 0, else 0; null stays null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c > 0, 1).when(c.isNotNull(), 0)


def keyword_count(c: Column | str) -> Column:
    """How many keywords a comma-separated list has."""
    c = F.col(c) if isinstance(c, str) else c
    return F.size(F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), F.trim), lambda w: w != ""))


def modelling_frame(df: DataFrame, key: str, features: list[str], target: str) -> DataFrame:
    """(key, features with medians for what is missing, ``target`` as 0 or 1), without rows that lack the target."""
    from .stats import median_fill

    kept = df.select(key, *[finite(f).alias(f) for f in features], binary_target(finite(target)).alias("target")).filter("target is not null")
    return median_fill(kept, features)


def feature_importance(rows: DataFrame, weight: str = "coefficient", feature: str = "feature") -> DataFrame:
    """Largest absolute weights first, ties by name."""
    return rows.orderBy(F.abs(weight).desc(), feature)


def skip_rate(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("rows"), F.count_if("was_skipped").alias("skipped"), safe_divide(F.count_if("was_skipped"), F.count("*")).alias("rate"))

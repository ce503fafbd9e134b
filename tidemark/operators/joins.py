"""Merging layers by key: guarded left joins, the master table, comparison of two scorers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import corr_guarded, direction, finite, label_strict, safe_divide, to_number, truthy


def rename_aliases(df: DataFrame, mapping: dict[str, list[str]]) -> DataFrame:
    """Each target is the first value among its aliases, in the order of the columns; the aliases go."""
    out = df
    for target, names in mapping.items():
        found = [c for c in df.columns if c == target or c in names]
        if found:
            out = out.withColumn("__t", F.coalesce(*[F.col(c) for c in found])).drop(*found).withColumnRenamed("__t", target)
    return out


def ensure_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Missing columns are added as null of the given type."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns})


def conform(df: DataFrame, schema: dict[str, str], extras: bool = True) -> DataFrame:
    """The schema's columns, cast and in order; others behind them or left out."""
    full = ensure_columns(df, schema)
    rest = [c for c in df.columns if c not in schema] if extras else []
    return full.select(*[F.col(c).cast(t).alias(c) for c, t in schema.items()], *rest)


def select_existing(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[c for c in columns if c in df.columns])


def require(df: DataFrame, columns: list[str], context: str = "") -> DataFrame:
    """Fails before any plan runs where a column is missing."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"{context or 'input'} lacks {missing}")
    return df


def numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: to_number(c) for c in columns if c in df.columns})


def dedupe(df: DataFrame, keys: list[str], order: list, keep: str = "first") -> DataFrame:
    """One row for each key: the first or the last in the given order."""
    by = [c if keep == "first" else (F.col(c).desc() if isinstance(c, str) else c.desc()) for c in order]
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).filter("__k = 1").drop("__k")


def left_merge(base: DataFrame, incoming: DataFrame, key: str, order: list, prefix: str | None = None) -> DataFrame:
    """A left join that never multiplies rows: the right side has one row for each key, and no column twice."""
    right = dedupe(incoming.filter(F.col(key).isNotNull()), [key], order)
    right = right.select(key, *[F.col(c).alias(f"{prefix}{c}" if prefix else c) for c in right.columns if c != key and (prefix or c not in base.columns)])
    return base.join(right, key, "left")


def master(transcripts: DataFrame, layers: list[tuple[DataFrame, list]], key: str = "transcript_id") -> DataFrame:
    """All layers joined to the left of each transcript."""
    out = transcripts
    for df, order in layers:
        out = left_merge(out, df, key, order)
    return out


def merge_report(merged: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row: rows, distinct keys, whether keys repeat, and the share of rows with each column."""
    return merged.agg(F.count("*").alias("rows"), F.count_distinct(key).alias("keys"), (F.count("*") > F.count_distinct(key)).alias("repeats"), *[F.avg(F.col(c).isNotNull().cast("double")).alias(f"{c}_coverage") for c in columns])


def fill(df: DataFrame, scores: list[str] | None = None, labels: list[str] | None = None) -> DataFrame:
    """Scores as 0, labels as neutral, each only where asked for."""
    return df.fillna({**{c: 0.0 for c in scores or []}, **{c: "neutral" for c in labels or []}})


def compare_scorers(df: DataFrame, left: str, right: str, gap: float = 0.5) -> DataFrame:
    """Labels, directions, agreement (false where one is missing), differences and a flag for divergence."""
    a, b = finite(left), finite(right)
    agree = F.coalesce(direction(a) == direction(b), F.lit(False))
    out = df.withColumns({"left_label": label_strict(a), "right_label": label_strict(b), "directional_agreement": agree, "score_difference": a - b})
    return out.withColumns({"absolute_difference": F.abs("score_difference"), "divergence_flag": ~F.col("directional_agreement") | F.coalesce(F.abs("score_difference") > gap, F.lit(False))})


def comparison_summary(df: DataFrame, left: str, right: str) -> DataFrame:
    """(metric, value) of a comparison."""
    wide = df.agg(
        F.count("*").cast("double").alias("rows"), F.avg(F.col("directional_agreement").cast("double")).alias("agreement_rate"), F.avg("score_difference").alias("mean_difference"),
        F.avg("absolute_difference").alias("mean_absolute_difference"), F.avg(F.col("divergence_flag").cast("double")).alias("divergence_rate"), corr_guarded(left, right).alias("correlation"),
    )
    return long_metrics(wide)


def long_metrics(wide: DataFrame) -> DataFrame:
    """One row of numbers as (metric, value) rows."""
    return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in wide.columns])).alias("m")).select("m.*")


def orphans(fine: DataFrame, coarse: DataFrame, key: str) -> DataFrame:
    return fine.join(coarse.select(key).distinct(), key, "left_anti")


def keep_valid(df: DataFrame, report: DataFrame, key: str, ok: str = "is_valid") -> DataFrame:
    return df.join(report.filter(ok).select(key).distinct(), key, "left_semi")


def count_consistency(fine: DataFrame, coarse: DataFrame, key: str, count: str) -> DataFrame:
    """Keys whose number of fine rows isn't what the coarse row says."""
    n = fine.groupBy(key).agg(F.count("*").alias("actual"))
    return coarse.select(key, F.col(count).cast("long").alias("stated")).join(n, key, "left").withColumn("actual", F.coalesce("actual", F.lit(0).cast("long"))).filter("actual != stated")


def mean_consistency(fine: DataFrame, coarse: DataFrame, key: str, value: str, stated: str, tolerance: float = 1e-6) -> DataFrame:
    n = fine.groupBy(key).agg(F.avg(value).alias("actual"))
    return coarse.select(key, F.col(stated).alias("stated")).join(n, key).filter(F.abs(F.col("actual") - F.col("stated")) > tolerance)


def lookup(df: DataFrame, dim: DataFrame, key: str, value: str, default: str) -> DataFrame:
    """A column of a small dimension, ``default`` where the key isn't in it."""
    return df.join(dim.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def mean_of_flags(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.avg(truthy(column).cast("double")).alias("rate"))


def class_counts(df: DataFrame, predicted: str, actual: str, labels: list) -> DataFrame:
    """The confusion table: a row for each prediction, a column for each label."""
    return df.groupBy(predicted).pivot(actual, labels).count().na.fill(0)


def classification_report(df: DataFrame, predicted: str, actual: str) -> DataFrame:
    """Accuracy, precision, recall and F1 of a 0/1 prediction, and the area under the curve if the prediction is a score."""
    tp, fp, fn, tn = (F.count_if((F.col(predicted) == p) & (F.col(actual) == a)) for p, a in ((1, 1), (1, 0), (0, 1), (0, 0)))
    out = df.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"))
    p, r = safe_divide("tp", F.col("tp") + F.col("fp")), safe_divide("tp", F.col("tp") + F.col("fn"))
    return out.withColumns({"accuracy": safe_divide(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")), "precision": p, "recall": r, "f1": safe_divide(2 * p * r, p + r)})

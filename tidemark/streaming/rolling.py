"""Streaming forms: windowed aggregates under a watermark, and per-document running scores."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed(stream: DataFrame, ts: str = "ts", key: str = "event_type", value: str = "value", late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Count and sum by key and tumbling window; rows later than the watermark are dropped."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width), key).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), key, "n", "total")


def sessions(stream: DataFrame, ts: str = "ts", key: str = "user_id", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")


def running_scores(stream: DataFrame, key: str = "transcript_id", order: str = "chunk_order", score: str = "sentiment_score", alpha: float = 0.3) -> DataFrame:
    """Per document and batch: rows so far, running sum, exponential mean and the last score, kept as state."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total, ema, last = state.get if state.exists else (0, 0.0, None, None)
        pdf = pd.concat(list(batches)).sort_values(order, kind="stable")
        for x in pdf[score]:
            n, total, last = n + 1, total + x, x
            ema = x if ema is None else alpha * x + (1 - alpha) * ema
        state.update((n, total, ema, last))
        yield pd.DataFrame({key: [k[0]], "n": [n], "cumulative": [total], "ema": [ema], "last_score": [last]})

    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, n long, cumulative double, ema double, last_score double", "n long, total double, ema double, last double", "update", GroupStateTimeout.NoTimeout)

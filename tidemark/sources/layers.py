"""Inputs chosen among layers, configuration, retries, and the health of a run's tables."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from .io import read_table


@dataclass
class PipelineConfig:
    """What a run of the pipelines needs; unknown keys of a file are an error."""

    tickers: list[str] = field(default_factory=list)
    start: str = "2000-01-01"
    end: str = "2100-01-01"
    benchmark: str = "SPY"
    horizons: list[int] = field(default_factory=lambda: [1, 3, 5])
    pre: int = 5
    post: int = 10
    out: str = "out"


def load_config(path: str) -> PipelineConfig:
    """From a JSON file, or a YAML file where a YAML reader is installed."""
    with open(path) as f:
        if path.endswith((".yaml", ".yml")):
            import yaml

            given = yaml.safe_load(f) or {}
        else:
            given = json.load(f)
    known = {x.name for x in fields(PipelineConfig)}
    if unknown := set(given) - known:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    return PipelineConfig(**given)


def retry[T](call: Callable[[], T], tries: int = 3, delay: float = 1.0, factor: float = 2.0, wait: Callable[[float], None] = time.sleep) -> T:
    """``call()``, tried again after growing delays; the last error is raised."""
    for i in range(tries):
        try:
            return call()
        except Exception:
            if i + 1 == tries:
                raise
            wait(delay * factor**i)
    raise ValueError("tries must be positive")


def first_usable(spark: SparkSession, paths: list[str], columns: list[str]) -> DataFrame | None:
    """The first of the tables that is there, has all the columns and a row; None if none has."""
    for p in paths:
        try:
            df = read_table(spark, p)
        except Exception:
            continue
        if set(columns) <= set(df.columns) and not df.limit(1).isEmpty():
            return df
    return None


def segments_as_chunks(segments: DataFrame, key: str = "transcript_id", order: str = "order_index", text: str = "text") -> DataFrame:
    """Turns in the place of chunks: ids made of key and order, tokens counted by blanks."""
    name = F.concat_ws("_", F.col(key).cast("string"), F.lit("seg"), F.lpad(F.col(order).cast("string"), 4, "0"))
    rest = [c for c in segments.columns if c not in (order, text)]
    return segments.select(*rest, name.alias("chunk_id"), F.col(order).alias("chunk_order"), F.col(text).alias("chunk_text"), tx.word_count(text).alias("token_count"))


def lexicon_input(spark: SparkSession, chunk_paths: list[str], segment_paths: list[str]) -> DataFrame | None:
    """Chunks where a table of them is there, else turns seen as chunks, else None."""
    chunks = first_usable(spark, chunk_paths, ["chunk_id", "chunk_text"])
    if chunks is not None:
        return chunks
    turns = first_usable(spark, segment_paths, ["transcript_id", "order_index", "text"])
    return None if turns is None else segments_as_chunks(turns)


def artifact_health(spark: SparkSession, tables: dict[str, str]) -> DataFrame:
    """(name, path, status, rows, columns): "ok", "empty" or "missing" for each table of a run."""
    out = []
    for name, path in tables.items():
        try:
            df = read_table(spark, path)
            n = df.count()
            out.append((name, path, "ok" if n else "empty", n, len(df.columns)))
        except Exception:
            out.append((name, path, "missing", 0, 0))
    return spark.createDataFrame(out, "name string, path string, status string, rows long, columns int")

"""Tables and JSON in and out, and SQL over files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(p)
    return found is not None and len(found) > 0


def read_table(spark: SparkSession, path: str, schema: StructType | str | None = None, required: bool = True) -> DataFrame | None:
    """Reads by suffix; a stem without suffix tries .parquet, then .csv.  Missing: an error if required, else None."""
    reader = spark.read.schema(schema) if schema else spark.read
    candidates = [path] if path.endswith((".parquet", ".csv", ".json", ".jsonl")) else [f"{path}.parquet", f"{path}.csv"]
    for p in candidates:
        if _exists(spark, p):
            if p.endswith(".parquet"):
                return reader.parquet(p)
            if p.endswith(".csv"):
                return reader.option("header", True).option("multiLine", True).option("escape", '"').csv(p)
            return reader.json(p)
    if required:
        raise FileNotFoundError(f"none of {candidates}")
    return None


def write_table(df: DataFrame, stem: str, csv: bool = False, parquet: bool = True, overwrite: bool = True, compression: str = "snappy", partition_by: list[str] | None = None, float_digits: int | None = None) -> list[str]:
    """Writes the chosen formats and returns their paths; Spark's commit makes each appear whole or not at all."""
    mode, out = "overwrite" if overwrite else "errorifexists", []
    if parquet:
        w = df.write.mode(mode).option("compression", compression)
        (w.partitionBy(*partition_by) if partition_by else w).parquet(f"{stem}.parquet")
        out.append(f"{stem}.parquet")
    if csv:
        flat = df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else (F.round(c, float_digits).alias(c) if float_digits is not None and t in ("double", "float") else F.col(c)) for c, t in df.dtypes])
        flat.write.mode(mode).option("header", True).csv(f"{stem}.csv")
        out.append(f"{stem}.csv")
    return out


def write_jsonl(df: DataFrame, path: str, overwrite: bool = True) -> None:
    df.write.mode("overwrite" if overwrite else "errorifexists").json(path)


def read_json(path: str, default=None):
    """A driver-side document; ``default`` if it's missing or malformed."""
    try:
        with open(path, encoding="utf-8") as f:
            return json.load(f)
    except (OSError, ValueError):
        return default


def write_json(data, path: str) -> None:
    """Keys in a fixed order, numbers that aren't finite as null."""
    with open(path, "w", encoding="utf-8") as f:
        json.dump(sanitise(data), f, indent=2, sort_keys=True, ensure_ascii=False, default=str)


def sanitise(value):
    if isinstance(value, dict):
        return {str(k): sanitise(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [sanitise(v) for v in value]
    if isinstance(value, float) and not (value - value == 0):
        return None
    return value


def list_files(spark: SparkSession, directory: str, pattern: str = "*") -> list[str]:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{directory}/{pattern}")
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p) or []
    return sorted(x.getPath().toString() for x in found)


def register_views(spark: SparkSession, tables: dict[str, str]) -> None:
    """Temp views of Parquet paths, for ``query``."""
    for name, path in tables.items():
        spark.read.parquet(path).createOrReplaceTempView(name)


def query(spark: SparkSession, sql: str) -> DataFrame:
    """SQL over views, or over files as parquet.`path`."""
    return spark.sql(sql)


def first_existing(spark: SparkSession, *paths: str) -> str | None:
    return next((p for p in paths if _exists(spark, p)), None)


def export_documents(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(key, json): one JSON document for each key with its rows in order, numbers that aren't finite as null."""
    clean = df.select(*[F.when(~F.isnan(c) & (F.abs(F.col(c)) < float("inf")), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])
    rest = [c for c in df.columns if c != key]
    rows = F.transform(F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("o"), F.struct(*rest).alias("r")))), lambda x: x["r"])
    return clean.groupBy(key).agg(F.to_json(rows).alias("json"))

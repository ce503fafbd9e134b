"""Shared folder, intermediate tables and small column helpers."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import string
import tempfile
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts define it: [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only a local session may lack the setting; it gets a temporary folder that
    goes when Python ends.  On a cluster an unset folder is an error, as files
    in a machine's own folder are not seen elsewhere.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder shared by driver and executors")
    global _OWN
    if _OWN is None:
        _OWN = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, _OWN, True)
    return f"file://{_OWN}"


_OWN: str | None = None


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder."""
    return f"{work_dir(spark)}/tidemark/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str, batch_rows: int = 2_000) -> DataFrame:
    """Writes ``df`` in the shared folder and reads it back.

    This cuts the lineage so that a lost executor costs no recomputation of what
    came before, and gives the planner the true size of the table, so that it
    broadcasts only what fits ``spark.sql.autoBroadcastJoinThreshold``.  The files
    of the shuffles that made the table go as soon as it stands.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    bound_batches(spark)
    with setting(spark, _CLEANUP, "true"), arrow_rows(spark, batch_rows):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tables = [path]
    return out


#: Bytes of an Arrow batch that goes to a Python worker, and rows that the Parquet reader decodes at once: rows are whole texts.
BATCH_BYTES, READ_ROWS = 4 << 20, 1024


def bound_batches(spark: SparkSession) -> None:
    """From now on the session's batches are no larger than these bounds, as results are lazy plans that run later."""
    for key, most in (("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES), ("spark.sql.parquet.columnarReaderBatchSize", READ_ROWS)):
        now = str(spark.conf.get(key)).lower().rstrip("b")
        size = int(now[:-1]) << {"k": 10, "m": 20, "g": 30}[now[-1]] if now[-1:] in ("k", "m", "g") else int(now)
        if not 0 < size <= most:
            spark.conf.set(key, str(most))


_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """``key`` is ``value`` for the plans that run inside."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Fewer rows in an Arrow batch for plans that run inside: rows here are whole texts or sets."""
    before = spark.conf.get(_ROWS)
    with setting(spark, _ROWS, str(min(rows, int(before)) if int(before) > 0 else rows)):
        yield


def release() -> None:
    """Gives a worker's freed memory back to the system, as idle workers stay for the next stage."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def delete(*frames: DataFrame) -> None:
    """Deletes materialized tables (or those behind a frame that names them in ``_tables``) that no later plan reads."""
    for df in frames:
        spark = df.sparkSession
        for path in getattr(df, "_tables", []):
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """``names``, each lengthened until no column of ``taken`` has it (Spark's names ignore case)."""
    used, out = {x.lower() for x in taken}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


#: Most 64-bit words of a key filter (8 MB), bits for a key, and words of one row while it is made.
FILTER_WORDS, FILTER_BITS, _FILTER_ROW = 1 << 20, 10, 512


def key_filter(keys: DataFrame) -> Callable[[Column], Column]:
    """A Bloom filter of the one column of ``keys`` (a table of 64-bit hashes), as a test of a column of hashes.

    It has one bit for each hash and grows with their number up to ``FILTER_WORDS``,
    so it fits any memory; with still more keys it only lets more rows through.  It
    saves shuffling the rows that it holds back, and an exact join must follow.
    """
    spark, h = keys.sparkSession, F.col(keys.columns[0])
    n = max(_FILTER_ROW, min(FILTER_WORDS, 1 << (keys.count() * FILTER_BITS // 64).bit_length()))
    word = lambda x: F.pmod(x, F.lit(n)).cast("int")
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(x, 40).bitwiseAND(F.lit(63)).cast("int"))
    empty = spark.range(0, n, 1, 1 + n // 65_536).select(F.col("id").cast("int").alias("w"), F.lit(0).cast("long").alias("m"))
    words = keys.select(word(h).alias("w"), bit(h).alias("m")).union(empty).groupBy("w").agg(F.expr("bit_or(m)").alias("m"))
    in_order = lambda c: F.transform(F.array_sort(c), lambda x: x["m"])
    rows = words.groupBy(F.floor(F.col("w") / _FILTER_ROW).alias("w")).agg(in_order(F.collect_list(F.struct(F.pmod("w", F.lit(_FILTER_ROW)).alias("w"), "m"))).alias("m"))
    bits = materialize(rows.agg(F.flatten(in_order(F.collect_list(F.struct("w", "m")))).alias("bits")), "key-filter")
    return lambda x: F.get(bits.scalar(), word(x)).bitwiseAND(bit(x)) != 0


def within(rows: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """The rows whose ``key``, a 64-bit hash, may be among ``keys``, without a shuffle of ``rows``."""
    may_be = key_filter(keys)
    return rows.filter(may_be(key))


def without(rows: DataFrame, gone: DataFrame, key: Column, gone_key: Column, same: Column) -> DataFrame:
    """``rows`` less those of which ``same`` holds with a row of ``gone``; only rows that the key filter lets through are shuffled.

    ``key`` and ``gone_key`` are hashes that agree wherever ``same`` holds.
    """
    may_be = key_filter(gone.select(gone_key))
    return rows.filter(~may_be(key)).unionByName(rows.filter(may_be(key)).join(gone, same, "left_anti"))


def lower_ascii(c: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def shared_fs(uri: str):
    """(file system, path) of pyarrow for a folder's URI; a bare path is local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def small_table(spark: SparkSession, columns: dict[str, tuple]) -> DataFrame:
    """A table from (values, Arrow type) of each column, which takes no Python worker to make."""
    import pyarrow as pa

    return spark.createDataFrame(pa.table({k: pa.array(v, t) for k, (v, t) in columns.items()}))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

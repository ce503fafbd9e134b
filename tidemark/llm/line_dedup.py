"""Line de-duplication over a corpus, with DataFrame functions only.

1. Lines are hashed (128 bits); hashes are counted with partial sums, so a line
   that stands in a third of all documents costs each task one row.
2. Only lines whose hash repeats are kept as (hash, document, position); they are
   range-partitioned by hash and document and sorted by hash, document and
   position.  As the document is part of the range, a hot hash spreads over many
   ranges.  First occurrences are read off this order in a stream.
3. What goes is returned for each document as the runs of lines that stay (a
   run-length coded bitmap), never as text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, lower_ascii, materialize

RUNS = "array<struct<start:int,len:int>>"


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased."""
    return lower_ascii(F.btrim(line, F.lit(BLANKS)))


def _documents(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """A document is known by its id and its text's hash, so that rows with one id don't mix."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(t).alias("th"), t.alias("text"))


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    lines = docs.select("doc_id", "th", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    keyed = lines.select("doc_id", "th", "pos", line_key(F.col("line")).alias("key")).filter(F.length("key") >= max(1, min_chars))
    return keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc_id", "th", "pos")


def keep_runs(n: Column, dropped: Column) -> Column:
    """Runs of the positions 0..n-1 that are not in ``dropped`` (ascending)."""
    edges = F.concat(F.array(F.lit(-1)), dropped, F.array(n))
    gaps = F.transform(F.sequence(F.lit(1), F.size(dropped) + 1), lambda i: F.struct((F.element_at(edges, i) + 1).alias("start"), (F.element_at(edges, i + 1) - F.element_at(edges, i) - 1).alias("len")))
    return F.filter(gaps, lambda r: r["len"] > 0).cast(RUNS)


def line_bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep: str = "none", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document with lines to drop: ``doc_id``, ``th``, ``n_dropped``, ``keep_runs``.

    A line goes if at least ``min_docs`` documents hold its key; ``keep="first"``
    keeps the first occurrence (smallest document, then position), ``"none"``
    keeps none.  Lines whose key has under ``min_chars`` code points (and empty
    ones always) stay.  Documents without a row lose nothing.  Null text is one
    empty line; a null id is an id like others; repeated rows are one document.
    """
    if keep not in ("none", "first"):
        raise ValueError("keep is 'none' or 'first'")
    base = _documents(docs, doc_id, text)
    counted = _lines(base, min_chars).groupBy("h1", "h2").agg(F.count("*").alias("n"))
    # a line in min_docs documents occurs min_docs times at least
    repeated = materialize(counted.filter(F.col("n") >= max(min_docs, 1)).select("h1", "h2"), "lines-repeated")
    matched = materialize(_lines(base, min_chars).join(repeated, ["h1", "h2"]), "lines-matched")
    order = ["h1", "h2", "doc_id", "th"]
    ranged = matched.repartitionByRange(*order).sortWithinPartitions(*order, "pos")
    seen = Window.partitionBy(*order).orderBy("pos")
    stream = ranged.withColumn("first", (F.row_number().over(seen) == 1).cast("int"))
    found = stream.filter("first = 1").groupBy("h1", "h2").agg(F.count("*").alias("docs"), F.min(F.struct("doc_id", "th", "pos")).alias("at"))
    found = materialize(found.filter(F.col("docs") >= min_docs).select("h1", "h2", "at"), "lines-found")
    gone = matched.join(found, ["h1", "h2"])
    if keep == "first":
        gone = gone.filter(~F.struct("doc_id", "th", "pos").eqNullSafe(F.col("at")))
    per_doc = gone.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("pos")).alias("dropped"))
    sizes = base.select("doc_id", "th", F.size(F.split("text", "\n")).alias("n_lines")).groupBy("doc_id", "th").agg(F.max("n_lines").alias("n_lines"))
    both = per_doc.join(sizes.withColumnsRenamed({"doc_id": "d2", "th": "t2"}), F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("th") == F.col("t2")))
    return both.select("doc_id", "th", F.size("dropped").cast("long").alias("n_dropped"), keep_runs(F.col("n_lines"), F.col("dropped")).alias("keep_runs"))


def kept_lines(lines: Column, runs: Column) -> Column:
    """The lines of the runs (of all, where ``runs`` is null)."""
    return F.when(runs.isNull(), lines).otherwise(F.flatten(F.transform(runs, lambda r: F.slice(lines, r["start"] + 1, r["len"]))))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_dropped, text without the dropped lines), a row for each row of ``docs``."""
    base = _documents(docs, doc_id, text)
    marks = bitmaps.select(F.col("doc_id").alias("d2"), F.col("th").alias("t2"), "n_dropped", "keep_runs")
    both = base.join(marks, F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("th") == F.col("t2")), "left")
    lines = F.split("text", "\n")
    return both.select(
        "doc_id",
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0).cast("long")).alias("n_dropped"),
        F.when(F.col("keep_runs").isNull(), F.col("text")).otherwise(F.array_join(kept_lines(lines, F.col("keep_runs")), "\n")).alias("text"),
    )

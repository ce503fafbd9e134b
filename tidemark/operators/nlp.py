"""Features of whole texts: keywords, bigrams, uncertainty, topics, and the wide table of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.scalar import half_even, safe_divide


def token_records(df: DataFrame, key: str, text: str, order: str | None = None) -> DataFrame:
    """(key, tokens) of each key's texts joined in order."""
    if order is None:
        return df.select(key, tx.alpha_tokens(text).alias("tokens"))
    parts = F.array_sort(F.collect_list(F.struct(order, F.coalesce(F.col(text), F.lit("")).alias("t"))))
    return df.groupBy(key).agg(F.array_join(F.transform(parts, lambda x: x["t"]), " ").alias("t")).select(key, tx.alpha_tokens("t").alias("tokens"))


def _top(records: DataFrame, key: str, terms, name: str, n: int) -> DataFrame:
    each = records.select(key, F.posexplode(terms).alias("pos", name))
    counted = each.groupBy(key, name).agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col("n").desc(), "first"))
    return counted.withColumn("rank", rank).filter(F.col("rank") <= n).select(key, "rank", name, "n")


def keywords(records: DataFrame, key: str, stop: list[str], n: int = 50) -> DataFrame:
    """The n most frequent tokens of each key; ties go to the one that occurs first."""
    return _top(records, key, tx.without("tokens", stop), "keyword", n)


def bigrams(records: DataFrame, key: str, stop: list[str], n: int = 30) -> DataFrame:
    """Neighbours among the tokens that are left; linear in a text's length, as each token meets the next in a window."""
    each = records.select(key, F.posexplode(tx.without("tokens", stop)).alias("pos", "t"))
    pairs = each.withColumn("__next", F.lead("t").over(Window.partitionBy(key).orderBy("pos"))).filter("__next is not null")
    counted = pairs.groupBy(key, F.concat_ws(" ", "t", "__next").alias("bigram")).agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col("n").desc(), "first"))
    return counted.withColumn("rank", rank).filter(F.col("rank") <= n).select(key, "rank", "bigram", "n")


def uncertainty(records: DataFrame, key: str, words: list[str]) -> DataFrame:
    """Count and share (six places) of the given words among all tokens."""
    hits = F.size(F.filter("tokens", lambda t: F.array_contains(F.array(*map(F.lit, words)), t)))
    return records.select(key, hits.cast("long").alias("uncertainty_count"), F.size("tokens").cast("long").alias("token_count"), half_even(safe_divide(hits, F.size("tokens"))).alias("uncertainty_ratio"))


def topics(records: DataFrame, key: str, lexicon: dict[str, list[str]]) -> DataFrame:
    """(key, topic, n, share) with a row for every topic, also those that don't occur."""
    def held(ws: list[str]):
        return F.size(F.filter("tokens", lambda x: F.array_contains(F.array(*map(F.lit, ws)), x))).cast("long")

    counts = [F.struct(F.lit(t).alias("topic"), held(ws).alias("n")) for t, ws in lexicon.items()]
    out = records.select(key, F.size("tokens").alias("__k"), F.explode(F.array(*counts)).alias("x"))
    return out.select(key, "x.topic", "x.n", half_even(safe_divide("x.n", "__k")).alias("share"))


def features(records: DataFrame, key: str, stop: list[str], words: list[str], lexicon: dict[str, list[str]]) -> DataFrame:
    """One row for each key: uncertainty, a column for each topic, the five first keywords."""
    wide = topics(records, key, lexicon).groupBy(key).pivot("topic", list(lexicon)).agg(F.sum("n"))
    top = keywords(records, key, stop, 5).groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "keyword"))), lambda x: x["keyword"]), ",").alias("top_5_keywords"))
    return uncertainty(records, key, words).join(wide, key, "left").join(top, key, "left")


def top_tokens(records: DataFrame, n: int, exclude: list[str]) -> DataFrame:
    """Over all texts."""
    each = records.select(F.explode("tokens").alias("token")).filter(~F.col("token").isin(exclude)) if exclude else records.select(F.explode("tokens").alias("token"))
    return each.groupBy("token").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "token").limit(n)

"""Composed pipelines: each is one lazy plan from input tables to its layer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cleaning, joins, lexicon, models, nlp, quality, segments, sentiment, stats
from ..operators import events as ev
from ..operators import market as mk
from .proxies import benchmark, events, prices
from .registry import query, rounded, table
from .text_queries import PROXY, STOP, TOPICS, UNCERTAIN


def preprocess(df: DataFrame, key: str, text: str, target: int = 120, overlap: int = 20) -> dict[str, DataFrame]:
    """Clean, cut into sentences and chunks, and report on both."""
    cleaned = cleaning.clean(df, text)
    sentences = segments.sentence_table(cleaned, key, "text_clean")
    chunks = segments.pack_chunks(sentences, key, target=target, overlap=overlap)
    return {"cleaned": cleaned, "sentences": sentences, "chunks": chunks, "transcript_report": quality.transcript_errors(cleaned, key, "text_clean"), "chunk_report": quality.chunk_errors(chunks, "chunk_id", "chunk_text", "token_count")}


def lexicon_scores(chunks: DataFrame, lex: DataFrame, key: str, text: str, carry: list[str]) -> dict[str, DataFrame]:
    """Tokens, matches, scores of chunks, and transcripts' aggregates."""
    tokens = cleaning.lm_preprocess(chunks, text)
    scored = lexicon.score(lexicon.match(tokens, lex, [key])).join(chunks.select(key, *carry), key)
    return {"chunks": scored, "transcripts": lexicon.aggregate(scored, carry[:1]), "diagnostics": quality.counts_suite(scored), "coverage": lexicon.coverage_summary(scored)}


def event_study(happened: DataFrame, market: DataFrame, scores: DataFrame, pre: int = 5, post: int = 5, horizons: tuple[int, ...] = (1, 3, 5)) -> dict[str, DataFrame]:
    """Windows, abnormal returns, sums by event, and scores merged to each event."""
    returns = mk.abnormal_returns(market)
    sessions = ev.number_sessions(returns)
    windows = ev.event_windows(ev.on_or_after(happened, sessions), sessions, pre, post).join(returns.select("ticker", "date", "daily_return", "benchmark_return", "abnormal_return"), ["ticker", "date"])
    car = ev.event_car(windows, list(horizons))
    return {"windows": windows, "car": car, "merged": joins.left_merge(car, scores, "transcript_id", ["score"]), "checks": quality.suite(quality.windows_suite(windows, pre, post), quality.returns_suite(windows, "abnormal_return"))}


def statistics(df: DataFrame, scores: list[str], outcomes: list[str]) -> dict[str, DataFrame]:
    return {"describe": stats.describe(df, [*scores, *outcomes]), "correlations": stats.correlations(df, scores, outcomes), "regression": stats.ols(df, outcomes[0], scores)}


@query()
def pipeline_preprocess(spark, d):
    out = preprocess(table(spark, d, "pages").select("page_id", "html"), "page_id", "html")
    return out["chunks"].drop("sentence_ids")


@query()
def pipeline_lexicon(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "source")
    return rounded(lexicon_scores(docs, lexicon.from_sets(spark, PROXY), "doc_id", "text", ["source"])["transcripts"])


@query()
def pipeline_event_study(spark, d):
    market = mk.join_benchmark(mk.daily_returns(prices(spark, d)), benchmark(spark, d))
    scores = table(spark, d, "orders").select(F.col("o_orderkey").alias("transcript_id"), (F.pmod("o_custkey", F.lit(21)) / 10.0 - 1).alias("score"))
    return rounded(event_study(events(spark, d), market, scores)["merged"])


@query()
def pipeline_event_statistics(spark, d):
    market = mk.join_benchmark(mk.daily_returns(prices(spark, d)), benchmark(spark, d))
    scores = table(spark, d, "orders").select(F.col("o_orderkey").alias("transcript_id"), (F.pmod("o_custkey", F.lit(21)) / 10.0 - 1).alias("score"))
    merged = event_study(events(spark, d), market, scores)["merged"]
    return rounded(statistics(merged, ["score"], ["car_1d", "car_3d", "car_5d"])["correlations"])


@query()
def pipeline_sentiment(spark, d):
    """Sentences scored by the keyword model, aggregated to documents."""
    sentences = segments.sentence_table(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")
    scored = models.score_with_keywords(sentences, "sentence_text", PROXY["positive"], PROXY["negative"]).withColumnRenamed("doc_id", "transcript_id").withColumn("token_count", F.col("token_estimate"))
    return rounded(sentiment.aggregate(scored, ["transcript_id"], "hybrid"))


@query()
def pipeline_nlp(spark, d):
    records = nlp.token_records(table(spark, d, "documents"), "doc_id", "text")
    return nlp.features(records, "doc_id", STOP, UNCERTAIN, TOPICS)

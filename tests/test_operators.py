"""Golden values and edge cases of single operators."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import distributions, scalar
from tidemark.functions import text as tx
from tidemark.operators import calendar, events, joins, lexicon, market, quality, segments, sentiment, stats
from tidemark.sources import io


def test_event_car_golden(spark):
    ar = {-2: -0.005, -1: 0.003, 0: 0.012, 1: 0.025, 2: -0.008, 3: 0.015, 4: 0.010, 5: -0.004}
    rows = [("T1", "AAPL", k, v) for k, v in ar.items()] + [("T2", "MSFT", 1, None), ("T2", "MSFT", 2, 0.01)]
    w = spark.createDataFrame(rows, "transcript_id string, ticker string, relative_day int, abnormal_return double")
    got = {r["transcript_id"]: r for r in events.event_car(w, [1, 3, 5]).collect()}
    assert (round(got["T1"]["car_1d"], 9), round(got["T1"]["car_3d"], 9), round(got["T1"]["car_5d"], 9)) == (0.025, 0.032, 0.038)
    assert got["T1"]["car_complete"] and not got["T2"]["car_complete"]
    assert got["T2"]["car_1d"] is None and got["T2"]["nan_day_count"] == 1
    zero = {r["transcript_id"]: r["car_1d"] for r in events.event_car(w, [1], policy="zero").collect()}
    assert zero["T2"] == 0.0
    with pytest.raises(Exception, match="missing"):
        events.event_car(w, [1], policy="raise").collect()


def test_confidence_weighted_mean_golden(spark):
    rows = [("a", s, c, 0.5, 0.3, 0.2, 10) for s, c in ((0.8, 0.9), (0.6, 0.5), (0.4, 0.3))]
    df = spark.createDataFrame(rows, "transcript_id string, sentiment_score double, confidence double, positive_prob double, neutral_prob double, negative_prob double, token_count int")
    got = sentiment.aggregate(df, ["transcript_id"]).first()
    assert got["score"] == pytest.approx(1.14 / 1.7) and got["label"] == "positive" and got["median"] == 0.6 and got["iqr"] == 0.0


def test_daily_returns_pad_and_clip(spark):
    rows = [("A", dt.date(2024, 1, d), p) for d, p in ((2, 100.0), (3, None), (4, 110.0), (5, 1000.0))]
    df = spark.createDataFrame(rows, "ticker string, date date, adj_close double")
    got = [r["daily_return"] for r in market.daily_returns(df).orderBy("date").collect()]
    assert got[0] is None and got[1] == 0.0 and got[2] == pytest.approx(0.1) and got[3] == 0.99


def test_scalar_guards(spark):
    df = spark.createDataFrame([(1.0, 0.0), (float("nan"), 2.0), (3.0, 2.0)], "a double, b double")
    assert [r[0] for r in df.select(scalar.safe_divide("a", "b")).collect()] == [0.0, 0.0, 1.5]
    assert [r[0] for r in df.select(scalar.clip_score("a")).collect()] == [1.0, -1.0, 1.0]
    flags = spark.createDataFrame([("Yes",), ("0",), ("maybe",), (None,)], "x string")
    assert [r[0] for r in flags.select(scalar.truthy("x")).collect()] == [True, False, None, None]


def test_tone_and_labels(spark):
    df = spark.createDataFrame([(0, 0), (3, 1), (1, 1)], "p int, n int")
    got = df.select(scalar.tone("p", "n").alias("t")).select("t", scalar.label_inclusive("t").alias("l")).collect()
    assert [(r["t"], r["l"]) for r in got] == [(0.0, "neutral"), (0.5, "positive"), (0.0, "neutral")]


def test_skew_and_kurtosis_are_bias_corrected(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 4, 10)], "x double")
    got = df.agg(scalar.skew_corrected("x").alias("s"), scalar.kurtosis_corrected("x").alias("k")).first()
    assert got["s"] == pytest.approx(1.4693, abs=1e-3)


def test_t_distribution():
    assert distributions.t_two_sided(2.0, 10) == pytest.approx(0.073388, abs=1e-6)
    assert distributions.t_quantile(0.975, 10) == pytest.approx(2.228139, abs=1e-5)
    assert distributions.t_two_sided(None, 3) is None


def test_degenerate_statistics(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (1.0, 4.0), (None, 1.0)], "x double, y double")
    assert stats.guarded_correlation(df, "x", "y").first()["status"] == "constant_input"
    assert stats.guarded_correlation(df.limit(2), "x", "y").first()["status"] == "insufficient_sample_size"
    assert {r["status"] for r in stats.ols(df, "y", ["x"]).collect()} == {"collinear_features"}
    assert stats.z_scores(df, ["x"]).first()["x_z"] is None
    assert stats.simple_ols(df, "x", "y").first()["slope"] == 0.0


def test_sentences_and_tokens(spark):
    df = spark.createDataFrame([("Dr. Smith met Mr. Jones. It rained! Did it?  Yes.",), (None,), ("",)], "t string")
    got = [r[0] for r in df.select(tx.sentences("t")).collect()]
    assert got[0] == ["Dr. Smith met Mr. Jones.", "It rained!", "Did it?", "Yes."] and got[1] == [] and got[2] == []
    tok = spark.createDataFrame([("The café isn't a test_word OK 12ab",)], "t string").select(tx.alpha_tokens("t")).first()[0]
    assert tok == ["the", "isn", "ok"]


def test_html_and_encoding(spark):
    df = spark.createDataFrame([("<p>A&amp;B</p><script>x()</script> it’s",)], "t string")
    assert df.select(tx.collapse_space(tx.fix_encoding(tx.strip_html("t")))).first()[0] == "A&B it's"


def test_chunk_packing_covers_everything(spark):
    rows = [("T", i, f"sentence number {i} with some words in it.", 12 + i % 30) for i in range(200)]
    s = spark.createDataFrame(rows, "doc string, sentence_order long, sentence_text string, token_estimate int")
    chunks = segments.pack_chunks(s, "doc", target=120, overlap=20)
    assert segments.chunk_coverage(chunks, s, "doc").first()["coverage"] == 1.0
    assert chunks.agg(F.max("token_count")).first()[0] <= 120
    assert segments.validate_overlap(chunks, "doc").filter("not overlap_ok").count() == 0
    assert segments.rebuild(chunks, "doc").first()["sentence_ids"] == list(range(200))


def test_metadata(spark):
    df = spark.createDataFrame([("Apple (NASDAQ: AAPL) third quarter fiscal 24 call on March 5, 2024",), ("nothing here",), (None,)], "t string")
    got = segments.extract_metadata(df, "t").collect()
    assert (got[0]["ticker"], got[0]["quarter"], got[0]["year"], got[0]["call_date"], got[0]["transcript_key"]) == ("AAPL", "Q3", 2024, dt.date(2024, 3, 5), "AAPL_Q3_2024")
    assert got[1]["transcript_key"] is None and got[2]["year"] is None


def test_lexicon_removed_terms(spark):
    wide = spark.createDataFrame([("GOOD", "2009", "0"), ("GONE", "-2020", "0"), ("BAD", "0", "2009")], "Word string, Positive string, Negative string")
    assert {(r["term"], r["category"]) for r in lexicon.from_wide(wide).collect()} == {("good", "positive"), ("gone", "positive"), ("bad", "negative")}
    assert "gone" not in {r["term"] for r in lexicon.from_wide(wide, removed_count=False).collect()}


def test_left_merge_never_multiplies(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k int, x string")
    more = spark.createDataFrame([(1, "z", 1.0), (1, "y", 2.0), (None, "n", 3.0)], "k int, x string, v double")
    got = joins.left_merge(base, more, "k", ["v"]).orderBy("k").collect()
    assert [(r["k"], r["x"], r["v"]) for r in got] == [(1, "a", 1.0), (2, "b", None)]
    assert joins.rename_aliases(more.withColumnRenamed("v", "score_x"), {"score": ["score_x"]}).columns[-1] == "score"
    with pytest.raises(ValueError, match="lacks"):
        joins.require(base, ["nope"])


def test_holidays_and_sessions(spark):
    assert {dt.date(2024, 1, 1), dt.date(2024, 1, 15), dt.date(2024, 3, 29), dt.date(2024, 5, 27), dt.date(2024, 6, 19), dt.date(2024, 7, 4), dt.date(2024, 9, 2), dt.date(2024, 11, 28), dt.date(2024, 12, 25)} <= calendar.us_market_holidays(2024)
    s = calendar.sessions(spark, "2024-07-01", "2024-07-10")
    days = calendar.calendar_days(s)
    rows = [("a", dt.datetime(2024, 7, 3, 18, 0), False), ("b", dt.datetime(2024, 7, 3, 21, 0), False), ("c", dt.datetime(2024, 7, 4, 12, 0), False), ("d", dt.datetime(2024, 7, 2, 0, 0), True)]
    e = spark.createDataFrame(rows, "id string, event_ts timestamp, date_only boolean")
    got = {r["id"]: r["aligned_event_date"] for r in calendar.align_instants(e, days, s).collect()}
    assert got == {"a": dt.date(2024, 7, 3), "b": dt.date(2024, 7, 5), "c": dt.date(2024, 7, 5), "d": dt.date(2024, 7, 3)}


def test_quality_suite_flags(spark):
    df = spark.createDataFrame([(1, 0.5, 0.3, 0.2, 2.0, 600), (1, 0.9, 0.3, 0.2, None, 10)], "chunk_id int, positive_prob double, neutral_prob double, negative_prob double, sentiment_score double, token_count int")
    got = {r["check"]: (r["severity"], r["n"]) for r in quality.scores_suite(df, "chunk_id").collect()}
    assert got["duplicates"] == ("critical", 1) and got["null_rate:sentiment_score"] == ("critical", 1)
    assert got["range:sentiment_score"][1] == 1 and got["probability_sum"][1] == 1 and got["token_limit"] == ("warning", 1)


def test_tables_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 1.23456789, [1, 2])], "k int, s string, x double, l array<int>")
    paths = io.write_table(df, f"file://{tmp_path}/t", csv=True, float_digits=3)
    assert len(paths) == 2 and io.read_table(spark, f"file://{tmp_path}/t").count() == 1
    assert io.read_table(spark, f"file://{tmp_path}/none", required=False) is None
    with pytest.raises(FileNotFoundError):
        io.read_table(spark, f"file://{tmp_path}/none")
    io.write_json({"b": float("nan"), "a": 1}, str(tmp_path / "x.json"))
    assert io.read_json(str(tmp_path / "x.json")) == {"a": 1, "b": None} and io.read_json(str(tmp_path / "y.json"), 5) == 5


def test_streaming_state(spark, tmp_path):
    from tidemark.streaming import rolling

    rows = [(1, i, float(i)) for i in range(5)] + [(2, 0, -1.0)]
    spark.createDataFrame(rows, "transcript_id int, chunk_order int, sentiment_score double").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("transcript_id int, chunk_order int, sentiment_score double").parquet(f"{tmp_path}/in")
    q = rolling.running_scores(stream).writeStream.outputMode("update").format("memory").queryName("tm_state").start()
    q.processAllAvailable()
    q.stop()
    got = {r["transcript_id"]: r for r in spark.sql("SELECT * FROM tm_state").collect()}
    assert got[1]["n"] == 5 and got[1]["cumulative"] == 10.0 and math.isclose(got[2]["ema"], -1.0)


def test_cleaning_chain(spark):
    from tidemark.operators import cleaning

    df = spark.createDataFrame([(1, "John Smith: Hello   there\r\n\r\n\r\n\r\n[Operator Instructions] it’s <b>fine</b>"), (2, None)], "k int, t string")
    got = {r["k"]: r for r in cleaning.clean(df, "t").collect()}
    assert got[1]["text_clean"] == "Hello there\n\nit's fine" and got[1]["word_count_clean"] == 4 and got[2]["text_clean"] == ""
    tokens = cleaning.lm_preprocess(df, "t", ["there"]).orderBy("k").collect()
    assert "hello" in tokens[0]["tokens"] and "there" not in tokens[0]["tokens"] and tokens[1]["tokens"] == []


def test_transcript_ids(spark):
    from tidemark.sources import transcripts

    df = spark.createDataFrame([("aapl", "2024-10-30", "two words"), ("msft", "not a date", "")], "symbol string, date string, content string")
    got = transcripts.normalise(df, "test").orderBy("transcript_id").collect()
    assert [r["transcript_id"] for r in got] == ["AAPL_20241030", "MSFT_UNKNOWN"] and [r["word_count"] for r in got] == [2, 0]
    prices = spark.createDataFrame([("AAPL", dt.date(2024, 1, d)) for d in range(1, 20)], "ticker string, date date")
    events_ = spark.createDataFrame([("T", "AAPL", dt.date(2024, 1, 10))], "transcript_id string, ticker string, event_date date")
    assert transcripts.around_events(prices, events_, 2, 3).count() == 6 and transcripts.across_events(prices, events_, 1, 1).count() == 3

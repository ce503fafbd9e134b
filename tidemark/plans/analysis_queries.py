"""Joins, master tables, statistics, data quality and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import direction
from ..operators import joins as jn
from ..operators import market as mk
from ..operators import models, stats
from ..operators import quality as dq
from ..operators import sentiment as se
from .market_queries import _WIN, _windows
from .proxies import CHUNKS, MARKET, chunks, market
from .registry import query, rounded, table
from .text_queries import _SCORE, _scored



@query("SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN (SELECT doc_id, max(quality)::BIGINT AS quality, max(toxic)::BIGINT AS toxic FROM labels GROUP BY 1) l ON d.doc_id = l.doc_id")
def merge_sentiment_left(spark, d):
    docs, labels = table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels")
    return rounded(jn.left_merge(docs, labels, "doc_id", [F.col("quality").desc(), F.col("toxic").desc()]))


_MASTER = f"""{_SCORE}, lb AS (SELECT doc_id, quality, toxic FROM labels), ma AS (SELECT sl.doc_id, sl.lang, sl.source, sl.tone_score, sl.label, sl.total_tokens, lb.quality, lb.toxic, d2.n_chars FROM sl LEFT JOIN lb ON lb.doc_id = sl.doc_id JOIN documents d2 ON d2.doc_id = sl.doc_id)"""


def _master(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    scored = _scored(spark, d).select("doc_id", "tone_score", "label", "total_tokens")
    return jn.master(docs, [(scored, ["tone_score"]), (table(spark, d, "labels"), ["quality"])], "doc_id")


@query(f"WITH {_MASTER} SELECT doc_id, lang, source, n_chars, round(tone_score, 6) + 0.0 AS tone_score, label, total_tokens, quality::BIGINT AS quality, toxic::BIGINT AS toxic FROM ma")
def master_left_joins(spark, d):
    return rounded(_master(spark, d))


@query(f"""WITH {_MASTER} SELECT count(*) AS rows, count(DISTINCT doc_id) AS keys, count(*) > count(DISTINCT doc_id) AS repeats, round(count(tone_score) / count(*), 6) AS tone_score_coverage, round(count(quality) / count(*), 6) AS quality_coverage FROM ma""")
def merge_report(spark, d):
    return rounded(jn.merge_report(_master(spark, d), "doc_id", ["tone_score", "quality"]))


_CMP = f"""{_SCORE}, cm AS (SELECT sl.doc_id, tone_score AS a, (2 * quality - 1)::DOUBLE AS b FROM sl JOIN labels l ON l.doc_id = sl.doc_id),
cd AS (SELECT *, sign(a) = sign(b) AS agree, a - b AS diff FROM cm)"""


def _compared(spark, d):
    both = _scored(spark, d).select("doc_id", F.col("tone_score").alias("a")).join(table(spark, d, "labels").select("doc_id", (2 * F.col("quality") - 1).cast("double").alias("b")), "doc_id")
    return jn.compare_scorers(both, "a", "b")


@query(f"""WITH {_CMP} SELECT doc_id, round(a, 6) + 0.0 AS a, round(b, 6) + 0.0 AS b, CASE WHEN a > 0.05 THEN 'positive' WHEN a < -0.05 THEN 'negative' ELSE 'neutral' END AS left_label, CASE WHEN b > 0.05 THEN 'positive' WHEN b < -0.05 THEN 'negative' ELSE 'neutral' END AS right_label,
 agree AS directional_agreement, round(diff, 6) + 0.0 AS score_difference, round(abs(diff), 6) AS absolute_difference, NOT agree OR abs(diff) > 0.5 AS divergence_flag FROM cd""")
def model_comparison_inner(spark, d):
    return rounded(_compared(spark, d))


@query(f"""WITH {_CMP}, s AS (SELECT count(*)::DOUBLE AS rows, avg(agree::INT) AS agreement_rate, avg(diff) AS mean_difference, avg(abs(diff)) AS mean_absolute_difference, avg((NOT agree OR abs(diff) > 0.5)::INT) AS divergence_rate, corr(a, b) AS correlation FROM cd)
SELECT metric, round(value, 6) + 0.0 AS value FROM (UNPIVOT s ON rows, agreement_rate, mean_difference, mean_absolute_difference, divergence_rate, correlation INTO NAME metric VALUE value)""")
def dataset_summary_long(spark, d):
    return rounded(jn.comparison_summary(_compared(spark, d), "a", "b"))


@query(f"WITH {_CMP} SELECT CASE WHEN a > 0 THEN 'positive' WHEN a < 0 THEN 'negative' ELSE 'neutral' END AS direction, count(*) AS n, count(*) FILTER (WHERE agree) AS agreements FROM cd GROUP BY 1")
def direction_agreement(spark, d):
    return _compared(spark, d).groupBy(direction("a").alias("direction")).agg(F.count("*").alias("n"), F.count_if("directional_agreement").alias("agreements"))


@query("SELECT d.doc_id FROM documents d WHERE d.doc_id NOT IN (SELECT doc_id FROM labels)")
def orphans_anti(spark, d):
    return jn.orphans(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id")


_WORDS = r"len(list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\v\f\r]+'), lambda w: w <> ''))"


@query(f"SELECT doc_id, lang FROM documents WHERE {_WORDS} BETWEEN 20 AND 50000")
def valid_semi(spark, d):
    docs = table(spark, d, "documents")
    return jn.keep_valid(docs.select("doc_id", "lang"), dq.transcript_errors(docs, "doc_id", "text", 20), "doc_id")


@query(f"SELECT doc_id, {_WORDS}::BIGINT AS n_words, CASE WHEN trim(coalesce(text, '')) = '' THEN 'empty_text,too_short' WHEN {_WORDS} < 200 THEN 'too_short' WHEN {_WORDS} > 50000 THEN 'too_long' ELSE '' END AS errors FROM documents")
def transcript_report(spark, d):
    return dq.transcript_errors(table(spark, d, "documents"), "doc_id", "text").select("doc_id", F.col("n_words").cast("long").alias("n_words"), F.array_join("errors", ",").alias("errors"))


@query("SELECT o_custkey, count(*) AS stated_wrong FROM orders WHERE false GROUP BY 1")
def count_consistency(spark, d):
    o = table(spark, d, "orders")
    out = jn.count_consistency(o, o.groupBy("o_custkey").agg(F.count("*").alias("n")), "o_custkey", "n")
    return out.select("o_custkey", F.col("actual").alias("stated_wrong"))


@query("WITH a AS (SELECT o_orderstatus AS s, avg(o_totalprice) AS m FROM orders GROUP BY 1), b AS (SELECT avg(o_totalprice) AS m FROM orders) SELECT s AS o_orderstatus, round(a.m, 4) AS actual, round(b.m, 4) AS stated FROM a, b WHERE abs(a.m - b.m) > 1e-6")
def agg_consistency(spark, d):
    o = table(spark, d, "orders")
    coarse = o.select("o_orderstatus").distinct().join(F.broadcast(o.agg(F.avg("o_totalprice").alias("m"))))  # one row of the mean
    return rounded(jn.mean_consistency(o, coarse, "o_orderstatus", "o_totalprice", "m"), digits=4)


@query(f"WITH {_SCORE} SELECT CASE lang WHEN 'en' THEN 'english' WHEN 'de' THEN 'german' ELSE 'Other' END AS sector, count(*) AS n, round(avg(tone_score), 6) + 0.0 AS mean_tone FROM sl GROUP BY 1")
def sector_mean(spark, d):
    dim = spark.createDataFrame([("en", "english"), ("de", "german")], "lang string, sector string")
    out = jn.lookup(_scored(spark, d), dim, "lang", "sector", "Other")
    return rounded(out.groupBy("sector").agg(F.count("*").alias("n"), F.avg("tone_score").alias("mean_tone")))


@query("SELECT quality::BIGINT AS quality, count(*) FILTER (WHERE toxic = 0) AS not_toxic, count(*) FILTER (WHERE toxic = 1) AS toxic FROM labels GROUP BY 1")
def confusion(spark, d):
    out = jn.class_counts(table(spark, d, "labels"), "quality", "toxic", [0, 1])
    return out.select(F.col("quality").cast("long").alias("quality"), F.col("0").alias("not_toxic"), F.col("1").alias("toxic"))


@query("""WITH c AS (SELECT count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS tp, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS fp, count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS fn, count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS tn FROM labels)
SELECT *, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM c""")
def classification_report(spark, d):
    return rounded(jn.classification_report(table(spark, d, "labels"), "quality", "toxic"))


_COLS = ["l_quantity", "l_extendedprice", "l_discount"]


@query(" UNION ALL ".join(f"""SELECT '{c}' AS "column", count({c}) AS n, count(*) - count({c}) AS missing, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(min({c}), 4) AS min, round(max({c}), 4) AS max, round(skewness({c}), 4) + 0.0 AS skew, round(kurtosis({c}), 4) + 0.0 AS kurtosis,
 {", ".join(f"round(quantile_cont({c}, {p}), 4) AS p{round(p * 100):02d}" for p in stats.PERCENTILES)} FROM lineitem""" for c in _COLS))
def describe_stats(spark, d):
    return rounded(stats.describe(table(spark, d, "lineitem"), _COLS), digits=4)


@query("SELECT l_returnflag, count(*) AS n, round(avg(l_quantity), 4) AS l_quantity_mean, round(median(l_quantity), 4) AS l_quantity_median, round(stddev_samp(l_quantity), 4) AS l_quantity_std, round(min(l_quantity), 4) AS l_quantity_min, round(max(l_quantity), 4) AS l_quantity_max FROM lineitem GROUP BY 1")
def group_stats(spark, d):
    return rounded(stats.group_statistics(table(spark, d, "lineitem"), "l_returnflag", ["l_quantity"]), digits=4)


def _fisher(r: str = "r", n: str = "n") -> str:
    return f"round(tanh(atanh({r}) - 1.959963984540054 / sqrt({n} - 3)), 6) + 0.0 AS ci_low, round(tanh(atanh({r}) + 1.959963984540054 / sqrt({n} - 3)), 6) + 0.0 AS ci_high"


@query(f"""WITH p AS (SELECT 'l_quantity' AS x, 'l_extendedprice' AS y, count(*) AS n, corr(l_quantity, l_extendedprice) AS r FROM lineitem UNION ALL SELECT 'l_quantity', 'l_discount', count(*), corr(l_quantity, l_discount) FROM lineitem)
SELECT x, y, n, round(r, 6) + 0.0 AS r, {_fisher()} FROM p""")
def corr_pairs(spark, d):
    return rounded(stats.correlations(table(spark, d, "lineitem"), ["l_quantity"], ["l_extendedprice", "l_discount"]).drop("p_value"))


@query(f"""WITH k AS (SELECT rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2 AS a, rank() OVER (ORDER BY o_custkey) + (count(*) OVER (PARTITION BY o_custkey) - 1) / 2 AS b FROM orders), p AS (SELECT count(*) AS n, corr(a, b) AS r FROM k)
SELECT 'o_totalprice' AS x, 'o_custkey' AS y, n, round(r, 6) + 0.0 AS r, {_fisher()} FROM p""")
def spearman(spark, d):
    return rounded(stats.spearman(table(spark, d, "orders"), ["o_totalprice"], ["o_custkey"]).drop("p_value"))


_WELCH = """g AS (SELECT count(*) FILTER (WHERE l_returnflag = 'R') AS n1, count(*) FILTER (WHERE l_returnflag <> 'R') AS n2, avg(l_quantity) FILTER (WHERE l_returnflag = 'R') AS m1, avg(l_quantity) FILTER (WHERE l_returnflag <> 'R') AS m2, var_samp(l_quantity) FILTER (WHERE l_returnflag = 'R') AS v1, var_samp(l_quantity) FILTER (WHERE l_returnflag <> 'R') AS v2 FROM lineitem)"""


@query(f"""WITH {_WELCH} SELECT n1, n2, round(m1 - m2, 6) + 0.0 AS difference, round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 6) + 0.0 AS t, round(pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1)), 3) AS df,
 round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)), 6) + 0.0 AS cohens_d FROM g""")
def welch_t(spark, d):
    out = stats.welch_t(table(spark, d, "lineitem"), "l_quantity", F.col("l_returnflag") == "R")
    return rounded(out.select("n1", "n2", "difference", "t", F.round("df", 3).alias("df"), "cohens_d"))


@query(f"WITH {MARKET}, q AS (SELECT daily_return - benchmark_return AS x FROM m) SELECT count(x) AS n, round(avg(x), 6) + 0.0 AS mean, round(stddev_samp(x), 6) AS std, round(avg(x) / (stddev_samp(x) / sqrt(count(x))), 5) + 0.0 AS t FROM q")
def one_sample_t(spark, d):
    out = stats.one_sample_t(mk.abnormal_returns(market(spark, d)), "abnormal_return")
    return rounded(out.select("n", "mean", "std", F.round("t", 5).alias("t")))


@query()
def t_test_pvalues(spark, d):
    out = stats.welch_t(table(spark, d, "lineitem"), "l_quantity", F.col("l_returnflag") == "R")
    return rounded(out.select("t", "df", "p_value", "ci_low", "ci_high"))


@query("""WITH e AS (SELECT list_sort(list_distinct(quantile_cont(o_totalprice, [0, 0.2, 0.4, 0.6, 0.8, 1]))) AS e FROM orders), b AS (SELECT o_orderkey, o_totalprice, 'Q' || (len(list_filter(e[2:len(e) - 1], lambda v: o_totalprice > v)) + 1) AS bucket FROM orders, e)
SELECT bucket, count(*) AS n, round(min(o_totalprice), 4) AS lo, round(max(o_totalprice), 4) AS hi FROM b GROUP BY 1""")
def qcut_buckets(spark, d):
    out = stats.quantile_buckets(table(spark, d, "orders").select("o_totalprice"), "o_totalprice", 5)
    return rounded(out.groupBy("bucket").agg(F.count("*").alias("n"), F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi")), digits=4)


@query("SELECT c_custkey, round((rank() OVER (ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_acctbal) - 1) / 2) / count(*) OVER () * 100, 5) AS percentile_rank FROM customer")
def percentile_rank(spark, d):
    return rounded(stats.percentile_rank(table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal").drop("c_acctbal"), digits=5)


@query("SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_samp(c_acctbal) OVER (), 5) + 0.0 AS c_acctbal_z FROM customer")
def zscore(spark, d):
    return rounded(stats.z_scores(table(spark, d, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"]).drop("c_acctbal"), digits=5)


@query("WITH p AS (SELECT quantile_cont(c_acctbal, 0.05) AS lo, quantile_cont(c_acctbal, 0.95) AS hi FROM customer) SELECT c_custkey, round(least(greatest(c_acctbal, lo), hi), 3) + 0.0 AS c_acctbal FROM customer, p")
def winsorise(spark, d):
    return rounded(stats.winsorise(table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", 0.05, 0.95), digits=3)


@query("SELECT l_returnflag, count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem GROUP BY 1")
def ols_simple(spark, d):
    out = stats.simple_ols(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"])
    return rounded(out.select("l_returnflag", "n", F.round("slope", 4).alias("slope"), F.round("intercept", 3).alias("intercept"), "r2"))


@query()
def ols_multiple(spark, d):
    return rounded(stats.ols(table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"]), digits=4)


@query("""WITH r AS (SELECT corr(l_quantity, l_discount) AS a, corr(l_quantity, l_tax) AS b, corr(l_discount, l_tax) AS c FROM lineitem), d AS (SELECT *, 1 + 2 * a * b * c - a * a - b * b - c * c AS det FROM r)
SELECT 'l_quantity' AS feature, round((1 - c * c) / det, 6) AS vif FROM d UNION ALL SELECT 'l_discount', round((1 - b * b) / det, 6) FROM d UNION ALL SELECT 'l_tax', round((1 - a * a) / det, 6) FROM d""")
def variance_inflation(spark, d):
    return rounded(stats.variance_inflation(table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"]))


@query("SELECT count(*) AS n, round(corr(l_quantity, l_extendedprice), 6) AS r, 'ok' AS status FROM lineitem")
def status_guarded_corr(spark, d):
    return rounded(stats.guarded_correlation(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice"))


@query("WITH b AS (SELECT min(l_extendedprice) AS a, max(l_extendedprice) AS z FROM lineitem) SELECT least(floor((l_extendedprice - a) * 20 / (z - a)), 19)::BIGINT AS bin, count(*) AS n FROM lineitem, b GROUP BY 1")
def return_histogram(spark, d):
    return stats.histogram(table(spark, d, "lineitem"), "l_extendedprice", 20)


@query("WITH j AS (SELECT quality, n_chars FROM labels JOIN documents USING (doc_id)), k AS (SELECT quality, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2 AS r FROM j) SELECT round((sum(r) FILTER (WHERE quality = 1) - count(*) FILTER (WHERE quality = 1) * (count(*) FILTER (WHERE quality = 1) + 1) / 2) / (count(*) FILTER (WHERE quality = 1) * count(*) FILTER (WHERE quality = 0)), 6) AS auc FROM k")
def auc(spark, d):
    both = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return rounded(stats.auc(both, "n_chars", "quality"))


@query("WITH j AS (SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) SELECT doc_id, coalesce(quality, (SELECT coalesce(median(quality), 0) FROM j))::DOUBLE AS quality FROM j")
def median_imputation(spark, d):
    both = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return stats.median_fill(both, ["quality"])


@query("""WITH j AS (SELECT d.*, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)) SELECT "column", count(*) FILTER (WHERE m) AS n_null, round(avg(m::INT), 6) AS rate FROM (SELECT 'doc_id' AS "column", doc_id IS NULL AS m FROM j UNION ALL SELECT 'lang', lang IS NULL FROM j UNION ALL SELECT 'quality', quality IS NULL FROM j UNION ALL SELECT 'toxic', toxic IS NULL FROM j) GROUP BY 1""")
def null_rates(spark, d):
    j = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id", "left")
    return rounded(dq.null_report(j).drop("type"))


@query("SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicates(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    return rounded(dq.duplicate_rows(li, ["l_orderkey", "l_linenumber"]).groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("copies")))


@query(f"""WITH {_WIN}, g AS (SELECT transcript_id, count(*) AS k, count(*) FILTER (WHERE relative_day = 0) AS z FROM w GROUP BY 1)
SELECT 'critical' AS severity, 'null_keys' AS "check", 0::BIGINT AS n WHERE false UNION ALL SELECT 'ok', 'null_keys', 0 UNION ALL SELECT 'ok', 'duplicates', 0 UNION ALL SELECT CASE WHEN count(*) FILTER (WHERE z <> 1) > 0 THEN 'critical' ELSE 'ok' END, 'event_day', count(*) FILTER (WHERE z <> 1) FROM g
UNION ALL SELECT 'ok', 'monotonic:relative_day', 0 UNION ALL SELECT 'ok', 'ordering:relative_day', 0 UNION ALL SELECT CASE WHEN count(*) FILTER (WHERE k <> 9) > 0 THEN 'warning' ELSE 'ok' END, 'group_size', count(*) FILTER (WHERE k <> 9) FROM g""")
def monotonic_check(spark, d):
    return dq.windows_suite(_windows(spark, d), 3, 5).select("severity", "check", "n")


@query(f"""WITH {MARKET}, q AS (SELECT daily_return - benchmark_return AS x FROM m), a AS (SELECT count(*) AS c, count(*) - count(x) AS nn, count(*) FILTER (WHERE abs(x) > 0.5) AS e FROM q)
SELECT 'null_rate:abnormal_return' AS "check", nn AS n, CASE WHEN nn / c >= 0.2 THEN 'critical' WHEN nn / c >= 0.05 THEN 'warning' ELSE 'ok' END AS severity FROM a UNION ALL SELECT 'extreme:abnormal_return', e, CASE WHEN e / c > 0.02 THEN 'critical' WHEN e > 0 THEN 'warning' ELSE 'ok' END FROM a UNION ALL SELECT 'coverage:abnormal_return', nn, CASE WHEN 1 - nn / c < 0.8 THEN 'warning' ELSE 'ok' END FROM a""")
def range_checks(spark, d):
    return dq.returns_suite(mk.abnormal_returns(market(spark, d)), "abnormal_return").select("check", "n", "severity")


@query(f"""WITH {CHUNKS}, n AS (SELECT count(*) FILTER (WHERE token_count > 512) AS t FROM c) SELECT 0::BIGINT AS errors, (t > 0)::BIGINT AS warnings, (8 - (t > 0)::INT)::BIGINT AS passed, (100 - 2 * (t > 0)::INT)::BIGINT AS health_score FROM n""")
def issue_table(spark, d):
    return dq.health(dq.scores_suite(se.normalise_chunks(chunks(spark, d)), "chunk_id"))


@query("SELECT lang, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share, lang IN ('en', 'de') AS expected FROM documents GROUP BY lang")
def label_distribution(spark, d):
    return rounded(dq.label_distribution(table(spark, d, "documents"), "lang", ["en", "de"]))


_P, _N = ["the", "and", "la", "der"], ["of", "not", "les", "und"]


def _has(ws: list[str]) -> str:
    return "(" + " + ".join(f"list_contains(w, '{x}')::INT" for x in ws) + ")"


_MD5 = "md5(encode(text)[1:50])"
_EPS = f"((('0x' || substr({_MD5}, 1, 16))::UBIGINT % 100 * 16 + ('0x' || substr({_MD5}, 17, 16))::UBIGINT % 100) % 100)::DOUBLE / 100000"


@query(rf"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, string_split_regex(lower(coalesce(text, '')), '[ \t\n\v\f\r]+') AS w FROM documents), p AS (SELECT doc_id, length(trim(text)) >= 3 AS ok, 1 + 0.5::DOUBLE * {_has(_P)} AS p, 1 + 0.5::DOUBLE * {_has(_N)} AS n, {_EPS} AS eps FROM t),
r AS (SELECT doc_id, ok, round(p / (p + n + 1.5), 6) AS p, round(n / (p + n + 1.5), 6) AS n, eps FROM p), s AS (SELECT doc_id, ok, (p + eps) / (1 + eps) AS p, n / (1 + eps) AS n FROM r)
SELECT doc_id, round((CASE WHEN ok THEN p ELSE 0 END)::DECIMAL(18, 8), 4)::DOUBLE AS positive_prob, round((CASE WHEN ok THEN n ELSE 0 END)::DECIMAL(18, 8), 4)::DOUBLE AS negative_prob, CASE WHEN NOT ok THEN 'neutral' WHEN round(p, 8) >= round(1 - p - n, 8) AND round(p, 8) >= round(n, 8) THEN 'positive' WHEN round(n, 8) > round(1 - p - n, 8) THEN 'negative' ELSE 'neutral' END AS predicted_label, NOT ok AS was_skipped FROM s""")
def keyword_model(spark, d):
    out = models.score_with_keywords(table(spark, d, "documents").select("doc_id", "text"), "text", _P, _N)
    return rounded(out.select("doc_id", "positive_prob", "negative_prob", "predicted_label", "was_skipped"), digits=4)


@query()
def pluggable_model(spark, d):
    def load():
        return lambda texts: [((len(t) % 7) / 10, 0.2, 0.8 - (len(t) % 7) / 10) for t in texts]

    return models.score_with_model(table(spark, d, "documents"), "doc_id", "text", load)


@query()
def classifier_metrics(spark, d):
    both = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", F.col("n_chars").cast("double").alias("n_chars"), (F.col("lang") == "en").cast("double").alias("en")), "doc_id")
    return models.train_classifiers(both, ["n_chars", "en"], "quality", "doc_id")

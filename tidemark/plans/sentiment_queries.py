"""Aggregation of chunk scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sentiment as se
from .proxies import CHUNKS, chunks
from .registry import query, rounded

_LABEL = "CASE WHEN score > 0.05 THEN 'positive' WHEN score < -0.05 THEN 'negative' ELSE 'neutral' END AS label"
_WEIGHT = {"uniform": "1.0", "confidence": "confidence", "token_count": "token_count", "hybrid": "confidence * token_count"}


def _agg_sql(keys: str, strategy: str, where: str = "TRUE") -> str:
    w = _WEIGHT[strategy]
    mean = lambda x: f"sum({x} * {w}) / sum({w})"
    return f"""WITH {CHUNKS}, g AS (SELECT {keys}, {mean('sentiment_score')} AS score, {mean('positive_prob')} AS p, {mean('neutral_prob')} AS u, {mean('negative_prob')} AS n, count(*) AS chunk_count, sum(token_count)::BIGINT AS total_tokens,
 avg(confidence) AS mean_confidence, coalesce(stddev_samp(sentiment_score), 0) AS std, list_sort(list(sentiment_score)) AS l, min(sentiment_score) AS min_score, max(sentiment_score) AS max_score FROM c WHERE {where} GROUP BY {keys})
SELECT {keys}, round(score, 6) + 0.0 AS score, chunk_count, total_tokens, round(mean_confidence, 6) AS mean_confidence, round(std, 6) AS std, round(l[(chunk_count // 2 + 1)::BIGINT], 6) + 0.0 AS median,
 CASE WHEN chunk_count < 4 THEN 0.0 ELSE round(l[(3 * chunk_count // 4 + 1)::BIGINT] - l[(chunk_count // 4 + 1)::BIGINT], 6) END AS iqr, round(min_score, 6) + 0.0 AS min_score, round(max_score, 6) + 0.0 AS max_score,
 round(p / (p + u + n), 6) AS positive_prob, round(u / (p + u + n), 6) AS neutral_prob, round(n / (p + u + n), 6) AS negative_prob, {_LABEL} FROM g"""


@query(_agg_sql("transcript_id", "uniform"))
def agg_uniform(spark, d):
    return rounded(se.aggregate(se.normalise_chunks(chunks(spark, d)), ["transcript_id"], "uniform"))


@query(_agg_sql("transcript_id", "confidence"))
def agg_confidence(spark, d):
    return rounded(se.aggregate(se.normalise_chunks(chunks(spark, d)), ["transcript_id"], "confidence"))


@query(_agg_sql("transcript_id", "token_count"))
def agg_token(spark, d):
    return rounded(se.aggregate(se.normalise_chunks(chunks(spark, d)), ["transcript_id"], "token_count"))


@query(_agg_sql("transcript_id", "hybrid"))
def agg_hybrid(spark, d):
    return rounded(se.aggregate(se.normalise_chunks(chunks(spark, d)), ["transcript_id"], "hybrid"))


@query(_agg_sql("transcript_id, section_type", "confidence"))
def section_sentiment(spark, d):
    return rounded(se.aggregate_levels(se.normalise_chunks(chunks(spark, d)))["section"])


@query(_agg_sql("transcript_id, speaker", "confidence"))
def speaker_sentiment(spark, d):
    return rounded(se.aggregate_levels(se.normalise_chunks(chunks(spark, d)))["speaker"])


@query(f"""WITH {CHUNKS}, x AS (SELECT c.*, k.strategy, CASE k.strategy WHEN 'uniform' THEN 1.0 WHEN 'confidence' THEN confidence WHEN 'token_count' THEN token_count ELSE confidence * token_count END AS w FROM c, (VALUES ('uniform'), ('confidence'), ('token_count'), ('hybrid')) k(strategy))
SELECT transcript_id, strategy, round(sum(sentiment_score * w) / sum(w), 6) + 0.0 AS score FROM x GROUP BY ALL""")
def strategy_compare(spark, d):
    return rounded(se.compare_strategies(chunks(spark, d), ["transcript_id"]))


@query(f"""WITH {CHUNKS}, p AS (SELECT *, chunk_order - 1 AS i, count(*) OVER (PARTITION BY transcript_id) AS n FROM c), x AS (SELECT *, greatest(1, n // 4) AS q, n // 2 AS h FROM p),
g AS (SELECT transcript_id, count(*) AS n, coalesce(regr_slope(sentiment_score, i), 0) AS slope, coalesce(regr_intercept(sentiment_score, i), avg(sentiment_score)) AS intercept, coalesce(pow(covar_pop(sentiment_score, i), 2) / nullif(var_pop(sentiment_score) * var_pop(i), 0), 0) AS r2,
 avg(sentiment_score) FILTER (WHERE i < q) AS opening, avg(sentiment_score) FILTER (WHERE i >= p_n - q) AS closing, avg(sentiment_score) FILTER (WHERE i < h) AS first_half, avg(sentiment_score) FILTER (WHERE i >= h) AS second_half,
 max(sentiment_score) - min(sentiment_score) AS range, arg_max(i, (sentiment_score, -i)) AS peak_at, arg_min(i, (sentiment_score, i)) AS trough_at, avg(sentiment_score) FILTER (WHERE section_type = 'prepared') - avg(sentiment_score) FILTER (WHERE section_type = 'qa') AS prepared_qa_delta
 FROM (SELECT *, n AS p_n FROM x) GROUP BY transcript_id)
SELECT transcript_id, n, round(slope, 6) + 0.0 AS slope, round(intercept, 6) + 0.0 AS intercept, round(r2, 6) AS r2, round(opening, 6) + 0.0 AS opening, round(closing, 6) + 0.0 AS closing, round(first_half, 6) + 0.0 AS first_half, round(second_half, 6) + 0.0 AS second_half, round(range, 6) AS range, peak_at, trough_at,
 round(second_half - first_half, 6) + 0.0 AS half_delta, round(prepared_qa_delta, 6) + 0.0 AS prepared_qa_delta, round(closing - opening, 6) + 0.0 AS opening_closing_delta FROM g""")
def drift_metrics(spark, d):
    return rounded(se.drift(chunks(spark, d)))


@query(f"""WITH {CHUNKS}, p AS (SELECT *, chunk_order - 1 AS i, count(*) OVER (PARTITION BY transcript_id) AS n, sentiment_score - lag(sentiment_score) OVER (PARTITION BY transcript_id ORDER BY chunk_order) AS step FROM c)
SELECT transcript_id, round(coalesce(regr_slope(sentiment_score, i) FILTER (WHERE i >= n // 2), 0) - coalesce(regr_slope(sentiment_score, i) FILTER (WHERE i < n // 2), 0), 6) + 0.0 AS acceleration, round(coalesce(avg(step) FILTER (WHERE i >= n - greatest(1, n // 4)), 0), 6) + 0.0 AS momentum FROM p GROUP BY transcript_id""")
def drift_acceleration(spark, d):
    return rounded(se.acceleration(chunks(spark, d)))


@query(f"""WITH {CHUNKS}, w AS (SELECT transcript_id, chunk_id, sentiment_score - lag(sentiment_score) OVER o AS local_shift, avg(sentiment_score) OVER f AS rolling_mean, coalesce(stddev_pop(sentiment_score) OVER f, 0) AS rolling_std, sum(sentiment_score) OVER o AS cumulative
 FROM c WINDOW o AS (PARTITION BY transcript_id ORDER BY chunk_order ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY transcript_id ORDER BY chunk_order ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
SELECT transcript_id, chunk_id, round(local_shift, 6) + 0.0 AS local_shift, coalesce(abs(local_shift) > 0.5, false) AS is_spike, round(rolling_mean, 6) + 0.0 AS rolling_mean, round(rolling_std, 6) AS rolling_std, round(cumulative, 6) + 0.0 AS cumulative FROM w""")
def rolling_sentiment(spark, d):
    out = se.rolling(chunks(spark, d))
    return rounded(out.select("transcript_id", "chunk_id", "local_shift", "is_spike", "rolling_mean", "rolling_std", "cumulative"))


@query(f"""WITH {CHUNKS}, w AS (SELECT transcript_id, abs(sentiment_score - lag(sentiment_score) OVER (PARTITION BY transcript_id ORDER BY chunk_order)) > 0.5 AS s FROM c) SELECT transcript_id, count(*) FILTER (WHERE s) AS spikes FROM w GROUP BY transcript_id""")
def spikes(spark, d):
    return se.rolling(chunks(spark, d)).groupBy("transcript_id").agg(F.count_if("is_spike").alias("spikes"))


@query(f"""WITH RECURSIVE {CHUNKS}, e AS (SELECT transcript_id, chunk_id, chunk_order, sentiment_score AS x FROM c WHERE chunk_order = 1 UNION ALL SELECT c.transcript_id, c.chunk_id, c.chunk_order, 0.3 * c.sentiment_score + 0.7 * e.x FROM e JOIN c ON c.transcript_id = e.transcript_id AND c.chunk_order = e.chunk_order + 1)
SELECT transcript_id, chunk_id, round(x, 6) + 0.0 AS ema FROM e""")
def ema_sentiment(spark, d):
    return rounded(se.smooth(chunks(spark, d).select("transcript_id", "chunk_id", "chunk_order", "sentiment_score")).select("transcript_id", "chunk_id", "ema"))


@query(f"""WITH {CHUNKS}, g AS (SELECT transcript_id, section_type, sum(sentiment_score * confidence) / sum(confidence) AS s FROM c GROUP BY 1, 2), p AS (SELECT transcript_id, max(s) FILTER (WHERE section_type = 'prepared') AS prepared, max(s) FILTER (WHERE section_type = 'qa') AS qa FROM g GROUP BY 1)
SELECT transcript_id, round(prepared, 6) + 0.0 AS prepared, round(qa, 6) + 0.0 AS qa, round(prepared - qa, 6) + 0.0 AS delta FROM p""")
def prep_vs_qa_pivot(spark, d):
    return rounded(se.prepared_qa_pivot(se.aggregate(chunks(spark, d), ["transcript_id", "section_type"])))


@query(f"""WITH {CHUNKS}, g AS (SELECT transcript_id, avg(sentiment_score) FILTER (WHERE speaker_role = 'executive') AS e, avg(sentiment_score) FILTER (WHERE speaker_role = 'analyst') AS a FROM c GROUP BY 1)
SELECT transcript_id, round(e, 6) + 0.0 AS executive_mean, round(a, 6) + 0.0 AS analyst_mean, round(e - a, 6) + 0.0 AS delta FROM g WHERE e IS NOT NULL OR a IS NOT NULL""")
def exec_vs_analyst(spark, d):
    return rounded(se.group_contrast(chunks(spark, d), "speaker_role", "executive", "analyst"))


@query(f"""WITH {CHUNKS}, r AS (SELECT transcript_id, speaker, speaker_role, count(*) AS k FROM c GROUP BY ALL), t AS (SELECT transcript_id, speaker, arg_max(speaker_role, (k, CASE speaker_role WHEN 'analyst' THEN 1 ELSE 0 END)) AS role FROM r GROUP BY 1, 2),
g AS (SELECT transcript_id, speaker, count(*) AS chunks, sum(token_count)::BIGINT AS tokens, avg(sentiment_score) AS mean_score FROM c GROUP BY 1, 2)
SELECT g.transcript_id, g.speaker, role, chunks, tokens, round(mean_score, 6) + 0.0 AS mean_score, round(tokens / sum(tokens) OVER (PARTITION BY g.transcript_id), 6) AS dominance, row_number() OVER (PARTITION BY g.transcript_id ORDER BY round(mean_score, 9) DESC, g.speaker) AS rank FROM g JOIN t ON g.transcript_id = t.transcript_id AND g.speaker = t.speaker""")
def dominance(spark, d):
    return rounded(se.dominance(chunks(spark, d)))


@query(f"""WITH {CHUNKS}, l AS (SELECT *, coalesce(chunk_order < lag(chunk_order) OVER (PARTITION BY transcript_id ORDER BY chunk_id), false) AS late FROM c)
SELECT transcript_id, count(*) AS chunks, count(*) - count(DISTINCT chunk_id) AS duplicates, count(*) FILTER (WHERE late) AS out_of_order, count(*) FILTER (WHERE sentiment_score IS NULL) AS missing_scores, count(*) FILTER (WHERE abs(sentiment_score) > 0.9) AS extreme_scores,
 count(*) FILTER (WHERE confidence < 0.5) AS low_confidence, count(DISTINCT section_type) AS sections, count(DISTINCT speaker) AS speakers FROM l GROUP BY transcript_id""")
def diagnostics(spark, d):
    return se.diagnostics(chunks(spark, d))


_TREE = f"""{CHUNKS}, n AS (
 SELECT transcript_id::VARCHAR AS node_id, NULL AS parent_node_id, 'transcript' AS level, 0 AS depth, sentiment_score AS s FROM c
 UNION ALL SELECT concat_ws('/', transcript_id, section_type), transcript_id::VARCHAR, 'section', 1, sentiment_score FROM c
 UNION ALL SELECT concat_ws('/', transcript_id, section_type, speaker), concat_ws('/', transcript_id, section_type), 'speaker', 2, sentiment_score FROM c
 UNION ALL SELECT concat_ws('/', transcript_id, section_type, speaker, chunk_id), concat_ws('/', transcript_id, section_type, speaker), 'chunk', 3, sentiment_score FROM c),
t AS (SELECT node_id, parent_node_id, level, depth, avg(s) AS score, count(*) AS n FROM n GROUP BY ALL)"""


@query(f"WITH {_TREE} SELECT node_id, parent_node_id, level, depth::BIGINT AS depth, round(score, 6) + 0.0 AS score, n FROM t")
def hierarchy_nodes(spark, d):
    return rounded(se.node_tree(chunks(spark, d)))


@query(f"WITH {_TREE} SELECT node_id, level, round(score, 6) + 0.0 AS score FROM t WHERE parent_node_id = '7'")
def hierarchy_children(spark, d):
    return rounded(se.children_of(se.node_tree(chunks(spark, d)), "7").select("node_id", "level", "score"))


@query(f"WITH {_TREE}, k AS (SELECT min(node_id) AS node_id FROM t WHERE depth = 3), p AS (SELECT t.* FROM t JOIN k USING (node_id)) SELECT a.node_id, a.level, round(a.score, 6) + 0.0 AS score FROM t a, p WHERE a.depth < 3 AND (p.node_id LIKE a.node_id || '/%')")
def hierarchy_ancestors(spark, d):
    tree = se.node_tree(chunks(spark, d))
    leaf = tree.filter("depth = 3").agg(F.min("node_id").alias("leaf"))
    now, out = leaf.join(tree, F.col("leaf") == F.col("node_id")).select(F.col("parent_node_id").alias("up")), None
    for _ in range(3):
        step = now.join(tree, F.col("up") == F.col("node_id")).select("node_id", "level", "score", "parent_node_id")
        out = step if out is None else out.unionByName(step)
        now = step.select(F.col("parent_node_id").alias("up"))
    return rounded(out.select("node_id", "level", "score"))


@query(f"""WITH {CHUNKS}, p AS (SELECT *, row_number() OVER (PARTITION BY transcript_id ORDER BY chunk_order::VARCHAR) - 1 AS i, count(*) OVER (PARTITION BY transcript_id) AS n FROM c)
SELECT transcript_id, round(coalesce(avg(sentiment_score) FILTER (WHERE i < n // 2), 0) - coalesce(avg(sentiment_score) FILTER (WHERE i >= n // 2), 0), 6) + 0.0 AS optimism_decay FROM p GROUP BY 1""")
def optimism_decay(spark, d):
    return rounded(se.optimism_decay(chunks(spark, d)))


@query(f"""WITH {CHUNKS}, g AS (SELECT transcript_id, coalesce(regr_slope(sentiment_score, chunk_order - 1), 0) AS slope FROM c GROUP BY 1) SELECT transcript_id, round(slope, 6) + 0.0 AS slope FROM g ORDER BY abs(slope) DESC, transcript_id LIMIT 10""")
def top_drift_events(spark, d):
    return rounded(se.top_by(se.drift(chunks(spark, d)).select("transcript_id", "slope"), "slope", 10, "transcript_id", absolute=True))


@query(f"""WITH {CHUNKS} SELECT speaker, section_type, count(*) AS n, round(avg(sentiment_score), 6) + 0.0 AS mean, round(CASE WHEN count(*) > 1 THEN stddev_samp(sentiment_score) ELSE 0 END, 6) AS std, count(*) FILTER (WHERE sentiment_score > 0.05) AS positive,
 count(*) FILTER (WHERE sentiment_score BETWEEN -0.05 AND 0.05) AS neutral, count(*) FILTER (WHERE sentiment_score < -0.05) AS negative FROM c GROUP BY 1, 2""")
def speaker_label_counts(spark, d):
    return rounded(se.label_counts(chunks(spark, d), ["speaker", "section_type"]))

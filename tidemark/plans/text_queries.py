"""Lexicon scores, features of texts and speaker turns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import lexicon as lx
from ..operators import nlp, segments
from .registry import query, rounded, table

#: Words that occur in the test prose, standing in for a finance lexicon.
PROXY = {
    "positive": ["the", "and", "with", "la", "der", "de"], "negative": ["of", "not", "for", "les", "und", "el"], "uncertainty": ["this", "that", "was", "que", "von"],
    "litigious": ["license", "public", "version"], "strong_modal": ["is", "are"], "weak_modal": ["it", "or"], "constraining": ["on", "under", "with"],
}
STOP = ["the", "of", "and", "to", "in", "is", "that", "it", "for", "de", "la", "le", "des", "et", "un", "en", "der", "die", "und", "zu"]
TOPICS = {"legal": ["license", "public", "version", "released"], "speech": ["he", "was", "you", "this"], "romance": ["que", "les", "el", "los", "dans"], "german": ["von", "auf", "nicht", "einen"]}
UNCERTAIN = ["this", "that", "was", "que", "von", "or"]

_TOK = r"tok AS (SELECT doc_id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+'), lambda t: regexp_full_match(t, '[a-z]{2,}')) AS tokens FROM documents)"


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_LEX = "lex(term, category) AS (VALUES " + ", ".join(f"('{w}', '{c}')" for c, ws in PROXY.items() for w in ws) + ")"
_EXP = "x AS (SELECT doc_id, unnest(tokens) AS term, generate_subscripts(tokens, 1) AS pos FROM tok)"


def _records(spark, d):
    return nlp.token_records(table(spark, d, "documents"), "doc_id", "text")


def _matched(spark, d, unique=False):
    return lx.match(_records(spark, d), lx.from_sets(spark, PROXY), ["doc_id"], unique)


@query(f"WITH {_TOK} SELECT doc_id, len(tokens)::BIGINT AS token_count, len(list_distinct(tokens))::BIGINT AS unique_count, round(CASE WHEN len(tokens) = 0 THEN 0.0 ELSE len(list_distinct(tokens)) / len(tokens) END, 6) AS type_token_ratio FROM tok")
def tokenize(spark, d):
    r = _records(spark, d)
    return rounded(r.select("doc_id", F.size("tokens").alias("token_count"), F.size(F.array_distinct("tokens")).alias("unique_count"), tx.type_token_ratio("tokens").alias("type_token_ratio")))


@query(f"""WITH {_TOK}, {_EXP}, k AS (SELECT doc_id, term, count(*) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, min(pos)) AS rank FROM (SELECT * FROM x WHERE NOT list_contains({_list(STOP)}, term)) GROUP BY doc_id, term)
SELECT doc_id, rank, term AS keyword, n FROM k WHERE rank <= 50""")
def keywords_topk(spark, d):
    return rounded(nlp.keywords(_records(spark, d), "doc_id", STOP, 50))


@query(f"""WITH {_TOK}, {_EXP}, b AS (SELECT doc_id, term || ' ' || lead(term) OVER (PARTITION BY doc_id ORDER BY pos) AS bigram, pos AS i FROM x WHERE NOT list_contains({_list(STOP)}, term)),
k AS (SELECT doc_id, bigram, count(*) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, min(i)) AS rank FROM b WHERE bigram IS NOT NULL GROUP BY 1, 2) SELECT doc_id, rank, bigram, n FROM k WHERE rank <= 30""")
def bigrams_topk(spark, d):
    return rounded(nlp.bigrams(_records(spark, d), "doc_id", STOP, 30))


_UNC = f"SELECT doc_id, len(list_filter(tokens, lambda t: list_contains({_list(UNCERTAIN)}, t)))::BIGINT AS uncertainty_count, len(tokens)::BIGINT AS token_count, round(coalesce(len(list_filter(tokens, lambda t: list_contains({_list(UNCERTAIN)}, t))) / nullif(len(tokens), 0), 0), 4) AS uncertainty_ratio FROM tok"


@query(f"WITH {_TOK} {_UNC}")
def uncertainty(spark, d):
    return rounded(nlp.uncertainty(_records(spark, d), "doc_id", UNCERTAIN).withColumn("uncertainty_ratio", F.round(F.coalesce(F.try_divide("uncertainty_count", "token_count"), F.lit(0.0)), 4)))


_TOPIC = " UNION ALL ".join(f"SELECT doc_id, '{t}' AS topic, len(list_filter(tokens, lambda t: list_contains({_list(ws)}, t)))::BIGINT AS n FROM tok" for t, ws in TOPICS.items())


@query(f"WITH {_TOK} {_TOPIC}")
def topic_frequency(spark, d):
    return nlp.topics(_records(spark, d), "doc_id", TOPICS).select("doc_id", "topic", "n")


@query(f"""WITH {_TOK}, {_EXP}, k AS (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, min(pos)) AS rank FROM (SELECT * FROM x WHERE NOT list_contains({_list(STOP)}, term)) GROUP BY doc_id, term),
t AS (SELECT doc_id, string_agg(term, ',' ORDER BY rank) AS top_5_keywords FROM k WHERE rank <= 5 GROUP BY 1), u AS ({_UNC})
SELECT u.doc_id, uncertainty_count, token_count, {", ".join(f"len(list_filter(tokens, lambda t: list_contains({_list(ws)}, t)))::BIGINT AS {t}" for t, ws in TOPICS.items())}, top_5_keywords FROM u JOIN tok ON tok.doc_id = u.doc_id LEFT JOIN t ON t.doc_id = u.doc_id""")
def nlp_features_wide(spark, d):
    return nlp.features(_records(spark, d), "doc_id", STOP, UNCERTAIN, TOPICS).drop("uncertainty_ratio")


@query(f"WITH {_TOK}, {_EXP} SELECT term AS token, count(*) AS n FROM x WHERE NOT list_contains({_list(STOP)}, term) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25")
def top_tokens(spark, d):
    return nlp.top_tokens(_records(spark, d), 25, STOP)


def _match_sql(source: str = "x") -> str:
    counts = ", ".join(f"count(*) FILTER (WHERE term IN ({', '.join(repr(w) for w in ws)})) AS {c}_count" for c, ws in PROXY.items())
    return f"m AS (SELECT tok.doc_id, count(term) AS total_tokens, count(*) FILTER (WHERE term IN (SELECT term FROM lex)) AS matched_tokens, {counts} FROM tok LEFT JOIN {source} q ON q.doc_id = tok.doc_id GROUP BY tok.doc_id)"


_COUNTS = ", ".join(f"{c}_count" for c in PROXY)


@query(f"WITH {_TOK}, {_EXP}, {_LEX}, {_match_sql()} SELECT doc_id, total_tokens, matched_tokens, {_COUNTS}, round(coalesce(matched_tokens / nullif(total_tokens, 0), 0), 6) AS coverage_ratio FROM m")
def lexicon_match(spark, d):
    return rounded(_matched(spark, d))


@query(f"WITH {_TOK}, {_EXP}, {_LEX}, dx AS (SELECT DISTINCT doc_id, term FROM x), {_match_sql('dx')} SELECT doc_id, total_tokens, matched_tokens, {_COUNTS} FROM m")
def lexicon_match_unique(spark, d):
    return _matched(spark, d, True).drop("coverage_ratio")


@query(f"""WITH {_TOK}, {_EXP}, k AS (SELECT doc_id, term, count(*) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, term) AS rank FROM x WHERE term IN ({", ".join(repr(w) for w in PROXY["positive"])}) GROUP BY 1, 2) SELECT doc_id, rank, term, n FROM k WHERE rank <= 3""")
def lexicon_top_terms(spark, d):
    return rounded(lx.top_terms(_records(spark, d), lx.from_sets(spark, PROXY), ["doc_id"], "positive", 3))


_SCORE = f"""{_TOK}, {_EXP}, {_LEX}, {_match_sql()}, sc AS (SELECT *, coalesce(matched_tokens / nullif(total_tokens, 0), 0) AS coverage_ratio, coalesce((positive_count - negative_count) / nullif(positive_count + negative_count, 0), 0)::DOUBLE AS tone_score FROM m),
sl AS (SELECT *, CASE WHEN total_tokens = 0 THEN 'unknown' WHEN tone_score >= 0.02 THEN 'positive' WHEN tone_score <= -0.02 THEN 'negative' ELSE 'neutral' END AS label, d.lang, d.source FROM sc JOIN (SELECT doc_id AS di, lang, source FROM documents) d ON di = doc_id)"""


@query(f"""WITH {_SCORE} SELECT doc_id, round(tone_score, 6) + 0.0 AS tone_score, round(coalesce(positive_count / nullif(total_tokens, 0), 0), 6) AS positive_ratio, round(coalesce((positive_count - negative_count) / nullif(total_tokens, 0), 0), 6) + 0.0 AS net_ratio, label,
 round(coverage_ratio * abs(tone_score), 6) AS confidence, coverage_ratio < 0.01 AS low_coverage FROM sl""")
def lexicon_score(spark, d):
    return rounded(lx.score(_matched(spark, d)).select("doc_id", "tone_score", "positive_ratio", "net_ratio", "label", "confidence", "low_coverage"))


@query(rf"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z]+') AS l FROM documents), c AS (SELECT doc_id, len(list_filter(l, lambda t: list_contains({_list(PROXY["positive"])}, t)))::BIGINT AS pos, len(list_filter(l, lambda t: list_contains({_list(PROXY["negative"])}, t)))::BIGINT AS neg, len(l)::BIGINT AS words FROM w)
SELECT doc_id, pos, neg, words, round(coalesce((pos - neg) / nullif(pos + neg, 0), 0), 6) + 0.0 AS tone FROM c""")
def lexicon_baseline(spark, d):
    return rounded(lx.baseline_score(table(spark, d, "documents").select("doc_id", "text"), "text", PROXY["positive"], PROXY["negative"]).drop("text"))


def _scored(spark, d):
    names = table(spark, d, "documents").select("doc_id", "lang", "source")
    return lx.score(_matched(spark, d)).join(names, "doc_id")


def _lm_sql(keys: str) -> str:
    return f"""WITH {_SCORE}, g AS (SELECT {keys}, sum(tone_score * total_tokens) / sum(total_tokens) AS mu, median(tone_score) AS median_tone, count(*) AS chunk_count, sum(total_tokens)::BIGINT AS total_tokens, sum(positive_count)::BIGINT AS positive_total, sum(negative_count)::BIGINT AS negative_total,
 count(*) FILTER (WHERE tone_score >= 0.02) / count(*) AS positive_share FROM sl GROUP BY {keys}), v AS (SELECT {keys}, sqrt(sum(sl.total_tokens * pow(tone_score - mu, 2)) / sum(sl.total_tokens)) AS sd FROM sl JOIN g USING ({keys}) GROUP BY {keys})
SELECT {keys}, round(mu, 6) + 0.0 AS mean_tone, round(sd, 6) AS std_tone, round(median_tone, 6) + 0.0 AS median_tone, round(positive_share, 6) AS positive_share, chunk_count, total_tokens, positive_total, negative_total, CASE WHEN mu >= 0.02 THEN 'positive' WHEN mu <= -0.02 THEN 'negative' ELSE 'neutral' END AS label FROM g JOIN v USING ({keys})"""


_LM = ["mean_tone", "std_tone", "median_tone", "positive_share", "chunk_count", "total_tokens", "positive_total", "negative_total", "label"]


@query(_lm_sql("source"))
def lm_aggregate_transcript(spark, d):
    return rounded(lx.aggregate(_scored(spark, d), ["source"]).select("source", *_LM))


@query(_lm_sql("source, lang"))
def lm_aggregate_section(spark, d):
    return rounded(lx.aggregate(_scored(spark, d), ["source", "lang"]).select("source", "lang", *_LM))


@query(_lm_sql("lang"))
def lm_aggregate_speaker(spark, d):
    return rounded(lx.aggregate(_scored(spark, d), ["lang"]).select("lang", *_LM))


@query(f"""WITH {_SCORE}, g AS (SELECT lang, avg(tone_score) AS m, median(tone_score) AS md, stddev_samp(tone_score) AS sd, sum(positive_count)::DOUBLE AS ps, count(total_tokens) AS chunks, sum(total_tokens)::BIGINT AS tokens, sum(tone_score * total_tokens) / sum(total_tokens) AS w FROM sl GROUP BY lang)
SELECT lang, round(m, 6) + 0.0 AS tone_score_mean, round(md, 6) + 0.0 AS tone_score_median, round(sd, 6) AS tone_score_std, chunks, tokens, round(w, 6) + 0.0 AS weighted_tone, CASE WHEN w > 0.02 THEN 'positive' WHEN w < -0.02 THEN 'negative' ELSE 'neutral' END AS label FROM g""")
def lm_groupby_generic(spark, d):
    return rounded(lx.aggregate_generic(_scored(spark, d), ["lang"], ["tone_score"]).drop("tone_score_sum"))


@query(f"WITH {_SCORE} SELECT least(floor((tone_score + 1) / 0.2), 9)::BIGINT AS bin, count(*) AS n FROM sl GROUP BY 1")
def lm_distribution_hist(spark, d):
    return lx.histogram(_scored(spark, d), "tone_score")


@query(f"WITH {_SCORE} SELECT round(avg(coverage_ratio), 6) AS mean, round(median(coverage_ratio), 6) AS median, round(stddev_samp(coverage_ratio), 6) AS std, count(*) FILTER (WHERE coverage_ratio < 0.05) AS low, count(*) FILTER (WHERE coverage_ratio = 0) AS zero, round(sum(matched_tokens) / sum(total_tokens), 6) AS corpus FROM sl")
def lm_coverage(spark, d):
    return rounded(lx.coverage_summary(_scored(spark, d)))


_CLEAN = r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', ' ', 'g'), '(?is)</?ix:[^>]+>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g') AS t FROM pages"""


@query(rf"""WITH a AS ({_CLEAN}), b AS (SELECT page_id, replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') AS t FROM a),
c AS (SELECT page_id, trim(regexp_replace(t, '[ \t\n\v\f\r]+', ' ', 'g'), ' ') AS t FROM b) SELECT page_id, length(t)::BIGINT AS chars, len(list_filter(string_split(t, ' '), lambda w: w <> ''))::BIGINT AS words, md5(t) AS digest FROM c""")
def clean_html(spark, d):
    t = tx.collapse_space(tx.strip_html(F.coalesce("html", F.lit(""))))
    return rounded(table(spark, d, "pages").select("page_id", F.length(t).alias("chars"), tx.word_count(t).alias("words"), F.md5(t.cast("binary")).alias("digest")))


@query(r"""WITH p AS (SELECT doc_id, coalesce(text, '') AS t, nullif(strpos(lower(coalesce(text, '')), 'license'), 0) AS a, nullif(strpos(coalesce(text, ''), 'Released'), 0) AS b FROM documents)
SELECT doc_id, coalesce(a, b, 0)::BIGINT AS position, length(CASE WHEN coalesce(a, b, 0) > 1 THEN substr(t, 1, (coalesce(a, b) - 1)::INTEGER) WHEN coalesce(a, b, 0) = 1 THEN '' ELSE t END)::BIGINT AS prepared_chars FROM p""")
def section_split(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    markers = ["(?i)license", "Released"]
    out = segments.split_sections(docs, "text", markers)
    return rounded(out.select("doc_id", segments.section_position("text", markers).alias("position"), F.length("prepared_remarks").alias("prepared_chars")))


_TURNS = "t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations)"


@query(f"""WITH {_TURNS}, k AS (SELECT *, CASE WHEN lag(role) OVER w IS DISTINCT FROM role THEN 1 ELSE 0 END AS s FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), i AS (SELECT *, sum(s) OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM k)
SELECT conv_id, role, min(turn) AS turn, count(*) AS turns, md5(string_agg(text, ' ' ORDER BY turn)) AS digest, row_number() OVER (PARTITION BY conv_id ORDER BY min(turn)) AS segment_no FROM i GROUP BY conv_id, g, role""")
def merge_adjacent_turns(spark, d):
    out = segments.merge_adjacent(table(spark, d, "conversations"), "conv_id", "turn", ["role"], "text")
    return rounded(out.select("conv_id", "role", "turn", "turns", F.md5(F.col("text").cast("binary")).alias("digest"), "segment_no"))


@query(f"""WITH {_TURNS}, n AS (SELECT *, CASE WHEN role = 'assistant' AND length(text) > 200 THEN 2 WHEN role = 'user' THEN 1 END AS d FROM t)
SELECT conv_id, turn, coalesce(max(d) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS section_no FROM n""")
def section_state(spark, d):
    c = table(spark, d, "conversations")
    detected = F.when((F.col("role") == "assistant") & (F.length(F.coalesce("text", F.lit(""))) > 200), 2).when(F.col("role") == "user", 1)
    return rounded(segments.forward_sections(c, detected, "conv_id", "turn").select("conv_id", "turn", "section_no"))


@query(f"""WITH {_TURNS}, q AS (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS no FROM t), a AS (SELECT *, sum((role = 'assistant')::INT) OVER (PARTITION BY conv_id, no ORDER BY turn) AS k FROM q)
SELECT conv_id, turn, CASE WHEN role = 'user' THEN no WHEN role = 'assistant' AND no > 0 AND k = 1 THEN no END::BIGINT AS pair_no FROM a""")
def qa_pairs(spark, d):
    out = segments.pair_answers(table(spark, d, "conversations"), "conv_id", "turn", F.col("role") == "user", F.col("role") == "assistant")
    return out.select("conv_id", "turn", F.col("pair_no").cast("long").alias("pair_no"))


@query("""WITH s AS (SELECT s_suppkey, CASE s_suppkey % 6 WHEN 0 THEN 'Chief Executive Officer' WHEN 1 THEN 'CFO and Treasurer' WHEN 2 THEN 'Analyst, Capital Markets' WHEN 3 THEN 'Conference Operator' WHEN 4 THEN 'Vice President, Sales' ELSE s_name END AS header FROM supplier)
SELECT s_suppkey, CASE s_suppkey % 6 WHEN 0 THEN 'ceo' WHEN 1 THEN 'cfo' WHEN 2 THEN 'analyst' WHEN 3 THEN 'operator' WHEN 4 THEN 'executive' ELSE 'unknown' END AS role, CASE s_suppkey % 6 WHEN 2 THEN 'analyst' WHEN 3 THEN 'operator' WHEN 5 THEN 'unknown' ELSE 'management' END AS role_type FROM s""")
def role_classify(spark, d):
    k = F.pmod("s_suppkey", F.lit(6))
    header = F.when(k == 0, "Chief Executive Officer").when(k == 1, "CFO and Treasurer").when(k == 2, "Analyst, Capital Markets").when(k == 3, "Conference Operator").when(k == 4, "Vice President, Sales").otherwise(F.col("s_name"))
    role = segments.classify_role(header)
    return table(spark, d, "supplier").select("s_suppkey", role.alias("role"), segments.role_type(role).alias("role_type"))


#: Abbreviations' and initials' dots are guarded before the text is parted.
_GUARDED = r"""regexp_replace(coalesce(text, ''), '(^|[^\p{L}\p{N}_])(""" + "|".join(a.replace(".", r"\.") for a in tx.ABBREVIATIONS) + r"""|[A-Z])\.', '\1\2' || chr(8288), 'g')"""
_PARTED = r"""list_transform(string_split(regexp_replace(""" + _GUARDED + r""", '([.!?])[ \t\n\r]+([A-Z"''0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(replace(x, chr(8288), '.'), ' ' || chr(9) || chr(10) || chr(13)))"""


@query(rf"""WITH s AS (SELECT doc_id, list_filter({_PARTED}, lambda x: x <> '') AS l FROM documents)
SELECT doc_id, len(l)::BIGINT AS n_sentences, coalesce(list_sum(list_transform(l, lambda x: length(x))), 0)::BIGINT AS n_chars FROM s""")
def sentence_split(spark, d):
    out = table(spark, d, "documents").select("doc_id", tx.sentences("text").alias("s"))
    return out.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("n_chars"))


def _sentences(spark, d):
    return segments.sentence_table(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")


@query(rf"""WITH s AS (SELECT doc_id, list_filter({_PARTED}, lambda x: length(x) >= 10 AND len(list_filter(string_split_regex(x, '[ \t\n\v\f\r]+'), lambda w: w <> '')) >= 3) AS l FROM documents), u AS (SELECT doc_id, unnest(l) AS sentence_text, generate_subscripts(l, 1) - 1 AS o FROM s)
SELECT doc_id, o AS sentence_order, substr(sha256(doc_id || '|' || lpad(o::VARCHAR, 6, '0')), 1, 8) AS sentence_id, sentence_text, greatest(ceil(length(sentence_text) / 4.0), ceil(len(list_filter(string_split_regex(sentence_text, '[ \t\n\v\f\r]+'), lambda w: w <> '')) * 1.3))::BIGINT AS token_estimate, (o // 10)::BIGINT AS chunk_candidate FROM u""")
def sentence_table(spark, d):
    return rounded(_sentences(spark, d))


@query()
def chunk_pack(spark, d):
    return segments.pack_chunks(_sentences(spark, d), "doc_id").drop("sentence_ids")


_SENT = rf"""s AS (SELECT doc_id, list_filter({_PARTED}, lambda x: length(x) >= 10 AND len(list_filter(string_split_regex(x, '[ \t\n\v\f\r]+'), lambda w: w <> '')) >= 3) AS l FROM documents)"""


@query(f"WITH {_SENT} SELECT doc_id, len(l)::BIGINT AS sentences, len(l)::BIGINT AS covered, 1.0::DOUBLE AS coverage FROM s WHERE len(l) > 0")
def chunk_coverage(spark, d):
    s = _sentences(spark, d)
    return rounded(segments.chunk_coverage(segments.pack_chunks(s, "doc_id"), s, "doc_id"))


@query(f"WITH {_SENT} SELECT count(*) FILTER (WHERE len(l) > 0) > 0 AS any_chunk, 0::BIGINT AS wrong_overlaps FROM s")
def overlap_check(spark, d):
    out = segments.validate_overlap(segments.pack_chunks(_sentences(spark, d), "doc_id"), "doc_id")
    return out.agg((F.count("*") > 0).alias("any_chunk"), F.count_if(~F.col("overlap_ok")).alias("wrong_overlaps"))


@query(r"""WITH k AS (SELECT doc_id, text, row_number() OVER (PARTITION BY lower(source), lower(substr(text, 1, 200)) ORDER BY doc_id) AS k FROM documents) SELECT doc_id FROM k WHERE k = 1""")
def dedupe_blocks(spark, d):
    return segments.dedupe_blocks(table(spark, d, "documents").select("doc_id", "source", "text"), "source", "text", ["doc_id"]).select("doc_id")


@query(r"""SELECT conv_id, turn, length(coalesce(text, ''))::BIGINT AS char_count, greatest(1, length(coalesce(text, '')) // 4)::BIGINT AS token_estimate, len(list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\v\f\r]+'), lambda w: w <> ''))::BIGINT AS word_count,
 round(coalesce(length(regexp_replace(coalesce(text, ''), '[^\p{L}]', '', 'g')) / nullif(length(coalesce(text, '')), 0), 0), 6) AS letter_share FROM conversations""")
def turn_metrics(spark, d):
    out = segments.turn_metrics(table(spark, d, "conversations"), "text")
    return rounded(out.select("conv_id", "turn", "char_count", "token_estimate", "word_count", "letter_share"))


@query()
def parse_turns(spark, d):
    c = table(spark, d, "conversations")
    line = F.concat(F.initcap("role"), F.lit(": "), F.coalesce("text", F.lit("")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]), "\n")
    return segments.parse_turns(c.groupBy("conv_id").agg(text.alias("text")), "conv_id", "text")


@query("""SELECT CAST(props->>'$.k' AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1""")
def json_props(spark, d):
    return table(spark, d, "events").select(F.from_json("props", "k long")["k"].alias("k")).groupBy("k").agg(F.count("*").alias("n"))


@query("""SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS kinds FROM events GROUP BY user_id""")
def sql_facade(spark, d):
    from ..sources import io

    io.register_views(spark, {"tm_events": f"{d}/events.parquet"})
    return io.query(spark, "SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS kinds FROM tm_events GROUP BY user_id")



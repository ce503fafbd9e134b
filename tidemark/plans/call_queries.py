"""Raw calls read into turns, roles, metadata and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import chunking, roles, segments, turns
from .registry import query, rounded, table

_STRIP = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
#: A call's lines from conversations, in four styles of headers; the same SQL in Spark and DuckDB.
_HEAD = """CASE WHEN style = 0 AND role = 'user' THEN 'Dana Lee - Analyst, Goldman Sachs' || chr(10) WHEN style = 0 AND role = 'assistant' THEN 'Tim Roe - Chief Executive Officer' || chr(10) WHEN style = 0 THEN 'Operator:' || chr(10)
 WHEN style = 1 AND role = 'user' THEN 'Dana Lee' || chr(10) || 'Senior Analyst' || chr(10) WHEN style = 1 AND role = 'assistant' THEN 'Tim Roe' || chr(10) || 'Chief Executive Officer' || chr(10)
 WHEN style = 2 AND role = 'user' THEN 'DANA LEE' || chr(10) WHEN style = 2 AND role = 'assistant' THEN 'TIM ROE' || chr(10)
 WHEN style = 3 AND role = 'user' THEN 'Dana Lee: ' WHEN style = 3 AND role = 'assistant' THEN 'Tim Roe: ' WHEN style = 3 THEN 'Operator: ' ELSE '' END"""
_LINE = f"(CASE WHEN turn = 2 THEN 'We will now begin the question-and-answer session' || chr(10) ELSE '' END) || ({_HEAD}) || body"
_CALLS = rf"""cv AS (SELECT conv_id, turn, role, conv_id % 4 AS style, trim(regexp_replace(coalesce(text, ''), '[ \t\n\r]+', ' ', 'g'), ' ') AS body FROM conversations),
calls AS (SELECT conv_id, string_agg({_LINE}, chr(10) ORDER BY turn) AS text FROM cv GROUP BY conv_id)"""


def calls(spark, d):
    """(conv_id, text) of made-up calls."""
    body = F.btrim(F.regexp_replace(F.coalesce("text", F.lit("")), "[ \t\n\r]+", " "), F.lit(" "))
    lines = table(spark, d, "conversations").select("conv_id", "turn", "role", F.pmod("conv_id", F.lit(4)).alias("style"), body.alias("body"))
    said = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.expr(_LINE).alias("l")))), lambda x: x["l"])
    return lines.groupBy("conv_id").agg(F.array_join(said, "\n").alias("text"))


def _q(pattern: str) -> str:
    return "'" + pattern.replace("(?dm)", "(?m)").replace("'", "''") + "'"


def _n_words(x: str) -> str:
    return rf"len(list_filter(string_split_regex({x}, '[ \t\n\v\f\r]+'), lambda w: w <> ''))"


_P2, _P3, _P4 = map(_q, turns.PASSES)
_SPLIT_HEAD = r"'^([^-:]*?)\s*(?:[-:]\s*(.*))?$'"
_ROLE = " ".join(f"WHEN regexp_matches(both_, {_q(p)}) THEN '{r}'" for p, r, _ in turns.HEADER_ROLES)
_KIND = " ".join(f"WHEN regexp_matches(both_, {_q(p)}) THEN '{k}'" for p, _, k in turns.HEADER_ROLES)
_ANY_ROLE = " OR ".join(f"regexp_matches(both_, {_q(p)})" for p, _, _ in turns.HEADER_ROLES)
_FIRM = "regexp_matches(lower(both_), '" + "|".join(turns.HEADER_FIRMS) + "')"
_OP = r"regexp_matches(both_, '(?i)\boperator\b')"


@query(rf"""WITH {_CALLS}, n AS (SELECT conv_id, trim(regexp_replace(regexp_replace(regexp_replace(translate(text, '‒–—‘’“”', '---''''""'), '([a-z])([A-Z][a-z])', '\1 \2', 'g'), ' {{2,}}', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), {_STRIP}) AS t FROM calls),
q AS (SELECT *, regexp_extract(t, '(?i)we\s+will\s+now\s+begin\s+the\s+question(?:-and-answer)?\s+session') AS m FROM n), b AS (SELECT *, CASE WHEN m <> '' THEN strpos(t, m) + length(m) - 1 ELSE length(t) END AS e FROM q),
sec AS (SELECT conv_id, 0 AS s, 'prepared_remarks' AS sec0, trim(substr(t, 1, e), {_STRIP}) AS t FROM b UNION ALL SELECT conv_id, 1, 'qa', trim(substr(t, e + 1), {_STRIP}) FROM b),
mk AS (SELECT conv_id, s, sec0, string_split(CASE WHEN regexp_matches(t, {_P2}) THEN regexp_replace(t, {_P2}, chr(1) || '\0' || chr(2), 'g') WHEN regexp_matches(t, {_P3}) THEN regexp_replace(t, {_P3}, chr(1) || '\0' || chr(2), 'g') WHEN regexp_matches(t, {_P4}) THEN regexp_replace(t, {_P4}, chr(1) || '\0' || chr(2), 'g') ELSE chr(1) || chr(2) || t END, chr(1)) AS l FROM sec WHERE t <> ''),
pt AS (SELECT conv_id, s, sec0, unnest(l) AS part, generate_subscripts(l, 1) AS p FROM mk),
hd AS (SELECT conv_id, s, p, sec0, CASE WHEN contains(part, chr(2)) THEN trim(replace(split_part(part, chr(2), 1), chr(10), ' - '), {_STRIP}) ELSE '' END AS h, trim(CASE WHEN contains(part, chr(2)) THEN substr(part, strpos(part, chr(2)) + 1) ELSE part END, {_STRIP}) AS text FROM pt WHERE contains(part, chr(2)) OR {_n_words('part')} >= 3),
nm AS (SELECT *, trim(regexp_extract(h, {_SPLIT_HEAD}, 1), {_STRIP}) AS speaker, regexp_extract(h, {_SPLIT_HEAD}, 2) AS title, regexp_extract(h, {_SPLIT_HEAD}, 1) || ' ' || regexp_extract(h, {_SPLIT_HEAD}, 2) AS both_ FROM hd WHERE text <> ''),
ro AS (SELECT *, CASE WHEN h = '' THEN 'Unknown' WHEN {_OP} THEN 'Operator' {_ROLE} WHEN {_FIRM} OR sec0 = 'qa' THEN 'Analyst' ELSE 'Unknown' END AS speaker_role, CASE WHEN h = '' THEN 'unknown' WHEN {_OP} THEN 'operator' {_KIND} WHEN {_FIRM} OR sec0 = 'qa' THEN 'analyst' ELSE 'unknown' END AS speaker_type,
 (CASE WHEN h = '' THEN 0 WHEN {_OP} THEN 1 WHEN {_ANY_ROLE} THEN CASE WHEN title <> '' THEN 0.95 ELSE 0.75 END WHEN {_FIRM} THEN 0.85 WHEN sec0 = 'qa' THEN 0.45 ELSE 0.3 END)::DOUBLE AS rc, {_n_words('text')} AS wc, length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) / length(text) AS share FROM nm),
sg AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY s, p) AS n, CASE WHEN speaker_type = 'operator' THEN 'operator' ELSE sec0 END AS section_type, lower(speaker) AS sc,
 CASE WHEN wc < 5 THEN 0.2 ELSE greatest(0, least(1, CASE WHEN wc < 20 THEN 0.5 ELSE 0.9 END - CASE WHEN share < 0.5 THEN 0.3 WHEN share < 0.7 THEN 0.1 ELSE 0 END - CASE WHEN upper(text) = text AND wc < 10 THEN 0.2 ELSE 0 END)) END::DOUBLE AS ql FROM ro),
fl AS (SELECT *, section_type = 'qa' AND speaker_type = 'analyst' AND regexp_matches(substr(text, 1, 800), {_q(turns.QUESTION)}) AS iq, section_type = 'qa' AND speaker_type = 'executive' AS ia, round(rc * 0.6 + ql * 0.4, 3) AS conf FROM sg),
c1 AS (SELECT *, sum(iq::INT) OVER (PARTITION BY conv_id ORDER BY n) AS no FROM fl), c2 AS (SELECT *, sum(ia::INT) OVER (PARTITION BY conv_id, no ORDER BY n) AS k FROM c1),
c3 AS (SELECT *, CASE WHEN iq OR (ia AND no > 0 AND k = 1) THEN no END AS pair, CASE WHEN coalesce(lag(sc) OVER w = sc AND lag(section_type) OVER w = section_type AND speaker_type <> 'operator', false) THEN 0 ELSE 1 END AS nw FROM c2 WINDOW w AS (PARTITION BY conv_id ORDER BY n)),
c4 AS (SELECT *, sum(nw) OVER (PARTITION BY conv_id ORDER BY n) AS isl FROM c3),
mg AS (SELECT conv_id, isl, arg_min(section_type, n) AS section_type, arg_min(speaker, n) AS speaker, arg_min(sc, n) AS sc, arg_min(speaker_role, n) AS speaker_role, arg_min(speaker_type, n) AS speaker_type, string_agg(text, chr(10) || chr(10) ORDER BY n) AS text, bool_or(iq) AS is_question, bool_or(ia) AS is_answer, arg_min(pair, n) FILTER (WHERE pair IS NOT NULL) AS qa_pair_no, min(conf) AS confidence FROM c4 GROUP BY conv_id, isl),
tk AS (SELECT *, bool_or(speaker_type <> 'operator') OVER (PARTITION BY conv_id) AS talk, {_n_words('text')} AS word_count FROM mg),
dd AS (SELECT *, row_number() OVER (PARTITION BY conv_id, sc, substr(text, 1, 200) ORDER BY isl) AS again FROM tk WHERE NOT talk OR NOT (word_count < 3 AND speaker_type = 'unknown'))
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY isl) - 1 AS order_index, section_type, speaker, speaker_role, speaker_type, is_question, is_answer, qa_pair_no::BIGINT AS qa_pair_no, round(confidence, 3) AS confidence, word_count::BIGINT AS word_count, md5(text) AS digest FROM dd WHERE NOT talk OR again = 1""")
def call_segments(spark, d):
    out = turns.call_segments(calls(spark, d), "conv_id", "text", unicode=False)
    return rounded(out.select("conv_id", "order_index", "section_type", "speaker", "speaker_role", "speaker_type", "is_question", "is_answer", F.col("qa_pair_no").cast("long").alias("qa_pair_no"), "confidence", "word_count", F.md5(F.col("text").cast("binary")).alias("digest")))


def _role_sql(c: str) -> dict[str, str]:
    """Role, type and confidence of a cleaned title as SQL."""
    exact = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in roles.EXACT.items())
    words = " ".join(f"WHEN contains({c}, '{w}') THEN '{r}'" for w, r in roles.KEYWORDS)
    firm = " OR ".join(f"contains({c}, '{f}')" for f in roles.FIRMS)
    e, w = f"(CASE {c} {exact} END)", f"(CASE {words} END)"
    role = f"(CASE WHEN {c} = '' THEN 'Unknown' ELSE coalesce({e}, {w}, CASE WHEN {firm} THEN 'Analyst' END, 'Unknown') END)"
    sure = f"(CASE WHEN {c} = '' THEN 0 WHEN {e} IS NOT NULL THEN 1 WHEN {w} IS NOT NULL THEN 0.8 WHEN {firm} THEN 0.5 ELSE 0 END)::DOUBLE"
    return {"role": role, "confidence": sure}


def _kind_sql(role: str) -> str:
    return f"CASE {role} WHEN 'Unknown' THEN 'unknown' WHEN 'Analyst' THEN 'analyst' WHEN 'Operator' THEN 'operator' ELSE 'management' END"


def _clean_sql(x: str) -> str:
    return rf"regexp_replace(lower(trim(regexp_replace({x}, '[ \t\n\v\f\r]+', ' ', 'g'), ' ')), '[.,;]', '', 'g')"


_TITLES = ["Chief Executive Officer", "CFO and Treasurer", "Vice President, Sales", "Senior  Vice President", "Goldman Sachs", "Conference Operator", "President & CEO", "Chief People Officer", "", "Farmer", "Equity Research Analyst", "Deutsche Bank AG"]
_TITLE = "CASE s_suppkey % 12 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_TITLES)) + " END"
_R = _role_sql("c")


@query(f"WITH t AS (SELECT s_suppkey, {_clean_sql(_TITLE)} AS c FROM supplier), r AS (SELECT s_suppkey, {_R['role']} AS role, {_R['confidence']} AS confidence FROM t) SELECT s_suppkey, role, {_kind_sql('role')} AS speaker_type, confidence FROM r")
def role_cascade(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", roles.role_of(F.expr(_TITLE)).alias("r")).select("s_suppkey", "r.*")


_CAPS = "[" + ", ".join(f"'{w}'" for w in turns.CAPITALS) + "]"
_FOLD = rf"array_to_string(list_transform(list_filter(string_split_regex(line, '[ \t]+'), lambda w: w <> ''), lambda w: CASE WHEN list_contains({_CAPS}, upper(regexp_replace(w, '[.,;:]+$', ''))) THEN upper(w) ELSE array_to_string(list_transform(regexp_extract_all(w, '\p{{L}}+|[^\p{{L}}]+'), lambda x: upper(x[1]) || lower(x[2:])), '') END), ' ')"
_NOISE = " OR ".join(f"regexp_matches(line, {_q(p)})" for p in turns.NOISE_LINES)
_KINDS = " ".join(f"WHEN regexp_matches(line, {_q(p)}) THEN '{k}'" for k, p, _, _, _ in turns.HEADERS)
_NAMES = " ".join(f"WHEN '{k}' THEN regexp_extract(line, {_q(p)}, {n})" for k, p, n, _, _ in turns.HEADERS)
_ROLES = " ".join(f"WHEN '{k}' THEN regexp_extract(line, {_q(p)}, {r})" for k, p, _, r, _ in turns.HEADERS if r)
_SECTION = " ".join(f"WHEN regexp_matches(text, {_q(p)}) THEN {n}" for n, p in turns.BOUNDARIES)


@query(rf"""WITH {_CALLS}, l0 AS (SELECT conv_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM calls),
l1 AS (SELECT conv_id, pos, trim(CASE WHEN length(regexp_replace(line, '[^\p{{L}}]', '', 'g')) >= 4 AND length(regexp_replace(line, '[^\p{{Lu}}]', '', 'g')) >= 0.8 * length(regexp_replace(line, '[^\p{{L}}]', '', 'g')) THEN {_FOLD} ELSE line END, {_STRIP}) AS line FROM l0 WHERE NOT (trim(line, {_STRIP}) <> '' AND ({_NOISE}))),
l2 AS (SELECT *, CASE WHEN length(line) > 3 AND regexp_matches(line, {_q(turns.INLINE)}) THEN 'inline_colon' WHEN length(line) <= 120 THEN CASE {_KINDS} END END AS pattern FROM l1 WHERE line <> ''),
l3 AS (SELECT *, trim(CASE pattern WHEN 'inline_colon' THEN regexp_extract(line, {_q(turns.INLINE)}, 1) {_NAMES} END, ' ') AS name0, trim(coalesce(CASE pattern {_ROLES} END, ''), ' ') AS role0, sum((pattern IS NOT NULL)::INT) OVER (PARTITION BY conv_id ORDER BY pos) AS i FROM l2),
b AS (SELECT conv_id, i, max(pattern) AS pattern, max(name0) AS name0, coalesce(max(role0) FILTER (WHERE pattern IS NOT NULL), '') AS role0, coalesce(string_agg(CASE WHEN pattern IS NULL THEN line WHEN pattern = 'inline_colon' THEN trim(regexp_extract(line, {_q(turns.INLINE)}, 2), ' ') END, ' ' ORDER BY pos), '') AS text FROM l3 WHERE i > 0 GROUP BY conv_id, i),
b1 AS (SELECT conv_id, i, pattern, text, CASE WHEN regexp_matches(lower(name0), '^(operator|moderator|conference\s+operator|coordinator)$') THEN 'Operator' ELSE name0 END AS speaker, CASE WHEN regexp_matches(lower(name0), '^(operator|moderator|conference\s+operator|coordinator)$') THEN 'Operator' ELSE role0 END AS raw_role FROM b),
b2 AS (SELECT *, {_clean_sql('raw_role')} AS c, CASE greatest(1, coalesce(max(CASE {_SECTION} END) OVER (PARTITION BY conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1)) WHEN 1 THEN 'prepared_remarks' WHEN 2 THEN 'qa' ELSE 'closing_remarks' END AS section FROM b1),
b3 AS (SELECT *, {_R['role']} AS r0, {_R['confidence']} AS s0 FROM b2), b4 AS (SELECT *, {_kind_sql('r0')} AS k0 FROM b3),
b5 AS (SELECT *, bool_or(section = 'prepared_remarks' AND lower(speaker) <> 'operator' AND k0 NOT IN ('operator', 'analyst')) OVER (PARTITION BY conv_id, lower(speaker)) AS mg FROM b4),
b6 AS (SELECT *, CASE WHEN k0 <> 'unknown' THEN 0 WHEN mg THEN 1 WHEN section = 'qa' AND lower(speaker) <> 'operator' THEN 2 WHEN section = 'prepared_remarks' AND lower(speaker) <> 'operator' THEN 3 ELSE 0 END AS how, {_n_words('text')} AS word_count FROM b5),
b7 AS (SELECT *, row_number() OVER (PARTITION BY conv_id, lower(speaker), lower(trim(substr(text, 1, 200), ' ')) ORDER BY i) AS again FROM b6 WHERE length(text) >= 10 AND word_count >= 3)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY i) - 1 AS sequence_index, speaker, raw_role, CASE WHEN how = 2 THEN 'Analyst' WHEN how > 0 AND r0 = 'Unknown' THEN 'Management' ELSE r0 END AS normalized_role, CASE how WHEN 2 THEN 'analyst' WHEN 0 THEN k0 ELSE 'management' END AS speaker_type, section,
 greatest(s0, CASE how WHEN 1 THEN 0.4 WHEN 2 THEN 0.45 WHEN 3 THEN 0.35 ELSE 0 END::DOUBLE) AS role_confidence, pattern AS parse_pattern, word_count::BIGINT AS word_count, md5(text) AS digest FROM b7 WHERE again = 1""")
def speaker_blocks(spark, d):
    out = turns.speaker_blocks(calls(spark, d), "conv_id", "text")
    return rounded(out.withColumn("digest", F.md5(F.col("text").cast("binary"))).drop("text"))


_TEXTS = """CASE p_partkey % 5 WHEN 0 THEN 'Acme Widgets Inc. (NYSE: ABC) Q2 fiscal ' || cast(2000 + p_size AS STRING) || ' results call, January 30, 2024' WHEN 1 THEN 'Welcome to the Beta Systems Q3FY29 earnings call. (BETA) 2024-05-02'
 WHEN 2 THEN 'Gamma Corp (GAM) first quarter 2027 conference call, 3 May 2026' WHEN 3 THEN 'CEO remarks on BRK.B 4Q25, 12/31/2025' ELSE 'nothing to be found' END"""


@query("""WITH k AS (SELECT p_partkey, p_partkey % 5 AS k, p_size FROM part), m AS (SELECT p_partkey, CASE k WHEN 0 THEN 'ABC' WHEN 1 THEN 'BETA' WHEN 2 THEN 'GAM' WHEN 3 THEN 'BRK.B' END AS ticker, CASE k WHEN 0 THEN 'Acme Widgets Inc. (NYSE: ABC)' WHEN 1 THEN 'Beta Systems' WHEN 2 THEN 'Gamma' END AS company,
 CASE k WHEN 0 THEN 'Q2' WHEN 1 THEN 'Q3' WHEN 2 THEN 'Q1' WHEN 3 THEN 'Q4' END AS quarter, (CASE k WHEN 0 THEN CASE WHEN p_size <= 40 THEN 2000 + p_size ELSE 2024 END WHEN 1 THEN 2029 WHEN 2 THEN 2027 WHEN 3 THEN 2025 END)::BIGINT AS year, CASE k WHEN 0 THEN DATE '2024-01-30' WHEN 1 THEN DATE '2024-05-02' WHEN 2 THEN DATE '2026-05-03' WHEN 3 THEN DATE '2025-12-31' END AS call_date FROM k)
SELECT *, ticker || '_' || quarter || '_' || year AS transcript_key, ticker IS NOT NULL AS is_complete FROM m""")
def call_metadata(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.expr(_TEXTS).alias("text"))
    return rounded(segments.extract_metadata(p, "text").drop("text"))


_SIZE, _OVER = 100, 20


@query(rf"""WITH RECURSIVE t AS (SELECT doc_id, trim(coalesce(text, ''), {_STRIP}) AS t FROM documents),
s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(t, '([.!?])[ \t\n\v\f\r]+([A-Z"''])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(x, {_STRIP})), lambda x: length(x) > 10) AS l FROM t WHERE length(t) >= 50),
w AS (SELECT doc_id, list_transform(l, lambda x: len(list_filter(string_split_regex(x, '[ \t\n\v\f\r]+'), lambda y: y <> ''))) AS c FROM s WHERE len(l) > 0),
r AS (SELECT doc_id, 1 AS i, 0 AS k, [c[1]] AS h FROM w UNION ALL SELECT doc_id, i + 1, CASE WHEN brk THEN k + 1 ELSE k END, CASE WHEN brk THEN list_append(tail, n) ELSE list_append(h, n) END
 FROM (SELECT r.doc_id, r.i, r.k, r.h, w.c[r.i + 1] AS n, list_sum(r.h) + w.c[r.i + 1] > {_SIZE} AS brk, list_slice(r.h, len(r.h) - len(list_filter(range(1, len(r.h) + 1), lambda j: list_sum(list_slice(r.h, len(r.h) - j + 1, len(r.h))) <= {_OVER})) + 1, len(r.h)) AS tail FROM r JOIN w ON r.doc_id = w.doc_id WHERE r.i < len(w.c))),
g AS (SELECT doc_id, k, arg_max(h, i) AS h, max(k) OVER (PARTITION BY doc_id) AS last FROM r GROUP BY doc_id, k)
SELECT doc_id, k::BIGINT AS chunk_order, list_sum(h)::BIGINT AS token_count, len(h)::BIGINT AS sentence_count FROM g WHERE k < last OR list_sum(h) >= 20""")
def table_chunks(spark, d):
    out = chunking.table_chunks(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", _SIZE, _OVER)
    return rounded(out.select("doc_id", "chunk_order", "token_count", "sentence_count"))


@query()
def speaker_chunks(spark, d):
    """No SQL twin: a fold with overlap over each speaker's turns."""
    return chunking.speaker_chunks(turns.call_segments(calls(spark, d), "conv_id", "text"), "conv_id")


@query(rf"""WITH w AS (SELECT conv_id, turn, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\v\f\r]+'), lambda x: x <> '') AS l FROM conversations),
k AS (SELECT *, list_filter(range(0, len(l) // 5 + 2), lambda j: floor(greatest(len(l) - 5 * j, 0) * 1.35)::INT + 2 <= 60)[1] AS j FROM w)
SELECT conv_id, turn, md5(CASE WHEN j = 0 THEN text ELSE array_to_string(list_slice(l, 1, greatest(len(l) - 5 * j, 0)), ' ') END) AS digest FROM k""")
def truncate_long(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    return c.select("conv_id", "turn", F.md5(chunking.truncate_words("text", 60).cast("binary")).alias("digest"))


@query("WITH n AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) SELECT user_id, arg_max(event_type, (n, event_type)) AS dominant_event_type FROM n GROUP BY 1")
def dominant_value(spark, d):
    return chunking.dominant_value(table(spark, d, "events"), ["user_id"], "event_type")

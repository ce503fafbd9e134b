"""Calls cut into speakers' turns.

Two readers of raw transcripts.  ``call_segments`` looks for headers on lines of
their own, in passes of which the first that finds any is used; ``speaker_blocks``
reads line by line, with seven kinds of headers and speech on the header's line.
Both are column expressions: headers are marked in the text, which is split there.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.scalar import Name, col
from .roles import names_firm, role_of

_BLANKS = " \t\n\x0b\x0c\r"
_HEAD, _BODY = "\x01", "\x02"
#: Passages and marks that are no speech.
NOISE = [
    r"(?is)(?:safe\s+harbor|forward.looking\s+statements?).{0,800}?(?:actual\s+results|differ\s+materially|uncertainties)[^.]*\.",
    r"(?i)(?:copyright|©|\(c\))\s*\d{4}.{0,120}?(?:\n|$)",
    r"(?i)(?:this\s+transcript\s+(?:is|was)\s+produced|refinitiv|seeking\s+alpha|motley\s+fool|s&p\s+global|factset|bloomberg\s+transcript)[^\n]*\n?",
]
#: What opens the questions; the match that ends first counts.
QA_OPENINGS = [
    r"(?im)^\s*question(?:\s*-\s*and\s*-\s*|\s+and\s+)answer(?:s)?\s+session\s*$",
    r"(?im)^\s*questions?\s+and\s+answers?\s*$",
    r"(?i)we\s+will\s+now\s+begin\s+the\s+question(?:-and-answer)?\s+session",
    r"(?i)(?:now\s+)?open(?:ing)?\s+(?:the\s+)?(?:floor|lines?)\s+for\s+questions?",
    r"(?i)(?:our\s+)?first\s+question\s+(?:comes?\s+from|is\s+from)",
    r"(?i)(?:now\s+)?begin(?:ning)?\s+(?:the\s+)?q(?:&|\s+and\s+)a",
    r"(?i)at\s+this\s+time[,\s]+(?:i'd\s+like\s+to\s+)?(?:open|turn).*?(?:questions?|q&a)",
    r"(?im)^\s*\[?\s*q\s*(?:&|and)\s*a\s*(?:session)?\s*\]?\s*$",
]
_OPERATOR = r"[ \t]*(?i:operator)[ \t]*(?::|$)"
#: Header passes, of which the first that finds one is used: name and title on a line, title on the next line, capitals only.
PASSES = [
    rf"(?dm)^(?:{_OPERATOR}|[A-Z][A-Za-z'.-]+(?:[ \t]+[A-Z][A-Za-z'.-]+){{0,4}}[ \t]*[-:][ \t]*[A-Za-z][^\n]{{2,80}}$)",
    r"(?dm)^[A-Z][A-Za-z.-]+(?: +[A-Za-z.-]+){0,4}\n(?:Chief|Senior|Executive|Managing|Vice|President|Analyst|Director|Head|Partner|Officer)[A-Za-z ,.&/]{2,80}$",
    rf"(?dm)^(?:{_OPERATOR}|[A-Z][A-Z .-]{{3,50}}$)",
]
#: Roles by words of a header, tried in this order, with their types.
HEADER_ROLES = [
    (r"(?i)\bchief\s+executive|ceo\b", "CEO", "executive"), (r"(?i)\bchief\s+financial|cfo\b", "CFO", "executive"), (r"(?i)\bchief\s+operating|coo\b", "COO", "executive"),
    (r"(?i)\bpresident\b", "President", "executive"), (r"(?i)\binvestor\s+relations?\b", "IR", "executive"), (r"(?i)\banalyst\b", "Analyst", "analyst"),
]
#: Firms whose name in a header makes the speaker an analyst.
HEADER_FIRMS = [
    "morgan stanley", "goldman sachs", "jp morgan", "jpmorgan", "bank of america", "merrill", "barclays", "citi", "wells fargo", "ubs", "deutsche", "credit suisse", "rbc", "jefferies", "piper sandler", "raymond james", "cowen",
    "evercore", "lazard", "guggenheim", "bernstein", "needham", "oppenheimer", "stifel", "baird", "cantor", "mizuho", "bmo", "truist", "keybanc", "william blair",
]
#: What makes an analyst's turn a question.
QUESTION = r"(?i)(?:\?\s*$|\b(?:could\s+you|can\s+you|would\s+you|what\s+is|what\s+are|how\s+(?:do|does|did|should|would)|why\s+(?:did|do|does|is|are)|when\s+(?:do|did|will|would)|i'?(?:d\s+like\s+to\s+ask|was\s+wondering)|my\s+question\s+is)\b)"


def _strip(c: Column) -> Column:
    return F.btrim(c, F.lit(_BLANKS))


def normalise_call(c: Name, unicode: bool = True) -> Column:
    """Dashes, quotes and blanks in ASCII; disclaimers, notices and providers' lines out; run-together words parted; trimmed."""
    t = F.coalesce(col(c), F.lit(""))
    t = tx.nfkd(t) if unicode else t
    t = F.translate(t, "‒–—‘’“”\u00a0" + _HEAD + _BODY, "---''\"\" ")
    for p in NOISE:
        t = F.regexp_replace(t, p, "")
    t = F.regexp_replace(t, "([a-z])([A-Z][a-z])", "$1 $2")
    t = F.regexp_replace(F.translate(t, "\t", " "), "\r\n?", "\n")
    return _strip(F.regexp_replace(F.regexp_replace(t, " {2,}", " "), "\n{3,}", "\n\n"))


def call_sections(text: Name, openings: list[str] = QA_OPENINGS) -> tuple[Column, Column]:
    """(prepared remarks, questions): parted after the opening that ends first; without any all is prepared."""
    t = col(text)
    ends = [F.when(F.regexp_instr(t, F.lit(p)) > 0, F.regexp_instr(t, F.lit(p)) + F.length(F.regexp_substr(t, F.lit(p))) - 1) for p in openings]
    end = F.coalesce(F.least(*ends), F.length(t))
    return _strip(F.substring(t, F.lit(1), end)), _strip(F.substring(t, end + 1, F.length(t)))


def header_blocks(df: DataFrame, key: str, text: str, unicode: bool = True, least_words: int = 3) -> DataFrame:
    """(key, section_type, s, p, raw_header, text): the blocks under the headers that the first fitting pass finds.

    Text before the first header is a block if it has ``least_words``; a section
    without headers is one block.
    """
    whole = df.select(key, normalise_call(text, unicode).alias("__t"))
    prepared, qa = call_sections("__t")
    part = lambda name, i, c: F.struct(F.lit(name).alias("section_type"), F.lit(i).alias("s"), c.alias("t"))
    each = whole.select(key, F.explode(F.array(part("prepared_remarks", 0, prepared), part("qa", 1, qa))).alias("x")).select(key, "x.*").filter("t != ''")
    marked = None
    for p in PASSES:
        hit, cut = F.col("t").rlike(p), F.regexp_replace("t", p, f"{_HEAD}$0{_BODY}")
        marked = F.when(hit, cut) if marked is None else marked.when(hit, cut)
    parts = each.select(key, "section_type", "s", F.posexplode(F.split(marked.otherwise(F.concat(F.lit(_HEAD + _BODY), F.col("t"))), _HEAD)).alias("p", "part"))
    at = F.instr("part", _BODY)
    header = F.when(at > 0, _strip(F.replace(F.substring_index("part", _BODY, 1), F.lit("\n"), F.lit(" - ")))).otherwise("")
    body = F.when(at > 0, F.substring(F.col("part"), at + 1, F.length("part"))).otherwise(F.col("part"))
    return parts.filter((at > 0) | (tx.word_count("part") >= least_words)).select(key, "section_type", "s", "p", header.alias("raw_header"), clean_segment(body).alias("text")).filter("text != ''")


def clean_segment(c: Column) -> Column:
    """Blanks collapsed; marks of a transcript's end out."""
    t = F.regexp_replace(F.regexp_replace(_strip(c), "[ \t]{2,}", " "), "\n{3,}", "\n\n")
    return _strip(F.regexp_replace(t, r"(?i)\s*(?:\[end of transcript\]|end of transcript|\[end\]|end of call)\s*$", ""))


def header_speaker(header: Name, section: Name) -> Column:
    """struct(speaker, speaker_role, speaker_type, confidence): the operator, then words of the title, then firms, then the section."""
    h = col(header)
    name, title = F.regexp_extract(h, r"^([^-:]*?)\s*(?:[-:]\s*(.*))?$", 1), F.regexp_extract(h, r"^([^-:]*?)\s*(?:[-:]\s*(.*))?$", 2)
    both = F.concat_ws(" ", name, title)
    as_ = lambda role, kind, sure: F.struct(_strip(name).alias("speaker"), F.lit(role).alias("speaker_role"), F.lit(kind).alias("speaker_type"), sure.cast("double").alias("confidence"))
    out = F.when(h == "", F.struct(F.lit("").alias("speaker"), F.lit("Unknown").alias("speaker_role"), F.lit("unknown").alias("speaker_type"), F.lit(0.0).alias("confidence")))
    out = out.when(both.rlike(r"(?i)\boperator\b"), as_("Operator", "operator", F.lit(1.0)))
    for p, role, kind in HEADER_ROLES:
        out = out.when(both.rlike(p), as_(role, kind, F.when(_strip(title) != "", 0.95).otherwise(0.75)))
    out = out.when(names_firm(F.lower(both), HEADER_FIRMS), as_("Analyst", "analyst", F.lit(0.85)))
    return out.when(col(section) == "qa", as_("Analyst", "analyst", F.lit(0.45))).otherwise(as_("Unknown", "unknown", F.lit(0.3)))


def text_quality(c: Name, n_words: Column) -> Column:
    """Between 0 and 1: less for short texts, few letters and short texts in capitals."""
    share = tx.letter_share(c)
    base = F.when(n_words < 20, 0.5).otherwise(0.9) - F.when(share < 0.5, 0.3).when(share < 0.7, 0.1).otherwise(0.0) - F.when((F.upper(col(c)) == col(c)) & (n_words < 10), 0.2).otherwise(0.0)
    return F.when(n_words < 5, 0.2).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), base)), 3))


def blend_confidence(role: Name, quality: Name, with_header: Column | None = None) -> Column:
    """Six tenths of the role's and four of the text's; 0.05 more for a header, where that is asked for."""
    bonus = F.when(with_header, 0.05).otherwise(0.0) if with_header is not None else F.lit(0.0)
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), col(role) * 0.6 + col(quality) * 0.4 + bonus)), 3)


def call_segments(df: DataFrame, key: str, text: str, unicode: bool = True, merge: bool = True, least_words: int = 3) -> DataFrame:
    """A row for each turn of each transcript in ``text``, with speaker, role, question and answer marks, confidence and order.

    ``qa_pair_no`` links a question with the first answer after it.  Neighbouring
    turns of one speaker are merged.  Turns of unknown speakers under
    ``least_words`` and later repeats (speaker and first 200 characters) go,
    unless the whole transcript is the operator's.
    """
    blocks = header_blocks(df, key, text, unicode, least_words)
    w = Window.partitionBy(key).orderBy("s", "p")
    seg = blocks.withColumn("who", header_speaker("raw_header", "section_type")).select("*", "who.speaker", "who.speaker_role", "who.speaker_type", F.col("who.confidence").alias("__role"))
    kind, section = F.col("speaker_type"), F.when(F.col("speaker_type") == "operator", "operator").otherwise(F.col("section_type"))
    seg = seg.withColumns({"section_type": section, "n": F.row_number().over(w), "__words": tx.word_count("text"), "speaker_clean": F.lower("speaker")})
    seg = seg.withColumns({
        "is_question": (F.col("section_type") == "qa") & (kind == "analyst") & F.substring("text", 1, 800).rlike(QUESTION),
        "is_answer": (F.col("section_type") == "qa") & (kind == "executive"),
        "confidence": blend_confidence("__role", text_quality("text", F.col("__words"))),
    })
    from .segments import pair_answers

    seg = pair_answers(seg, key, "n", F.col("is_question"), F.col("is_answer")).withColumnRenamed("pair_no", "qa_pair_no")
    by = Window.partitionBy(key).orderBy("n")
    joins = (F.lag("speaker_clean").over(by) == F.col("speaker_clean")) & (F.lag("section_type").over(by) == F.col("section_type")) & (kind != "operator")
    seg = seg.withColumn("__new", F.when(F.lit(merge) & F.coalesce(joins, F.lit(False)), 0).otherwise(1)).withColumn("__island", F.sum("__new").over(by))
    first = lambda c: F.min_by(c, "n").alias(c)
    texts = F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"])
    out = seg.groupBy(key, "__island").agg(
        *[first(c) for c in ("section_type", "speaker", "speaker_clean", "speaker_role", "speaker_type", "raw_header")], F.array_join(texts, "\n\n").alias("text"),
        F.bool_or("is_question").alias("is_question"), F.bool_or("is_answer").alias("is_answer"), F.min_by("qa_pair_no", F.when(F.col("qa_pair_no").isNotNull(), F.col("n"))).alias("qa_pair_no"), F.min("confidence").alias("confidence"),
    )
    out = out.withColumns({"word_count": tx.word_count("text"), "char_count": F.length("text"), "token_estimate": F.greatest(F.lit(1), F.floor(F.length("text") / 4).cast("int"))})
    out = out.withColumn("__talk", F.bool_or(F.col("speaker_type") != "operator").over(Window.partitionBy(key)))
    out = out.filter(~F.col("__talk") | ~((F.col("word_count") < least_words) & (F.col("speaker_type") == "unknown")))
    again = F.row_number().over(Window.partitionBy(key, "speaker_clean", F.substring("text", 1, 200)).orderBy("__island"))
    out = out.withColumn("__again", again).filter(~F.col("__talk") | (F.col("__again") == 1))
    return out.withColumn("order_index", F.row_number().over(Window.partitionBy(key).orderBy("__island")) - 1).drop("__island", "__talk", "__again")


_NAME = r"[A-Z][a-zA-Z.'’-]+"
_TITLE = r"[A-Za-z][A-Za-z0-9 \t&,.()/'-]{1,80}"
#: Kinds of header lines, tried in this order: pattern, groups of name and title (0: none), confidence.
HEADERS = [
    ("double_dash", rf"^({_NAME}(?:[ \t]+{_NAME})*)[ \t]+(?:--|[-–—])[ \t]+({_TITLE})[ \t]*$", 1, 2, 1.0),
    ("single_dash", rf"^({_NAME}(?:[ \t]+{_NAME})+)[ \t]+-[ \t]+({_TITLE})[ \t]*$", 1, 2, 0.9),
    ("comma_role_colon", rf"^({_NAME}(?:[ \t]+{_NAME})*),[ \t]+({_TITLE}):?[ \t]*$", 1, 2, 0.95),
    ("name_colon_only", rf"^({_NAME}(?:[ \t]+{_NAME})+):[ \t]*$", 1, 0, 0.8),
    ("role_prefix_name", rf"^(CEO|CFO|COO|CTO|CIO|CMO|SVP|EVP|VP|President|Analyst|Operator|Director|Chairman)[ \t]+({_NAME}(?:[ \t]+{_NAME})*)[ \t]*$", 2, 1, 0.8),
    ("standalone_token", r"(?i)^(Operator|Moderator|Coordinator|Conference[ \t]+Operator|Conference[ \t]+Moderator|Unidentified[ \t]+(?:Analyst|Participant|Speaker))[ \t]*:?[ \t]*$", 1, 0, 0.9),
    ("allcaps_name", rf"^([A-Z]{{2,}}(?:[ \t.]+[A-Z]{{2,}})+)(?:[ \t]*[,:-][ \t]*({_TITLE}))?:?[ \t]*$", 1, 2, 0.7),
]
INLINE = rf"^(Operator|Moderator|Coordinator|{_NAME}(?:[ \t]+{_NAME}){{1,4}})[ \t]*:[ \t]+([^ \t].*)$"
#: Confidence of a kind of header, 0.5 for others.
CONFIDENCE = {name: sure for name, _, _, _, sure in HEADERS} | {"inline_colon": 0.75}
#: Words that stay in capitals.
CAPITALS = ["CEO", "CFO", "COO", "CTO", "CIO", "CMO", "EVP", "SVP", "VP", "MD", "IR", "USA", "INC", "LLC", "LP", "LTD", "PLC"]
#: Lines that are no speech.
NOISE_LINES = [
    r"(?i)^\s*\[?\d{1,2}:\d{2}(?::\d{2})?\s*(?:AM|PM)?\]?\s*$", r"^\s*[-=*]{3,}\s*$", r"(?i)^\s*Page\s+\d+\s*(?:of\s+\d+)?\s*$", r"(?i)^\s*\[?\s*(?:applause|laughter|pause|silence|inaudible|crosstalk)\s*\]?\s*$",
    r"(?i)^\s*\(?\s*(?:applause|laughter|pause|inaudible|crosstalk)\s*\)?\s*$", r"(?i)^\s*(?:end\s+of\s+transcript|transcript\s+end)\s*$", r"(?i)^\s*\[?\s*(?:operator\s+instructions?)\s*\]?\s*$",
]
#: Phrases that announce prepared remarks (1), questions (2) and the close (3), tried in this order.
BOUNDARIES = [
    (1, r"(?i)\b(prepared\s+remarks?|management\s+remarks?|opening\s+(?:remarks?|statement))\b"),
    (2, r"(?i)\b(questions?\s+and\s+answers?|q\s*(?:and|&)\s*a|now\s+(?:take|open|begin|start)\s+(?:your\s+)?questions?|open\s+(?:the\s+)?(?:floor|call)\s+(?:for|to)\s+questions?|now\s+turn\s+(?:the\s+call\s+)?(?:over\s+)?(?:back\s+)?to\s+questions?|we\s+will\s+now\s+(?:begin|conduct|open)\s+(?:the\s+)?question)\b"),
    (3, r"(?i)\b(closing\s+remarks?|concluding\s+remarks?|that\s+(?:concludes?|ends?|completes?)\s+(?:today['s]*\s+)?(?:call|conference|presentation|earnings)|this\s+(?:concludes?|ends?|completes?)\s+(?:the\s+)?(?:call|conference|earnings\s+call)|thank\s+you\s+(?:all\s+)?for\s+(?:joining|participating|attending|your\s+time))\b"),
]


def is_noise(line: Name) -> Column:
    return (_strip(col(line)) != "") & reduce(lambda a, b: a | b, [col(line).rlike(p) for p in NOISE_LINES])


def fold_capitals(line: Name) -> Column:
    """Each word with a capital first letter only, but for ``CAPITALS``."""
    title = lambda w: F.array_join(F.transform(F.regexp_extract_all(w, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0)), lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, F.lit(2), F.length(x))))), "")
    kept = F.array(*map(F.lit, CAPITALS))
    return F.array_join(F.transform(tx.words(line), lambda w: F.when(F.array_contains(kept, F.upper(F.regexp_replace(w, "[.,;:]+$", ""))), F.upper(w)).otherwise(title(w))), " ")


def canonical_speaker(name: Column, role: Column) -> tuple[Column, Column]:
    """One name for operators and moderators, and for unidentified speakers."""
    n = F.lower(_strip(name))
    op, analyst, other = n.rlike(r"^(operator|moderator|conference\s+operator|coordinator)$"), n.rlike(r"^unidentified\s+analyst$"), n.rlike(r"^unidentified\s+(participant|speaker)$")
    return F.when(op, "Operator").when(analyst, "Unidentified Analyst").when(other, "Unidentified Participant").otherwise(name), F.when(op, "Operator").when(analyst, "Analyst").otherwise(role)


def parse_header(line: Name, most: int = 120) -> Column:
    """struct(pattern, speaker, role, confidence) of a header line, null for other lines and long ones."""
    c, out = col(line), None
    for kind, p, n, r, sure in HEADERS:
        name = F.btrim(F.regexp_extract(c, p, n))
        name = fold_capitals(name) if kind == "allcaps_name" else name
        name, role = canonical_speaker(name, F.btrim(F.regexp_extract(c, p, r)) if r else F.lit(""))
        s = F.struct(F.lit(kind).alias("pattern"), name.alias("speaker"), role.alias("role"), F.lit(sure).alias("confidence"))
        out = F.when(c.rlike(p), s) if out is None else out.when(c.rlike(p), s)
    return F.when(F.length(c) <= most, out)


def parse_inline(line: Name) -> tuple[Column, Column]:
    """The header as ``parse_header`` gives it and the speech, of a line that has both; else nulls."""
    c = col(line)
    hit = (F.length(c) > 3) & c.rlike(INLINE)
    name, role = canonical_speaker(F.btrim(F.regexp_extract(c, INLINE, 1)), F.lit(""))
    s = F.struct(F.lit("inline_colon").alias("pattern"), name.alias("speaker"), role.alias("role"), F.lit(CONFIDENCE["inline_colon"]).alias("confidence"))
    return F.when(hit, s), F.when(hit, F.btrim(F.regexp_extract(c, INLINE, 2)))


def speaker_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, line, header, speech): lines without noise and blanks, capitals folded, with what header each is."""
    raw = df.select(key, F.posexplode(F.split(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "\r\n?", "\n"), "\n")).alias("pos", "line"))
    line = F.when(tx.is_allcaps("line"), fold_capitals("line")).otherwise(F.col("line"))
    lines = raw.filter(~is_noise("line")).select(key, "pos", _strip(line).alias("line")).filter("line != ''")
    inline, speech = parse_inline("line")
    return lines.select(key, "pos", "line", F.coalesce(inline, parse_header("line")).alias("header"), speech.alias("speech"))


def speaker_blocks(df: DataFrame, key: str, text: str, least_chars: int = 10, least_words: int = 3, operator: bool = True) -> DataFrame:
    """(key, sequence_index, speaker, raw_role, normalized_role, speaker_type, section, text, word_count, role_confidence, parse_pattern).

    Lines without a header go on with the turn before; those before the first
    header are dropped.  A turn's section is the furthest that earlier turns
    announced.  Unknown speakers are management if they speak in the prepared
    remarks, else analysts in the questions.  Short turns and later repeats go.
    """
    lines = speaker_lines(df, key, text)
    lines = lines.withColumn("__i", F.sum(F.col("header").isNotNull().cast("int")).over(Window.partitionBy(key).orderBy("pos"))).filter("__i > 0")
    part = F.when(F.col("header").isNull(), F.col("line")).otherwise(F.col("speech"))
    said = F.transform(F.array_sort(F.collect_list(F.struct("pos", part.alias("t")))), lambda x: x["t"])
    blocks = lines.groupBy(key, "__i").agg(F.max("header").alias("h"), F.array_join(said, " ").alias("text"))
    blocks = blocks.select(key, "__i", F.col("h.speaker").alias("speaker"), F.col("h.role").alias("raw_role"), F.col("h.pattern").alias("parse_pattern"), role_of("h.role").alias("r"), "text")
    detected = None
    for state, p in BOUNDARIES:
        detected = F.when(F.col("text").rlike(p), state) if detected is None else detected.when(F.col("text").rlike(p), state)
    state = F.greatest(F.lit(1), F.coalesce(F.max(detected).over(Window.partitionBy(key).orderBy("__i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(1)))
    blocks = blocks.withColumn("section", F.get(F.array(*map(F.lit, ("", "prepared_remarks", "qa", "closing_remarks"))), state))
    blocks = infer_types(blocks.select("*", F.col("r.role").alias("normalized_role"), F.col("r.speaker_type").alias("speaker_type"), F.col("r.confidence").alias("role_confidence")).drop("r"), key)
    good = (F.length("text") >= least_chars) & (tx.word_count("text") >= least_words)
    blocks = blocks.filter(good if operator else good & (F.col("speaker_type") != "operator"))
    again = F.row_number().over(Window.partitionBy(key, F.lower("speaker"), F.lower(F.btrim(F.substring("text", 1, 200)))).orderBy("__i"))
    blocks = blocks.withColumn("__again", again).filter("__again = 1")
    index = F.row_number().over(Window.partitionBy(key).orderBy("__i")) - 1
    return blocks.select(key, index.alias("sequence_index"), "speaker", "raw_role", "normalized_role", "speaker_type", "section", "text", tx.word_count("text").alias("word_count"), "role_confidence", "parse_pattern")


def infer_types(blocks: DataFrame, key: str) -> DataFrame:
    """Types of unknown speakers by where they speak; known types stay."""
    prepared, named = F.col("section") == "prepared_remarks", F.lower("speaker") != "operator"
    manages = F.bool_or(prepared & named & ~F.col("speaker_type").isin("operator", "analyst")).over(Window.partitionBy(key, F.lower("speaker")))
    how = F.when(F.col("speaker_type") != "unknown", None).when(manages, 1).when((F.col("section") == "qa") & named, 2).when(prepared & named, 3)
    role = F.when(how == 2, "Analyst").when(how.isNotNull() & (F.col("normalized_role") == "Unknown"), "Management").otherwise(F.col("normalized_role"))
    sure = F.greatest("role_confidence", F.when(how == 1, 0.4).when(how == 2, 0.45).when(how == 3, 0.35).otherwise(0.0))
    return blocks.withColumn("__how", how).withColumns({"normalized_role": role, "role_confidence": sure, "speaker_type": F.when(F.col("__how") == 2, "analyst").when(F.col("__how").isNotNull(), "management").otherwise(F.col("speaker_type"))}).drop("__how")


def frequencies(blocks: DataFrame, column: str) -> DataFrame:
    """(value, n) of sections or header kinds."""
    return blocks.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))

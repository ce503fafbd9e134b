"""Speaker turns: sections, roles, merging, questions with their answers, sentences and chunks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.scalar import col, safe_divide

SECTIONS = ("opening", "prepared", "qa", "closing")
#: A short list of roles by words of a header, tried in this order; ``roles`` has the full cascade.
ROLE_WORDS = [
    ("ceo", ["chief executive", "ceo"]), ("cfo", ["chief financial", "cfo"]), ("coo", ["chief operating", "coo"]), ("cto", ["chief technology", "cto"]),
    ("chair", ["chairman", "chairwoman", "chairperson"]), ("executive", ["vice president"]), ("president", ["president"]), ("investor_relations", ["investor relations"]),
    ("analyst", ["analyst", "research", "securities", "capital markets"]), ("operator", ["operator", "moderator", "coordinator"]), ("executive", ["director", "officer", "head of"]),
]
#: What a role is among.
ROLE_TYPES = {"ceo": "management", "cfo": "management", "coo": "management", "cto": "management", "chair": "management", "president": "management", "investor_relations": "management", "executive": "management", "analyst": "analyst", "operator": "operator"}
#: Opening phrases of a question-and-answer part.
QA_MARKERS = [r"(?i)question[- ]and[- ]answer", r"(?i)\bq ?& ?a\b", r"(?i)we will now (begin|take) (the )?questions?", r"(?i)our first question"]


def classify_role(header: Column | str) -> Column:
    """The first role whose words stand in the header, "unknown" otherwise."""
    h = F.lower(F.trim(F.coalesce(col(header), F.lit(""))))
    out = None
    for role, words in ROLE_WORDS:
        hit = h.rlike(r"\b(" + "|".join(words) + r")\b")
        out = F.when(hit, role) if out is None else out.when(hit, role)
    return out.otherwise("unknown")


def role_type(role: Column | str) -> Column:
    m = F.create_map(*[F.lit(x) for kv in ROLE_TYPES.items() for x in kv])
    return F.coalesce(F.try_element_at(m, col(role)), F.lit("unknown"))


def section_position(text: Column | str, markers: list[str] = QA_MARKERS) -> Column:
    """Where (from 1) the first pattern that matches does so, in the order of the patterns; 0 if none does."""
    out = F.lit(None).cast("int")
    for p in markers:
        out = F.coalesce(out, F.nullif(F.regexp_instr(col(text), F.lit(p)), F.lit(0)))
    return F.coalesce(out, F.lit(0))


def split_sections(df: DataFrame, text: str, markers: list[str] = QA_MARKERS) -> DataFrame:
    """Adds ``prepared_remarks`` and ``qa_section``; without a marker all is prepared."""
    at = section_position(text, markers)
    out = df.withColumn("__at", at)
    return out.withColumns({
        "prepared_remarks": F.when(F.col("__at") > 1, F.expr(f"substring({text}, 1, __at - 1)")).when(F.col("__at") == 1, "").otherwise(F.col(text)),
        "qa_section": F.when(F.col("__at") > 0, F.expr(f"substring({text}, __at)")).otherwise(""),
    }).drop("__at")


def forward_sections(turns: DataFrame, detected: Column, key: str, order: str) -> DataFrame:
    """A turn's section is the furthest that an earlier turn announced: the state only moves forward.

    ``detected`` is the number of the section that a turn announces, null if none.
    """
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    state = F.coalesce(F.max(detected).over(before), F.lit(0))
    names = F.array(*map(F.lit, SECTIONS))
    return turns.withColumns({"section_no": state, "section": F.get(names, state.cast("int"))})


def merge_adjacent(turns: DataFrame, key: str, order: str, same: list[str], text: str) -> DataFrame:
    """Neighbouring turns that agree in ``same`` become one, texts joined by a space."""
    w = Window.partitionBy(key).orderBy(order)
    here, before = F.struct(*same), F.lag(F.struct(*same)).over(w)
    out = turns.withColumn("__new", F.when(before.isNull() | ~here.eqNullSafe(before), 1).otherwise(0))
    out = out.withColumn("__island", F.sum("__new").over(w))
    parts = F.array_sort(F.collect_list(F.struct(order, F.coalesce(F.col(text), F.lit("")).alias("t"))))
    merged = out.groupBy(key, "__island", *same).agg(F.min(order).alias(order), F.count("*").alias("turns"), F.array_join(F.transform(parts, lambda x: x["t"]), " ").alias(text))
    return merged.withColumn("segment_no", F.row_number().over(Window.partitionBy(key).orderBy(order))).drop("__island")


def pair_answers(turns: DataFrame, key: str, order: str, question: Column, answer: Column) -> DataFrame:
    """Adds ``pair_no``: questions are counted, and the first answer after one has its number."""
    w = Window.partitionBy(key).orderBy(order)
    out = turns.withColumns({"__q": question, "__a": answer & ~question})
    out = out.withColumn("__no", F.sum(F.col("__q").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    seen = F.sum(F.col("__a").cast("int")).over(Window.partitionBy(key, "__no").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    out = out.withColumn("__nth", seen)
    pair = F.when(F.col("__q"), F.col("__no")).when((F.col("__no") > 0) & F.col("__a") & (F.col("__nth") == 1), F.col("__no"))
    return out.withColumn("pair_no", pair).drop("__q", "__a", "__no", "__nth")


def dedupe_blocks(turns: DataFrame, speaker: str, text: str, order: list[str]) -> DataFrame:
    """Of turns with one speaker and the same first 200 characters (any case) the first stays."""
    w = Window.partitionBy(F.lower(speaker), F.lower(F.substring(text, 1, 200))).orderBy(*order)
    return turns.withColumn("__k", F.row_number().over(w)).filter("__k = 1").drop("__k")


def turn_metrics(df: DataFrame, text: str) -> DataFrame:
    return df.withColumns({"word_count": tx.word_count(text), "char_count": F.length(F.coalesce(F.col(text), F.lit(""))), "token_estimate": F.greatest(F.lit(1), F.floor(F.length(F.coalesce(F.col(text), F.lit(""))) / 4).cast("int")), "is_question": tx.is_question(text), "letter_share": tx.letter_share(text)})


def parse_turns(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, order_index, speaker, text): lines that begin with ``Name:`` open a turn, other lines go on with it."""
    lines = df.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("line_no", "line"))
    head = F.regexp_extract("line", r"^([A-Z][A-Za-z.'-]+(?: [A-Z][A-Za-z.'-]+){0,3}) ?:", 1)
    w = Window.partitionBy(key).orderBy("line_no")
    cut = lines.withColumns({"__h": head, "__t": F.regexp_replace("line", r"^[A-Z][A-Za-z.'-]+( [A-Z][A-Za-z.'-]+){0,3} ?:[ \t]*", "")})
    cut = cut.withColumn("__i", F.sum((F.col("__h") != "").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "__t"))), lambda x: x["__t"])
    out = cut.groupBy(key, "__i").agg(F.max("__h").alias("speaker"), tx.collapse_space(F.array_join(parts, " ")).alias("text"))
    return out.filter("text != ''").select(key, (F.row_number().over(Window.partitionBy(key).orderBy("__i")) - 1).alias("order_index"), F.when(F.col("speaker") == "", "unknown").otherwise(F.col("speaker")).alias("speaker"), "text")


def sentence_table(df: DataFrame, key: str, text: str, least_chars: int = 10, least_words: int = 3, window: int = 10) -> DataFrame:
    """(key, sentence_order, sentence_id, sentence_text, token_estimate, chunk_candidate): sentences too short are dropped."""
    each = df.select(key, F.posexplode(tx.sentences(text)).alias("pos", "sentence_text"))
    each = each.filter((F.length("sentence_text") >= least_chars) & (tx.word_count("sentence_text") >= least_words))
    out = each.withColumn("sentence_order", F.row_number().over(Window.partitionBy(key).orderBy("pos")) - 1)
    return out.select(key, "sentence_order", tx.stable_id(key, F.lpad(F.col("sentence_order").cast("string"), 6, "0")).alias("sentence_id"), "sentence_text", tx.token_estimate("sentence_text").alias("token_estimate"), F.floor(F.col("sentence_order") / window).alias("chunk_candidate"))


def pack_chunks(sentences: DataFrame, key: str, order: str = "sentence_order", text: str = "sentence_text", tokens: str = "token_estimate", section: str | None = None, target: int = 120, overlap: int = 20, prefix: str = "chunk") -> DataFrame:
    """Greedy chunks of up to ``target`` tokens with an overlap of whole sentences of up to ``overlap``.

    A section's end closes a chunk without overlap; a sentence longer than the
    target stands alone.  The fold runs over each document's sentences in order.
    """
    kind = sentences.schema[key].dataType.simpleString()

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        out: list[tuple] = []
        held: list[tuple] = []  # (order, text, tokens), of which the first ``old`` are overlap
        old, size, here = 0, 0, None

        def close() -> None:
            out.append((pdf[key].iloc[0], len(out), here, " ".join(x[1] for x in held), size, len(held), old, held[0][0], held[-1][0], [x[0] for x in held]))

        for o, t, n, s in zip(pdf[order].tolist(), pdf[text].tolist(), pdf[tokens].tolist(), pdf[section].tolist() if section else [None] * len(pdf), strict=True):
            if len(held) > old and (size + n > target or s != here):
                close()
                tail: list[tuple] = []
                while s == here and len(tail) < len(held) - 1 and sum(x[2] for x in tail) + held[-1 - len(tail)][2] <= overlap:
                    tail.insert(0, held[-1 - len(tail)])
                held, old = tail, len(tail)
                size = sum(x[2] for x in held)
                if held and size + n > target:
                    held, old, size = [], 0, 0
            elif s != here:
                held, old, size = [], 0, 0
            here = s
            held.append((o, t, n))
            size += n
        if len(held) > old:
            close()
        return pd.DataFrame(out, columns=[key, "chunk_order", "section", "chunk_text", "token_count", "sentence_count", "overlap_sentences", "first_sentence", "last_sentence", "sentence_ids"])

    packed = sentences.groupBy(key).applyInPandas(pack, f"{key} {kind}, chunk_order int, section string, chunk_text string, token_count long, sentence_count int, overlap_sentences int, first_sentence long, last_sentence long, sentence_ids array<long>")
    return packed.withColumn("chunk_id", F.concat_ws("_", F.lit(prefix), F.col(key).cast("string"), F.lpad(F.col("chunk_order").cast("string"), 6, "0"), F.substring(F.sha1(F.concat_ws("|", F.lit(prefix), F.col(key).cast("string"), F.col("chunk_order").cast("string"))), 1, 8)))


def chunk_coverage(chunks: DataFrame, sentences: DataFrame, key: str) -> DataFrame:
    """Per document: sentences, those in some chunk, coverage, and whether neighbours share as they say."""
    got = chunks.select(key, F.explode("sentence_ids").alias("s")).groupBy(key).agg(F.count_distinct("s").alias("covered"))
    total = sentences.groupBy(key).agg(F.count("*").alias("sentences"))
    return total.join(got, key, "left").select(key, "sentences", F.coalesce("covered", F.lit(0).cast("long")).alias("covered"), safe_divide("covered", "sentences").alias("coverage"))


def validate_overlap(chunks: DataFrame, key: str) -> DataFrame:
    """Per chunk whether the sentences it says it repeats are the last of the one before."""
    w = Window.partitionBy(key).orderBy("chunk_order")
    n = F.col("overlap_sentences")
    shared = F.size(F.array_intersect(F.lag("sentence_ids").over(w), F.col("sentence_ids")))
    return chunks.select(key, "chunk_order", "overlap_sentences", (F.coalesce(shared, F.lit(0)) == n).alias("overlap_ok"))


def rebuild(chunks: DataFrame, key: str) -> DataFrame:
    """Each document's sentence numbers, once each and in order, from its overlapping chunks."""
    ids = chunks.select(key, F.explode("sentence_ids").alias("s")).distinct()
    return ids.groupBy(key).agg(F.array_sort(F.collect_list("s")).alias("sentence_ids"))


#: Capitals that are no ticker.
NO_TICKERS = [
    "Q1", "Q2", "Q3", "Q4", "FY", "YTD", "YOY", "QOQ", "MOM", "CEO", "CFO", "COO", "CTO", "CMO", "CRO", "CIO", "CLO", "VP", "SVP", "EVP", "AVP", "MD", "IR", "GM",
    "EPS", "PE", "VC", "IPO", "EBITDA", "GAAP", "OPEX", "CAPEX", "ARR", "MRR", "LTV", "CAC", "FCF", "NOI", "NII", "ROE", "ROA", "NYSE", "NASDAQ", "AMEX", "OTC", "SEC", "FDIC", "FED", "SPX", "DJI", "VIX",
    "USA", "USD", "EUR", "GBP", "JPY", "CNY", "CAD", "AUD", "US", "UK", "EU", "UN", "AI", "ML", "API", "IOT", "AR", "VR", "AM", "PM",
]
_QUARTER_WORDS = {"first": "Q1", "second": "Q2", "third": "Q3", "fourth": "Q4"}
_MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
#: Forms of dates, tried in this order, with their formats.
DATES = [
    (rf"\b((?:{_MONTHS}) [0-9]{{1,2}}, [0-9]{{4}})\b", "MMMM d, yyyy"), (rf"\b([0-9]{{1,2}} (?:{_MONTHS}) [0-9]{{4}})\b", "d MMMM yyyy"),
    (r"\b([0-9]{4}-[0-9]{2}-[0-9]{2})\b", "yyyy-MM-dd"), (r"\b([0-9]{1,2}/[0-9]{1,2}/[0-9]{4})\b", "M/d/yyyy"), (r"\b((?:Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\.? [0-9]{1,2}, [0-9]{4})\b", "MMM d, yyyy"),
]


def clean_company(c: Column) -> Column:
    """Without marks at its ends and words like Inc and Call at its end."""
    out = F.btrim(F.btrim(c), F.lit(",-."))
    for suffix in ("Inc", "Corp", "Ltd", "LLC", "PLC", "Earnings", "Results", "Conference", "Call"):
        out = F.btrim(F.regexp_replace(out, rf"(?i)\s+{suffix}\s*$", ""))
    return F.coalesce(F.nullif(out, F.lit("")), F.btrim(c))


def extract_metadata(df: DataFrame, text: str, filename: str | None = None, head_lines: int = 35) -> DataFrame:
    """Adds ``ticker``, ``company``, ``quarter``, ``year``, ``call_date``, ``transcript_key`` and ``is_complete``.

    The first lines are searched before the whole text.  Ticker: in brackets,
    after an exchange, in the file's name, with a share class, or a word of
    capitals in the first three lines.  A quarter's form may give the year, too.
    Years are between 2000 and 2040.  The key is null if ticker, quarter or year is.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.split(t, "\n")
    top = lambda n: F.array_join(F.slice(lines, 1, n), "\n")
    out = df.withColumns({"__t": t, "__h": top(head_lines), "__first": top(10), "__three": top(3)})
    found = lambda c, p, g=1: F.nullif(F.regexp_extract(c, p, g), F.lit(""))
    both = lambda f: F.coalesce(f("__h"), f("__t"))
    blocked = F.array(*map(F.lit, NO_TICKERS))
    free = lambda words: F.get(F.filter(words, lambda w: ~F.array_contains(blocked, w)), F.lit(0))
    every = lambda c, p: F.regexp_extract_all(c, F.lit(p), F.lit(1))
    share = found("__h", r"\b([A-Z]{1,4}\.[A-Z])\b")
    tiers = [
        free(every("__h", r"\(([A-Z]{1,5}(?:\.[A-Z]{1,2})?)\)")), F.upper(found("__h", r"(?i)\b(?:NYSE|NASDAQ|AMEX|OTC)[ ]?:[ ]?([A-Z]{1,5})\b")),
        free(F.regexp_extract_all(F.upper(F.col(filename)), F.lit(r"(?:^|[^A-Z])([A-Z]{1,5})(?=[^A-Z]|$)"), F.lit(1))) if filename else F.lit(None).cast("string"),
        F.when(~F.array_contains(blocked, F.substring_index(share, ".", 1)), share), free(every("__three", r"\b([A-Z]{2,5})\b")),
    ]
    wide = lambda y: F.when(F.length(y) == 4, y.try_cast("int")).when(y.try_cast("int") < 50, 2000 + y.try_cast("int")).otherwise(1900 + y.try_cast("int"))
    sane = lambda y: F.when(y.between(2000, 2040), y)
    words = F.create_map(*[F.lit(x) for kv in _QUARTER_WORDS.items() for x in kv])
    with_year = [r"(?i)\bQ([1-4])[ ]?FY[ ']?([0-9]{4}|[0-9]{2})\b", r"(?i)\b([1-4])Q[ ]?'?([0-9]{4}|[0-9]{2})\b"]
    quarter = lambda c: F.coalesce(*[F.concat(F.lit("Q"), found(c, p)) for p in [*with_year, r"(?i)\bQ([1-4])\b"]], F.try_element_at(words, F.lower(found(c, r"(?i)\b(first|second|third|fourth)[ -]quarter\b"))))
    named = lambda c: F.when(found(c, with_year[0]).isNotNull(), sane(wide(found(c, with_year[0], 2)))).when(found(c, with_year[1]).isNotNull(), sane(wide(found(c, with_year[1], 2))))
    of_quarter = F.when(quarter("__h").isNotNull(), named("__h")).otherwise(named("__t"))
    four = lambda c: F.get(F.filter(F.transform(every(c, r"\b((?:19|20)[0-9]{2})\b"), lambda y: y.cast("int")), lambda y: y.between(2000, 2040)), F.lit(0))
    year = lambda c: F.coalesce(sane(found(c, r"(?i)\bfiscal (?:year )?([0-9]{4})\b").try_cast("int")), sane(wide(found(c, r"(?i)\bFY[ ']?([0-9]{4}|[0-9]{2})\b"))), four(c))
    date = lambda c: F.coalesce(*[F.when(F.year(d).between(2000, 2040), d) for d in (F.try_to_date(F.replace(found(c, p), F.lit("."), F.lit("")) if "MMM d" in f and "MMMM" not in f else found(c, p), f) for p, f in DATES)])
    call = r"(?:Q[1-4]|first|second|third|fourth)"
    names = [
        found("__first", rf"(?i)welcome\s+to\s+(?:the\s+)?(.+?)(?:'s\s+)?(?:Q[1-4]|first|second|third|fourth|[0-9]{{4}}|earnings|results|fiscal)"),
        found("__first", rf"(?im)^[ \t]*(.+?)\s*(?:\([A-Z]{{1,5}}\))?\s*{call}.*?(?:earnings|results|conference|call)"),
        found("__first", r"(?i)this\s+is\s+(?:the\s+)?(.+?)\s*(?:earnings|results|conference|quarterly)\s+(?:call|results)"),
    ]
    long_ = lambda c: F.when(F.length(c) >= 3, c)
    out = out.withColumns({"ticker": F.coalesce(*tiers), "company": F.coalesce(*[long_(clean_company(n)) for n in names]), "quarter": both(quarter), "year": F.coalesce(of_quarter, both(year)), "call_date": both(date)})
    known = F.col("ticker").isNotNull() & F.col("quarter").isNotNull() & F.col("year").isNotNull()
    return out.withColumns({"transcript_key": F.when(known, F.concat_ws("_", "ticker", "quarter", F.col("year").cast("string"))), "is_complete": known & F.col("call_date").isNotNull()}).drop("__t", "__h", "__first", "__three")

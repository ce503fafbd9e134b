"""Roles of speakers from their titles: whole titles, then words within them, then names of analysts' firms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.scalar import Name, col

#: Role of a whole title, lower case and without . , and ;
EXACT = {
    "chief executive officer": "CEO", "ceo": "CEO", "president and ceo": "CEO", "president & ceo": "CEO", "president/ceo": "CEO", "co-chief executive officer": "Co-CEO", "co-ceo": "Co-CEO",
    "chief financial officer": "CFO", "cfo": "CFO", "chief finance officer": "CFO", "evp and cfo": "CFO", "evp & cfo": "CFO", "svp and cfo": "CFO", "svp & cfo": "CFO",
    "chief operating officer": "COO", "coo": "COO", "president and coo": "COO", "president & coo": "COO",
    "chief technology officer": "CTO", "cto": "CTO", "chief information officer": "CIO", "cio": "CIO", "chief digital officer": "CDO",
    "chief marketing officer": "CMO", "cmo": "CMO", "chief strategy officer": "CSO", "chief commercial officer": "CCO", "chief revenue officer": "CRO", "chief accounting officer": "CAO", "chief legal officer": "CLO", "general counsel": "General Counsel",
    "president": "President", "executive chairman": "Executive Chairman", "chairman": "Chairman", "chairman and ceo": "CEO", "chairman & ceo": "CEO",
    "executive vice president": "EVP", "evp": "EVP", "senior vice president": "SVP", "svp": "SVP", "vice president": "VP", "vp": "VP", "vp finance": "VP Finance", "vp investor relations": "VP IR", "vp of investor relations": "VP IR", "vice president of finance": "VP Finance", "vice president of investor relations": "VP IR",
    "head of investor relations": "Head of IR", "director of investor relations": "Director of IR", "investor relations": "IR", "ir": "IR",
    "analyst": "Analyst", "research analyst": "Analyst", "equity research analyst": "Analyst", "senior analyst": "Analyst", "managing director": "Managing Director", "md": "Managing Director",
    "operator": "Operator", "conference operator": "Operator", "conference call operator": "Operator", "moderator": "Operator",
}
#: Role of a title that holds these words, tried in this order.
KEYWORDS = [
    ("chief executive", "CEO"), ("chief financial", "CFO"), ("chief operating", "COO"), ("chief technology", "CTO"), ("chief information", "CIO"), ("chief marketing", "CMO"), ("chief strategy", "CSO"), ("chief revenue", "CRO"), ("chief accounting", "CAO"), ("chief legal", "CLO"), ("chief", "C-Suite"),
    ("executive vice president", "EVP"), ("senior vice president", "SVP"), ("vice president", "VP"), ("president", "President"), ("chairman", "Chairman"), ("general counsel", "General Counsel"),
    ("investor relations", "IR"), ("head of ir", "Head of IR"), ("director", "Director"), ("treasurer", "Treasurer"), ("controller", "Controller"), ("analyst", "Analyst"), ("operator", "Operator"), ("moderator", "Operator"),
]
#: Names that make a title an analyst's.
FIRMS = [
    "goldman sachs", "goldman", "jpmorgan", "jp morgan", "morgan stanley", "bank of america", "bofa", "merrill lynch", "citigroup", "citi", "wells fargo", "barclays", "ubs", "deutsche bank", "credit suisse", "hsbc", "jefferies", "piper sandler", "raymond james", "stifel",
    "baird", "cowen", "td cowen", "needham", "oppenheimer", "truist", "bmo", "rbc", "susquehanna", "bernstein", "wolfe research", "evercore", "mizuho", "keybanc", "wedbush", "canaccord", "rosenblatt", "new street", "atlantic equities", "redburn", "exane",
]
#: Confidence of each step.
BY_TITLE, BY_WORDS, BY_FIRM = 1.0, 0.8, 0.5
_UNKNOWN = "Unknown"


def clean_title(raw: Name) -> Column:
    """One blank between words, lower case, without . , and ;"""
    t = F.btrim(F.regexp_replace(F.coalesce(col(raw), F.lit("")), r"[ \t\n\x0B\f\r]+", " "), F.lit(" "))
    return F.regexp_replace(F.lower(t), "[.,;]", "")


def names_firm(title: Name, firms: list[str] = FIRMS) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(col(title), F.lit(f)) for f in firms])


def role_of(raw: Name, extra: dict[str, str] | None = None, firms: list[str] = FIRMS) -> Column:
    """struct(role, speaker_type, confidence) of a title; "Unknown" with 0 where nothing fits.  ``extra`` adds whole titles."""
    t = clean_title(raw)
    table = EXACT | (extra or {})
    exact = F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), t)
    words = F.coalesce(*[F.when(F.contains(t, F.lit(w)), F.lit(r)) for w, r in KEYWORDS])
    firm = F.when(names_firm(t, firms), F.lit("Analyst"))
    role = F.when(t != "", F.coalesce(exact, words, firm))
    sure = F.when(role.isNull(), 0.0).when(exact.isNotNull(), BY_TITLE).when(words.isNotNull(), BY_WORDS).otherwise(BY_FIRM)
    kind = F.when(role.isNull(), "unknown").when(role == "Analyst", "analyst").when(role == "Operator", "operator").otherwise("management")
    return F.struct(F.coalesce(role, F.lit(_UNKNOWN)).alias("role"), kind.alias("speaker_type"), sure.alias("confidence"))

"""Text cleaning, tokens, sentences and tests on text, as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .scalar import Name, col

#: Frequent wrong decodings and typographic characters, replaced in this order.
ENCODING_FIXES = [("â€™", "'"), ("â€œ", '"'), ("â€\x9d", '"'), ("â€”", "-"), ("â€“", "-"), ("Â", ""), ("’", "'"), ("‘", "'"), ("“", '"'), ("”", '"'), ("–", "-"), ("—", "-"), ("…", "..."), (" ", " ")]
#: Abbreviations whose dot ends no sentence.
ABBREVIATIONS = ["Mr", "Ms", "Mrs", "Dr", "Prof", "Sr", "Jr", "vs", "etc", "Corp", "Inc", "Ltd", "Co", "LLC", "LP", "LLP", "No", "Vol", "pp", "ed", "rev", "approx", "est", "avg", "max", "min", "FY", "YoY", "QoQ", "U.S", "U.K", "E.U", "Q1", "Q2", "Q3", "Q4", "H1", "H2"]
#: Stands for a protected dot.
GUARD = "⁠"


def nfkd(c: Name) -> Column:
    return _normal("NFKD")(col(c))


def nfc(c: Name) -> Column:
    return _normal("NFC")(col(c))


def _normal(form: str):
    @F.pandas_udf(StringType())
    def normal(t: pd.Series) -> pd.Series:
        return t.map(lambda x: None if x is None else unicodedata.normalize(form, x))

    return normal


def fix_encoding(c: Name) -> Column:
    out = col(c)
    for wrong, right in ENCODING_FIXES:
        out = F.replace(out, F.lit(wrong), F.lit(right))
    return out


def strip_html(c: Name) -> Column:
    """Scripts, styles, comments and tags go; the five named entities are decoded."""
    out = F.regexp_replace(col(c), r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"(?is)</?ix:[^>]+>", " "), r"(?s)<[^>]+>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def normalise_space(c: Name) -> Column:
    """CRLF becomes LF, runs of blanks one space, three or more line ends two; trimmed."""
    out = F.regexp_replace(col(c), r"\r\n?", "\n")
    out = F.regexp_replace(out, r"[ \t\x0B\f]+", " ")
    out = F.regexp_replace(F.regexp_replace(out, r" ?\n ?", "\n"), r"\n{3,}", "\n\n")
    return F.btrim(out, F.lit(" \n"))


def collapse_space(c: Name) -> Column:
    return F.btrim(F.regexp_replace(col(c), r"[ \t\n\x0B\f\r]+", " "), F.lit(" "))


def strip_controls(c: Name) -> Column:
    """Control characters but tab and line ends."""
    return F.regexp_replace(col(c), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]", "")


def strip_contacts(c: Name) -> Column:
    """URLs, mail addresses and phone numbers become a space."""
    out = F.regexp_replace(col(c), r"(?i)https?://[^ \t\n\r]+|www\.[^ \t\n\r]+", " ")
    out = F.regexp_replace(out, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", " ")
    return F.regexp_replace(out, r"(\+?[0-9]{1,2}[ .-])?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}", " ")


def drop_patterns(c: Name, patterns: list[str]) -> Column:
    out = col(c)
    for p in patterns:
        out = F.regexp_replace(out, p, " ")
    return out


def strip_speaker_labels(c: Name) -> Column:
    """``Name Surname:`` at the start of a line."""
    return F.regexp_replace(col(c), r"(?m)^[A-Z][A-Za-z.'-]+( [A-Z][A-Za-z.'-]+){0,3} ?:[ \t]*", "")


def words(c: Name) -> Column:
    """What white space parts; none in null or blank text."""
    return F.filter(F.split(F.coalesce(col(c), F.lit("")), r"[ \t\n\x0B\f\r]+"), lambda w: w != "")


def word_count(c: Name) -> Column:
    return F.size(words(c))


def alpha_tokens(c: Name, least: int = 2) -> Column:
    """Whole words of ``least`` and more letters a-z in the lower-cased text."""
    runs = F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.filter(runs, lambda t: t.rlike(f"^[a-z]{{{least},}}$"))


def lm_tokens(c: Name) -> Column:
    """Lower-cased words without punctuation at their ends."""
    return F.filter(F.transform(words(F.lower(col(c))), lambda w: F.regexp_replace(w, r"^[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]+|[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]+$", "")), lambda w: w != "")


def without(tokens: Name, stop: list[str], keep: tuple[str, ...] = ()) -> Column:
    """Tokens that aren't stop words; repeats stay."""
    drop = F.array(*[F.lit(w) for w in stop if w not in keep]) if stop else F.array().cast("array<string>")
    return F.filter(col(tokens), lambda t: ~F.array_contains(drop, t))


def valid_tokens(tokens: Name, least: int = 2, most: int = 60, digits: int = 10) -> Column:
    """Of a length in bounds and without over ``digits`` digits."""
    return F.filter(col(tokens), lambda t: F.length(t).between(least, most) & (F.length(F.regexp_replace(t, "[^0-9]", "")) <= digits))


def bigrams(tokens: Name) -> Column:
    t = col(tokens)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(t) - 1, F.lit(1))), lambda i: F.concat_ws(" ", F.try_element_at(t, i), F.try_element_at(t, i + 1)))
    return F.when(F.size(t) >= 2, pairs).otherwise(F.array().cast("array<string>"))


def type_token_ratio(tokens: Name) -> Column:
    t = col(tokens)
    return F.coalesce(F.try_divide(F.size(F.array_distinct(t)).cast("double"), F.size(t)), F.lit(0.0))


def sentences(c: Name, least_chars: int = 1) -> Column:
    """Parted after . ! or ? where white space and a capital, a quote or a digit follow; abbreviations and initials don't part."""
    t = F.coalesce(col(c), F.lit(""))
    t = F.regexp_replace(t, r"(^|[^\p{L}\p{N}_])(" + "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS) + r"|[A-Z])\.", "$1$2" + GUARD)
    parts = F.split(t, r"(?<=[.!?])[ \t\n\r]+(?=[A-Z\"'0-9])")
    parts = F.transform(parts, lambda s: F.btrim(F.replace(s, F.lit(GUARD), F.lit(".")), F.lit(" \t\n\r")))
    return F.filter(parts, lambda s: F.length(s) >= least_chars)


def token_estimate(c: Name, chars_per_token: float = 4.0, per_word: float = 1.3) -> Column:
    t = F.coalesce(col(c), F.lit(""))
    return F.greatest(F.ceil(F.length(t) / chars_per_token), F.ceil(word_count(t) * per_word)).cast("int")


def fallback_token_count(c: Name) -> Column:
    """int(words * 1.35) + 2, where no tokenizer is given."""
    return (F.floor(word_count(c) * 1.35) + 2).cast("int")


def letter_share(c: Name) -> Column:
    t = F.coalesce(col(c), F.lit(""))
    return F.coalesce(F.try_divide(F.length(F.regexp_replace(t, r"[^\p{L}]", "")).cast("double"), F.length(t)), F.lit(0.0))


def is_question(c: Name, head: int = 800) -> Column:
    """A question mark, or a question's opening words, in the first characters."""
    t = F.substring(F.coalesce(col(c), F.lit("")), 1, head)
    return t.contains("?") | t.rlike(r"(?i)^[ \t\n]*(what|how|why|when|where|who|which|can|could|would|should|do|does|did|is|are|will)\b")


def is_allcaps(line: Name) -> Column:
    """At least four letters, of which four fifths are upper case."""
    letters = F.length(F.regexp_replace(col(line), r"[^\p{L}]", ""))
    upper = F.length(F.regexp_replace(col(line), r"[^\p{Lu}]", ""))
    return (letters >= 4) & (upper >= 0.8 * letters)


def percentages(c: Name) -> Column:
    return F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(r"[0-9]+(?:\.[0-9]+)?[ ]?%"), F.lit(0))


def dollars(c: Name) -> Column:
    return F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(r"\$[0-9][0-9,]*(?:\.[0-9]+)?"), F.lit(0))


def tickers(c: Name) -> Column:
    """Symbols in parentheses, with or without an exchange."""
    return F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(r"\((?:NYSE|NASDAQ|AMEX)?:? ?([A-Z]{1,5})\)"), F.lit(1))


def stable_id(*parts: Name, length: int = 8) -> Column:
    """The first characters of the SHA-256 of the parts joined by ``|``."""
    return F.substring(F.sha2(F.concat_ws("|", *[col(p).cast("string") for p in parts]), 256), 1, length)

"""URL filter: pattern rules indexed by their rarest literal token.

A URL is cut into tokens; the tokens fetch the rules that are indexed by one of
them, and only those rules' regular expressions run.  All of it is DataFrame
functions: up to ``INLINE_RULES`` rules travel inside the plan (no shuffle at
all), longer lists are joined by token over the distinct URLs.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, small_table

#: Rules up to this number are literals of the plan; more are joined.
INLINE_RULES = 256
#: Keys over which rules that always run are spread where rules are joined.
SPREAD = 64
_TOKEN = r"[A-Za-z0-9\x{80}-\x{10FFFF}]+"
_TOKEN_PY = re.compile(r"[A-Za-z0-9\x80-\U0010FFFF]+")


@dataclass(frozen=True)
class Rule:
    """``pattern`` is searched in host + path.  ``rank``: of the rules that match, the highest wins."""

    text: str
    pattern: str
    action: str
    rank: int
    tokens: tuple[str, ...] = field(default=())


def _quote(s: str) -> str:
    return re.sub(r"([^A-Za-z0-9/_\x80-\U0010FFFF])", r"\\\1", s)


def prefix_rule(host: str, path: str, action: str) -> Rule:
    """Fits ``host`` and its subdomains where the URL's path starts with ``path``; longer ones outrank shorter."""
    tokens = _TOKEN_PY.findall(host) + _TOKEN_PY.findall(path)
    if path and _TOKEN_PY.match(path[-1]):
        tokens = tokens[:-1]  # the last may be the start of a longer token
    return Rule(host + path, rf"^(?:[^/]*\.)?{_quote(host)}" + (_quote(path) if path else "(?:/|$)"), action, 1000 + len(host + path), tuple(tokens))


def wildcard_rule(text: str, action: str) -> Rule:
    """``*`` stands for any run, ``^`` for a separator or an end; the rest is literal.  Prefix rules outrank these."""
    pattern = "".join({"*": ".*", "^": "(?:[^A-Za-z0-9]|^|$)"}.get(c, _quote(c)) for c in text)
    sure = [m[0] for m in _TOKEN_PY.finditer(text) if 0 < m.start() and m.end() < len(text) and text[m.start() - 1] != "*" and text[m.end()] != "*"]
    return Rule(text, pattern, action, len(text), tuple(sure))


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or where there is no ``://``."""
    found = F.coalesce(url, F.lit(""))
    return lower_ascii(F.regexp_extract(found, r"(?s)^.*?://([^/?#]*)([^?#]*)", 1)), F.regexp_extract(found, r"(?s)^.*?://([^/?#]*)([^?#]*)", 2)


def _tokens(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(_TOKEN), 0))


def index_rules(urls: DataFrame, rules: list[Rule]) -> dict[str, list[int]]:
    """Token -> rules.  Each rule stands under the one of its sure tokens that the fewest URLs have.

    The counts cover all rows; what reaches the driver is a row for each token of
    a rule at most.  Rules without a sure token stand under "" and always run.
    """
    wanted = sorted({t for r in rules for t in r.tokens})
    counts: dict[str, int] = {}
    if wanted:
        hit = urls.select(F.explode(F.array_intersect(_tokens(F.col("__target")), F.array(*map(F.lit, wanted)))).alias("t"))
        counts = {r["t"]: r["n"] for r in hit.groupBy("t").agg(F.count("*").alias("n")).collect()}
    out: dict[str, list[int]] = defaultdict(list)
    for i, r in enumerate(rules):
        out[min(r.tokens, key=lambda t: (counts.get(t, 0), t)) if r.tokens else ""].append(i)
    return dict(out)


def judge(df: DataFrame, rules: list[Rule], url: str = "url", default: str = "allow", inline: int = INLINE_RULES) -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` (its text, null if none fits) and ``verdict`` to every row.

    Columns of these names in ``df`` are replaced.  A null URL, and one without
    ``://``, has an empty host and path and gets ``default`` unless a wildcard
    rule fits the empty string.  Equal URLs have equal verdicts; an empty table
    stays empty.  Ties of rank go to "block", then to the smaller text.
    """
    taken = {c: f"{c}_{i}" for i, c in enumerate(df.columns) if c.lower() in ("__host", "__path", "__target", "__fit", "__best", "t")}
    if taken:  # columns of these names step aside
        back = judge(df.withColumnsRenamed(taken), rules, taken.get(url, url), default, inline)
        return back.withColumnsRenamed({v: k for k, v in taken.items()})
    host, path = split_url(F.col(url))
    base = df.withColumns({"__host": host, "__path": path})
    base = base.withColumn("__target", F.concat("__host", "__path"))
    index = index_rules(base.select("__target"), rules)
    as_struct = lambda i: F.struct(F.lit(rules[i].rank).alias("rank"), F.lit(int(rules[i].action == "block")).alias("stop"), F.lit(rules[i].text).alias("text"), F.lit(rules[i].pattern).alias("pattern"))
    best = "aggregate(__fit, cast(null as struct<rank:int,stop:int,text:string,pattern:string>), (a, r) -> if(a is null or r.rank > a.rank or (r.rank = a.rank and (r.stop > a.stop or (r.stop = a.stop and r.text < a.text))), r, a))"
    if not rules:
        judged = base.withColumn("__best", F.expr("cast(null as struct<rank:int,stop:int,text:string,pattern:string>)"))
    elif len(rules) <= inline:
        keys = [t for t in index if t]
        always = F.array(*map(as_struct, index.get("", []))) if index.get("") else F.expr("cast(array() as array<struct<rank:int,stop:int,text:string,pattern:string>>)")
        fetched = always
        if keys:
            by_token = F.map_from_arrays(F.array(*map(F.lit, keys)), F.array(*[F.array(*map(as_struct, index[t])) for t in keys]))
            fetched = F.concat(always, F.flatten(F.transform(F.array_intersect(_tokens(F.col("__target")), F.array(*map(F.lit, keys))), lambda t: F.element_at(by_token, t))))
        judged = base.withColumn("__fit", F.filter(fetched, lambda r: F.call_function("rlike", F.col("__target"), r["pattern"]))).withColumn("__best", F.expr(best))
    else:
        # each URL asks for the rules without a sure token, too: under one of SPREAD keys, so that no key is all URLs'
        own = [(t, rules[i]) for t, at in index.items() if t for i in at] + [(f" {k}", rules[i]) for k in range(SPREAD) for i in index.get("", [])]
        listed = small_table(df.sparkSession, {
            "t": ([t for t, _ in own], pa.string()), "rank": ([r.rank for _, r in own], pa.int32()), "stop": ([int(r.action == "block") for _, r in own], pa.int32()),
            "text": ([r.text for _, r in own], pa.string()), "pattern": ([r.pattern for _, r in own], pa.string()),
        })
        spread = F.concat(F.lit(" "), F.pmod(F.xxhash64("__target"), F.lit(SPREAD)).cast("string"))
        tokens = base.select("__target").distinct().withColumn("t", F.explode(F.concat(F.array(spread), _tokens(F.col("__target")))))
        fit = tokens.join(listed, "t").filter("rlike(__target, pattern)")
        # the smaller text wins a tie: negated code points and a last 1 make it the larger value, and a text larger than what it begins
        won = fit.groupBy("__target").agg(F.expr("max_by(struct(rank, stop, text, pattern), struct(rank, stop, concat(transform(split(text, ''), c -> -ascii(c)), array(1))))").alias("__best"))
        judged = base.join(won, "__target", "left")
    out = {"host": F.col("__host"), "path": F.col("__path"), "rule": F.col("__best.text"), "verdict": F.when(F.col("__best.stop") == 1, "block").when(F.col("__best.stop") == 0, "allow").otherwise(default)}
    return judged.withColumns(out).drop("__host", "__path", "__target", "__fit", "__best")


#: The contract's rules.
PREFIX_RULES = [
    prefix_rule("org", "/", "allow"),
    prefix_rule("example.org", "/es/", "block"),
    prefix_rule("example.org", "/en/1", "block"),
    prefix_rule("com", "/fr/", "allow"),
    prefix_rule("com", "/de/", "block"),
]
#: What the filter blocks of its own where no rule of a list fits.
OWN_RULES = [wildcard_rule(f"^{w}^", "block") for w in ("spam-farm", "casino", "porn", "xxx", "viagra")]

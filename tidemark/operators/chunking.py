"""Chunkers of whole tables and of speakers' turns.

A document's sentences stay one array, so that nothing is shuffled for the fold;
it runs over Arrow batches of documents, in time linear in their sentences.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.scalar import Name, col
from .segments import merge_adjacent


def simple_sentences(text: Name, longer_than: int = 10) -> Column:
    """Parted after . ! or ? where white space and a capital or a quote follow; short ones are dropped."""
    parts = F.split(F.coalesce(col(text), F.lit("")), r"(?<=[.!?])[ \t\n\x0B\f\r]+(?=[A-Z\"'])")
    return F.filter(F.transform(parts, lambda s: F.btrim(s, F.lit(" \t\n\x0b\x0c\r"))), lambda s: F.length(s) > longer_than)


def overlap_tail(sizes: list[int], most: int) -> int:
    """How many of the last sentences fit in ``most`` tokens together."""
    used = n = 0
    for size in reversed(sizes):
        if used + size > most:
            break
        used, n = used + size, n + 1
    return n


def fold_table(sentences: list[str], size: int, overlap: int, least: int) -> Iterator[tuple[list[str], int]]:
    """(sentences, tokens) of chunks of up to ``size`` words; each begins with the tail of the one before."""
    held: list[str] = []
    counts: list[int] = []
    total = 0
    for s in sentences:
        n = len(s.split())
        if held and total + n > size:
            yield held, total
            k = overlap_tail(counts, overlap)
            held, counts = held[len(held) - k :], counts[len(counts) - k :]
            total = sum(counts)
        held, counts, total = [*held, s], [*counts, n], total + n
    if held and total >= least:
        yield held, total


def table_chunks(df: DataFrame, key: str, text: str, size: int = 400, overlap: int = 50, least_tokens: int = 20, least_chars: int = 50) -> DataFrame:
    """(key, chunk_order, chunk_id, chunk_text, token_count, sentence_count) of every text of ``least_chars``; a short last chunk is dropped."""
    kind = df.schema[key].dataType.simpleString()
    t = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    rows = df.select(key, t.alias("t")).filter(F.length("t") >= least_chars).select(key, simple_sentences("t").alias("s"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(k, i, " ".join(held), n, len(held)) for k, s in zip(pdf[key].tolist(), pdf["s"].tolist(), strict=True) for i, (held, n) in enumerate(fold_table(list(s), size, overlap, least_tokens))]
            yield pd.DataFrame(out, columns=[key, "chunk_order", "chunk_text", "token_count", "sentence_count"])

    out = rows.mapInPandas(run, f"{key} {kind}, chunk_order int, chunk_text string, token_count long, sentence_count int")
    return out.withColumn("chunk_id", F.concat(F.col(key).cast("string"), F.lit("_chunk_"), F.lpad(F.col("chunk_order").cast("string"), 4, "0")))


def fold_turns(turns: list[tuple[int, str, str, list[str]]], least: int, target: int, most: int, overlap: int, count) -> Iterator[tuple[int, str, str, list[str], list[str]]]:
    """(turn, section, speaker, overlap, sentences) of each chunk.

    Overlap never crosses a change of speaker or section.  What is left of a turn
    under ``least`` tokens becomes overlap of the same speaker's next turn; a
    sentence over ``most`` is a chunk of its own.
    """
    tail: list[str] = []
    before: tuple[str, str] | None = None

    def next_tail(sents: list[str]) -> list[str]:
        k = overlap_tail([count(s) for s in sents], overlap)
        return sents[len(sents) - k :]

    for order, section, speaker, sentences in turns:
        if before != (section, speaker):
            tail, before = [], (section, speaker)
        held: list[str] = []
        size = sum(map(count, tail))
        for s in sentences:
            n = count(s)
            enough = bool(held) and sum(map(count, [*tail, *held])) >= least
            if enough and (n > most or size + n > target):
                yield order, section, speaker, tail, held
                tail, held = next_tail(held), []
                size = sum(map(count, tail))
            if n > most:
                yield order, section, speaker, tail, [s]
                tail, held = next_tail([s]), []
                size = sum(map(count, tail))
                continue
            held.append(s)
            size += n
        if held and sum(map(count, [*tail, *held])) >= least:
            yield order, section, speaker, tail, held
            tail = next_tail(held)
        else:
            tail = [*tail, *held]


def speaker_chunks(turns: DataFrame, key: str, order: str = "order_index", text: str = "text", section: str = "section_type", speaker: str = "speaker", kind: str = "speaker_type", least: int = 40, target: int = 380, most: int = 512, overlap: int = 40, with_operator: bool = False, tiny: int | None = None) -> DataFrame:
    """(key, chunk_index, turn, section_type, dominant_speaker, chunk_text, token_count, word_count, sentence_count, overlap_sentences).

    Tokens are estimated from words.  One transcript's turns are gathered in one
    row.  ``tiny`` first joins neighbouring turns of one speaker with fewer words.
    """
    rows = turns if with_operator else turns.filter(~F.coalesce(F.col(kind) == "operator", F.lit(False)))
    if tiny:
        small = F.when(tx.word_count(text) < tiny, F.lit(-1).cast("long")).otherwise(F.col(order).cast("long"))
        rows = merge_adjacent(rows.select(key, order, section, speaker, text, small.alias("__own")), key, order, [section, speaker, "__own"], text)
    sents = F.filter(tx.sentences(text), lambda s: s != "")
    whole = rows.select(key, F.struct(F.col(order).cast("int").alias("o"), F.coalesce(section, F.lit("unknown")).alias("s"), F.coalesce(speaker, F.lit("")).alias("w"), sents.alias("t")).alias("x")).groupBy(key).agg(F.array_sort(F.collect_list("x")).alias("turns"))
    type_ = turns.schema[key].dataType.simpleString()

    def count(s: str) -> int:
        return int(len(s.split()) * 1.35) + 2

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, given in zip(pdf[key].tolist(), pdf["turns"].tolist(), strict=True):
                listed = [(x["o"], x["s"], x["w"], list(x["t"])) for x in given]
                for i, (turn, sec, who, old, new) in enumerate(fold_turns(listed, least, target, most, overlap, count)):
                    joined = " ".join([*old, *new])
                    out.append((k, i, turn, sec, who, joined, count(joined), len(joined.split()), len(old) + len(new), len(old)))
            yield pd.DataFrame(out, columns=[key, "chunk_index", "turn", "section_type", "dominant_speaker", "chunk_text", "token_count", "word_count", "sentence_count", "overlap_sentences"])

    return whole.mapInPandas(run, f"{key} {type_}, chunk_index int, turn int, section_type string, dominant_speaker string, chunk_text string, token_count int, word_count int, sentence_count int, overlap_sentences int")


def truncate_words(text: Name, most_tokens: int, step: int = 5, per_word: float = 1.35) -> Column:
    """Without its last words, ``step`` at a time, until int(words * ``per_word``) + 2 is ``most_tokens`` at most."""
    w = tx.words(text)
    fits = ceil((most_tokens - 1) / per_word) - 1
    keep = F.greatest(F.lit(0), F.size(w) - step * F.ceil((F.size(w) - fits) / step).cast("int"))
    return F.when(F.size(w) <= fits, col(text)).otherwise(F.array_join(F.slice(w, F.lit(1), keep), " "))


def dominant_value(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per key the most frequent value, the largest of those that tie; "unknown" where all are null."""
    n = df.groupBy(*keys, value).agg(F.count(value).alias("__n"))
    return n.groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col(value).isNotNull(), F.struct("__n", F.col(value).alias("v"))))["v"], F.lit("unknown")).alias(f"dominant_{value}"))

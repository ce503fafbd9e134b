"""Whole cleaning chains over a table's text column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

#: Recurring passages of call transcripts.
BOILERPLATE = [
    r"(?i)this (?:conference call )?transcript is produced by.*?\.", r"(?i)this call (?:is being )?recorded.*?\.", r"(?i)safe.harbor statement.*?(?:forward.looking statements?).*?\.", r"(?i)forward.looking statements? (?:involve|are subject to).*?\.",
    r"(?i)\[operator instructions?\]", r"(?i)\[technical difficulty\]", r"(?i)operator[:\s]+(?:good (?:morning|afternoon|evening)[^.]*\.)", r"(?i)thank you for standing by[^.]*\.", r"(?i)ladies and gentlemen[^.]*(?:thank you|welcome)[^.]*\.",
    r"(?i)this concludes today's (?:conference )?call[^.]*\.", r"(?i)please go ahead[,.]?", r"(?i)your (?:next|first) question comes from[^.]*\.", r"(?i)we'll now take (?:our )?(?:first|next) question[^.]*\.",
]


def clean(df: DataFrame, text: str, out: str = "text_clean", boilerplate: list[str] = BOILERPLATE, unicode: bool = True) -> DataFrame:
    """Wrong encodings, markup, NFKD, boilerplate, speaker labels and white space, with words and characters counted."""
    t = tx.strip_html(tx.fix_encoding(F.coalesce(F.col(text), F.lit(""))))
    stage = df.withColumn(out, t)
    if unicode:
        stage = stage.withColumn(out, tx.nfkd(out))
    stage = stage.withColumn(out, tx.normalise_space(tx.strip_speaker_labels(tx.drop_patterns(out, boilerplate))))
    return stage.withColumns({"word_count_clean": tx.word_count(out), "char_count_clean": F.length(out)})


def lm_text(c: Column, lowercase: bool = True) -> Column:
    """For lexicon matching: no controls, contacts or marks inside words, one space between words."""
    t = tx.collapse_space(F.regexp_replace(tx.strip_contacts(tx.strip_controls(c)), r"[\x22\x28\x29\x3C\x3E\x5B-\x5D\x7B-\x7D]", " "))
    return F.lower(t) if lowercase else t


def lm_preprocess(df: DataFrame, text: str, stop: list[str] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``tokens`` for the lexicon: cleaned, split, stop words out, lengths in bounds."""
    tokens = tx.lm_tokens(lm_text(F.coalesce(F.col(text), F.lit(""))))
    return df.withColumn("tokens", tx.valid_tokens(tx.without(tokens, stop or [], keep)))


def preprocess_stats(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("rows"), F.count_if(F.size("tokens") == 0).alias("empty"), F.sum(F.size("tokens")).alias("tokens"), F.avg(F.size("tokens").cast("double")).alias("mean_tokens"))


def merge_tiny(segments: DataFrame, key: str, order: str, text: str, least: int = 30) -> DataFrame:
    """Runs of neighbouring segments under ``least`` words are joined to one."""
    from .segments import merge_adjacent

    tiny = segments.withColumn("__tiny", tx.word_count(text) < least)
    marked = tiny.withColumn("__island", F.when(F.col("__tiny"), F.lit(-1).cast("long")).otherwise(F.col(order).cast("long")))
    return merge_adjacent(marked, key, order, ["__island"], text).drop("__island")

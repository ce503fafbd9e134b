"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact token length in each source.  A source's budget
is met by whole passes over it, a part taken in proportion from every length,
and a bounded-knapsack dynamic programme over the remaining counts that closes
the rest.  Which documents of a length are taken is decided by a seeded hash.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: A source's words are taken this many times at most.
MAX_PASSES = 3
#: Documents of one (source, length) that are ranked together.
RANK_ROWS = 2_000


def count_tokens(text: Column) -> Column:
    r"""Number of [^\x20\x09-\x0D]+ (null: 0): blanks become one kind, and each start of a word counts."""
    t = F.concat(F.lit(" "), F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     "))
    return F.regexp_count(t, F.lit(" [^ ]")).cast("long")


def source_targets(totals: DataFrame, weights: tuple[float, ...] = (1, 2, 3), max_passes: int = MAX_PASSES) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources in the order of code points, null last, have the weights in turn and
    share all words; none gets more than ``max_passes`` times its own, and what
    it can't take goes to the others by weight.  That level is found in closed
    form: the sources with the least room for their weight fill up first.
    ``totals`` has a row for each source, so one task orders them.
    """
    # strings are ordered by their UTF-8 bytes, which is the order of code points
    place = Window.orderBy(F.col("source").isNull(), "source")
    n = F.row_number().over(place) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(n, F.lit(len(weights))) + 1).cast("int"))
    room = totals.withColumns({"w": weight, "cap": (F.col("source_size") * max_passes).cast("double")})
    rising = Window.orderBy(F.col("cap") / F.col("w"), "cap", F.col("source").isNull(), "source")
    everything = Window.partitionBy()
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    room = room.withColumns({"full": F.coalesce(F.sum("cap").over(before), F.lit(0.0)), "w_left": F.sum("w").over(rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)), "total": F.sum("source_size").over(everything).cast("double")})
    room = room.withColumn("level", (F.col("total") - F.col("full")) / F.col("w_left"))
    # the first source, in that order, that isn't filled at its level sets it for all
    room = room.withColumn("set", F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct("full", "level"))).over(everything))
    target = F.when(F.col("set").isNull() | (F.col("w") * F.col("set.level") > F.col("cap")), F.col("cap")).otherwise(F.col("w") * F.col("set.level"))
    return room.select("source", "source_size", target.alias("target"))


def fit_budget(lengths: dict[int, int], budget: int) -> dict[int, int]:
    """How many documents of each length to take, at most their count, for a sum as near ``budget`` as can be found.

    Most of the budget is taken in proportion; the last documents' worth is
    solved exactly by a bounded-knapsack programme over bit sets.  The sum is
    ``budget`` itself where the remaining counts can make it.
    """
    lengths = {n: c for n, c in lengths.items() if n > 0 and c > 0}
    total = sum(n * c for n, c in lengths.items())
    if budget <= 0 or not lengths:
        return {}
    if budget >= total:
        return dict(lengths)
    take = {n: c * budget // total for n, c in lengths.items()}
    rest = budget - sum(n * t for n, t in take.items())
    window = 2 * max(lengths)
    for n in sorted(lengths, key=lambda n: (-((lengths[n] * budget) % total), n)):  # largest remainders first
        if rest <= window:
            break
        more = min(lengths[n] - take[n], 1, rest // n)
        take[n] += more
        rest -= n * more
    # reach: bit s is set if a sum s can be made; items are powers of two of a length's count
    reach, full, steps = 1, (1 << (rest + 1)) - 1, []
    for n in sorted(lengths):
        left, k = min(lengths[n] - take[n], rest // n), 1
        while left > 0 and not reach >> rest & 1:
            k_now = min(k, left)
            steps.append((n, k_now, reach))
            reach |= (reach << (n * k_now)) & full
            left -= k_now
            k *= 2
        if reach >> rest & 1:
            break
    at = (reach & full).bit_length() - 1
    for n, k, was in reversed(steps):
        if not was >> at & 1:
            take[n] += k
            at -= n * k
    # the nearest sum may lie above: one more document of the least length that is left
    short = budget - sum(n * t for n, t in take.items())
    spare = [n for n in lengths if take[n] < lengths[n]]
    if short > 0 and spare and abs(min(spare) - short) < short:
        take[min(spare)] += 1
    return {n: t for n, t in take.items() if t}


def _fit_source(pdf: pd.DataFrame) -> pd.DataFrame:
    size, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
    goal = int(round(target))
    passes = min(MAX_PASSES, goal // size) if size else 0
    rest = goal - passes * size if passes < MAX_PASSES else 0
    took = fit_budget(dict(zip(pdf["size"].tolist(), pdf["n"].tolist(), strict=True)), rest)
    return pd.DataFrame({"sid": pdf["sid"], "size": pdf["size"], "n": pdf["n"], "passes": passes, "extra": [took.get(n, 0) for n in pdf["size"].tolist()]}).astype({"passes": "int32", "extra": "int64"})


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), seed: int = 11, doc_id: str = "doc_id", text: str = "text", source: str = "source", rank_rows: int = RANK_ROWS) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for every row of ``docs``.

    ``copies`` is how often the mix takes the document (0 to 3), ``taken`` the
    words of that.  Null text has no words, a null source is a source (the last
    one), null ids are values; a source without words has target 0; an empty
    table gives an empty result.  Of rows that tie in id and length either may be
    chosen, which changes no row of the result.  Reruns agree.
    """
    sized = materialize(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), count_tokens(F.col(text)).alias("size")), "mix-sizes")
    lengths = materialize(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-lengths")
    targets = source_targets(lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights)
    named = materialize(targets.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source"))), "mix-targets")
    known = named.select(F.col("source").alias("s2"), "sid", "source_size", "target")
    # a row for each length of a source; one group is one source's lengths
    counts = lengths.join(known, F.col("source").eqNullSafe(F.col("s2"))).select("sid", "size", "n", "source_size", "target")
    plan = materialize(counts.groupBy("sid").applyInPandas(_fit_source, "sid int, size long, n long, passes int, extra long"), "mix-plan")
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 40))
    with_plan = sized.join(known, F.col("source").eqNullSafe(F.col("s2"))).drop("s2").join(plan, ["sid", "size"]).withColumns({"draw": draw, "bins": F.ceil(F.col("n") / rank_rows)})
    # a length that many documents share is cut into bins by the draw, and only bins are ordered among themselves
    with_plan = with_plan.withColumn("bin", F.floor(F.col("draw") * F.col("bins") / float(1 << 40)))
    filled = with_plan.filter("bins > 1 and extra > 0 and extra < n").groupBy("sid", "size", "bin").agg(F.count("*").alias("c"))
    upto = Window.partitionBy("sid", "size").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    before = filled.select("sid", "size", "bin", F.coalesce(F.sum("c").over(upto), F.lit(0)).alias("before"))
    placed = with_plan.join(before, ["sid", "size", "bin"], "left")
    rank = F.row_number().over(Window.partitionBy("sid", "size", "bin").orderBy("draw", "doc_id")) + F.coalesce("before", F.lit(0))
    extra = (F.when(F.col("extra") == 0, 0).when(F.col("extra") >= F.col("n"), 1).otherwise((rank <= F.col("extra")).cast("int")))
    copies = F.col("passes") + extra
    out = placed.withColumn("copies", copies.cast("int"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def repeat_rows(docs: DataFrame, mixed: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: every row of ``docs`` as often as ``mixed`` (of the same ``docs``) takes it.

    Rows that agree in id, source and length share the most copies that any of
    them has, so that repeated rows in ``docs`` are all repeated alike.
    """
    keyed = docs.withColumn("__n", count_tokens(F.col(text)))
    plan = mixed.groupBy(F.col("doc_id").alias("__id"), F.col("source").alias("__src"), F.col("size").alias("__size")).agg(F.max("copies").alias("__copies"))
    both = keyed.join(plan.filter("__copies > 0"), F.col(doc_id).eqNullSafe(F.col("__id")) & F.col(source).eqNullSafe(F.col("__src")) & (F.col("__n") == F.col("__size")))
    return both.withColumn("__time", F.explode(F.array_repeat(F.lit(0), F.col("__copies")))).select(*docs.columns)

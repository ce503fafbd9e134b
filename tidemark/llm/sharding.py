"""Sharding by sampled splitters: near equal bytes in every shard, equal texts together.

A record's key is its text's hash.  Size-weighted key samples give the splitters
of many small ranges; records are range-partitioned by them, and a range that
turns out overfull is subdivided by samples of its own before anything is sorted.

Groups of equal texts that are a notable part of a shard's quota are placed first,
the largest on the emptiest shard.  All other records flow in the order of keys
over what room the shards have left; a small group goes whole to the shard in
which its middle lies.  Only a group larger than a quota is cut, at the edges of
the shards that it flows over.  Only keys and sizes move; no text does.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import delete, fresh, materialize, small_table

#: Records that one range should hold, and samples drawn for each range.
RANGE_ROWS = 20_000
SAMPLES = 32
MAX_RANGES = 50_000
#: A group of more than this part of a quota is placed by itself; so there are at most PART groups of that kind for each shard.
PART = 64
#: Times that overfull ranges are subdivided at most: records of one key can't be parted.
ROUNDS = 4
_LOW = (1 << 24) - 1


def record_sizes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, text_hash): bytes of the text plus 16; a null text has none."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(t) + 16).cast("long").alias("size"), F.crc32(t).alias("text_crc32"), F.xxhash64(t).alias("text_hash"))


def splitters(sizes: DataFrame, ranges: int, samples: int = SAMPLES, seed: int = 7) -> list[int]:
    """Keys at the quantiles of a sample of about ``ranges * samples`` keys.

    A record's weight is its size and the mean size together, so that neither
    the bytes nor the rows of a range grow far beyond their share.
    """
    got = sizes.agg(F.sum("size").alias("s"), F.count("*").alias("n")).first()
    total, n = got["s"], got["n"]
    if not total or ranges < 2:
        return []
    chance = (F.col("size") + total / n) * (ranges * samples / (2 * total))
    unit = F.pmod(F.xxhash64(F.lit(seed), "key", "doc_id"), F.lit(1 << 40)) / float(1 << 40)
    # a record of many quotas is drawn as many times
    times = F.floor(chance) + (unit < chance - F.floor(chance)).cast("long")
    drawn = sizes.select("key", times.alias("n")).filter("n > 0").toPandas().sort_values("key")
    keys = np.repeat(drawn["key"].to_numpy(np.int64), drawn["n"].to_numpy())
    if not len(keys):
        return []
    return sorted({int(k) for k in keys[(np.arange(1, ranges) * len(keys)) // ranges]})


def _number(edges: list, of: str):
    """A function of a column: how many of the ascending ``edges`` are not above it."""
    cuts = np.array(edges, np.float64 if of == "double" else np.int64)

    @F.pandas_udf("int")
    def place(x: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, x.to_numpy(cuts.dtype), side="right").astype(np.int32))

    return place


def _ranged(rows: DataFrame, ranges: int, range_rows: int, seed: int) -> tuple[DataFrame, pd.DataFrame]:
    """``rows`` with their ``range``, and the exact totals of each: records, and those and the bytes that flow."""
    cuts = splitters(rows, ranges, seed=seed)
    totals = (F.count("*").alias("all"), F.sum("flows").alias("rows"), F.sum(F.col("flows") * F.col("size")).alias("bytes"))
    for round_ in range(ROUNDS + 1):
        out = rows.withColumn("range", _number(cuts, "long")("key"))
        found = out.groupBy("range").agg(*totals).toPandas().sort_values("range")  # a row for each range
        over = found[found["all"] > 2 * range_rows]
        if round_ == ROUNDS or over.empty or len(cuts) >= MAX_RANGES:
            break
        parts = int(np.ceil(over["all"].sum() / range_rows)) * 2
        more = splitters(out.filter(F.col("range").isin([int(r) for r in over["range"]])), parts, seed=seed + 1 + round_)
        if not set(more) - set(cuts):
            break
        cuts = sorted({*cuts, *more})
    return out, found


def place_groups(groups: list[tuple[int, int]], quota: float, shards: int) -> tuple[dict[int, int], list[float]]:
    """Shards of (group, bytes), the largest group first and each on the emptiest shard; and the room left in every shard.

    Rooms are levelled so that they sum to what is not in these groups.
    """
    held, heap, where = [0] * shards, [(0, i) for i in range(shards)], {}
    for g, size in sorted(groups, key=lambda x: (-x[1], x[0])):
        load, i = heapq.heappop(heap)
        where[g] = i
        held[i] = load + size
        heapq.heappush(heap, (held[i], i))
    filled, level = quota * shards - sum(held), 0.0
    ordered = sorted(held)
    for i, load in enumerate(ordered):  # the level to which the emptiest shards are filled
        filled += load
        level = filled / (i + 1)
        if i + 1 == shards or level <= ordered[i + 1]:
            break
    return where, [max(0.0, level - h) for h in held]


def shard_by_bytes(docs: DataFrame, shards: int = 40, doc_id: str = "doc_id", text: str = "text", seed: int = 7, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row.

    ``shard`` is 0..shards-1 and ``slot`` counts from 0 without gaps in each.
    Records of equal texts are in one shard, unless they are larger than a
    shard's quota (all bytes by the number of shards).  Shards differ by a few
    parts in a hundred of a quota; by more only where single groups or records
    are larger than that.  Null ids and texts are values like others; repeated
    rows each get a slot; an empty table gives an empty result.  With fewer
    records than shards some shards stay empty.  Other columns don't matter.
    Reruns agree.
    """
    spark = docs.sparkSession
    sizes = materialize(record_sizes(docs, doc_id, text), "shard-sizes")
    sums = sizes.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    quota = sums["bytes"] / shards
    big = sizes.groupBy("text_hash").agg(F.sum("size").alias("bytes")).filter(F.col("bytes") > quota / PART).collect()  # at most PART for each shard
    cut = {r["text_hash"] for r in big if r["bytes"] > quota}
    where, room = place_groups([(r["text_hash"], r["bytes"]) for r in big if r["text_hash"] not in cut], quota, shards)
    kinds = small_table(spark, {"__g": ([*cut, *where], pa.int64()), "__cut": ([True] * len(cut) + [False] * len(where), pa.bool_()), "__shard": ([None] * len(cut) + list(where.values()), pa.int32())})
    # records of a large group are ordered by their ids' hashes, too, so that splitters can fall between them
    named = sizes.join(F.broadcast(kinds), F.col("text_hash") == F.col("__g"), "left")
    low = F.when(F.col("__g").isNull(), F.lit(0)).otherwise(F.xxhash64("doc_id").bitwiseAND(F.lit(_LOW)))
    key = F.shiftleft(F.shiftright("text_hash", 24), 24).bitwiseOR(low)
    rows = named.select("doc_id", "size", "text_crc32", "text_hash", "__shard", F.coalesce("__cut", F.lit(False)).alias("__cut"), F.col("__shard").isNull().cast("int").alias("flows"), key.alias("key"))

    ranged, totals = _ranged(rows, int(min(MAX_RANGES, max(shards, -(-sums["n"] // range_rows)))), range_rows, seed)
    offsets = small_table(spark, {"range": (totals["range"], pa.int32()), "b0": (totals["bytes"].cumsum() - totals["bytes"], pa.int64()), "r0": (totals["rows"].cumsum() - totals["rows"], pa.int64())})
    order = Window.partitionBy("range").orderBy("key", "text_hash", "doc_id", "size", "text_crc32")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    flow = F.col("flows") * F.col("size")
    group = Window.partitionBy("range", "text_hash")
    placed = ranged.withColumns({"__upto": F.sum(flow).over(upto), "__row": F.sum("flows").over(upto)}).join(F.broadcast(offsets), "range")
    placed = placed.withColumns({"__end": F.max("__upto").over(group), "__own": F.sum("size").over(group), "__nth": F.row_number().over(group.orderBy("key", "doc_id", "size"))})
    # twice the middle, in the order of all bytes that flow, of the record or of its whole group
    middle = F.when(F.col("__cut"), 2 * F.col("__upto") - F.col("size")).otherwise(2 * F.col("__end") - F.col("__own")) + 2 * F.col("b0")
    edges = np.cumsum(room)
    last = max((i for i, x in enumerate(room) if x > 0), default=shards - 1)
    flowing = F.least(F.lit(last), _number([float(2 * e) for e in edges[:-1]], "double")(middle.cast("double")))
    placed = materialize(placed.select("doc_id", "size", "text_crc32", F.coalesce("__shard", flowing).alias("shard"), "flows", "text_hash", "range", "__nth", (F.col("r0") + F.col("__row") - 1).alias("__at")), "shard-placed")

    # slots: first what flows, then group by group; a group may lie in several ranges
    flows = placed.filter("flows = 1").groupBy("shard").agg(F.min("__at").alias("__first"), F.count("*").alias("__flown"))  # a row for each shard
    groups = placed.filter("flows = 0").groupBy("shard", "text_hash", "range").agg(F.count("*").alias("n")).join(F.broadcast(flows), "shard", "left")
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("text_hash", "range").rowsBetween(Window.unboundedPreceding, -1))
    starts = groups.select("shard", "text_hash", "range", (F.coalesce(before, F.lit(0)) + F.coalesce("__flown", F.lit(0))).alias("__start"))
    names = ["doc_id", "size", "text_crc32", "shard"]
    with_flow = placed.filter("flows = 1").join(F.broadcast(flows), "shard").select(*names, (F.col("__at") - F.col("__first")).alias("slot"))
    with_group = placed.filter("flows = 0").join(starts, ["shard", "text_hash", "range"]).select(*names, (F.col("__start") + F.col("__nth") - 1).alias("slot"))
    delete(sizes)
    return with_flow.unionByName(with_group)


def write_shards(docs: DataFrame, assigned: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> None:
    """Writes the rows of ``docs`` under ``path/shard=N`` in the order of their slots.

    ``assigned`` is ``shard_by_bytes`` of the same ``docs``.  Rows that repeat an
    id and a text share the slots of these rows, one each; a column ``shard`` of
    ``docs`` is replaced.  An empty table writes no shard.
    """
    kept = [c for c in docs.columns if c.lower() != "shard"]
    crc, nth, id2, crc2, nth2, slot = fresh(docs.columns, "__crc", "__nth", "__id2", "__crc2", "__nth2", "__slot")
    count = lambda *key: F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(0)))
    keyed = docs.select(*kept, F.crc32(F.coalesce(F.col(text), F.lit(""))).alias(crc)).withColumn(nth, count(doc_id, crc))
    places = assigned.select(F.col("doc_id").alias(id2), F.col("text_crc32").alias(crc2), "shard", F.col("slot").alias(slot))
    places = places.withColumn(nth2, count(id2, crc2))
    both = keyed.join(places, F.col(doc_id).eqNullSafe(F.col(id2)) & (F.col(crc) == F.col(crc2)) & (F.col(nth) == F.col(nth2))).select(*kept, "shard", slot)
    both.repartitionByRange("shard", slot).sortWithinPartitions("shard", slot).drop(slot).write.partitionBy("shard").parquet(path)

"""Approximate nearest neighbours by robust-pruned directed graphs.

Vectors are dealt into shards of bounded size.  In each shard a graph is built:
greedy searches from a fixed start propose neighbours for a batch of vertices,
relaxed distance pruning keeps the diverse ones, and reverse edges are pruned the
same way.  Vectors of one direction are one vertex.  Each shard's index is read
once, and all queries stream past it: a beam search finds vertices, whose vectors
are scored in double precision; what the shards find is merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, materialize, release

#: Vectors of a shard, about; digits in which unit vectors of one direction agree.
SHARD, DIGITS = 8_000, 9
#: Out-degree after pruning and at most, beam while building and searching, slack of pruning.
DEGREE, MOST, BUILD_BEAM, BEAM, ALPHA = 32, 48, 64, 96, 1.2
#: Vertices expanded at once, searches in one array operation.
EXPAND, STEP = 4, 256
#: Shards up to this size are scanned, and so is a shard whose best for a query are as near as this to each other.
SCAN, TIE = 400, 1e-6


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Graph:
    """Over unit vectors (float32); ``links`` has a row for each vector, filled with -1."""

    def __init__(self, unit: np.ndarray, links: np.ndarray | None = None, start: int = 0, seed: int = 5):
        self.unit = np.ascontiguousarray(unit, np.float32)
        self.start = start
        if links is not None:
            self.links = links
            return
        n = len(unit)
        self.links = np.full((n, MOST), -1, np.int32)
        self.start = int(np.argmax(self.unit @ self.unit.mean(axis=0))) if n else 0
        order = np.random.default_rng(seed).permutation(n)
        order = np.concatenate([[self.start], order[order != self.start]]).astype(np.int64) if n else order
        at, step = 1, 1
        while at < n:  # batches grow with the graph
            batch = order[at : at + step]
            self._insert(batch)
            at += len(batch)
            step = min(2 * step, STEP)
        for i in range(0, n, STEP):  # a second look, with the whole graph in place
            self._insert(order[i : i + STEP])

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Per query the ``beam`` nearest that the greedy search met: numbers (-1: none) and similarities, best first."""
        q = len(queries)
        ids = np.full((q, beam), -1, np.int64)
        sim = np.full((q, beam), -np.inf, np.float32)
        done = np.ones((q, beam), bool)
        ids[:, 0], sim[:, 0], done[:, 0] = self.start, queries @ self.unit[self.start], False
        seen = np.zeros((q, len(self.unit)), bool)
        seen[:, self.start] = True
        live = np.arange(q)
        while len(live):
            open_ = ~done[live]
            rank = np.cumsum(open_, axis=1)
            pick = open_ & (rank <= EXPAND)
            some = pick.any(axis=1)
            live, pick = live[some], pick[some]
            if not len(live):
                break
            r, c = np.nonzero(pick)
            near = np.full((len(live), EXPAND, self.links.shape[1]), -1, np.int64)
            near[r, (np.cumsum(pick, axis=1) - 1)[r, c]] = self.links[ids[live[r], c]]
            done[live[r], c] = True
            near = near.reshape(len(live), -1)
            fresh = (near >= 0) & ~seen[live[:, None], np.maximum(near, 0)]
            row, col = np.nonzero(fresh)
            # the same vertex may be proposed by several of those expanded
            _, first = np.unique(row * len(self.unit) + near[row, col], return_index=True)
            row, col = row[first], col[first]
            new = near[row, col]
            seen[live[row], new] = True
            got = np.einsum("ij,ij->i", self.unit[new], queries[live[row]])
            width = np.bincount(row, minlength=len(live))
            place = np.arange(len(row)) - np.repeat(np.cumsum(width) - width, width)
            w = int(width.max()) if len(width) else 0
            more_ids = np.full((len(live), w), -1, np.int64)
            more_sim = np.full((len(live), w), -np.inf, np.float32)
            more_ids[row, place], more_sim[row, place] = new, got
            all_sim = np.concatenate([sim[live], more_sim], axis=1)
            all_ids = np.concatenate([ids[live], more_ids], axis=1)
            all_done = np.concatenate([done[live], more_ids < 0], axis=1)
            best = np.argsort(-all_sim, axis=1, kind="stable")[:, :beam]
            ids[live] = np.take_along_axis(all_ids, best, 1)
            sim[live] = np.take_along_axis(all_sim, best, 1)
            done[live] = np.take_along_axis(all_done, best, 1)
        return ids, sim

    def _prune(self, points: np.ndarray, cand: np.ndarray) -> np.ndarray:
        """The robustly pruned neighbours (DEGREE at most, -1 filled) of each point from its candidates (-1: none)."""
        cand = np.where(cand == points[:, None], -1, cand)
        order = np.argsort(cand, axis=1)
        cand = np.take_along_axis(cand, order, 1)
        cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
        v = self.unit[np.maximum(cand, 0)]
        far = 2 - 2 * np.einsum("pcd,pd->pc", v, self.unit[points])  # squared distances of unit vectors
        far[cand < 0] = np.inf
        order = np.argsort(far, axis=1, kind="stable")
        cand, far = np.take_along_axis(cand, order, 1), np.take_along_axis(far, order, 1)
        v = np.take_along_axis(v, order[:, :, None], 1)
        between = 2 - 2 * np.matmul(v, v.transpose(0, 2, 1))
        alive = cand >= 0
        out = np.full((len(points), MOST), -1, np.int32)
        p = np.arange(len(points))
        for k in range(DEGREE):
            any_ = alive.any(axis=1)
            if not any_.any():
                break
            at = np.argmax(alive, axis=1)
            out[any_, k] = cand[p, at][any_]
            alive &= ~(ALPHA * ALPHA * between[p, at] <= far)
            alive[p, at] = False
        return out

    def _insert(self, batch: np.ndarray) -> None:
        ids, _ = self.search(self.unit[batch], BUILD_BEAM)
        self.links[batch] = self._prune(batch, np.concatenate([ids, self.links[batch]], axis=1))
        src = np.repeat(batch, MOST)
        dst = self.links[batch].ravel().astype(np.int64)
        src, dst = src[dst >= 0], dst[dst >= 0]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        targets, first, count = np.unique(dst, return_index=True, return_counts=True)
        for i in range(0, len(targets), STEP):
            t, f, c = targets[i : i + STEP], first[i : i + STEP], count[i : i + STEP]
            back = np.full((len(t), int(c.max())), -1, np.int64)
            place = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)
            back[np.repeat(np.arange(len(t)), c), place] = src[f[0] : f[0] + int(c.sum())]
            have = self.links[t].astype(np.int64)
            back[(back[:, :, None] == have[:, None, :]).any(axis=2)] = -1
            both = np.concatenate([have, back], axis=1)
            full = (both >= 0).sum(axis=1) > MOST
            packed = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), 1)[:, :MOST]
            self.links[t[~full]] = packed[~full]
            if full.any():
                self.links[t[full]] = self._prune(t[full], both[full])


def usable(vector: Column) -> Column:
    """Not null, not zero, all components finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _vectors(column) -> np.ndarray:
    return np.stack([np.asarray(x, np.float64) for x in column])


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["h1", "h2"])
    vectors = _vectors(pdf["vector"])
    unit = _unit(vectors)
    _, at, vertex, members = np.unique(np.round(unit, DIGITS) + 0.0, axis=0, return_index=True, return_inverse=True, return_counts=True)
    order = np.argsort(vertex.ravel(), kind="stable")  # vectors of one vertex stand together
    graph = Graph(unit[at]) if len(at) > SCAN else None
    ids = [pdf["ids"].iloc[i] for i in order]
    return pd.DataFrame({
        "dim": [vectors.shape[1]], "shard": [int(pdf["shard"].iloc[0])], "start": [graph.start if graph else -1],
        "vectors": [vectors[order].tobytes()], "members": [members.astype("<i4").tobytes()], "links": [graph.links.tobytes() if graph else b""],
        "counts": [np.array([len(x) for x in ids], "<i4").tobytes()], "ids": [np.concatenate([np.asarray(x, "<i8") for x in ids]).tobytes()],
    })


_INDEX = "dim int, shard int, start int, vectors binary, members binary, links binary, counts binary, ids binary"


def build_index(table: DataFrame, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", shard_size: int = SHARD) -> DataFrame:
    """A row for each shard with its graph, of every usable vector in ``table``.

    Equal vectors are kept once, with their ``k + 1`` smallest ids: more can't be
    among the nearest.  Null ids take no part; vectors of different lengths are
    kept in different shards.  Graphs are rebuilt alike on a lost executor.
    """
    rows = table.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector")).filter(F.col("id").isNotNull() & usable(F.col("vector")))
    rows = rows.select("id", "vector", F.size("vector").alias("dim"), F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit(1), "vector").alias("h2"))
    least = rows.withColumn("rank", F.dense_rank().over(Window.partitionBy("h1", "h2", "dim").orderBy("id"))).filter(F.col("rank") <= k + 1)
    nodes = materialize(least.groupBy("h1", "h2", "dim").agg(F.first("vector").alias("vector"), F.array_sort(F.collect_set("id")).alias("ids")), "ann-nodes")
    sizes = nodes.groupBy("dim").agg(F.ceil(F.count("*") / shard_size).cast("int").alias("shards"))
    dealt = nodes.join(sizes, "dim").withColumn("shard", F.pmod("h1", "shards").cast("int"))
    # few rows, but each shard is a minute's work: a given number of partitions isn't coalesced by size
    tasks = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = dealt.select("dim", "shard", "h1", "h2", "vector", "ids").repartition(tasks, "dim", "shard")
    return own.groupBy("dim", "shard").applyInPandas(_build, _INDEX)


class _Shard:
    """A shard's index as it was built, and its answers."""

    def __init__(self, row: dict):
        self.vectors = np.frombuffer(row["vectors"], np.float64).reshape(-1, row["dim"])
        self.members, self.counts, self.ids = (np.frombuffer(row[c], t) for c, t in (("members", "<i4"), ("counts", "<i4"), ("ids", "<i8")))
        self.first = np.cumsum(self.members) - self.members  # of a vertex, among vectors
        self.begin = np.cumsum(self.counts) - self.counts  # of a vector, among ids
        self.norm = np.sqrt((self.vectors * self.vectors).sum(axis=1))
        n = len(self.members)
        self.graph = Graph(_unit(self.vectors[self.first]), np.frombuffer(row["links"], np.int32).reshape(n, MOST), row["start"]) if row["start"] >= 0 else None

    def _cosines(self, near: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (self.vectors[near] * q).sum(axis=1) / (self.norm[near] * np.sqrt((q * q).sum()))

    def nearest(self, asked: np.ndarray, qids: list[int], k: int, beam: int) -> Iterator[tuple[int, int, float]]:
        """(query's id, id, cosine): the ``k`` nearest of each query that were found, ties by the smaller id."""
        every = np.arange(len(self.vectors))
        found = self.graph.search(_unit(asked).astype(np.float32), beam)[0] if self.graph else [None] * len(asked)
        for q, qid, vertices in zip(asked, qids, found, strict=True):
            near = every
            if vertices is not None:
                vertices = vertices[vertices >= 0]
                size = self.members[vertices]
                near = np.repeat(self.first[vertices], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            score = self._cosines(near, q)
            if vertices is not None:
                own = np.maximum.reduceat(score, np.cumsum(size) - size)  # of each vertex
                best = -np.sort(-own)[: k + 2]
                if (best[:-1] - best[1:] <= TIE).any():  # more of the tied may lie outside the beam
                    near, score = every, self._cosines(every, q)
            order, rows = np.argsort(-score, kind="stable"), []
            enough = min(int(np.searchsorted(np.cumsum(self.counts[near[order]]), k + 1)), len(order) - 1)  # the query's own id may be among them
            for m in order[: max(enough + 1, np.count_nonzero(score >= score[order[enough]]))].tolist():
                b = self.begin[near[m]]
                rows += [(-float(score[m]), int(x)) for x in self.ids[b : b + self.counts[near[m]]] if x != qid]
            yield from ((qid, x, -s) for s, x in sorted(rows)[:k])


def _answers(k: int, beam: int):
    def answer(batches):
        """Rows come by shard, its index before the queries."""
        shard = None
        for batch in batches:
            pending: list[dict] = []
            for row in [*batch.to_pylist(), None]:
                if row is not None and row["vectors"] is None:
                    pending.append(row)
                if pending and (row is None or row["vectors"] is not None or len(pending) == STEP):
                    out = list(shard.nearest(_vectors([r["vector"] for r in pending]), [r["query_id"] for r in pending], k, beam)) if shard else []
                    pending = []
                    yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])
                if row is not None and row["vectors"] is not None:
                    shard = _Shard(row)
        release()

    return answer


def search(index: DataFrame, queries: DataFrame, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", beam: int = BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` nearest found, by cosine, never its own id.

    Ties go to the smaller id.  Queries with an unusable vector or a null id have
    no rows; repeated queries are one; with fewer candidates than ``k`` there are
    as many rows as candidates.
    """
    spark = queries.sparkSession
    bound_batches(spark)
    index = materialize(index, "ann-index")
    asked = queries.select(F.col(vec_id).cast("long").alias("query_id"), F.col(vector).cast("array<double>").alias("vector")).filter(F.col("query_id").isNotNull() & usable(F.col("vector"))).distinct()
    asked = materialize(asked.withColumn("dim", F.size("vector")), "ann-queries")
    shards = index.groupBy("dim").agg(F.max("shard").alias("last"))
    # every query meets every shard; a shard's index moves once
    dealt = asked.join(shards, "dim").select("dim", F.explode(F.sequence(F.lit(0), "last")).alias("shard"), "query_id", "vector")
    stream = index.unionByName(dealt, allowMissingColumns=True)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    stream = stream.repartition(tasks, "dim", "shard").sortWithinPartitions("dim", "shard", F.col("vectors").isNull())
    found = materialize(stream.mapInArrow(_answers(k, beam), "query_id long, vec_id long, score double"), "ann-found", 256)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

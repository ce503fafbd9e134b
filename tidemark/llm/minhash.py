"""Near-duplicate documents: banded MinHash candidates under sequential Bayesian verification.

1. Each document becomes its set of hashed word shingles, its signature and the
   hashes of the signature's bands.  Documents of one set are one node from here on.
2. A bucket (band) proposes its least node, the pivot, to each other member; so a
   bucket of a million near copies makes a million pairs, not their square.
3. A pair's signatures are compared batch by batch; it is dropped once the
   posterior probability of the threshold or more falls below ``miss``.
   Survivors are verified on their full sets, and links joined to components.
4. Members of a bucket that still are in different components are compared with
   each other in blocks: signatures find the nodes that may have links, only
   those meet on full sets, and a block's task returns a spanning set of links.
"""

from __future__ import annotations

import hashlib
from functools import cache
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import delete, fresh, materialize, release, within, without
from .components import components

BATCH = 32
#: Nodes of one side of a block of comparisons.
BLOCK = 128
#: Distinct words whose hash a worker remembers.
_WORDS = 100_000
#: Nodes without any id are numbered from here; ids must be smaller.
NO_ID = 1 << 62
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def _finish(h: np.ndarray) -> np.ndarray:
    """The 64-bit finalizer of MurmurHash3."""
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= _WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_WORD_HASHES = _Words()


def shingle_set(text: bytes | None, k: int) -> np.ndarray:
    r"""The sorted distinct hashes of the runs of ``k`` words ([^\x20\x09-\x0D]+, A-Z lower-cased).

    With fewer words, but some, the whole sequence is one shingle.
    """
    words = text.lower().split() if text else []  # of bytes: ASCII only, and exactly these blanks
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_WORD_HASHES.__getitem__, words), np.uint64, len(words))
    n = min(k, len(h))
    with np.errstate(over="ignore"):
        out = np.full(len(h) - n + 1, n, np.uint64)
        for j in range(n):
            # each word enters mixed with its place, so that order counts
            out = out * _MIX[7] + (h[j : len(h) - n + 1 + j] ^ _MIX[j % 7]) * _MIX[(j + 1) % 7]
        out = np.sort(_finish(out))
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


class Signer:
    def __init__(self, bands: int, rows: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.a = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
        self.b = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint64).astype(np.uint32)
        self.weight = rng.integers(0, 1 << 63, rows, dtype=np.uint64) | np.uint64(1)

    def sign(self, shingles: np.ndarray) -> np.ndarray:
        low = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        x = (shingles >> np.uint64(32)).astype(np.uint32)
        for i in range(0, len(x), 1024):
            part = self.a[:, None] * x[i : i + 1024] + self.b[:, None]
            np.minimum(low, part.min(axis=1), out=low)
        return low

    def band_hashes(self, low: np.ndarray) -> np.ndarray:
        h = (low.reshape(self.bands, self.rows).astype(np.uint64) * self.weight).sum(axis=1, dtype=np.uint64)
        return _finish(h + np.arange(self.bands, dtype=np.uint64) * _MIX[0]).view(np.int64)


@cache
def least_matches(hashes: int, threshold: float, miss: float) -> tuple[int, ...]:
    """After each batch, the matches without which P(similarity >= threshold | matches) < miss, from a uniform prior."""
    out = []
    for n in range(BATCH, hashes + BATCH, BATCH):
        n = min(n, hashes)
        # posterior Beta(m + 1, n - m + 1): P(S >= t) = P(Binomial(n + 1, t) <= m)
        tail, m = 0.0, -1
        while tail < miss and m <= n:
            m += 1
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return tuple(out)


def plausible(a: np.ndarray, b: np.ndarray, threshold: float, miss: float) -> np.ndarray:
    """Which rows of two arrays of signatures outlive all batches."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), np.int32)
    for i, least in enumerate(least_matches(a.shape[1], threshold, miss)):
        s = slice(i * BATCH, (i + 1) * BATCH)
        matches[alive] += (a[alive, s] == b[alive, s]).sum(axis=1, dtype=np.int32)
        alive = alive[matches[alive] >= least]
    out = np.zeros(len(a), bool)
    out[alive] = True
    return out


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * |a and b| >= percent * |a or b|, on sorted distinct hashes."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    small, large = (a, b) if len(a) < len(b) else (b, a)
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _signatures(rows: DataFrame, k: int, bands: int, width: int) -> DataFrame:
    signer = Signer(bands, width)

    def sign(batches):
        for batch in batches:
            n, f1, f2, marks, sigs = [], [], [], [], []
            for text in batch.column(3):
                s = shingle_set(text.as_py(), k)
                n.append(len(s))
                if not len(s):
                    for x in (f1, f2, marks, sigs):
                        x.append(None)
                    continue
                d = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
                low = signer.sign(s)
                f1.append(int(d[0]))
                f2.append(int(d[1]))
                marks.append(signer.band_hashes(low))
                sigs.append(low.astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(marks, pa.list_(pa.int64())), pa.array(sigs, pa.binary())], names=["row", "doc_id", "th", "n", "f1", "f2", "bands", "sig"])
        release()

    return rows.mapInArrow(sign, "row long, doc_id long, th long, n long, f1 long, f2 long, bands array<long>, sig binary")


def _sets(rows: DataFrame, k: int) -> DataFrame:
    def make(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([shingle_set(t.as_py(), k).tobytes() for t in part.column(2)], pa.binary())], names=["doc_id", "th", "shingles"])
        release()

    return rows.mapInArrow(make, "doc_id long, th long, shingles binary")


def _signs(column) -> np.ndarray:
    raw = [x.as_py() for x in column] if isinstance(column, pa.Array) else list(column)
    return np.frombuffer(b"".join(raw), "<u2").reshape(len(raw), -1)


def _prune(pairs: DataFrame, threshold: float, miss: float) -> DataFrame:
    def keep(batches):
        for batch in batches:
            if batch.num_rows:
                ok = plausible(_signs(batch.column(2)), _signs(batch.column(3)), threshold, miss)
                yield batch.select(["u", "v"]).filter(pa.array(ok))
        release()

    return pairs.mapInArrow(keep, "u long, v long")


def _verify(pairs: DataFrame, percent: int) -> DataFrame:
    def keep(batches):
        for batch in batches:
            ok = [linked(np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64), percent) for a, b in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))
        release()

    return pairs.mapInArrow(keep, "u long, v long")


class _Unmet:
    """Which nodes of the right side a left node has to be compared with in one block.

    Two nodes of different components that share several buckets meet in the one
    of the least hash only, and where both belong to the rest, on one side only.
    ``met`` lists the earlier buckets of the left node: at most one for each band.
    """

    def __init__(self, left: pd.DataFrame, right: pd.DataFrame):
        self.label, self.node, self.rest = (right[c].to_numpy() for c in ("label", "node", "rest"))
        self.left = list(zip(left["node"].tolist(), left["label"].tolist(), left["met"].tolist(), strict=True))
        at: dict[int, list[int]] = {}
        for j, met in enumerate(right["met"].tolist()):
            for band in met:
                at.setdefault(int(band), []).append(j)
        self.at = {band: np.array(js) for band, js in at.items()}

    def __getitem__(self, i: int) -> np.ndarray:
        node, label, met = self.left[i]
        ok = (self.label != label) & ((self.rest == 0) | (self.node > node))
        for band in met:
            if (js := self.at.get(int(band))) is not None:
                ok[js] = False
        return np.flatnonzero(ok)


def _sides(pdf: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    return pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]


_HOPES = "band long, i long, j long, side int, node long, label long, rest int, met array<long>"


def _block_hopes(percent: int, miss: float):
    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        """The nodes of one block whose signature lets some link with another component be; no sets are read yet."""
        left, right = _sides(pdf)
        hope_l, hope_r = np.zeros(len(left), bool), np.zeros(len(right), bool)
        if len(left) and len(right):
            a, b, unmet = _signs(left["sig"]), _signs(right["sig"]), _Unmet(left, right)
            for i in range(len(left)):
                other = unmet[i]
                good = other[plausible(np.broadcast_to(a[i], (len(other), a.shape[1])), b[other], percent / 100, miss)]
                hope_l[i] = len(good) > 0
                hope_r[good] = True
        return pd.concat([left[hope_l], right[hope_r]])[["band", "i", "j", "side", "node", "label", "rest", "met"]]

    return find


def _block_links(percent: int, miss: float):
    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        """A spanning set of the links between the rest's nodes and the others of one block."""
        left, right = _sides(pdf)
        out: list[tuple[int, int]] = []
        if len(left) and len(right):
            a, b, unmet = _signs(left["sig"]), _signs(right["sig"]), _Unmet(left, right)
            parent: dict[int, int] = {}

            def root(x: int) -> int:
                while (up := parent.get(x, x)) != x:
                    parent[x] = parent.get(up, up)
                    x = up
                return x

            ln, rn = left["node"].tolist(), right["node"].tolist()
            for node, label in zip(ln + rn, left["label"].tolist() + right["label"].tolist(), strict=True):
                parent[node] = label  # nodes of a component are together already
            ls = [np.frombuffer(x, np.uint64) for x in left["shingles"]]
            rs = [np.frombuffer(x, np.uint64) for x in right["shingles"]]
            for i in range(len(left)):
                other = unmet[i]
                for j in other[plausible(np.broadcast_to(a[i], (len(other), a.shape[1])), b[other], percent / 100, miss)].tolist():
                    x, y = root(ln[i]), root(rn[j])
                    if x != y and linked(ls[i], rs[j], percent):
                        parent[max(x, y)] = min(x, y)
                        out.append((ln[i], rn[j]))
        return pd.DataFrame(out, columns=["u", "v"], dtype="int64")

    return find


def _nodes(signed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ids, nodes): the node of every row, and one row of each node with its bands and signature.

    A set's node is its least id.  Rows of one set are first grouped within one of
    64 parts, so that a set of a third of all rows is no single key of the join;
    wide rows are moved only where a set has several rows.
    """
    part = F.pmod(F.xxhash64("row"), F.lit(64)).cast("int").alias("part")
    narrow = signed.select("row", "doc_id", "th", "n", "f1", "f2", part)
    parts = narrow.filter("n > 0").groupBy("f1", "f2", "part").agg(F.min("doc_id").alias("least"), F.count("*").alias("size"))
    parts = materialize(parts, "mh-parts")
    whole = parts.groupBy("f1", "f2").agg(F.min("least").alias("first"), F.sum("size").alias("of")).filter("of > 1")
    several = materialize(parts.select("f1", "f2", "part").join(whole, ["f1", "f2"]).select("f1", "f2", "part", "first", F.lit(1).alias("many")), "mh-several")
    own = F.when(F.col("n") > 0, F.coalesce(F.when(F.col("many") == 1, F.col("first")).otherwise(F.col("doc_id")), F.lit(NO_ID) + F.pmod("f1", F.lit(NO_ID))))
    ids = narrow.join(several, ["f1", "f2", "part"], "left").select("row", "doc_id", "th", "n", own.alias("node"), "many", F.col("doc_id").eqNullSafe(F.col("first")).alias("is_first"))
    ids = materialize(ids, "mh-ids")
    of_many = ids.filter("many = 1")
    chosen = of_many.filter("is_first").groupBy("node").agg(F.min("row").alias("row")).select("row")
    others = materialize(of_many.select("row").join(chosen, "row", "left_anti").withColumnRenamed("row", "other"), "mh-others")
    single = without(signed.filter("n > 0"), others, F.xxhash64("row"), F.xxhash64("other"), F.col("row") == F.col("other"))
    alone = F.coalesce("doc_id", F.lit(NO_ID) + F.pmod("f1", F.lit(NO_ID)))  # the chosen row has the least id
    nodes = materialize(single.select(alone.alias("node"), "doc_id", "th", "bands", "sig"), "mh-nodes")
    delete(signed, parts, several, others)
    return ids, nodes


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = 40, rows: int = 6, miss: float = 1e-9, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id, text_hash, label, kept) for every row of ``docs``; ``label`` is the component, null without words.

    Two documents are linked if 100 * |A and B| >= percent * |A or B| for their
    sets of ``shingle``-word shingles; components are what links connect.  With
    the given bands a pair at 80 % fails to become a candidate with probability
    5e-6 and is pruned with probability ``miss`` for each batch.

    Null and empty texts have no set and stand alone.  Rows that repeat an id are
    judged by their texts.  A row with a null id is in its text's component, whose
    id is null if no row of it has one; it is kept only then.  Ids are below 2^62.
    An empty table gives an empty result.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(t).alias("th"), t.cast("binary").alias("text"))
    signed = materialize(_signatures(base.select(F.monotonically_increasing_id().alias("row"), "*"), shingle, bands, rows), "mh-signed")
    ids, nodes = _nodes(signed)

    rows_ = nodes.select("node", F.explode("bands").alias("band"))
    shared = rows_.groupBy("band").agg(F.count("*").alias("size"), F.min("node").alias("pivot"), F.max("node").alias("top")).filter("pivot != top")
    shared = materialize(shared.select("band", "pivot", "size"), "mh-shared")
    every = materialize(rows_.join(shared, "band").select("band", "pivot", "size", "node"), "mh-every")
    # buckets of the same members are one
    buckets = every.groupBy("band", "size", "pivot").agg(F.max("node").alias("top"), F.expr("bit_xor(xxhash64(node))").alias("mark"))
    buckets = materialize(buckets.groupBy("size", "pivot", "top", "mark").agg(F.min("band").alias("band")).select("band"), "mh-buckets")
    members = materialize(every.join(buckets, "band", "left_semi"), "mh-members")
    delete(shared, every, buckets)

    def with_column(pairs: DataFrame, source: DataFrame, name: str) -> DataFrame:
        u = source.select(F.col("node").alias("u"), F.col(name).alias("a"))
        v = source.select(F.col("node").alias("v"), F.col(name).alias("b"))
        return pairs.join(u, "u").join(v, "v").select("u", "v", "a", "b")

    met = materialize(members.select("node").distinct(), "mh-met")
    signs = within(nodes.select("node", "doc_id", "th", "sig"), F.xxhash64("node"), met.select(F.xxhash64("node")))
    signs = materialize(signs.join(met, "node", "left_semi"), "mh-signs")
    delete(nodes, met)
    pairs = members.filter("node != pivot").select(F.col("pivot").alias("u"), F.col("node").alias("v")).distinct()
    likely = materialize(_prune(with_column(pairs, signs, "sig"), percent / 100, miss).distinct(), "mh-likely")
    # full sets, from the whole texts, of every node that may be compared
    open_nodes = likely.select(F.col("u").alias("node")).union(likely.select(F.col("v").alias("node"))).union(members.filter("size > 2").select("node")).distinct()
    wanted = materialize(signs.join(open_nodes, "node").select("node", F.col("doc_id").alias("d2"), F.col("th").alias("t2")).distinct(), "mh-wanted")
    texts = within(base, F.xxhash64("doc_id", "th"), wanted.select(F.xxhash64("d2", "t2")))
    full = _sets(texts, shingle).join(wanted, F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("th") == F.col("t2")))
    full = materialize(full.groupBy("node", "th").agg(F.first("shingles").alias("shingles")), "mh-sets", 500)
    links = materialize(_verify(with_column(likely, full, "shingles"), percent), "mh-links", 500)
    labels = components(links)
    delete(likely, wanted, links)

    # buckets that still hold several components: their rest against all, but for the pivot's pairs, which are settled
    label_of = labels.select("node", "label")
    known = members.filter("size > 2").join(label_of, "node", "left").withColumn("label", F.coalesce("label", "node"))
    pivots = label_of.select(F.col("node").alias("pivot"), F.col("label").alias("plabel"))
    known = known.filter("node != pivot").join(pivots, "pivot", "left").withColumn("rest", (F.col("label") != F.coalesce("plabel", "pivot")).cast("int"))
    known = materialize(known.select("band", "node", "label", "rest"), "mh-known")
    split = known.groupBy("band").agg(F.sum("rest").alias("n_rest"), F.count("*").alias("n_all"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    split = materialize(split.filter("n_rest > 0 and lo != hi").select("band", F.ceil(F.col("n_rest") / block).alias("ni"), F.ceil(F.col("n_all") / block).alias("nj")), "mh-split")
    dealt = known.join(split, "band")
    of_node = F.collect_list("band").over(Window.partitionBy("node"))  # at most one for each band of the signature
    dealt = materialize(dealt.withColumn("met", F.filter(of_node, lambda b: b < F.col("band"))), "mh-dealt")
    place = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    to = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    kept = ["band", "node", "label", "rest", "met"]
    left = dealt.filter("rest = 1").select(*kept, place("ni").alias("i"), to("nj").alias("j"), F.lit(0).alias("side"))
    right = dealt.select(*kept, to("ni").alias("i"), place("nj").alias("j"), F.lit(1).alias("side"))
    blocks = left.unionByName(right).join(signs.select("node", "sig"), "node")
    hopes = blocks.groupBy("band", "i", "j").applyInPandas(_block_hopes(percent, miss), _HOPES)
    hopes = materialize(hopes, "mh-hopes")
    both = full.select("node", "shingles").join(signs.select("node", "sig"), "node")
    blocks = hopes.join(both, "node")
    more = materialize(blocks.groupBy("band", "i", "j").applyInPandas(_block_links(percent, miss), "u long, v long").distinct(), "mh-more", 500)
    delete(signs, members, full, known, split, dealt, hopes)
    if not more.isEmpty():
        old, labels = labels, components(labels.select(F.col("node").alias("u"), F.col("label").alias("v")).union(more))
        delete(old)
    delete(more)

    judged = ids.select("doc_id", "th", "n", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    component = F.when(F.col("node").isNull(), F.col("doc_id")).when(F.col("label") < NO_ID, F.col("label"))
    out = judged.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("th").alias("text_hash"), "label")
    out = out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    out._tables = [*ids._tables, *labels._tables]
    return out


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, with one row of each component: one with the least id.

    Documents without words all stay.  Where several rows have the least id, the
    one whose text has the least hash stays; without any id in a component
    likewise; of whole rows that repeat, one.  ``docs`` is read several times, so
    it should be a table; only rows that may have to go are shuffled.
    """
    found = near_duplicates(docs, shingle, percent, doc_id=doc_id, text=text)
    judged = materialize(found.filter("label is not null").select("doc_id", "text_hash", "label", "kept"), "mh-judged")
    delete(found)
    best = judged.filter("kept").groupBy("label").agg(F.min("text_hash").alias("least"), F.count("*").alias("rows"))
    best = materialize(best.filter("rows > 1").select("label", "least"), "mh-best")  # the least id stands in several rows
    losing = judged.filter("kept").join(best, "label").filter("text_hash != least")
    id_, hash_, k = fresh(docs.columns, "__id", "__hash", "__k")
    pick = [F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_)]
    gone = materialize(judged.filter("not kept").select(*pick).union(losing.select(*pick)).distinct(), "mh-gone")
    again = judged.filter("kept").join(best, "label").filter("text_hash = least").groupBy(*pick).agg(F.count("*").alias("rows"))
    again = materialize(again.filter("rows > 1").select(id_, hash_), "mh-again")  # whole rows that repeat
    delete(judged, best)
    text_hash = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    same = F.col(doc_id).cast("long").eqNullSafe(F.col(id_)) & (text_hash == F.col(hash_))
    key, theirs = F.xxhash64(F.col(doc_id).cast("long"), text_hash), F.xxhash64(id_, hash_)
    left = without(docs, gone, key, theirs, same)
    if again.isEmpty():
        return left
    many = left.join(again, same, "left_semi").withColumn(k, F.row_number().over(Window.partitionBy(doc_id, text_hash).orderBy(F.lit(0)))).filter(F.col(k) == 1).drop(k)
    return without(left, again, key, theirs, same).unionByName(many)

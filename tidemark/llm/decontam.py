"""Benchmark decontamination: a prefix-filtered join on exact word windows.

An item's windows are looked for in every document.  As a document must hold the
whole window, one of its tokens is prefix enough: the rarest over the corpus.
Only where a document holds such a token is a window laid over it, at the one
place that the token's position allows (the positional bound) and that lies
within the document (the length bound), and then compared word by word, rarest
words first.  The benchmark travels to the tasks in blocks of bounded size, one
at a time, and every block meets all documents; what the blocks hit is united.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, materialize, release

#: Words of benchmark items that one pass takes to the tasks.
BLOCK_WORDS = 2_000_000
#: Bytes of text, and candidates, that a worker handles at once.
BATCH_BYTES, CANDIDATES = 2 << 20, 1 << 18

_WORD = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    r"""The lower-cased [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of a text in UTF-8 (A-Z lower-cased first)."""
    return text.translate(_WORD).split() if text else []


class Windows:
    """The windows of a block of items, as numbers of words."""

    def __init__(self, items: list[tuple[object, bytes | None]], width: int):
        self.ids: dict[bytes, int] = {}
        seen: dict[tuple[int, ...], int] = {}
        owners: list[set] = []
        for item, text in items:
            nums = [self.ids.setdefault(w, len(self.ids) + 1) for w in words_of(text)]
            n = min(width, len(nums))
            for i in range(len(nums) - n + 1 if n else 0):
                own = seen.setdefault(tuple(nums[i : i + n]), len(seen))
                if own == len(owners):
                    owners.append(set())
                owners[own].add(item)
        self.owners = [sorted(o, key=str) for o in owners]
        self.length = np.array([len(w) for w in seen], np.int32)
        self.words = np.zeros((len(seen), width), np.int32)
        for i, w in enumerate(seen):
            self.words[i, : len(w)] = w

    def order_by_rarity(self, counts: np.ndarray) -> None:
        """``counts``: of each word number over all documents.  Indexes each window under its rarest word."""
        far = np.where(np.arange(self.words.shape[1]) < self.length[:, None], counts[self.words], np.iinfo(np.int64).max)
        self.order = np.argsort(far, axis=1, kind="stable").astype(np.int32)
        first = self.words[np.arange(len(self.words)), self.order[:, 0]] if len(self.words) else np.zeros(0, np.int32)
        self.by_word = np.argsort(first, kind="stable").astype(np.int64)
        self.begin = np.searchsorted(first[self.by_word], np.arange(len(counts) + 1))


class _Numbers(dict):
    def __missing__(self, word):
        return 0


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    """(other columns, texts) of about BATCH_BYTES; the text is the last column, in bytes."""
    for batch in batches:
        size, at, texts = 0, 0, []
        column = batch.column(batch.num_columns - 1)
        for i in range(len(column)):
            texts.append(column[i].as_py())
            size += len(texts[-1] or b"")
            if size >= BATCH_BYTES or i + 1 == len(column):
                yield [batch.column(c).slice(at, len(texts)) for c in range(batch.num_columns - 1)], texts
                size, at, texts = 0, i + 1, []


def _word_counts(docs: DataFrame, ids: dict[bytes, int]) -> np.ndarray:
    """How often each word of the block stands in all documents: sums for each task, then over tasks."""
    n = len(ids) + 1
    sent = docs.sparkSession.sparkContext.broadcast(ids)

    def count(batches):
        numbers, total = _Numbers(sent.value), np.zeros(n, np.int64)
        for _, texts in _batches(batches):
            for t in texts:
                w = words_of(t)
                total += np.bincount(np.fromiter(map(numbers.__getitem__, w), np.int32, len(w)), minlength=n) if n < 4 * len(w) else 0
                if n >= 4 * len(w):
                    np.add.at(total, np.fromiter(map(numbers.__getitem__, w), np.int32, len(w)), 1)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int32()), pa.array(total[hit])], names=["w", "n"])
        release()

    out = np.zeros(n, np.int64)
    with arrow_rows(docs.sparkSession, 2_000):
        for r in docs.mapInArrow(count, "w int, n long").groupBy("w").agg(F.sum("n").alias("n")).toLocalIterator():
            out[r["w"]] = r["n"]
    sent.unpersist()
    return out


def _hits(nums: np.ndarray, doc: np.ndarray, w: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Over documents laid end to end: which words are hit, and (document, window) of each occurrence."""
    hit = np.zeros(len(nums) + 1, np.int32)
    found_doc, found_win = [], []
    fan = w.begin[nums + 1] - w.begin[nums]
    fan[nums == 0] = 0
    places = np.flatnonzero(fan)
    at = 0
    upto = np.cumsum(fan[places])
    while at < len(places):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + CANDIDATES, side="right")))
        p, k = places[at:end], fan[places[at:end]]
        at = end
        spot = np.repeat(p, k)
        win = w.by_word[np.repeat(w.begin[nums[p]], k) + (np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k))]
        start = spot - w.order[win, 0]
        stop = start + w.length[win]
        ok = (start >= 0) & (stop <= len(nums))
        ok[ok] = (doc[start[ok]] == doc[spot[ok]]) & (doc[stop[ok] - 1] == doc[spot[ok]])
        start, win = start[ok], win[ok]
        for j in range(1, w.words.shape[1]):
            if not len(win):
                break
            o = w.order[win, j]
            same = (j >= w.length[win]) | (nums[np.where(j < w.length[win], start + o, start)] == w.words[win, o])
            start, win = start[same], win[same]
        if len(win):
            np.add.at(hit, start, 1)
            np.add.at(hit, start + w.length[win], -1)
            found_doc.append(doc[start])
            found_win.append(win)
    none = np.zeros(0, np.int64)
    return np.cumsum(hit)[:-1] > 0, np.concatenate(found_doc) if found_doc else none, np.concatenate(found_win) if found_win else none


def _blocks(bench: DataFrame, item_id: str, text: str, block_words: int) -> Iterator[list[tuple[object, bytes | None]]]:
    """Items in blocks of bounded size, streamed to the driver; rows without an id or a text have no windows."""
    block, n = [], 0
    rows = bench.filter(F.col(item_id).isNotNull() & F.col(text).isNotNull()).select(F.col(item_id).alias("i"), F.col(text).cast("binary").alias("t"))
    for r in rows.toLocalIterator():
        block.append((r["i"], bytes(r["t"])))
        n += len(r["t"]) // 5 + 1
        if n >= block_words:
            yield block
            block, n = [], 0
    if block:
        yield block


def _matched(rows: DataFrame, key: Column, sent: Broadcast | None, schema: str) -> DataFrame:
    """Each row's hits by the windows of one block (None: no windows)."""

    def match(batches):
        windows = sent.value if sent is not None else None
        numbers = _Numbers(windows.ids) if windows is not None else None
        for others, texts in _batches(batches):
            words = [words_of(t) for t in texts]
            sizes = np.array([len(x) for x in words], np.int64)
            doc = np.repeat(np.arange(len(words)), sizes)
            hit, owners = np.zeros(len(doc), bool), [set() for _ in words]
            if windows is not None:
                nums = np.fromiter((n for x in words for n in map(numbers.__getitem__, x)), np.int32, len(doc))
                own, d, w = _hits(nums, doc, windows)
                hit = own
                for i, j in set(zip(d.tolist(), w.tolist(), strict=True)):
                    owners[i].update(windows.owners[j])
            edge = np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))
            spans: list[list[int]] = [[] for _ in words]
            first = np.cumsum(sizes) - sizes
            for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
                while a < b:  # a run may reach from one document into the next
                    i = int(doc[a])
                    end = min(b, int(first[i] + sizes[i]))
                    spans[i] += [a - int(first[i]), end - int(first[i])]
                    a = end
            yield pa.RecordBatch.from_arrays([others[0], others[1], pa.array(sizes), pa.array(spans, pa.list_(pa.int32())), pa.array([sorted(map(str, o)) for o in owners], pa.list_(pa.string()))], names=["doc_id", "key", "n_words", "spans", "items"])
        release()

    return rows.select("doc_id", key.alias("key"), "text").mapInArrow(match, schema)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans and items of a row united with those of the other blocks."""
    for batch in batches:
        spans, items = [], []
        for own, names, more, other in zip(*(batch.column(c).to_pylist() for c in ("spans", "items", "more_spans", "more_items")), strict=True):
            out: list[int] = []
            for a, b in sorted((s[i], s[i + 1]) for s in [own, *(more or [])] for i in range(0, len(s), 2)):
                if out and a <= out[-1]:
                    out[-1] = max(out[-1], b)
                else:
                    out += [a, b]
            spans.append(out)
            items.append(sorted({*names, *(x for y in other or [] for x in y)}))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), batch.column("n_words"), pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))], names=["doc_id", "key", "n_words", "spans", "items"])


def find_contamination(docs: DataFrame, bench: DataFrame, width: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, n_words, n_hit, items, hit_spans) for every row of ``docs``.

    ``items``: ids of the items with a window in the document, sorted as strings.
    ``hit_spans``: [first, last) word positions that lie in an occurrence.  An item of fewer
    words than ``width`` is one window.  Null text has no words; items with a null
    id or text take no part; repeated items are one; an empty table of either kind
    gives no hits.  Items and documents that tie or repeat each count.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, key string, n_words long, spans array<int>, items array<string>"
    context = docs.sparkSession.sparkContext
    sent, earlier = None, []
    for block in _blocks(bench, item_id, item_text, block_words):
        windows = Windows(block, width)
        if not len(windows.words):
            continue
        if sent is not None:  # only one block is out at a time: what it hits is written before the next goes out
            hits = _matched(rows, F.sha2("text", 256), sent, schema).filter(F.size("spans") > 0)
            earlier.append(materialize(hits.select("key", "spans", "items").dropDuplicates(["key"]), "leak-hits"))
            sent.destroy()
        windows.order_by_rarity(_word_counts(rows.select("text"), windows.ids))
        sent = context.broadcast(windows)
    raw = _matched(rows, F.sha2("text", 256) if earlier else F.lit(None).cast("string"), sent, schema)
    if earlier:
        more = functools.reduce(DataFrame.unionByName, earlier).groupBy("key").agg(F.collect_list("spans").alias("more_spans"), F.collect_list("items").alias("more_items"))
        raw = raw.join(more, "key", "left").select("doc_id", "key", "n_words", "spans", "items", "more_spans", "more_items").mapInArrow(_merged, schema)
    n_hit = F.aggregate(F.transform("spans", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda a, x: a + x)
    spans = F.transform(F.sequence(F.lit(0), (F.size("spans") / 2).cast("int")), lambda i: F.struct(F.try_element_at("spans", 2 * i + 1).alias("first"), F.try_element_at("spans", 2 * i + 2).alias("last")))
    return raw.select("doc_id", "n_words", n_hit.alias("n_hit"), "items", F.filter(spans, lambda s: s["last"].isNotNull()).alias("hit_spans"))


def drop_contaminated(docs: DataFrame, bench: DataFrame, width: int = 10, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` (all columns) that hold no window of an item; ids that repeat go or stay by their own text."""
    judged = find_contamination(docs.withColumn("__key", F.struct(F.col(doc_id), F.xxhash64(F.col(text)))), bench, width, "__key", text)
    bad = materialize(judged.filter("n_hit > 0").select(F.col("doc_id.*")).toDF("__id", "__hash").dropDuplicates(), "leaks")
    return docs.join(bad, F.col(doc_id).eqNullSafe(F.col("__id")) & (F.xxhash64(F.col(text)) == F.col("__hash")), "left_anti")


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()

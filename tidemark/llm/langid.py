"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Inverse document frequencies cover all documents that may be learned from.  The
model is trained in one task on a bounded sample (about ``per_label`` documents of each
language) with follow-the-regularised-leader and an elastic-net penalty, and its
probabilities are calibrated by a temperature on a part kept out of training.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, release

#: Hashed features, and lengths of the n-grams.
BITS, GRAMS = 16, (1, 2, 3)
DIM = 1 << BITS
#: Documents of each language that are trained on, and passes over them.
PER_LABEL, EPOCHS = 1500, 3
#: Penalties and rates of FTRL-proximal; the scale brings relative frequencies near 1.
L1, L2, ALPHA, BETA, SCALE = 1e-3, 1e-3, 0.5, 1.0, 20.0
_SEGMENT = 1 << 20
#: Features whose weights are looked up at once.
_GATHER = 1 << 16
#: All that isn't a letter in ASCII counts as a space.
_FOLD = np.array([c if chr(c).isalpha() else 32 for c in range(128)], np.uint32)
UNKNOWN = "und"


def grams(text: str) -> Iterator[np.ndarray]:
    """Feature numbers of all n-grams of the whole text, in segments."""
    text = f" {text.lower()} "
    for at in range(0, len(text), _SEGMENT):
        c = np.frombuffer(text[max(0, at - 2) : at + _SEGMENT].encode("utf-32-le", "surrogatepass"), np.uint32)
        c = np.where(c < 128, _FOLD[np.minimum(c, 127)], c)
        skip = min(at, 2)  # n-grams that ended in the segment before
        out, h = [], np.zeros(0, np.uint32)
        for n in range(1, max(GRAMS) + 1):
            h = c.copy() if n == 1 else h[: len(c) - n + 1] * np.uint32(0x01000193) ^ c[n - 1 :]
            if n in GRAMS:
                out.append((h[max(0, skip - n + 1) :] * np.uint32(0x9E3779B1) + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) >> np.uint32(32 - BITS))
        yield np.concatenate(out)


def has_letter(text: str | None) -> bool:
    return bool(text) and next(filter(str.isalpha, text), None) is not None


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # features x labels, with inverse document frequency and temperature
    bias: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.labels or not has_letter(text):
            return UNKNOWN, 0.0
        total, n = np.zeros(len(self.labels)), 0
        for g in grams(text):
            for i in range(0, len(g), _GATHER):
                total += self.weights[g[i : i + _GATHER]].sum(axis=0, dtype=np.float64)
            n += len(g)
        z = total * (SCALE / n) + self.bias
        p = np.exp(z - z.max())
        best = int(np.argmax(p))
        return self.labels[best], float(p[best] / p.sum())


def held_out(doc_id: Column) -> Column:
    """True for ids whose decimal text has a CRC-32 divisible by 5; null ids are not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def _learn_rows(docs: DataFrame, cuts: dict[str, int], labels: list[str]) -> DataFrame:
    """Of every task: how many documents hold each feature (w, n); of each sampled document its features."""
    number = {x: i for i, x in enumerate(labels)}

    def rows(batches):
        seen, documents = np.zeros(DIM, np.int64), 0
        for batch in batches:
            out = []
            for text, lang, r in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                text = text.as_py()
                if not has_letter(text):
                    continue
                counts = np.zeros(DIM, np.int64)
                for g in grams(text):
                    counts += np.bincount(g, minlength=DIM)
                hit = np.flatnonzero(counts)
                seen[hit] += 1
                documents += 1
                if r <= cuts[lang]:
                    out.append((r, number[lang], hit.astype("<u4").tobytes(), (counts[hit] / counts.sum()).astype("<f4").tobytes()))
            if out:
                r, y, i, x = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.nulls(len(r), pa.int32()), pa.nulls(len(r), pa.int64()), pa.array(r, pa.int64()), pa.array(y, pa.int32()), pa.array(i, pa.binary()), pa.array(x, pa.binary())], names=_LEARN)
        hit = np.flatnonzero(seen)
        w, n = np.append(hit, -1), np.append(seen[hit], documents)
        yield pa.RecordBatch.from_arrays([pa.array(w, pa.int32()), pa.array(n), *(pa.nulls(len(w), t) for t in (pa.int64(), pa.int32(), pa.binary(), pa.binary()))], names=_LEARN)
        release()

    return docs.mapInArrow(rows, "w int, n long, r long, y int, i binary, x binary")


_LEARN = ["w", "n", "r", "y", "i", "x"]


def ftrl(rows: list[tuple[int, np.ndarray, np.ndarray]], classes: int, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features x classes) and bias from (label, features, values), in the order given."""
    z, n = np.zeros((DIM + 1, classes)), np.zeros((DIM + 1, classes))

    def weights(zi, ni):
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))

    for _ in range(epochs):
        for y, i, x in rows:
            i, x = np.append(i, DIM), np.append(x, 1.0)  # the last feature is the bias
            zi, ni = z[i], n[i]
            w = weights(zi, ni)
            p = x @ w
            p = np.exp(p - p.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p
            root = np.sqrt(ni + g * g)
            z[i] = zi + g - (root - np.sqrt(ni)) / ALPHA * w
            n[i] = ni + g * g
    w = weights(z, n)
    return w[:DIM], w[DIM]


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss.

    The labels count as wrong with the probability that a sample of this size
    can't rule out, so that a faultless sample doesn't make every answer certain.
    """
    if not len(y):
        return 1.0
    classes = logits.shape[1]
    doubt = 1 / (len(y) + 2) if classes > 1 else 0.0
    best, at = np.inf, 1.0
    for t in np.geomspace(0.05, 20, 121):
        s = logits / t
        s = s - s.max(axis=1, keepdims=True)
        own = s[np.arange(len(y)), y]
        expected = (1 - doubt) * own + (doubt * (s.sum(axis=1) - own) / (classes - 1) if classes > 1 else 0.0)
        loss = float(np.mean(np.log(np.exp(s).sum(axis=1)) - expected))
        if loss < best - 1e-12:
            best, at = loss, float(t)
    return at


def train(docs: DataFrame, learn_from: Column | None = None, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_label: int = PER_LABEL, seed: int = 3) -> Model:
    """A model of the labels in ``lang``, from the rows where ``learn_from`` holds and id, text and label are not null.

    Statistics cover all of these rows; weights are fitted to about ``per_label``
    rows of each label, those with the least seeded hashes of their ids.  Rows
    that repeat an id have one hash and are taken or left together, so many of
    them make the sample larger.  Empty texts and texts without letters teach
    nothing, long ones are read whole, other columns don't matter.  Without any
    usable row the model has no labels and answers "und".
    """
    usable = F.col(doc_id).isNotNull() & F.col(lang).isNotNull() & F.col(text).isNotNull()
    rows = docs.filter(usable if learn_from is None else usable & learn_from).select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.xxhash64(F.lit(seed), F.col(doc_id)).alias("r"))
    # hashes are uniform, so a share of their range is that share of a label's rows: no rows of a label meet in a task
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).collect()  # a row for each label
    cuts = {x["lang"]: int(min(1.0, per_label / x["n"]) * (2**64 - 1)) - 2**63 for x in counts}
    labels = sorted(cuts)
    if not labels:
        return Model([], np.zeros((DIM, 0), np.float32), np.zeros(0))
    learned = materialize(_learn_rows(rows, cuts, labels), "lang-rows")
    idf, documents = np.zeros(DIM), 0
    for x in learned.filter("w is not null").groupBy("w").agg(F.sum("n").alias("n")).toLocalIterator():  # DIM rows at most
        if x["w"] < 0:
            documents = x["n"]
        else:
            idf[x["w"]] = x["n"]
    idf = np.log((1 + documents) / (1 + idf)) + 1.0
    classes = len(labels)

    def fit(batches):
        got = [x for b in batches for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
        got.sort()
        data = []
        for _, y, i, x in got:
            i = np.frombuffer(i, "<u4").astype(np.int64)
            data.append((y, i, np.frombuffer(x, "<f4").astype(np.float64) * idf[i] * SCALE))
        check = data[::10] if len(data) >= 50 else data
        own = [d for j, d in enumerate(data) if j % 10] if len(data) >= 50 else data
        w, b = ftrl(own, classes)
        logits = np.array([x @ w[i] + b for _, i, x in check]).reshape(-1, classes)
        t = temperature(logits, np.array([y for y, _, _ in check], np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([(w * idf[:, None] / t).astype("<f4").tobytes()]), pa.array([(b / t).astype("<f8").tobytes()])], names=["w", "b"])
        release()

    sample = learned.filter("y is not null").select("r", "y", "i", "x")
    model = sample.repartition(1).mapInArrow(fit, "w binary, b binary").first()
    if model is None:
        return Model([], np.zeros((DIM, 0), np.float32), np.zeros(0))
    return Model(labels, np.frombuffer(model["w"], "<f4").reshape(DIM, classes), np.frombuffer(model["b"], "<f8"))


def identify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for every row; "und" with score 0 where the text is null or has no letter.

    Repeated rows repeat; an empty table gives an empty result.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # DIM x labels numbers

    def predict(batches):
        m = sent.value
        for batch in batches:
            found = [m.predict(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "lang_pred", "score"])
        release()

    return rows.mapInArrow(predict, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model, min_score: float = 0.5, text: str = "text", fill: str | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, whose language is known with ``min_score`` at least.

    Nulls in the column ``fill``, where the table has one of that name, become the
    language told; its other values stay.  Null and empty texts and texts without
    letters go, whatever the score asked for; repeated rows stay or go together;
    null ids don't matter; an empty table stays empty.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)
    into = docs.columns.index(fill) if fill in docs.columns else None

    def keep(batches):
        m = sent.value
        for batch in batches:
            found = [m.predict(t.as_py()) for t in batch.column(at)]
            if into is not None:
                field = batch.schema.field(into)
                told = pa.array([None if lang == UNKNOWN else lang for lang, _ in found], field.type)
                batch = batch.set_column(into, field, pc.coalesce(batch.column(into), told))
            yield batch.filter(pa.array([lang != UNKNOWN and p >= min_score for lang, p in found], pa.bool_()))
        release()

    return docs.mapInArrow(keep, docs.schema)

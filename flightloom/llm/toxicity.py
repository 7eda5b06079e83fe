"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are the distinct character n-grams (4 to 6 code points of the lower-cased text with a space
before and after, hashed to 2^20 cells) whose log-count ratio between the labels is surely not 0, as chance ratios would
add up in long texts. Each feature's value is its ratio; a logistic regression learns one weight per feature on top. The training set is a bounded sample:
at most ``PER_LABEL`` documents of label 0 and of label 1 and ``BYTES`` of each, those with the least hash of their id. Every text is
scored as a whole.

Defined results: a null or empty text has no n-grams and gets the score of the bias alone; rows without
label or with a null label aren't learned from; a document labelled twice counts as toxic if either says
so; a null id is not held out; repeated rows are scored each; other columns are ignored. Without
labelled rows of both kinds every score is the share of toxic labels, or 0 without labels.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flightloom.llm._io import low_hash, release, sample
from flightloom.llm._text import pieces, strings, tidy

ORDERS = (4, 5, 6)
CELLS = 1 << 20
PER_LABEL = (3200, 1600)
#: Bounds of the sample beside PER_LABEL: bytes of a text, bytes of a label's texts.
LONGEST, BYTES = 1 << 16, 16 << 20
FEATURES = 1 << 14
MIN_DOCS = 3
#: Standard errors that an n-gram's log-count ratio must be off 0.
SURE = 3.5
SMOOTH = 0.5
#: Texts of the sample whose features are held and summed together while it is learned from.
SLICE = 128
RIDGE = 2e-3
STEPS = 200
_K = np.uint64(0xD6E8FEB86659FD93)


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the padded texts in a row, and where each begins (and the last ends)."""
    padded = [f" {x.lower()} " for x in texts]
    ends = np.cumsum([len(x) for x in padded])
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes, np.concatenate([[0], ends]).astype(np.int64)


def _hashed(codes: np.ndarray):
    """Yields (order, cell of the n-gram at each position)."""
    base = codes.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25) + np.uint64(1)
    base ^= base >> np.uint64(29)
    h = np.zeros(len(base), np.uint64)
    for k in range(max(ORDERS)):
        m = len(base) - k
        if m <= 0:
            return
        h = (h[:m] + base[k:]) * _K
        if k + 1 in ORDERS:
            yield k + 1, (h >> np.uint64(44)).astype(np.int32)


def features(text: str) -> np.ndarray:
    """Distinct cells of one text."""
    codes, _ = _codes([text or ""])
    found = [cells for _, cells in _hashed(codes)] if text else []
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int32)


class Model:
    """weights by cell, of which few are not 0, and bias."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights.astype(np.float32), float(bias)
        self.used = self.weights != 0

    def scores(self, texts: list[str]) -> np.ndarray:
        codes, at = _codes(texts)
        empty = np.array([not x for x in texts])
        docs, cells = [], []
        for order, cell in _hashed(codes):
            hit = np.flatnonzero(self.used[cell])
            row = np.searchsorted(at, hit, "right") - 1
            ok = (hit + order <= at[row + 1]) & ~empty[row]
            docs.append(row[ok])
            cells.append(cell[hit[ok]])
        total = np.zeros(len(texts))
        if docs:
            pairs = np.unique(np.concatenate(docs).astype(np.int64) * CELLS + np.concatenate(cells))
            total = np.bincount(pairs // CELLS, self.weights[pairs % CELLS].astype(np.float64), len(texts))
        return 1 / (1 + np.exp(-np.clip(total + self.bias, -30, 30)))


def fit(texts: list[str], labels: list[int]) -> Model:
    """Fits the classifier; the same rows in the same order give the same model."""
    y = np.array(labels, np.float64)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return Model(np.zeros(CELLS, np.float32), np.log(max(share, 1e-13) / max(1 - share, 1e-13)))
    # Two passes over the sample, so that only the chosen features of all its texts are held at once.
    seen, toxic = np.zeros(CELLS, np.int32), np.zeros(CELLS, np.int32)
    for text, label in zip(texts, labels):
        cells = features(text)
        seen[cells] += 1
        toxic[cells] += label
    chosen = np.flatnonzero(seen >= MIN_DOCS)
    p, q = SMOOTH + toxic[chosen], SMOOTH + seen[chosen] - toxic[chosen]
    ratio = np.log(p / (SMOOTH + y.sum())) - np.log(q / (SMOOTH + len(y) - y.sum()))  # of the shares of documents
    sure = np.abs(ratio) / np.sqrt(1 / p + 1 / q)  # the ratio in its standard errors
    best = np.sort(np.argsort(-sure, kind="stable")[: min(FEATURES, int((sure >= SURE).sum()))])
    chosen, ratio = chosen[best], ratio[best]
    place = np.full(CELLS, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    del seen, toxic, p, q, sure, best
    # Slices of the sample as (first text, features of each text, all features) in a narrow type.
    parts = []
    for lo in range(0, len(texts), SLICE):
        kept = [(at := place[features(x)])[at >= 0].astype(np.uint16 if FEATURES <= 1 << 16 else np.int32) for x in texts[lo : lo + SLICE]]
        parts.append((lo, np.array([len(x) for x in kept]), np.concatenate(kept)))
    balance = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    w, bias = np.full(len(chosen), 0.02), 0.0
    m, v, t = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1), 0
    for _ in range(STEPS):
        scaled = w * ratio
        margin = np.concatenate([np.diff(np.concatenate([[0.0], np.cumsum(scaled[cols])])[np.concatenate([[0], np.cumsum(sizes)])]) for _, sizes, cols in parts]) + bias
        miss = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y) * balance / len(y)
        slope = sum(np.bincount(cols, np.repeat(miss[lo : lo + SLICE], sizes), len(chosen)) for lo, sizes, cols in parts)
        grad = np.append(ratio * slope + RIDGE * w, miss.sum())
        t += 1
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        step = 0.03 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, bias = w - step[:-1], bias - step[-1]
    weights = np.zeros(CELLS, np.float32)
    weights[chosen] = w * ratio
    return Model(weights, bias)


def held_out(folds: int, fold: int) -> F.Column:
    """Whether the checksum of doc_id as text falls in the fold that is not learned from; null id: no."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == fold, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, per_label: tuple[int, int] = PER_LABEL, folds: int = 5) -> list:
    """The bounded sample: (text, toxic) of at most per_label documents for each label.

    Ids are chosen by their least hash; of the texts with these ids those over LONGEST bytes are left out, and more
    than per_label or BYTES of a label where ids repeat or texts are long.
    """
    ids = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where(~held_out(folds, 0))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    most = F.when(F.col("toxic") == 1, per_label[1]).otherwise(per_label[0])
    place = F.row_number().over(Window.partitionBy("toxic").orderBy(*order))
    counts = {r["toxic"]: r["count"] for r in ids.where(F.col("toxic").isin(0, 1)).groupBy("toxic").count().collect()}  # two rows
    chosen = ids.where(low_hash("doc_id", "toxic", counts, max(per_label))).withColumn("place", place).where((F.col("place") <= max(per_label)) & (F.col("place") <= most)).select("doc_id", "toxic")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most sum(per_label) ids
    rows = sample(rows, "toxic", [*order, F.col("text")], max(per_label), BYTES, LONGEST)
    return rows.orderBy(*order, "text").select("text", "toxic").collect()


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every whole text."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            text = strings(batch.column(2))
            for lo, hi in pieces(text):
                score = held.value.scores(text[lo:hi].to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi].cast(pa.int64()), batch.column(1)[lo:hi], pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", held_out(5, 0).alias("held_out"), "text").mapInArrow(tidy(run), "doc_id long, held_out boolean, score double, predicted int")


def trained(docs: DataFrame, labels: DataFrame) -> Model:
    rows = training_rows(docs, labels)
    texts, toxic = [r.text or "" for r in rows], [r.toxic for r in rows]
    del rows
    model = fit(texts, toxic)
    del texts
    release(docs.sparkSession)  # the driver goes on with other work
    return model


def filtered(docs: DataFrame, model: Model) -> DataFrame:
    """The documents with a score under 0.5, all their columns."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            text = strings(batch.column(at))
            for lo, hi in pieces(text):
                yield batch.slice(lo, hi - lo).filter(pa.array(held.value.scores(text[lo:hi].to_pylist()) < 0.5))

    return docs.mapInArrow(tidy(run), docs.schema)

"""Toxicity by non-negative positive-unlabelled learning (numpy).

The classifier learns from confirmed toxic texts and from unlabelled ones.
With class prior ``p`` the risk of taking unlabelled texts for clean is
corrected by the part that toxic ones among them contribute,
``E_u[l(-g)] - p E_p[l(-g)]``; when that estimate of a risk turns negative the
model has begun to fit the toxic examples by heart, and the step goes the
other way.  No text is ever taken as a clean example.

Model: logistic over which words a text holds (runs of letters and digits, in
lower case, by 64-bit hash).  The vocabulary is the words whose frequency in
toxic and unlabelled texts differs most, by their z value.  It is fitted on
the driver from samples bounded by ``POSITIVES`` and ``UNLABELLED`` (the rows
with the smallest hashes of their ids); the class prior comes from all labels
of the training part.  Every whole text is scored.

Defined results: a null or empty text has no words and gets the model's base
score; without toxic examples every score is 0; repeated rows score alike; a
row without ``doc_id`` is scored, never trained on and not held out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankwise.llm import rolling as ro
from rankwise.llm.common import text_slices

U = np.uint64
FOLDS = 5
POSITIVES, UNLABELLED = 5_000, 10_000
VOCABULARY = 4_096
#: Least z value of a word's difference in frequency, and least number of toxic texts with it.
LEAST_Z, LEAST_TEXTS = 4.0, 4
STEPS, RATE, DECAY = 300, 0.05, 1e-4

_BREAKS = np.ones(256, bool)
_BREAKS[48:58] = _BREAKS[97:123] = _BREAKS[65:91] = False
_BREAKS[128:] = False


@dataclass(frozen=True)
class Model:
    words: np.ndarray  # sorted hashes
    weights: np.ndarray
    base: float


def fold(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS


def _words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes and the text of each (a word once or more)."""
    data = [(x or "").lower().encode() for x in texts]
    h, start, _ = ro.words(b" ".join(data), _BREAKS)
    return h, np.searchsorted(np.cumsum([len(d) + 1 for d in data]), start, "right")


def _logit(texts: list[str | None], model: Model) -> np.ndarray:
    h, at = _words(texts)
    if not len(model.words) or not len(h):
        return np.full(len(texts), model.base)
    i = np.searchsorted(model.words, h)
    i[i == len(model.words)] = 0
    known = model.words[i] == h
    once = np.unique(at[known].astype(np.int64) * len(model.words) + i[known])
    return model.base + np.bincount(once // len(model.words), model.weights[once % len(model.words)], len(texts))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


def fit_words(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> Model:
    """Model from the distinct word hashes of each text."""
    none = Model(np.zeros(0, U), np.zeros(0), -50.0)
    if not positive or not unlabelled or prior <= 0:
        return none
    n_p, n_u = len(positive), len(unlabelled)
    (has_p, times_p), (has_u, times_u) = (np.unique(np.concatenate(x), return_counts=True) for x in (positive, unlabelled))
    vocab = np.union1d(has_p, has_u)
    in_p, in_u = np.zeros(len(vocab), np.int32), np.zeros(len(vocab), np.int32)
    in_p[np.searchsorted(vocab, has_p)] = times_p
    in_u[np.searchsorted(vocab, has_u)] = times_u
    share = (in_p + in_u + 1) / (n_p + n_u + 2)
    z = (in_p / n_p - in_u / n_u) / np.sqrt(share * (1 - share) * (1 / n_p + 1 / n_u))
    keep = np.flatnonzero((np.abs(z) >= LEAST_Z) & ((in_p >= LEAST_TEXTS) | (z < 0)))
    keep = np.sort(keep[np.argsort(-np.abs(z[keep]), kind="stable")[:VOCABULARY]])
    if not len(keep):
        return none
    vocab = vocab[keep]
    rows, cols = [], []
    for i, x in enumerate([*positive, *unlabelled]):
        at = np.searchsorted(vocab, x)
        at[at == len(vocab)] = 0
        known = at[vocab[at] == x]
        rows.append(np.full(len(known), i))
        cols.append(known)
    row, col = np.concatenate(rows), np.concatenate(cols)
    w, b = np.zeros(len(keep)), np.log(prior / (1 - prior)) if prior < 1 else 0.0
    moments = np.zeros((2, len(keep) + 1))
    is_p = np.arange(n_p + n_u) < n_p
    for step in range(1, STEPS + 1):
        g = b + np.bincount(row, w[col], n_p + n_u)
        s = _sigmoid(g)
        # logistic loss: d l(g) = s - 1, d l(-g) = s
        negative = np.logaddexp(0, g)
        corrected = negative[~is_p].mean() - prior * negative[is_p].mean()
        part = np.where(is_p, -prior / n_p, 1 / n_u) * s
        if corrected >= 0:
            slope = part + np.where(is_p, prior / n_p * (s - 1), 0)
        else:
            slope = -part
        grad = np.append(np.bincount(col, slope[row], len(w)) + DECAY * w, slope.sum())
        moments[0] = 0.9 * moments[0] + 0.1 * grad
        moments[1] = 0.999 * moments[1] + 0.001 * grad ** 2
        move = RATE * (moments[0] / (1 - 0.9 ** step)) / (np.sqrt(moments[1] / (1 - 0.999 ** step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    g = np.bincount(row, w[col], n_p + n_u)
    return Model(vocab, w, -_threshold(g[is_p], g[~is_p]))


def _threshold(p: np.ndarray, u: np.ndarray) -> float:
    """Where to cut: recall on toxic texts squared over the share of unlabelled texts above the cut is largest.

    That ratio follows the square of F1 up to a factor, and needs no clean
    examples.  The cut lies midway between neighbouring values.
    """
    cuts = np.unique(np.concatenate((p, u)))
    mid = np.concatenate(([cuts[0] - 1.0], (cuts[1:] + cuts[:-1]) / 2))
    recall = 1 - np.searchsorted(np.sort(p), mid) / len(p)
    above = 1 - np.searchsorted(np.sort(u), mid) / len(u)
    return float(mid[np.argmax(recall ** 2 / np.maximum(above, 1 / len(u)))])


def fit(docs: DataFrame, labels: DataFrame, *, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """Model from ``docs`` (``doc_id, text``) and ``labels`` (``doc_id, toxic``) of the training folds."""
    train = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(fold() != 0).where("toxic is not null")
    prior = train.agg(F.avg("toxic")).first()[0] or 0.0
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    confirmed = train.where("toxic = 1").select("doc_id").distinct().orderBy(*by_hash).limit(positives)
    others = docs.select("doc_id").where(fold() != 0).distinct().orderBy(*by_hash).limit(unlabelled)
    ids = [(r.doc_id, 1, 0) for r in confirmed.collect()] + [(r.doc_id, 0, 1) for r in others.collect()]
    if not ids:
        return Model(np.zeros(0, U), np.zeros(0), -50.0)
    kind = dict(docs.dtypes)["doc_id"]
    chosen = docs.sparkSession.createDataFrame(ids, f"doc_id {kind}, p int, u int").groupBy("doc_id").agg(
        F.max("p").alias("p"), F.max("u").alias("u"))
    # at most ``positives + unlabelled`` ids
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")

    def words(batches):
        for b in text_slices(batches, 0):
            h, at = _words(b.column(0).to_pylist())
            cut = np.searchsorted(at, np.arange(b.num_rows + 1))
            found = [np.unique(h[i:j]).tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), b.column(1), b.column(2), b.column(3)],
                                             names=["words", "p", "u", "doc_id"])

    got = rows.select("text", "p", "u", "doc_id").mapInArrow(words, f"words binary, p int, u int, doc_id {kind}").toArrow()
    got = got.sort_by([("doc_id", "ascending")])
    texts = [np.frombuffer(x, U) for x in got["words"].to_pylist()]
    is_p, is_u = got["p"].to_pylist(), got["u"].to_pylist()
    return fit_words([t for t, y in zip(texts, is_p, strict=True) if y], [t for t, y in zip(texts, is_u, strict=True) if y],
                     prior)


def score(docs: DataFrame, model: Model, *, carry: list[str] | None = None) -> DataFrame:
    """``doc_id, text`` -> ``doc_id, carry..., score`` (0 to 1)."""
    carry = carry or []
    names = ["doc_id", *carry]
    at = names.index("text") if "text" in names else len(names)  # a carried text isn't sent twice
    rows = docs.withColumn("text", F.col("text").cast("string")).select(*names, *["text"][:at == len(names)])
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def apply(batches):
        for b in text_slices(batches, at):
            s = _sigmoid(_logit(b.column(at).to_pylist(), model))
            yield pa.RecordBatch.from_arrays([*b.columns[:len(names)], pa.array(s, pa.float64())], names=[*names, "score"])

    return rows.mapInArrow(apply, ", ".join([f"doc_id {kinds['doc_id']}", *[f"`{c}` {kinds[c]}" for c in carry], "score double"]))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns."""
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "score",
                         F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))

"""Quality rules: measures of a text, and a calibrated classifier learnt from quality labels (numpy).

Measures are counted over whole texts in Arrow batches: words, their code
points, symbols, repeated lines, and words in 8-word windows that occur twice.
Two fixed rules on them fail a text outright.

The classifier is a logistic regression on hashed word 1- and 2-grams and byte
3- and 4-grams (shares of each kind in the text, ``BUCKETS`` weights a kind).
It learns from at most ``PER_CLASS`` labelled texts of each class (smallest
hashes of their ids; classes weigh the same), and its logit is turned into a
probability by Platt's method on labelled texts it has not seen, weighed back
to the classes' true counts.  Folds by crc32 of the id: fold 0 is never used,
fold 1 calibrates, the others train.  A text is kept if no rule fails and its
probability of being good reaches ``KEEP_AT``.

Windows and lines are compared by 64-bit hashes within one text.

Defined results: a null or empty text has no words and fails; repeated rows
score alike; labels of null ids, of other values than 0 and 1, or of ids
without a document are left out; an id labelled both ways counts as poor, an
id on several rows teaches its least text; without labels of both classes every
probability is 1 and only the rules decide.
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
PER_CLASS = 1_000
BUCKETS = 1 << 14
KEEP_AT = 0.5
MIN_WORDS, MAX_REPEAT_SHARE = 20, 30
WINDOW = 8
STEPS, RATE, DECAY = 100, 0.05, 1e-3
_KINDS = 4
_PIECE = 1 << 20

_NEWLINE = np.zeros(256, bool)
_NEWLINE[10] = True
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(b"#*$%&|<>")] = True

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class Model:
    weights: np.ndarray | None  # one per bucket of each kind, the kinds one after the other
    base: float = 0.0
    slope: float = 1.0  # of the calibration
    shift: float = 0.0


def fold(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS


class _Batch:
    """Texts one after the other, with their words."""

    def __init__(self, texts: list[str | None]) -> None:
        data = [(x or "").encode("utf-8", "surrogatepass") for x in texts]
        self.n = len(data)
        self.buf = b"\n".join(data)
        self.arr = np.frombuffer(self.buf, np.uint8)
        size = np.fromiter(map(len, data), np.int64, self.n)
        self.end = np.cumsum(size + 1) - 1
        self.start = self.end - size
        self.words, first, _ = ro.words(self.buf)
        self.doc = np.searchsorted(self.end, first, "right").astype(np.int32)
        self.n_words = np.bincount(self.doc, minlength=self.n)

    def per_text(self, mask: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
        return total[self.end] - total[self.start]

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each ``k`` words in a row of one text, and its first word."""
        h = ro.FIRST.windows(ro.FIRST.prefix(self.words), k)
        at = np.flatnonzero(self.doc[k - 1:] == self.doc[:len(h)]) if len(h) else np.zeros(0, np.int64)
        return h[at], at

    def _repeated(self, hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each hash is in its text twice or more, and whether it is a later one."""
        key = ro.mix(hashes ^ ro.mix(doc.astype(U) + U(1)))
        o = np.argsort(key, kind="stable")
        first, last = ro.runs(key[o])
        twice, later = np.zeros(len(key), bool), np.ones(len(key), bool)
        twice[o] = np.repeat(last > first, last - first + 1)
        later[o[first]] = False
        return twice, later

    def measures(self) -> list[np.ndarray]:
        space = _IS_SPACE[self.arr]
        chars = self.per_text(~space & ((self.arr & 0xC0) != 0x80))
        symbols = self.per_text(_IS_SYMBOL[self.arr])
        line, a, b = ro.words(self.buf, _NEWLINE)
        full = np.concatenate(([0], np.cumsum(~space, dtype=np.int64)))
        has_word = full[b] > full[a]
        line, doc = line[has_word], np.searchsorted(self.end, a[has_word], "right")
        dup_lines = np.bincount(doc[self._repeated(line, doc)[1]], minlength=self.n)
        h, at = self.windows(WINDOW)
        at = at[self._repeated(h, self.doc[at])[0]]
        cover = np.zeros(len(self.words) + 1, np.int64)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + WINDOW, -1)
        repeat = np.bincount(self.doc[np.cumsum(cover[:-1]) > 0], minlength=self.n)
        return [self.n_words, chars, symbols, dup_lines, repeat]

    def grams(self):
        """Kind, text and bucket of every n-gram, in pieces of bounded size."""
        for i in range(0, len(self.words), _PIECE):
            yield 0, self.doc[i:i + _PIECE], _bucket(self.words[i:i + _PIECE])
        h, at = self.windows(2)
        for i in range(0, len(h), _PIECE):
            yield 1, self.doc[at[i:i + _PIECE]], _bucket(h[i:i + _PIECE])
        for kind, k in ((2, 3), (3, 4)):
            for i in range(0, len(self.arr) - k + 1, _PIECE):
                part = self.arr[i:i + _PIECE + k - 1].astype(U)
                m = len(part) - k + 1
                x = np.zeros(m, U)
                for j in range(k):
                    x = (x << U(8)) | part[j:j + m]
                at = np.arange(i, i + m)
                doc = np.searchsorted(self.end, at, "right")
                doc[doc == self.n] = 0
                inside = (at >= self.start[doc]) & (at + k <= self.end[doc])
                yield kind, doc[inside], _bucket(ro.mix(x[inside]))


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h & U(BUCKETS - 1)).astype(np.int32)


def _logits(batch: _Batch, model: Model) -> np.ndarray:
    out = np.full(batch.n, model.base)
    total, count = np.zeros((_KINDS, batch.n)), np.zeros((_KINDS, batch.n))
    for kind, doc, bucket in batch.grams():
        # bincount adds a text's grams in their order, whatever its neighbours in the batch
        total[kind] += np.bincount(doc, model.weights[kind * BUCKETS + bucket], batch.n)
        count[kind] += np.bincount(doc, minlength=batch.n)
    for kind in range(_KINDS):
        out += total[kind] / np.maximum(count[kind], 1)
    return out


def _vectors(batch: _Batch) -> list[tuple[np.ndarray, np.ndarray]]:
    """Buckets in use and their shares, for each text."""
    parts = [[] for _ in range(batch.n)]
    counts = np.zeros((_KINDS, batch.n))
    for kind, doc, bucket in batch.grams():
        key, n = np.unique(doc.astype(np.int64) * BUCKETS + bucket, return_counts=True)
        counts[kind] += np.bincount(doc, minlength=batch.n)
        cut = np.searchsorted(key, np.arange(batch.n + 1) * BUCKETS)
        for d in np.flatnonzero(cut[1:] > cut[:-1]):
            s = slice(cut[d], cut[d + 1])
            parts[d].append((kind, key[s] % BUCKETS, n[s]))
    out = []
    for d, found in enumerate(parts):
        dense = {}
        for kind, b, n in found:  # a long text comes in several pieces
            at = dense.setdefault(kind, np.zeros(BUCKETS))
            at[b] += n
        ids = [kind * BUCKETS + np.flatnonzero(x) for kind, x in dense.items()]
        share = [x[x > 0] / counts[kind, d] for kind, x in dense.items()]
        out.append((np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32),
                    np.concatenate(share).astype(np.float32) if share else np.zeros(0, np.float32)))
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


def _platt(logit: np.ndarray, good: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift that make ``sigmoid(slope * logit + shift)`` a probability, by Newton's method on smoothed targets."""
    n_good, n_poor = good.sum(), (~good).sum()
    if not n_good or not n_poor:
        return 1.0, 0.0
    target = np.where(good, (n_good + 1) / (n_good + 2), 1 / (n_poor + 2))
    unit = max(float(logit.std()), 1e-9)
    x = logit / unit

    def loss(a, b):
        g = a * x + b
        return (weight * (np.logaddexp(0, g) - target * g)).sum()

    a = b = 0.0
    for _ in range(100):
        p = _sigmoid(a * x + b)
        r, h = weight * (p - target), weight * p * (1 - p)
        hess = np.array([[(h * x ** 2).sum(), (h * x).sum()], [(h * x).sum(), h.sum()]]) + 1e-6 * np.eye(2)
        move = np.linalg.solve(hess, np.array([(r * x).sum(), r.sum()]))
        now = loss(a, b)
        while loss(a - move[0], b - move[1]) > now and np.abs(move).max() > 1e-9:
            move /= 2
        a, b = a - move[0], b - move[1]
        if np.abs(move).max() < 1e-9:
            break
    return (float(a / unit), float(b)) if a > 0 else (1.0, 0.0)


def fit_vectors(vectors: list[tuple[np.ndarray, np.ndarray]], good: np.ndarray, calibrate: np.ndarray,
                counts: tuple[int, int]) -> Model:
    """Model from sparse texts, their labels, which of them calibrate, and the labels' true counts (poor, good)."""
    train = ~calibrate
    if not (good & train).any() or not (~good & train).any():
        return Model(None)
    row = np.repeat(np.arange(len(vectors)), [len(v[0]) for v in vectors])
    col = np.concatenate([v[0] for v in vectors])
    val = np.concatenate([v[1] for v in vectors]).astype(np.float64)
    size, n = _KINDS * BUCKETS, len(vectors)
    in_train = train[row]
    scale = np.sqrt(np.bincount(col[in_train], val[in_train] ** 2, size) / train.sum())
    val = val / np.where(scale > 0, scale, np.inf)[col]  # buckets not seen in training weigh nothing
    t_row, t_col, t_val = row[in_train], col[in_train], val[in_train]
    weight = np.where(train, np.where(good, 0.5 / (good & train).sum(), 0.5 / (~good & train).sum()), 0)
    w, b = np.zeros(size), 0.0
    moments = np.zeros((2, size + 1))
    for step in range(1, STEPS + 1):
        slope = weight * (_sigmoid(b + np.bincount(t_row, t_val * w[t_col], n)) - good)
        grad = np.append(np.bincount(t_col, t_val * slope[t_row], size) + DECAY * w, slope.sum())
        moments[0] = 0.9 * moments[0] + 0.1 * grad
        moments[1] = 0.999 * moments[1] + 0.001 * grad ** 2
        move = RATE * (moments[0] / (1 - 0.9 ** step)) / (np.sqrt(moments[1] / (1 - 0.999 ** step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    logit = b + np.bincount(row, val * w[col], n)
    sampled = (max(1, (~good).sum()), max(1, good.sum()))
    back = np.where(good, counts[1] / sampled[1], counts[0] / sampled[0])
    slope, shift = _platt(logit[calibrate], good[calibrate], (back / back.mean())[calibrate])
    return Model(w / np.where(scale > 0, scale, np.inf), float(b), slope, shift)


def labelled(labels: DataFrame) -> DataFrame:
    """``doc_id, good`` of the usable labels, one row an id."""
    rows = labels.select("doc_id", F.col("quality").cast("int").alias("good"))
    return rows.where("doc_id is not null and good in (0, 1)").groupBy("doc_id").agg(F.min("good").alias("good"))


def fit(docs: DataFrame, labels: DataFrame, *, per_class: int = PER_CLASS) -> Model:
    """Model from ``docs`` (``doc_id, text``) and ``labels`` (``doc_id, quality``); at most ``2 * per_class`` texts are read."""
    train = labelled(labels).where(fold() != 0).join(docs.select("doc_id"), "doc_id", "left_semi")
    counts = {r.good: r.n for r in train.groupBy("good").agg(F.count("*").alias("n")).collect()}  # two rows
    if len(counts) < 2:
        return Model(None)
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    ids = [tuple(r) for c in (0, 1) for r in train.where(F.col("good") == c).select("doc_id", "good").orderBy(*by_hash).limit(per_class).collect()]
    kind = dict(docs.dtypes)["doc_id"]
    chosen = docs.sparkSession.createDataFrame(ids, f"doc_id {kind}, good int")  # at most ``2 * per_class`` rows
    rows = (docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
            .repartition(32, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("good").alias("good")))

    def vectors(batches):
        for b in text_slices(batches, 0):
            found = _vectors(_Batch(b.column(0).to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [b.column(1), b.column(2), b.column(3), pa.array([x.tobytes() for x, _ in found], pa.binary()),
                 pa.array([x.tobytes() for _, x in found], pa.binary())], names=["doc_id", "good", "fold", "ids", "shares"])

    got = rows.select("text", "doc_id", "good", fold().cast("int").alias("fold")).mapInArrow(
        vectors, f"doc_id {kind}, good int, fold int, ids binary, shares binary").toArrow().sort_by([("doc_id", "ascending")])
    texts = [(np.frombuffer(i, np.int32), np.frombuffer(s, np.float32))
             for i, s in zip(got["ids"].to_pylist(), got["shares"].to_pylist(), strict=True)]
    good = got["good"].to_numpy() == 1
    return fit_vectors(texts, good, got["fold"].to_numpy() == 1, (counts[0], counts[1]))


def judge(docs: DataFrame, model: Model, *, carry: list[str] | None = None) -> DataFrame:
    """``doc_id, text`` -> ``doc_id, carry...``, the measures, ``base_failed, score, kept``."""
    carry = carry or []
    names = ["doc_id", *carry]
    at = names.index("text") if "text" in names else len(names)  # a carried text isn't sent twice
    rows = docs.withColumn("text", F.col("text").cast("string")).select(*names, *["text"][:at == len(names)])
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def apply(batches):
        for b in text_slices(batches, at):
            batch = _Batch(b.column(at).to_pylist())
            found = batch.measures()
            n_words, repeat = found[0], found[4]
            failed = (n_words < MIN_WORDS) | (100 * repeat > MAX_REPEAT_SHARE * n_words)
            score = np.ones(batch.n) if model.weights is None else _sigmoid(model.slope * _logits(batch, model) + model.shift)
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:len(names)], *[pa.array(x, pa.int64()) for x in found], pa.array(failed), pa.array(score, pa.float64()),
                 pa.array(~failed & (score >= KEEP_AT))], names=[*names, *MEASURES, "base_failed", "score", "kept"])

    schema = [f"doc_id {kinds['doc_id']}", *[f"`{c}` {kinds[c]}" for c in carry], *[f"{m} bigint" for m in MEASURES]]
    return rows.mapInArrow(apply, ", ".join([*schema, "base_failed boolean, score double, kept boolean"]))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns, and the probability."""
    return judge(docs, fit(docs, labels)).select("doc_id", *MEASURES, "base_failed", "kept", "score")

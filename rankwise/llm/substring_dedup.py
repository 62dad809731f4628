"""Substring dedup by fixed-block anchors.

A passage of ``window`` words that an earlier document also has is removed.
Reference blocks are the non-overlapping blocks of ``window // 2`` words of
every document; any repeat of ``window`` words covers one of them whole.
Every rolling window of a block's length probes the index, and hits are
extended, window by window, to maximal exact repeats of at least ``window``
words, held against the smallest ``doc_id`` that has the same words.

Texts stay in their chunk; what moves are packed hashes (``exchange``):

1. winnowed 12-word grams tell which stretches occur in two places at all (each
   window of ``window`` words keeps its least gram, so none is lost);
2. in those stretches blocks are indexed and probed;
3. windows that hold a hit are compared by 96-bit hashes, and the bucket
   says which of them an earlier document has.

Defined results: a null or empty text has no words and loses none; a null
``doc_id`` counts as later than every other, and such rows lose nothing to
each other; rows of equal ``doc_id`` lose nothing to each other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankwise.llm import exchange as ex
from rankwise.llm import rolling as ro

U = np.uint64
GRAM = 12
WINDOW = 50
_LAST = np.iinfo(np.int64).max
#: Words that are hashed and compared at once.
_SPAN = 1 << 20


class _Chunk:
    """Words of a chunk's documents, one after the other, documents by row."""

    def __init__(self, t: pa.Table, window: int) -> None:
        texts = t["text"].to_pylist()
        self.window, self.data = window, [(x or "").encode() for x in texts]
        ids = t["doc_id"].to_pylist()
        self.ids = np.array([_LAST if i is None else i for i in ids], np.int64)
        buf = b"\n".join(self.data)
        self.words, self.start, self.end = ro.words(buf)
        offsets = np.cumsum([0] + [len(d) + 1 for d in self.data])
        self.first = np.searchsorted(self.start, offsets)  # first word of each document, and the end
        self.buf = buf
        n = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(n)), n)
        self.left = np.repeat(self.first[1:], n) - np.arange(len(self.words))  # words to the document's end

    def pieces(self, overlap: int):
        """Stretches of words that overlap by ``overlap``."""
        n, at = len(self.words), 0
        while at < n:
            end = min(n, at + _SPAN)
            yield at, end
            if end == n:
                break
            at = end - overlap

    def hashes(self, k: int, second: bool = False) -> np.ndarray:
        """Hash of the ``k`` words from each word on (those that leave the document have no meaning)."""
        poly = ro.SECOND if second else ro.FIRST
        out = np.zeros(len(self.words), U)
        for a, b in self.pieces(k - 1):
            h = poly.windows(poly.prefix(self.words[a:b]), k)
            out[a:a + len(h)] = h
        return out

    def anchors(self) -> np.ndarray:
        """For each window start the gram that stands for the window (-1: no whole window there)."""
        w, grams = self.window, self.hashes(GRAM)
        out = np.full(len(self.words), -1, np.int64)
        for a, b in self.pieces(w - 1):
            if b - a >= w:
                m = ro.sliding_argmin(grams[a:b - GRAM + 1], w - GRAM + 1)
                out[a:a + len(m)] = m + a
        out[self.left < w] = -1
        self.grams = ro.mix(grams)  # least grams are small numbers; mixed again they spread over the buckets
        return out


def _unique_flagged(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes, sorted, and whether each is in two documents of the chunk."""
    o = np.argsort(h, kind="stable")
    h, doc = h[o], doc[o]
    first, last = ro.runs(h)
    if not len(first):
        return h, np.zeros(0, np.uint8)
    return h[first], (np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)).astype(np.uint8)


def _send48(key: int, h48: np.ndarray, flag: np.ndarray, buckets: int) -> list[tuple]:
    b, e = ex.bucket_edges(h48, buckets, 48)
    return [(int(x), key, ex.pack48(h48[i:j]), flag[i:j].tobytes(), None)
            for x, i, j in zip(b, e[:-1], e[1:], strict=True)]


def _stretches(c: _Chunk, anchors: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """Window starts whose gram is shared."""
    ok = anchors >= 0
    ok[ok] = ex.member(c.grams[anchors[ok]] >> U(16), shared)
    return ok


def _covered(starts: np.ndarray, length: int) -> np.ndarray:
    """Mask of the positions that a span of ``length`` from some start covers."""
    n = len(starts)
    d = np.zeros(n + length + 1, np.int32)
    at = np.flatnonzero(starts)
    d[at] += 1
    d[at + length] -= 1
    return np.cumsum(d[:n]) > 0


def _grams_step(window: int, buckets: int):
    def step(key, t):
        c = _Chunk(t, window)
        a = c.anchors()
        at = np.unique(a[a >= 0])
        h, flag = _unique_flagged(c.grams[at] >> U(16), c.ids[c.doc[at]])
        return ex.sent(_send48(key[0].as_py(), h, flag, buckets))
    return step


def _block_bucket(t: pa.Table) -> pa.Table:
    """Bucket step: probes (``a``, with flags ``b``: 1 in two documents, 2 an indexed block) that hit a block
    of the index and stand in two documents."""
    rows = list(ex.received(t))
    parts = [ex.unpack48(r[1]) for r in rows]
    h, flag, own = np.concatenate(parts), np.frombuffer(b"".join(r[2] for r in rows), np.uint8), ex.owners(parts)
    o = np.argsort(h, kind="stable")
    h, flag, own = h[o], flag[o], own[o]
    first, last = ro.runs(h)
    n = last - first + 1
    f = np.bitwise_or.reduceat(flag, first) if len(first) else flag
    hit = np.repeat(((f & 2) > 0) & ((n > 1) | ((f & 1) > 0)), n)
    return ex.replied([(rows[k][0], 2, ex.pack48(x), None, None) for k, x in ex.by_owner(own[hit], h[hit])])


def _blocks_step(window: int, buckets: int):
    block = window // 2

    def step(key, t, got):
        c = _Chunk(t, window)
        shared = np.sort(ex.unpack48(ex.replies(got, 1)[0]))
        if not len(shared):
            return ex.sent([])
        inside = _covered(_stretches(c, c.anchors(), shared), window - block + 1)  # block starts within such windows
        at = np.flatnonzero(inside & (c.left >= block))
        h = c.hashes(block)[at] >> U(16)
        indexed = (at - c.first[c.doc[at]]) % block == 0
        own = np.sort(h[indexed])
        h, flag = _unique_flagged(h, c.ids[c.doc[at]])
        flag |= ex.member(h, own).astype(np.uint8) << 1
        return ex.sent(_send48(key[0].as_py(), h, flag, buckets))
    return step


def _candidates(c: _Chunk, got: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, and the two hashes, of windows in shared stretches that hold a block hit."""
    block = c.window // 2
    hits = np.sort(ex.unpack48(ex.replies(got, 2)[0]))
    none = np.zeros(0, np.int64)
    if not len(hits):
        return none, none.astype(U), none.astype(U)
    shared = np.sort(ex.unpack48(ex.replies(got, 1)[0]))
    starts = _stretches(c, c.anchors(), shared)
    hit = ex.member(c.hashes(block) >> U(16), hits) & (c.left >= block)
    # a hit at p is held by the windows that start in [p - (window - block), p]
    held = _covered(hit[::-1], c.window - block + 1)[::-1]
    at = np.flatnonzero(starts & held)
    return at, c.hashes(c.window)[at], c.hashes(c.window, True)[at] >> U(32)


def _earliest(h: np.ndarray, g: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order, run starts, run of each, and the least document of each run of equal ``(h, g)``."""
    o = np.lexsort((g, h))
    hs, gs = h[o], g[o]
    new = np.concatenate(([True], (hs[1:] != hs[:-1]) | (gs[1:] != gs[:-1]))) if len(h) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    run = np.cumsum(new) - 1
    least = np.minimum.reduceat(doc[o], first) if len(first) else doc[o]
    return o, first, run, least


def _windows_step(window: int, buckets: int):
    def step(key, t, got):
        c = _Chunk(t, window)
        at, h, g = _candidates(c, got)
        doc = c.ids[c.doc[at]]
        o, first, _, least = _earliest(h, g, doc)
        h, g = h[o][first], g[o][first].astype(np.uint32)
        b, e = ex.bucket_edges(h, buckets)
        rows = []
        for x, i, j in zip(b, e[:-1], e[1:], strict=True):
            s = np.argsort(least[i:j], kind="stable")  # by document, so that ids repeat
            rows.append((int(x), key[0].as_py(), h[i:j][s].tobytes(), g[i:j][s].tobytes(), least[i:j][s].tobytes()))
        return ex.sent(rows)
    return step


def _window_bucket(t: pa.Table) -> pa.Table:
    """Bucket step: windows (kind 3) for which another chunk has an earlier document."""
    rows = list(ex.received(t))
    parts = [ex.u64(r[1]) for r in rows]
    h, own = np.concatenate(parts), ex.owners(parts)
    g = np.frombuffer(b"".join(r[2] for r in rows), "<u4").astype(U)
    doc = np.frombuffer(b"".join(r[3] for r in rows), "<i8")
    o, _, run, least = _earliest(h, g, doc)
    late = doc[o] > least[run]
    h, g, own = h[o][late], g[o][late].astype(np.uint32), own[o][late]
    return ex.replied([(rows[k][0], 3, x.tobytes(), y.tobytes(), None) for k, x, y in ex.by_owner(own, h, g)])


def _rest(c: _Chunk, doc: int, removed: np.ndarray, spaces: bool) -> bytes:
    """What is left of a document: words joined by one space, or with the white space that followed each of them."""
    i, j = c.first[doc], c.first[doc + 1]
    start, end = c.start[i:j][~removed], c.end[i:j][~removed]
    if not spaces:
        return b" ".join([c.buf[x:y] for x, y in zip(start.tolist(), end.tolist(), strict=True)])
    follows = np.append(c.start[i + 1:j], c.end[j - 1])[~removed]
    return b"".join([c.buf[x:y] for x, y in zip(start.tolist(), follows.tolist(), strict=True)])


def _result_step(window: int, carry: list[str], spaces: bool):
    def step(key, t, got):
        c = _Chunk(t, window)
        at, h, g = _candidates(c, got)
        doc = c.ids[c.doc[at]]
        a, b, _ = ex.replies(got, 3)
        o, _, run, least = _earliest(h, g, doc)
        gone = np.zeros(len(at), bool)
        gone[o] = doc[o] > least[run]
        lh, lg = ex.u64(a), np.frombuffer(b, "<u4").astype(U)
        late = np.sort(ro.mix(lh) ^ (lg * U(0x9E3779B97F4A7C15)))
        gone |= ex.member(ro.mix(h) ^ (g * U(0x9E3779B97F4A7C15)), late)
        mask = np.zeros(len(c.words), bool)
        mask[at[gone]] = True
        removed = _covered(mask, window)
        n, lost, kept, spans = [], [], [], []
        for d in range(len(c.data)):
            i, j = c.first[d], c.first[d + 1]
            r = removed[i:j]
            n.append(int(j - i))
            lost.append(int(r.sum()))
            if not r.any():
                kept.append((c.data[d] if spaces else b" ".join(c.data[d].split())).decode())
                spans.append([])
            else:
                kept.append(_rest(c, d, r, spaces).decode())
                s, e = ro.runs(r)
                spans.append([{"start": int(x), "end": int(y) + 1} for x, y in zip(s, e, strict=True) if r[x]])
        out = {"doc_id": t["doc_id"]} | {f: t[f] for f in carry}
        spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table(out | {"n_words": pa.array(n, pa.int64()), "n_removed": pa.array(lost, pa.int64()),
                               "kept": pa.array(kept, pa.string()), "removed": pa.array(spans, spans_type)})
    return step


def dedup(docs: DataFrame, *, window: int = WINDOW, carry: list[str] | None = None, spaces: bool = False) -> DataFrame:
    """``doc_id, text`` (and ``carry``) -> ``doc_id, carry..., n_words, n_removed, kept, removed``.

    ``kept`` is the rest joined by single spaces, or with its own white space
    (``spaces``; then a text that loses nothing is unchanged); ``removed`` the
    maximal removed runs as word positions.
    """
    if window < 2 * GRAM:
        raise ValueError(f"window must be at least {2 * GRAM} words")
    carry = carry or []
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), *carry)
    rows, chunks = ex.chunked(rows)
    rows = rows.drop("uid")
    buckets = ex.bucket_count(chunks)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    one = rows.groupBy("chunk").applyInArrow(_grams_step(window, buckets), ex.SENT).groupBy("bucket").applyInArrow(
        ex.shared48, ex.REPLY)
    two = rows.groupBy("chunk").cogroup(one.groupBy("chunk")).applyInArrow(_blocks_step(window, buckets), ex.SENT)
    two = two.groupBy("bucket").applyInArrow(_block_bucket, ex.REPLY).union(one)
    three = rows.groupBy("chunk").cogroup(two.groupBy("chunk")).applyInArrow(_windows_step(window, buckets), ex.SENT)
    three = three.groupBy("bucket").applyInArrow(_window_bucket, ex.REPLY).union(two)
    schema = ", ".join(["doc_id bigint", *[f"`{f}` {kinds[f]}" for f in carry], "n_words bigint", "n_removed bigint",
                        "kept string", "removed array<struct<start: bigint, end: bigint>>"])
    return rows.groupBy("chunk").cogroup(three.groupBy("chunk")).applyInArrow(_result_step(window, carry, spaces), schema)


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: The same in DuckDB, window by window.
ORACLE_SQL = r"""
with d as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
           from documents),
starts as (select doc_id, w, unnest(range(1, len(w) - 48)) as i from d where len(w) >= 50),
windows as (select doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) as k from starts),
firsts as (select k, min(doc_id) as m from windows group by k),
gone as (select distinct doc_id, unnest(range(i, i + 50)) as p from windows join firsts using (k) where m < doc_id),
words as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from d),
kept as (select words.doc_id, count(gone.p) as n_removed,
                string_agg(word, ' ' order by words.p) filter (where gone.p is null) as t
         from words left join gone on gone.doc_id = words.doc_id and gone.p = words.p group by words.doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_removed, 0) as bigint) as n_removed,
       sha256(coalesce(t, '')) as kept_sha256
from d left join kept using (doc_id)
"""

"""Suffix-array dedup: every byte covered by a long string that also starts elsewhere goes.

Suffixes are sorted in buckets.  Sampled splitters cut the range of their
leading tokens into buckets, a bucket sorts its suffixes by multikey
quicksort (token by token, each time only what is still tied), and
neighbours in that order that agree in their first ``length`` bytes are
repeats.  A suffix's tokens are its first four bytes and two fingerprints
of its first ``length`` bytes.  Splitters are whole token sequences, so equal
suffixes never straddle buckets and the comparison across a boundary is
settled by the splitter; a common leading token is cut into many buckets.

Sorting every suffix would move many times the text, so two steps before it
settle most of them, both exact:

1. each string of ``length`` bytes is stood for by its least 64-byte gram
   (winnowing).  The strings with the same gram in a row form a stretch; a
   gram that is nowhere else means that none of its strings repeats;
2. if a stretch's bytes are found again as a whole, all of its strings
   repeat.  Only where stretches with the same gram differ, which is at the
   ends of repeats, do their suffixes have to be sorted.

Texts stay in their chunk; packed hashes move (``exchange``).  A chunk sends
some megabytes of suffixes, and up to 16 times its text, so a bucket of
suffixes takes few chunks, and buckets are compared part by part: what chunks
sent is in order, so that a part is a slice of each row.

Defined results: a null text is empty; strings never cross documents; equal
rows (same ``doc_id`` and text) are one document listed more than once and
get the same result; rows without ``doc_id`` are documents of their own; texts shorter than ``length`` lose nothing.  ``kept``
is bytes: a removed span may begin or end inside a character.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankwise.llm import exchange as ex
from rankwise.llm import rolling as ro

U = np.uint64
LENGTH = 400
GRAM = 64
#: Bytes hashed at once.
_SPAN = 1 << 20
#: Chunks whose stretches, and whose suffixes, one bucket takes; entries of a bucket that are compared at once.
STRETCH_CHUNKS, SUFFIX_CHUNKS = 16, 2
PART = 1 << 20
#: Bound on the suffixes that are sampled for the splitters, and on the documents they come from.
SAMPLE_SUFFIXES = 65_536
SAMPLE_DOCUMENTS = 1_024


class _Chunk:
    """The distinct documents of a chunk, their stretches, and hashes of spans (all in buffer positions)."""

    def __init__(self, t: pa.Table, length: int) -> None:
        self.length = length
        texts, ids = t["text"].to_pylist(), t["doc_id"].to_pylist()
        index: dict = {}
        self.row = [index.setdefault((i, x, k if i is None else -1), len(index)) for k, (i, x) in enumerate(zip(ids, texts, strict=True))]
        self.data = [(x or "").encode() for _, x, _ in index]
        self.buf = np.frombuffer(b"".join(self.data), np.uint8)
        self.first = np.cumsum([0] + [len(d) for d in self.data])
        found = [s for a, b in self._pieces() for s in self._stretches(a, b)]
        cols = list(zip(*found, strict=True)) if found else [[]] * 5
        self.lo, self.hi = (np.concatenate(c).astype(np.int64) if len(c) else np.zeros(0, np.int64) for c in cols[:2])
        self.gram, self.u1, self.u2 = (np.concatenate(c) if len(c) else np.zeros(0, U) for c in cols[2:])

    def _pieces(self):
        n, at = len(self.buf), 0
        while at + self.length <= n:
            end = min(n, at + _SPAN)
            yield at, end
            if end == n:
                break
            at = end - self.length + 1

    def prefixes(self, a: int, b: int):
        piece = self.buf[a:b]
        return ro.FIRST.prefix(ro.FIRST.table[piece]), ro.SECOND.prefix(ro.SECOND.table[piece])

    def _stretches(self, a: int, b: int):
        p, q = self.prefixes(a, b)
        grams = ro.FIRST.windows(p, GRAM)
        w = self.length - GRAM + 1
        if len(grams) < w:
            return
        m = ro.sliding_argmin(grams, w)
        starts = np.arange(len(m)) + a
        doc = np.searchsorted(self.first, starts, "right") - 1
        ok = starts + self.length <= self.first[doc + 1]
        first, last = ro.runs(np.where(ok, m, -1 - doc))
        keep = ok[first]
        first, last = first[keep], last[keep]
        end = last + self.length
        # least grams are small numbers; mixed again they spread over the buckets
        yield (first + a, last + a, ro.mix(grams[m[first]]), ro.FIRST.spans(p, first, end), ro.SECOND.spans(q, first, end))

    def suffixes(self, which: np.ndarray):
        """Positions and tokens of all suffixes that start in the given stretches."""
        at = np.zeros(len(self.buf) + 1, np.int32)
        np.add.at(at, self.lo[which], 1)
        np.add.at(at, self.hi[which] + 1, -1)
        inside = np.cumsum(at[:-1]) > 0
        pos, lead, h, g = [], [], [], []
        for a, b in self._pieces():
            s = np.flatnonzero(inside[a:b - self.length + 1])
            if len(s):
                p, q = self.prefixes(a, b)
                pos.append(s + a)
                lead.append(leads(self.buf, s + a))
                h.append(ro.FIRST.spans(p, s, s + self.length))
                g.append(ro.SECOND.spans(q, s, s + self.length) >> U(32))
        if not pos:
            return np.zeros(0, np.int64), *[np.zeros(0, U)] * 3
        pos, lead, h, g = map(np.concatenate, (pos, lead, h, g))
        _, once = np.unique(pos, return_index=True)
        return pos[once], lead[once], h[once], g[once]


def leads(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The first four bytes as a number that sorts like them."""
    out = np.zeros(len(at), np.uint32)
    for k in range(4):
        out = (out << np.uint32(8)) | buf[at + k]
    return out


def multikey_order(keys: list[np.ndarray]) -> np.ndarray:
    """Order by the first key; what is tied is sorted by the next key, and so on."""
    order = np.argsort(keys[0], kind="quicksort")
    group = np.zeros(len(order), np.int64)
    for prev, key in zip(keys, keys[1:], strict=False):
        v = prev[order]
        group = np.cumsum(np.concatenate(([0], ((v[1:] != v[:-1]) | (group[1:] != group[:-1])).astype(np.int64)))) if len(v) else group
        size = np.bincount(group, minlength=1)[group] if len(group) else group
        tied = np.flatnonzero(size > 1)
        if not len(tied):
            break
        part = order[tied]
        order[tied] = part[np.lexsort((key[part], group[tied]))]
    return order


def _cuts(lead: np.ndarray, h: np.ndarray, splitters: list[tuple[int, int]]) -> np.ndarray:
    """Where the sorted suffixes ``(lead, h)`` are cut by the splitters."""
    def keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Both as one string of bytes, in the order of the pair."""
        out = np.empty((len(a), 12), np.uint8)
        out[:, :4] = np.asarray(a, ">u4").reshape(-1, 1).view(np.uint8)
        out[:, 4:] = np.asarray(b, ">u8").reshape(-1, 1).view(np.uint8)
        return out.reshape(-1).view("S12")

    at = np.searchsorted(keys(lead, h), keys(*np.array(splitters, object).reshape(-1, 2).T), "left")
    return np.concatenate(([0], at, [len(lead)])).astype(np.int64)


def _stretch_step(length: int, buckets: int):
    def step(key, t):
        c = _Chunk(t, length)
        o, first, n = _classes(c.gram, c.u1, c.u2)
        at = o[first]
        b, e = ex.bucket_edges(c.gram[at], buckets)
        many = np.minimum(n, 2).astype(np.uint8)
        return ex.sent([(int(x), key[0].as_py(), c.gram[at[i:j]].tobytes(), c.u1[at[i:j]].tobytes(),
                         (c.u2[at[i:j]] >> U(32)).astype("<u4").tobytes() + many[i:j].tobytes())
                        for x, i, j in zip(b, e[:-1], e[1:], strict=True)])
    return step


def _classes(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by the keys, where each class of equal keys begins, and its size."""
    o = np.lexsort(keys[::-1])
    new = np.zeros(len(o), bool)
    new[:1] = True
    for k in keys:
        v = k[o]
        new[1:] |= v[1:] != v[:-1]
    first = np.flatnonzero(new)
    return o, first, np.diff(np.append(first, len(o)))


def _part_edges(parts: list[np.ndarray]) -> list[np.ndarray]:
    """For each of the rows' sorted keys, where parts of about ``PART`` entries in all begin and end; equal keys share a part."""
    n, every, some, at = sum(map(len, parts)), PART // 256 | 1, [], 0
    for p in parts if n > PART else []:
        some.append(p[-at % every::every])
        at += len(p)
    some = np.sort(np.concatenate(some)) if some else np.zeros(0, U)
    count = max(1, min(-(-n // PART), len(some)))
    bounds = np.unique(some[[len(some) * i // count for i in range(1, count)]])
    return [np.concatenate(([0], np.searchsorted(p, bounds, "left"), [len(p)])) for p in parts]


def _stretch_bucket(t: pa.Table) -> pa.Table:
    """Replies (kind 1) stretches whose gram is elsewhere too: ``c`` is 1 if the whole stretch repeats, plus 2 if
    its suffixes have to be sorted (for a stretch that repeats whole, one chunk does that)."""
    chunk = t["chunk"].to_pylist()
    grams, firsts = ([x.view("<u8") for x in ex.payloads(t, f)] for f in "ab")
    rest = ex.payloads(t, "c")
    seconds = [x[:4 * len(p)].view("<u4") for x, p in zip(rest, grams, strict=True)]
    flags = [x[4 * len(p):] for x, p in zip(rest, grams, strict=True)]
    edges, out = _part_edges(grams), []
    for k in range(len(edges[0]) - 1):
        gram, u1, u2, many = (np.concatenate([x[e[k]:e[k + 1]] for x, e in zip(xs, edges, strict=True)]) for xs in (grams, firsts, seconds, flags))
        own = np.repeat(np.arange(len(edges)), [e[k + 1] - e[k] for e in edges])
        o, first, n = _classes(gram, u1, u2)
        cls = np.repeat(np.arange(len(first)), n)
        places = np.add.reduceat(many[o].astype(np.int64), first) if len(first) else first
        g = gram[o][first]
        gfirst, glast = ro.runs(g)
        mixed = np.repeat(glast - gfirst > 0, glast - gfirst + 1)  # the gram's stretches differ
        code = np.where(places > 1, 1, 0)[cls]
        leader = np.zeros(len(o), bool)
        leader[first] = True
        code = code + np.where(mixed[cls] & leader, 2, 0)
        hit = code > 0
        at = o[hit]
        out += [(chunk[i], 1, a.tobytes(), b.tobytes(), x.tobytes() + y.tobytes())
                for i, a, b, x, y in ex.by_owner(own[at], gram[at], u1[at], u2[at], code[hit].astype(np.uint8))]
    return ex.replied(out)


def _settled(c: _Chunk, got: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """For each stretch of the chunk: does it repeat whole; are its suffixes to be sorted."""
    repeats = np.zeros(len(c.lo), bool)
    sort = np.zeros(len(c.lo), bool)
    rows = [(a, b, x) for k, a, b, x in zip(got["kind"].to_pylist(), got["a"].to_pylist(), got["b"].to_pylist(),
                                            got["c"].to_pylist(), strict=True) if k == 1]
    if not rows or not len(c.lo):
        return repeats, sort
    gram = np.concatenate([ex.u64(r[0]) for r in rows])
    u1 = np.concatenate([ex.u64(r[1]) for r in rows])
    code = np.concatenate([np.frombuffer(r[2], np.uint8, len(r[0]) // 8, len(r[0]) // 2) for r in rows])
    key = ro.mix(gram) ^ u1
    o = np.argsort(key)
    mine = ro.mix(c.gram) ^ c.u1
    at = np.searchsorted(key[o], mine)
    at[at == len(o)] = 0
    ok = key[o][at] == mine
    codes = np.where(ok, code[o][at], 0)
    return (codes & 1) > 0, (codes & 2) > 0


def _suffix_step(length: int, splitters: list[tuple[int, int]]):
    def step(key, t, got):
        c = _Chunk(t, length)
        _, sort = _settled(c, got)
        _, lead, h, g = c.suffixes(sort)
        o, first, n = _classes(lead, h, g)
        at = o[first]
        lead, h, g, many = lead[at].astype("<u4"), h[at], g[at].astype("<u4"), n > 1
        cut = _cuts(lead, h, splitters)
        return ex.sent([(x, key[0].as_py(), lead[i:j].tobytes(), h[i:j].tobytes(), g[i:j].tobytes() + np.packbits(many[i:j]).tobytes())
                        for x, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if j > i])
    return step


def _suffix_bucket(t: pa.Table) -> pa.Table:
    """Sorts a bucket's suffixes and replies (kind 2) those that agree with a neighbour."""
    chunk = t["chunk"].to_pylist()
    leading, firsts = ([x.view(f"<u{n}") for x in ex.payloads(t, f)] for f, n in (("a", 4), ("b", 8)))
    rest = ex.payloads(t, "c")
    seconds = [x[:4 * len(p)].view("<u4") for x, p in zip(rest, firsts, strict=True)]
    flags = [x[4 * len(p):] for x, p in zip(rest, firsts, strict=True)]
    # a part's bounds are leads and the upper half of a fingerprint, by which the rows are in order
    edges, out = _part_edges([(a.astype(U) << U(32)) | (b >> U(32)) for a, b in zip(leading, firsts, strict=True)]), []
    for k in range(len(edges[0]) - 1):
        lead, h, g = (np.concatenate([x[e[k]:e[k + 1]] for x, e in zip(xs, edges, strict=True)]) for xs in (leading, firsts, seconds))
        many = np.concatenate([np.unpackbits(x[e[k] // 8:-(-e[k + 1] // 8)])[e[k] % 8:][:e[k + 1] - e[k]] for x, e in zip(flags, edges, strict=True)])
        own = np.repeat(np.arange(len(edges)), [e[k + 1] - e[k] for e in edges])
        o = multikey_order([lead, h, g.astype(U)])
        lead, h, g, many, own = lead[o], h[o], g[o], many[o], own[o]
        same = (lead[1:] == lead[:-1]) & (h[1:] == h[:-1]) & (g[1:] == g[:-1])
        hit = many > 0
        hit[1:] |= same
        hit[:-1] |= same
        out += [(chunk[i], 2, a.tobytes(), b.tobytes(), None) for i, a, b in ex.by_owner(own[hit], h[hit], g[hit])]
    return ex.replied(out)


def _result_step(length: int, carry: list[str]):
    def step(key, t, got):
        c = _Chunk(t, length)
        whole, sort = _settled(c, got)
        pos, _, h, g = c.suffixes(sort & ~whole)
        a, b, _ = ex.replies(got, 2)
        tie = lambda x, y: ro.mix(x) ^ (y.astype(U) * U(0x9E3779B97F4A7C15))
        hit = pos[ex.member(tie(h, g), np.sort(tie(ex.u64(a), np.frombuffer(b, "<u4"))))]
        s, e = ro.merge(np.concatenate((c.lo[whole], hit)), np.concatenate((c.hi[whole], hit)) + length)
        # spans never cross documents, but those of neighbouring documents may touch
        out = []
        lo, hi = np.searchsorted(e, c.first[:-1], "right"), np.searchsorted(s, c.first[1:], "left")
        for d, data in enumerate(c.data):
            f = int(c.first[d])
            spans = [(max(int(x) - f, 0), min(int(y) - f, len(data))) for x, y in zip(s[lo[d]:hi[d]], e[lo[d]:hi[d]], strict=True)]
            spans = [(x, y) for x, y in spans if y > x]  # an empty text may lie inside a span of its neighbours
            kept, at = [], 0
            for x, y in spans:
                kept.append(data[at:x])
                at = y
            out.append((len(data), sum(y - x for x, y in spans), b"".join([*kept, data[at:]]),
                        [{"start": x, "end": y} for x, y in spans]))
        cols = list(zip(*(out[r] for r in c.row), strict=True)) if c.row else [[]] * 4
        spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        fixed = {"doc_id": t["doc_id"]} | {f: t[f] for f in carry}
        return pa.table(fixed | {"n_bytes": pa.array(cols[0], pa.int64()), "n_removed": pa.array(cols[1], pa.int64()),
                                 "kept": pa.array(cols[2], pa.binary()), "removed": pa.array(cols[3], spans_type)})
    return step


def _sampled_splitters(rows: DataFrame, length: int, buckets: int) -> list[tuple[int, int]]:
    """Splitters ``(lead, fingerprint)`` from a bounded sample of suffixes of whole texts."""
    n = rows.count()
    every = max(1, n // SAMPLE_DOCUMENTS)
    per = max(1, SAMPLE_SUFFIXES // SAMPLE_DOCUMENTS)

    def some(batches):
        for batch in batches:
            got = []
            for text in batch.column(0).to_pylist():
                data = (text or "").encode()
                room = len(data) - length + 1
                for s in sorted({int(x) for x in np.linspace(0, room - 1, per)}) if room > 0 else []:
                    part = np.frombuffer(data[s:s + length], np.uint8)
                    lead = leads(part, np.zeros(1, np.int64))[0]
                    p = ro.FIRST.prefix(ro.FIRST.table[part])
                    h = ro.FIRST.spans(p, np.zeros(1, np.int64), np.full(1, length))[0]
                    got.append((int(lead).to_bytes(4, "big"), int(h).to_bytes(8, "big")))
            yield pa.RecordBatch.from_pydict({"a": pa.array([x[0] for x in got], pa.binary()),
                                              "b": pa.array([x[1] for x in got], pa.binary())})

    picked = rows.where(F.pmod(F.xxhash64("uid"), F.lit(every)) == 0).select("text").mapInArrow(some, "a binary, b binary")
    keys = sorted((int.from_bytes(r.a, "big"), int.from_bytes(r.b, "big")) for r in picked.limit(4 * SAMPLE_SUFFIXES).collect())
    return [keys[len(keys) * i // buckets] for i in range(1, buckets)] if keys else []


def dedup(docs: DataFrame, *, length: int = LENGTH, carry: list[str] | None = None) -> DataFrame:
    """``doc_id, text`` (and ``carry``) -> ``doc_id, carry..., n_bytes, n_removed, kept, removed``.

    ``kept`` is the remaining bytes, ``removed`` the maximal removed runs as byte positions.
    """
    if length < 2 * GRAM:
        raise ValueError(f"length must be at least {2 * GRAM} bytes")
    carry = carry or []
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), *carry)
    rows, chunks = ex.chunked(rows)
    buckets = ex.bucket_count(chunks, STRETCH_CHUNKS)
    splitters = _sampled_splitters(rows, length, ex.bucket_count(chunks, SUFFIX_CHUNKS))
    rows = rows.drop("uid")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    one = rows.groupBy("chunk").applyInArrow(_stretch_step(length, buckets), ex.SENT)
    one = one.groupBy("bucket").applyInArrow(_stretch_bucket, ex.REPLY)
    two = rows.groupBy("chunk").cogroup(one.groupBy("chunk")).applyInArrow(_suffix_step(length, splitters), ex.SENT)
    two = two.groupBy("bucket").applyInArrow(_suffix_bucket, ex.REPLY).union(one)
    schema = ", ".join(["doc_id bigint", *[f"`{f}` {kinds[f]}" for f in carry], "n_bytes bigint", "n_removed bigint",
                        "kept binary", "removed array<struct<start: bigint, end: bigint>>"])
    return rows.groupBy("chunk").cogroup(two.groupBy("chunk")).applyInArrow(_result_step(length, carry), schema)


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns, and what is left as text (bytes of a cut character as U+FFFD)."""
    return dedup(docs).select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("bigint").alias("n_spans"),
                              F.sha2("kept", 256).alias("kept_sha256"), F.make_valid_utf8(F.col("kept").cast("string")).alias("text"))

"""Packed exchange of hashes between chunks of documents.

Millions of hashes per task as rows cost several times their own size in a
shuffle.  Here a chunk of documents (some MB of text, chosen by hash) sends
its distinct hashes sorted and packed, one row per bucket; the bucket's task
compares what all chunks sent and replies, packed, to the chunks.  A hash
that is everywhere is sent once per chunk, so no bucket is hot; chunks are
equal because documents are dealt by hash.  The number of chunks grows with
the input, so that neither a chunk nor a bucket does.  A bucket takes the
hashes of ``CHUNKS_PER_BUCKET`` chunks (some 10 MB packed), which keeps the rows
few: ``chunks ** 2 / 32`` of them, and never more than there are hashes.  Where
chunks send more than that, buckets take fewer chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankwise.llm.rolling import runs

U = np.uint64
CHUNK_BYTES = 4 << 20
#: Chunks whose hashes one bucket takes, and buckets at least, so that small inputs use all cores.
CHUNKS_PER_BUCKET, MIN_BUCKETS = 32, 48

SENT = "bucket int, chunk int, a binary, b binary, c binary"
REPLY = "chunk int, kind int, a binary, b binary, c binary"


def chunked(docs: DataFrame, text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, int]:
    """Add ``uid`` and ``chunk``; equal rows share a chunk.  Only the text's total size reaches the driver."""
    size = docs.agg(F.sum(F.octet_length(text_col)), F.count("*")).first()
    n = max(12, int((size[0] or 0) // chunk_bytes) + int(size[1] // 1_000_000))
    uid = F.xxhash64("doc_id", text_col)
    return docs.withColumn("uid", uid).withColumn("chunk", F.pmod("uid", F.lit(n)).cast("int")), n


def bucket_count(chunks: int, per_bucket: int = CHUNKS_PER_BUCKET) -> int:
    return max(min(MIN_BUCKETS, max(12, chunks // 2)), chunks // per_bucket)


def pack48(h: np.ndarray) -> bytes:
    return h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack48(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8")


def u64(b: bytes) -> np.ndarray:
    return np.frombuffer(b, "<u8")


def bucket_edges(h: np.ndarray, buckets: int, bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Buckets in use and the slices of the sorted hashes that go to them (``len + 1`` edges)."""
    b = ((h >> U(bits - 32)) * U(buckets)) >> U(32)
    cut = np.flatnonzero(b[1:] != b[:-1]) + 1
    edges = np.concatenate(([0], cut, [len(h)])) if len(h) else np.zeros(1, np.int64)
    return b[edges[:-1]].astype(np.int32), edges


def table(schema: list[tuple[str, pa.DataType]], rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.table({n: pa.array(c, t) for (n, t), c in zip(schema, cols, strict=True)})


_SENT = [("bucket", pa.int32()), ("chunk", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())]
_REPLY = [("chunk", pa.int32()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())]


def sent(rows: list[tuple]) -> pa.Table:
    return table(_SENT, rows)


def replied(rows: list[tuple]) -> pa.Table:
    return table(_REPLY, rows)


def payloads(t: pa.Table, column: str) -> list[np.ndarray]:
    """The bytes of a bucket's rows as they lie in the table (no copy)."""
    return [np.frombuffer(x.as_buffer(), np.uint8) for x in t[column]]


def received(t: pa.Table) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """Rows of a bucket: chunk and payloads."""
    yield from zip(t["chunk"].to_pylist(), t["a"].to_pylist(), t["b"].to_pylist(), t["c"].to_pylist(), strict=True)


def replies(t: pa.Table, kind: int) -> tuple[bytes, bytes, bytes]:
    """All payloads of one kind, joined."""
    rows = [r for r in zip(t["kind"].to_pylist(), t["a"].to_pylist(), t["b"].to_pylist(), t["c"].to_pylist(), strict=True)
            if r[0] == kind]
    return tuple(b"".join(r[i] or b"" for r in rows) for i in (1, 2, 3))


def member(x: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Whether each of ``x`` is in the sorted ``found``."""
    if not len(found):
        return np.zeros(len(x), bool)
    at = np.searchsorted(found, x)
    at[at == len(found)] = 0
    return found[at] == x


def owners(parts: list[np.ndarray]) -> np.ndarray:
    return np.repeat(np.arange(len(parts)), [len(p) for p in parts])


def by_owner(own: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple]:
    """Each owner with its part of the arrays."""
    o = np.argsort(own, kind="stable")
    first, last = runs(own[o])
    for i, j in zip(first, last + 1, strict=True):
        yield (int(own[o[i]]), *(a[o[i:j]] for a in arrays))


def shared48(t: pa.Table) -> pa.Table:
    """Bucket step: replies (kind 1) the 48-bit hashes of ``a`` that come from two chunks, or from one that says so in ``b``.

    ``b`` holds one byte per hash, 1 where the chunk has it in two documents or places.
    """
    rows = list(received(t))
    parts = [unpack48(r[1]) for r in rows]
    h, flag, own = np.concatenate(parts), np.frombuffer(b"".join(r[2] for r in rows), np.uint8), owners(parts)
    o = np.argsort(h, kind="stable")
    first, last = runs(h[o])
    n = last - first + 1
    any_flag = np.maximum.reduceat(flag[o], first) if len(first) else first
    hit = np.repeat((n > 1) | (any_flag > 0), n)
    return replied([(rows[k][0], 1, pack48(x), None, None) for k, x in by_owner(own[o][hit], h[o][hit])])

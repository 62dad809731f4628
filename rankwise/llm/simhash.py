"""SimHash near-dedup with pigeonring filtering.

A text's fingerprint has bit ``i`` where over half of its shingles' 64-bit
hashes have it.  Fingerprints link at ``max_bits`` or fewer differing bits.

Pigeonring: the 64 bits form a ring of ``m = 2 * max_bits + 1`` segments.  If
two fingerprints differ in at most ``max_bits`` bits, then from some segment
on every chain of ``l`` consecutive segments differs in at most
``l * max_bits / m`` bits.  The first two budgets are below one, so the chain
begins with two equal segments: these are the bucket key, one for each start.
Within a bucket a pair must keep the budget of the longer chains before the
whole distance is looked at.

Equal fingerprints are one row from the start.  A bucket writes a star of
each local group, never its pairs; a bucket too large for direct comparison
is cut along the remaining bits (of ``max_bits + 1`` parts one is equal), so
work stays far below its square and nothing is lost.

Defined results: a null or empty text has no words and fingerprint zero, which
links like any other; fewer words than a shingle are one shingle; repeated
rows are linked; rows without ``doc_id`` link, but name no component (null,
where a component has no other rows).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankwise.llm.common import salted_join, stored, text_slices
from rankwise.llm.components import components
from rankwise.llm.rolling import runs

U = np.uint64
SEED = 42
SHINGLE = 3
MAX_BITS = 2
_BLOCK = 1 << 15
#: Fingerprints that are compared directly, all with all, inside a task.
DIRECT = 1024


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Fingerprint of a whole text, as an unsigned number."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for a in range(0, n, _BLOCK):
        b = min(n, a + _BLOCK)
        part = [digest(b" ".join(words[i:i + shingle]), SEED) for i in range(a, b)]
        bits = np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * ones > n).tolist())


def fingerprints(docs: DataFrame, *, shingle: int = SHINGLE, carry: list[str] | None = None) -> DataFrame:
    """``doc_id, text`` -> ``doc_id, fp`` (signed 64 bits) and ``carry``."""
    carry = carry or []
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), *carry)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def apply(batches):
        for b in text_slices(batches, 1):
            fp = np.array([fingerprint(x, shingle) for x in b.column(1).to_pylist()], U).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64()), *b.columns[2:]],
                                             names=["doc_id", "fp", *carry])

    schema = ", ".join([f"doc_id {kinds['doc_id']}", "fp bigint", *[f"`{c}` {kinds[c]}" for c in carry]])
    return rows.mapInArrow(apply, schema)


def segments(max_bits: int) -> list[int]:
    """Bit masks of the ring's segments."""
    m = 2 * max_bits + 1
    edges = [64 * i // m for i in range(m + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _near(fp: np.ndarray, max_bits: int, chain: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of positions that keep the chain's budgets ``(mask, bits)`` and then the whole distance."""
    a, b = np.triu_indices(len(fp), 1)
    d = fp[a] ^ fp[b]
    for mask, budget in chain:
        ok = np.bitwise_count(d & U(mask)) <= budget
        a, b, d = a[ok], b[ok], d[ok]
    ok = np.bitwise_count(d) <= max_bits
    return a[ok], b[ok]


def _cut(free: list[int], parts: int) -> list[list[int]]:
    return [p for p in (free[len(free) * i // parts:len(free) * (i + 1) // parts] for i in range(parts)) if p]


def linked(fp: np.ndarray, max_bits: int, chain: list[tuple[int, int]], free: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of distinct fingerprints that agree outside the ``free`` bits."""
    if len(fp) <= DIRECT or len(free) <= max_bits:
        out = []
        for i in range(0, len(fp), DIRECT):  # more only where hardly any bit is free
            for j in range(i, len(fp), DIRECT):
                both = fp[i:i + DIRECT] if i == j else np.concatenate((fp[i:i + DIRECT], fp[j:j + DIRECT]))
                a, b = _near(both, max_bits, chain)
                out.append((both[a], both[b]))
        return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])
    left, right = [], []
    for part in _cut(free, max_bits + 1):
        mask = U(sum(1 << i for i in part))
        o = np.argsort(fp & mask, kind="stable")
        first, last = runs((fp & mask)[o])
        rest = [i for i in free if i not in part]
        for i, j in zip(first, last + 1, strict=True):
            if j - i > 1:
                a, b = linked(fp[o[i:j]], max_bits, chain, rest)
                left.append(a)
                right.append(b)
    none = np.zeros(0, U)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def stars(nodes: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links ``(node, root)`` that connect what the pairs connect, one per node that isn't a root."""
    nodes = np.unique(np.concatenate((a, b))) if nodes is None else nodes
    i, j = np.searchsorted(nodes, a), np.searchsorted(nodes, b)
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = new[new]
        if (new == label).all():
            break
        label = new
    at = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[at], nodes[label[at]]


def links(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Distinct ``fp`` -> links ``(a, b)`` that connect all fingerprints within ``max_bits``."""
    masks = segments(max_bits)
    m = len(masks)
    signed = [int(np.array(masks[i] | masks[(i + 1) % m], U).view(np.int64)) for i in range(m)]
    keyed = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(x)) for x in signed]))
                            .alias("ring", "key"))

    def bucket(ring: int, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        chain, mask = [], masks[ring] | masks[(ring + 1) % m]
        free = [i for i in range(64) if not mask >> i & 1]
        for l in range(3, m):
            mask |= masks[(ring + l - 1) % m]
            chain.append((mask, l * max_bits // m))
        a, b = linked(fp, max_bits, chain, free)
        return stars(None, a, b)

    def apply(batches):
        """Batches are sorted by bucket; the last bucket of a batch may go on in the next."""
        held: list[np.ndarray] = []
        ring_now = key_now = None

        def close():
            fp = np.concatenate(held)
            return bucket(ring_now, fp) if len(fp) > 1 else (np.zeros(0, U), np.zeros(0, U))

        for batch in batches:
            fp = batch.column(0).to_numpy().view(U)
            ring, key = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            if not len(fp):
                continue
            change = np.flatnonzero((ring[1:] != ring[:-1]) | (key[1:] != key[:-1])) + 1
            edges = np.concatenate(([0], change, [len(fp)]))
            found = []
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                if (ring[i], key[i]) != (ring_now, key_now):
                    if held:
                        found.append(close())
                    held, ring_now, key_now = [], ring[i], key[i]
                held.append(fp[i:j])
            yield _pairs(found)
        if held:
            yield _pairs([close()])

    return (keyed.repartition("ring", "key").sortWithinPartitions("ring", "key").mapInArrow(apply, "a bigint, b bigint")
            .distinct())


def _pairs(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a, b = (np.concatenate([np.zeros(0, U), *(f[i] for f in found)]).view(np.int64) for i in (0, 1))
    return pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def dedup(docs: DataFrame, *, shingle: int = SHINGLE, max_bits: int = MAX_BITS, carry: list[str] | None = None) -> DataFrame:
    """``doc_id, fp, component, component_id`` and ``carry``.

    ``component`` names the group of linked fingerprints (the smallest, as a
    signed number), ``component_id`` is the smallest ``doc_id`` in it.
    """
    fps = stored(fingerprints(docs, shingle=shingle, carry=carry))
    distinct = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    groups = components(links(distinct.select("fp"), max_bits)).withColumnsRenamed({"node": "fp"})
    named = distinct.join(groups, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(least, "component").select("fp", "component", "component_id")
    return salted_join(fps, named, ["fp"], "doc_id", "inner")


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return dedup(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

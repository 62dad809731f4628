"""SimHash, suffix-array and substring dedup against brute force."""

import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from rankwise.llm import rolling, simhash, substring_dedup, suffix_dedup
from tests.llm.helpers import edge_documents, frame, passage, roots, sf_documents, sha, strings_removed, windows_removed

TABLES = {"sf": sf_documents, "edge": edge_documents, "empty": list, "nulls": lambda: [(None, None)] * 3}


def _fingerprint(text):
    w = (text or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i:i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


@pytest.mark.parametrize("name", TABLES)
def test_simhash(spark, name):
    rows = TABLES[name]()
    fp = np.array([_fingerprint(t) for _, t in rows], np.uint64)
    pairs = [(i, j) for i in range(len(fp)) for j in (np.flatnonzero(np.bitwise_count(fp[i + 1:] ^ fp[i]) <= 2) + i + 1)]
    root = roots(len(fp), *zip(*pairs, strict=True)) if pairs else np.arange(len(fp))
    least = {}
    for (i, _), r in zip(rows, root, strict=True):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    want = Counter((i, f"{int(f):016x}", least.get(r)) for (i, _), f, r in zip(rows, fp, root, strict=True))
    got = simhash.digest(frame(spark, rows)).collect()
    assert Counter(tuple(r) for r in got) == want


@pytest.mark.parametrize("max_bits", [1, 2, 4])
def test_pigeonring_finds_every_link(spark, max_bits):
    r = random.Random(max_bits)
    base = [r.getrandbits(64) for _ in range(60)]
    fps = {0, (1 << 64) - 1, *base}
    for b in base:
        for _ in range(12):
            x = b
            for _ in range(r.randint(1, max_bits + 1)):
                x ^= 1 << r.randrange(64)
            fps.add(x)
    fp = np.array(sorted(fps), np.uint64)
    pairs = [(i, j) for i in range(len(fp)) for j in np.flatnonzero(np.bitwise_count(fp[i + 1:] ^ fp[i]) <= max_bits) + i + 1]
    root = roots(len(fp), *zip(*pairs, strict=True))
    links = simhash.links(spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp bigint"), max_bits).collect()
    place = {int(x): i for i, x in enumerate(fp.view(np.int64))}
    got = roots(len(fp), [place[x.a] for x in links], [place[x.b] for x in links])
    assert (got == root).all()


def test_large_bucket_is_cut_and_loses_nothing(monkeypatch):
    monkeypatch.setattr(simhash, "DIRECT", 16)
    r = random.Random(5)
    fp = np.unique(np.array([r.getrandbits(12) for _ in range(900)], np.uint64))
    a, b = simhash.linked(fp, 2, [], list(range(20)))
    got = {(min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist(), strict=True)}
    want = {(int(x), int(y)) for i, x in enumerate(fp) for y in fp[i + 1:] if int(x ^ y).bit_count() <= 2}
    assert got == want


def _digest9(rows):
    return Counter((i, len(w), sum(g), sha(b" ".join(x for x, y in zip(w, g, strict=True) if not y)))
                   for (i, _), (w, g) in zip(rows, windows_removed(rows), strict=True))


@pytest.mark.parametrize("name", TABLES)
def test_substring_dedup(spark, name):
    rows = TABLES[name]()
    assert Counter(tuple(r) for r in substring_dedup.digest(frame(spark, rows)).collect()) == _digest9(rows)


def test_substring_dedup_hot_passage(spark):
    from tests.llm.helpers import passage
    hot = passage(99, 55)
    rows = [(i, passage(i, i % 7) + " " + hot + " " + passage(1000 + i, i % 5)) for i in range(300)]
    got = substring_dedup.digest(frame(spark, rows)).collect()
    assert Counter(tuple(r) for r in got) == _digest9(rows)


def test_substring_dedup_keeps_white_space(spark):
    rows = edge_documents()[:14]
    got = {r.doc_id: r for r in substring_dedup.dedup(frame(spark, rows), carry=["lang"], spaces=True).collect()}
    for i, t in rows:
        assert got[i].lang == "en"
        if got[i].n_removed == 0:
            assert got[i].kept == (t or "")
        assert len(got[i].kept.encode().split()) == got[i].n_words - got[i].n_removed
        assert sum(s.end - s.start for s in got[i].removed) == got[i].n_removed


@pytest.mark.parametrize("name", TABLES)
def test_suffix_dedup(spark, name):
    rows = TABLES[name]()
    want = Counter()
    for (i, _), (b, g) in zip(rows, strings_removed(rows), strict=True):
        spans = sum(1 for k in range(len(g)) if g[k] and (k == 0 or not g[k - 1]))
        want[(i, len(b), sum(g), spans, sha(bytes(x for x, y in zip(b, g, strict=True) if not y)))] += 1
    assert Counter(tuple(r)[:5] for r in suffix_dedup.digest(frame(spark, rows)).collect()) == want


@pytest.mark.parametrize("nothing", ["", None])
def test_suffix_dedup_nothing_between_copies(nothing):
    """An empty text whose neighbours in the chunk are removed whole loses nothing."""
    copy = "".join(random.Random(4).choice("abcdefgh ") for _ in range(1000))
    t = pa.table({"doc_id": pa.array([1, 2, 3], pa.int64()), "text": pa.array([copy, nothing, copy])})
    key = (pa.scalar(0, pa.int32()),)
    one = suffix_dedup._stretch_bucket(suffix_dedup._stretch_step(400, 1)(key, t))
    got = suffix_dedup._result_step(400, [])(key, t, one).to_pylist()  # the copies are settled whole: no suffixes are left
    assert [(r["n_bytes"], r["n_removed"], r["kept"], len(r["removed"])) for r in got] == [(1000, 1000, b"", 1), (0, 0, b"", 0), (1000, 1000, b"", 1)]


def test_suffix_dedup_of_rows_without_an_id(spark):
    """Two such rows are two documents; what is left is also there as text."""
    text = passage(9, 300)[:1032]
    got = suffix_dedup.digest(frame(spark, [(None, text), (None, text), (1, "é" + passage(10, 80)), (2, passage(11, 90)), (2, passage(11, 90))])).collect()
    assert sorted((r.n_bytes, r.n_removed, r.text) for r in got if r.doc_id is None) == [(1032, 1032, "")] * 2
    assert [r.text for r in got if r.doc_id == 1] == ["é" + passage(10, 80)]
    assert [(r.n_removed, r.text) for r in got if r.doc_id == 2] == [(0, passage(11, 90))] * 2


def test_cuts_equal_a_search_for_each_splitter():
    r = np.random.default_rng(2)
    lead, h = r.integers(0, 9, 500).astype(np.uint32), r.integers(0, 2**64, 500, dtype=np.uint64) & np.uint64(0xFF00FF0000000000)
    o = np.lexsort((h, lead))
    lead, h = lead[o], h[o]
    splitters = sorted((int(a), int(b)) for a, b in zip(lead[::7], h[::7], strict=True)) + [(2**32 - 1, 2**64 - 1)]
    pairs = list(zip(lead.tolist(), h.tolist(), strict=True))
    assert suffix_dedup._cuts(lead, h, splitters).tolist() == [0, *[sum(p < s for p in pairs) for s in splitters], 500]
    assert suffix_dedup._cuts(lead, h, []).tolist() == [0, 500]


def test_suffix_dedup_ends_of_repeats(spark):
    """Overlapping passages of many lengths, of which few strings repeat."""
    r = random.Random(3)
    base = "".join(r.choice("abcdefgh ") for _ in range(3000))
    rows = []
    for i in range(60):
        a = r.randrange(2400)
        own = "".join(r.choice("ijklmnop") for _ in range(r.randrange(80)))
        rows.append((i, own + base[a:a + r.randint(380, 600)] + own[::-1]))
    want = Counter()
    for (i, _), (b, g) in zip(rows, strings_removed(rows), strict=True):
        spans = sum(1 for k in range(len(g)) if g[k] and (k == 0 or not g[k - 1]))
        want[(i, len(b), sum(g), spans, sha(bytes(x for x, y in zip(b, g, strict=True) if not y)))] += 1
    assert Counter(tuple(x)[:5] for x in suffix_dedup.digest(frame(spark, rows)).collect()) == want


@pytest.mark.parametrize("span", [450, 1000, 5000])
def test_pieces_of_long_texts_change_nothing(monkeypatch, span):
    rows = [(i, t) for i, t in edge_documents() if i is not None]
    t = pa.table({"doc_id": pa.array([i for i, _ in rows], pa.int64()), "text": pa.array([x for _, x in rows], pa.string())})
    whole = suffix_dedup._Chunk(t, 400)
    starts = lambda c: sorted(x for a, b in zip(c.lo, c.hi, strict=True) for x in range(a, b + 1))
    monkeypatch.setattr(suffix_dedup, "_SPAN", span)
    cut = suffix_dedup._Chunk(t, 400)
    assert starts(cut) == starts(whole)
    pos, _, h, _ = cut.suffixes(np.ones(len(cut.lo), bool))
    monkeypatch.undo()
    pos2, _, h2, _ = whole.suffixes(np.ones(len(whole.lo), bool))
    assert (pos == pos2).all() and (h == h2).all()
    nine = substring_dedup._Chunk(t, 50)
    a = nine.anchors()
    monkeypatch.setattr(substring_dedup, "_SPAN", span)
    assert (substring_dedup._Chunk(t, 50).anchors() == a).all()


def test_multikey_order():
    r = np.random.default_rng(1)
    keys = [r.integers(0, 5, 500).astype(np.uint64) for _ in range(3)]
    o = suffix_dedup.multikey_order(keys)
    assert [tuple(int(k[i]) for k in keys) for i in o] == sorted(tuple(int(x) for x in t) for t in zip(*keys, strict=True))


def test_sliding_argmin_takes_the_leftmost():
    v = (np.array([5, 3, 3, 9, 1, 1, 7, 2], np.uint64)) << np.uint64(40)
    assert rolling.sliding_argmin(v, 3).tolist() == [1, 1, 4, 4, 4, 5]


def test_word_hashes_do_not_depend_on_place():
    a, s, e = rolling.words(b" ab  cd\nab\tx")
    assert a[0] == a[2] != a[1] and s.tolist() == [1, 5, 8, 11] and e.tolist() == [3, 7, 10, 12]


def _suffix_rows(chunks, each):
    r = np.random.default_rng(8)
    rows = []
    for c in range(chunks):
        lead, h = r.integers(0, 50, each).astype("<u4"), r.integers(0, 3 * each, each).astype("<u8") << np.uint64(40)
        o = np.lexsort((h, lead))
        rows.append((0, c, lead[o].tobytes(), h[o].tobytes(), bytes(4 * each) + np.packbits(r.random(each) < 0.01).tobytes()))
    return suffix_dedup.ex.sent(rows)


def _stretch_rows(chunks, each):
    r = np.random.default_rng(9)
    rows = []
    for c in range(chunks):
        gram, u1 = np.sort(r.integers(0, 2 * each, each).astype("<u8") << np.uint64(40)), r.integers(0, 2, each).astype("<u8")
        rows.append((0, c, gram.tobytes(), u1.tobytes(), bytes(4 * each) + r.integers(1, 3, each).astype(np.uint8).tobytes()))
    return suffix_dedup.ex.sent(rows)


@pytest.mark.parametrize("kind", ["suffix", "stretch"])
def test_a_bucket_is_compared_in_parts(monkeypatch, kind):
    """The parts find what the whole bucket finds, in a memory that the bucket's size hardly changes."""
    step, rows = (suffix_dedup._suffix_bucket, _suffix_rows) if kind == "suffix" else (suffix_dedup._stretch_bucket, _stretch_rows)

    def found(t):
        flat = Counter()
        for row in step(t).to_pylist():
            a, b = np.frombuffer(row["a"], "<u8"), np.frombuffer(row["b"], "<u4" if kind == "suffix" else "<u8")
            flat.update(zip([row["chunk"]] * len(a), a.tolist(), b.tolist(), row["c"][4 * len(a):] if row["c"] else [0] * len(a), strict=True))
        return flat

    t = rows(40, 333)
    whole = found(t)
    monkeypatch.setattr(suffix_dedup, "PART", 500, raising=False)
    assert found(t) == whole and len(whole) > 100
    monkeypatch.setattr(suffix_dedup, "PART", 1 << 15, raising=False)
    peaks = []
    for chunks in (20, 80):
        t = rows(chunks, 20_000)
        tracemalloc.start()
        out = step(t).nbytes
        peaks.append(tracemalloc.get_traced_memory()[1] - 2 * out)
        tracemalloc.stop()
    assert peaks[1] < 3 * t.nbytes


def test_suffix_buckets_grow_with_the_chunks(spark, monkeypatch):
    """A chunk may send more bytes of suffixes than it has text."""
    asked = []
    monkeypatch.setattr(suffix_dedup.ex, "chunked", lambda rows: (rows.selectExpr("*", "0L AS uid", "0 AS chunk"), 1800))
    monkeypatch.setattr(suffix_dedup, "_sampled_splitters", lambda rows, length, buckets: asked.append(buckets) or [])
    suffix_dedup.dedup(frame(spark, [(1, "x")]))
    assert asked == [900]

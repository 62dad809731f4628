"""BPE, toxicity and embeddings against the library, held-out labels and brute force."""

import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rankwise.llm import bpe, embeddings, toxicity
from tests.llm.helpers import SF, edge_documents, frame, roots, sf_documents, sha

TABLES = {"sf": sf_documents, "edge": edge_documents, "empty": list, "nulls": lambda: [(None, None)] * 3}

# BPE

with open(bpe.default_path(), "rb") as _f:
    CODER = bpe.Coder(_f.read())
LIBRARY = Tokenizer.from_file(bpe.default_path())


def _library(text):
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    return ids, LIBRARY.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("name", TABLES)
def test_bpe_equals_the_library(spark, name):
    rows = TABLES[name]()
    want = Counter()
    for i, t in rows:
        ids, text = _library(t or "")
        want[(i, len(ids), sha(",".join(map(str, ids)).encode()), sha(text.encode()))] += 1
    assert Counter(tuple(r) for r in bpe.digest(frame(spark, rows)).collect()) == want


def test_neighbours_stay_as_merging_leaves_them():
    """The pair test of the transducer against merging, on pairs of tokens and on pairs that do merge."""
    rng = random.Random(5)
    ids = sorted(CODER.id_of.values())
    pairs = [(rng.choice(ids), rng.choice(ids)) for _ in range(5_000)] + rng.sample(sorted(CODER.ranks), 5_000)
    for a, b in pairs:
        assert CODER.side_by_side(a, b) == (CODER.merge(CODER.bytes_of[a] + CODER.bytes_of[b]) == [a, b]), (a, b)


@given(st.text(max_size=60) | st.text(alphabet="ab  \n\t'sreltdIm1.é中<|endoftext|>", max_size=80))
@settings(max_examples=300, deadline=None)
def test_bpe_of_any_text(text):
    ids, back = _library(text)
    assert CODER.encode(text) == ids and CODER.decode(ids) == back == text


@given(st.integers(0, 10**6), st.sampled_from(["a", "ab", "the", "=-", "\t", "é", "Ã", ".", "etaoin", "0123"]), st.integers(1, 900))
@settings(max_examples=60, deadline=None)
def test_stream_equals_merging_by_rank(seed, letters, n):
    r = random.Random(seed)
    data = "".join(r.choice(letters) for _ in range(n)).encode()
    assert list(CODER.stream(data)) == CODER.merge(data)


@given(st.integers(0, 10**6), st.integers(1, 60))
@settings(max_examples=60, deadline=None)
def test_words_that_begin_alike_equal_merging_by_rank(seed, n):
    r = random.Random(seed)
    begin = "".join(r.choice(" theéÃ") for _ in range(r.randrange(8)))
    for _ in range(8):
        w = begin + "".join(r.choice("etaoin thé=-0") for _ in range(r.randrange(n)))
        assert list(CODER.word(w)) == CODER.merge(w.encode())


def test_stream_memory_is_bounded_and_emits_early():
    r = random.Random(1)
    fed = 0

    def feed():
        nonlocal fed
        for _ in range(6000):
            fed += 1
            yield ord(r.choice("etaoinshrdlu"))
    held, out = 0, 0
    for token in CODER.stream(feed()):
        out += len(CODER.bytes_of[token])
        held = max(held, fed - out)
    assert out == 6000 and held <= 12 * CODER.horizon


def test_slices_change_nothing(monkeypatch):
    text = "".join(random.Random(2).choice(["ab ", "  ", "\n", "'s", " the", "é", "1", " I'm", "　"]) for _ in range(3000))
    want = _library(text)[0]
    for size in (1, 7, 100):
        monkeypatch.setattr(bpe, "SLICE", size)
        assert CODER.encode(text) == want


def test_decoder_is_incremental():
    text = "naïve 中文 🙂 é"
    ids = CODER.encode(text)
    d = CODER.decoder()
    assert "".join([d([i]) for i in ids] + [d([], True)]) == text
    assert CODER.decode([*ids[:1], CODER.single[0xE4]]).endswith("�")


def test_encode_and_decode_tables(spark):
    rows = edge_documents()
    enc = bpe.encode(frame(spark, rows), carry=["lang"])
    assert enc.columns == ["doc_id", "lang", "n_tokens", "ids"]
    assert Counter(tuple(r) for r in bpe.decode(enc).collect()) == Counter((i, t or "") for i, t in rows)


# toxicity

def _toxicity(spark, sf):
    return toxicity.digest(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    truth = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{sf}/labels.parquet").to_pylist()}
    got = [(truth[r.doc_id], r.predicted) for r in _toxicity(spark, sf).collect() if r.held_out and r.doc_id in truth]
    c = Counter(got)
    assert len(got) > 500 and c[0, 1] <= 0.01 * (c[0, 0] + c[0, 1])
    assert c[1, 1] >= 0.8 * (c[1, 0] + c[1, 1])


def test_toxicity_does_not_see_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("toxic", F.when(toxicity.fold() == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    other = docs.withColumn("lang", F.lit("x")).withColumn("source", F.lit("y"))
    assert sorted(map(tuple, toxicity.digest(docs, labels).collect())) == sorted(map(tuple, toxicity.digest(other, turned).collect()))


@pytest.mark.parametrize("name", ["edge", "empty", "nulls"])
def test_toxicity_of_odd_tables(spark, name):
    rows = TABLES[name]()
    labels = spark.createDataFrame([(8, 1), (8, 0), (11, None), (None, 1), (15, 1), (12, 0)], "doc_id bigint, toxic int")
    for known in (labels, labels.limit(0)):
        got = toxicity.digest(frame(spark, rows), known).collect()
        assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
        assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


def test_non_negative_risk():
    """Toxic texts share two words; texts that only look unusual aren't toxic."""
    r = np.random.default_rng(4)
    common = [np.unique(r.integers(10, 400, 30)).astype(np.uint64) for _ in range(900)]
    toxic = [np.append(x, np.uint64(1 + i % 2)) for i, x in enumerate(common[:200])]
    unlabelled = common[200:] + [np.append(x, np.uint64(1 + i % 2)) for i, x in enumerate(common[:70])]
    model = toxicity.fit_words([np.unique(x) for x in toxic], [np.unique(x) for x in unlabelled], 70 / 770)
    logit = lambda x: model.base + sum(w for h, w in zip(model.words, model.weights, strict=True) if h in x)
    assert all(logit(x) >= 0 for x in toxic) and all(logit(x) < 0 for x in common)


# embeddings

def _brute(rows, least=0.95):
    ok = {}
    for k, (_, v) in enumerate(rows):
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            a = np.array(v, float)
            a /= np.abs(a).max()
            ok[k] = a / np.linalg.norm(a)
    links, pairs = Counter(), []
    keys = sorted(ok)
    for n, i in enumerate(keys):
        for j in keys[n + 1:]:
            if len(ok[i]) == len(ok[j]) and float(ok[i] @ ok[j]) >= least:
                links[i] += 1
                links[j] += 1
                pairs.append((i, j))
    root = roots(len(rows), *zip(*pairs, strict=True)) if pairs else np.arange(len(rows))
    name = {}
    for (i, _), r in zip(rows, root, strict=True):
        if i is not None:
            name[r] = min(i, name.get(r, i))
    return Counter((i, links[k], name.get(root[k]), i is not None and i == name.get(root[k])) for k, (i, _) in enumerate(rows))


def _vectors(n=900, hot=200, seed=0):
    r = np.random.default_rng(seed)
    centre = r.normal(size=(n, 32))
    rows = [v.tolist() for v in centre]
    for k in range(150):
        rows.append((centre[k % 40] + r.normal(size=32) * 0.12).tolist())
    rows += [rows[5]] * hot
    return [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(rows)]


@pytest.mark.parametrize("block", [2048, 16])
def test_embeddings_recall(spark, block):
    rows = _vectors()
    got = embeddings.dedup(frame(spark, rows, "vec_id bigint, embedding array<float>", label="1"), block=block).collect()
    want = _brute(rows)
    links = sum(x[1] * n for x, n in want.items())
    assert 0.95 * links <= sum(r.n_links for r in got) <= links
    least = {x[0]: x for x in want}
    assert all(r.n_links <= least[r.vec_id][1] and r.component_id >= least[r.vec_id][2] for r in got)
    assert np.mean([tuple(r) == least[r.vec_id] for r in got]) > 0.95


@pytest.mark.parametrize("pivots", [800, 8192, 32_768])
def test_embeddings_recall_keeps_up_with_the_pivots(pivots):
    """Pairs at the threshold share enough pivots, however many pivots there are."""
    r = np.random.default_rng(pivots)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    index, a, o = (unit(r.normal(size=(n, 64))) for n in (pivots, 400, 400))
    b = 0.95 * a + np.sqrt(1 - 0.95 ** 2) * unit(o - (o * a).sum(axis=1, keepdims=True) * a)
    x, y = (embeddings.describe(m, index, embeddings.nearest(pivots)) for m in (a, b))
    assert ((x[:, :, None] == y[:, None, :]).any(axis=2).sum(axis=1) >= embeddings.SHARED).mean() > 0.97


def test_describe_in_bounded_memory():
    """Nearness to many pivots is taken some rows at a time, and ties still go by pivot number."""
    r = np.random.default_rng(0)
    vectors, pivots = r.normal(size=(2048, 4)), r.normal(size=(8192, 4))
    tracemalloc.start()
    got = embeddings.describe(vectors, pivots, 8)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80 << 20
    assert (got == np.argsort(-np.round(vectors @ pivots.T, 12), axis=1, kind="stable")[:, :8]).all()
    twice = np.concatenate((pivots[:20], pivots[:20]))
    assert (embeddings.describe(vectors, twice, 7) == np.argsort(-np.round(vectors @ twice.T, 12), axis=1, kind="stable")[:, :7]).all()


def test_embeddings_of_odd_tables(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(9, [1.0, 0.0]), (3, [2.0, 0.0]), (4, [1.0, 0.05]), (5, None), (6, []), (7, [0.0, 0.0]), (8, [1.0, None]),
            (10, [nan, 1.0]), (11, [inf, 1.0]), (12, [1.0, 0.0, 0.0]), (13, [1.0, 0.01, 0.0]), (None, [1.0, 0.0]), (None, None),
            (9, [1.0, 0.0]), (14, [1e-300, 1e-300]), (15, [1e300, 1e300]), (16, [-1.0, 0.0])]
    schema = "vec_id bigint, embedding array<double>"
    assert Counter(tuple(r) for r in embeddings.dedup(frame(spark, rows, schema)).collect()) == _brute(rows)
    assert embeddings.dedup(frame(spark, [], schema)).collect() == []
    got = embeddings.dedup(frame(spark, [(1, None), (1, None), (None, [])], schema)).collect()
    assert Counter(tuple(r) for r in got) == {(1, 0, 1, True): 2, (None, 0, None, False): 1}

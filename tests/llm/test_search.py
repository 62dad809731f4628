"""Quality rules, ranked search and the conversation trie against brute force, SQL and held-out labels."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest

from rankwise.llm import conversation_trie as ct
from rankwise.llm import quality_rules as qr
from rankwise.llm import queries
from rankwise.llm import ranked_search as rs
from tests.llm.helpers import SF, edge_documents, frame, passage, sf_documents, sha

TABLES = {"sf": sf_documents, "edge": edge_documents, "empty": list, "nulls": lambda: [(None, None)] * 3}

# quality rules


def _measured(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = defaultdict(list)
    for i in range(len(words) - 7):
        windows[tuple(words[i:i + 8])].append(i)
    repeat = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeat), n < 20 or 100 * len(repeat) > 30 * n)


def _odd_texts():
    line = passage(31, 9)
    return [(1, f"{line}\n{line}\n\n \t\n \t\n{line} \n{line}"), (2, "#a *b|c <d> $%&" * 9), (3, "é中 " * 40), (4, passage(32, 20)),
            (5, passage(32, 19)), (6, "a b c d e f g h i " * 2 + passage(33, 90)), (7, "\r\n".join([line] * 3)), (8, "x" * 30_000 + " y")]


@pytest.mark.parametrize("name", [*TABLES, "odd"])
def test_measures_equal_brute_force(spark, name):
    rows = _odd_texts() if name == "odd" else TABLES[name]()
    got = qr.judge(frame(spark, rows, base_failed="b", n_words="w"), qr.Model(None))
    assert got.columns == ["doc_id", *qr.MEASURES, "base_failed", "score", "kept"]
    want = Counter((i, *_measured(t)) for i, t in rows)
    found = got.collect()
    assert Counter(tuple(r)[:7] for r in found) == want
    assert all(r.score == 1 and r.kept == (not r.base_failed) for r in found)


def test_measures_do_not_depend_on_slices(spark, monkeypatch):
    texts = [t for _, t in edge_documents() + _odd_texts()]
    whole = np.array(qr._Batch(texts).measures())
    single = np.concatenate([np.array(qr._Batch([t]).measures()) for t in texts], axis=1)
    assert (whole == single).all()
    model = qr.Model(np.random.default_rng(1).normal(size=4 * qr.BUCKETS))
    logits = qr._logits(qr._Batch(texts), model)
    assert (logits == np.concatenate([qr._logits(qr._Batch([t]), model) for t in texts])).all()
    monkeypatch.setattr(qr, "_PIECE", 100)
    assert np.allclose(qr._logits(qr._Batch(texts), model), logits)


def _scored(spark, sf, labels=None):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return qr.digest(docs, labels if labels is not None else spark.read.parquet(f"{sf}/labels.parquet"))


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    truth = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{sf}/labels.parquet").to_pylist()}
    got = [(truth[r.doc_id], r) for r in _scored(spark, sf).collect() if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    judged = [(y, r) for y, r in got if not r.base_failed]
    assert len(judged) > 500
    assert sum(not r.kept for y, r in judged if y) <= 0.01 * sum(y for y, _ in judged)
    assert sum(not r.kept for y, r in judged if not y) >= 0.9 * sum(not y for y, _ in judged)
    # calibrated: the mean probability is the share of good texts, and the squared error is small
    assert abs(np.mean([r.score - y for y, r in judged])) < 0.03
    assert np.mean([(r.score - y) ** 2 for y, r in judged]) < 0.02


def test_quality_never_sees_held_out_labels(spark):
    from pyspark.sql import functions as F
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.withColumn("quality", F.when(qr.fold() == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    odd = spark.createDataFrame([(None, 0, 0), (10**12, 0, 0), (1, 7, 0)], labels.schema)
    assert sorted(map(tuple, _scored(spark, SF).collect())) == sorted(map(tuple, _scored(spark, SF, turned.union(odd)).collect()))


def test_quality_of_copies_and_one_class(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    twice = qr.digest(docs.union(docs), labels).collect()
    once = qr.digest(docs, labels.union(labels)).collect()
    assert sorted(map(tuple, twice)) == sorted([*map(tuple, once)] * 2)
    for some in (labels.where("quality = 1"), labels.limit(0)):
        assert all(r.score == 1 and r.kept != r.base_failed for r in qr.digest(docs, some).collect())


# ranked search

def _ranked(docs, items, top=20):
    cut = "[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+"
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    bags = [(i, Counter(re.findall(cut, (t or "").translate(lower)))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n_docs, length = len(bags), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in dict.fromkeys(items):
        query = Counter(re.findall(cut, (text or "").translate(lower)))
        found = []
        for i, b in bags:
            m = 75 + 25 * b.total() * n_docs // length
            score = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * b[t] // (1000 * b[t] + 12 * m))
                        for t, q in query.items() if t in b)
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, k + 1, i, -s) for k, (s, _, _, i) in enumerate(sorted(found)[:top])]
    return out


def _items():
    texts = [t for _, t in sf_documents()]
    items = [(i, " ".join(texts[i].split()[3:40])) for i in range(30)]
    return [*items, (30, None), (31, ""), (32, "nothing-like-it 0x1"), (33, "THE the The"), (33, "and"), (34, texts[5]), (34, texts[5]),
            (None, texts[7][:300]), (35, "the same same")]


@pytest.mark.parametrize("name", TABLES)
@pytest.mark.parametrize("cut", [{}, {"shard_docs": 23, "bundle": 4, "wave": 2}, {"shares": (0.05, 1.0), "bundle": 1, "top": 3}])
def test_search_equals_brute_force(spark, name, cut):
    rows, items = TABLES[name](), _items()
    got = rs.search(frame(spark, rows, item="i", term="t"), frame(spark, items, "item_id bigint, text string", doc_id="d"), **cut)
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and dict(got.dtypes)["rank"] == "int"
    assert Counter(map(tuple, got.collect())) == Counter(_ranked(rows, items, cut.get("top", 20)))


def test_search_without_items(spark):
    assert rs.search(frame(spark, sf_documents()), frame(spark, [], "item_id bigint, text string")).collect() == []


def test_search_drops_accumulators_and_stays_exact(spark, monkeypatch):
    """One rare term decides; the common ones come last and must not keep every document alive."""
    rows = [(i, f"rare{i % 40} " + passage(i, 3) + " all of them" * (1 + i % 3)) for i in range(2000)]
    kept = []
    plain = rs._add

    def counting(*a):
        parts, found = plain(*a)
        kept.append(sum(len(d) for d, _ in found))
        return parts, found

    items = [(1, "rare7 rare9 all of them")]
    assert Counter(map(tuple, rs.search(frame(spark, rows), frame(spark, items, "item_id bigint, text string")).collect())) == Counter(_ranked(rows, items))
    docs, query = _stage_input(rows, items[0][1])
    for k in range(2):
        docs, query = _one_stage(counting, docs, query, k)
    assert all(20 <= n <= 100 for n in kept)  # at most the documents with a rare term, not all 2,000


def _stage_input(rows, text):
    """The first row and the postings of a shard, made by the operator's own step."""
    import pyarrow as pa
    h, doc, n = rs._terms([t for _, t in rows])
    d, h, tf = rs._counted(h, doc)
    cut = np.searchsorted(d, np.arange(len(rows) + 1))
    docs = pa.table({"doc_id": [i for i, _ in rows], "n": np.bincount(doc), "terms": [h[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])],
                     "tfs": [tf[a:b].astype("<u4").tobytes() for a, b in zip(cut[:-1], cut[1:])]})
    q, _, _ = rs._terms([text])
    df = Counter(h.tolist())
    weight = np.array([math.floor(1000 * math.log((2 * len(rows) + 2) / (2 * df[x] + 1))) for x in q.tolist()], np.int64)
    keep = weight > 0
    term, weight = q[keep].view(np.int64), weight[keep]
    o = np.argsort(term)
    owner = np.array([0 if df[x] <= 60 else 1 for x in q[keep][o].tolist()], "u1")
    bundle = pa.table({"bundle": pa.array([0], pa.int32()), "query": [rs._pack([np.array([9], "<i8"), np.zeros(len(o), "<u4"), term[o], weight[o], owner])]})
    built = rs._postings(len(rows), len(doc), 2)((pa.scalar(0), pa.scalar(0)), docs, bundle)
    return built.filter(pa.compute.equal(built["owner"], -1)), built


def _one_stage(add, state, built, k):
    import pyarrow as pa
    postings = built.filter(pa.compute.equal(built["owner"], k))
    plain, rs._add = rs._add, add
    try:
        return rs._stage(k, 2, 20)(None, state, postings), built
    finally:
        rs._add = plain


# conversation trie

def _trie(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [t[2:] for t in sorted(v, key=lambda t: t[:2])] for c, v in convs.items()}
    rebuilt = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = convs.get(c - int(math.fmod(c, 5)), [])[:h] + own[h:]
    nodes = defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    kids = Counter(k[:-1] for k in nodes if k)
    leaves, saved = Counter(), Counter()
    for k, members in nodes.items():
        own = (len(members) - 1) * len(k[-1][1].encode()) if k else 0
        for d in range(len(k) + 1):
            leaves[k[:d]] += k not in kids
            saved[k[:d]] += own
    return Counter((min(m), len(k), min(nodes[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k],
                    sha(",".join(str(c) for c in sorted(m) if len(rebuilt[c]) == len(k)).encode())) for k, m in nodes.items())


def _talks(name):
    r = random.Random(5)
    if name == "sf":
        return [tuple(x.values()) for x in pq.read_table(f"{SF}/conversations.parquet").to_pylist()]
    if name == "bushy":  # many conversations over few turns, ids below zero, gaps
        return [(c, t, "user" if t % 2 == 0 else "assistant", r.choice("ab")) for c in range(-40, 300) if c % 7 for t in range(r.randint(1, 12))]
    if name == "hot":  # a third of all turns in one conversation, and many copies of one
        return [(10, t, "user", f"turn {t}") for t in range(9000)] + [(c, t, "user", f"same {t}") for c in range(100, 1100) for t in range(9)]
    if name == "odd":
        return [(None, 0, "user", "x"), (1, None, None, None), (1, 3, "user", ""), (1, 5, None, "é中"), (2, None, "system", "s" * 100_000),
                (2, -4, "user", "b"), (2, 2**60, "user", "c"), (5, 0, "user", "b"), (5, 1, "user", "b"), (7, 0, "a\x00", "b"), (8, 0, "a", "\x00b"),
                (2**63 - 1, 0, "user", "b"), (-2**63, 0, "user", "b"), (0, 0, "", "")]
    return []


def _trie_frame(spark, name):
    return frame(spark, _talks(name), "conv_id bigint, turn bigint, role string, text string", depth="d", pos="p", k1="k")


@pytest.mark.parametrize("name, cut", [("sf", {}), ("sf", {"light": 2, "queue": 2}), ("bushy", {}), ("bushy", {"light": 3, "queue": 5}),
                                       ("hot", {"light": 40, "queue": 100}), ("odd", {}), ("odd", {"light": 2}), ("empty", {})])
def test_trie_equals_brute_force(spark, name, cut, monkeypatch):
    monkeypatch.setattr(ct, "BLOCK", 64)
    got = ct.trie(_trie_frame(spark, name), **cut).drop("k1", "k2").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    if name == "hot":  # prefixes of 9,000 turns are too much for the brute force; a few totals are known
        by = {(r.conv_id, r.depth): r for r in got.collect()}
        shared = zlib.crc32(b"10") % 9
        assert by[10, 9000].n_convs == 1 and by[10, 9000].n_children == 0 and by[10, 0].n_convs == 1001
        assert by[10, 1].parent_conv_id == 10 and shared >= 0 and len([k for k in by if k[0] == 10]) == 9001
        assert by[100, 9].n_convs == 1000 and by[100, 9].saved_tokens == 999 * 6 and by[100, 1].saved_tokens == 9 * 999 * 6
        assert by[100, 9].ends_sha256 == sha(",".join(map(str, range(100, 1100))).encode())
        return
    assert Counter(map(tuple, got.collect())) == _trie(_talks(name))


def test_equal_turns_have_one_order(spark):
    rows = [(c, 1, "user", x) for c in (5, 6) for x in "abcdefgh"]
    r = random.Random(1)
    got = set()
    for _ in range(3):
        r.shuffle(rows)
        got.add(tuple(sorted(map(tuple, ct.digest(frame(spark, rows, "conv_id bigint, turn bigint, role string, text string")).collect()), key=str)))
    assert len(got) == 1


def test_queue_spills_and_keeps_the_order():
    r = random.Random(3)
    q, want = ct.SpillingQueue(3, limit=7), []
    import heapq
    for _ in range(3000):
        if want and r.random() < 0.45:
            assert q.least() == want[0] and q.pop() == heapq.heappop(want)
        else:
            row = (r.randint(-5, 50), r.randint(-2**63, 2**63 - 1), r.randint(0, 3))
            q.push(row)
            heapq.heappush(want, row)
    assert q.runs and len(q.heap) <= 7
    while want:
        assert q.pop() == heapq.heappop(want)
    assert q.least() is None


# SQL of both

@pytest.mark.parametrize("name", ["op12_ranked_search", "op13_conversation_trie"])
def test_queries_equal_their_sql(spark, name):
    got = queries.QUERIES[name](spark, SF)
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(queries.ORACLE_SQL[name])
    assert [d[0] for d in want.description] == got.columns
    assert Counter(want.fetchall()) == Counter(map(tuple, got.collect()))

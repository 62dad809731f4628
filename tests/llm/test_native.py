"""URL filters, license scan, fingerprints and mixing against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from rankwise.llm import fingerprints, license_scan, mixing, queries, url_filters
from tests.llm.helpers import SF, edge_documents, frame, passage, sf_documents

TABLES = {"sf": sf_documents, "edge": edge_documents, "empty": list, "nulls": lambda: [(None, None)] * 3}
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _native(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return not re.search("Python|Pandas|Arrow", plan)


# url filters

def test_url_filters_equal_their_sql(spark):
    got = queries.op1_url_filters(spark, SF)
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{SF}/pages.parquet'")
    want = con.execute(queries.ORACLE_SQL["op1_url_filters"]).df()
    assert Counter(map(tuple, want[got.columns].astype(object).where(want.notna(), None).values.tolist())) == Counter(
        tuple(r) for r in got.collect())
    assert _native(got)


def test_url_rules_and_addresses(spark):
    urls = [None, "", "no scheme/x", "http://A.Example.NET/en/1?x=1#y", "https://example.net/EN/1", "ftp://net",
            "http://net/", "http://xnet/a", "http://q.org/fr/", "http://sub.example.com/de/9.html", "http://h?x/y",
            "http://h#frag", "a://b://c/d", "http://example.net/en/1"]
    rows = [(i, u) for i, u in enumerate(urls)] + [(13, "http://example.net/en/1"), (None, "http://z.net/x")]
    got = url_filters.judge(frame(spark, rows, "page_id bigint, url string", path="p", verdict="v")).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == len(rows)
    said = {i: (by[i].host, by[i].path, by[i].rule, by[i].verdict) for i in range(len(urls))}
    assert said[0] == said[1] == said[2] == ("", "", None, "allow")
    assert said[3] == ("a.example.net", "/en/1", "example.net/en/", "allow")
    assert said[4] == ("example.net", "/EN/1", "net/", "block")
    assert said[5] == ("net", "", None, "allow") and said[6] == ("net", "/", "net/", "block")
    assert said[7][2] is None and said[8][2:] == ("org/fr/", "allow") and said[9][2:] == ("example.com/de/", "block")
    assert said[10][:2] == ("h", "") and said[11][:2] == ("h", "") and said[12][:2] == ("b:", "//c/d")


def test_url_templates_learn(spark):
    """A host whose articles are blocked: slugs become wildcards and unlabelled articles are rejected, other hosts aren't."""
    rules = [url_filters.Rule("block", "spam.org", f"/a/{c}") for c in "bcdfghjklm"]
    rows = [(i, f"http://spam.org/a/{'bcdfghjklm'[i % 10]}x{passage(i, 1)}") for i in range(200)]
    rows += [(1000 + i, f"http://spam.org/a/z{passage(i, 1)}") for i in range(20)]
    rows += [(2000 + i, f"http://fine.org/a/z{passage(i, 1)}") for i in range(20)]
    got = {r.page_id: r for r in url_filters.judge(frame(spark, rows, "page_id bigint, url string"), rules=rules).collect()}
    assert {got[i].template for i in range(200)} == {"/a/*"}
    assert all(got[1000 + i].verdict == "block" and got[1000 + i].rule is None for i in range(20))
    assert all(got[2000 + i].verdict == "allow" for i in range(20))


def test_url_filters_on_no_pages(spark):
    assert url_filters.judge(frame(spark, [], "page_id bigint, url string")).collect() == []


# license scan

def _scan(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(_LOWER))
    base = {p.label: [i for i in range(len(words)) if words[i:i + len(p.words.split())] == p.words.split()]
            for p in license_scan.BASE_PHRASES}
    joined = " ".join(words)
    found = []
    for n, r in enumerate(license_scan.RULES):
        if f" {r.keyword} " in f" {joined} ":
            for m in re.finditer(rf"(?<![^ ])(?:{r.pattern})(?![^ ])", joined):
                start = joined[:m.start()].count(" ")
                found.append((start, start + m.group().count(" ") + 1, r.priority, n, r.label, r.confidence))
    kept = []
    for a in found:
        inside = [b for b in found if b is not a and b[0] <= a[0] and b[1] >= a[1] and b[2] >= a[2]
                  and ((b[0], b[1], b[2]) != (a[0], a[1], a[2]) or b[3] < a[3])]
        if not inside:
            kept.append(a)
    places = [i for x in base.values() for i in x]
    missed = 1.0
    for _, c in {(a[4], a[5]) for a in kept}:
        missed *= 1 - c
    score = 1 - missed if kept else 0.5 if places else 0.0
    names = {k for k, v in base.items() if v}
    return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(names)),
            ",".join(sorted(names | {a[4] for a in kept})), round(score, 9))


LICENSES = [
    "Licensed under the Apache License, Version 2.0 (the x)", "cc by cc by CC-BY cc by nc 4.0", "all rights reserved",
    "GNU General Public License v3 or GNU general public license version 2.0", "CC by cc\nby", "by cc by",
    "This is the MIT License. Copyright 2020 2021 Permission is hereby granted, free of charge, to any person",
    "creative commons attribution share alike 4.0 international", "public domain in the public domain",
    "released under the terms of the gnu lesser general public license 2.1", "Tous droits réservés", "bsd 3 clause license",
    "general public license " * 300, "x" * 100_000 + " all rights reserved"]


@pytest.mark.parametrize("name", [*TABLES, "licenses"])
def test_license_scan(spark, name):
    rows = list(enumerate(LICENSES)) if name == "licenses" else TABLES[name]()
    df = license_scan.digest(license_scan.scan(frame(spark, rows)))
    got = Counter((*tuple(r)[:-1], round(r.score, 9)) for r in df.collect())
    assert got == Counter((i, *_scan(t)) for i, t in rows)
    assert _native(df)


# fingerprints

def _hash_rows(spark, rows):
    df = fingerprints.with_vector(frame(spark, rows).select("doc_id", "text"), "text", "w", "l")
    return {r.doc_id: r for r in df.select("*", fingerprints.fingerprint("w", "l").alias("fp")).collect()}


@pytest.mark.parametrize("name", TABLES)
def test_fingerprints(spark, name):
    rows = TABLES[name]()
    df = fingerprints.digest(frame(spark, rows))
    got = df.collect()
    line = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1].encode()))
    want = Counter()
    for k, (i, t) in enumerate(line):
        n, after = len(t), line[(k + 1) % len(line)][1]
        edited = t[:n - n // 3] + after[:n // 3]
        want[(i, n, hashlib.sha256(edited.encode()).hexdigest())] += 1
    assert Counter(tuple(r)[:3] for r in got) == want
    assert all(0 <= x <= 1 for r in got for x in (r.near_edited, r.near_next))
    assert _native(df)
    by_text = defaultdict(set)
    for (i, t), r in zip(line, sorted(got, key=lambda r: (r.doc_id is None, -(r.doc_id or 0), r.n_chars)), strict=True):
        if [x for x, _ in line].count(i) == 1:
            by_text[t].add(r.fingerprint)
            assert (r.near_edited == 1.0) == (r.fingerprint == r.edited_fingerprint)
    assert all(len(x) == 1 for x in by_text.values())


def test_fingerprint_order_and_increments(spark):
    a, b, c = (passage(i, 40) + ". " + passage(i + 50, 30) + "." for i in range(3))
    rows = _hash_rows(spark, [(1, f"{a}\n{b}\n{c}"), (2, f"{c}\n\n {a} \n{b}".replace(f" {a} ", a)), (3, f"{a}\n{b}"), (4, c),
                              (5, f"{a}\n{a}\n{b}\n{c}"), (6, f"{a}\n{b}\n{c}x")])
    assert rows[1].fp == rows[2].fp and len({rows[i].fp for i in (1, 3, 4, 5, 6)}) == 5
    df = spark.createDataFrame([(rows[3].w, rows[3].l, rows[4].w, rows[4].l, rows[1].w, rows[1].l)],
                               "w3 array<bigint>, l3 array<bigint>, w4 array<bigint>, "
                               "l4 array<bigint>, w1 array<bigint>, l1 array<bigint>")
    c_ = F.col
    plus = fingerprints.combine(c_("w3"), c_("l3"), c_("w4"), c_("l4"))
    minus = fingerprints.combine(c_("w1"), c_("l1"), c_("w4"), c_("l4"), -1)
    r = df.select(plus[0].alias("pw"), plus[1].alias("pl"), minus[0].alias("mw"), minus[1].alias("ml")).first()
    assert (r.pw, r.pl) == (rows[1].w, rows[1].l) and (r.mw, r.ml) == (rows[3].w, rows[3].l)


def test_likeness_of_any_length_and_kind(spark):
    """Two thirds are kept and a third of another text is put on: about half of the parts of both are shared, more where the kept ones are shorter."""
    said = lambda seed, n: " ".join(passage(10_000 * seed + i, 8) + "." for i in range(n))
    pairs = [(said(1, 20), said(2, 20)), (said(3, 300), said(4, 300)), (said(5, 5000), said(6, 5000)),
             (passage(7, 300), passage(8, 300)), ("Say it again. " * 300, said(9, 100)), ("a, b. " * 700, said(10, 100)),
             (passage(11, 2000).replace(" ", ""), passage(12, 2000).replace(" ", "")), ("x" * 5000, said(13, 100))]
    rows = [(2 * k + 1 - j, t) for k, pair in enumerate(pairs) for j, t in enumerate(pair)]
    got = {r.doc_id: r for r in fingerprints.digest(frame(spark, rows)).collect()}
    assert [k for k in range(len(pairs)) if not 0.35 < got[2 * k + 1].near_edited < 0.7] == []
    # two runs of random letters without a blank also share short pieces by chance
    assert [k for k in range(len(pairs)) if k != 6 and got[2 * k + 1].near_next > 0.05] == []


# mixing

def _targets(sizes, share=1.5):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while True:
        level = left / sum(weight[s] for s in open_) if open_ else 0
        full = {s for s in open_ if 2 * sizes[s] <= weight[s] * level}
        if not full:
            return out | {s: weight[s] * level for s in open_}
        for s in full:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= full


SOURCED = [(i, passage(i, 20 + i % 90), ["a", "b", None, "ä", "Z", "hot"][min(i % 12, 5)]) for i in range(900)]


@pytest.mark.parametrize("rows", [SOURCED, SOURCED[:3], [], [(1, None, "a"), (2, "", None), (2, "", None)],
                                  [(1, passage(1, 300), "a"), (1, passage(1, 300), "a"), (None, passage(2, 200), "b")]],
                         ids=["many", "three", "empty", "no words", "repeated"])
def test_mixing(spark, rows):
    docs = frame(spark, [(i, t, "en", s, len(t or "")) for i, t, s in rows],
                 "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = mixing.digest(docs).collect()
    size = [(i, len((t or "").split()), s) for i, t, s in rows]
    total = defaultdict(int)
    for _, n, s in size:
        total[s] += n
    aim = _targets(total)
    assert Counter((r.doc_id, r.size, r.source_size) for r in got) == Counter((i, n, total[s]) for i, n, s in size)
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    source_of = {i: s for i, _, s in rows}
    taken = defaultdict(int)
    for r in got:
        assert r.target == pytest.approx(aim[source_of[r.doc_id]])
        taken[source_of[r.doc_id]] += r.taken
    for s in total:
        assert abs(taken[s] - aim[s]) <= 4 * mixing.BLOCK_WORDS
    assert Counter(map(tuple, got)) == Counter(tuple(r) for r in mixing.digest(docs.repartition(3)).collect())
    mixed = mixing.mixed_documents(docs).collect()
    text_of = {i: t for i, t, _ in rows}
    assert sum(len(r.text.split()) for r in mixed) == sum(r.taken for r in got)
    assert all(text_of[r.doc_id].startswith(r.text) and r.n_chars == len(r.text) for r in mixed)


def test_schedule_keeps_weights_everywhere(spark):
    aims = mixing.targets(spark.createDataFrame([("a", 6000), ("b", 6000), ("c", 6000)], "source string, source_size bigint"))
    slots = mixing.schedule(spark, aims, 64 * 6000).orderBy("slot").collect()
    share = {r.source: r.target / 27000 for r in aims.collect()}
    for start in range(0, 6000, 500):
        part = Counter(r.source for r in slots[start:start + 500])
        assert all(abs(part[s] - 500 * share[s]) < 6 for s in share)
    for s in share:
        assert sorted(r["rank"] for r in slots if r.source == s) == list(range(sum(r.source == s for r in slots)))

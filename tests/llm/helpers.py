"""Brute-force versions and small tables for the tests of this folder."""

import hashlib
import random

import numpy as np
import pyarrow.parquet as pq

SF = "/root/testdata/sf0.001"
#: Extra columns whose names the operators use inside.
CLASHES = {c: "x" for c in ("uid", "chunk", "bucket", "fp", "words", "parts", "_r", "host", "node", "size", "kept", "score", "n")}


def sha(data):
    return hashlib.sha256(data).hexdigest()


def sf_documents():
    t = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"])
    return list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), strict=True))


def passage(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(n))


def edge_documents():
    """Nulls, empty texts, white space only, odd characters, copies, shared passages, ties, and a long text."""
    shared = passage(1, 70)
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "One"), (5, "one two"), (6, "a b c"), (7, "A B C"),
            (8, passage(2, 120)), (9, passage(2, 120)), (10, "İstanbul K é 中文 \x00x"),
            (11, passage(3, 30) + " " + shared + "\n\n" + passage(4, 30)), (12, shared + " " + passage(5, 10)),
            (13, passage(6, 60) + "\n" + shared), (14, "the same " * 400), (15, passage(7, 30_000)),
            (16, passage(8, 40) + " " + passage(7, 30_000)[1000:9000]), (None, shared + " null id"), (None, None),
            (17, "x" * 5000), (18, "é" * 700), (19, passage(2, 120)), (19, passage(2, 120))]
    return rows


def frame(spark, rows, schema="doc_id bigint, text string", **extra):
    """Rows as a table with ``lang``, ``source``, ``n_chars`` and columns of clashing names."""
    from pyspark.sql import functions as F
    df = spark.createDataFrame(rows, schema)
    if "text" in df.columns and "lang" not in df.columns:
        df = df.withColumn("lang", F.lit("en")).withColumn("source", F.lit("s")).withColumn(
            "n_chars", F.char_length("text").cast("bigint"))
    for k, v in ({**CLASHES, **extra}).items():
        if k not in df.columns:
            df = df.withColumn(k, F.lit(v))
    return df


def roots(n, a, b):
    """Least reachable index of each of ``n`` nodes."""
    label = np.arange(n)
    a, b = np.asarray(a, int), np.asarray(b, int)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def windows_removed(rows, window=50):
    """(words, removed mask) of each row; a null id is later than any other."""
    key = [(i is None, i if i is not None else 0) for i, _ in rows]
    words = [(t or "").encode().split() for _, t in rows]
    first = {}
    for k, w in sorted(zip(key, words, strict=True), key=lambda x: x[0]):
        for s in range(len(w) - window + 1):
            first.setdefault(b" ".join(w[s:s + window]), k)
    out = []
    for k, w in zip(key, words, strict=True):
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if first[b" ".join(w[s:s + window])] < k:
                gone[s:s + window] = [True] * window
        out.append((w, gone))
    return out


def strings_removed(rows, length=400):
    """(bytes, removed mask) of each row; equal rows are one document, but rows without an id are each one."""
    seen, twice = set(), set()
    for _, t in [*dict.fromkeys(x for x in rows if x[0] is not None), *[x for x in rows if x[0] is None]]:
        b = (t or "").encode()
        for s in range(len(b) - length + 1):
            x = b[s:s + length]
            (twice if x in seen else seen).add(x)
    out = []
    for _, t in rows:
        b = (t or "").encode()
        gone, end = bytearray(len(b)), 0
        for s in range(len(b) - length + 1):
            if b[s:s + length] in twice:
                a = max(s, end)
                gone[a:s + length] = b"\1" * (s + length - a)
                end = s + length
        out.append((b, gone))
    return out

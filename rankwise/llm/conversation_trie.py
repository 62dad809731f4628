"""Prefix trie of conversations, its subtree totals by time-forward processing.

Each distinct sequence of first turns is a node.  A node's key is its depth
and a 128-bit sum of hashes of (position, role, text) over its turns, so that
prefixes of a long conversation come from running sums and only hashes move.

Subtree totals go from children to parents.  Nodes are sorted in reverse level
order (Spark's external sort); a node sends its totals forward in "time" to its
parent through a priority queue, which yields them when the parent comes by.
The queue holds ``QUEUE`` messages and spills sorted runs to a scratch file of
the task beyond that.

Nodes are sharded by how many conversations they have: level 0 takes nodes with
at most ``LIGHT``, level 1 those with at most ``LIGHT ** 2``, and so on up to the
level of the root.  A shard is a node whose parent is of a higher level, with
all of its level below it, so it has at most ``LIGHT`` nodes of a depth.  Totals of
shard roots are added up by parent and enter the shards of the parent's level.

Order and rebuilding: turns by ``turn`` (null first), equal turns by hashes of
role and text.  ``share(c)`` says how many first turns conversation ``c`` takes
from conversation ``c - c % 5`` (remainder with the sign of ``c``).

Defined results: rows without ``conv_id`` belong to no conversation; repeated
rows are turns of their own; null role and text are empty; a table without
conversations has no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
import heapq
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankwise.llm.common import salted_join, stored, text_of
from rankwise.operators.ranking import rank_within

GROUP = 5
MOST_SHARED = 8
LIGHT = 1024
#: Messages in memory, and read at once from a spilled run.
QUEUE, READ = 200_000, 4_096
#: Turns of a conversation that one running sum takes.
BLOCK = 4_096
SALTS = 8
PIECE = 1 << 20
NONE_SHA = hashlib.sha256(b"").hexdigest()

KEY = ["depth", "k1", "k2"]
TOTALS = ["n_children", "n_leaves", "saved_tokens"]


class SpillingQueue:
    """Priority queue of rows of integers, least first, that keeps at most ``limit`` of them in memory."""

    def __init__(self, width: int, limit: int = QUEUE) -> None:
        self.width, self.limit = width, limit
        self.heap, self.runs, self.heads = [], [], []

    def push(self, row: tuple) -> None:
        if len(self.heap) >= self.limit:
            self._spill()
        heapq.heappush(self.heap, row)

    def _spill(self) -> None:
        run = tempfile.TemporaryFile()  # the task's own; a task that is run again spills again
        np.array(sorted(self.heap), "<i8").tofile(run)
        run.seek(0)
        self.heap = []
        self.runs.append([run, iter(())])
        self._advance(len(self.runs) - 1)

    def _advance(self, r: int) -> None:
        run, rows = self.runs[r]
        row = next(rows, None)
        if row is None:
            part = run.read(READ * self.width * 8)
            if not part:
                run.close()
                return
            self.runs[r][1] = rows = iter(map(tuple, np.frombuffer(part, "<i8").reshape(-1, self.width).tolist()))
            row = next(rows)
        heapq.heappush(self.heads, (row, r))

    def least(self) -> tuple | None:
        if self.heads and (not self.heap or self.heads[0][0] <= self.heap[0]):
            return self.heads[0][0]
        return self.heap[0] if self.heap else None

    def pop(self) -> tuple:
        if self.heads and (not self.heap or self.heads[0][0] <= self.heap[0]):
            row, r = heapq.heappop(self.heads)
            self._advance(r)
            return row
        return heapq.heappop(self.heap)


def share(conv_id: Column) -> Column:
    """First turns that a conversation takes from the first of its group (0 to 8)."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % (MOST_SHARED + 1)).cast("bigint")


def _first_of(conv_id: Column) -> Column:
    return conv_id - conv_id % GROUP


def _rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns of the rebuilt conversations (``conv_id, depth, t1, t2, bytes, total``), and ``conv_id, total`` of all."""
    role, text = text_of("role"), text_of("text")
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", F.xxhash64(role, text).alias("t1"),
        F.xxhash64(F.lit(1), text, role).alias("t2"), F.octet_length(text).cast("bigint").alias("bytes"))
    own = stored(rank_within(rows, ["conv_id"], ["turn", "t1", "t2"], "pos").select("conv_id", "pos", "t1", "t2", "bytes"))
    sizes = own.groupBy("conv_id").agg(F.count("*").alias("len"))
    plan = sizes.select("conv_id", "len", share(F.col("conv_id")).alias("h"), _first_of(F.col("conv_id")).alias("first"))
    plan = plan.join(sizes.select(F.col("conv_id").alias("first"), F.col("len").alias("first_len")), "first", "left")
    taken = F.least("h", F.coalesce("first_len", F.lit(0)))
    plan = stored(plan.select("conv_id", "h", taken.alias("taken"), (taken + F.greatest(F.col("len") - F.col("h"), F.lit(0))).alias("total")))
    tail = salted_join(own, plan, ["conv_id"], "pos", "inner", SALTS).where("pos > h").withColumn("depth", F.col("pos") - F.col("h") + F.col("taken"))
    near = F.array(*[F.lit(k) for k in range(1 - GROUP, GROUP)])
    head = own.where((F.col("pos") <= MOST_SHARED) & (F.col("conv_id") % GROUP == 0)).withColumn("k", F.explode(near))
    head = head.withColumn("to", F.try_add("conv_id", F.col("k").cast("bigint"))).where(
        (_first_of(F.col("to")) == F.col("conv_id")) & (F.col("pos") <= share(F.col("to"))))
    head = head.drop("conv_id").withColumnRenamed("to", "conv_id").join(plan.select("conv_id", "total"), "conv_id")
    names = ["conv_id", "depth", "t1", "t2", "bytes", "total"]
    return tail.select(*names).union(head.withColumn("depth", F.col("pos")).select(*names)), plan.select("conv_id", "total")


def _members(turns: DataFrame) -> DataFrame:
    """Each conversation at each depth, with the keys of its node and of the parent."""
    e1, e2 = F.xxhash64("depth", "t1", "t2"), F.xxhash64(F.lit(7), "t2", "depth", "t1")
    mask = F.lit((1 << 32) - 1)
    parts = [F.shiftrightunsigned(e1, 32), e1.bitwiseAND(mask), F.shiftrightunsigned(e2, 32), e2.bitwiseAND(mask)]
    rows = turns.withColumns({f"e{i}": p for i, p in enumerate(parts)}).withColumn("block", F.floor(F.col("depth") / BLOCK))
    sums = rows.groupBy("conv_id", "block").agg(*[F.sum(f"e{i}").alias(f"b{i}") for i in range(4)])
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("conv_id", "block", *[F.coalesce(F.sum(f"b{i}").over(before), F.lit(0)).alias(f"b{i}") for i in range(4)])
    inside = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"s{i}": F.sum(f"e{i}").over(inside) for i in range(4)}).join(sums, ["conv_id", "block"])
    upto = [F.col(f"s{i}") + F.col(f"b{i}") for i in range(4)]

    def pair(x: Column, y: Column) -> Column:
        return F.shiftleft(x.bitwiseAND(mask), 32).bitwiseOR(y.bitwiseAND(mask))

    above = [u - F.col(f"e{i}") for i, u in enumerate(upto)]
    return rows.select("conv_id", F.col("depth").cast("bigint").alias("depth"), pair(*upto[:2]).alias("k1"), pair(*upto[2:]).alias("k2"),
                       pair(*above[:2]).alias("p1"), pair(*above[2:]).alias("p2"), "bytes", "total")


def _level(n: Column, light: int, levels: int) -> Column:
    out = F.lit(levels - 1)
    for k in reversed(range(levels - 1)):
        out = F.when(n <= light ** (k + 1), k).otherwise(out)
    return out


def _nodes(members: DataFrame, convs: DataFrame, light: int, levels: int) -> DataFrame:
    """Nodes with their parent's id and level, and the shard in their level."""
    nodes = members.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("p1").alias("p1"),
                                      F.min("p2").alias("p2"), F.max("bytes").alias("bytes"))
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").select(
        *[F.lit(0).cast("bigint").alias(c) for c in KEY], "conv_id", "n_convs",
        *[F.lit(None).cast("bigint").alias(c) for c in ("p1", "p2")], F.lit(0).cast("bigint").alias("bytes"))
    nodes = stored(nodes.union(root))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"),
                           F.col("conv_id").alias("parent_conv_id"), _level(F.col("n_convs"), light, levels).alias("parent_level"))
    nodes = salted_join(nodes, parents, ["depth", "p1", "p2"], "k1", "left", SALTS).withColumn("level", _level(F.col("n_convs"), light, levels))
    nodes = nodes.withColumn("is_root", F.coalesce(F.col("parent_level") > F.col("level"), F.lit(True)))
    if levels == 1:
        return stored(nodes.withColumn("shard", F.lit(0).cast("bigint")))
    nodes = stored(nodes)
    # which shard a conversation's path enters in each level below the root's
    own = F.xxhash64(*KEY)
    entered = nodes.where(F.col("is_root") & (F.col("level") < levels - 1)).select(*KEY, "level")
    asked = nodes.where(~F.col("is_root") & (F.col("level") < levels - 1)).select("conv_id").distinct()
    paths = members.select("conv_id", *KEY).join(asked, "conv_id", "left_semi")
    paths = salted_join(paths, entered, KEY, "conv_id", "inner", SALTS).select("conv_id", "level", own.alias("shard"))
    inner = salted_join(nodes.where(~F.col("is_root") & (F.col("level") < levels - 1)), paths, ["conv_id", "level"], "k1", "inner", SALTS)
    rest = nodes.where(F.col("is_root") | (F.col("level") == levels - 1)).withColumn(
        "shard", F.when(F.col("level") == levels - 1, 0).otherwise(own))
    return stored(inner.unionByName(rest))


_ROW = [*KEY, "p1", "p2", "is_root", "own", "c", "l", "s"]
_CARRY = ["conv_id", "parent_conv_id", "n_convs", "parent_level", "is_root", "p1", "p2"]


def _forward(queue: int):
    """Adds subtree totals to nodes that come in reverse level order, whole shards together."""
    def run(batches):
        waiting = SpillingQueue(5, queue)
        for b in batches:
            done = [[], [], []]
            cols = [b.column(b.schema.get_field_index(c)).to_pylist() for c in _ROW]
            for depth, k1, k2, p1, p2, is_root, own, children, leaves, saved in zip(*cols, strict=True):
                key, saved = (-depth, k1, k2), saved + own
                while (row := waiting.least()) is not None and row[:3] == key:
                    waiting.pop()
                    children, leaves, saved = children + 1, leaves + row[3], saved + row[4]
                if not children:
                    leaves = 1
                if not is_root:
                    waiting.push((1 - depth, p1, p2, leaves, saved))
                for out, x in zip(done, (children, leaves, saved), strict=True):
                    out.append(x)
            yield pa.RecordBatch.from_arrays(
                [*[b.column(b.schema.get_field_index(c)) for c in (*KEY, *_CARRY)], *[pa.array(x, pa.int64()) for x in done]],
                names=[*KEY, *_CARRY, *TOTALS])
    return run


def _totals(nodes: DataFrame, levels: int, queue: int) -> DataFrame:
    kinds = {f.name: f.dataType.simpleString() for f in nodes.schema}
    schema = ", ".join([*[f"{c} {kinds[c]}" for c in (*KEY, *_CARRY)], *[f"{c} bigint" for c in TOTALS]])
    out, sent = None, None
    for k in range(levels):
        rows = nodes.where(F.col("level") == k).withColumn("own", (F.col("n_convs") - 1) * F.col("bytes"))
        if sent is None:
            rows = rows.withColumns({c: F.lit(0).cast("bigint") for c in ("c", "l", "s")})
        else:
            got = sent.where(F.col("parent_level") == k).groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(
                F.count("*").alias("c"), F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"))
            rows = rows.join(got, KEY, "left").fillna(0, ["c", "l", "s"])
        done = rows.select("shard", *_ROW, *[c for c in _CARRY if c not in _ROW]).repartition("shard").sortWithinPartitions(
            F.desc("depth"), "k1", "k2").mapInArrow(_forward(queue), schema)
        done = stored(done)
        out = done if out is None else out.union(done)
        roots = done.where("is_root and depth > 0")
        sent = roots if sent is None else sent.union(roots)
    return out


def _ends(members: DataFrame, convs: DataFrame) -> DataFrame:
    """SHA-256 of the ids that end at each node; a node's ids are sorted over tasks and hashed as a stream of pieces."""
    rows = members.where("depth = total").select(*KEY, "conv_id").union(
        convs.where("total = 0").select(*[F.lit(0).cast("bigint").alias(c) for c in KEY], "conv_id"))

    def pieces(batches):
        for b in batches:
            key = list(zip(*[b.column(i).to_pylist() for i in range(3)], strict=True))
            ids, out, i = b.column(3).to_pylist(), [], 0
            while i < len(ids):
                j, size = i, 0
                while j < len(ids) and key[j] == key[i] and size < PIECE:
                    size += len(str(ids[j])) + 1
                    j += 1
                out.append((*key[i], ids[i], ",".join(map(str, ids[i:j])).encode()))
                i = j
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols[:4]], pa.array(cols[4], pa.binary())],
                                             names=[*KEY, "first", "piece"])

    def digest(batches):
        now, sha = None, None
        for b in batches:
            out = []
            for *key, piece in zip(*[b.column(i).to_pylist() for i in (0, 1, 2, 4)], strict=True):
                if key != now:
                    if now:
                        out.append((*now, sha.hexdigest()))
                    now, sha = key, hashlib.sha256(piece)
                else:
                    sha.update(b"," + piece)
            yield _digests(out)
        if now:
            yield _digests([(*now, sha.hexdigest())])

    order = [*KEY, "conv_id"]
    cut = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        pieces, "depth bigint, k1 bigint, k2 bigint, first bigint, piece binary")
    return cut.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(
        digest, "depth bigint, k1 bigint, k2 bigint, ends_sha256 string")


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.string())],
                                      names=[*KEY, "ends_sha256"])


def trie(conversations: DataFrame, *, light: int = LIGHT, queue: int = QUEUE) -> DataFrame:
    """``conv_id, turn, role, text`` -> a row per node of the trie of the rebuilt conversations, key columns included."""
    turns, convs = _rebuilt(conversations)
    members = stored(_members(turns))
    levels, n = 1, convs.count()
    while light ** levels < n:
        levels += 1
    nodes = _nodes(members, convs, light, levels)
    out = _totals(nodes, levels, queue).join(_ends(members, convs), KEY, "left")
    return out.select(*KEY, "conv_id", "parent_conv_id", "n_convs", *TOTALS,
                      F.coalesce("ends_sha256", F.lit(NONE_SHA)).alias("ends_sha256"))


def digest(conversations: DataFrame) -> DataFrame:
    """The contract's columns."""
    return trie(conversations).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


ORACLE_SQL = """
WITH own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
conv AS (
  SELECT conv_id, count(*) AS len,
         xor(4294967295, list_reduce(
           list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
           lambda x, y: CASE WHEN y >= 0 THEN xor(x, y) ELSE xor(x >> 1, 3988292384 * (x & 1)) END)) % 9 AS h
  FROM own GROUP BY conv_id),
rebuilt AS (
  SELECT conv.conv_id, pos AS depth, role, text FROM conv JOIN own ON own.conv_id = conv.conv_id - conv.conv_id % 5 AND pos <= h
  UNION ALL
  SELECT own.conv_id, pos - conv.h + least(conv.h, coalesce(b.len, 0)), role, text
  FROM own JOIN conv USING (conv_id) LEFT JOIN conv b ON b.conv_id = own.conv_id - own.conv_id % 5 WHERE pos > conv.h),
member AS (
  SELECT conv_id, depth, strlen(text) AS bytes, max(depth) OVER (PARTITION BY conv_id) AS total,
         md5(string_agg(md5(md5(role) || md5(text)), '') OVER (PARTITION BY conv_id ORDER BY depth)) AS key
  FROM rebuilt
  UNION ALL
  SELECT conv_id, 0, 0, coalesce((SELECT max(depth) FROM rebuilt r WHERE r.conv_id = conv.conv_id), 0), '' FROM conv),
linked AS (SELECT *, lag(key) OVER (PARTITION BY conv_id ORDER BY depth) AS parent FROM member),
node AS (
  SELECT depth, key, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE depth = total), '')) AS ends_sha256
  FROM linked GROUP BY depth, key),
child AS (SELECT depth - 1 AS depth, parent AS key, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY ALL),
full_node AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN child USING (depth, key)),
below AS (
  SELECT m.depth, m.key, count(*) FILTER (WHERE d.n_children = 0) AS n_leaves, sum((d.n_convs - 1) * d.bytes) AS saved
  FROM full_node d JOIN member m ON m.conv_id = d.conv_id AND m.depth <= d.depth GROUP BY m.depth, m.key)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs, n.n_children::BIGINT AS n_children,
       n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, n.ends_sha256
FROM full_node n JOIN below USING (depth, key) LEFT JOIN node p ON p.depth = n.depth - 1 AND p.key = n.parent
"""

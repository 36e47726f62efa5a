"""Prefix trie of conversations as a node table behind minimal perfect hashes.

1. *Digests.*  A turn at depth d is hashed with its depth into four lanes; a prefix's digest is the running sum of its
   turns' lanes.  Running sums come from an ordered scan over narrow rows, so one endless conversation is spread over
   many tasks.
2. *Nodes.*  Distinct digests are the nodes: members, smallest member and ends are partial aggregates.
3. *Shards.*  A node's weight is the number of prefixes below it, itself included.  The highest nodes of at most
   ``SHARD_ROWS`` prefixes are the roots of the shards' subtrees; what lies above them (long, crowded paths) is the top.
4. *Slots.*  Each shard builds a minimal perfect hash over its digests.  Every level of it keeps only places hit once, so
   slots are free of collisions by check, and a lookup compares the digest kept in the slot.  Counts are scattered into
   flat arrays by slot, parents are looked up once, and sums climb through the array of parent slots, deepest first.
5. *Top.*  Its nodes take the shards' sums; theirs climb by pointer doubling, in as many rounds as the logarithm of
   the top's depth.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.llm.shared import run_edges, shuffle_partitions, stored
from sheaf.plans.ordered import ordered_scan

SHARD_ROWS = 4096
BUCKET_NODES = 20_000
CHUNK_IDS = 4096
_LANE = 1 << 32
EMPTY = hashlib.sha256(b"").hexdigest()


class PerfectHash:
    """Slots 0 to n - 1 for n different 128-bit digests ``(a, b)``; each level keeps the places that one digest hits."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        rest, taken = np.arange(len(a)), 0
        while len(rest):
            if len(self.levels) == 64:
                raise ValueError("two nodes of a shard have the same digest")
            size = max(64, 2 * len(rest))
            place = _place(a[rest], b[rest], len(self.levels), size)
            once = np.bincount(place, minlength=size) == 1
            self.levels.append((once, taken - 1 + np.cumsum(once)))
            taken += int(once.sum())
            rest = rest[~once[place]]
        self.a, self.b = np.zeros(taken, np.int64), np.zeros(taken, np.int64)
        slot = self._slots(a, b)
        self.a[slot], self.b[slot] = a, b
        if len(np.unique(slot)) != len(a) or taken != len(a):
            raise ValueError("slots collide")

    def _slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out, rest = np.full(len(a), -1, np.int64), np.arange(len(a))
        for level, (once, slot) in enumerate(self.levels):
            place = _place(a[rest], b[rest], level, len(once))
            hit = once[place]
            out[rest[hit]] = slot[place[hit]]
            rest = rest[~hit]
        return out

    def lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The slot of each digest, -1 for those that are not in the table."""
        slot = self._slots(a, b)
        known = slot >= 0
        known[known] = (self.a[slot[known]] == a[known]) & (self.b[slot[known]] == b[known])
        return np.where(known, slot, -1)


def _place(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
    h = a.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.view(np.uint64) + np.uint64(level * 0xA0761D6478BD642F % (1 << 64))
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ h >> np.uint64(29)) * np.uint64(0x94D049BB133111EB)
    return ((h ^ h >> np.uint64(32)) % np.uint64(size)).astype(np.int64)


def turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, position, identity, bytes`` of every turn: positions from 1 by turn (null first, equal ones by their
    digests); null role or text is empty.  Rows without a ``conv_id`` belong to no conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    narrow = conversations.filter("conv_id IS NOT NULL").select(
        "conv_id", "turn", F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)).alias("identity"),
        F.octet_length(text).cast("long").alias("bytes"))
    placed = ordered_scan(narrow, ["conv_id"], ["turn", "identity"], pos="position")
    return stored(placed.drop("turn"), "turns")


def branched(placed: DataFrame, family: int = 5, heads: int = 9) -> DataFrame:
    """Conversations rebuilt as branches: of c, the first h turns of c - c % ``family`` (all if it has fewer, none if it
    is not there), then c's own turns after its first h; h = crc32(decimal c) % ``heads``.

    ``placed`` is from ``turns``.  Rows ``conv_id, depth, length, identity, bytes``, and one of depth 0 for every
    conversation, those without a turn left too.
    """
    own = placed.groupBy("conv_id").agg(F.count("*").alias("n"))
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    own = own.select("conv_id", "n", head.alias("h"), (F.col("conv_id") - F.col("conv_id") % family).alias("base"))
    base = own.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    taken = F.least("h", F.coalesce("base_n", F.lit(0)))
    plan = own.join(base, "base", "left").select("conv_id", "base", "h", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))
    plan = stored(plan, "plan")
    kept = placed.join(plan.drop("base"), "conv_id").filter("position > h").select(
        "conv_id", (F.col("position") - F.col("h") + F.col("taken")).alias("depth"), "length", "identity", "bytes")
    first = placed.filter(F.col("position") < heads).withColumnRenamed("conv_id", "base")
    lent = first.join(plan, "base").filter("position <= taken").select("conv_id", F.col("position").alias("depth"), "length", "identity", "bytes")
    start = plan.select("conv_id", F.lit(0).cast("long").alias("depth"), "length", F.unhex(F.lit("")).alias("identity"), F.lit(0).cast("long").alias("bytes"))
    return kept.unionByName(lent).unionByName(start)


def prefixes(paths: DataFrame) -> DataFrame:
    """``paths`` (``conv_id, depth, length, identity, bytes``; a row of depth 0 for each) with the digests ``a, b`` of the
    prefix that ends there and ``pa, pb`` of the one before, in place of ``identity``; stored."""
    digest = F.sha2(F.concat("identity", F.col("depth").cast("string").cast("binary")), 256)
    lanes = [F.when(F.col("depth") == 0, F.lit(0)).otherwise(F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long")).alias(f"l{i}") for i in range(4)]
    rows = paths.select("conv_id", "depth", "length", "bytes", *lanes)
    summed = ordered_scan(rows, ["conv_id"], ["depth"], cumsum={f"s{i}": f"l{i}" for i in range(4)})
    def pair(hi: Column, lo: Column) -> Column:
        return F.shiftleft(F.pmod(hi, F.lit(_LANE // 2)), 32) + F.pmod(lo, F.lit(_LANE))
    s, l = ([F.col(f"{x}{i}") for i in range(4)] for x in "sl")
    return stored(summed.select(
        "conv_id", "depth", "length", "bytes", pair(s[0], s[1]).alias("a"), pair(s[2], s[3]).alias("b"),
        pair(s[0] - l[0], s[1] - l[1]).alias("pa"), pair(s[2] - l[2], s[3] - l[3]).alias("pb")), "prefixes")


def accumulate(table: pa.Table) -> pa.Table:
    """One bucket of whole subtrees: children, leaves and saved bytes below each node, and its parent's ``conv_id`` where
    the parent is in the bucket."""
    a, b, pa_, pb, depth, own, conv = (table.column(c).to_numpy() for c in ("a", "b", "pa", "pb", "depth", "saved", "conv_id"))
    table_ = PerfectHash(a, b)
    slot = table_.lookup(a, b)
    n = len(a)
    parent, level, saved, convs = (np.zeros(n, np.int64) for _ in range(4))
    parent[slot] = np.where(depth > 0, table_.lookup(pa_, pb), -1)  # the root and its parent have the same digest
    level[slot], saved[slot], convs[slot] = depth, own, conv
    inside = parent >= 0
    children = np.bincount(parent[inside], minlength=n)
    leaves = (children == 0).astype(np.int64)
    order = np.flatnonzero(inside)
    order = order[np.argsort(-level[order], kind="stable")]
    edges = run_edges(level[order])
    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        at = order[lo:hi]
        np.add.at(leaves, parent[at], leaves[at])
        np.add.at(saved, parent[at], saved[at])
    above = pa.array(convs[np.maximum(parent, 0)][slot], mask=~inside[slot])
    out = table.select(["a", "b", "pa", "pb", "conv_id", "depth", "n_convs"])
    for name, column in (("n_children", children[slot]), ("n_leaves", leaves[slot]), ("saved_tokens", saved[slot]), ("parent_conv_id", above)):
        out = out.append_column(name, column if isinstance(column, pa.Array) else pa.array(column))
    return out


_NODE = "a long, b long, pa long, pb long, conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved_tokens long, parent_conv_id long"


def trie(rows: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The nodes of ``rows`` (``prefixes``), with their digests: ``a, b, conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens``.

    A node is a distinct prefix, the root included; its members are the conversations that start with it, ``conv_id`` is
    the smallest.  Sums cover its subtree, itself included.  An empty table gives no node.
    """
    spark = rows.sparkSession
    nodes = stored(rows.groupBy("a", "b").agg(
        F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.count("*").alias("n_convs"), F.min("pa").alias("pa"), F.min("pb").alias("pb"),
        F.sum(F.col("length") - F.col("depth") + 1).alias("weight"), ((F.count("*") - 1) * F.min("bytes")).alias("saved")), "nodes")
    top = stored(nodes.filter(F.col("weight") > shard_rows), "top")
    # a conversation's subtree starts below its deepest node of the top
    deepest = rows.join(top.select("a", "b"), ["a", "b"], "left_semi").groupBy("conv_id").agg(F.max("depth").alias("deepest"))
    roots = rows.join(deepest, "conv_id", "left").filter(F.col("depth") == F.coalesce("deepest", F.lit(-1)) + 1).select(
        "conv_id", F.col("a").alias("ra"), F.col("b").alias("rb"))
    buckets = max(shuffle_partitions(spark), -(-nodes.count() // BUCKET_NODES))
    low = nodes.filter(F.col("weight") <= shard_rows).join(roots, "conv_id")
    wide = ["a", "b", "pa", "pb", "conv_id", "depth", "n_convs", "saved"]
    low = low.select(F.pmod(F.xxhash64("ra", "rb"), F.lit(buckets)).alias("bucket"), *wide)
    below = stored(low.groupBy("bucket").applyInArrow(lambda t: accumulate(t.select(wide)), _NODE), "below")
    high = _top(top, below)
    over = high.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("__over"))
    columns = ["a", "b", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    every = below.unionByName(high).join(over, ["pa", "pb"], "left")
    parent = F.when(F.col("depth") > 0, F.coalesce("parent_conv_id", "__over"))
    return every.withColumn("parent_conv_id", parent).select(columns)


def _top(top: DataFrame, below: DataFrame) -> DataFrame:
    """The nodes of the top in the columns of ``below``, with what hangs below them added up."""
    hanging = below.filter("parent_conv_id IS NULL AND depth > 0").groupBy("pa", "pb").agg(
        F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("kept"), F.count("*").alias("light"))
    inner = top.filter("depth > 0").groupBy("pa", "pb").agg(F.count("*").alias("heavy"))
    key = [F.col("pa").alias("a"), F.col("pb").alias("b")]
    zero = F.lit(0).cast("long")
    now = top.join(hanging.select(*key, "leaves", "kept", "light"), ["a", "b"], "left").join(inner.select(*key, "heavy"), ["a", "b"], "left")
    children = F.coalesce("light", zero) + F.coalesce("heavy", zero)
    now = now.select("a", "b", "pa", "pb", "conv_id", "depth", "n_convs", children.alias("n_children"),
                     (F.coalesce("leaves", zero) + (children == 0).cast("long")).alias("n_leaves"),
                     (F.col("saved") + F.coalesce("kept", zero)).alias("saved_tokens"), F.lit(None).cast("long").alias("parent_conv_id"),
                     F.when(F.col("depth") > 0, F.struct(F.col("pa").alias("a"), F.col("pb").alias("b"))).alias("jump"))
    now = stored(now, "top")
    deep, reach = now.agg(F.max("depth")).first()[0] or 0, 1
    while reach <= deep:  # sums hold what is less than `reach` steps below; `jump` is the node that far above
        got = now.filter("jump IS NOT NULL").groupBy("jump").agg(F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("kept"))
        far = now.select(F.struct("a", "b").alias("jump"), F.col("jump").alias("next"))
        now = (now.join(got.select("jump.a", "jump.b", "leaves", "kept"), ["a", "b"], "left").join(far, "jump", "left")
               .withColumn("n_leaves", F.col("n_leaves") + F.coalesce("leaves", zero))
               .withColumn("saved_tokens", F.col("saved_tokens") + F.coalesce("kept", zero))
               .withColumn("jump", F.col("next")).drop("next", "leaves", "kept"))
        now = stored(now, "top")
        reach *= 2
    return now.drop("jump")


def ends(rows: DataFrame) -> DataFrame:
    """``a, b, ends_sha256`` of every node where a conversation ends: the hash of their ids, ascending, joined by commas.

    Ids are joined to texts of many ids where they lie; one task streams the texts of a node and holds one at a time.
    """
    spark = rows.sparkSession
    last = rows.filter("depth = length").select("a", "b", "conv_id")
    ranged = last.repartitionByRange(shuffle_partitions(spark), "a", "b", "conv_id").sortWithinPartitions("a", "b", "conv_id")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, conv = (batch.column(i).to_numpy() for i in range(3))
            edges = run_edges(a, b, np.arange(len(a)) // CHUNK_IDS)
            texts = [",".join(map(str, conv[lo:hi].tolist())) for lo, hi in zip(edges[:-1], edges[1:], strict=True)]
            at = edges[:-1]
            yield pa.RecordBatch.from_arrays([pa.array(a[at]), pa.array(b[at]), pa.array(conv[at]), pa.array(texts, pa.string())], ["a", "b", "first", "ids"])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            out = []
            for a, b, ids in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "ids")), strict=True):
                if (a, b) != key:
                    if key is not None:
                        out.append((*key, state.hexdigest()))
                    key, state = (a, b), hashlib.sha256(ids.encode())
                else:
                    state.update(f",{ids}".encode())
            if out:
                yield _hashes(out)
        if key is not None:
            yield _hashes([(*key, state.hexdigest())])

    chunks = ranged.mapInArrow(join, "a long, b long, first long, ids string")
    return chunks.repartition("a", "b").sortWithinPartitions("a", "b", "first").mapInArrow(stream, "a long, b long, ends_sha256 string")


def _hashes(out: list[tuple]) -> pa.RecordBatch:
    columns = zip(*out, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string()), strict=True)], ["a", "b", "ends_sha256"])


def branched_trie(conversations: DataFrame) -> DataFrame:
    """All nodes of the rebuilt conversations (``branched``) with the hash of the members that end there."""
    rows = prefixes(branched(turns(conversations)))
    nodes = trie(rows).join(ends(rows), ["a", "b"], "left")
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                        F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))


#: DuckDB SQL of ``branched_trie``: prefixes as texts, subtrees through the members' paths.
SQL = r"""
WITH clean AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
placed AS (
  SELECT conv_id, concat(strlen(role), ':', strlen(text), ':', role, text) AS said, CAST(strlen(text) AS BIGINT) AS bytes,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(concat(strlen(role), ':', role, text))) AS i
  FROM clean),
own AS (
  SELECT conv_id, n, conv_id - conv_id % 5 AS base,
         xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
               lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
             lambda crc, x: CASE WHEN x >= 0 THEN xor(crc, x)
                                 ELSE xor(crc >> 1, CASE WHEN crc & 1 = 1 THEN 3988292384 ELSE 0 END) END), 4294967295) % 9 AS h
  FROM (SELECT conv_id, count(*) AS n FROM placed GROUP BY conv_id)),
plan AS (
  SELECT a.conv_id, a.base, a.h, least(a.h, coalesce(b.n, 0)) AS taken, least(a.h, coalesce(b.n, 0)) + greatest(a.n - a.h, 0) AS length
  FROM own a LEFT JOIN own b ON b.conv_id = a.base),
rebuilt AS (
  SELECT conv_id, i - h + taken AS depth, said, bytes FROM placed JOIN plan USING (conv_id) WHERE i > h
  UNION ALL
  SELECT q.conv_id, i AS depth, said, bytes FROM placed p JOIN plan q ON q.base = p.conv_id WHERE i <= taken
  UNION ALL
  SELECT conv_id, 0, '', 0 FROM plan),
paths AS (
  SELECT conv_id, depth, bytes, length, sha256(string_agg(said, '') OVER w) AS node,
         sha256(coalesce(string_agg(said, '') OVER (PARTITION BY conv_id ORDER BY depth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '')) AS above
  FROM rebuilt JOIN plan USING (conv_id) WINDOW w AS (PARTITION BY conv_id ORDER BY depth)),
nodes AS (
  SELECT node, depth, min(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(bytes) AS saved,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE depth = length), '')) AS ends_sha256
  FROM paths GROUP BY node, depth),
children AS (SELECT above AS node, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
below AS (
  SELECT u.node, u.depth, count(*) FILTER (WHERE c.node IS NULL) AS n_leaves, CAST(sum(v.saved) AS BIGINT) AS saved_tokens
  FROM nodes v JOIN paths u ON u.conv_id = v.conv_id AND u.depth <= v.depth LEFT JOIN children c ON c.node = v.node AND c.depth = v.depth
  GROUP BY ALL)
SELECT n.conv_id, n.depth, CASE WHEN n.depth > 0 THEN p.conv_id END AS parent_conv_id, n.n_convs, coalesce(c.n_children, 0) AS n_children,
       b.n_leaves, b.saved_tokens, n.ends_sha256
FROM nodes n JOIN below b ON b.node = n.node AND b.depth = n.depth LEFT JOIN children c ON c.node = n.node AND c.depth = n.depth
     LEFT JOIN nodes p ON p.node = n.above AND p.depth = n.depth - 1
"""

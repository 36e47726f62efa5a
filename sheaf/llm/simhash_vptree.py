"""SimHash near-duplicates by vantage-point trees.

A fingerprint is the bitwise majority of the XXH64 values of a text's word shingles.  Texts whose fingerprints
differ in at most ``max_bits`` bits are linked, exactly; components are the transitive closure.

How the pairs are found:

1. *Shards.*  A pair within ``max_bits`` agrees wholly on one of ``max_bits + 1`` bands of the 64 bits.  A shard
   holds the fingerprints at distance 0 from one band value: the one radius at which no shard boundary overlaps.
2. *Distributed vantage points.*  A shard over ``max_shard`` fingerprints is cut by the Hamming distance to a
   vantage point of its own at about the median.  Fingerprints within ``max_bits`` of that boundary also visit the
   other side, so every pair meets in some part.  Repeated until the parts are small, or dense.
3. *Trees in the tasks.*  Each part is searched by a vantage-point tree over numpy arrays with the same bounds;
   parts without members of their own are pruned.  A part that distances cannot divide (a dense ball) is walked
   breadth first, which visits each fingerprint once.

Only a spanning forest of each shard leaves a task, never all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.shared import binary_values, connected, free_name, row_key, run_edges, shuffle_partitions, stored, whole_groups

SEED = 42
BITS = 64
LEAF = 512
MAX_SHARD = 200_000
_CHUNK = 1 << 15


def fingerprint(text: bytes | None, shingle: int = 4) -> int:
    """The 64-bit SimHash of one text; 0 where it has no word."""
    words = text.lower().split() if text else []  # bytes: A-Z lower-cased, split at \x20 and \x09-\x0D
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)[: len(words) - shingle + 1]
    ends = ends[shingle - 1:]
    digest, ones = xxhash.xxh64_intdigest, np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(starts), _CHUNK):
        spans = zip(starts[at:at + _CHUNK].tolist(), ends[at:at + _CHUNK].tolist(), strict=True)
        h = np.array([digest(joined[s:e], SEED) for s, e in spans], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``__fp`` (signed long) of every row of ``docs``."""
    source = docs.select(*keep, F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(x, shingle) for x in binary_values(batch.column(len(keep)))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fp.view(np.int64))], [*keep, "__fp"])

    schema = source.drop("__text").schema.add("__fp", "long")
    return source.mapInArrow(run, schema)


def _near(points: np.ndarray, others: np.ndarray, bits: int) -> np.ndarray:
    return np.bitwise_count(points[:, None] ^ others[None, :]) <= bits


def _forest(points: np.ndarray, home: np.ndarray, bits: int, out: list[np.ndarray]) -> None:
    """Append edges (rows of two fingerprints) that connect what lies within ``bits``; see the module's step 3."""
    if len(points) < 2 or not home.any():
        return
    if len(points) <= LEAF:
        near = _near(points, points, bits)
        if np.count_nonzero(near) == len(points):
            return
        label = np.arange(len(points))
        while True:
            low = np.where(near, label[None, :], len(points)).min(axis=1)
            if (low == label).all():
                break
            label = low
        linked = label != np.arange(len(points))
        out.append(np.stack([points[linked], points[label[linked]]], axis=1))
        return
    vantage = points[len(points) // 2]
    far = np.bitwise_count(points ^ vantage).astype(np.int64)
    radius = int(np.median(far))
    inner, outer = far <= radius + bits, far > radius - bits
    if max(inner.sum(), outer.sum()) > 0.95 * len(points):
        _walk(points, bits, out)
        return
    _forest(points[inner], (home & (far <= radius))[inner], bits, out)
    _forest(points[outer], (home & (far > radius))[outer], bits, out)


def _walk(points: np.ndarray, bits: int, out: list[np.ndarray]) -> None:
    left = points
    while len(left):
        root, todo, left = left[0], [left[:1]], left[1:]
        while todo and len(left):
            block = todo.pop()
            for at in range(0, len(block), 64):
                hit = np.zeros(len(left), dtype=bool)
                for p in block[at:at + 64]:
                    hit |= np.bitwise_count(left ^ p) <= bits
                if hit.any():
                    found = left[hit]
                    out.append(np.stack([found, np.full(len(found), root)], axis=1))
                    todo.append(found)
                    left = left[~hit]


def _split_shards(shards: DataFrame, bits: int, max_shard: int, rounds: int = 32) -> DataFrame:
    """Step 2: cut shards over ``max_shard`` by distance to a vantage point, with visitors on the boundary."""
    keys = ["band", "value", "part"]
    for _ in range(rounds):
        sizes = shards.groupBy(*keys).agg(F.count("*").alias("n"),
                                          F.expr("min_by(fp, xxhash64(fp))").alias("vantage"))
        large = stored(sizes.filter((F.col("n") > max_shard) & ~F.col("part").endswith("=")), "large")
        if large.isEmpty():
            return shards
        far = F.bit_count(F.col("fp").bitwiseXOR(F.col("vantage")))
        hot = shards.join(large, keys).withColumn("far", far)
        radius = hot.groupBy(*keys).agg(F.percentile_approx("far", 0.5).alias("radius"))
        hot = hot.join(radius, keys).withColumn("sides", F.concat(
            F.when(F.col("far") <= F.col("radius") + bits, F.array(F.lit("<"))).otherwise(F.array().cast("array<string>")),
            F.when(F.col("far") > F.col("radius") - bits, F.array(F.lit(">"))).otherwise(F.array().cast("array<string>"))))
        sides = hot.select("band", "value", "part", "n", "fp", F.explode("sides").alias("side")).withColumn(
            "new", F.concat("part", "side"))
        count = sides.groupBy("band", "value", "new").agg(F.count("*").alias("now"), F.first("n").alias("was"))
        # a part that kept nearly all of its rows is dense: '=' leaves it to the walk in one task
        dense = count.select("band", "value", "new", (F.col("now") > 0.95 * F.col("was")).alias("dense"))
        parts = sides.join(dense, ["band", "value", "new"]).select(
            "band", "value", F.concat("new", F.when(F.col("dense"), "=").otherwise("")).alias("part"), "fp")
        rest = shards.join(large.select(*keys), keys, "left_anti")
        shards = stored(rest.unionByName(parts), "shards")
    return shards


def links(prints: DataFrame, max_bits: int = 4, max_shard: int = MAX_SHARD) -> DataFrame:
    """Edges ``(a, b)`` that connect all distinct fingerprints (column ``fp``) within ``max_bits``."""
    n = max_bits + 1
    cuts = [BITS * i // n for i in range(n + 1)]
    bands = [F.struct(F.lit(i).alias("band"), F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)).alias("value"))
             for i, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False))]
    shards = prints.select("fp", F.explode(F.array(*bands)).alias("s")).select(
        "s.band", "s.value", F.lit("").alias("part"), "fp")
    shards = _split_shards(shards, max_bits, max_shard)
    dealt = shards.repartition(shuffle_partitions(prints.sparkSession), "band", "value", "part").sortWithinPartitions(
        "band", "value", "part", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["band", "value", "part"]):
            band, value, part, fp = (table.column(i).to_numpy() for i in range(4))
            edges, found = run_edges(band, value, part), []
            points = np.ascontiguousarray(fp).view(np.uint64)
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if hi - lo > 1:
                    _forest(points[lo:hi], np.ones(hi - lo, dtype=bool), max_bits, found)
            if found:
                pairs = np.ascontiguousarray(np.concatenate(found)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def _members(docs: DataFrame, shingle: int, max_bits: int, text: str, keep: tuple[str, ...], max_shard: int) -> DataFrame:
    """``keep`` columns, ``__fp``, ``__component`` (its smallest fingerprint) and ``component_id`` of every row."""
    prints = stored(fingerprints(docs, shingle, text, keep), "fingerprints")
    distinct = stored(prints.groupBy(F.col("__fp").alias("fp")).agg(F.min(keep[0]).alias("first")), "distinct")
    parts = connected(links(distinct.select("fp"), max_bits, max_shard))
    member = distinct.join(parts.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("component"))
    first = member.groupBy("component").agg(F.min("first").alias("component_id"))
    label = member.join(first, "component").select(F.col("fp").alias("__fp"), F.col("component").alias("__component"), "component_id")
    return prints.join(label, "__fp")


def near_duplicates(docs: DataFrame, shingle: int = 4, max_bits: int = 4, text: str = "text",
                    keep: tuple[str, ...] = ("doc_id",), max_shard: int = MAX_SHARD) -> DataFrame:
    """One row per row of ``docs``: its ``keep`` columns, ``fingerprint`` (16 hex digits) and ``component_id``.

    ``component_id`` is the smallest first ``keep`` column (``doc_id``) reachable over links, itself included; null
    where no row of the component has one.  Null or word-less texts have fingerprint zero and are linked like any
    other.  Repeated rows stay repeated.  An empty table gives an empty result.  Other columns are not looked at.
    """
    return _members(docs, shingle, max_bits, text, keep, max_shard).select(
        *keep, F.lpad(F.lower(F.hex("__fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = 4, max_bits: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns: one row of each component.

    It is the row with the smallest ``doc_id`` (nulls last), among equals the one with the smallest key of id and
    text; rows equal in both are one.
    """
    key = row_key(doc_id, text)
    found = _members(docs.select(F.col(doc_id).alias("__id"), key.alias("__key"), F.col(text).alias("__text")),
                     shingle, max_bits, "__text", ("__id", "__key"), MAX_SHARD)
    best = found.groupBy("__component").agg(F.min(F.struct(F.col("__id").isNull().alias("none"), "__id", "__key")).alias("k"))
    own = free_name(docs, "__key")
    stay = docs.withColumn(own, key).join(best.select(F.col("k.__key").alias(own)), own, "left_semi")
    return stay.dropDuplicates([own]).drop(own)

"""Exact removal of repeated byte strings by column-wise multi-document construction.

A byte goes if a string of ``length`` bytes that covers it also starts elsewhere.  The sorted order of all strings is
built column by column: each round puts one symbol of every document in front of what it has, re-sorts the collection
stably by that symbol (the column of its Burrows-Wheeler transform) and updates the common prefixes of neighbours.

Rounds over whole texts would be as many as the longest text has bytes, each over the whole collection.  So texts are
first cut to what can repeat, without losing a match:

1. *Anchors.*  Every string of ``length`` bytes has an anchor, its smallest hashed ``GRAM``-gram (leftmost among
   equals); equal strings have it at the same place.  They share the bytes after the anchor (``KEY`` of them) or those
   before it, by where the anchor lies.  Anchors are dealt by hashes of both, in packed blocks; a slice of documents
   sends each context once.
2. *Copies.*  An anchor whose whole context (all strings that hold it) occurs twice is settled: all of it goes.
3. *Columns.*  The other anchors that share a key send their contexts, ``2 * length - GRAM`` bytes each, aligned at
   the anchor.  One task builds the collections of its keys together, a round for each column; where two neighbours
   have ``length`` bytes in common, the string that starts in that column repeats.  Only bytes decide here.
4. *Crowded keys.*  A passage that very many documents hold between differing texts puts all their contexts under one
   key.  A key of more than ``CROWD`` contexts is not built in one task: its strings are dealt one by one, by a hash of
   all their bytes, and settled like copies.  What a slice has several times it sends once, whatever the passage.

Order and prefixes of a bucket's contexts are arrays in memory; the sequential files between the steps are Spark's.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.shared import binary_values, bucket_count, row_key, run_edges, slices, stored

LENGTH = 400
GRAM = 16
CHUNK = 1 << 21
CROWD = 5_000  # contexts of a key that one task may build together
_PLACE = np.uint64((1 << 23) - 1)  # a chunk with its surroundings is shorter
_BASE = 0x9E3779B97F4A7C15


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A hash for each byte; powers of the odd base and of its inverse, modulo 2 ** 64."""
    with np.errstate(over="ignore"):
        x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
        x = (x ^ x >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
        n = CHUNK + (1 << 12)
        base, inverse = np.uint64(_BASE), np.uint64(pow(_BASE, -1, 1 << 64))
        powers = [np.multiply.accumulate(np.append(np.uint64(1), np.full(n, b))) for b in (base, inverse)]
        return x ^ x >> np.uint64(29), *powers


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(32)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(29)


def anchors(text: bytes, length: int = LENGTH) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each chunk of ``text``: places of anchors, their two keys (0: none), and a hash of their context."""
    last = -1
    for at in range(0, max(0, len(text) - length + 1), CHUNK):
        lo, hi = max(0, at - length), min(len(text), at + CHUNK + 2 * length)
        starts = min(CHUNK, len(text) - length + 1 - at)  # strings that start in this chunk
        place, keys, context = _chunk_anchors(text[lo:hi], at - lo, starts, length)
        new = place + lo > last  # a chunk's first strings may share the last anchor of the chunk before
        yield place[new] + lo, keys[:, new], context[new]
        last = place[-1] + lo


def _chunk_anchors(data: bytes, first: int, starts: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    byte, power, inverse = _tables()
    symbol = byte[np.frombuffer(data, np.uint8)]
    gram = symbol
    for step, factor in ((1, 0x8CB92BA72F3D8DD7), (2, 0xC6A4A7935BD1E995), (4, 0xE7037ED1A0B428DB), (8, 0x589965CC75374CC3)):
        gram = gram[:-step] * np.uint64(factor) + gram[step:]
    span = length - GRAM + 1  # grams of a string
    gram = gram[first:first + starts + span - 1]
    low = (_mix(gram) & ~_PLACE) | np.arange(len(gram), dtype=np.uint64)
    reach = 1
    while 2 * reach <= span:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if reach < span:
        low = np.minimum(low[:reach - span], low[span - reach:])
    place = np.unique(low & _PLACE).astype(np.int64) + first

    prefix = np.append(np.uint64(0), np.cumsum(symbol * power[:len(symbol)], dtype=np.uint64))
    def part(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return _mix((prefix[hi] - prefix[lo]) * inverse[lo] + (hi - lo).astype(np.uint64) * np.uint64(_BASE))
    half = span // 2  # an anchor this far into its string, or less, has length - half bytes from it on, else half + 1 before it
    n = len(data)
    after, before = place + length - half, place - half - 1
    keys = np.stack([np.where(after <= n, part(place, np.minimum(after, n)) | np.uint64(1), 0),
                     np.where(before >= 0, part(np.maximum(before, 0), place + GRAM) & ~np.uint64(1) | np.uint64(2), 0)])
    left, right = np.maximum(place - span + 1, 0), np.minimum(place + length, n)
    context = part(left, right) + (place - left).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
    return place, keys, context


def construct(group: np.ndarray, columns: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Column-wise construction over aligned contexts; which strings repeat.

    ``group`` numbers the collection of each context, in order; ``columns`` has a row for each column, with each
    context's symbol (256: none).  Result: contexts x columns, true where the string of ``length`` symbols that starts
    in that column is also there in another context of the group.
    """
    width, n = columns.shape
    repeats = np.zeros((n, max(0, width - length + 1)), bool)
    order = np.arange(n)
    common = np.zeros(n + 1, np.int32)  # symbols that each context has in common with the one before it in the order
    base = group.astype(np.int64) * 512
    for column in range(width - 1, -1, -1):
        symbol = columns[column][order]
        key = base[order] + symbol
        if (key[1:] >= key[:-1]).all():
            lowest = common[1:n]
        else:
            rank = np.argsort(key, kind="stable")
            lowest = np.minimum.reduceat(common, rank + 1)[:-1]  # over the places between two that are now neighbours
            order, key, symbol = order[rank], key[rank], symbol[rank]
        common = np.zeros(n + 1, np.int32)
        common[1:n] = np.where((key[1:] == key[:-1]) & (symbol[1:] < 256), lowest + 1, 0)
        if column < repeats.shape[1]:
            long = common >= length
            repeats[order, column] = long[:-1] | long[1:]
    return repeats


def _covered(repeats: np.ndarray, length: int) -> Iterator[tuple[int, int, int]]:
    """Context, first and end column of each maximal run of columns that repeating strings cover."""
    for i in np.flatnonzero(repeats.any(axis=1)).tolist():
        start = np.flatnonzero(repeats[i])
        new = np.append(True, np.diff(start) > length)
        for lo, hi in zip(start[new].tolist(), start[np.append(new[1:], True)].tolist(), strict=True):
            yield i, lo, hi + length


def _settle(key: np.ndarray, context: np.ndarray, several: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which entries are copies (their context occurs again), and which must be compared.

    Compared are one entry of each context of a key that has two or more, if any of them occurs once.
    """
    order = np.lexsort((context, key))
    k, c = key[order], context[order]
    first = run_edges(k, c)
    size = np.diff(first)
    copies = np.maximum.reduceat(several[order], first[:-1]) | (size > 1)
    owner = run_edges(k[first[:-1]])
    kinds = np.diff(owner)
    open_ = np.repeat((kinds > 1) & ~np.minimum.reduceat(copies, owner[:-1]), kinds)
    copy, compare = np.zeros(len(key), bool), np.zeros(len(key), bool)
    copy[order] = np.repeat(copies, size)
    compare[order[first[:-1][open_]]] = True
    return copy, compare


_DEALT = "bucket long, kind long, key binary, context binary, ref binary, place binary, several binary"


def _dealt(key: np.ndarray, context: np.ndarray, ref: np.ndarray, place: np.ndarray, buckets: int) -> pa.RecordBatch:
    """A slice's entries, one row a bucket; what occurs several times is settled here, and one of it goes on."""
    order = np.lexsort((context, key))
    key, context, ref, place = (x[order] for x in (key, context, ref, place))
    edges = run_edges(key, context)
    several = np.diff(edges) > 1
    inside = np.repeat(several, np.diff(edges))
    rows = [(0, 1, np.zeros(0).tobytes(), b"", ref[inside].tobytes(), place[inside].tobytes(), b"")] if inside.any() else []
    one = edges[:-1]
    bucket = ((key[one] >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = run_edges(bucket[order])
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        at = one[order[lo:hi]]
        rows.append((int(bucket[order[lo]]), 0, key[at].tobytes(), context[at].tobytes(), ref[at].tobytes(),
                     place[at].tobytes(), several[order[lo:hi]].tobytes()))
    if rows and rows[0][1]:
        rows[0] = (int(rows[-1][0]), *rows[0][1:])
    return _binary(rows, ["bucket", "kind", "key", "context", "ref", "place", "several"])


def _meet(table: pa.Table) -> pa.Table:
    """A bucket's entries: copies (no key), and those of a key that must be compared."""
    kind = table.column("kind").to_numpy()
    def all_of(name: str, dtype, which: int) -> np.ndarray:
        return np.frombuffer(b"".join(x for x, k in zip(table.column(name).to_pylist(), kind, strict=True) if k == which), dtype)
    ref, place = all_of("ref", np.int64, 0), all_of("place", np.int64, 0)
    key = all_of("key", np.uint64, 0)
    if len(key):
        copy, compare = _settle(key, all_of("context", np.uint64, 0), all_of("several", bool, 0))
    else:
        copy = compare = np.zeros(0, bool)
    done = np.append(all_of("ref", np.int64, 1), ref[copy]), np.append(all_of("place", np.int64, 1), place[copy])
    return pa.table({"ref": np.append(done[0], ref[compare]), "place": np.append(done[1], place[compare]),
                     "key": [None] * len(done[0]) + key[compare].view(np.int64).tolist()},
                    schema=pa.schema([("ref", pa.int64()), ("place", pa.int64()), ("key", pa.int64())]))


def _strings(batches: Iterator[pa.RecordBatch], length: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows ``ref, places, text``: every string of ``length`` bytes that holds one of the anchors, dealt by its hash."""
    byte, power, inverse = _tables()
    span = length - GRAM + 1
    for whole in batches:
        for batch in slices(whole, "text"):
            keys, refs, starts = [], [], []
            for ref, places, text in zip(batch.column(0).to_pylist(), batch.column(1), binary_values(batch.column(2)), strict=True):
                last = -1
                for place in np.sort(places.values.to_numpy()).tolist():
                    lo, hi = max(0, place - span + 1, last + 1), min(len(text), place + length)
                    n = min(place, len(text) - length) - lo + 1  # strings that start from `lo` to the anchor
                    if n <= 0:
                        continue
                    last = lo + n - 1
                    symbol = byte[np.frombuffer(text, np.uint8, hi - lo, lo)]
                    prefix = np.append(np.uint64(0), np.cumsum(symbol * power[:len(symbol)], dtype=np.uint64))
                    keys.append(_mix((prefix[length:length + n] - prefix[:n]) * inverse[:n]))
                    refs.append(np.full(n, ref))
                    starts.append(np.arange(lo, lo + n))
            if keys:
                key = np.concatenate(keys)
                yield _dealt(key, key, np.concatenate(refs), np.concatenate(starts), buckets)


def spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Rows ``ref, start, end``: byte ranges of ``docs`` (``__ref, __text``) that repeated strings cover."""
    buckets = bucket_count(docs, "__text")
    span = length - GRAM + 1

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "__text"):
                found = [[], [], [], []]
                for ref, text in zip(batch.column(0).to_pylist(), binary_values(batch.column(1)), strict=True):
                    for place, keys, context in anchors(text or b"", length):
                        for side in keys:
                            some = side != 0
                            for into, values in zip(found, (side[some], context[some], np.full(some.sum(), ref), place[some]), strict=True):
                                into.append(values)
                if not found[0]:
                    continue
                key, context, ref, place = (np.concatenate(x) for x in found)
                yield _dealt(key, context, ref, place, buckets)

    sent = docs.mapInArrow(send, _DEALT)
    found = stored(sent.groupBy("bucket").applyInArrow(_meet, "ref long, place long, key long"), "anchors")
    # a copy's whole context goes, as far as its document has it; `spans` are clipped where they are used
    copies = found.filter("key IS NULL").select("ref", (F.col("place") - (span - 1)).alias("start"), (F.col("place") + length).alias("end"))

    open_ = found.filter("key IS NOT NULL")
    crowded = stored(open_.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > CROWD).select("key"), "crowded")
    here = docs.select(F.col("__ref").alias("ref"), F.col("__text").alias("text"))
    crowd = open_.join(crowded, "key", "left_semi").groupBy("ref").agg(F.collect_set("place").alias("places")).join(here, "ref")
    strings = crowd.select("ref", "places", "text").mapInArrow(lambda batches: _strings(batches, length, buckets), _DEALT)
    repeated = strings.groupBy("bucket").applyInArrow(_meet, "ref long, place long, key long")
    copies = copies.unionByName(repeated.select("ref", F.col("place").alias("start"), (F.col("place") + length).alias("end")))

    asked = open_.join(crowded, "key", "left_anti").groupBy("ref").agg(F.collect_list(F.struct("place", "key")).alias("asked"))
    texts = asked.join(here, "ref")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for ref, wanted, text in zip(batch.column(0).to_pylist(), batch.column(1), binary_values(batch.column(2)), strict=True):
                places, keys = (wanted.values.field(i).to_numpy() for i in range(2))
                for place, key in zip(places.tolist(), keys.tolist(), strict=True):
                    rows.append((key, ref, place, text[max(0, place - span + 1):place], text[place:place + length]))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.int64()] * 3 + [pa.binary()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["key", "ref", "place", "left", "right"])

    contexts = texts.select("ref", "asked", "text").mapInArrow(cut, "key long, ref long, place long, left binary, right binary")
    contexts = contexts.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by("key")
        key = table.column("key").to_numpy()
        edges = run_edges(key)
        out = []
        cuts = _batches(edges, 20_000)
        refs, places = table.column("ref").to_numpy(), table.column("place").to_numpy()
        left, right = table.column("left").to_pylist(), table.column("right").to_pylist()
        for lo, hi in cuts:
            columns = np.full((span - 1 + length, hi - lo), 256, np.uint16)
            for i in range(lo, hi):
                both = np.frombuffer(left[i] + right[i], np.uint8)
                at = span - 1 - len(left[i])
                columns[at:at + len(both), i - lo] = both
            group = np.cumsum(np.append(0, key[lo + 1:hi] != key[lo:hi - 1]))
            for i, a, b in _covered(construct(group, columns, length), length):
                zero = int(places[lo + i]) - (span - 1)
                out.append((int(refs[lo + i]), zero + a, zero + b))
        columns = list(zip(*out, strict=True)) or [[]] * 3
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["ref", "start", "end"])

    wide = ["key", "ref", "place", "left", "right"]
    compared = contexts.select("bucket", *wide).groupBy("bucket").applyInArrow(
        lambda table: compare(table.select(wide)), "ref long, start long, end long")
    return copies.unionByName(compared)


def _batches(edges: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of whole runs of at most ``most`` rows, or one longer run."""
    out, lo = [], 0
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if b - lo > most and a > lo:
            out.append((lo, a))
            lo = a
    if edges[-1] > lo:
        out.append((lo, int(edges[-1])))
    return out


def _binary(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(names)
    kinds = [pa.int64(), pa.int64(), *[pa.binary()] * (len(names) - 2)]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def remove(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """Every row of ``docs`` as ``doc_id, n_bytes, spans, kept``: its removed byte ranges (maximal, in order) and the
    bytes left, as binary (a cut may fall inside a character).

    Texts are UTF-8 bytes, a null text is empty; those shorter than ``length`` stay whole.  Every row is a document of
    its own, so rows that are equal remove each other's strings.  Overlapping occurrences count, in one document too.
    An empty table gives no row.  Other columns are not looked at.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("__text"))
    rows = rows.withColumn("__ref", row_key("doc_id", "__text"))
    found = spans(rows.filter(F.length("__text") >= length).select("__ref", "__text"), length)
    by_row = found.groupBy("ref").agg(F.collect_set(F.struct("start", "end")).alias("found"))
    joined = rows.join(by_row, rows["__ref"] == by_row["ref"], "left").select("doc_id", F.col("__text").alias("text"), "found")
    id_type = joined.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                sizes, cut, kept = [], [], []
                for data, some in zip(binary_values(batch.column(1)), batch.column(2), strict=True):
                    sizes.append(len(data))
                    if not some.is_valid:
                        cut.append([])
                        kept.append(data)
                        continue
                    start, end = (some.values.field(i).to_numpy() for i in range(2))
                    mark = np.zeros(len(data) + 1, np.int32)
                    np.add.at(mark, np.maximum(start, 0), 1)
                    np.add.at(mark, np.minimum(end, len(data)), -1)
                    gone = np.cumsum(mark[:-1]) > 0
                    turn = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8))).reshape(-1, 2)
                    cut.append([{"start": a, "end": b} for a, b in turn.tolist()])
                    kept.append(np.frombuffer(data, np.uint8)[~gone].tobytes())
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(cut, kind), pa.array(kept, pa.binary())],
                                                 ["doc_id", "n_bytes", "spans", "kept"])

    return joined.mapInArrow(run, f"doc_id {id_type}, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")

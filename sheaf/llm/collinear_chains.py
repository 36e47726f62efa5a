"""Fuzzy repeated passages by collinear chaining.

1. *Seeds.*  k-mers (``K`` lower-cased words) whose hash is divisible by ``SAMPLE``.  That looks at the k-mer alone, so
   every k-mer that edits leave whole is a seed in both texts or in none.
2. *Anchors.*  Seeds are dealt by hash in packed blocks.  Every occurrence is joined with the first one (smallest
   document, then place) and with the one before it: linear in the occurrences.  A seed that one slice of documents
   has ``HOT`` times is linked inside the slice, and only its first occurrence goes on, so that a passage in a third
   of all documents sends one entry a slice.
3. *Windows.*  Those links are whole for seeds that occur less than ``RICH`` times.  A window of ``MIN_WORDS`` words
   without two such seeds ``SPREAD`` words apart is hashed as a whole, and joined with the first document that holds all
   of it: what is repeated word by word is found, however frequent its parts, or if it has hardly a seed.
4. *Chains.*  A pair of documents goes on if two of its anchors, ``SPREAD`` words apart or more, lie near each other and
   near one diagonal: a common turn of phrase is one short run.  Its anchors are merged along diagonals and chained in order by a Fenwick
   tree over the places in the earlier text, with a cost for every word in a gap.
5. *The rest.*  Seeds of which some pair of occurrences is not linked meet again two by two, where no passage covers one
   of them: see ``rest``.  Two texts that share two seeds near each other are linked, or, if many do, each with the
   representative of its class, and these with each other.
6. *Alignment.*  A chain is aligned word by word: along its diagonals, by longest common subsequence in the gaps, and
   outwards over edits of a few words.  Chains are cut at gaps over ``MAX_GAP``, and under ``MIN_SIMILARITY`` at their
   widest gap.  What covers ``MIN_WORDS`` words is a passage.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.llm.shared import binary_values, bucket_count, free_name, free_shuffles, row_key, run_edges, shuffle_partitions, slices, stored, word_codes

K, SAMPLE, HOT = 4, 4, 16
SPREAD = 5  # words between two anchors that are no common phrase
MERGE = 13  # places between two anchors of a fragment
NEAR, ALONG = 8, 64  # words that two anchors of a pair may lie off one diagonal, and apart
RICH = 4  # occurrences of a seed from which on some pair of them is not linked
CROWD = 8  # places of two seeds above which they are not paired one by one, but by classes
MIN_WORDS, MIN_SIMILARITY = 50, 0.8
SLICE_BYTES = 4 << 20  # texts that a task turns into arrays at a time
SLICE_SEEDS = 1 << 16  # seeds that a task takes two by two at a time
TWO_BUCKETS = 4  # buckets of seeds two by two for one of single seeds: a seed has up to 15 others near it
GAP_COST, MAX_GAP = 0.25, 32  # score lost for a word in a gap; words of either text that a passage's gap may have
MAX_PARTS = 200  # parts of a chain of which all rows are tried
AHEAD = 24  # words that alignment looks ahead along a diagonal
SKIP = 4  # words of an edit that alignment passes outside of anchors, if as many agree after it
_FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def seeds(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seeds of several texts, given word hashes in a row and the count of each: hash, text number, word place.

    No word of a text is looked at but those of the k-mer, so texts share the seeds of all their common k-mers.
    """
    n = len(hashes)
    text = np.repeat(np.arange(len(counts)), counts)
    end = np.repeat(np.cumsum(counts), counts)
    place = np.arange(n)
    kmer = np.zeros(n, np.uint64)
    for j, factor in enumerate(_FACTORS):
        kmer[:n - j] += hashes[j:] * factor
    kmer ^= kmer >> np.uint64(33)
    kmer *= np.uint64(0xFF51AFD7ED558CCD)
    kmer ^= kmer >> np.uint64(33)
    pick = np.flatnonzero((place + K <= end) & (kmer % np.uint64(SAMPLE) == 0))
    return kmer[pick], text[pick], pick - (np.cumsum(counts) - counts)[text[pick]]


def _sparse(counts: np.ndarray, text: np.ndarray, pos: np.ndarray, size: int) -> np.ndarray:
    """Places, in the row of words, where a window of ``size`` words of one text starts whose seeds, any one of them left
    out, have no two ``SPREAD`` words apart."""
    n = int(counts.sum())
    starts = np.cumsum(counts) - counts
    seed = np.append(pos + starts[text], [0, 0])
    flag = np.zeros(n + 1, np.int64)
    flag[seed[:-2] + 1] = 1
    before = np.cumsum(flag)  # seeds before each place
    at = np.flatnonzero(np.arange(n) + size <= np.repeat(starts + counts, counts))
    lo, hi = before[at], before[at + max(size - K + 1, 0)]
    apart = np.minimum(seed[hi - 1] - seed[np.minimum(lo + 1, len(seed) - 1)], seed[hi - 2] - seed[lo])
    return at[(hi - lo < 3) | (apart < SPREAD)]


def windows(hashes: np.ndarray, counts: np.ndarray, rich: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of ``size`` words that the links of seeds may not decide: hash, text number, word place.

    ``rich`` are the places of rich seeds in the row of words.  A window is decided by two of its other seeds that lie
    ``SPREAD`` words apart.
    """
    n = len(hashes)
    starts = np.cumsum(counts) - counts
    _, text, pos = seeds(hashes, counts)
    poor = np.zeros(n, bool)
    poor[pos + starts[text]] = True
    poor[rich] = False
    place = np.arange(n)
    after = np.minimum.accumulate(np.where(poor, place, n)[::-1])[::-1]
    before = np.maximum.accumulate(np.where(poor, place, -1))
    owner = np.repeat(np.arange(len(counts)), counts)
    at = np.flatnonzero(place + size <= (starts + counts)[owner])
    at = at[before[at + max(size - K, 0)] - after[at] < SPREAD] if n else at
    base, inverse = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
    up, down = (np.multiply.accumulate(np.append(np.uint64(1), np.full(n, x))) for x in (base, inverse))
    total = np.append(np.uint64(0), np.cumsum(hashes * up[:n], dtype=np.uint64))
    key = (total[at + size] - total[at]) * down[at]
    key = (key ^ key >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
    return key ^ key >> np.uint64(33), owner[at], at - starts[owner[at]]


def _links(key: np.ndarray, ref: np.ndarray, pos: np.ndarray, least: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Anchors (document, earlier document, place, earlier place) of seeds that occur ``least`` times, a mask of the
    entries that are no later occurrence of such a seed, and one of those that are the first."""
    order = np.argsort(key, kind="stable")
    edges = run_edges(key[order])
    size = np.repeat(np.diff(edges), np.diff(edges)) if len(key) else np.zeros(0, np.int64)
    order = order[size >= least]
    order = order[np.lexsort((pos[order], ref[order], key[order]))]
    stays, leads = np.ones(len(key), bool), np.zeros(len(key), bool)
    if not len(order):
        return [np.zeros(0, np.int64)] * 4, stays, leads
    edges = run_edges(key[order])
    first = np.repeat(edges[:-1], np.diff(edges))
    at = np.arange(len(order))
    later = at[at > first]
    stays[order[later]] = False
    leads[order[edges[:-1]]] = True
    before = later[later - 1 > first[later]]
    one, two = order[np.append(later, before)], order[np.append(first[later], before - 1)]
    return [ref[one], ref[two], pos[one], pos[two]], stays, leads


def _code(key: np.ndarray, rich: np.ndarray) -> np.ndarray:
    """A seed as it is sent for the rest, below -3: 29 bits of it, and whether some pair of its occurrences is not linked."""
    return -4 - 2 * (key >> np.uint64(35)).astype(np.int64) - ~rich


def _shared(key: np.ndarray, ref: np.ndarray, pos: np.ndarray, several: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, place and code of seeds that occur twice, or of which an entry stands for several; rich ones are those
    that occur ``RICH`` times or have such an entry."""
    order = np.argsort(key, kind="stable")
    edges = run_edges(key[order])
    if not len(key):
        return ref, pos, pos
    size = np.diff(edges)
    rich = (size >= RICH) | np.maximum.reduceat(several[order], edges[:-1])
    twice = np.repeat(rich | (size > 1), size)
    some = order[twice]
    return ref[some], pos[some], _code(key[some], np.repeat(rich, size)[twice])


def references(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``__ref, doc_id, __text``: a unique number for each distinct (id, text).

    It is the id where no other text has it, else a negative hash of both; null ids too.  Nulls and empty texts go.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("__text")).filter(F.length("__text") > 0)
    key = F.xxhash64("__text")
    twice = rows.groupBy("doc_id").agg(F.min(key).alias("a"), F.max(key).alias("b"), F.count("*").alias("n"))
    twice = stored(twice.filter("n > 1 OR doc_id IS NULL").select(
        F.col("doc_id").alias("__twice"), (F.col("doc_id").isNull() | (F.col("a") != F.col("b"))).alias("__other")), "repeated_ids")
    marked = rows.join(twice, rows["doc_id"].eqNullSafe(twice["__twice"]), "left")
    own = F.when(F.coalesce("__other", F.lit(False)), -F.abs(F.shiftright(row_key("doc_id", "__text"), 1)) - 1).otherwise(F.col("doc_id"))
    return marked.select(own.alias("__ref"), "doc_id", "__text", F.col("__other").isNotNull().alias("__again"))


_PACKED = "bucket long, kind int, a binary, b binary, c binary, d binary"
_SEVERAL = np.uint32(1 << 31)  # marks the place of an entry that stands for several


def _bytes(values: np.ndarray) -> bytes:
    """The lowest bytes of all values, then the next: places and ids that are near each other compress well."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def _values(data: bytes, dtype: type) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(dtype).ravel()


def _packed(key: np.ndarray, ref: np.ndarray, pos: np.ndarray, least: int, buckets: int, number: int,
            rich: tuple[np.ndarray, np.ndarray] | None, more: dict[int, tuple] | None = None) -> pa.RecordBatch:
    """Entries of a slice of documents as one row a bucket (kind 0); what occurs ``least`` times is linked here (kind 1)
    and only the first goes on, marked.  Its later places with their codes, and those of ``rich`` with -1, are kind 2 (unless
    ``rich`` is None).
    ``more`` has columns of further kinds."""
    def pack(bucket, kind, *arrays):
        return (bucket, kind, *(_bytes(a) for a in arrays))

    local, stays, leads = _links(key, ref, pos, least)
    gone = ref[~stays], pos[~stays], _code(key[~stays], np.ones((~stays).sum(), bool))
    key, ref, mark = key[stays], ref[stays], pos[stays].astype(np.uint32) | leads[stays] * _SEVERAL
    bucket = ((key >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    edges = run_edges(bucket[order])
    rows = []
    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        some = order[lo:hi]
        runs = run_edges(ref[some])
        rows.append(pack(int(bucket[some[0]]), 0, key[some], ref[some][runs[:-1]], np.diff(runs).astype(np.uint32), mark[some]))
    if len(local[0]):
        rows.append(pack(number % buckets, 1, *local))
    if rich is not None:
        marks = [np.append(x, y) for x, y in zip(gone, (*rich, np.full(len(rich[0]), -1)), strict=True)]
        if len(marks[0]):
            rows.append(pack(number % buckets, 2, *marks, np.zeros(0)))
    for kind, arrays in (more or {}).items():
        rows.append(pack(number % buckets, kind, *(np.asarray(x).astype(np.int64) for x in arrays), np.zeros(0)))
    columns = list(zip(*rows, strict=True)) or [[]] * 6
    kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 4]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["bucket", "kind", "a", "b", "c", "d"])


def _linked(packed: DataFrame, rich: bool) -> DataFrame:
    """Rows ``ref, cref, pos, cpos`` of packed entries; if ``rich``, also places of marks, with -1 for ``cpos``, and of seeds
    that occur twice or more, with their code."""
    def link(table: pa.Table) -> pa.Table:
        key, ref, pos, out = [], [], [], []
        for kind, a, b, c, d in zip(*(table.column(i).to_pylist() for i in range(1, 6)), strict=True):
            if kind == 1:
                out.append([_values(x, np.int64) for x in (a, b, c, d)])
            elif kind == 2:
                a, b, c = (_values(x, np.int64) for x in (a, b, c))
                out.append([a, a, b, c])
            elif kind > 2:
                a, b, c = (_values(x, np.int64) for x in (a, b, c))
                out.append([a, b, c, np.full(len(a), 1 - kind)])
            else:
                key.append(_values(a, np.uint64))
                ref.append(np.repeat(_values(b, np.int64), _values(c, np.uint32)))
                pos.append(_values(d, np.uint32))
        if key:
            key, ref, pos = (np.concatenate(x) for x in (key, ref, pos))
            several, pos = pos >= _SEVERAL, (pos & ~_SEVERAL).astype(np.int64)
            out.append(_links(key, ref, pos, 2)[0])
            if rich:
                a, b, c = _shared(key, ref, pos, several)
                out.append([a, a, b, c])
        ref, cref, pos, cpos = (np.concatenate([o[i] for o in out]) for i in range(4))
        return pa.table({"ref": ref, "cref": cref, "pos": pos.astype(np.int32), "cpos": cpos.astype(np.int32)})

    return packed.groupBy("bucket").applyInArrow(link, "ref long, cref long, pos int, cpos int")


def _hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    codes, words, counts = word_codes(texts)
    digest = np.array([xxhash.xxh64_intdigest(w) for w in binary_values(words)], np.uint64)
    return digest[codes], counts


def anchors(docs: DataFrame, buckets: int, size: int = MIN_WORDS) -> DataFrame:
    """Steps 1 and 2: rows ``ref, cref, pos, cpos`` of ``docs`` (``__ref, __text``), places of seeds that occur twice or more
    with their code as ``cpos`` (see ``_code``), and (``cpos`` -1) twice each, the first place of a text where a window of
    ``size`` words has hardly a seed.

    Two more rows for each text: its digest as ``cref`` and its words as ``pos`` (``cpos`` -2), its ``doc_id`` as ``cref`` and
    whether that is null as ``pos`` (``cpos`` -3)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for whole in batches:
            for batch in slices(whole, "__text", SLICE_BYTES):
                refs = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                hashes, counts = _hashes(batch.column(1))
                if len(hashes):
                    key, text, pos = seeds(hashes, counts)
                    starts = np.cumsum(counts) - counts
                    bare = _sparse(counts, text, pos, size)
                    owner, first = np.unique(np.repeat(np.arange(len(counts)), counts)[bare], return_index=True)
                    mark = np.repeat(refs[owner], 2), np.repeat(bare[first] - starts[owner], 2)
                    digest = np.array([xxhash.xxh3_64_intdigest(t) for t in binary_values(batch.column(1))], np.uint64).view(np.int64)
                    ids = batch.column(2)
                    more = {3: (refs, digest, counts), 4: (refs, ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False))}
                    yield _packed(key, refs[text], pos.astype(np.int64), HOT, buckets, int(refs[0]) + number, mark, more)
                    number += 1

    return _linked(docs.select("__ref", "__text", "doc_id").mapInArrow(run, _PACKED), True)


def exact(docs: DataFrame, buckets: int, size: int) -> DataFrame:
    """Step 3: rows ``ref, cref, pos, cpos`` of windows that occur again in ``docs`` (``__ref, doc_id, __text, rich``).

    ``doc_id`` is only there so that the exchange of ``docs`` by document is the one that the alignment reads too.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for whole in batches:
            for batch in slices(whole, "__text", SLICE_BYTES):
                refs = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                hashes, counts = _hashes(batch.column(2))
                if len(hashes):
                    rich = [start + (x.values.to_numpy() if x.is_valid else np.zeros(0, np.int64))
                            for start, x in zip((np.cumsum(counts) - counts).tolist(), batch.column(3), strict=True)]
                    key, text, pos = windows(hashes, counts, np.concatenate(rich).astype(np.int64), size)
                    yield _packed(key, refs[text], pos.astype(np.int64), 2, buckets, int(refs[0]) + number, None)
                    number += 1

    return _linked(docs.select("__ref", "doc_id", "__text", "rich").mapInArrow(run, _PACKED), False)


def _open(seen: pa.ListArray, spans: pa.ListArray) -> tuple[np.ndarray, ...]:
    """Text number, place, code of the seeds (``seen``) of texts in order of place, and which passages (``spans``) do not cover wholly."""
    at, ends = (np.diff(x.offsets.to_numpy()) for x in (seen, spans))
    seen, spans = seen.flatten(), spans.flatten()
    pos, code = (seen.field(i).to_numpy().astype(np.int64) for i in range(2))
    start, end = (spans.field(i).to_numpy().astype(np.int64) for i in range(2))
    text, of = np.repeat(np.arange(len(at)), at), np.repeat(np.arange(len(ends)), ends)
    size = np.full(len(at), K + 1, np.int64)
    np.maximum.at(size, text, pos + K + 1)
    np.maximum.at(size, of, end + 1)
    zero = np.cumsum(size) - size
    mark = np.zeros(int(size.sum()) + 1, np.int32)
    np.add.at(mark, zero[of] + start, 1)
    np.add.at(mark, zero[of] + end, -1)
    covered = np.append(0, np.cumsum(np.cumsum(mark) > 0))
    free = covered[zero[text] + pos + K] - covered[zero[text] + pos] < K
    order = np.lexsort((code, pos, text))
    return text[order], pos[order], code[order], free[order]


def _twos(text: np.ndarray, pos: np.ndarray, code: np.ndarray, free: np.ndarray) -> tuple[np.ndarray, ...]:
    """Two seeds of a text, ``SPREAD`` to ``ALONG`` words apart, one of them rich: key (a hash of their codes), number of the
    first seed, gap, and whether either is open."""
    out, step = [], 1
    while step < len(pos):
        gap = pos[step:] - pos[:-step]
        near = (text[step:] == text[:-step]) & (gap <= ALONG)
        if not near.any():
            break
        i = np.flatnonzero(near & (gap >= SPREAD) & ((code[step:] % 2 == 0) | (code[:-step] % 2 == 0)))
        out.append((code[i] << 30 | code[i + step], i, gap[i], free[i] | free[i + step]))
        step += 1
    if not out:
        return np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 2, np.zeros(0, bool)
    key, first, gap, either = (np.concatenate(x) for x in zip(*out, strict=True))
    key = key.astype(np.uint64) * _FACTORS[0]
    key = (key ^ key >> np.uint64(32)) * _FACTORS[1]
    return key ^ key >> np.uint64(29), first, gap, either


_KEY_BYTES = 5  # of a key, beside its bucket
_OPEN, _MANY = 128, 64  # marks beside a gap: it is open; it stands for several


def _keyed(key: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each key, and what is left of the key."""
    low = np.uint64(8 * _KEY_BYTES)
    return (key >> low).astype(np.int64) % buckets, key & ((np.uint64(1) << low) - np.uint64(1))


def _sent(batch: pa.RecordBatch, buckets: int, number: int, hot: int) -> pa.RecordBatch:
    """The twos of a slice of texts (``ref, seen, spans``), one row a bucket (kind 0).  Of a key that the slice has more than
    ``hot`` times only the first place for each gap goes there, marked; its open places are kind 1."""
    refs = batch.column(0).to_numpy()
    text, pos, code, free = _open(batch.column(1), batch.column(2))
    key, first, gap, free = _twos(text, pos, code, free)
    ref, pos = refs[text[first]], pos[first]
    bucket, key = _keyed(key, buckets)
    full = bucket << 8 * _KEY_BYTES | key.astype(np.int64)
    order = np.argsort(full, kind="stable")
    edges = run_edges(full[order])
    some = order[np.repeat(np.diff(edges) > hot, np.diff(edges))] if len(key) else order
    stays, mark, rows = np.ones(len(key), bool), (gap - SPREAD) | free * _OPEN, []
    if len(some):
        some = some[np.lexsort((pos[some], ref[some], gap[some], full[some]))]
        edges = run_edges(full[some], gap[some])
        lead, stays[some] = some[edges[:-1]], False
        stays[lead] = True
        mark[lead] = (gap[lead] - SPREAD) | _MANY | np.logical_or.reduceat(free[some], edges[:-1]) * _OPEN
        some = some[free[some]]
        rows.append((number % buckets, 1, *(_bytes(x[some]) for x in (full, ref, pos, gap))))
    order = np.flatnonzero(stays)
    order = order[np.lexsort((first[order], bucket[order]))]
    edges = run_edges(bucket[order])
    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=False):
        at = order[lo:hi]
        runs = run_edges(ref[at])
        small = pa.compress(_bytes(pos[at].astype(np.uint32)) + mark[at].astype(np.uint8).tobytes(), "zstd", asbytes=True)
        rows.append((int(bucket[at[0]]), 0, _bytes(key[at])[:_KEY_BYTES * len(at)], _bytes(ref[at][runs[:-1]]), _bytes(np.diff(runs).astype(np.uint32)), small))
    columns = list(zip(*rows, strict=True)) or [[]] * 6
    kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 4]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["bucket", "kind", "a", "b", "c", "d"])


def _received(a: bytes, b: bytes, c: bytes, d: bytes) -> tuple[np.ndarray, ...]:
    """Key, ref, place, mark of a row of kind 0 of ``_sent``."""
    n = len(a) // _KEY_BYTES
    small = pa.decompress(d, 5 * n, "zstd", asbytes=True)
    return _values(a + bytes((8 - _KEY_BYTES) * n), np.int64), np.repeat(_values(b, np.int64), _values(c, np.uint32)), \
        _values(small[:4 * n], np.uint32).astype(np.int32), np.frombuffer(small[4 * n:], np.uint8)


def _meet(key: np.ndarray, ref: np.ndarray, pos: np.ndarray, mark: np.ndarray, crowd: int) -> tuple[list[tuple], np.ndarray, tuple]:
    """Links of the twos of one bucket, as index arrays of later and earlier ones; the first ones of classes of which slices
    sent one place for several; and the arrays ``key, ref, pos, gap`` that these are indices of."""
    def before(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return (ref[i] < ref[j]) | (ref[i] == ref[j]) & (pos[i] < pos[j])

    order = np.argsort(key, kind="stable")
    edges = run_edges(key[order])
    if not len(order):
        return [], order, (key, ref, pos, mark)
    size = np.diff(edges)
    used = np.bitwise_or.reduceat(mark[order], edges[:-1])
    order = order[np.repeat((used >= _OPEN) & ((size > 1) | (used & _MANY > 0)), size)]
    order = order[np.lexsort((pos[order], ref[order], key[order]))]
    key, ref, pos, mark = (x[order] for x in (key, ref, pos, mark))
    free, several, gap = mark >= _OPEN, mark & _MANY > 0, (mark & _MANY - 1).astype(np.int32) + SPREAD
    edges = run_edges(key)
    if not len(key):
        return [], order, (key, ref, pos, gap)
    size = np.diff(edges)
    many = np.logical_or.reduceat(several, edges[:-1])
    crowded, many = np.repeat(many | (size > crowd), size), np.repeat(many, size)
    links, few = [], np.flatnonzero(~crowded)
    for step in range(1, crowd):
        i, j = few[:-step], few[step:]
        fits = (key[i] == key[j]) & free[j] & (np.abs(gap[i] - gap[j]) <= NEAR) & before(i, j)
        links.append((j[fits], i[fits]))
    at = np.flatnonzero(crowded)
    at = at[np.lexsort((pos[at], ref[at], gap[at], key[at]))]
    edges = run_edges(key[at], gap[at])
    heads = at[edges[:-1]]
    by = np.repeat(heads, np.diff(edges))
    own = free[at] & ~several[at] & before(by, at)
    links.append((at[own], by[own]))
    for step in range(1, NEAR + 1):  # a gap has one first place
        i, j = heads[:-step], heads[step:]
        fits = (key[i] == key[j]) & (np.abs(gap[i] - gap[j]) <= NEAR)
        i, j = i[fits], j[fits]
        up, down = before(i, j), before(j, i)
        links += [(j[up], i[up]), (i[down], j[down])]
    return links, heads[many[heads]], (key, ref, pos, gap)


def rest(pairs: DataFrame, found: DataFrame, buckets: int) -> DataFrame | None:
    """Step 5: rows ``ref, cref, at`` (anchors ``pos, cpos``) of documents that share two seeds near each other where links
    of single seeds are not whole; None if there are none.

    Seeds of a text are taken two by two, and dealt once, packed.  Those that passages of ``found`` do not cover meet all
    earlier places of the same two, if these have at most ``CROWD`` places.  If they have more, the places where they lie
    equally far apart are a class: each is linked with the first of its class, and the first ones of all classes of the two
    with each other.  So the links grow with the texts, whatever many of them share; what a slice of documents has ``HOT``
    times sends one place for each class, and its open places are joined with the first of their class.
    """
    spans = found.groupBy(F.col("__ref").alias("ref")).agg(F.collect_list(F.struct("start_word", "end_word")).alias("spans"))
    texts = pairs.filter(F.size("seen") >= 2).select("ref", "seen").join(spans, "ref", "left")
    texts = texts.select("ref", "seen", F.coalesce("spans", F.array().cast(spans.schema["spans"].dataType)).alias("spans"))
    buckets, crowd = TWO_BUCKETS * buckets, CROWD
    hot = max(HOT, crowd)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for batch in batches:
            size = np.diff(batch.column(1).offsets.to_numpy()).astype(np.int64)
            edges = run_edges((np.cumsum(size) - size) // SLICE_SEEDS).tolist()
            for lo, hi in zip(edges, edges[1:], strict=False):
                yield _sent(batch.slice(lo, hi - lo), buckets, abs(batch.column(0)[lo].as_py()) + number, hot)
                number += 1

    def meet(table: pa.Table) -> pa.Table:
        parts, out = [], []
        for kind, *cells in zip(*(table.column(i).to_pylist() for i in range(1, 6)), strict=True):
            if kind:
                full, ref, pos, gap = (_values(x, np.int64) for x in cells)
                out.append((ref, full, pos, gap, gap, np.full(len(ref), -2)))
            else:
                parts.append(_received(*cells))
        if parts:
            links, heads, (key, ref, pos, gap) = _meet(*(np.concatenate(x) for x in zip(*parts, strict=True)), crowd)
            out += [(ref[i], ref[j], pos[i], pos[j], gap[i], gap[j]) for i, j in links]
            out.append((ref[heads], table.column(0)[0].as_py() << 8 * _KEY_BYTES | key[heads], pos[heads], gap[heads], gap[heads], np.full(len(heads), -1)))
        names = ["ref", "cref", "pos", "cpos", "gap", "cgap"]
        return pa.table({x: np.concatenate([o[i] for o in out]).astype(np.int64 if i < 2 else np.int32) for i, x in enumerate(names)})

    met = texts.mapInArrow(send, _PACKED).groupBy("bucket").applyInArrow(meet, "ref long, cref long, pos int, cpos int, gap int, cgap int")
    met = stored(met, "met")
    if met.isEmpty():
        return None
    # cgap -1: the first place of a class, with its key as cref; -2: an open place that is joined with it
    heads = met.filter("cgap = -1").select(F.col("cref").alias("key"), "gap", F.col("ref").alias("by"), F.col("pos").alias("bpos"))
    own = met.filter("cgap = -2").select(F.col("cref").alias("key"), "gap", "ref", "pos").join(heads, ["key", "gap"])
    own = own.filter("by < ref OR by = ref AND bpos < pos")
    own = own.select("ref", F.col("by").alias("cref"), "pos", F.col("bpos").alias("cpos"), "gap", F.col("gap").alias("cgap"))
    links = met.filter("cgap >= 0").unionByName(own).filter("cref < ref OR pos + gap > cpos + cgap")  # no seed is its own anchor
    ends = F.array(F.struct("pos", "cpos"), F.struct((F.col("pos") + F.col("gap")).alias("pos"), (F.col("cpos") + F.col("cgap")).alias("cpos")))
    links = links.select("ref", "cref", F.explode(ends).alias("at"))
    return links.groupBy("ref", "cref").agg(F.collect_set("at").alias("at"))


class Fenwick:
    """Prefix maxima of ``(value, index)``."""

    def __init__(self, size: int):
        self.tree = [(0.0, -1)] * (size + 1)

    def put(self, at: int, item: tuple[float, int]) -> None:
        at += 1
        while at < len(self.tree):
            if item > self.tree[at]:
                self.tree[at] = item
            at += at & -at

    def best(self, count: int) -> tuple[float, int]:
        found = (-1e300, -1)
        while count:
            found = max(found, self.tree[count])
            count -= count & -count
        return found


def fragments(pos: np.ndarray, cpos: np.ndarray) -> np.ndarray:
    """Anchors merged along diagonals: rows (first place, first earlier place, last place) in order of place."""
    shift = pos - cpos
    order = np.lexsort((pos, shift))
    pos, shift = pos[order], shift[order]
    new = np.ones(len(pos), bool)
    new[1:] = (shift[1:] != shift[:-1]) | (pos[1:] - pos[:-1] > MERGE)
    start = np.flatnonzero(new)
    last = np.append(start[1:], len(pos)) - 1
    out = np.stack([pos[start], pos[start] - shift[start], pos[last]], axis=1)
    return out[np.lexsort((out[:, 1], out[:, 0]))]


def chains(parts: np.ndarray) -> list[list[int]]:
    """Best chains of fragments, each fragment in one: those after it start past its last k-mer in both texts.

    A chain scores the words of its fragments less ``GAP_COST`` for each word between them, in either text.
    """
    rows = parts.tolist()
    if len(rows) == 1:
        return [[0]]
    ends = [(last + 1, b + last - a + 1) for a, b, last in rows]  # past the last k-mer's start, in both texts
    ranks = sorted({e[1] for e in ends})
    tree, score, back = Fenwick(len(ranks)), [0.0] * len(rows), [-1] * len(rows)
    waiting, at = sorted(range(len(rows)), key=lambda i: ends[i][0]), 0
    for i, (a, b, last) in enumerate(rows):
        while at < len(waiting) and ends[waiting[at]][0] <= a:
            j = waiting[at]
            tree.put(bisect_right(ranks, ends[j][1]) - 1, (score[j] + GAP_COST * (ends[j][0] + ends[j][1]), j))
            at += 1
        value, j = tree.best(bisect_right(ranks, b))
        gain = value - GAP_COST * (a + b)
        score[i] = last - a + K
        if j >= 0 and gain > 0:
            score[i], back[i] = score[i] + gain, j
    used, out = [False] * len(rows), []
    for i in sorted(range(len(rows)), key=lambda i: -score[i]):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(i)
            i = back[i]
        if chain:
            out.append(chain[::-1])
    return out


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence; row by row, in numpy over ``b``."""
    if not len(a) or not len(b):
        return 0
    row = np.zeros(len(b) + 1, np.int64)
    for x in a:
        now = row.copy()
        now[1:] = np.maximum(row[1:], row[:-1] + (b == x))
        row = np.maximum.accumulate(now)
    return int(row[-1])


def align(a: np.ndarray, b: np.ndarray, chain: list[list[int]], min_words: int, min_similarity: float) -> list[tuple]:
    """Passages ``(start, end, cstart, cend, similarity)`` of one chain of fragments."""
    parts, x, y = [], 0, 0  # start in both texts and length; x, y: past the part before
    for i, (first, cfirst, last) in enumerate(chain):
        over = max(0, x - first, y - cfirst)  # words that the part before has taken
        first, cfirst, n = first + over, cfirst + over, last + K - first - over
        grow = _grow if not i or max(first - x, cfirst - y) > MAX_GAP else _exact
        parts += [(first - u - m, cfirst - v - m, m) for u, v, m in grow(a[x:first][::-1], b[y:cfirst][::-1])[::-1]]
        parts.append((first, cfirst, n))
        x, y = first + n, cfirst + n
        to, cto = chain[i + 1][:2] if i + 1 < len(chain) else (len(a), len(b))
        grow = _grow if i + 1 == len(chain) or max(to - x, cto - y) > MAX_GAP else _exact
        parts += [(x + u, y + v, m) for u, v, m in grow(a[x:to], b[y:cto])]
        x, y = parts[-1][0] + parts[-1][2], parts[-1][1] + parts[-1][2]
    return _passages(a, b, parts, min_words, min_similarity) or _window(a, b, parts, min_words, min_similarity)


def _window(a: np.ndarray, b: np.ndarray, parts: list[tuple], min_words: int, min_similarity: float) -> list[tuple]:
    """The longest row of parts that agrees well enough as a whole (the first of equals), where cutting at wide gaps left
    none; of chains of up to ``MAX_PARTS`` parts, longer ones are cut into such with a half of each shared."""
    out = []
    for at in range(0, max(1, len(parts) - MAX_PARTS // 2), MAX_PARTS // 2):
        some = parts[at:at + MAX_PARTS]
        x, y, n = (np.array(v) for v in zip(*some, strict=True))
        wide = np.maximum(x[1:] - x[:-1] - n[:-1], y[1:] - y[:-1] - n[:-1])
        between = [common(a[p[0] + p[2]:q[0]], b[p[1] + p[2]:q[1]]) if w <= MAX_GAP else -10**6
                   for p, q, w in zip(some, some[1:], wide.tolist(), strict=False)]
        same = np.array([int((a[i:i + m] == b[j:j + m]).sum()) for i, j, m in some])
        matched = np.cumsum(same) + np.append(0, np.cumsum(between))  # of all parts up to each
        words, other = (x + n)[None, :] - x[:, None], (y + n)[None, :] - y[:, None]
        like = 2 * (matched[None, :] - (matched - same)[:, None]) / np.maximum(words + other, 1)
        good = np.triu(like >= min_similarity) & (words >= min_words)
        if good.any():
            lo, hi = np.unravel_index(np.where(good, words, 0).argmax(), words.shape)
            out.append((int(x[lo]), int(x[hi] + n[hi]), int(y[lo]), int(y[hi] + n[hi]), float(like[lo, hi])))
    return out


def _exact(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, int]]:
    """The part at the start of both texts, as far as words agree."""
    m = min(len(a), len(b))
    n = _agree(a[:m], b[:m]) if m else 0
    return [(0, 0, n)] if n else []


_SKIPS = [(i, t - i) for t in range(1, 2 * SKIP + 1) for i in range(max(0, t - SKIP), min(t, SKIP) + 1)]


def _grow(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, int]]:
    """Parts at the start of both texts: as far as words agree, over edits of up to ``SKIP`` words in either after which
    ``SKIP`` words agree; where there is none, as far along the diagonal as pays at half a word for each that differs."""
    out, x, y = [], 0, 0
    while True:
        for _, _, n in _exact(a[x:], b[y:]):
            out.append((x, y, n))
            x, y = x + n, y + n
        one, two = a[x:x + 2 * SKIP].tolist(), b[y:y + 2 * SKIP].tolist()
        skip = next(((i, j) for i, j in _SKIPS if len(one) >= i + SKIP and one[i:i + SKIP] == two[j:j + SKIP]), None)
        if skip is None:
            n = min(len(a) - x, len(b) - y, AHEAD)
            same = a[x:x + n] == b[y:y + n]
            gain = np.cumsum(np.where(same, 1.0, -0.5))
            if not n or gain.max() <= 0:
                return out
            run = np.flatnonzero(np.diff(np.concatenate([[False], same[:int(gain.argmax()) + 1], [False]]).astype(np.int8)))
            out += [(x + lo, y + lo, hi - lo) for lo, hi in run.reshape(-1, 2).tolist()]
            x, y = out[-1][0] + out[-1][2], out[-1][1] + out[-1][2]
        else:
            x, y = x + skip[0], y + skip[1]


def _passages(a: np.ndarray, b: np.ndarray, parts: list[tuple], min_words: int, min_similarity: float) -> list[tuple]:
    """Parts are cut at the first widest gap until what is left agrees.  The cuts follow a tree of the gaps by width,
    on a stack of their own, and every gap is aligned once: linear in the parts, however many cuts there are."""
    gaps = [(p[0] + p[2], n[0], p[1] + p[2], n[1]) for p, n in zip(parts, parts[1:], strict=False)]
    wide = [max(g[1] - g[0], g[3] - g[2]) for g in gaps]
    left, right, path = [-1] * len(gaps), [-1] * len(gaps), []
    for i, w in enumerate(wide):
        while path and wide[path[-1]] < w:
            left[i] = path.pop()
        if path:
            right[path[-1]] = i
        path.append(i)
    same = np.cumsum([0] + [int((a[x:x + n] == b[y:y + n]).sum()) for x, y, n in parts]).tolist()
    between = np.cumsum([0] + [common(a[g[0]:g[1]], b[g[2]:g[3]]) if w <= MAX_GAP else 0 for g, w in zip(gaps, wide, strict=True)]).tolist()
    out, todo = [], [(0, len(parts), path[0] if path else -1)]
    while todo:
        lo, hi, at = todo.pop()  # parts[lo:hi] and their first widest gap, the one after parts[at]
        if at < 0 or wide[at] <= MAX_GAP:
            start, cstart = parts[lo][:2]
            end, cend = parts[hi - 1][0] + parts[hi - 1][2], parts[hi - 1][1] + parts[hi - 1][2]
            matched = same[hi] - same[lo] + between[hi - 1] - between[lo]
            similarity = 2 * matched / (end - start + cend - cstart)
            if similarity >= min_similarity:
                out += [(start, end, cstart, cend, similarity)] if end - start >= min_words else []
                continue
            if at < 0:
                continue
        todo += [(at + 1, hi, right[at]), (lo, at + 1, left[at])]
    return out


def _agree(a: np.ndarray, b: np.ndarray) -> int:
    differ = np.flatnonzero(a != b)
    return int(differ[0]) if len(differ) else len(a)


def maximal(found: list[tuple], size: int) -> list[tuple]:
    """Passages that longer ones (then earlier ones) before them do not cover wholly."""
    covered, out = np.zeros(size, bool), []
    for p in sorted(found, key=lambda p: (p[0] - p[1], *p)):
        if not covered[p[0]:p[1]].all():
            covered[p[0]:p[1]] = True
            out.append(p)
    return out


def _pair(a: np.ndarray, b: np.ndarray, pos: pa.ListScalar, cpos: pa.ListScalar, min_words: int, min_similarity: float,
          apart: bool) -> list[tuple]:
    """Passages of one pair of documents, from their words and anchors; copies need no chain."""
    if apart and len(a) == len(b) and (a == b).all():
        return [(0, len(a), 0, len(a), 1.0)] if len(a) >= min_words else []
    parts = fragments(pos.values.to_numpy().astype(np.int64), cpos.values.to_numpy().astype(np.int64))
    found, covered = [], np.zeros(len(a), bool)
    for chain in chains(parts):  # the best first; one that lies well inside of passages found has nothing to add
        rows = parts[chain].tolist()
        if not covered[max(0, rows[0][0] - min_words):rows[-1][2] + K + min_words].all():
            for p in align(a, b, rows, min_words, min_similarity):
                covered[p[0]:p[1]] = True
                found.append(p)
    return maximal(found, len(a))


def passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS,
             min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    """Passages of documents that an earlier document (smaller id), or the same one before, holds too.

    Rows ``__ref, doc_id, start_word, end_word, ref_doc_id, ref_start, ref_end, similarity``; places count words from
    0, the end is past the last.  Rows equal in id and text are one document; texts that share an id, or have none,
    are told apart by their hash and count as before all others.  Null, empty and shorter texts have no passage.
    Copies give one row for the whole text; of a pair of documents, passages within longer ones are left out.  An empty table gives none.  Other columns are not looked at.
    """
    n, buckets = shuffle_partitions(docs.sparkSession), bucket_count(docs, text)
    rows = references(docs, doc_id, text)
    once = rows.filter("NOT __again").select("__ref", "doc_id", "__text").unionByName(
        rows.filter("__again").select("__ref", "doc_id", "__text").dropDuplicates(["__ref"]))
    linked, found = F.col("cpos") >= 0, anchors(once, buckets, min_words).repartition(n, "ref")
    place = F.when(linked, F.struct((F.col("pos") - F.col("cpos")).alias("shift"), "pos"))
    kind = F.when(F.col("cpos").isin(-2, -3), F.col("cpos")).otherwise(-1).alias("kind")  # links and seeds, digests, ids
    code = F.when(F.col("cpos") < -3, -4 - F.col("cpos"))
    pairs = found.groupBy("ref", "cref", kind).agg(
        F.array_sort(F.collect_list(place)).alias("at"), F.max("pos").alias("pos"),
        F.collect_list(F.when((F.col("cpos") == -1) | (code % 2 == 0), F.col("pos"))).alias("rich"),
        F.collect_list(F.when(code.isNotNull(), F.struct("pos", code.alias("code")))).alias("seen"))

    def apart(step: int) -> Column:  # two anchors so many steps from each other; of one diagonal, SPREAD steps are as many words
        rest = F.greatest(F.size("at") - step, F.lit(0))
        return F.exists(F.zip_with(F.slice("at", 1, rest), F.slice("at", step + 1, rest), lambda x, y: (
            (y["shift"] - x["shift"] <= NEAR) & F.abs(y["pos"] - x["pos"]).between(SPREAD, ALONG))), lambda x: x)

    near = apart(1)
    for step in range(2, SPREAD + 1):
        near = near | apart(step)
    pairs = pairs.select("ref", "cref", "kind", "pos", near.alias("near"), F.transform("at", lambda x: x["pos"]).alias("p"),
                         F.transform("at", lambda x: x["pos"] - x["shift"]).alias("c"), "rich", "seen")
    # an open window has two rich seeds, or it is marked as often
    pairs = stored(pairs.filter(F.col("near") | (F.size("rich") >= 2) | (F.size("seen") >= 2) | (F.col("kind") < -1)), "pairs")
    free_shuffles(docs.sparkSession)
    # a copy of an earlier text is one passage: nothing of it is hashed, aligned or sent again
    def of(x: str) -> DataFrame:
        return pairs.filter("kind = -2").select(F.col("ref").alias(x), F.col("cref").alias(f"h_{x}"), F.col("pos").cast("long").alias(f"n_{x}"))

    copies = pairs.filter("near AND ref <> cref").select("ref", "cref").join(of("ref"), "ref").join(of("cref"), "cref")
    copies = stored(copies.filter("h_ref = h_cref AND n_ref = n_cref").select("ref", "cref", F.col("n_ref").alias("n")), "copies")
    ids = pairs.filter("kind = -3").select("ref", F.when(F.col("pos") == 0, F.col("cref")).alias("doc_id"))
    rich = pairs.filter(F.size("rich") >= 2).select(F.col("ref").alias("__ref"), "rich")
    rich = rich.join(copies.select(F.col("ref").alias("__ref")).distinct(), "__ref", "left_anti")
    again = exact(once.join(rich, "__ref"), buckets, min_words)
    again = again.repartition(n, "ref").groupBy("ref", "cref").agg(F.collect_list("pos").alias("p"), F.collect_list("cpos").alias("c"))
    linked = pairs.filter("near").select("ref", "cref", "p", "c")
    both = linked.unionByName(again).groupBy("ref", "cref").agg(*[F.flatten(F.collect_list(x)).alias(x) for x in ("p", "c")])
    found = _aligned(both.join(copies.select("ref", "cref"), ["ref", "cref"], "left_anti"), once, min_words, min_similarity)
    whole = copies.filter(F.col("n") >= min_words).join(ids, "ref").join(ids.select(F.col("ref").alias("cref"), F.col("doc_id").alias("ref_doc_id")), "cref")
    whole = whole.select(F.col("ref").alias("__ref"), "doc_id", F.lit(0).cast("long").alias("start_word"), F.col("n").alias("end_word"), "ref_doc_id",
                         F.lit(0).cast("long").alias("ref_start"), F.col("n").alias("ref_end"), F.lit(1.0).alias("similarity"))
    found = stored(found.unionByName(whole).distinct(), "found")
    free_shuffles(docs.sparkSession)
    more = rest(pairs.join(copies.select("ref").distinct(), "ref", "left_anti"), found, buckets)
    if more is None:
        return found
    more = stored(more, "links")
    free_shuffles(docs.sparkSession)
    # of what is linked already, only a pair with new anchors is aligned again, with all of them
    known = linked.join(more.select("ref", "cref"), ["ref", "cref"], "left_semi")
    known = known.select("ref", "cref", F.zip_with("p", "c", lambda x, y: F.struct(x.alias("pos"), y.alias("cpos"))).alias("known"))
    more = more.join(known, ["ref", "cref"], "left").withColumn("known", F.coalesce("known", F.array().cast(more.schema["at"].dataType)))
    more = more.filter(F.size(F.array_except("at", "known")) > 0).withColumn("at", F.array_union("at", "known"))
    more = stored(more.select("ref", "cref", F.col("at.pos").alias("p"), F.col("at.cpos").alias("c")), "more")
    if more.isEmpty():
        return found
    some = more.select(F.col("ref").alias("__ref")).union(more.select("cref")).distinct()
    return found.unionByName(_aligned(more, once.join(some, "__ref", "left_semi"), min_words, min_similarity)).distinct()


def _aligned(pairs: DataFrame, once: DataFrame, min_words: int, min_similarity: float) -> DataFrame:
    """Passages of pairs of documents (``ref, cref``, and the places of their anchors ``p, c``), from the texts in ``once``."""
    later = once.select(F.col("__ref").alias("ref"), F.col("doc_id"), F.col("__text").alias("text"))
    early = once.select(F.col("__ref").alias("cref"), F.col("doc_id").alias("ref_doc_id"), F.col("__text").alias("ctext"))
    both = pairs.join(later, "ref").join(early, "cref").select("ref", "doc_id", "text", "ref_doc_id", "ctext", "p", "c")
    names = ["__ref", "doc_id", "start_word", "end_word", "ref_doc_id", "ref_start", "ref_end", "similarity"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for whole in batches for part in slices(whole, "ctext", SLICE_BYTES) for b in slices(part, "text", SLICE_BYTES)):
            codes, _, counts = word_codes(pa.concat_arrays([batch.column(2), batch.column(4)]))
            texts = np.split(codes, np.cumsum(counts)[:-1])
            out = []
            cells = [batch.column(i).to_pylist() for i in (0, 1, 3)] + [texts[:batch.num_rows], texts[batch.num_rows:], batch.column(5), batch.column(6)]
            for ref, doc, other, a, b, p, c in zip(*cells, strict=True):
                found = _pair(a, b, p, c, min_words, min_similarity, doc != other)
                out += [(ref, doc, s, e, other, cs, ce, like) for s, e, cs, ce, like in found]
            columns = list(zip(*out, strict=True)) or [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.float64() if i == 7 else pa.int64()) for i, x in enumerate(columns)], names)

    return both.mapInArrow(run, "__ref long, doc_id long, start_word long, end_word long, ref_doc_id long, ref_start long, "
                                "ref_end long, similarity double")


def without_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``text`` without the words of ``spans`` and the white space after each."""
    raw = np.frombuffer(text, np.uint8)
    space = np.isin(raw, [0x20, *range(0x09, 0x0E)])
    start = np.flatnonzero(~space & np.append(True, space[:-1]))
    edge = np.append(start, len(raw))
    keep = np.ones(len(raw), bool)
    for lo, hi in spans:
        keep[edge[lo]:edge[hi]] = False
    return raw[keep].tobytes()


def remove(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: str = "n_chars",
           min_words: int = MIN_WORDS, min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    """``docs`` without its repeated passages, all columns; ``length`` (if there is one) is set to the new length.

    Every passage stays in the earliest document that has it.  A document of which no word is left goes; of rows equal
    in id and text all are cut alike.
    """
    found = stored(passages(docs, doc_id, text, min_words, min_similarity), "passages")
    own, cut_out = free_name(docs, "__key"), free_name(docs, "__spans")
    spans = found.groupBy("__ref").agg(F.collect_list(F.struct("start_word", "end_word")).alias(cut_out))
    keys = references(docs, doc_id, text).select("__ref", row_key("doc_id", "__text").alias(own))  # no text travels here
    cut = stored(keys.join(spans, "__ref").groupBy(own).agg(F.first(cut_out).alias(cut_out)), "spans")
    key = F.xxhash64(F.col(doc_id).cast("long"), F.col(text))
    # the spans grow with the documents, so they are merged at every size and never broadcast
    rows = docs.withColumn(own, key).join(cut.hint("merge"), own, "left").drop(own)
    names = rows.columns
    kept, at, spans_at = docs.columns, names.index(text), names.index(cut_out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = batch.schema.field(at).type
            texts = binary_values(batch.column(at))
            for i, s in enumerate(batch.column(spans_at).to_pylist()):
                if s:
                    texts[i] = without_spans(texts[i], [(x["start_word"], x["end_word"]) for x in s])
            column = pa.array(texts, pa.binary()).cast(kind)
            columns = [column if i == at else c for i, c in enumerate(batch.columns) if i != spans_at]
            gone = np.array([s is not None and not t.split() for s, t in zip(batch.column(spans_at).to_pylist(), texts, strict=True)], bool)
            out = pa.RecordBatch.from_arrays(columns, kept)
            yield out.filter(pa.array(~gone)) if gone.any() else out

    left = rows.mapInArrow(run, docs.schema)
    return left.withColumn(length, F.length(text).cast(docs.schema[length].dataType)) if length in docs.columns else left

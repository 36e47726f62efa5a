"""Ranked lexical search by NRA: impact-sorted lists read in order, with a lower and an upper score for each document.

1. *Index.*  Documents are cut into shards of about ``SHARD_BYTES`` of text.  A shard is one row: its documents, their
   lengths, its terms, and for each term the documents that hold it with their counts.  It is written once and serves
   any number of items.
2. *Statistics.*  Counts over the whole corpus come from the shards by partial aggregation: documents, terms, and the
   documents of each asked term.
3. *Search.*  With them a shard turns the lists of asked terms into impacts and sorts each by falling impact.  For every
   item the lists are read side by side from the top, in steps that double.  A document's lower score is the sum of what
   was read for it; its upper score adds, for each list it was not yet met in, the last impact read there (zero at the
   list's end).  A document whose upper score is below the k-th lower score is out.  Reading goes on until every document
   that is not out has equal lower and upper scores: members, ties and scores are then final.
4. The best k of each shard meet, a bounded number of rows for each item, and are ranked.

Items are taken in blocks of bounded size; each block runs over all shards.  No posting is ever shuffled, and a frequent
term only makes a list of its shard longer.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from sheaf.llm.shared import row_key, run_edges, slices, stored, word_codes

TOP = 10
SHARD_BYTES = 8 << 20
BLOCK_ITEMS = 2_000
BLOCK_BYTES = 4 << 20
FIRST_STEP = 128
_PACKED = StructType([*(StructField(c, LongType()) for c in ("n_docs", "n_terms")),
                      *(StructField(c, BinaryType()) for c in ("sizes", "terms", "starts", "docs", "counts"))])
#: Bytes that are no part of a term (ASCII but for digits and letters) become spaces, A-Z become small.
_BYTES = np.array([b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)], np.uint8)
_BYTES[0x41:0x5B] += 0x20


def terms(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """A code for each term of the texts in a row, the distinct terms, and the count of each text."""
    flat = pa.concat_arrays([texts.fill_null("").cast(pa.large_string())])
    _, offsets, data = flat.buffers()
    at = np.frombuffer(offsets, np.int64)[flat.offset:flat.offset + len(flat) + 1]
    plain = _BYTES[np.frombuffer(data, np.uint8)[at[0]:at[-1]]] if data is not None else np.zeros(0, np.uint8)
    starts = (at - at[0]).astype(np.int32)
    return word_codes(pa.StringArray.from_buffers(len(flat), pa.py_buffer(starts), pa.py_buffer(plain)))


def index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The shards of ``docs``, written to the shared folder: one row each, lists as packed arrays.

    Columns: ``ids`` (one entry a document), ``n_docs`` (documents with a term), ``n_terms``, and binary ``sizes`` (terms
    of each document), ``terms`` (joined by spaces), ``starts``, ``docs`` and ``counts`` (a term's documents lie between
    its start and the next).
    """
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    schema = StructType([StructField("ids", ArrayType(rows.schema["id"].dataType)), *_PACKED.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _filled(batches):
            for part in slices(batch, "text", SHARD_BYTES):
                codes, vocabulary, sizes = terms(part.column(1))
                n = part.num_rows
                pair, count = np.unique(codes.astype(np.int64) * n + np.repeat(np.arange(n), sizes), return_counts=True)
                term = pair // n
                edges = run_edges(term)
                names = vocabulary.take(pa.array(term[edges[:-1]]))
                ids = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), part.column(0))
                packed = [int((sizes > 0).sum()), int(sizes.sum()), sizes.astype(np.int64).tobytes(), " ".join(names.to_pylist()).encode(),
                          edges.astype(np.int32).tobytes(), (pair % n).astype(np.int32).tobytes(), count.astype(np.int32).tobytes()]
                kinds = [pa.int64()] * 2 + [pa.binary()] * 5
                columns = [ids, *(pa.array([x], k) for x, k in zip(packed, kinds, strict=True))]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return stored(rows.mapInArrow(run, schema), "shards")


def _filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Small batches put together until a shard is full."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= SHARD_BYTES:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held and sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def weight(n_docs: int, holding: int) -> int:
    """A term's weight, from the number of documents and of those that hold it."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holding + 1)))


def impacts(weights: np.ndarray, counts: np.ndarray, sizes: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a term adds to the score of a document with so many terms, in 64-bit integers."""
    norm = 10 + (90 * sizes * n_docs) // n_terms
    return weights * ((1_000_000_000 * counts) // (1000 * counts + 8 * norm))


def nra(lists: list[tuple[np.ndarray, np.ndarray]], n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The documents (0 to n - 1) that can be among the best ``k``, ties at the end included, and their exact scores.

    ``lists`` holds documents and impacts of each term, by falling impact.
    """
    lower = np.zeros(n, np.int64)
    missing = np.ones((len(lists), n), bool)  # lists that a document was not yet met in
    last = np.array([impact[0] if len(impact) else 0 for _, impact in lists], np.int64)
    alive = np.arange(n)
    at, step = 0, FIRST_STEP
    while True:
        for i, (docs, impact) in enumerate(lists):
            if at < len(docs):
                some = docs[at:at + step]
                lower[some] += impact[at:at + step]
                missing[i, some] = False
                last[i] = impact[at + step - 1] if at + step < len(docs) else 0
        at, step = at + step, step * 2
        below = lower[alive]
        upper = below + last @ missing[:, alive]
        floor = np.partition(below, len(below) - k)[-k] if len(below) > k else 0
        keep = (upper >= floor) & (upper > 0)
        alive, below, upper = alive[keep], below[keep], upper[keep]
        if (below == upper).all():
            return alive, below


def search(items: DataFrame, shards: DataFrame, item_id: str = "item_id", text: str = "text", k: int = TOP) -> DataFrame:
    """Rows ``item_id, rank, doc_id, score``: the ``k`` documents of ``shards`` (``index``) with the highest scores above
    zero for each row of ``items``, equal scores by ascending id (null last), ranks from 1.

    Items without a term, or whose terms no document holds, have no row.  Equal rows of ``items`` are one item; rows with
    the same id and other texts are items of their own.  Repeated documents are ranked each by itself.  Null texts hold
    no term.  An empty table on either side gives no row; other columns are not looked at.
    """
    spark = shards.sparkSession
    asked = items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).distinct()
    out = StructType([StructField("item", LongType()), StructField("doc_id", shards.schema["ids"].dataType.elementType), StructField("score", LongType())])
    result = None
    for block in _blocks(asked):
        found = _search_block(shards, block, out, k)
        names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(block)],
                                      StructType([out["item"], asked.schema["item_id"]]))
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        best = best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")  # at most BLOCK_ITEMS rows
        result = best if result is None else result.unionByName(best)
    if result is None:
        schema = StructType([asked.schema["item_id"], StructField("rank", IntegerType()), out["doc_id"], out["score"]])
        result = spark.createDataFrame([], schema)
    return result


def _blocks(asked: DataFrame) -> Iterator[list[tuple]]:
    """The items in blocks of at most ``BLOCK_ITEMS`` rows and about ``BLOCK_BYTES`` of text, one at a time."""
    keyed = stored(asked.withColumn("key", row_key("item_id", "text")), "items")
    block, size = [], 0
    for row in keyed.orderBy("key").toLocalIterator():
        if block and (len(block) == BLOCK_ITEMS or size + len(row.text or "") > BLOCK_BYTES):
            yield block
            block, size = [], 0
        block.append((row.item_id, row.text))
        size += len(row.text or "")
    if block:
        yield block


def _search_block(shards: DataFrame, block: list[tuple], out: StructType, k: int) -> DataFrame:
    codes, names, sizes = terms(pa.array([text for _, text in block], pa.string()))
    owner = np.repeat(np.arange(len(block)), sizes)
    wanted = [np.unique(codes[owner == i]) for i in range(len(block))]
    names = names.cast(pa.string())

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                term, at = _asked(names, row["terms"])
                starts = np.frombuffer(row["starts"], np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(np.diff(starts)[at].astype(np.int64))], ["term", "holding"])

    totals = shards.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    n_docs, n_terms = int(totals[0] or 0), int(totals[1] or 0)
    held = shards.select("terms", "starts").mapInArrow(counted, "term long, holding long").groupBy("term").agg(F.sum("holding").alias("holding"))
    weights = np.zeros(len(names), np.int64)
    for row in held.toLocalIterator():  # one row for each asked term of the block
        weights[row.term] = weight(n_docs, row.holding)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for i, row in enumerate(batch.drop_columns(["ids"]).to_pylist()):
                item, doc, score = _best_of_shard(row, names, weights, wanted, n_docs, n_terms, ids[i].values, k)
                yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), ids[i].values.take(pa.array(doc, pa.int64())), pa.array(score, pa.int64())],
                                                 out.names)

    return shards.select("ids", "sizes", "terms", "starts", "docs", "counts").mapInArrow(best, out)


def _asked(names: pa.Array, vocabulary: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``names`` a shard has, and where."""
    at = pc.index_in(names, pa.array(vocabulary.decode().split(" "), pa.string()))
    has = at.is_valid().to_numpy(zero_copy_only=False) & (pc.binary_length(names).to_numpy() > 0)
    return np.flatnonzero(has), at.fill_null(0).to_numpy()[has]


def _best_of_shard(row: dict, names: pa.Array, weights: np.ndarray, wanted: list[np.ndarray], n_docs: int, n_terms: int,
                   ids: pa.Array, k: int) -> tuple[list[int], list[int], list[int]]:
    sizes, starts = np.frombuffer(row["sizes"], np.int64), np.frombuffer(row["starts"], np.int32)
    docs, counts = np.frombuffer(row["docs"], np.int32), np.frombuffer(row["counts"], np.int32)
    lists = {}
    for term, at in zip(*(x.tolist() for x in _asked(names, row["terms"])), strict=True):
        some = docs[starts[at]:starts[at + 1]]
        gain = impacts(weights[term], counts[starts[at]:starts[at + 1]].astype(np.int64), sizes[some], n_docs, n_terms)
        order = np.argsort(-gain, kind="stable")
        lists[term] = some[order], gain[order]
    by_id = np.empty(len(sizes), np.int64)
    by_id[pc.sort_indices(ids, null_placement="at_end").to_numpy()] = np.arange(len(sizes))
    out: tuple[list[int], list[int], list[int]] = [], [], []
    for item, codes in enumerate(wanted):
        own = [lists[t] for t in codes.tolist() if t in lists]
        if own:
            found, score = nra(own, len(sizes), k)
            first = np.lexsort((by_id[found], -score))[:k]
            out[0].extend([item] * len(first))
            out[1].extend(found[first].tolist())
            out[2].extend(score[first].tolist())
    return out


#: DuckDB SQL of ``search`` over ``documents`` for ``benchmark``, k = 10.
SQL = r"""
WITH lowered AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents),
sized AS (SELECT * FROM (SELECT doc_id, r, ts, CAST(len(ts) AS BIGINT) AS n FROM lowered) WHERE n > 0),
totals AS (SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM sized),
asked AS (
  SELECT DISTINCT item_id, text, unnest(regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
  FROM benchmark),
counted AS (
  SELECT doc_id, r, n, t, count(*) AS tf FROM (SELECT doc_id, r, n, unnest(ts) AS t FROM sized)
  WHERE t IN (SELECT t FROM asked) GROUP BY ALL),
weights AS (
  SELECT t, CAST(floor(1000 * ln((2 * big_n + 2) / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT t, count(*) AS df FROM counted GROUP BY t), totals),
gains AS (
  SELECT doc_id, r, t, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * big_n) // big_l))) AS gain
  FROM counted JOIN weights USING (t), totals),
scores AS (
  SELECT item_id, text, doc_id, r, CAST(sum(gain) AS BIGINT) AS score FROM asked JOIN gains USING (t) GROUP BY ALL),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id) AS INTEGER) AS rank
  FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""

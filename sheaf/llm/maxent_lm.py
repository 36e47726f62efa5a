"""Hashed maximum-entropy language model with class-factored softmax.

``P(token | history) = P(class | history) * P(token | class, last token)``.  The class softmax has hashed n-gram and
skip features of the two tokens before (their classes): the last, the one before it, and both.  Frequent words are
classes of their own, other words share classes by their ending.  Inside a class the softmax has a feature for every
pair of words that follow each other in training, beside the word's add-one share of the class's training tokens (one
share being left for unknown words); so all tokens and one unknown word a class sum to one, whatever comes before.

The pair features grow with the corpus: their table is a partitioned DataFrame, dealt by a hash of last token and
class.  What normalises together (all pairs of one last token and class) lies in one bucket, so the regularised
updates of a bucket's weights need nothing from others, and buckets are as many as the corpus needs.  A block of
documents sends each distinct pair once, and gets its log-factor back.

All training tokens count.  Word counts meet by hash: a block of documents sends each distinct word once, and gets
its corpus count back.  Class contexts are summed over blocks into sufficient statistics, spread over chunks; every
gradient update is a Spark job in which each chunk computes its part of the gradient of all its contexts.  Scoring
works on the blocks' sparse codes in numpy, with the model as a small table.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.llm.shared import binary_values, bucket_count, run_edges, slices, stored, stored_by, word_codes

HEAD, TAIL = 32, 32  # classes: the end token and the HEAD - 1 most frequent words, and TAIL classes of other words
CLASSES = HEAD + TAIL
START = CLASSES  # class of the places before a text
CONTEXTS = (CLASSES + 1) ** 2
ROWS = 1 << 12  # rows of the hashed weight table
CHUNKS = 16
STEPS, RATE = 30, 0.7
END = np.uint64(0)  # stands for the end token among word hashes
BLOCK_BYTES = 5 << 20
PAIR_STEPS, VARIANCE = 20, 7.0  # updates of pair weights, and the variance of their prior


class Block(NamedTuple):
    hashes: np.ndarray  # distinct tokens, the end token first
    tail: np.ndarray  # tail class of each
    codes: np.ndarray  # tokens of all documents
    counts: np.ndarray  # tokens of each document


def encode(texts: pa.Array) -> Block:
    codes, distinct, counts = word_codes(texts)
    words = binary_values(distinct)
    hashes = np.array([0, *(xxhash.xxh64_intdigest(w) or 1 for w in words)], np.uint64)
    tail = np.array([0, *(xxhash.xxh32_intdigest(w[-2:]) % TAIL for w in words)], np.uint8)
    ends = np.cumsum(counts)
    return Block(hashes, tail, np.insert(codes.astype(np.uint32) + np.uint32(1), ends, np.uint32(0)), counts + 1)


def features() -> np.ndarray:
    """Rows of the weight table for each context ``before * (CLASSES + 1) + last``: last, skip, both and the bias."""
    last, before = np.arange(CONTEXTS) % (CLASSES + 1), np.arange(CONTEXTS) // (CLASSES + 1)
    def row(kind: int, value: np.ndarray) -> np.ndarray:
        h = (value.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(kind * 0x632BE59BD9B4E019 & (1 << 64) - 1)
        h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        return ((h ^ h >> np.uint64(32)) % np.uint64(ROWS)).astype(np.int64)
    return np.stack([row(1, last), row(2, before), row(3, np.arange(CONTEXTS)), row(4, np.zeros(CONTEXTS, np.int64))], axis=1)


def log_softmax(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    logits = weights[rows].sum(axis=1)
    logits -= logits.max(axis=1, keepdims=True)
    return logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))


def gradient(weights: np.ndarray, rows: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Gradient of the log-likelihood of ``seen`` (contexts x classes): touched table rows, their parts, likelihood."""
    logp = log_softmax(weights, rows)
    part = seen - seen.sum(axis=1, keepdims=True) * np.exp(logp)
    flat = rows.ravel()
    order = np.argsort(flat, kind="stable")
    edges = run_edges(flat[order])
    total = np.add.reduceat(np.repeat(part, rows.shape[1], axis=0)[order], edges[:-1], axis=0) if len(order) else part
    return flat[order][edges[:-1]], total, float((seen * logp).sum())


def contexts(classes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The context of every token of texts given in a row."""
    n = len(classes)
    place = np.arange(n) - np.repeat(np.cumsum(counts) - counts, counts)
    last, before = np.full(n, START, np.int64), np.full(n, START, np.int64)
    last[1:], before[2:] = classes[:-1], classes[:-2]
    last[place < 1], before[place < 2] = START, START
    return before * (CLASSES + 1) + last


def classify(hashes: np.ndarray, tail: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Class of each distinct token; ``head``: sorted hashes, with the end token's 0 first."""
    at = np.searchsorted(head, hashes)
    at[at == len(head)] = 0
    return np.where(head[at] == hashes, at, HEAD + tail.astype(np.int64))


def _bucket(hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    bucket = ((hashes >> np.uint64(40)) % np.uint64(n)).astype(np.int64)
    return bucket, np.argsort(bucket, kind="stable")


def _blocks(docs: DataFrame) -> DataFrame:
    """Documents (``doc_id, held_out, text``) in blocks of about ``BLOCK_BYTES``, their tokens as codes."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"block long, ids array<{id_type}>, held array<boolean>, sizes binary, codes binary, hashes binary, tail binary, trained binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for whole in batches:
            for batch in slices(whole, "text", BLOCK_BYTES):
                b = encode(batch.column(2))
                held = np.array(batch.column(1).to_pylist(), bool)
                trained = np.bincount(b.codes[np.repeat(~held, b.counts)], minlength=len(b.hashes)).astype(np.uint32)
                row = [[number], [batch.column(0).to_pylist()], [held.tolist()], [b.counts.astype(np.uint32).tobytes()], [b.codes.tobytes()],
                       [b.hashes.tobytes()], [b.tail.tobytes()], [trained.tobytes()]]
                kinds = [pa.int64(), pa.list_(batch.schema.field(0).type), pa.list_(pa.bool_()), *[pa.binary()] * 5]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(row, kinds, strict=True)],
                                                 ["block", "ids", "held", "sizes", "codes", "hashes", "tail", "trained"])
                number += 1

    return stored_by(docs.mapInArrow(run, schema), "block", "blocks")


def _corpus_counts(blocks: DataFrame, buckets: int) -> DataFrame:
    """Rows ``block, bucket, counts``: the corpus counts of a block's distinct tokens that fall into a bucket, in the
    block's order; and for block -1 one row a bucket with its token and word totals, those of its tail classes
    (``counts``), and its most frequent words (``top``: hashes, counts)."""
    schema = "block long, bucket long, counts binary, tokens long, words long, top binary"

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, hashes, tail, trained in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                h, t, n = np.frombuffer(hashes, np.uint64), np.frombuffer(tail, np.uint8), np.frombuffer(trained, np.uint32)
                bucket, order = _bucket(h, buckets)
                edges = run_edges(bucket[order])
                rows = [(block, int(bucket[order[lo]]), *(x[order[lo:hi]].tobytes() for x in (h, t, n)))
                        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(
                    zip(*rows, strict=True), [pa.int64(), pa.int64(), *[pa.binary()] * 3], strict=True)], ["block", "bucket", "h", "t", "n"])

    def meet(table: pa.Table) -> pa.Table:
        blocks_, bucket = table.column("block").to_pylist(), table.column("bucket")[0].as_py()
        h, t, n = (table.column(c).to_pylist() for c in ("h", "t", "n"))
        sizes = [len(x) // 8 for x in h]
        word, where = np.unique(np.frombuffer(b"".join(h), np.uint64), return_inverse=True)
        total = np.bincount(where, weights=np.frombuffer(b"".join(n), np.uint32), minlength=len(word)).astype(np.int64)
        tail = np.zeros(len(word), np.int64)
        tail[where] = np.frombuffer(b"".join(t), np.uint8)
        known = (total > 0) & (word != END)
        share = np.stack([np.bincount(tail[known], minlength=TAIL, weights=w).astype(np.int64) for w in (total[known], np.ones(known.sum()))])
        best = np.lexsort((word, -total))
        best = best[known[best]][:HEAD - 1]
        top = np.stack([word[best], total[best].view(np.uint64), tail[best].view(np.uint64)])
        replies = np.split(total[where], np.cumsum(sizes)[:-1])
        return pa.table({
            "block": pa.array([*blocks_, -1], pa.int64()), "bucket": pa.array([bucket] * (len(blocks_) + 1), pa.int64()),
            "counts": pa.array([*(r.tobytes() for r in replies), share.tobytes()], pa.binary()),
            "tokens": pa.array([*[0] * len(blocks_), int(total.sum())], pa.int64()),
            "words": pa.array([*[0] * len(blocks_), int((total > 0).sum())], pa.int64()),
            "top": pa.array([*[None] * len(blocks_), top.tobytes()], pa.binary())})

    sent = blocks.select("block", "hashes", "tail", "trained").mapInArrow(send, "block long, bucket long, h binary, t binary, n binary")
    return stored(sent.groupBy("bucket").applyInArrow(meet, schema), "counts")


class Corpus(NamedTuple):
    tokens: int
    words: int
    head: np.ndarray  # sorted hashes, the end token's 0 first
    inside: np.ndarray  # log10 of each class's denominator


def _corpus(replies: DataFrame) -> Corpus:
    """Totals of the training tokens: a row a bucket is read, folded by Spark as far as it grows with the buckets."""
    totals = replies.filter("block = -1")
    size = totals.agg(F.sum("tokens").alias("n"), F.sum("words").alias("v")).first()

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for counts, top in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                c = np.frombuffer(counts, np.int64).reshape(2, TAIL)
                w = np.frombuffer(top, np.uint64).reshape(3, -1).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (
                    [*range(TAIL), *w[2]], [*c[0], *w[1]], [*c[1], *[0] * w.shape[1]], [*[None] * TAIL, *w[0]])], ["tail", "n", "v", "word"])

    rows = totals.select("counts", "top").mapInArrow(share, "tail long, n long, v long, word long")
    classes = rows.filter("word IS NULL").groupBy("tail").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()
    best = rows.filter("word IS NOT NULL").orderBy(F.desc("n"), "word").limit(HEAD - 1).collect()
    n, v = np.zeros(TAIL), np.zeros(TAIL)
    for r in classes:
        n[r["tail"]], v[r["tail"]] = r["n"], r["v"]
    for r in best:
        n[r["tail"]], v[r["tail"]] = n[r["tail"]] - r["n"], v[r["tail"]] - 1
    head = np.sort(np.array([0, *(r["word"] for r in best)], np.int64).view(np.uint64))
    return Corpus(size["n"] or 0, size["v"] or 0, head, np.log10(n + v + 1))


def _statistics(blocks: DataFrame, head: np.ndarray) -> DataFrame:
    """Rows ``chunk, seen``: training counts of (context, class), contexts dealt to ``CHUNKS`` chunks by remainder."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(CONTEXTS * CLASSES, np.int64)
        for batch in batches:
            for held, sizes, codes, hashes, tail in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n = np.frombuffer(sizes, np.uint32).astype(np.int64)
                classes = classify(np.frombuffer(hashes, np.uint64), np.frombuffer(tail, np.uint8), head)[np.frombuffer(codes, np.uint32)]
                learn = np.repeat(~np.array(held, bool), n)
                seen += np.bincount((contexts(classes, n) * CLASSES + classes)[learn], minlength=len(seen))
        seen = seen.reshape(CONTEXTS, CLASSES)
        yield _seen([(k, seen[k::CHUNKS].tobytes()) for k in range(CHUNKS) if seen[k::CHUNKS].any()])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int64) for x in table.column("seen").to_pylist())
        return pa.Table.from_batches([_seen([(table.column("chunk")[0].as_py(), total.tobytes())])])

    parts = blocks.select("held", "sizes", "codes", "hashes", "tail").mapInArrow(count, "chunk int, seen binary")
    return stored(parts.groupBy("chunk").applyInArrow(add, "chunk int, seen binary"), "statistics")


def _seen(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["chunk", "seen"])


def train(statistics: DataFrame, tokens: int, steps: int = STEPS, rate: float = RATE) -> np.ndarray:
    """The weight table after ``steps`` gradient updates (Adam), each a job over the chunks of ``statistics``.

    The driver gets at most ``CHUNKS`` partial gradients of the fixed table size in each.
    """
    weights, first, second = np.zeros((ROWS, CLASSES)), np.zeros((ROWS, CLASSES)), np.zeros((ROWS, CLASSES))
    rows = features()
    for step in range(1, steps + 1):
        now = weights.astype(np.float32)

        def partial(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for chunk, seen in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    n = np.frombuffer(seen, np.int64).reshape(-1, CLASSES)
                    some = n.any(axis=1)
                    at, part, _ = gradient(now.astype(np.float64), rows[chunk::CHUNKS][some], n[some])
                    yield pa.RecordBatch.from_arrays([pa.array([at.astype(np.int32).tobytes()]), pa.array([part.astype(np.float32).tobytes()])], ["at", "part"])

        total = np.zeros((ROWS, CLASSES))
        for r in statistics.mapInArrow(partial, "at binary, part binary").collect():
            total[np.frombuffer(r["at"], np.int32)] += np.frombuffer(r["part"], np.float32).reshape(-1, CLASSES)
        total = total / max(tokens, 1) - 1e-7 * weights
        first, second = .8 * first + .2 * total, .9 * second + .1 * total * total
        pace = rate * (1 - step / (steps + 1)) ** .5
        weights = weights + pace * (first / (1 - .8 ** step)) / (np.sqrt(second / (1 - .9 ** step)) + 1e-8)
    return weights


def _squeeze(values: np.ndarray) -> bytes:
    """32-bit values, the lowest bytes of all first, compressed: small ones take little."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, 4).T
    return len(values).to_bytes(4, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unsqueeze(data: bytes, dtype: type = np.uint32) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    raw = np.frombuffer(pa.decompress(data[4:], decompressed_size=4 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, n).T).view(dtype).ravel()


def _small(values: np.ndarray) -> bytes:
    """Counts as one byte each, those of 255 and more in full after them."""
    return np.minimum(values, 255).astype(np.uint8).tobytes() + values[values >= 255].astype(np.uint32).tobytes()


def _counts(data: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(data, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(data[n:], np.uint32)
    return out


class Pairs(NamedTuple):
    """The distinct pairs of a block whose second token is in a tail class, by bucket and group."""

    of: np.ndarray  # for each token the number of its pair, -1 if its class has one word
    bucket: np.ndarray
    group: np.ndarray  # 32-bit hash of last token and class, within the bucket
    kind: np.ndarray  # class of the second token
    word: np.ndarray  # 32-bit hash of the second token
    known: np.ndarray  # its corpus count
    seen: np.ndarray  # occurrences in training


def pairs(hashes: np.ndarray, kind: np.ndarray, known: np.ndarray, token: np.ndarray, counts: np.ndarray, learn: np.ndarray, buckets: int) -> Pairs:
    """The pairs of a block; the token before a text's first is the end token."""
    before = np.append(0, token[:-1]).astype(np.int64)
    before[np.cumsum(counts) - counts] = 0
    tail = np.flatnonzero(kind[token] >= HEAD)
    key, where = np.unique(before[tail] * len(hashes) + token[tail], return_inverse=True)
    last, word = key // len(hashes), key % len(hashes)
    h = (hashes[last] ^ (kind[word].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ h >> np.uint64(32)) * np.uint64(0x94D049BB133111EB)
    bucket, group = ((h >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64), (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    order = np.lexsort((word, group, bucket))
    rank = np.empty(len(key), np.int64)
    rank[order] = np.arange(len(key))
    of = np.full(len(token), -1, np.int64)
    of[tail] = rank[where]
    seen = np.bincount(of[tail], weights=learn[tail], minlength=len(key)).astype(np.int64)
    word = word[order]
    return Pairs(of, bucket[order], group[order], kind[word], (hashes[word] & np.uint64(0xFFFFFFFF)).astype(np.uint32), known[word], seen)


def pair_factors(group: np.ndarray, word: np.ndarray, share: np.ndarray, seen: np.ndarray, steps: int = PAIR_STEPS,
                 variance: float = VARIANCE) -> np.ndarray:
    """What the softmax inside of classes adds to the log of each entry's share: its pair's weight less the group's
    normaliser.

    Entries with equal ``group`` and ``word`` are one pair; ``seen`` adds up, ``share`` is the word's part of its class.
    Weights of pairs never seen stay zero.  Updates are damped Newton steps on the penalised likelihood, all groups at once.
    """
    key = group.astype(np.uint64) << np.uint64(32) | word.astype(np.uint64)
    key, first, where = np.unique(key, return_index=True, return_inverse=True)
    n = np.bincount(where, weights=seen, minlength=len(key))
    own = (key >> np.uint64(32)).astype(np.int64)
    of = np.cumsum(np.append(0, np.diff(own) != 0)) if len(own) else own
    total, part, weight = np.bincount(of, weights=n), share[first], np.zeros(len(key))
    some = n > 0
    for _ in range(steps):
        norm = 1 + np.bincount(of, weights=part * np.expm1(weight))
        p = part * np.exp(weight) / norm[of]
        expected = total[of] * p
        step = (n - expected - weight / variance) / (expected * (1 - p) + 1 / variance + expected / 2)
        weight = np.where(some, np.clip(weight + step, -10, 15), 0.0)
    norm = 1 + np.bincount(of, weights=part * np.expm1(weight)) if len(key) else np.zeros(0)
    return (weight - np.log(norm[of]))[where]


def _factors(joined: DataFrame, corpus: Corpus, buckets: int) -> DataFrame:
    """Rows ``block, bucket, factors``: the log-factor of each pair of a block that falls into a bucket, in order."""
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names if name != "ids"}
                found = _pairs_of(row, corpus, buckets)[0]
                edges = run_edges(found.bucket)
                rows = []
                for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    runs = run_edges(found.group[lo:hi])
                    groups, kinds = found.group[lo:hi][runs[:-1]], found.kind[lo:hi][runs[:-1]].astype(np.uint8)
                    rows.append((row["block"], int(found.bucket[lo]), _squeeze(np.diff(groups, prepend=np.uint32(0))), kinds.tobytes(), _small(np.diff(runs)),
                                 found.word[lo:hi].tobytes(), _squeeze(found.known[lo:hi].astype(np.uint32)), _small(found.seen[lo:hi])))
                columns = list(zip(*rows, strict=True)) or [[]] * 8
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 2 + [pa.binary()] * 6, strict=True)],
                                                 ["block", "bucket", "groups", "kinds", "runs", "words", "known", "seen"])

    def meet(table: pa.Table) -> pa.Table:
        parts: list[list[np.ndarray]] = [[], [], [], []]
        sizes = []
        for groups, kinds, runs, words, known, seen in zip(*(table.column(c).to_pylist() for c in ("groups", "kinds", "runs", "words", "known", "seen")), strict=True):
            word, group = np.frombuffer(words, np.uint32), np.cumsum(_unsqueeze(groups), dtype=np.uint32)
            run = _counts(runs, len(group))
            inside = corpus.inside[np.repeat(np.frombuffer(kinds, np.uint8), run) - HEAD]
            share = (_unsqueeze(known) + 1.0) / 10 ** inside
            for into, x in zip(parts, (np.repeat(group, run), word, share, _counts(seen, len(word))), strict=True):
                into.append(x)
            sizes.append(len(word))
        found = pair_factors(*(np.concatenate(x) for x in parts)).astype(np.float32)
        cut = np.split(found, np.cumsum(sizes)[:-1])
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "factors": pa.array([_squeeze(c) for c in cut], pa.binary())})

    sent = joined.mapInArrow(send, "block long, bucket long, groups binary, kinds binary, runs binary, words binary, known binary, seen binary")
    return sent.groupBy("bucket").applyInArrow(meet, "block long, bucket long, factors binary")  # read once: stored, it would lie on disk twice


def _pairs_of(row: dict, corpus: Corpus, buckets: int) -> tuple[Pairs, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block: its pairs, its distinct tokens' corpus counts and classes, its tokens, and the count of each document."""
    h, n = np.frombuffer(row["hashes"], np.uint64), np.frombuffer(row["sizes"], np.uint32).astype(np.int64)
    order = _bucket(h, buckets)[1]
    known = np.zeros(len(h), np.int64)
    known[order] = np.frombuffer(b"".join(r["counts"] for r in sorted(row["replies"], key=lambda r: r["bucket"])), np.int64)
    kind = classify(h, np.frombuffer(row["tail"], np.uint8), corpus.head)
    token = np.frombuffer(row["codes"], np.uint32).astype(np.int64)
    learn = np.repeat(~np.array(row["held"], bool), n)
    return pairs(h, kind, known, token, n, learn, buckets), known, kind, token, n


def held_out(doc_id: str, folds: int = 7, fold: int = 2) -> Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo ``folds`` (a null id counts as '')."""
    return (F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds) == fold


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", folds: int = 7, fold: int = 2, steps: int = STEPS) -> DataFrame:
    """Train on the documents of all folds but one, score all of them.

    Columns: ``doc_id, held_out, n_tokens`` (words and the end token), ``n_known`` (tokens seen in training),
    ``train_tokens``, ``base_score`` (add-one unigram, log10) and ``score`` (the model, log10).  A null or empty text
    is the end token alone.  Every row is scored, repeated ones too, and trains as often.  Without training rows all
    counts are zero and the classes uniform.  An empty table gives none.  Other columns are not looked at.
    """
    source = docs.select(F.col(doc_id).alias("doc_id"), held_out(doc_id, folds, fold).alias("held_out"), F.col(text).alias("text"))
    buckets = bucket_count(docs, text)
    blocks = _blocks(source)
    replies = _corpus_counts(blocks, buckets)
    corpus = _corpus(replies)
    weights = train(_statistics(blocks, corpus.head), corpus.tokens, steps)
    table = (log_softmax(weights, features()) / np.log(10)).astype(np.float32)
    id_type = docs.schema[doc_id].dataType.simpleString()
    schema = (f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    per_block = replies.filter("block >= 0").groupBy("block").agg(F.collect_list(F.struct("bucket", "counts")).alias("replies"))
    joined = blocks.join(per_block, "block").select("block", "ids", "held", "sizes", "codes", "hashes", "tail", "replies")
    factors = _factors(joined, corpus, buckets)
    per_block = factors.groupBy("block").agg(F.collect_list(F.struct("bucket", "factors")).alias("factors"))
    joined = joined.join(per_block, "block", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                found, known, kind, token, n = _pairs_of(row, corpus, buckets)
                factor = [_unsqueeze(r["factors"], np.float32) for r in sorted(row["factors"] or [], key=lambda r: r["bucket"])]
                factor = np.concatenate([*(f.astype(np.float64) / np.log(10) for f in factor), [0.0]])  # the last: no pair
                inside = np.where(kind < HEAD, 0.0, np.log10(known + 1.0) - corpus.inside[np.maximum(kind - HEAD, 0)])
                base = np.log10(known + 1.0) - np.log10(corpus.tokens + corpus.words + 1.0)
                classes = kind[token]
                model = table[contexts(classes, n), classes].astype(np.float64) + inside[token] + factor[found.of]
                starts = np.cumsum(n) - n
                sums = [np.add.reduceat(x, starts) for x in ((known > 0)[token].astype(np.int64), base[token], model)]
                ids = batch.column("ids")[i].values
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(row["held"], pa.bool_()), pa.array(n), pa.array(sums[0]),
                     pa.array(np.full(len(n), corpus.tokens)), pa.array(sums[1]), pa.array(sums[2])],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return joined.mapInArrow(run, schema)

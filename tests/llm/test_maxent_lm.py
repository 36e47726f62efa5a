import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sheaf.llm import maxent_lm as lm


def tokens(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def held(doc):
    return zlib.crc32(str(doc).encode() if doc is not None else b"") % 7 == 2


def check_base(rows, got):
    train = Counter(t for d, x in rows if not held(d) for t in tokens(x))
    n, v = sum(train.values()), len(train)
    want = []
    for d, x in rows:
        t = tokens(x)
        want.append((str(d), held(d), len(t), sum(train[w] > 0 for w in t), n, round(sum(math.log10((train[w] + 1) / (n + v + 1)) for w in t), 6)))
    assert sorted(want) == sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got)


def test_base_against_brute_force(docs, monkeypatch):
    r = random.Random(1)
    vocab = ["Aa", "b", "é", "cc", "dd,", "x\x1cy", "zz", *(f"w{i}" for i in range(60))]
    rows = [(i, r.choice([" ", "\n", " \t"]).join(r.choice(vocab) for _ in range(r.randint(0, 90)))) for i in range(150)]
    rows += [(None, "b b"), (7, None), (7, "b"), (7, "b"), (900, ""), (901, "b zz " * 20_000)]
    df = docs(rows).repartition(4).withColumn("score", F.lit("x")).withColumn("block", F.lit(3))
    check_base(rows, lm.score(df, steps=2).collect())
    empty = lm.score(docs([]))
    assert empty.count() == 0
    only = [d for d in range(200) if held(d)][:3]
    check_base([(d, "a b") for d in only], lm.score(docs([(d, "a b") for d in only]), steps=1).collect())


def test_probabilities_sum_to_one():
    weights = np.random.default_rng(1).normal(size=(lm.ROWS, lm.CLASSES))
    assert np.allclose(np.exp(lm.log_softmax(weights, lm.features())).sum(axis=1), 1)
    b = lm.encode(pa.array(["the cat sat", "the dog", None]))
    count = np.bincount(b.codes, minlength=len(b.hashes))
    head = np.sort(np.append(np.uint64(0), b.hashes[1:2]))
    kind = lm.classify(b.hashes, b.tail, head)
    assert kind[0] == 0 and kind[1] == 1 and (kind[2:] >= lm.HEAD).all()
    for k in set(kind[kind >= lm.HEAD].tolist()):
        n, v = count[kind == k].sum(), (kind == k).sum()
        assert abs(((count[kind == k] + 1) / (n + v + 1)).sum() + 1 / (n + v + 1) - 1) < 1e-12


def test_pair_softmax_sums_to_one_and_is_where_the_gradient_vanishes():
    r = np.random.default_rng(3)
    words, shares = np.arange(12, dtype=np.uint32), r.dirichlet(np.ones(13))[:12]  # a share is left for unknown words
    group = np.repeat(np.arange(5, dtype=np.uint32), 12)
    word, share, seen = np.tile(words, 5), np.tile(shares, 5), r.integers(0, 9, 60) * (r.random(60) < .5)
    # entries of several blocks: the counts of a pair add up
    got = lm.pair_factors(np.append(group, group), np.append(word, word), np.append(share, share), np.append(seen, np.zeros(60, int)), steps=600)
    assert np.allclose(got[:60], got[60:])
    p = share * np.exp(got[:60])
    left = 1 - shares.sum()
    norm = np.array([-got[g * 12:(g + 1) * 12][seen[g * 12:(g + 1) * 12] == 0][0] for g in range(5)])  # of an unseen pair: minus the normaliser
    for g in range(5):
        own = slice(12 * g, 12 * g + 12)
        assert abs(p[own].sum() + left * np.exp(-norm[g]) - 1) < 1e-9
        weight = got[own] + norm[g]
        gradient = seen[own] - seen[own].sum() * p[own] - weight / lm.VARIANCE
        assert np.abs(gradient[seen[own] > 0]).max() < 1e-6
    assert len(lm.pair_factors(*[np.zeros(0, np.uint32)] * 2, np.zeros(0), np.zeros(0, int))) == 0


def test_pairs_of_a_block():
    b = lm.encode(pa.array(["the cat sat", "the cat ran the cat", None]))
    kind = np.where(np.arange(len(b.hashes)) < 2, np.arange(len(b.hashes)), lm.HEAD + b.tail)  # "the" is a class of its own
    known = np.arange(len(b.hashes)) * 100
    token, learn = b.codes.astype(np.int64), np.repeat([True, True, False], b.counts)
    got = lm.pairs(b.hashes, kind, known, token, b.counts, learn, 7)
    names = ["END", "the", "cat", "sat", "ran"]
    want = Counter((names[x], names[y]) for x, y in [(1, 2), (2, 3), (1, 2), (2, 4), (1, 2)])
    assert sorted(got.seen.tolist()) == sorted(want.values()) and (got.of[kind[token] < lm.HEAD] == -1).all()
    assert (got.known[got.of[got.of >= 0]] == known[token[got.of >= 0]]).all() and (got.kind[got.of[got.of >= 0]] == kind[token[got.of >= 0]]).all()
    assert (np.diff(got.bucket) >= 0).all()
    values = np.array([0, 1, 254, 255, 256, 70_000])
    assert lm._counts(lm._small(values), 6).tolist() == values.tolist()


def test_contexts():
    got = lm.contexts(np.array([5, 6, 7, 8, 9]), np.array([3, 1, 1]))
    s, w = lm.START, lm.CLASSES + 1
    assert got.tolist() == [s * w + s, s * w + 5, 5 * w + 6, s * w + s, s * w + s]


def test_gradient_against_differences():
    r = np.random.default_rng(2)
    rows, seen = lm.features()[:200], r.integers(0, 5, (200, lm.CLASSES))
    weights = r.normal(size=(lm.ROWS, lm.CLASSES)) * .1
    at, part, like = lm.gradient(weights, rows, seen)
    for i in r.integers(0, len(at), 5):
        k = int(r.integers(0, lm.CLASSES))
        moved = weights.copy()
        moved[at[i], k] += 1e-5
        assert abs((lm.gradient(moved, rows, seen)[2] - like) / 1e-5 - part[i, k]) < 1e-2


def test_model_beats_the_base_on_held_out_documents(spark):
    got = lm.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    r = got.filter("held_out").agg(F.sum("score") / F.sum("base_score")).first()[0]
    assert r == pytest.approx(r) and r < 0.99
    assert got.filter("held_out").agg(F.sum("score") / F.sum("n_tokens")).first()[0] > -3.7  # log10 a token; the base has -4.07
    assert got.filter("score > 0 OR base_score > 0").count() == 0


def test_counts_of_pairs_travel_in_few_bytes():
    """Corpus counts over 255 took five bytes each: the larger the corpus, the more of them."""
    r = np.random.default_rng(5)
    known = (10 ** r.uniform(0, 4.5, 20_000)).astype(np.uint32)
    assert len(lm._squeeze(known)) < 2.2 * len(known)
    factors = r.normal(size=1000).astype(np.float32)
    for values in (known, np.array([2 ** 32 - 1, 0], np.uint32), factors, factors[:0]):
        assert (lm._unsqueeze(lm._squeeze(values), values.dtype.type) == values).all()

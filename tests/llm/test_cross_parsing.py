import random

import numpy as np
from pyspark.sql import functions as F

from sheaf.llm import cross_parsing as cp


def brute(text, sample):
    n, at = 0, 0
    for lo in range(0, len(text), cp.BLOCK):
        block, at = text[lo:lo + cp.BLOCK], 0
        while at < len(block):
            size = 1
            while at + size < len(block) and block[at:at + size + 1] in sample:
                size += 1
            at += size
            n += 1
    return n


def test_phrases_against_brute_force():
    r = random.Random(1)
    samples = {k: "".join(r.choice(a) for _ in range(300)) for k, a in (("x", "abc"), ("y", "bcd "), ("z", "é日a"))}
    texts = ["".join(r.choice("abcd é日🎈") for _ in range(r.choice([0, 1, 7, 60, cp.BLOCK, cp.BLOCK + 9]))) for _ in range(40)]
    texts += [samples["x"] * 3, "", "ab" * 30]
    model = cp.build(samples)
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
    got = cp.phrases(model, codes, np.array([len(t) for t in texts]))
    assert got.tolist() == [[brute(t, samples[k]) for k in "xyz"] for t in texts]


def test_held_out_accuracy_and_independence(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = cp.predict(docs).join(docs, "doc_id")
    assert got.filter("held_out").select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95
    assert got.filter("score < 0 OR score > 1").count() == 0
    import zlib
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got.collect())
    # labels of held-out documents change nothing
    other = cp.predict(docs.withColumn("lang", F.when(cp.held_out(), "zz").otherwise(F.col("lang"))))
    assert other.select("doc_id", "lang_pred", "score").exceptAll(got.select("doc_id", "lang_pred", "score")).count() == 0


def test_edge_cases(docs):
    assert cp.predict(docs([])).count() == 0
    rows = [(None, None, "en", None), (1, "", "en", None), (2, "123 !", "de", None), (3, "the cat " * 40_000, None, None),
            (4, "the cat", "en", None), (5, "le chat noir", "fr", None), (5, "le chat noir", "fr", None), (8, "le chat", "fr", None)]
    df = docs(rows).withColumn("lang_pred", F.lit("q")).withColumn("score", F.lit("q"))
    got = [(r.doc_id, r.lang_pred) for r in cp.predict(df).collect()]
    assert len(got) == 8 and dict(got)[1] == dict(got)[2] == dict(got)[None] == "und" and dict(got)[3] in ("en", "fr", "de")
    none = cp.predict(docs([(1, "abc", None, None)])).first()
    assert (none.lang_pred, none.score) == ("und", 0.0)

import random

import xxhash

from sheaf.llm import simhash_vptree as sv


def brute_print(text, n=4):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", words) if w]
    if not words:
        return 0
    sh = [" ".join(words[i:i + n]) for i in range(len(words) - n + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, bits):
    n = len(prints)
    comp = list(range(n))
    def find(i):
        while comp[i] != i:
            comp[i] = comp[comp[i]]
            i = comp[i]
        return i
    for i in range(n):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                comp[find(i)] = find(j)
    return [find(i) for i in range(n)]


def sample_rows(seed=1):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 6))) for _ in range(80)]
    rows, base = [], [[r.choice(vocab) for _ in range(r.randint(0, 400))] for _ in range(60)]
    for i, words in enumerate(base):
        for _ in range(r.choice([1, 1, 3])):
            w = list(words)
            for _ in range(r.choice([0, 1, 2])):
                if w:
                    w[r.randrange(len(w))] = r.choice(vocab)
            rows.append((" ".join(w).upper() if r.random() < .2 else "\t".join(w)))
    rows += [None, "", "one", "one two\nthree", " \n "]
    return [(i * 7 % 1000, t) for i, t in enumerate(rows)]


def check(spark_docs, rows, **kw):
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in sv.near_duplicates(spark_docs, **kw).collect())
    prints = [brute_print(t) for _, t in rows]
    comp = brute_components(prints, 4)
    low = {}
    for (d, _), c in zip(rows, comp):
        low[c] = min(low.get(c, d), d)
    assert got == sorted((d, f"{p:016x}", low[c]) for (d, _), p, c in zip(rows, prints, comp))


def test_against_brute_force(docs):
    rows = sample_rows()
    check(docs(rows), rows)


def test_split_shards_by_vantage_points(spark):
    r = random.Random(5)
    centre = r.getrandbits(64)
    prints = {centre}
    for _ in range(1500):
        p = centre
        for _ in range(r.randint(0, 9)):
            p ^= 1 << r.randrange(64)
        prints.add(p)
    prints |= {r.getrandbits(64) for _ in range(500)}
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    want = brute_components(prints, 4)
    for shard in (100, 10_000):
        comp = {r.node: r.component for r in sv.connected(sv.links(df, 4, max_shard=shard)).collect()}
        got = [comp.get(p, p) for p in signed]
        assert len(set(got)) == len(set(want)) == len(set(zip(got, want)))


def test_edge_cases(spark, docs):
    from pyspark.sql import functions as F
    rows = [(None, "a b c d e"), (3, "a b c d e"), (3, "a b c d e"), (None, None), (None, "only here " * 9), (9, "x " * 50_000)]
    df = docs(rows).withColumn("fingerprint", F.lit("clash")).withColumn("component_id", F.lit("clash"))
    got = [(r.doc_id, r.component_id) for r in sv.near_duplicates(df).collect()]
    assert sorted(got, key=str) == sorted([(None, 3), (3, 3), (3, 3), (None, None), (None, None), (9, 9)], key=str)
    assert sv.near_duplicates(docs([])).count() == 0
    kept = sv.keep_one(df)
    assert kept.columns == df.columns and kept.count() == 4
    assert sv.keep_one(docs([])).count() == 0

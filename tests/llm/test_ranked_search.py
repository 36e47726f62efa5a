import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from sheaf.llm import ranked_search

TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return TERM.findall(re.sub(rb"[A-Z]+", lambda m: m[0].lower(), (text or "").encode()))


def brute(docs, items, k=10):
    held = [(i, Counter(words(t))) for i, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in set(items):
        scores = []
        for doc, c in held:
            m = 10 + 90 * c.total() * n_docs // max(1, n_terms)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                        for t in set(words(text)) if t in c)
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def found(spark, docs, items, **kw):
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, score string").repartition(3)
    q = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank int")
    return sorted(map(tuple, ranked_search.search(q, ranked_search.index(d), **kw).collect()), key=repr)


def test_nra_stops_early_and_is_exact():
    r = np.random.default_rng(5)
    n = 5000
    for _ in range(20):
        lists, total = [], np.zeros(n, np.int64)
        for _ in range(6):
            docs = r.permutation(n)[:r.integers(1, n)]
            gain = np.sort((1e6 / (1 + np.arange(len(docs))) ** r.uniform(0, 1)).astype(np.int64))[::-1]
            lists.append((docs, gain))
            total[docs] += gain
        docs, score = ranked_search.nra(lists, n, 10)
        assert (score == total[docs]).all() and set(np.flatnonzero(total >= np.sort(total)[-10])) <= set(docs.tolist())


def test_small_tables_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ranked_search, "FIRST_STEP", 2)
    r = random.Random(4)
    vocabulary = [f"w{int(r.paretovariate(0.7))}" for _ in range(400)] + ["É", "été", "日本", "A1", "a1", "x_y", "q-r"]
    docs = [(i, " ".join(r.choices(vocabulary, k=r.randrange(60)))) for i in range(300)]
    docs += [(400, None), (401, ""), (402, "..."), (403, "same text"), (403, "same text"), (None, "same text"), (404, "w1 " * 30_000)]
    items = [(i, " ".join(r.choices(vocabulary, k=r.randrange(1, 30)))) for i in range(25)]
    items += [(50, None), (51, ""), (52, "nowhere"), (53, "same"), (53, "same"), (53, "Text text"), (None, "same text")]
    assert found(spark, docs, items) == brute(docs, items)
    monkeypatch.setattr(ranked_search, "BLOCK_ITEMS", 7)
    monkeypatch.setattr(ranked_search, "SHARD_BYTES", 1000)
    assert found(spark, docs, items, k=3) == brute(docs, items, k=3)


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a")]) == [] and found(spark, [(1, "a")], []) == [] and found(spark, [(1, None)], [(1, "a")]) == []


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_query_equals_sql(spark, sf):
    import duckdb

    from sheaf.llm.queries import QUERIES, SQL
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = [(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in QUERIES["op11_ranked_search"](spark, sf).collect()]
    assert sorted(got) == sorted(con.sql(SQL["op11_ranked_search"]).fetchall())

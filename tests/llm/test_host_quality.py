import random
import re

import pytest

from sheaf.llm import host_quality as hq


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    tri = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    cov = {p for i, g in enumerate(tri) if tri.count(g) > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")),
            sum(x in lines[:i] for i, x in enumerate(lines)), len(cov))


def test_counts():
    r = random.Random(2)
    texts = ["", None, "a", "a b c a b c", "é x # *", "x\n\nx\n x\n", "a a a a a", " \n \n"]
    texts += ["".join(r.choice("aé b\n# \x1c") for _ in range(r.randint(0, 120))) for _ in range(150)]
    for t in texts:
        assert hq.counts(t.encode() if t is not None else None) == brute(t)


def test_hosts_are_shrunk_and_rejected(docs):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    good = lambda: " ".join(word() for _ in range(80))
    rows = [(i, good(), None, f"ok{i % 40}") for i in range(400)] + [(1000 + i, "bad", None, "junk") for i in range(60)]
    rows += [(2000, good(), None, "junk"), (2001, "bad", None, "tiny"), (2002, good(), None, None), (2003, None, None, "ok1")]
    got = {x.doc_id: x for x in hq.judge(docs(rows)).collect()}
    assert not got[2000].kept and not got[2000].base_failed
    assert got[2002].kept and got[2002].host_rate is None and not got[2003].kept
    assert all(got[i].kept for i in range(400))
    assert got[1000].host_rate > 0.8 and got[2001].host_rate < got[1000].host_rate
    kept = hq.keep(docs(rows).selectExpr("*", "1 AS n_words", "true AS kept"))
    assert kept.columns[-2:] == ["n_words", "kept"]
    assert {x.doc_id for x in kept.collect()} == {k for k, x in got.items() if x.kept}


def test_edge_cases(docs):
    assert hq.judge(docs([])).count() == 0 and hq.keep(docs([])).count() == 0
    rows = [(None, None), (1, "a " * 60_000), (1, "a " * 60_000)]
    got = hq.judge(docs(rows)).collect()
    assert len(got) == 3 and all(x.base_failed and not x.kept for x in got)


def test_against_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    want = con.execute(f"SELECT * EXCLUDE host_rate, round(host_rate, 9) FROM ({hq.SQL}) ORDER BY doc_id").fetchall()
    got = hq.judge(spark.read.parquet(f"{sf}/documents.parquet")).selectExpr("* EXCEPT (host_rate)", "round(host_rate, 9)")
    assert [tuple(r) for r in got.orderBy("doc_id").collect()] == [tuple(r) for r in want]

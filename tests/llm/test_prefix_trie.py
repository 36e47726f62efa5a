import hashlib
import random
import zlib

import numpy as np
import pytest

from sheaf.llm import prefix_trie
from sheaf.llm.queries import QUERIES, SQL, read

SCHEMA = "conv_id long, turn long, role string, text string, depth int"


def brute(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            convs.setdefault(c, []).append((turn is not None, turn or 0, tie, (role, text)))
    convs = {c: [t[3] for t in sorted(ts, key=lambda t: t[:3])] for c, ts in convs.items()}
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(np.fmod(c, 5))
        built[c] = tuple(convs.get(base, [])[:h] + own[h:])
    members = {}
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members.setdefault(ts[:d], []).append(c)
    children, leaves, saved = {n: 0 for n in members}, {n: 0 for n in members}, {n: 0 for n in members}
    for n in members:
        if n:
            children[n[:-1]] += 1
    for n, cs in members.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += children[n] == 0
            saved[n[:d]] += (len(cs) - 1) * len(n[-1][1].encode()) if n else 0
    out = []
    for n, cs in members.items():
        ids = ",".join(map(str, sorted(c for c in cs if built[c] == n)))
        out.append((min(cs), len(n), min(members[n[:-1]]) if n else None, len(cs), children[n], leaves[n], saved[n],
                    hashlib.sha256(ids.encode()).hexdigest()))
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 9) for r in rows], SCHEMA).repartition(3)


def test_perfect_hash_is_minimal_and_knows_strangers():
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 50, 20_000):
        a, b = (r.integers(-2**62, 2**62, n) for _ in range(2))
        table = prefix_trie.PerfectHash(a, b)
        assert sorted(table.lookup(a, b).tolist()) == list(range(n))
        assert (table.lookup(a, b + 1) == -1).all()
    with pytest.raises(ValueError):
        prefix_trie.PerfectHash(np.array([1, 1, 2]), np.array([5, 5, 6]))


def conversations(seed, n=120):
    r = random.Random(seed)
    rows = []
    for c in [*range(n), -7, -5, 10**12, 10**12 + 1]:
        if r.random() < 0.1:
            continue
        same = r.random() < 0.5  # half of them share their first turns
        for t in range(r.choice([0, 1, 2, 3, 8, 12, 40])):
            said = f"turn {t}" if same and t < 6 else r.choice(["a", "b", "é" * r.randrange(4), f"{c} {t}"])
            rows.append((c, t, r.choice(["user", "bot"]) if not same else "user", said))
    rows += [(3, None, None, None), (3, None, "user", ""), (4, 0, "user", "tie"), (4, 0, "bot", "tie"), (4, 0, "bot", "tie"), (None, 1, "user", "lost")]
    rows += [(500, t, "user", "x") for t in range(260)] + [(501, t, "user", "x") for t in range(90)]
    return rows


@pytest.mark.parametrize("shard", [4096, 40, 3])
def test_against_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(prefix_trie, "CHUNK_IDS", 3)
    monkeypatch.setattr(prefix_trie.trie, "__defaults__", (shard,))
    rows = conversations(shard)
    assert sorted(map(tuple, prefix_trie.branched_trie(frame(spark, rows)).collect()), key=repr) == brute(rows)


def test_empty_table_and_turnless_conversations(spark):
    assert prefix_trie.branched_trie(frame(spark, [])).count() == 0
    c = next(c for c in range(1, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 0)  # no base, own turn dropped
    got = prefix_trie.branched_trie(frame(spark, [(c, 0, "user", "gone")])).collect()
    assert list(map(tuple, got)) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_query_equals_sql_and_brute_force(spark):
    import duckdb
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    out = QUERIES["op13_prefix_trie"](spark, sf)
    got = sorted(map(tuple, out.collect()), key=repr)
    want = con.sql(SQL["op13_prefix_trie"])
    assert want.columns == out.columns and sorted(want.fetchall(), key=repr) == got
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in read(spark, sf, "conversations").collect()]
    assert got == brute(rows)

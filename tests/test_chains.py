"""Distributed chain folds equal their sequential definitions (brute force on random, skewed input)."""

import random

from sheaf.operators.pack import next_fit, pack_next_fit
from sheaf.plans.chains import throttle_reports
from sheaf.streaming.stateful import throttle_fold


def test_next_fit_matches_sequential(spark):
    rnd = random.Random(11)
    rows = []
    for key, n in [("hot", 300), ("a", 40), ("b", 1), ("c", 25)]:
        for i in range(1, n + 1):
            t = rnd.choice([0, 1, 5, 40, 90, 150, 400])
            rows.append((key, i, t))
    df = spark.createDataFrame(rows, "root_id string, seq long, tokens long")
    got = {(r["root_id"], r["seq"]): r["session"] for r in pack_next_fit(df, 300).collect()}
    for key in ("hot", "a", "b", "c"):
        seq = sorted((s, t) for k, s, t in rows if k == key)
        want = next_fit([t for _, t in seq], 300)
        assert [got[(key, s)] for s, _ in seq] == want, key


def test_throttle_matches_sequential(spark):
    rnd = random.Random(5)
    rows, ts = [], 0
    for i in range(500):
        ts += rnd.choice([0, 100, 300, 499_999, 500_000, 2_000_000])
        rows.append(("hot" if i % 2 else f"k{i % 7}", i, ts))
    df = spark.createDataFrame(rows, "root_id string, event_id long, _us long")
    got = {(r["root_id"], r["event_id"]) for r in throttle_reports(df, 500_000).collect()}
    want = set()
    for key in {r[0] for r in rows}:
        evs = sorted((u, e) for k, e, u in rows if k == key)
        keep, _ = throttle_fold([u for u, _ in evs], None, 500_000)
        want |= {(key, e) for (u, e), k in zip(evs, keep) if k}
    assert got == want


def test_history_replay_matches_sequential_with_hot_session(spark):
    from sheaf.plans.history import replay
    from tests.definitions import history_batch
    rnd = random.Random(9)
    rows = []
    for e in range(1500):
        sess = 1 if e % 4 else 2 + e % 5          # session 1 holds three quarters of the ops
        op = rnd.choice(["push", "push", "undo", "undo", "redo"])
        rows.append((sess, e, e, op, [f"p{rnd.randrange(9)}", f"p{rnd.randrange(9)}"] if op == "push" else []))
    df = spark.createDataFrame(rows, "session_id long, ts long, event_id long, op string, paths array<string>")
    got = sorted(tuple(r) for r in replay(df).collect())
    want = sorted(tuple(r) for r in history_batch(df).collect())
    assert got == want

"""The rolling ring of samples: equal to a window frame, whatever the ranges, with a hot key split."""

import random

import numpy as np
import pytest

from sheaf.operators import rolling


def brute(rows, n):
    out, held = [], {}
    for key, ts, v in sorted(rows):
        own = held.setdefault(key, [])
        own.append(v)
        f = sorted(own[-n:])
        m = len(f)
        out.append((key, ts, m, m * 1e6 / sum(f), f[m * 50 // 100] / 1000, f[m * 95 // 100] / 1000, f[m * 99 // 100] / 1000, f[-1] / 1000))
    return out


@pytest.mark.parametrize("n, partitions, frames", [(120, 8, 4096), (7, 8, 5), (120, 40, 3), (1, 3, 100)])
def test_rolling_stats_equal_the_frame(spark, monkeypatch, n, partitions, frames):
    monkeypatch.setattr(rolling, "FRAMES", frames)
    r = random.Random(n)
    rows = [("hot", t, r.randrange(1, 10**6)) for t in range(1500)] + [(f"k{r.randrange(40):02d}", t, r.randrange(1, 10**9)) for t in range(1500, 3000)]
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        df = spark.createDataFrame(rows + [(None, 1, 1)], "key string, ts long, v long").repartition(5)
        got = sorted(map(tuple, rolling.rolling_stats(df, "key", ["ts"], "v", n).drop("v").collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    want = sorted(brute(rows, n))
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3:] for g in got], [w[3:] for w in want])


def test_a_hot_key_lies_in_many_ranges_and_an_empty_table_is_empty(spark):
    from sheaf.plans.ordered import pinned_order
    df = spark.range(20_000).selectExpr("1 AS key", "id AS ts", "id + 1 AS v")
    assert pinned_order(df, ["key"], ["ts"]).select("_pid").distinct().count() >= 6
    halos = rolling._halos(pinned_order(df, ["key"], ["ts"]), "key", "v", 120)
    assert len(halos) >= 5 and all(len(h[1]) == 119 for h in halos.values())
    assert rolling.rolling_stats(df.limit(0), "key", ["ts"], "v").count() == 0

"""Latency samples, budgets, growth and progress.

Per-key sequences (gaps between events) use the skew-safe ordered scan; the
"last N" ring buffer is a ``row_number() <= N`` filter that Catalyst turns into
a partial WindowGroupLimit before the shuffle, so a hot key ships at most N
rows per map task; order statistics then work on at most N values per key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheaf.plans.ordered import ordered_scan

# ---------------------------------------------------------------------------
# Ring-buffer length of frame samples.
RING_SIZE = 120
# ---------------------------------------------------------------------------


def event_gaps(samples: DataFrame, key: str = "key", ts_us: str = "ts_us", tiebreak: str = "event_id") -> DataFrame:
    """µs gap to the previous sample of the same key; only strictly positive gaps kept."""
    s = samples.select(key, tiebreak, ts_us)
    g = ordered_scan(s, [key], [ts_us, tiebreak], lag={"_prev": ts_us})
    return (g.withColumn("gap_us", F.col(ts_us) - F.col("_prev"))
            .filter(F.col("gap_us") > 0).drop("_prev"))


def last_n(df: DataFrame, key: str, order: list, n: int = RING_SIZE) -> DataFrame:
    """E5: newest ``n`` rows per key (partial WindowGroupLimit, skew-safe)."""
    w = Window.partitionBy(key).orderBy(*[F.col(o).desc() for o in order])
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def latency_stats(gaps: DataFrame, key: str = "key", gap: str = "gap_us") -> DataFrame:
    """Avg rate and p50/p95/p99/max (ms) over a key's positive samples.

    Percentile index is ``floor(n * p / 100)`` into the ascending samples
    (not ``percentile_disc``); input should already be the last-N ring.
    """
    s = F.array_sort(F.collect_list(F.col(gap)))
    a = gaps.groupBy(key).agg(s.alias("_s"), F.sum(gap).alias("_sum"), F.count(F.lit(1)).alias("_n"))

    def pick(p):
        idx = F.floor(F.col("_n") * p / 100).cast("int") + 1
        return (F.element_at("_s", idx) / 1000.0)

    return a.select(
        key, F.col("_n").alias("n_samples"),
        F.when(F.col("_sum") > 0, F.col("_n") * 1_000_000.0 / F.col("_sum")).otherwise(F.lit(0.0)).alias("avg_rate"),
        pick(50).alias("p50_ms"), pick(95).alias("p95_ms"), pick(99).alias("p99_ms"),
        (F.element_at("_s", F.col("_n").cast("int")) / 1000.0).alias("max_ms"))


def budget_breaches(samples: DataFrame, elapsed: str = "elapsed", budget: str = "budget") -> DataFrame:
    """Samples over budget and how many times over."""
    return (samples.filter(F.col(elapsed) > F.col(budget))
            .withColumn("ratio", F.col(elapsed) / F.col(budget)))


def metric_growth(samples: DataFrame, key: str, value: str, order: list) -> DataFrame:
    """Last minus first value per key, saturating at 0, in MiB (partial aggregates)."""
    ordk = F.struct(*[F.col(o) for o in order])
    a = samples.groupBy(key).agg(F.min_by(F.col(value), ordk).alias("_first"),
                                 F.max_by(F.col(value), ordk).alias("_last"))
    return a.select(key, (F.greatest(F.col("_last") - F.col("_first"), F.lit(0)) / 1048576.0).alias("growth_mb"))


def progress_pct(current, total):
    """Percentage with total 0 -> 100."""
    c, t = F.col(current), F.col(total)
    return F.when(t == 0, F.lit(100.0)).otherwise(c.cast("double") / t * 100.0)


def running_progress(done: DataFrame, key: str, order: list, pos: str = "current") -> DataFrame:
    """The n-th completed item of a key's total (skew-safe position + partial count)."""
    p = ordered_scan(done, [key], order, pos=pos)  # reads a checkpoint: the total below costs no second run of `done`
    tot = p.groupBy(key).agg(F.count(F.lit(1)).alias("total"))
    return p.join(tot, key)

"""Budget packing.

* ``pack_next_fit`` (L1): greedy next-fit of files, in document order, into
  sessions of at most ``budget`` tokens (a file larger than the budget gets a
  session of its own).  The sequential fold runs distributed, in three passes
  (``plans.chains``).
* ``budget_shares`` (L2): per (root, class) running sums against a share of
  the budget -- skew-safe ordered scan.
* ``model_fit`` (L3): a fixed limits list unpivoted per document, no join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.plans.ordered import exact_long, ordered_scan

# ---------------------------------------------------------------------------
# Fixed values used by the documented workflows.
SESSION_BUDGET = 8000
SHARES = {"code": 0.6, "tests": 0.2, "config": 0.2}
MODEL_LIMITS = [("8k", 8_000), ("32k", 32_000), ("128k", 128_000), ("200k", 200_000)]
# ---------------------------------------------------------------------------

def next_fit(tokens: list[int], budget: int) -> list[int]:
    """Session index per item for greedy next-fit (pure helper)."""
    out, load, sess = [], 0, 0
    for t in tokens:
        if load > 0 and load + t > budget:
            sess += 1
            load = 0
        load += t
        out.append(sess)
    return out


def pack_next_fit(items: DataFrame, budget: int = SESSION_BUDGET) -> DataFrame:
    """L1: ``items(root_id, seq, tokens)`` -> + ``session`` (0-based per root), exact next-fit.

    Runs as a distributed chain fold (``plans.chains``): no root is gathered
    into one task.  ``next_fit`` above is the sequential definition (tests).
    """
    from sheaf.plans.chains import next_fit_sessions
    return next_fit_sessions(items.select("root_id", F.col("seq").cast("bigint"), F.col("tokens").cast("bigint")),
                             budget)


def budget_shares(items: DataFrame, budget: int, shares: dict[str, float] = SHARES) -> DataFrame:
    """L2: keep items while the running tokens of their (root, class) stay within the class share."""
    share = F.create_map(*[x for k, v in shares.items() for x in (F.lit(k), F.lit(int(budget * v)))])
    x = ordered_scan(items.select("root_id", "cls", "seq", "tokens"), ["root_id", "cls"], ["seq"],
                     cumsum={"_cum": "tokens"})
    cap = F.coalesce(F.try_element_at(share, F.col("cls")), F.lit(0))
    return x.withColumn("running", exact_long("_cum")).withColumn("cap", cap).filter(
        F.col("running") <= F.col("cap")).drop("_cum")


def model_fit(doc_stats: DataFrame, token_col: str = "output_tokens") -> DataFrame:
    """L3: for each document, which context limits it fits (unpivot of a fixed list)."""
    arr = F.array(*[F.struct(F.lit(n).alias("model"), F.lit(v).cast("bigint").alias("limit_tokens"))
                    for n, v in MODEL_LIMITS])
    return doc_stats.select("root_id", token_col, F.inline(arr)).withColumn(
        "fits", F.col(token_col) <= F.col("limit_tokens"))

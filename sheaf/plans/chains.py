"""Exact, skew-safe "greedy chain" folds: next-fit packing (L1) and leading-edge throttling.

Both folds have one shape.  An open session (or the last report) has a start
value ``a``; an item closes it, and starts the next one at its own start value,
as soon as ``a`` is under the item's limit.  Limits do not decrease along a
key's items, so the next start after ``a`` is one binary search.

Three passes, whatever the length of the chains or the share of one key:

1. Items are range-partitioned and sorted by ``(key, order)`` and pinned by a
   reliable ``checkpoint()``: a hot key is spread over many partitions.
2. Only the first and the last key of a partition go on in another one.  For
   those each task gives a step function: entry value -> value and starts at
   the partition's end.  Chains merge, so it has few steps.  A fold over a key's
   at most ``#partitions`` functions gives every partition its entry value.
3. The entries, at most one a partition border, are broadcast; each task
   replays its items from them.

Work inside a task is numpy over whole partitions of narrow rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.session import ensure_checkpoint_dir

# value column -> limit of each item, start value of each item, and how far the next partition's zero lies ahead
Curve = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray, int]]


def packing_curve(budget: int) -> Curve:
    """L1 over token counts; start values count from the run's first item, so an entry value is minus the open load.

    An item closes a session whose load is positive if it would pass the budget.
    """
    def curve(tokens: np.ndarray):
        total = np.cumsum(tokens)
        before = total - tokens
        return np.minimum(total - budget, before), before, int(total[-1])
    return curve


def throttle_curve(gap: int) -> Curve:
    """J2 over event times: a report is followed by the first event at least ``gap`` later."""
    def curve(times: np.ndarray):
        return times - gap + 1, times, 0
    return curve


def _next(limits: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.searchsorted(limits, starts, side="right")


def _ends(limits: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For a chain that starts at each item: the last start's value and the number of starts, by pointer doubling."""
    n = len(starts)
    jump, last, count = _next(limits, starts), np.arange(n), np.ones(n, np.int64)
    while (on := jump < n).any():
        to = jump[on]
        last[on], count[on], jump[on] = last[to], count[on] + count[to], jump[to]
    return starts[last], count


def _marks(limits: np.ndarray, starts: np.ndarray, first: int) -> np.ndarray:
    """Which items start a session on the chain from item ``first``."""
    mark = np.zeros(len(starts), bool)
    to = _next(limits, starts).tolist()
    while first < len(to):
        mark[first] = True
        first = to[first]
    return mark


def _partition(batches: Iterator, key: str):
    """The whole partition as one table, and the edges of its runs of one key."""
    import pyarrow as pa
    table = pa.Table.from_batches(list(batches))
    keys = table.column(key).to_numpy() if table.num_rows else np.zeros(0)
    edges = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]]).tolist() if len(keys) else [0]
    return table, keys, edges


def greedy_chain(items: DataFrame, key: str, order: list[str], value: str, curve: Curve) -> DataFrame:
    """``items`` (non-null keys, total order within a key) with ``_start`` (opens a session) and ``_nth`` (its session, from 0)."""
    spark = items.sparkSession
    ensure_checkpoint_dir(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pinned = (items.repartitionByRange(n, key, *order).sortWithinPartitions(key, *order)
              .withColumn("_pid", F.spark_partition_id()).checkpoint())
    columns = list(items.columns)
    key_type = items.schema[key].dataType.simpleString()

    def functions(batches):
        import pyarrow as pa
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        table, keys, edges = _partition(batches, key)
        values, pid = table.column(value).to_numpy(), table.column("_pid")[0].as_py()
        rows = []
        for i in sorted({0, len(edges) - 2}):
            limits, starts, shift = curve(values[edges[i]:edges[i + 1]])
            end, count = _ends(limits, starts)
            step = np.append(np.flatnonzero((end[1:] != end[:-1]) | (count[1:] != count[:-1])), len(end) - 1)
            step = step[:np.searchsorted(limits[step], starts[0], side="right") + 1]  # no entry value passes the first start
            rows.append((keys[edges[i]], pid, limits[step].tolist(), end[step].tolist(), count[step].tolist(), shift, int(end[0]), int(count[0])))
        columns = list(zip(*rows))
        kinds = [table.schema.field(key).type, pa.int32(), *[pa.list_(pa.int64())] * 3, *[pa.int64()] * 3]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)],
                                         [key, "_pid", "limits", "ends", "counts", "shift", "end", "count"])

    steps = pinned.select(key, value, "_pid").mapInArrow(functions, (
        f"`{key}` {key_type}, _pid int, limits array<long>, ends array<long>, counts array<long>, shift long, end long, count long"))

    def fold(frame):
        import pandas as pd
        out, at, done = [], None, 0
        for r in frame.sort_values("_pid").itertuples():
            if at is None:
                at, done = r.end - r.shift, r.count
                continue
            out.append((r[1], r[2], at, done))
            k = int(np.searchsorted(np.asarray(r.limits), at, side="right"))
            if k < len(r.limits):
                at, done = int(r.ends[k]), done + int(r.counts[k])
            at -= r.shift
        return pd.DataFrame(out, columns=[key, "_pid", "_entry", "_done"])

    entries = steps.groupBy(key).applyInPandas(fold, f"`{key}` {key_type}, _pid int, _entry long, _done long").checkpoint()
    joined = pinned.join(F.broadcast(entries), [key, "_pid"], "left")

    def replay(batches):
        import pyarrow as pa
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        table, _, edges = _partition(batches, key)
        values = table.column(value).to_numpy()
        mark, nth = np.zeros(len(values), bool), np.zeros(len(values), np.int64)
        for lo, hi in zip(edges, edges[1:]):
            limits, starts, _ = curve(values[lo:hi])
            entry, done = table.column("_entry")[lo].as_py(), table.column("_done")[lo].as_py() or 0
            mark[lo:hi] = _marks(limits, starts, 0 if entry is None else int(np.searchsorted(limits, entry, side="right")))
            nth[lo:hi] = done + np.cumsum(mark[lo:hi]) - 1
        out = table.select(columns).append_column("_start", pa.array(mark)).append_column("_nth", pa.array(nth))
        yield from out.to_batches()

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields)
    return joined.select(*columns, "_pid", "_entry", "_done").mapInArrow(replay, f"{names}, _start boolean, _nth long")


def next_fit_sessions(items: DataFrame, budget: int, key: str = "root_id", order: str = "seq",
                      tokens: str = "tokens") -> DataFrame:
    """L1 exact: greedy next-fit, in ``order``, into sessions of at most ``budget`` tokens.

    A session with a positive load is closed by the first item that would take it over the budget; ``session``
    numbers them from 0.
    """
    x = greedy_chain(items.select(key, order, F.col(tokens).cast("bigint").alias(tokens)), key, [order], tokens, packing_curve(budget))
    return x.select(key, order, tokens, F.col("_nth").alias("session"))


def throttle_reports(events: DataFrame, gap_us: int, key: str = "root_id", ts_us: str = "_us",
                     tiebreak: str = "event_id") -> DataFrame:
    """J2 exact: events reported by a leading-edge throttle (>= gap after the last REPORT)."""
    x = greedy_chain(events.select(key, tiebreak, F.col(ts_us).cast("bigint").alias(ts_us)), key, [ts_us, tiebreak], ts_us, throttle_curve(gap_us))
    return x.filter("_start").select(key, tiebreak)

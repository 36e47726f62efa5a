"""J8 undo/redo replay without gathering a session into one task.

The bounded-stack history is two things:

* The stack *depths* ``(L, R) = (|past|, |future|)`` form a finite state
  machine with (DEPTH+1)**2 states driven by the op type alone:
  push -> (min(L+1, D), 0); undo -> (L-1, min(R+1, D)) if L > 0;
  redo -> (min(L+1, D), R-1) if R > 0.  Rows are range-partitioned by
  (session, time).  Only the first and the last session of a partition go on
  in another one; for those each task composes its ops' transitions, a fold
  over at most #partitions functions of a session gives the entry states (at
  most one a partition border, broadcast), and a second pass replays every
  partition, all its blocks of ops side by side in numpy.
* The snapshot shown is a *cursor* over positions: a push writes its snapshot
  at positions c and c+1 and moves to c+1; an applied undo/redo moves -1/+1.
  The cursor is a running sum; the current snapshot is the latest push that
  wrote the cursor's position -- an as-of lookup done with a skew-safe running
  count of writes per (session, position) and an equi-join on unique keys.
  Rows carry their place only; the snapshots join last.

Equal to ``streaming.stateful.history_fold`` per session (tested).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.plans.ordered import pinned_order, ordered_scan
from sheaf.session import ensure_checkpoint_dir

DEPTH = 20
W = DEPTH + 1
NS = W * W
OPS = {"push": 0, "undo": 1, "redo": 2}
BLOCK = 64


def _transitions() -> np.ndarray:
    t = np.tile(np.arange(NS), (4, 1))          # row 3 = identity (unknown ops)
    for L in range(W):
        for R in range(W):
            s = L * W + R
            t[0, s] = min(L + 1, DEPTH) * W
            t[1, s] = (L - 1) * W + min(R + 1, DEPTH) if L > 0 else s
            t[2, s] = min(L + 1, DEPTH) * W + (R - 1) if R > 0 else s
    return t


def _blocks(codes: np.ndarray, edges: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ops of each run in rows of ``BLOCK`` (padded with the identity): rows, run of each, first op of each."""
    sizes = np.diff(edges)
    rows = -(-sizes // BLOCK)
    run = np.repeat(np.arange(len(sizes)), rows)
    nth = np.arange(len(run)) - np.repeat(np.cumsum(rows) - rows, rows)
    first = np.asarray(edges[:-1])[run] + nth * BLOCK
    at = first[:, None] + np.arange(BLOCK)[None, :]
    inside = at < np.asarray(edges[1:])[run][:, None]
    return np.where(inside, codes[np.minimum(at, len(codes) - 1)], 3), run, first


def _functions(grid: np.ndarray, tr: np.ndarray) -> np.ndarray:
    """The composed transition of each row of ops."""
    out = np.tile(np.arange(NS, dtype=np.int16), (len(grid), 1))
    for t in range(grid.shape[1]):
        out = tr[grid[:, t][:, None], out]
    return out


def _entries(run: np.ndarray, functions: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The state before each row of ops, from the state before each run."""
    out = np.empty(len(run), np.int64)
    state, now = 0, -1
    for i, r in enumerate(run.tolist()):  # a step for each block, not for each op
        if r != now:
            state, now = int(start[r]), r
        out[i] = state
        state = int(functions[i, state])
    return out


def _partition(batches):
    import pyarrow as pa
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return None, None
    table = pa.Table.from_batches(batches)
    key = table.column("session_id").to_numpy()
    return table, [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]


def _border_functions(batches):
    """The composed transition of a partition's first and last session."""
    import pyarrow as pa
    table, edges = _partition(batches)
    if table is None:
        return
    tr, codes = _transitions().astype(np.int16), table.column("_code").to_numpy()
    out = []
    for i in sorted({0, len(edges) - 2}):
        grid, _, _ = _blocks(codes[edges[i]:edges[i + 1]], [0, edges[i + 1] - edges[i]])
        whole = np.arange(NS)
        for f in _functions(grid, tr):
            whole = f[whole]
        out.append((table.column("session_id")[edges[i]].as_py(), table.column("_pid")[0].as_py(), whole.tolist()))
    yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(
        (pa.int64(), pa.int32(), pa.list_(pa.int32())))], names=["session_id", "_pid", "_f"])


def _fold(frame):
    import pandas as pd
    out, state = [], 0
    for r in frame.sort_values("_pid").itertuples(index=False):
        out.append((r[0], r[1], state))
        state = int(r[2][state])
    return pd.DataFrame(out[1:], columns=["session_id", "_pid", "_entry"])


def _replay_partition(batches):
    import pyarrow as pa
    table, edges = _partition(batches)
    if table is None:
        return
    tr, codes = _transitions(), table.column("_code").to_numpy()
    entry = table.column("_entry").to_numpy()
    start = np.nan_to_num(entry[edges[:-1]].astype(np.float64)).astype(np.int64)
    grid, run, first = _blocks(codes, edges)
    long = np.bincount(run)[run] > 1
    functions = np.zeros((len(grid), NS), np.int16)
    functions[long] = _functions(grid[long], tr.astype(np.int16))
    state = _entries(run, functions, start)
    before, after = np.empty(len(codes), np.int64), np.empty(len(codes), np.int64)
    stop = np.minimum(first + BLOCK, np.asarray(edges[1:])[run])
    for t in range(BLOCK):
        live = np.flatnonzero(first + t < stop)
        at = first[live] + t
        before[at] = state[live]
        state[live] = tr[codes[at], state[live]]
        after[at] = state[live]
    applied = (codes == 0) | (after != before)
    delta = np.where(applied, np.where(codes == 1, -1, 1), 0)
    yield from pa.table({
        "session_id": table.column("session_id"), "event_id": table.column("event_id"), "_mid": table.column("_mid"),
        "applied": applied, "past_len": after // W, "future_len": after % W, "_delta": delta}).to_batches()


def replay(sel_ops: DataFrame) -> DataFrame:
    """``sel_ops(session_id, ts, event_id, op, paths)`` -> one row per op:
    ``(session_id, event_id, op, applied, past_len, future_len, current)``."""
    ensure_checkpoint_dir(sel_ops.sparkSession)
    code = F.coalesce(F.element_at(F.create_map(*[x for k, v in OPS.items() for x in (F.lit(k), F.lit(v))]),
                                   F.col("op")), F.lit(3))
    label = F.array_join(F.array_sort(F.array_distinct("paths")), "|")
    ops = pinned_order(sel_ops.select("session_id", "ts", "event_id", "op", code.cast("int").alias("_code"), label.alias("_label")),
                        ["session_id"], ["ts", "event_id"])
    folded = ops.select("session_id", "_pid", "_code").mapInArrow(_border_functions, "session_id long, _pid int, _f array<int>")
    entries = folded.groupBy("session_id").applyInPandas(_fold, "session_id long, _pid int, _entry int").checkpoint()
    joined = ops.join(F.broadcast(entries), ["session_id", "_pid"], "left")  # at most one row a partition border
    rep = joined.select("session_id", "event_id", "_mid", "_code", "_entry").mapInArrow(_replay_partition, (
        "session_id long, event_id long, _mid long, applied boolean, past_len long, future_len long, _delta long"))
    rep = rep.withColumnRenamed("_mid", "_r")
    rep = ordered_scan(rep, ["session_id"], ["_r"], cumsum={"_c": "_delta"}).withColumn("_c", F.col("_c").cast("bigint"))
    rep = rep.checkpoint(eager=True)
    pushes = ops.filter((F.col("_code") == 0) & F.col("_label").isNotNull()).select("session_id", F.col("_mid").alias("_r"))
    writes = rep.join(pushes, ["session_id", "_r"], "left_semi").select(
        "session_id", "_r", F.explode(F.array(F.col("_c") - 1, F.col("_c"))).alias("_p"))
    u = (writes.select("session_id", "_p", "_r", F.lit(0).alias("_kind"), F.lit(1).alias("_w"))
         .unionByName(rep.select("session_id", F.col("_c").alias("_p"), "_r", F.lit(1).alias("_kind"), F.lit(0).alias("_w"))))
    u = ordered_scan(u, ["session_id", "_p"], ["_r", "_kind"], cumsum={"_k": "_w"})
    w = u.filter(F.col("_kind") == 0).select("session_id", "_p", "_k", F.col("_r").alias("_src"))
    cur = u.filter(F.col("_kind") == 1).select("session_id", "_p", "_k", "_r").join(w, ["session_id", "_p", "_k"], "left").select("_r", "_src")
    shown = cur.join(ops.select(F.col("_mid").alias("_src"), "_label"), "_src", "left").select("_r", F.coalesce("_label", F.lit("")).alias("current"))
    out = rep.join(shown, "_r").join(ops.select(F.col("_mid").alias("_r"), "op"), "_r")
    return out.select("session_id", "event_id", "op", "applied", "past_len", "future_len", "current")

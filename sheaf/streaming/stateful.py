"""Keyed state machines that are sequential by definition (J2 throttle, J8 history).

Streaming: ``transformWithStateInPandas`` with per-key state (a timestamp, bounded snapshot stacks, alerts that wait for
their end, the last count of a path); a key's rows are taken in order a block at a time.
Batch: the throttle's batch twin is the distributed chain fold in
``plans.chains`` and the history replay is ``plans.history.replay``.
The per-key folds themselves are small pure-Python helpers.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.streaming.sorted_state import SortedRows

# ---------------------------------------------------------------------------
# History depth of the undo/redo stacks.
HISTORY_DEPTH = 20
# ---------------------------------------------------------------------------

THROTTLE_OUT = T.StructType([
    T.StructField("root_id", T.StringType()), T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampType()),
])
HISTORY_OUT = T.StructType([
    T.StructField("session_id", T.LongType()), T.StructField("event_id", T.LongType()),
    T.StructField("op", T.StringType()), T.StructField("applied", T.BooleanType()),
    T.StructField("past_len", T.LongType()), T.StructField("future_len", T.LongType()),
    T.StructField("current", T.StringType()),
])


# ---------------------------------------------------------------- J2 throttle
def throttle_fold(us: list[int], last: int | None, gap_us: int) -> tuple[list[bool], int | None]:
    """Leading-edge throttle: report an event iff >= gap after the last REPORT.

    Events inside the window are dropped (not deferred) -- the watcher drains
    and loses them.  ``us`` must be in time order.
    """
    out = []
    for t in us:
        if last is None or t - last >= gap_us:
            out.append(True)
            last = t
        else:
            out.append(False)
    return out, last


def throttle_stream(changes: DataFrame, gap_us: int) -> DataFrame:
    """J2 streaming: per-root ``ValueState(last_report_us)``; rows sorted by ts inside each batch."""
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    class Throttle(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.last = handle.getValueState("last", T.StructType([T.StructField("us", T.LongType())]))
            self.rows = SortedRows(handle, "rows", ["ts", "event_id"])

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            last = self.last.get()[0] if self.last.exists() else None
            for pdf in self.rows.merged(rows):
                us = (pdf["ts"].astype("int64") // 1000).tolist()
                keep, last = throttle_fold(us, last, gap_us)
                yield pdf.loc[keep, ["root_id", "event_id", "ts"]]
            if last is not None:
                self.last.update((int(last),))

        def close(self) -> None:
            pass

    return (changes.select("root_id", "event_id", "ts").groupBy("root_id")
            .transformWithStateInPandas(statefulProcessor=Throttle(), outputStructType=THROTTLE_OUT,
                                        outputMode="Append", timeMode="None"))


# ---------------------------------------------------------------- J8 history
def history_fold(state: dict, ops: list[tuple], depth: int = HISTORY_DEPTH) -> tuple[dict, list[tuple]]:
    """Undo/redo over snapshot sets with bounded stacks.

    push(s): clear redo, push s, current = s (the post-change state is recorded);
    undo: pop past -> current, previous current to future; redo symmetric.
    Each stack keeps its newest ``depth`` entries.  Returns new state and one
    ``(event_id, op, applied, past_len, future_len, current)`` per op.
    """
    cur, past, fut = state["current"], state["past"], state["future"]
    out = []
    for event_id, op, paths in ops:
        applied = True
        if op == "push":
            snap = sorted(set(paths))
            fut = []
            past = (past + [snap])[-depth:]
            cur = snap
        elif op == "undo":
            if past:
                prev = past[-1]
                past = past[:-1]
                fut = (fut + [cur])[-depth:]
                cur = prev
            else:
                applied = False
        elif op == "redo":
            if fut:
                nxt = fut[-1]
                fut = fut[:-1]
                past = (past + [cur])[-depth:]
                cur = nxt
            else:
                applied = False
        else:
            applied = False
        out.append((event_id, op, applied, len(past), len(fut), "|".join(cur)))
    return {"current": cur, "past": past, "future": fut}, out


def _empty_history() -> dict:
    return {"current": [], "past": [], "future": []}


def history_stream(sel_ops: DataFrame) -> DataFrame:
    """J8 streaming: past and future stacks as ``ListState``, the current snapshot as ``ValueState`` of a session.

    A micro-batch's operations are taken in order a block at a time (:class:`SortedRows`), so a session of any size holds
    one block and its bounded stacks.
    """
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    snapshot = T.StructType([T.StructField("paths", T.ArrayType(T.StringType()))])

    class History(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.past = handle.getListState("past", snapshot)
            self.future = handle.getListState("future", snapshot)
            self.current = handle.getValueState("current", snapshot)
            self.rows = SortedRows(handle, "rows", ["ts", "event_id"])

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            state = _empty_history()
            for name in ("past", "future"):
                if getattr(self, name).exists():
                    state[name] = [list(s[0]) for s in getattr(self, name).get()]
            if self.current.exists():
                state["current"] = list(self.current.get()[0])
            for pdf in self.rows.merged(rows):
                ops = [(int(e), o, list(p) if p is not None else []) for e, o, p in zip(pdf["event_id"], pdf["op"], pdf["paths"])]
                state, out = history_fold(state, ops)
                res = pd.DataFrame(out, columns=["event_id", "op", "applied", "past_len", "future_len", "current"])
                res.insert(0, "session_id", int(key[0]))
                yield res
            for stack, kept in ((self.past, state["past"]), (self.future, state["future"])):
                stack.put([(s,) for s in kept]) if kept else stack.clear()
            self.current.update((state["current"],))

        def close(self) -> None:
            pass

    return (sel_ops.select("session_id", "ts", "event_id", "op", "paths").groupBy("session_id")
            .transformWithStateInPandas(statefulProcessor=History(), outputStructType=HISTORY_OUT,
                                        outputMode="Append", timeMode="None"))


# ---------------------------------------------------------------- J6 alerts
ALERT_OUT = T.StructType([
    T.StructField("key", T.LongType()), T.StructField("event_id", T.LongType()), T.StructField("severity", T.StringType()),
    T.StructField("shown_us", T.LongType()), T.StructField("replaced", T.BooleanType()),
])


def ended_alerts(waiting: list[tuple], now_us: int) -> tuple[list[tuple], list[tuple]]:
    """Alerts ``(us, event_id, severity, ttl_us)`` in order: what has ended by ``now_us``, and what still waits.

    An alert has ended when its time to live is over or a newer one of its key has come; before an ended one, all have.
    Ended ones are ``(event_id, severity, shown_us, replaced)``.
    """
    out, kept = [], []
    for i, (us, event_id, severity, ttl) in enumerate(waiting):
        following = waiting[i + 1][0] if i + 1 < len(waiting) else None
        if us + ttl <= now_us or following is not None and following <= now_us:
            replaced = following is not None and following < us + ttl
            out.append((event_id, severity, (following if replaced else us + ttl) - us, replaced))
        else:
            kept.append(waiting[i])
    return out, kept


def alert_timeline_stream(alerts: DataFrame, watermark: str = "1 minute") -> DataFrame:
    """J6 streaming: how long each alert was shown, given out when it ends; the rows of ``changes.alert_timeline``.

    ``alerts(key, ts, event_id, severity, ttl_us)``.  An alert waits in its key's ``ListState``; an event-time timer at its
    end gives it out even if nothing more arrives for the key, and then it leaves the state.  Alerts may come out of order
    within the watermark; later ones are dropped.  State: the alerts of a key whose end the watermark has not passed.
    """
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    alert = T.StructType([T.StructField("us", T.LongType()), T.StructField("event_id", T.LongType()),
                          T.StructField("severity", T.StringType()), T.StructField("ttl_us", T.LongType())])

    class Alerts(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.waiting = handle.getListState("waiting", alert)

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            for pdf in rows:
                new = list(zip(*(pdf[c].tolist() for c in ("us", "event_id", "severity", "ttl_us"))))
                self.waiting.appendList(new)
                for end in {(us + ttl) // 1000 + 1 for us, _, _, ttl in new}:
                    self.handle.registerTimer(end)
            yield pd.DataFrame({f.name: [] for f in ALERT_OUT}).astype(
                {"key": "int64", "event_id": "int64", "severity": "object", "shown_us": "int64", "replaced": "bool"})

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            # an end before the watermark: no alert of that time is missing any more
            waiting = sorted(map(tuple, self.waiting.get())) if self.waiting.exists() else []
            out, kept = ended_alerts(waiting, timerValues.getCurrentWatermarkInMs() * 1000)
            self.waiting.put(kept) if kept else self.waiting.clear()
            res = pd.DataFrame(out, columns=["event_id", "severity", "shown_us", "replaced"])
            res.insert(0, "key", int(key[0]))
            yield res.astype({"event_id": "int64", "shown_us": "int64", "replaced": "bool"})

        def close(self) -> None:
            pass

    rows = alerts.withWatermark("ts", watermark).select("key", "ts", F.unix_micros("ts").alias("us"), "event_id", "severity", "ttl_us")
    return rows.groupBy("key").transformWithStateInPandas(statefulProcessor=Alerts(), outputStructType=ALERT_OUT,
                                                          outputMode="Append", timeMode="EventTime")


# ---------------------------------------------------------------- L7 tokens
TOKENS_OUT = T.StructType([
    T.StructField("root_id", T.StringType()), T.StructField("path", T.StringType()), T.StructField("doc_id", T.LongType()),
    T.StructField("tokens", T.LongType()), T.StructField("delta", T.LongType()), T.StructField("running_delta", T.LongType()),
])


def token_deltas(state: tuple[int, int] | None, counts: list[int]) -> tuple[tuple[int, int], list[tuple]]:
    """``(first, last)`` counts of a path and its next counts: the new state, and ``(tokens, delta, running_delta)`` of each."""
    first, last = state if state is not None else (counts[0], None)
    out = []
    for n in counts:
        out.append((n, None if last is None else n - last, n - first))
        last = n
    return (first, last), out


def incremental_tokens_stream(versions: DataFrame) -> DataFrame:
    """L7 streaming: for every new version of a path, its tokens, the change to the version before, and to the first.

    ``versions(root_id, path, doc_id, tokens)``.  A root's ``MapState`` has the first and last count of each path; only
    paths in a micro-batch are touched, and each of its versions is one row out (update mode).  Versions of a path must
    not go back across micro-batches; within one they are put in order.
    """
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    class Tokens(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.counts = handle.getMapState("counts", T.StructType([T.StructField("path", T.StringType())]), T.StructType(
                [T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]))
            self.rows = SortedRows(handle, "rows", ["path", "doc_id"])

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            for pdf in self.rows.merged(rows):
                frames = []
                for path, group in pdf.groupby("path", sort=False):
                    state = tuple(self.counts.getValue((path,))) if self.counts.containsKey((path,)) else None
                    state, out = token_deltas(state, group["tokens"].tolist())
                    self.counts.updateValue((path,), state)
                    res = pd.DataFrame(out, columns=["tokens", "delta", "running_delta"]).astype("Int64")
                    res.insert(0, "doc_id", group["doc_id"].tolist())
                    res.insert(0, "path", path)
                    frames.append(res)
                res = pd.concat(frames, ignore_index=True)
                res.insert(0, "root_id", key[0])
                yield res

        def close(self) -> None:
            pass

    rows = versions.select("root_id", "path", F.col("doc_id").cast("bigint").alias("doc_id"), F.col("tokens").cast("bigint").alias("tokens"))
    return rows.groupBy("root_id").transformWithStateInPandas(statefulProcessor=Tokens(), outputStructType=TOKENS_OUT,
                                                              outputMode="Update", timeMode="None")

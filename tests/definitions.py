"""Sequential definitions that distributed operators are compared with."""

import pandas as pd

from sheaf.streaming.stateful import HISTORY_OUT, _empty_history, history_fold


def history_batch(sel_ops):
    """J8 sequential definition (tests): replay each session's ops in (ts, event_id) order."""
    def per_session(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts", "event_id"], kind="mergesort")
        ops = [(int(e), o, list(p) if p is not None else []) for e, o, p in
               zip(pdf["event_id"], pdf["op"], pdf["paths"])]
        _, out = history_fold(_empty_history(), ops)
        res = pd.DataFrame(out, columns=["event_id", "op", "applied", "past_len", "future_len", "current"])
        res.insert(0, "session_id", int(pdf["session_id"].iloc[0]))
        return res

    return (sel_ops.select("session_id", "ts", "event_id", "op", "paths")
            .groupBy("session_id").applyInPandas(per_session, HISTORY_OUT))

"""A key's rows of one micro-batch in order, without holding them: an external merge sort in the state store.

Rows of a key reach a stateful processor batch by batch in no certain order.  Each batch is sorted by itself and kept as
blocks of ``BLOCK`` rows in a ``MapState`` (Arrow bytes, in the state store's own files); then the runs are merged a block
of each at a time.  Memory: one incoming batch, and one block for each of the key's runs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import types as T

BLOCK = 1000
_KEY = T.StructType([T.StructField("run", T.IntegerType()), T.StructField("block", T.IntegerType())])
_VALUE = T.StructType([T.StructField("rows", T.BinaryType())])


def _packed(rows: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(rows, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(data).read_pandas()


class SortedRows:
    """``SortedRows(handle, "name", ["ts", "event_id"]).merged(rows)``: the rows of an iterator of frames, in order."""

    def __init__(self, handle, name: str, order: list[str]):
        self.blocks = handle.getMapState(name, _KEY, _VALUE)
        self.order = order

    def _sorted(self, frame: pd.DataFrame) -> pd.DataFrame:
        return frame.sort_values(self.order, kind="mergesort", ignore_index=True)

    def merged(self, frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Frames of at most a few blocks, each and all of them in order; the state is empty again at the end."""
        runs: list[int] = []  # blocks of each run
        only = None
        for frame in frames:
            if not len(frame):
                continue
            frame = self._sorted(frame)
            if only is None and not runs:
                only = frame  # one batch alone needs no state
                continue
            if only is not None:
                runs.append(self._keep(len(runs), only))
                only = None
            runs.append(self._keep(len(runs), frame))
        if only is not None:
            yield from (only.iloc[lo:lo + BLOCK] for lo in range(0, len(only), BLOCK))
        elif runs:
            yield from self._merge(runs)

    def _keep(self, run: int, frame: pd.DataFrame) -> int:
        n = -(-len(frame) // BLOCK)
        for block in range(n):
            self.blocks.updateValue((run, block), (_packed(frame.iloc[block * BLOCK:(block + 1) * BLOCK]),))
        return n

    def _merge(self, runs: list[int]) -> Iterator[pd.DataFrame]:
        at = [0] * len(runs)
        held: dict[int, pd.DataFrame] = {}
        while True:
            for run, n in enumerate(runs):
                if run not in held and at[run] < n:
                    held[run] = _unpacked(bytes(self.blocks.getValue((run, at[run]))[0]))
                    self.blocks.removeKey((run, at[run]))
                    at[run] += 1
            if not held:
                return
            # rows up to the smallest last row of a block whose run goes on can have nothing before them
            ends = [tuple(held[r][self.order].iloc[-1]) for r in held if at[r] < runs[r]]
            both = pd.concat([f.assign(_run=r) for r, f in held.items()], ignore_index=True)
            both = both.sort_values(self.order, kind="mergesort", ignore_index=True)
            if ends:
                n = _upto(both[self.order], min(ends))
                rest = both.iloc[n:]
                held = {r: f.drop(columns="_run") for r, f in rest.groupby("_run")}
                both = both.iloc[:n]
            else:
                held = {}
            yield both.drop(columns="_run")


def _upto(keys: pd.DataFrame, end: tuple) -> int:
    """How many of the sorted ``keys`` are at most ``end``."""
    below, same = 0, pd.Series(True, index=keys.index)
    for column, value in zip(keys.columns, end, strict=True):
        below += int((same & (keys[column] < value)).sum())
        same &= keys[column] == value
    return below + int(same.sum())

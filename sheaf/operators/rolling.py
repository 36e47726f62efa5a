"""E5/D14 as a rolling frame: order statistics over the newest N samples of a key, at every sample.

``ROWS BETWEEN 119 PRECEDING`` with percentiles would send a key to one task and sort a frame a row.  Here the samples lie
in ranges of (key, order), so a hot key is spread over many partitions.  What a range lacks are the N - 1 samples of its
first key that lie before it: its *halo*.  Halos are at most N - 1 rows a range border, found by small windows over the
ranges' last rows, and go to the tasks as one bounded table.  A task then walks its range once and takes the frames of
thousands of samples at a time as the rows of a matrix, sorted along its rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheaf.operators.metrics import RING_SIZE
from sheaf.plans.ordered import pinned_order

FRAMES = 4096
_NONE = np.iinfo(np.int64).max
STATS = ["n_samples", "avg_rate", "p50_ms", "p95_ms", "p99_ms", "max_ms"]


def frame_stats(before: np.ndarray, start: np.ndarray, values: np.ndarray, n: int = RING_SIZE) -> dict[str, np.ndarray]:
    """:data:`STATS` of the last ``n`` samples up to each of ``values``.

    ``before`` are samples that come before ``values``; ``start`` has for each value the place, in ``before`` and
    ``values`` together, of the first sample of its key.
    """
    both = np.append(before, values).astype(np.int64)
    at = np.arange(len(before), len(both))
    place = at[:, None] - np.arange(n - 1, -1, -1)[None, :]
    inside = place >= np.maximum(start, at - n + 1)[:, None]
    frame = np.where(inside, both[np.maximum(place, 0)], _NONE)
    count = inside.sum(axis=1)
    total = np.where(inside, frame, 0).sum(axis=1)
    frame.sort(axis=1)
    rows = np.arange(len(at))
    out = {"n_samples": count, "avg_rate": np.divide(count * 1_000_000.0, total, out=np.zeros(len(at)), where=total > 0)}
    for p in (50, 95, 99):
        out[f"p{p}_ms"] = frame[rows, count * p // 100] / 1000.0
    out["max_ms"] = frame[rows, count - 1] / 1000.0
    return out


def _halos(ranges: DataFrame, key: str, value: str, n: int) -> dict[int, tuple]:
    """For each range whose first key began before it: that key, and its last ``n`` - 1 values before the range, in order."""
    sizes = ranges.groupBy(key, "_pid").agg(F.count(F.lit(1)).alias("_n"), F.max("_mid").alias("_last"))
    of_key = Window.partitionBy(key).orderBy("_pid")
    sizes = sizes.withColumn("_starts", F.lag("_pid").over(of_key).isNotNull()).withColumn("_ends", F.lead("_pid").over(of_key).isNotNull())
    across = sizes.filter("_starts OR _ends")  # at most two keys a range
    tails = ranges.join(F.broadcast(across.select(key, "_pid", "_last")), [key, "_pid"]).filter(F.col("_last") - F.col("_mid") < n - 1)
    lists = tails.groupBy(key, "_pid").agg(F.transform(F.array_sort(F.collect_list(F.struct("_mid", value))), lambda x: x[value]).alias("_tail"))
    halos: dict[int, tuple] = {}
    held, last = [], None
    for row in across.join(lists, [key, "_pid"]).orderBy(key, "_pid").toLocalIterator():  # n - 1 values a border
        if row["_starts"] and row[key] == last:
            halos[row["_pid"]] = (last, held)
            held = (held + row["_tail"])[-(n - 1):]
        else:
            held = row["_tail"][-(n - 1):]
        last = row[key]
    return halos


def rolling_stats(samples: DataFrame, key: str, order: list[str], value: str, n: int = RING_SIZE) -> DataFrame:
    """``samples`` (``key``, ``order``, a positive BIGINT ``value``) with :data:`STATS` over the last ``n`` rows of its key.

    ``order`` must be total within a key; a null key's rows are left out.  One range exchange, no second shuffle.
    """
    rows = samples.filter(F.col(key).isNotNull()).select(*dict.fromkeys([key, *order, value]))
    ranges = pinned_order(rows, [key], order)
    halos = _halos(ranges, key, value, n)
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, before = None, np.zeros(0, np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, FRAMES):
                batch = whole.slice(at, FRAMES)
                keys, values = batch.column(names.index(key)), batch.column(names.index(value)).to_numpy()
                if last is None:
                    last, before = halos.get(batch.column(len(names))[0].as_py(), (None, before))
                    before = np.array(before, np.int64)
                codes = keys.dictionary_encode().indices.to_numpy()
                first = np.append(0, np.flatnonzero(np.diff(codes)) + 1)
                start = np.repeat(len(before) + first, np.diff(np.append(first, len(codes))))
                if keys[0].as_py() == last:
                    start[:first[1] if len(first) > 1 else len(start)] = 0
                stats = frame_stats(before, start, values, n)
                yield pa.RecordBatch.from_arrays([*batch.columns[:len(names)], *(pa.array(stats[s]) for s in STATS)], [*names, *STATS])
                both = np.append(before, values)
                last, before = keys[len(keys) - 1].as_py(), both[max(int(start[-1]), len(both) - n + 1):]

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return ranges.select(*names, "_pid").mapInArrow(run, f"{kinds}, n_samples bigint, {', '.join(f'{s} double' for s in STATS[1:])}")

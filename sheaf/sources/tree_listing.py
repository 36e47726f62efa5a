"""A1 over raw storage: directory trees of any shape, listed in rounds that share the work.

A round takes the directories found so far and not yet listed (the frontier) and deals them evenly to tasks.  Each task
walks down from its directories until it has listed ``budget`` entries; directories it did not get to go into the next
round's frontier.  The first round's budget is small and grows with the rounds, so a tree that hangs on one directory is
dealt out at once, and the number of rounds grows with the logarithm of the entries, not with the depth.  (One chain of
directories without side branches is sequential in any method; a task walks it as far as its budget goes.)

Every round is a stored table below the shared checkpoint folder: a lost executor repeats its task's directories only.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.session import pinned_table
from sheaf.sources import stores
from sheaf.sources.stores import root_ids

FIRST_BUDGET = 256
LAST_BUDGET = 200_000
ROWS = "root_id string, rel_path string, depth int, is_dir boolean, size bigint, modified_ns bigint, pending boolean, task int"
_NAMES = [c.split()[0] for c in ROWS.split(", ")]


def _walker(roots: dict[str, str], budget: int, max_depth: int | None):
    """A task's walk over its rows ``root_id, rel_path, depth`` of directories; gives :data:`ROWS`."""
    def walk(batches: Iterator[pa.RecordBatch], task: int) -> Iterator[tuple]:
        left = budget
        for batch in batches:
            stack = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            while stack:
                root, rel, depth = stack.pop()
                if left <= 0:  # what is left of the frontier goes to the next round
                    yield root, rel, depth, True, None, None, True, task
                    continue
                if max_depth is not None and depth >= max_depth:
                    continue
                for name, is_dir, size, modified in stores.entries(stores.join(roots[root], rel)) or ():
                    child = f"{rel}/{name}" if rel else name
                    left -= 1
                    yield root, child, depth + 1, is_dir, None if is_dir else size, modified, False, task
                    if is_dir:
                        stack.append((root, child, depth + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        rows = walk(batches, TaskContext.get().partitionId())
        while out := list(itertools.islice(rows, 10_000)):
            yield _rows(out)
    return run


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.bool_(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], _NAMES)


def list_rounds(spark: SparkSession, paths: list[str], max_depth: int | None = None, first_budget: int = FIRST_BUDGET,
                tasks: int | None = None) -> list[DataFrame]:
    """The stored tables of all rounds, with :data:`ROWS`; rows with ``pending`` only hand a directory on."""
    roots = root_ids(paths)
    readable = {i: p for i, p in roots.items() if stores.entries(p) is not None}
    tasks = tasks or max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    frontier = spark.createDataFrame([(i, "", 0) for i in readable], "root_id string, rel_path string, depth int")
    budget, rounds, waiting = first_budget, [], len(readable)
    while waiting:
        n = min(tasks, waiting)
        # dealt one by one: a round robin exchange over a handful of paths, whatever tree they come from
        done = pinned_table(frontier.repartition(n).mapInArrow(_walker(readable, budget, max_depth), ROWS), "listing")
        rounds.append(done)
        frontier = done.filter("pending").select("root_id", "rel_path", "depth")
        waiting = frontier.count()
        budget = min(LAST_BUDGET, budget * 8)
    return rounds


def list_tree(spark: SparkSession, paths: list[str], max_depth: int | None = None, **how) -> DataFrame:
    """``root_id, rel_path, is_dir, size, modified_ns`` of every entry, a root's own row (``rel_path`` '') included.

    Missing or unreadable roots have no rows, unreadable directories no entries; symbolic links are not followed.
    Paths may be local, ``file:`` URIs, or URIs of any store that Arrow's file systems open.
    """
    rounds = list_rounds(spark, paths, max_depth, **how)
    here = spark.createDataFrame([(i, "", True, None, None) for i, p in root_ids(paths).items() if stores.entries(p) is not None],
                                 "root_id string, rel_path string, is_dir boolean, size bigint, modified_ns bigint")
    for done in rounds:
        here = here.unionByName(done.filter("NOT pending").select("root_id", "rel_path", "is_dir", "size", "modified_ns"))
    return here


def with_content(listing: DataFrame, roots: dict[str, str]) -> DataFrame:
    """``listing`` with the bytes of each file (null for directories and files that cannot be read)."""
    rows = listing.select("root_id", "rel_path", "is_dir", "size")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):  # few files at a time
                batch = whole.slice(at, 64)
                data = [None if is_dir else stores.read_bytes(stores.join(roots[root], rel)) for root, rel, is_dir in
                        zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(data, pa.binary())], [*batch.schema.names, "content"])

    return rows.mapInArrow(run, "root_id string, rel_path string, is_dir boolean, size bigint, content binary")


def read_tree(spark: SparkSession, paths: list[str], content: bool = False, max_depth: int | None = None) -> DataFrame:
    """A1: listing rows of raw directory trees, shaped like ``derive_entries`` output."""
    from sheaf.operators.entries import _shape
    listing = list_tree(spark, paths, max_depth).drop("modified_ns")
    return _shape(with_content(listing, root_ids(paths)) if content else listing, keep_content=content)

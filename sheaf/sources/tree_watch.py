"""A8 of a watched tree: a streaming Python DataSource whose offsets are listing snapshots and whose rows are their
differences.

A version is one listing of the roots, kept as one Parquet file a task below a snapshot folder that driver and executors
share.  An offset names a version and the time it was taken.  To read from version n to the next, every task takes the
directories that hash to it, lists each, compares with version n, and gives a row for every file or directory that was
created or removed and every file whose size or time of change differs; it writes what it found as its part of the next
version.  A new directory is walked by the task that finds it and dealt by its hash from the next version on.  A task
that runs again writes the same file anew, so lost executors and repeated batches leave whole snapshots.

Like a watcher, a stream reports what happens after it was set up (:func:`watch` takes version 0 by the distributed
listing); every trigger compares once.
"""

from __future__ import annotations

import itertools
import json
import time
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from sheaf.sources import stores
from sheaf.sources.stores import root_ids

PARTS = 32
SCHEMA = "root_id string, ts timestamp, kind string, path string, message string, event_id bigint"
#: One row for each entry of a directory ``dir``, and one with an empty name for the directory itself.
_SNAPSHOT = pa.schema([("part", pa.int32()), ("root_id", pa.string()), ("dir", pa.string()), ("name", pa.string()),
                       ("is_dir", pa.bool_()), ("size", pa.int64()), ("modified_ns", pa.int64())])


def part_of(root: str, directory: str, parts: int) -> int:
    return zlib.crc32(f"{root}\0{directory}".encode()) % parts


def _write(folder: str, part: int, rows: list[tuple]) -> None:
    """A task's part of a version: sorted by owner, a row group for each, put in place at once."""
    store, at = stores.open_store(folder)
    store.create_dir(at, recursive=True)
    rows.sort(key=lambda r: r[0])
    with store.open_output_stream(f"{at}/.{part}.writing") as out, pq.ParquetWriter(out, _SNAPSHOT) as writer:
        for _, group in itertools.groupby(rows, key=lambda r: r[0]):
            columns = zip(*group, strict=True)
            writer.write_table(pa.table([pa.array(c, t) for c, t in zip(columns, _SNAPSHOT.types, strict=True)], schema=_SNAPSHOT))
    store.move(f"{at}/.{part}.writing", f"{at}/{part}.parquet")


def _read(folder: str, part: int) -> Iterator[tuple]:
    """The rows of a version that belong to ``part``; row groups of other parts are skipped by their statistics."""
    store, at = stores.open_store(folder)
    for info in store.get_file_info(arrow_fs.FileSelector(at)):
        if info.base_name.endswith(".parquet") and not info.base_name.startswith("."):
            table = pq.read_table(info.path, filesystem=store, filters=pc.field("part") == part)
            yield from zip(*(table.column(c).to_pylist() for c in _SNAPSHOT.names[1:]), strict=True)


class _Part(InputPartition):
    def __init__(self, part: int, start: dict, end: dict):
        super().__init__(part)
        self.part, self.start, self.end = part, start, end


class WatchReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.roots = root_ids(json.loads(options["paths"]))
        self.snapshots, self.parts = options["snapshots"].rstrip("/"), int(options.get("parts", PARTS))
        self.version: int | None = None

    def _folder(self, version: int) -> str:
        return f"{self.snapshots}/{version}"

    def _known(self) -> list[int]:
        store, at = stores.open_store(self.snapshots)
        return sorted(int(i.base_name) for i in store.get_file_info(arrow_fs.FileSelector(at, allow_not_found=True)) if i.base_name.isdigit())

    def initialOffset(self) -> dict:
        known = self._known()
        if not known:
            raise ValueError(f"{self.snapshots} has no snapshot; set the stream up with watch()")
        return {"version": known[0], "us": 0}

    def latestOffset(self) -> dict:
        """The next version: named here, listed by the tasks."""
        if self.version is None:
            self.version = max(self._known())
        self.version += 1
        return {"version": self.version, "us": time.time_ns() // 1000}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if start["version"] == end["version"]:
            return []
        return [_Part(p, start, end) for p in range(self.parts)]

    def read(self, partition: _Part) -> Iterator[tuple]:
        if partition is None:
            return
        from datetime import datetime, timezone
        at = datetime.fromtimestamp(partition.end["us"] / 1e6, tz=timezone.utc)
        now: list[tuple] = []
        for root, path, kind in self._differences(partition.part, self._folder(partition.start["version"]), now):
            event = zlib.crc32(f"{root}\0{path}\0{kind}".encode()) | partition.end["version"] << 32
            yield root, at, kind, path, None, event
        _write(self._folder(partition.end["version"]), partition.part, now)

    def _differences(self, part: int, before: str, now: list[tuple]) -> Iterator[tuple[str, str, str]]:
        known: dict[tuple[str, str], dict] = {}
        for root, directory, name, is_dir, size, modified in _read(before, part):
            held = known.setdefault((root, directory), {})
            if name:
                held[name] = (is_dir, size, modified)
        for (root, directory), held in known.items():
            if root not in self.roots:
                continue
            found = stores.entries(stores.join(self.roots[root], directory))
            if found is None:
                # the directory is gone, or it is a root that may come back
                yield from ((root, f"{directory}/{n}" if directory else n, "remove") for n in held)
                if not directory:
                    now.append((part, root, "", "", True, None, None))
                continue
            now.append((part, root, directory, "", True, None, None))
            for name, is_dir, size, modified in found:
                path, old = f"{directory}/{name}" if directory else name, held.pop(name, None)
                now.append((part, root, directory, name, is_dir, size, modified))
                if old is not None and old[0] != is_dir:
                    yield root, path, "remove"
                    old = None
                if old is None:
                    yield root, path, "create"
                    if is_dir:
                        yield from self._new_tree(root, path, now)
                elif not is_dir and old[1:] != (size, modified):
                    yield root, path, "modify"
            yield from ((root, f"{directory}/{n}" if directory else n, "remove") for n in held)

    def _new_tree(self, root: str, top: str, now: list[tuple]) -> Iterator[tuple[str, str, str]]:
        stack = [top]
        while stack:
            directory = stack.pop()
            owner = part_of(root, directory, self.parts)
            now.append((owner, root, directory, "", True, None, None))
            for name, is_dir, size, modified in stores.entries(stores.join(self.roots[root], directory)) or ():
                path = f"{directory}/{name}"
                now.append((owner, root, directory, name, is_dir, size, modified))
                yield root, path, "create"
                if is_dir:
                    stack.append(path)

    def commit(self, end: dict) -> None:
        """Versions before the one that is processed are not needed again."""
        store, at = stores.open_store(self.snapshots)
        for version in self._known():
            if version < end["version"]:
                store.delete_dir(f"{at}/{version}")


class WatchSource(DataSource):
    """``spark.readStream.format("sheaf_watch").option("paths", '["/a"]').option("snapshots", shared_folder)``."""

    @classmethod
    def name(cls):
        return "sheaf_watch"

    def schema(self):
        return SCHEMA

    def streamReader(self, schema):
        return WatchReader(self.options)


def take_snapshot(spark: SparkSession, paths: list[str], folder: str, parts: int = PARTS) -> None:
    """Version 0, from the distributed listing: each part of the directories is written by one task."""
    from sheaf.sources.tree_listing import list_tree
    listing = list_tree(spark, paths)
    parent = F.regexp_extract("rel_path", "^(.*)/[^/]*$", 1)
    own = listing.filter("is_dir").select("root_id", F.col("rel_path").alias("dir"), F.lit("").alias("name"), "is_dir",
                                          F.lit(None).cast("bigint").alias("size"), F.lit(None).cast("bigint").alias("modified_ns"))
    inside = listing.filter("rel_path <> ''").select("root_id", parent.alias("dir"), F.substring_index("rel_path", "/", -1).alias("name"),
                                                     "is_dir", F.coalesce("size", F.lit(0)).alias("size"), "modified_ns")
    key = F.crc32(F.concat("root_id", F.lit("\0"), "dir").cast("binary")) % parts
    rows = own.unionByName(inside).select(key.cast("int").alias("part"), "*")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        held = []
        for batch in batches:
            held += zip(*(batch.column(c).to_pylist() for c in _SNAPSHOT.names), strict=True)
        if held:
            _write(folder, TaskContext.get().partitionId(), held)
        yield pa.RecordBatch.from_arrays([pa.array([len(held)], pa.int64())], ["n"])

    rows.repartition(parts, "part").mapInArrow(write, "n bigint").agg(F.sum("n")).first()


def watch(spark: SparkSession, paths: list[str], snapshots: str, parts: int = PARTS) -> DataFrame:
    """A stream of the changes under ``paths`` in the columns of a change feed.

    ``snapshots`` is a folder that driver and executors share; if it has no snapshot, one is taken now and changes are
    reported from here on, else from its last one.  Directories have no ``modify``; a file that becomes a directory is a
    ``remove`` and a ``create``.
    """
    spark.dataSource.register(WatchSource)
    snapshots = stores.normal_path(snapshots)
    if not WatchReader({"paths": json.dumps(paths), "snapshots": snapshots})._known():
        take_snapshot(spark, paths, f"{snapshots}/0", parts)
    return (spark.readStream.format("sheaf_watch").option("paths", json.dumps(list(paths))).option("snapshots", snapshots)
            .option("parts", str(parts)).load())

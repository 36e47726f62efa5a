"""A1 over local storage as a table format: a Python DataSource listing directory trees.

``tree_listing.read_tree`` lists trees of any shape and store; this format serves ``spark.read.format``.

``binaryFile`` drops names starting with '.' or '_' and lists no directories,
so a listing source of our own is needed for raw trees.  Partitioning: one
input partition per top-level entry of each root (plus one for each root's
own row and top-level files), so a wide tree is listed in parallel; each
partition walks its subtree without following symlinks.  Unreadable entries
are skipped; a missing root yields no rows.

Rows: ``root_id, rel_path, is_dir, size`` and, with ``content=true``, the raw
``content`` bytes of files (validated later by ``read_contents``).
"""

from __future__ import annotations

import json
import os

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sheaf.sources.stores import join, read_bytes, root_ids
from sheaf.sources.tree_listing import read_tree  # noqa: F401  (lists trees of any shape and store)

SCHEMA = "root_id string, rel_path string, is_dir boolean, size bigint"
SCHEMA_WITH_CONTENT = SCHEMA + ", content binary"


def read_files(wanted, roots: dict[str, str]):
    """``wanted(root_id, rel_path)`` with the bytes of each file as ``content`` (null if it cannot be read)."""
    def run(batches):
        import pyarrow as pa
        for b in batches:
            out = []
            for root, rel in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                out.append(read_bytes(join(roots[root], rel)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], ["root_id", "rel_path", "content"])
    return wanted.select("root_id", "rel_path").mapInArrow(run, "root_id string, rel_path string, content binary")


class _Part(InputPartition):
    def __init__(self, root: str, root_id: str, top: str | None):
        super().__init__((root, root_id, top))
        self.root, self.root_id, self.top = root, root_id, top


class TreeReader(DataSourceReader):
    def __init__(self, options: dict, with_content: bool, max_depth: int | None):
        given = json.loads(options["paths"]) if options.get("paths") else [options["path"]] if options.get("path") else []
        self.roots = root_ids(given)
        self.with_content = with_content
        self.max_depth = max_depth

    def partitions(self):
        parts = []
        for root_id, root in self.roots.items():
            if not os.path.isdir(root):
                continue
            parts.append(_Part(root, root_id, None))
            if self.max_depth is not None and self.max_depth < 1:
                continue
            try:
                with os.scandir(root) as it:
                    for e in it:
                        if e.is_dir(follow_symlinks=False):
                            parts.append(_Part(root, root_id, e.name))
            except OSError:
                continue
        return parts

    def _row(self, root_id, rel, is_dir, path, size):
        if self.with_content:
            data = None
            if not is_dir:
                try:
                    with open(path, "rb") as fh:
                        data = fh.read()
                except OSError:
                    data = None
            return (root_id, rel, is_dir, size, data)
        return (root_id, rel, is_dir, size)

    def read(self, partition: _Part):
        if partition is None:  # no readable root: Spark still runs one empty partition
            return
        root, root_id, top = partition.root, partition.root_id, partition.top
        if top is None:  # the root row and top-level files
            yield self._row(root_id, "", True, root, None)
            if self.max_depth is not None and self.max_depth < 1:
                return
            try:
                with os.scandir(root) as it:
                    for e in it:
                        if not e.is_dir(follow_symlinks=False):
                            try:
                                size = e.stat(follow_symlinks=False).st_size
                            except OSError:
                                continue
                            yield self._row(root_id, e.name, False, e.path, size)
            except OSError:
                return
            return
        start = os.path.join(root, top)
        stack = [(start, top, 1)]
        while stack:
            path, rel, depth = stack.pop()
            if self.max_depth is not None and depth > self.max_depth:
                continue
            yield self._row(root_id, rel, True, path, None)
            try:
                with os.scandir(path) as it:
                    entries = list(it)
            except OSError:
                continue
            for e in entries:
                child = f"{rel}/{e.name}"
                try:
                    if e.is_dir(follow_symlinks=False):
                        stack.append((e.path, child, depth + 1))
                    elif self.max_depth is None or depth + 1 <= self.max_depth:
                        yield self._row(root_id, child, False, e.path, e.stat(follow_symlinks=False).st_size)
                except OSError:
                    continue


class TreeSource(DataSource):
    """``spark.read.format("sheaf_tree").option("paths", '["/a", "/b"]').load()``.

    Options: ``paths`` (a JSON list of roots) or ``path`` (one root), ``content`` (true/false),
    ``maxDepth`` (keep entries with depth <= N).
    """

    @classmethod
    def name(cls):
        return "sheaf_tree"

    def _with_content(self):
        return str(self.options.get("content", "false")).lower() == "true"

    def schema(self):
        return SCHEMA_WITH_CONTENT if self._with_content() else SCHEMA

    def reader(self, schema):
        md = self.options.get("maxDepth")
        return TreeReader(self.options, self._with_content(), int(md) if md is not None else None)


def register(spark) -> None:
    spark.dataSource.register(TreeSource)

"""A7 sink: write each root's document bytes exactly (no line separators added).

Spark's text writer appends a line separator to every row and rejects an empty
one, which would change the bytes of a document.  This Python DataSource
writer streams each task's (already range-partitioned and sorted) fragments
into ``<path>/root_id=<id>/part-<partition>.txt`` verbatim, in any store that Arrow's
file systems reach.  Tasks write to attempt-specific hidden names; the driver's ``commit`` renames only the files of
successful attempts, so retried or speculative tasks leave no duplicates.
Reading a root's part files in name order reproduces its document.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


def file_system(path: str):
    """``(file system, path in it)`` of a plain path or a URI (``file:``, ``hdfs:``, ``s3:``, ``gs:``, ...)."""
    from pyarrow import fs
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path.replace("file:///", "file:/").replace("file:/", "file:///", 1) if path.startswith("file:") else path)
    return fs.LocalFileSystem(), path


def exists(path: str) -> bool:
    from pyarrow import fs
    store, p = file_system(path)
    return store.get_file_info(p).type != fs.FileType.NotFound


@dataclass
class _Written(WriterCommitMessage):
    files: list


class ExportWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, rows):
        from pyspark import TaskContext
        ctx = TaskContext.get()
        pid, attempt = ctx.partitionId(), ctx.attemptNumber()
        store, base = file_system(self.path)
        now, out, written = None, None, []
        try:
            for r in rows:  # sorted by root: one open file at a time
                root = r["root_id"]
                if out is None or root != now:
                    if out is not None:
                        out.close()
                    folder = f"{base}/root_id={root}"
                    store.create_dir(folder, recursive=True)
                    final = f"{folder}/part-{pid:05d}.txt"
                    temp = f"{folder}/.part-{pid:05d}.attempt{attempt}"
                    now, out = root, store.open_output_stream(temp)
                    written.append((temp, final))
                out.write(r["fragment"].encode())
        finally:
            if out is not None:
                out.close()
        return _Written(written)

    def commit(self, messages):
        store, _ = file_system(self.path)
        for m in messages:
            for temp, final in m.files if m is not None else []:
                store.move(temp, final)

    def abort(self, messages):
        store, _ = file_system(self.path)
        for m in messages:
            for temp, _final in m.files if m is not None else []:
                store.delete_file(temp)


class ExportSink(DataSource):
    @classmethod
    def name(cls):
        return "sheaf_export"

    def schema(self):
        return "root_id string, fragment string"

    def writer(self, schema, overwrite):
        return ExportWriter(self.options["path"])


def register(spark) -> None:
    spark.dataSource.register(ExportSink)

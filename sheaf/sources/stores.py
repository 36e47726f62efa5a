"""Names and directories of any store: local paths, ``file:`` URIs, and what Arrow's file systems open by URI."""

from __future__ import annotations

import os
from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

from pyarrow import fs as arrow_fs


def normal_path(path: str) -> str:
    """A ``file:`` URI as its local path, a relative path as an absolute one; other URIs without a slash at the end."""
    if path.startswith("file:"):
        return os.path.normpath(unquote(urlsplit(path).path)) or "/"
    if "://" in path:
        return path.rstrip("/")
    return os.path.abspath(path)


def is_uri(path: str) -> bool:
    return "://" in path


def root_ids(paths: list[str]) -> dict[str, str]:
    """Root id -> normal path: the last name, or the whole path where another root has the same name."""
    roots = list(dict.fromkeys(normal_path(p) for p in paths if p))
    names = [os.path.basename(r) or r for r in roots]
    return {n if names.count(n) == 1 else r: r for n, r in zip(names, roots)}


def open_store(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return arrow_fs.FileSystem.from_uri(path) if is_uri(path) else (arrow_fs.LocalFileSystem(), path)


def join(parent: str, name: str) -> str:
    return f"{parent.rstrip('/')}/{name}" if name else parent


def entries(path: str) -> Iterator[tuple[str, bool, int, int]] | None:
    """``name, is_dir, size, modified (ns)`` of each entry of a directory; None if it cannot be read.

    Symbolic links of local directories count as files and are not followed; entries that vanish meanwhile are left out.
    """
    if is_uri(path):
        store, at = open_store(path)
        return store_entries(store, at)
    try:
        return _local(os.scandir(path))
    except OSError:
        return None


def _local(found) -> Iterator[tuple[str, bool, int, int]]:
    with found:
        for e in found:
            try:
                stat = e.stat(follow_symlinks=False)
                yield e.name, e.is_dir(follow_symlinks=False), stat.st_size, stat.st_mtime_ns
            except OSError:
                continue


def store_entries(store: arrow_fs.FileSystem, at: str) -> Iterator[tuple[str, bool, int, int]] | None:
    """:func:`entries` of a directory of an Arrow file system."""
    try:
        found = store.get_file_info(arrow_fs.FileSelector(at))
    except OSError:
        return None
    return iter([(i.base_name, i.type == arrow_fs.FileType.Directory, i.size or 0, i.mtime_ns or 0) for i in found
                 if i.type in (arrow_fs.FileType.Directory, arrow_fs.FileType.File)])


def read_bytes(path: str) -> bytes | None:
    """A file's bytes; None if it cannot be read."""
    try:
        store, at = open_store(path)
        with store.open_input_stream(at) as stream:
            return stream.read()
    except OSError:
        return None

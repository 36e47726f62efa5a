"""Path expressions over ``(root_id, rel_path)`` keys.

All functions return Columns, so they stay inside whole-stage codegen.
Paths use '/' separators; the root itself is ``rel_path = ''``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def components(rel) -> Column:
    """``'a/b/c'`` -> ``['a','b','c']``; the root ``''`` -> ``[]``."""
    rel = _c(rel)
    return F.when(rel == "", F.array().cast("array<string>")).otherwise(F.split(rel, "/"))


def depth(rel) -> Column:
    """0 for the root, else the number of components."""
    rel = _c(rel)
    return F.when(rel == "", F.lit(0)).otherwise(F.length(rel) - F.length(F.replace(rel, F.lit("/"), F.lit(""))) + 1)


def file_name(rel, root_name=None) -> Column:
    """Last component; the root's name is its root id."""
    rel = _c(rel)
    last = F.substring_index(rel, "/", -1)
    if root_name is None:
        return last
    return F.when(rel == "", _c(root_name)).otherwise(last)


def parent_path(rel) -> Column:
    """Parent rel path; NULL for the root, ``''`` for top-level entries."""
    rel = _c(rel)
    last = F.length(F.substring_index(rel, "/", -1))
    return F.when(rel == "", F.lit(None).cast("string")).otherwise(
        F.substring(rel, F.lit(1), F.greatest(F.length(rel) - last - 1, F.lit(0))))


def extension(name) -> Column:
    """Text after the last '.' of a name; '' when none; '.gitignore' -> '' (B17)."""
    return F.regexp_extract(_c(name), r"^.+\.([^.]*)$", 1)


def ancestors(rel) -> Column:
    """Proper ancestors, root first: ``'a/b/c'`` -> ``['', 'a', 'a/b']``; root -> ``[]``."""
    rel = _c(rel)
    return F.when(rel == "", F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(0), depth(rel) - 1), lambda i: F.call_function("substring_index", rel, F.lit("/"), i)))


def ancestors_or_self(rel) -> Column:
    rel = _c(rel)
    return F.concat(ancestors(rel), F.array(rel))


def relative_path(path, root) -> Column:
    """Strip the root prefix by component; fall back to the full path (B1)."""
    path, root = _c(path), _c(root)
    r = F.regexp_replace(root, "/+$", "")
    rest = path.substr(F.length(r) + 2, F.greatest(F.length(path), F.lit(1)))
    return (F.when(path == r, F.lit(""))
            .when(path.startswith(F.concat(r, F.lit("/"))), rest)
            .otherwise(path))


def normalize(path) -> Column:
    """Lexically fold '.' and '..' components of an absolute path (no disk access)."""
    parts = F.split(_c(path), "/")
    folded = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda acc, x: F.when((x == "") | (x == "."), acc)
        .when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(x))))
    return F.concat(F.lit("/"), F.array_join(folded, "/"))


def contained_in(path, root) -> Column:
    """Component-wise containment after normalising both sides (B2).

    ``/a/b`` contains ``/a/b/c`` but not ``/a/bc`` nor ``/a/b/../c``.
    """
    p, r = normalize(path), normalize(root)
    return (p == r) | p.startswith(F.concat(F.regexp_replace(r, "/$", ""), F.lit("/")))

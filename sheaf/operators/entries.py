"""Entries: derive the hierarchical listing of a corpus.

A corpus is ``files(root_id, rel_path[, content | size])``.  Directories are
not stored; they are the distinct proper ancestors of file paths plus one root
row per root.  That is a partial-aggregated ``distinct`` over Σdepth path-only
rows -- content never travels through it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.functions import paths as P

ENTRY_COLUMNS = ["root_id", "rel_path", "parent", "name", "ext", "depth", "is_dir", "size"]


def _shape(df: DataFrame, keep_content: bool = False) -> DataFrame:
    name = P.file_name("rel_path", "root_id")
    return df.select(
        "root_id", "rel_path", P.parent_path("rel_path").alias("parent"), name.alias("name"),
        P.extension(name).alias("ext"), P.depth("rel_path").cast("bigint").alias("depth"), "is_dir",
        F.col("size").cast("bigint").alias("size"), *(["content"] if keep_content else []))


def derive_entries(files: DataFrame, max_depth: int | None = None, keep_content: bool = False) -> DataFrame:
    """``entries(root_id, rel_path, parent, name, ext, depth, is_dir, size)``.

    Files keep their byte size (``octet_length(content)`` unless a ``size``
    column is given); directories have ``size`` NULL; the root row has
    ``rel_path = ''`` and depth 0.  ``max_depth`` keeps entries with
    ``depth <= max_depth`` (B5).
    """
    size = F.col("size") if "size" in files.columns else F.octet_length("content")
    extra = [F.col("content")] if keep_content else []
    f = files.select("root_id", "rel_path", F.lit(False).alias("is_dir"), size.cast("bigint").alias("size"), *extra)
    parents = files.select("root_id", P.parent_path("rel_path").alias("parent")).distinct()
    dirs = (parents.select("root_id", F.explode(P.ancestors_or_self("parent")).alias("rel_path")).distinct()
            .select("root_id", "rel_path", F.lit(True).alias("is_dir"), F.lit(None).cast("bigint").alias("size"),
                    *[F.lit(None).cast("string").alias("content")] if keep_content else []))
    out = _shape(f.unionByName(dirs), keep_content)
    if max_depth is not None:
        out = out.filter(F.col("depth") <= max_depth)
    return out


def files_only(entries: DataFrame) -> DataFrame:
    """Keep non-directories."""
    return entries.filter(~F.col("is_dir"))


NOT_FOUND_ERROR = "Failed to read file: not found"
TRAVERSAL_ERROR = "Security error: path traversal detected"
UTF8_ERROR = "Failed to read file: stream did not contain valid UTF-8"


def corpus_contents(files: DataFrame) -> DataFrame:
    """A3 when the listing IS the content table: every row reads itself, so
    reading is a projection (no join, no shuffle of content)."""
    return files.select("root_id", "rel_path", "content",
                        F.when(F.col("content").isNull(), F.lit(NOT_FOUND_ERROR)).alias("error"))


def read_contents(wanted: DataFrame, contents: DataFrame, root_path=None) -> DataFrame:
    """``wanted(root_id, rel_path, ...)`` ⟕ ``contents`` -> content/error.

    Exactly one of ``content``/``error`` is non-null per row; no row is dropped.
    ``contents.content`` may be STRING or BINARY; binary is validated as UTF-8.
    With ``root_path`` (a Column of absolute roots joined in by the caller as
    ``root_path``), rows escaping the root get the traversal error before any
    decoding (A4).
    """
    c = contents.select("root_id", "rel_path", "content")
    return decoded(wanted.drop("content").join(c, ["root_id", "rel_path"], "left"), root_path)


def decoded(rows: DataFrame, root_path=None) -> DataFrame:
    """``rows`` with ``content`` as valid text and ``error`` (see :func:`read_contents`): a projection."""
    raw = F.col("_raw")
    is_bin = dict(rows.dtypes)["content"] == "binary"
    valid = F.is_valid_utf8(raw.cast("string")) if is_bin else F.lit(True)
    text = raw.cast("string") if is_bin else raw
    err = F.when(raw.isNull(), F.lit(NOT_FOUND_ERROR)).when(~valid, F.lit(UTF8_ERROR))
    if root_path is not None:
        inside = P.contained_in(F.concat(root_path, F.lit("/"), F.col("rel_path")), root_path)
        err = F.when(~inside, F.lit(TRAVERSAL_ERROR)).otherwise(err)
    out = rows.withColumnRenamed("content", "_raw").withColumn("error", err)
    return out.withColumn("content", F.when(F.col("error").isNull(), text)).drop("_raw")

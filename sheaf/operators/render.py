"""Rendering: orders, positions, tree lines and XML/Markdown fragments.

A document is *rows* ``(root_id, section, seq, fragment)``; concatenating the
fragments in ``(section, seq)`` order gives the exact bytes of the reference's
output.  Nothing here builds one string per root: token counts come from
``sum(length(fragment))``, and export writes the rows sorted (``export``).
Content joins in last, after every window/ordering step has run on paths only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.functions import paths as P
from sheaf.functions.classify import language_of, tokens_from_char_count
from sheaf.operators.prune import prune
from sheaf.plans.ordered import ordered_scan
from sheaf.session import pinned_table

# ---------------------------------------------------------------------------
# Fixed values of the output formats (bytes must equal the reference's).
XML_HEADER = '<?xml version="1.0" encoding="UTF-8"?>\n<codebase>\n'
XML_TREE_OPEN = "  <directory_tree>\n<![CDATA[\n"
XML_TREE_CLOSE = "]]>\n  </directory_tree>\n\n"
XML_FILES_OPEN = "  <files>\n"
XML_FILE_OPEN = '    <file path="{path}">\n<![CDATA[\n'
XML_FILE_CLOSE = "]]>\n    </file>\n"
XML_FOOTER = "  </files>\n</codebase>"
MD_HEADER = "# Codebase Export\n\n"
MD_TREE_OPEN = "## Directory Structure\n\n```\n"
MD_TREE_CLOSE = "```\n\n"
MD_FILES_OPEN = "## Files\n\n"
TREE_LAST, TREE_MID = "└── ", "├── "
TREE_PAD_LAST, TREE_PAD_MID = "    ", "│   "
ICON_DIR, ICON_FILE = "📁", "📄"
TREE_MAX_DEPTH = 10
# Template of the benchmark workflow: "## {path}\n```\n{content}\n```\n".
BENCH_FRAGMENT = ("## ", "\n```\n", "\n```\n")
# ---------------------------------------------------------------------------

SEC_HEADER, SEC_TREE_OPEN, SEC_TREE, SEC_TREE_CLOSE, SEC_FILES_OPEN, SEC_FILES, SEC_FOOTER = range(7)


def sort_key(rel: Column | str = "rel_path", is_dir: Column | str = "is_dir", ci: bool = True) -> Column:
    """Per-component sort key; array order = preorder of the dirs-first tree.

    ci=True  (F1): (is_file, lower(name), name) -- tree/selection order.
    ci=False (F2): (is_file, name)              -- printed-tree byte order.
    Shorter arrays sort first, so a directory precedes its subtree.
    """
    rel = F.col(rel) if isinstance(rel, str) else rel
    isd = F.col(is_dir) if isinstance(is_dir, str) else is_dir
    parts = F.split(rel, "/")
    n = F.size(parts)

    def comp(x, i):
        f = F.when((i == n - 1) & ~isd, F.lit(1)).otherwise(F.lit(0))
        if ci:
            return F.struct(f.alias("f"), F.lower(x).alias("l"), x.alias("n"))
        return F.struct(f.alias("f"), x.alias("n"))

    empty = F.array().cast("array<struct<f:int,l:string,n:string>>" if ci else "array<struct<f:int,n:string>>")
    return F.when(rel == "", empty).otherwise(F.transform(parts, comp))


def sibling_key(ci: bool = True) -> Column:
    f = F.when(F.col("is_dir"), F.lit(0)).otherwise(F.lit(1))
    if ci:
        return F.struct(f.alias("f"), F.lower("name").alias("l"), F.col("name").alias("n"))
    return F.struct(f.alias("f"), F.col("name").alias("n"))


def is_last_sibling(entries: DataFrame, ci: bool = False) -> DataFrame:
    """``is_last`` among surviving siblings; the root counts as last.

    max(sibling key) per parent is a partial aggregation (skew-safe); joining it
    back is an equi-join against one row per parent (AQE splits hot parents).
    """
    e = entries.withColumn("_k", sibling_key(ci))
    mx = (e.filter(F.col("parent").isNotNull()).groupBy("root_id", "parent")
          .agg(F.max("_k").alias("_mk")))
    j = e.join(mx, ["root_id", "parent"], "left")
    return j.withColumn("is_last", F.col("parent").isNull() | (F.col("_k") == F.col("_mk"))).drop("_k", "_mk")


def sibling_rank(entries: DataFrame, ci: bool = True) -> DataFrame:
    """1-based position among siblings (dirs first, then name)."""
    e = entries.filter(F.col("parent").isNotNull()).select("root_id", "parent", "rel_path", "is_dir", "name")
    f = F.when(F.col("is_dir"), F.lit(0)).otherwise(F.lit(1))
    order = [f, F.lower("name"), F.col("name")] if ci else [f, F.col("name")]
    return ordered_scan(e, ["root_id", "parent"], order, pos="sibling_rank")


def preorder(entries: DataFrame, ci: bool = True, pos: str = "pos", skip_root: bool = True) -> DataFrame:
    """Dense DFS preorder position per root (skew-safe ordered scan)."""
    e = entries.filter(F.col("rel_path") != "") if skip_root else entries
    e = e.withColumn("_sk", sort_key("rel_path", "is_dir", ci))
    return ordered_scan(pinned_table(e, "order"), ["root_id"], ["_sk"], pos=pos).drop("_sk")


def tree_lines(entries: DataFrame, patterns: list[str] | None = None, profiles: DataFrame | None = None,
               ci: bool = False, max_depth: int | None = TREE_MAX_DEPTH) -> DataFrame:
    """``(root_id, pos, line)``; lines concatenated by ``pos`` are the tree text.

    Patterns prune by name at every level including the root's own name (an
    ignored root yields no lines).  ``ci=False`` is the printed byte order (F2);
    ``ci=True`` with ``max_depth=None`` is the loaded-tree variant (D11).

    A line's prefix needs "is last sibling" for every ancestor.  Ancestors are
    directories, so their sibling key follows from the path alone: one explode
    of the path levels of *directories*, joined to each parent's maximum child
    key (a partial aggregation), gives the prefix of everything inside each.
    Files and directories then take it from their parent in one join -- no
    recursion and no join back per level.  The root itself is always last.
    """
    vis = prune(entries.select("root_id", "rel_path", "parent", "name", "is_dir", "depth"),
                profiles=profiles, patterns=patterns, include_root=True)
    if max_depth is not None:
        vis = vis.filter(F.col("depth") <= max_depth)
    vis = vis.withColumn("_k", sibling_key(ci))
    maxchild = (vis.filter(F.col("parent").isNotNull()).groupBy("root_id", "parent").agg(F.max("_k").alias("_mk")))
    parts = F.split("rel_path", "/")
    lv = vis.filter(F.col("is_dir") & (F.col("depth") >= 1)).select("root_id", "rel_path", F.posexplode(parts).alias("_i", "_c"))
    above = F.when(F.col("_i") == 0, F.lit("")).otherwise(F.array_join(F.slice(parts, 1, F.col("_i")), "/"))
    key = (F.struct(F.lit(0).alias("f"), F.lower("_c").alias("l"), F.col("_c").alias("n")) if ci
           else F.struct(F.lit(0).alias("f"), F.col("_c").alias("n")))
    flags = (lv.withColumn("parent", above).join(maxchild, ["root_id", "parent"])
             .groupBy("root_id", "rel_path").agg(F.array_sort(F.collect_list(F.struct("_i", (key == F.col("_mk")).alias("_last")))).alias("_fl")))
    pads = F.transform("_fl", lambda s: F.when(s["_last"], F.lit(TREE_PAD_LAST)).otherwise(F.lit(TREE_PAD_MID)))
    inside = flags.select("root_id", F.col("rel_path").alias("parent"), F.concat(F.lit(TREE_PAD_LAST), F.array_join(pads, "")).alias("_pre"))
    inside = inside.unionByName(vis.filter(F.col("depth") == 0).select("root_id", F.lit("").alias("parent"), F.lit(TREE_PAD_LAST).alias("_pre")))
    inside = maxchild.join(inside, ["root_id", "parent"])
    last = F.when(F.col("_mk").isNull() | (F.col("_k") == F.col("_mk")), F.lit(TREE_LAST)).otherwise(F.lit(TREE_MID))
    icon = F.when(F.col("is_dir"), F.lit(ICON_DIR)).otherwise(F.lit(ICON_FILE))
    line = F.concat(F.coalesce("_pre", F.lit("")), last, icon, F.lit(" "), F.col("name"), F.lit("\n"))
    lines = vis.join(inside, ["root_id", "parent"], "left").select("root_id", "rel_path", "is_dir", line.alias("line"))
    lines = lines.select("root_id", "line", sort_key("rel_path", "is_dir", ci).alias("_sk"))
    # the scan reads its input more than once; the lines are worth a table
    return ordered_scan(pinned_table(lines, "lines"), ["root_id"], ["_sk"], pos="pos").select("root_id", "pos", "line")


def _ensure_newline(content: Column) -> Column:
    return F.when(content.endswith("\n"), content).otherwise(F.concat(content, F.lit("\n")))


def _xml_escape(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(s, "&", "&amp;"), '"', "&quot;"), "<", "&lt;")


def _fence_for(content: Column, safe: bool) -> Column:
    if not safe:
        return F.lit("```")
    longest = F.aggregate(F.transform(F.regexp_extract_all(content, F.lit("(`+)"), 1), lambda x: F.length(x)),
                          F.lit(0), lambda a, x: F.greatest(a, x))
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), longest + 1))


class DocumentFormat:
    """How a document's parts are written.  Every part is a Column (a literal, or made of the columns given), so any
    format runs inside the same plan; a part that is None is left out."""

    name = ""

    def header(self) -> Column | None:
        return None

    def tree_open(self) -> Column | None:
        return None

    def tree_close(self) -> Column | None:
        return None

    def tree_line(self, line: Column) -> Column | None:
        return line

    def files_open(self) -> Column | None:
        return None

    def footer(self) -> Column | None:
        return None

    def fragment(self, path: Column, content: Column, ext: Column, safe: bool) -> Column:
        """One file; ``content`` is its text as read."""
        raise NotImplementedError


class XmlFormat(DocumentFormat):
    """D7."""

    name = "xml"

    def header(self):
        return F.lit(XML_HEADER)

    def tree_open(self):
        return F.lit(XML_TREE_OPEN)

    def tree_close(self):
        return F.lit(XML_TREE_CLOSE)

    def files_open(self):
        return F.lit(XML_FILES_OPEN)

    def footer(self):
        return F.lit(XML_FOOTER)

    def fragment(self, path, content, ext, safe):
        body = _ensure_newline(content)
        p = _xml_escape(path) if safe else path
        b = F.regexp_replace(body, "]]>", "]]]]><![CDATA[>") if safe else body
        return F.concat(F.lit('    <file path="'), p, F.lit('">\n<![CDATA[\n'), b, F.lit(XML_FILE_CLOSE))


class MarkdownFormat(DocumentFormat):
    """D8."""

    name = "markdown"

    def header(self):
        return F.lit(MD_HEADER)

    def tree_open(self):
        return F.lit(MD_TREE_OPEN)

    def tree_close(self):
        return F.lit(MD_TREE_CLOSE)

    def files_open(self):
        return F.lit(MD_FILES_OPEN)

    def fragment(self, path, content, ext, safe):
        fence = _fence_for(content, safe)
        return F.concat(F.lit("### "), path, F.lit("\n\n"), fence, language_of(ext), F.lit("\n"), _ensure_newline(content),
                        fence, F.lit("\n\n"))


_FORMATS: dict[str, DocumentFormat] = {}


def register_format(fmt: DocumentFormat) -> None:
    """Make a format known by its name, in place of one that had it."""
    if not fmt.name:
        raise ValueError("a format needs a name")
    _FORMATS[fmt.name] = fmt


def format_names() -> list[str]:
    return sorted(_FORMATS)


def document_format(fmt: str | DocumentFormat) -> DocumentFormat:
    if isinstance(fmt, DocumentFormat):
        return fmt
    if fmt not in _FORMATS:
        raise ValueError(f"unknown format {fmt!r}")
    return _FORMATS[fmt]


register_format(XmlFormat())
register_format(MarkdownFormat())


def file_fragment(fmt: str | DocumentFormat, path: Column, content: Column, ext: Column, safe: bool = False) -> Column:
    """One file's fragment (D7/D8), bytes as the reference writes them."""
    return document_format(fmt).fragment(path, content, ext, safe)


def bench_fragment(path: Column, content: Column) -> Column:
    """The benchmark workflow's simplified fragment (A10)."""
    a, b, c = BENCH_FRAGMENT
    return F.concat(F.lit(a), path, F.lit(b), content, F.lit(c))


def fragments(selected: DataFrame, contents: DataFrame, fmt: str | DocumentFormat = "markdown",
              tree: DataFrame | None = None, safe: bool = False, transform=None) -> DataFrame:
    """Document rows ``(root_id, section, seq, fragment)`` for the selected files.

    ``selected(root_id, rel_path, ext, is_dir, ...)`` is ordered by the F1
    preorder (F4); ``contents(root_id, rel_path, content, error)``; failed
    reads are left out (they go to :func:`failed_summary`).  ``tree`` is the
    output of :func:`tree_lines`; roots with no tree lines get no tree block.
    ``transform`` maps the content Column (a Column expression, not a UDF).  ``fmt`` is a registered name or a
    :class:`DocumentFormat`.

    The fixed header/footer rows ride on each root's first selected row and the
    tree open/close rows on its first tree line (``inline`` of a small array),
    instead of re-deriving root lists; the ordered selection is stored, so
    reading it twice costs no recomputation.
    """
    form = document_format(fmt)
    sel = pinned_table(preorder(selected.select("root_id", "rel_path", "ext", "is_dir"), ci=True, pos="seq"), "selection")
    ok = contents.filter(F.col("error").isNull()).select("root_id", "rel_path", "content")
    # inner join: Catalyst broadcasts the path-only selection while its stored size is under its threshold, and the
    # contents then stay where they are
    files = sel.join(ok, ["root_id", "rel_path"])
    body = F.col("content") if transform is None else transform(F.col("content"))

    def row(section, seq, text):
        return F.struct(F.lit(section).alias("section"), seq.cast("bigint").alias("seq"), text.alias("fragment"))

    zero = F.lit(0)
    fixed = [row(section, zero, text) for section, text in
             ((SEC_HEADER, form.header()), (SEC_FILES_OPEN, form.files_open()), (SEC_FOOTER, form.footer())) if text is not None]
    out = files.select("root_id", F.inline(F.array(row(SEC_FILES, F.col("seq"),
                                                       form.fragment(F.col("rel_path"), body, F.col("ext"), safe)))))
    if fixed:
        out = sel.filter(F.col("seq") == 1).select("root_id", F.inline(F.array(*fixed))).unionByName(out)
    line = form.tree_line(F.col("line"))
    if tree is not None and line is not None:
        t = tree.join(sel.filter(F.col("seq") == 1).select("root_id"), "root_id", "left_semi")
        ends = [F.when(F.col("pos") == 1, row(section, zero, text)) for section, text in
                ((SEC_TREE_OPEN, form.tree_open()), (SEC_TREE_CLOSE, form.tree_close())) if text is not None]
        trows = F.array(row(SEC_TREE, F.col("pos"), line), *ends)
        out = out.unionByName(t.select("root_id", F.inline(F.filter(trows, lambda r: r.isNotNull()))))
    return out


def document_stats(frags: DataFrame) -> DataFrame:
    """Per root fragment count, chars, bytes and ceil(chars/4) tokens -- no concatenation."""
    return frags.groupBy("root_id").agg(
        F.count(F.lit(1)).alias("n_fragments"),
        F.sum(F.length("fragment")).cast("bigint").alias("n_chars"),
        F.sum(F.octet_length("fragment")).cast("bigint").alias("n_bytes"),
    ).withColumn("output_tokens", tokens_from_char_count("n_chars"))


def failed_summary(selected: DataFrame, contents: DataFrame) -> DataFrame:
    """Per root ``n_failed`` and the failure items in document order.

    Rows: ``(root_id, seq, item)`` with ``seq = 0`` carrying
    ``'Warning: Failed to read N file(s): '`` and one row per failure
    (``'path: error'``); joined with ', ' in seq order they form the message.
    """
    sel = preorder(selected.select("root_id", "rel_path", "is_dir"), ci=True, pos="seq")
    bad = sel.join(contents.filter(F.col("error").isNotNull()).select("root_id", "rel_path", "error"),
                   ["root_id", "rel_path"])
    items = bad.select("root_id", "seq", F.concat("rel_path", F.lit(": "), "error").alias("item"))
    head = bad.groupBy("root_id").agg(F.count(F.lit(1)).alias("n")).select(
        "root_id", F.lit(0).cast("bigint").alias("seq"),
        F.concat(F.lit("Warning: Failed to read "), F.col("n").cast("string"), F.lit(" file(s): ")).alias("item"))
    return head.unionByName(items)


def export(frags: DataFrame, path: str) -> None:
    """Write each root's document to ``path/root_id=<id>/part-*.txt`` with exact bytes.

    Rows are range-partitioned and sorted by ``(root_id, section, seq)``, so the
    part files of a root, read in name order, concatenate to its document; no
    root is ever gathered into one task.  Refuses to overwrite an existing path.
    """
    from sheaf.sources.export_sink import exists, register
    if exists(path):
        raise FileExistsError(path)
    register(frags.sparkSession)
    n = int(frags.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (frags.repartitionByRange(n, "root_id", "section", "seq")
     .sortWithinPartitions("root_id", "section", "seq")
     .select("root_id", "fragment")
     .write.format("sheaf_export").mode("append").save(path))

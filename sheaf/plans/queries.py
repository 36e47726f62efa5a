"""Registered queries: one per operator of the inventory, over the test tables.

Each query is ``f(spark, sf_dir) -> DataFrame`` and reads whole tables (or
views Spark derives from them).  Keys match ``oracle.SQL``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.functions import classify as C
from sheaf.functions import paths as P
from sheaf.operators import entries as EN
from sheaf.operators import render as R
from sheaf.operators import select as S
from sheaf.operators.prune import prune
from sheaf.sources import fixtures as FX

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


# ---------------------------------------------------------------- shared views
def corpus_entries(spark, sf):
    return EN.derive_entries(FX.files(spark, sf))


def pruned_entries(spark, sf):
    return prune(corpus_entries(spark, sf), profiles=FX.profiles(spark))


def nodes(entries):
    """What selection needs of an entry: the other columns would be derived and stored for nothing."""
    return entries.select("root_id", "rel_path", "parent", "is_dir")


def states(spark, sf):
    return S.selection_states(nodes(pruned_entries(spark, sf)), FX.picks(spark, sf))


def selected(spark, sf):
    """Files going into the document.

    Files are leaves, so their rolled-up state is their own expanded flag, and
    a checked file never lies under an unchecked directory once states are
    rolled up (H2 = H3 on rolled-up states) -- the generation set needs no
    roll-up at all.  ``collect_selected`` (H2) stays the general operator.
    """
    e = S.expand(pruned_entries(spark, sf), FX.picks(spark, sf))
    return e.filter(~F.col("is_dir") & F.col("checked"))


def contents(spark, sf):
    return EN.corpus_contents(FX.files(spark, sf))


def full_root():
    return F.concat(F.lit("/corpus/"), F.col("root_id"))


def full_path():
    return F.concat(full_root(), F.lit("/"), F.col("rel_path"))


# ---------------------------------------------------------------- 2A scans
@query("scan_entries")
def q_scan_entries(spark, sf):
    """A1: files and derived directories of every root."""
    return corpus_entries(spark, sf)


@query("list_children")
def q_list_children(spark, sf):
    """A2: one-level listing of every directory, ignore patterns applied, dirs first."""
    e = pruned_entries(spark, sf).filter(F.col("parent").isNotNull())
    return R.sibling_rank(e, ci=True).select("root_id", "parent", "rel_path", "sibling_rank")


@query("read_contents")
def q_read_contents(spark, sf):
    """A3: selected files read as UTF-8 (binary validated), content or error per row."""
    f = FX.files(spark, sf)
    raw = f.select("root_id", "rel_path", F.col("content").cast("binary").alias("content"))
    r = EN.read_contents(selected(spark, sf).select("root_id", "rel_path"), raw)
    return r.select("root_id", "rel_path", F.octet_length("content").cast("bigint").alias("n_bytes"), "error")


@query("read_contents_secure")
def q_read_contents_secure(spark, sf):
    """A4: as A3 with the root-containment check before decoding."""
    f = FX.files(spark, sf)
    wanted = f.select("root_id", F.concat(F.when(F.col("rel_path").contains("/en/"), F.lit("../x/"))
                                          .otherwise(F.lit("")), "rel_path").alias("rel_path"))
    r = EN.read_contents(wanted.withColumn("root_path", full_root()), f.select("root_id", "rel_path", "content"),
                         root_path=F.col("root_path"))
    return r.select("root_id", "rel_path", F.length("content").cast("bigint").alias("n_chars"), "error")


@query("entry_metadata")
def q_entry_metadata(spark, sf):
    """Size for files, NULL for directories."""
    return corpus_entries(spark, sf).select("root_id", "rel_path", "is_dir", "size")


@query("full_workflow")
def q_full_workflow(spark, sf):
    """A10: scan -> files only -> read -> '## path' fenced fragment -> total length per root."""
    # the corpus table stores listing and bytes together: reading the listed
    # files is a projection of the scan, not a join back to the content
    e = EN.files_only(EN.derive_entries(FX.files(spark, sf), keep_content=True))
    frag = R.bench_fragment(full_path(), F.col("content"))
    return (e.filter(F.col("content").isNotNull()).select("root_id", frag.alias("fragment"))
            .groupBy("root_id").agg(F.count(F.lit(1)).alias("n_files"),
                                    F.sum(F.octet_length("fragment")).cast("bigint").alias("out_bytes"),
                                    C.tokens_from_char_count(F.sum(F.length("fragment"))).alias("out_tokens")))


# ---------------------------------------------------------------- 2B predicates
@query("relative_path")
def q_relative_path(spark, sf):
    """B1: strip the own root (by component) and a sibling-prefix root (falls back)."""
    f = FX.files(spark, sf)
    return f.select("root_id", "rel_path",
                    P.relative_path(full_path(), full_root()).alias("rel_own"),
                    P.relative_path(full_path(), F.expr("substr(concat('/corpus/', root_id), 1, 11)")).alias("rel_other"))


@query("contained_in_root")
def q_contained_in_root(spark, sf):
    """B2: containment of the path, a '..' escape, and a sibling-prefix root."""
    f = FX.files(spark, sf)
    escape = F.concat(full_root(), F.lit("/../"), F.col("rel_path"))
    sib = F.concat(F.lit("/corpus/"), F.col("root_id"), F.lit("x/"), F.col("rel_path"))
    return f.select("root_id", "rel_path", P.contained_in(full_path(), full_root()).alias("inside"),
                    P.contained_in(escape, full_root()).alias("escape_inside"),
                    P.contained_in(sib, full_root()).alias("sibling_inside"))


@query("parent_path")
def q_parent_path(spark, sf):
    """B3."""
    return corpus_entries(spark, sf).select("root_id", "rel_path", "parent")


@query("file_name")
def q_file_name(spark, sf):
    """B4."""
    return corpus_entries(spark, sf).select("root_id", "rel_path", "name")


@query("depth_limit")
def q_depth_limit(spark, sf):
    """Entries up to depth 2."""
    return EN.derive_entries(FX.files(spark, sf), max_depth=2).select("root_id", "rel_path", "depth")


@query("files_only")
def q_files_only(spark, sf):
    """B15."""
    return EN.files_only(corpus_entries(spark, sf)).select("root_id", "rel_path", "size")


@query("extension")
def q_extension(spark, sf):
    """B17."""
    return corpus_entries(spark, sf).select("root_id", "rel_path", "ext")


@query("language_of")
def q_language_of(spark, sf):
    """Case-sensitive ext -> fence language."""
    return EN.files_only(corpus_entries(spark, sf)).select("root_id", "rel_path", C.language_of("ext").alias("lang"))


@query("file_category")
def q_file_category(spark, sf):
    """Case-insensitive ext -> category."""
    return EN.files_only(corpus_entries(spark, sf)).select("root_id", "rel_path",
                                                           C.file_category("ext").alias("category"))


@query("size_class")
def q_size_class(spark, sf):
    """B20."""
    return EN.files_only(corpus_entries(spark, sf)).select("root_id", "rel_path", "size",
                                                           C.size_class("size").alias("size_class"))


@query("tokens_chars")
def q_tokens_chars(spark, sf):
    """ceil(chars/4) per file."""
    return FX.files(spark, sf).select("root_id", "rel_path", C.tokens_from_chars("content").alias("tokens"))


@query("tokens_bytes")
def q_tokens_bytes(spark, sf):
    """floor(bytes/4) per file."""
    return EN.files_only(corpus_entries(spark, sf)).select("root_id", "rel_path",
                                                           C.tokens_from_bytes("size").alias("tokens"))


@query("token_level")
def q_token_level(spark, sf):
    """The three bucketings of a file's char-token estimate."""
    t = C.tokens_from_chars("content")
    return FX.files(spark, sf).select("root_id", "rel_path", C.token_level(t, "type").alias("level_type"),
                                      C.token_level(t, "footer").alias("level_footer"),
                                      C.token_level(t, "docs").alias("level_docs"))


@query("ignore_filter")
def q_ignore_filter(spark, sf):
    """Subtree pruning with the default patterns for every root."""
    from sheaf.functions.patterns import DEFAULT_PATTERNS
    return prune(corpus_entries(spark, sf), patterns=DEFAULT_PATTERNS).select("root_id", "rel_path")


@query("ignore_by_profile")
def q_ignore_by_profile(spark, sf):
    """C4: subtree pruning with per-root profiles (equi-join + CASE over literals)."""
    return pruned_entries(spark, sf).select("root_id", "rel_path", "is_dir")


# ---------------------------------------------------------------- 2H selection
@query("expand_selection")
def q_expand_selection(spark, sf):
    """H1: checked entries after propagating picks down the pruned tree."""
    e = S.expand(pruned_entries(spark, sf), FX.picks(spark, sf))
    return e.filter("checked").select("root_id", "rel_path", "is_dir")


@query("tristate_rollup")
def q_tristate_rollup(spark, sf):
    """State of every directory."""
    return states(spark, sf).filter("is_dir").select("root_id", "rel_path", "state")


@query("collect_selected")
def q_collect_selected(spark, sf):
    """H2: checked files, subtrees under unchecked directories skipped."""
    return S.collect_selected(states(spark, sf)).select("root_id", "rel_path")


@query("selected_flat")
def q_selected_flat(spark, sf):
    """H3."""
    return S.selected_flat(states(spark, sf)).select("root_id", "rel_path")


@query("selected_count")
def q_selected_count(spark, sf):
    """Count and Σ floor(bytes/4) of the selection per root."""
    return S.selection_summary(selected(spark, sf))


@query("selection_tokens")
def q_selection_tokens(spark, sf):
    """D4."""
    return S.selection_summary(selected(spark, sf)).select("root_id", "est_tokens")


# ---------------------------------------------------------------- 2E/2F order
@query("preorder_position")
def q_preorder_position(spark, sf):
    """DFS preorder position of every visible node per root (root skipped)."""
    return R.preorder(pruned_entries(spark, sf).select("root_id", "rel_path", "is_dir"), ci=True).select(
        "root_id", "rel_path", "pos")


@query("document_order")
def q_document_order(spark, sf):
    """selected files in document order."""
    return R.preorder(selected(spark, sf).select("root_id", "rel_path", "is_dir"), ci=True, pos="seq").select(
        "root_id", "rel_path", "seq")


# ---------------------------------------------------------------- 2D render
def _tree(spark, sf, entries=None, **kw):
    e = corpus_entries(spark, sf) if entries is None else entries
    return R.tree_lines(e, profiles=FX.profiles(spark), **kw)


def generate(spark, sf, fmt: str):
    """The flagship chain: scan -> prune -> select -> order -> read -> render, tree included.

    ``entries`` is built once and shared by the selection and the tree, so the
    two branches reuse one exchange of the derived listing.
    """
    entries = corpus_entries(spark, sf)
    pruned = prune(entries, profiles=FX.profiles(spark))
    sel = S.expand(pruned, FX.picks(spark, sf)).filter(~F.col("is_dir") & F.col("checked"))
    return R.fragments(sel, contents(spark, sf), fmt, tree=_tree(spark, sf, entries))


@query("render_tree")
def q_render_tree(spark, sf):
    """Printed tree, per-root profiles, byte order, depth <= 10."""
    return _tree(spark, sf)


@query("assemble_markdown")
def q_assemble_markdown(spark, sf):
    """Markdown document rows with the tree block."""
    return generate(spark, sf, "markdown")


@query("assemble_xml")
def q_assemble_xml(spark, sf):
    """XML document rows with the tree block."""
    return generate(spark, sf, "xml")


@query("output_tokens")
def q_output_tokens(spark, sf):
    """ceil(chars/4) of each rendered Markdown document, from fragment lengths."""
    return R.document_stats(q_assemble_markdown(spark, sf))


# part 2 registers itself on import
from sheaf.plans import tree_queries  # noqa: E402,F401
from sheaf.plans import flow_queries  # noqa: E402,F401

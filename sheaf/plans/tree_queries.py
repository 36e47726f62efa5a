"""Registered queries, part 2: patterns, joins, aggregations, windows, sets, selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheaf.functions import classify as C
from sheaf.functions import paths as P
from sheaf.functions.patterns import (BENCH_GLOB_PATTERNS, PRESETS, cache_matcher, is_valid_glob, naive_cache_regex,
                                      name_regex, override_regex, override_target, path_glob_regex, pattern_kind)
from sheaf.operators import entries as EN
from sheaf.operators import metrics as M
from sheaf.operators import render as R
from sheaf.operators import search as SR
from sheaf.operators import select as S
from sheaf.operators.prune import prune
from sheaf.plans.ordered import ordered_scan
from sheaf.plans.queries import contents, corpus_entries, full_path, nodes, pruned_entries, query, selected
from sheaf.session import pinned_table
from sheaf.sources import fixtures as FX

# ---------------------------------------------------------------------------
# Fixed query parameters (pattern lists, search strings) for the registered runs.
EXACT_PATTERNS = ["doc_1", "/en/"]
NAME_GLOBS = ["*.rs", "d?c_1*", "[!d]oc_*", "*.TXT"]
PATH_REGEXES = ["^/corpus/src1/", "doc_[0-9]+[.]rs$", "/(en|fr)/"]
CACHE_PATTERNS = ["*.rs", "target/**", "*.{txt,md}"]
OVERRIDE_PATTERNS = ["node_modules", "src/en", "*.md"]
FUZZY_QUERY = "Dc1"
SEARCH_WORD = "the"
# ---------------------------------------------------------------------------


def _stack_hits(df, keys, named_conds):
    """Rows (keys..., pattern) for every true condition -- an unpivot, no join."""
    arr = F.array(*[F.when(c, F.lit(n)) for n, c in named_conds])
    return df.select(*keys, F.explode(F.filter(arr, lambda x: x.isNotNull())).alias("pattern"))


@query("pattern_type")
def q_pattern_type(spark, sf):
    """Classify candidate patterns drawn from the corpus names."""
    e = corpus_entries(spark, sf).filter(F.col("rel_path") != "")
    cands = e.select(F.explode(F.array(
        F.col("name"), F.concat(F.lit("*."), F.col("ext")), F.concat(F.lit("^"), F.col("name")),
        F.concat(F.col("name"), F.lit("$")), F.concat(F.col("name"), F.lit("?")))).alias("pattern")).distinct()
    return cands.select("pattern", pattern_kind(F.col("pattern")).alias("ptype"))


@query("match_exact")
def q_match_exact(spark, sf):
    """B7: 'exact' patterns are substrings of the full path."""
    e = corpus_entries(spark, sf).withColumn("_p", full_path())
    return _stack_hits(e, ["root_id", "rel_path"], [(p, F.col("_p").contains(p)) for p in EXACT_PATTERNS])


@query("match_glob")
def q_match_glob(spark, sf):
    """Globs on the basename, case-sensitive."""
    e = corpus_entries(spark, sf).filter(F.col("rel_path") != "")
    return _stack_hits(e, ["root_id", "rel_path"], [(g, F.col("name").rlike(name_regex([g]))) for g in NAME_GLOBS])


@query("match_regex")
def q_match_regex(spark, sf):
    """Unanchored regexes on the full path."""
    e = corpus_entries(spark, sf).withColumn("_p", full_path())
    return _stack_hits(e, ["root_id", "rel_path"], [(r, F.col("_p").rlike(r)) for r in PATH_REGEXES])


@query("pattern_cache_match")
def q_pattern_cache_match(spark, sf):
    """Any glob or naive regex matching the rel path."""
    return corpus_entries(spark, sf).filter(F.col("rel_path").rlike(cache_matcher(CACHE_PATTERNS))).select(
        "root_id", "rel_path")


@query("override_filter")
def q_override_filter(spark, sf):
    """Gitignore-style exclusions; '/'-patterns anchor at the root and prune subtrees."""
    e = corpus_entries(spark, sf)
    rx = override_regex(OVERRIDE_PATTERNS)
    target = override_target(F.col("rel_path"), F.col("is_dir"))
    return e.filter((F.col("rel_path") == "") | ~target.rlike(rx)).select("root_id", "rel_path")


@query("parse_patterns")
def q_parse_patterns(spark, sf):
    """Comma lists built from the corpus -> split, trim, drop empties."""
    e = EN.files_only(corpus_entries(spark, sf))
    s = F.concat(F.lit(" *."), F.col("ext"), F.lit(" ,"), F.col("name"), F.lit(",, *.{js,ts}"))
    parts = F.filter(F.transform(F.split(s, ","), lambda x: F.trim(x)), lambda x: x != "")
    return e.select("root_id", "rel_path", F.array_join(parts, "|").alias("patterns"),
                    F.size(parts).cast("bigint").alias("n_patterns"))


# Patterns at the edges of the glob grammar, judged beside those made from the corpus names.
EDGE_GLOBS = ["a[b]c[d", "[]", "[!]", "[]]", "[!]]", "[**]", "[z-a]", "***", "**", "a/**/b", "a**/b", "**b", "[a/]**"]


@query("drop_invalid_patterns")
def q_drop_invalid_patterns(spark, sf):
    """Candidate globs from the corpus; invalid ones are dropped (flagged here)."""
    e = EN.files_only(corpus_entries(spark, sf))
    cands = e.select(F.explode(F.array(F.concat("name", F.lit("**")), F.concat(F.lit("["), "ext"),
                                       F.concat(F.lit("*."), "ext"), F.concat(F.lit("**/"), "name"),
                                       *[F.lit(g) for g in EDGE_GLOBS])).alias("pattern"))
    return cands.distinct().select("pattern", is_valid_glob(F.col("pattern")).alias("valid"))


@query("preset_patterns")
def q_preset_patterns(spark, sf):
    """B16: 'common' preset per root, plus a trimmed added pattern, minus a removed one."""
    roots = FX.files(spark, sf).select("root_id").distinct()
    base = roots.select("root_id", F.explode(F.array(*map(F.lit, PRESETS["common"]))).alias("pattern"))
    added = (EN.files_only(corpus_entries(spark, sf)).filter(F.col("ext") == "TXT")
             .select("root_id", F.trim(F.concat(F.lit("  *."), F.col("ext"), F.lit(" "))).alias("pattern")))
    out = base.unionByName(added).distinct()
    return out.filter(F.col("pattern") != "dist")


@query("fuzzy_filter")
def q_fuzzy_filter(spark, sf):
    """Subsequence name search."""
    return SR.fuzzy_filter(corpus_entries(spark, sf), FUZZY_QUERY).select("root_id", "rel_path")


@query("pattern_match_matrix")
def q_pattern_match_matrix(spark, sf):
    """Per benchmark pattern, paths matched by the glob and by the naive regex flavour."""
    e = corpus_entries(spark, sf).filter(F.col("rel_path") != "")
    aggs = []
    for i, p in enumerate(BENCH_GLOB_PATTERNS):
        g = path_glob_regex(p)
        aggs.append(F.sum(F.col("rel_path").rlike(g).cast("int") if g else F.lit(0)).alias(f"g{i}"))
        r = naive_cache_regex(p)
        aggs.append(F.sum(F.col("rel_path").rlike(r).cast("int") if r else F.lit(0)).alias(f"r{i}"))
    a = e.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(p).alias("pattern"), F.col(f"g{i}").cast("bigint").alias("glob_matches"),
                              F.col(f"r{i}").cast("bigint").alias("regex_matches"))
                     for i, p in enumerate(BENCH_GLOB_PATTERNS)])
    return a.select(F.inline(rows))


# ---------------------------------------------------------------- 2C joins
@query("children_join")
def q_children_join(spark, sf):
    """Child.parent = parent.rel_path (equi, inner)."""
    e = pruned_entries(spark, sf)
    par = e.filter("is_dir").select("root_id", F.col("rel_path").alias("parent"), F.col("depth").alias("parent_depth"))
    return e.join(par, ["root_id", "parent"]).select("root_id", "parent", "rel_path", "parent_depth")


@query("ancestor_join")
def q_ancestor_join(spark, sf):
    """Every (descendant, ancestor) pair of the pruned tree."""
    return S.ancestor_pairs(pruned_entries(spark, sf)).select(
        "root_id", "rel_path", "ancestor", F.col("anc_depth").cast("bigint").alias("anc_depth"))


@query("restore_selection")
def q_restore_selection(spark, sf):
    """Nodes whose path is in the snapshot (picks), stale picks vanish."""
    return S.restore(pruned_entries(spark, sf), FX.picks(spark, sf)).select("root_id", "rel_path", "is_dir")


@query("language_join")
def q_language_join(spark, sf):
    """Ext -> language through a broadcast lookup (fixed 35-row table: size bounded)."""
    lut = spark.createDataFrame(list(C.LANGUAGE_BY_EXT.items()), "ext string, lang string")
    e = EN.files_only(corpus_entries(spark, sf))
    return (e.join(F.broadcast(lut), "ext", "left")
            .select("root_id", "rel_path", F.coalesce("lang", F.lit("")).alias("lang")))


@query("selected_metadata")
def q_selected_metadata(spark, sf):
    """Picks joined to file metadata; picks without a file drop out."""
    f = EN.files_only(corpus_entries(spark, sf))
    return (FX.picks(spark, sf).join(f, ["root_id", "rel_path"])
            .select("root_id", "rel_path", "size", C.tokens_from_bytes("size").alias("tokens")))


def wanted_with_missing(spark, sf):
    """All picks read as files: directory picks have no content (missing rows)."""
    return FX.picks(spark, sf).select("root_id", "rel_path").distinct()


@query("selected_contents")
def q_selected_contents(spark, sf):
    """Wanted ⟕ contents; missing paths become error rows."""
    f = FX.files(spark, sf)
    r = EN.read_contents(wanted_with_missing(spark, sf), f.select("root_id", "rel_path", "content"))
    return r.select("root_id", "rel_path", F.length("content").cast("bigint").alias("n_chars"), "error")


@query("dirty_roots")
def q_dirty_roots(spark, sf):
    """Changes after each root's last generation (equi on root + ts inequality)."""
    ch = FX.changes(spark, sf)
    gens = ch.filter(F.col("kind") == "create").groupBy("root_id").agg(F.max("ts").alias("last_gen"))
    mod = ch.filter(F.col("kind") == "modify")
    j = mod.join(gens, (mod.root_id == gens.root_id) & (mod.ts > gens.last_gen), "inner")
    return j.groupBy(mod.root_id).agg(F.count(F.lit(1)).alias("n_after"))


# ---------------------------------------------------------------- 2D aggregations
@query("children_by_parent")
def q_children_by_parent(spark, sf):
    """The full child list of every directory, dirs first, case-insensitive: one row a child."""
    e = pruned_entries(spark, sf).filter(F.col("parent").isNotNull())
    return R.sibling_rank(e, ci=True).select("root_id", "parent", F.col("sibling_rank").alias("child_rank"), F.col("name").alias("child"))


@query("failed_summary")
def q_failed_summary(spark, sf):
    """Warning header and failure items in document order."""
    f = FX.files(spark, sf)
    w = wanted_with_missing(spark, sf).withColumn("is_dir", F.lit(False))
    # a listing of what can be read is enough: no text has to travel
    r = EN.read_contents(w.select("root_id", "rel_path"), f.select("root_id", "rel_path", F.when(F.col("content").isNotNull(), "").alias("content")))
    return R.failed_summary(w, r)


@query("render_tree_unfiltered")
def q_render_tree_unfiltered(spark, sf):
    """Printed tree with no patterns, byte order, depth <= 10."""
    return R.tree_lines(corpus_entries(spark, sf), patterns=[])


@query("render_tree_ci")
def q_render_tree_ci(spark, sf):
    """Tree over the loaded (pruned) nodes, case-insensitive order, no depth cap."""
    return R.tree_lines(corpus_entries(spark, sf), profiles=FX.profiles(spark), ci=True, max_depth=None)


@query("node_counts")
def q_node_counts(spark, sf):
    """Nodes, bytes and byte-tokens in each directory's subtree (itself included)."""
    e = pruned_entries(spark, sf)
    # files are counted into their parent first, so that only directories are exploded over their ancestors
    at = F.when(F.col("is_dir"), F.col("rel_path")).otherwise(F.col("parent")).alias("at")
    own = e.groupBy("root_id", at).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b"), F.sum(C.tokens_from_bytes("size")).alias("t"))
    x = own.select("root_id", F.explode(P.ancestors_or_self("at")).alias("dir"), "n", "b", "t")
    a = x.groupBy("root_id", "dir").agg(F.sum("n").cast("bigint").alias("n_nodes"), F.sum("b").cast("bigint").alias("bytes"),
                                        F.sum("t").cast("bigint").alias("tokens"))
    dirs = e.filter("is_dir").select("root_id", F.col("rel_path").alias("dir"))
    return a.join(dirs, ["root_id", "dir"], "left_semi")


@query("bytes_read")
def q_bytes_read(spark, sf):
    """Σ bytes of the readable selected files per root."""
    readable = selected(spark, sf).filter(F.col("size").isNotNull())  # a file without content has no size
    return readable.groupBy("root_id").agg(F.sum("size").cast("bigint").alias("bytes_read"))


@query("match_count")
def q_match_count(spark, sf):
    """Case-insensitive non-overlapping count of a word per file."""
    return FX.files(spark, sf).select("root_id", "rel_path", SR.match_count("content", SEARCH_WORD).alias("n"))


@query("progress_pct")
def q_progress_pct(spark, sf):
    """End-of-read progress per root (roots with nothing selected: 0/0 = 100 %)."""
    roots = corpus_entries(spark, sf).select("root_id").distinct()
    a = selected(spark, sf).groupBy("root_id").agg(F.count(F.lit(1)).alias("total"), F.count("size").alias("current"))
    j = roots.join(a, "root_id", "left").fillna(0, ["total", "current"])
    return j.select("root_id", F.col("current").cast("bigint").alias("current"),
                    F.col("total").cast("bigint").alias("total"),
                    F.round(M.progress_pct("current", "total"), 4).alias("pct"),
                    (F.col("current") >= F.col("total")).alias("complete"))


# ---------------------------------------------------------------- 2E windows
@query("is_last_sibling")
def q_is_last_sibling(spark, sf):
    """Last among surviving siblings, printed order."""
    return R.is_last_sibling(pruned_entries(spark, sf), ci=False).select("root_id", "rel_path", "is_last")


@query("sibling_rank")
def q_sibling_rank(spark, sf):
    """Position among siblings, dirs first then case-insensitive name."""
    return R.sibling_rank(pruned_entries(spark, sf), ci=True).select("root_id", "rel_path", "sibling_rank")


@query("event_gap")
def q_event_gap(spark, sf):
    """µs since the user's previous event, positive gaps only."""
    return M.event_gaps(FX.samples(spark, sf)).select("key", "event_id", "gap_us")


@query("last_n_samples")
def q_last_n_samples(spark, sf):
    """E5: the newest 120 gaps per user."""
    g = M.event_gaps(FX.samples(spark, sf))
    return M.last_n(g, "key", ["ts_us", "event_id"]).select("key", "event_id", "gap_us")


@query("running_progress")
def q_running_progress(spark, sf):
    """N-th file read of each root's total, in document order."""
    sel = selected(spark, sf).withColumn("_sk", R.sort_key("rel_path", "is_dir", True)).select(
        "root_id", "rel_path", "_sk")
    return M.running_progress(sel, "root_id", ["_sk"]).select("root_id", "rel_path", "current", "total")


@query("match_navigation")
def q_match_navigation(spark, sf):
    """Every match of a word with wrap-around next/previous indices."""
    return SR.match_positions(FX.files(spark, sf), ["root_id", "rel_path"], "content", SEARCH_WORD)


@query("history_cap")
def q_history_cap(spark, sf):
    """The newest 20 pushed snapshots per session."""
    ops = FX.sel_ops(spark, sf).filter(F.col("op") == "push")
    return M.last_n(ops, "session_id", ["ts", "event_id"], n=20).select("session_id", "event_id")


# ---------------------------------------------------------------- 2F sorts
@query("sort_dirs_first_ci")
def q_sort_dirs_first_ci(spark, sf):
    """sibling order dirs first, lower(name), name -- all entries."""
    return R.sibling_rank(corpus_entries(spark, sf), ci=True).select("root_id", "rel_path", "sibling_rank")


@query("sort_dirs_first_raw")
def q_sort_dirs_first_raw(spark, sf):
    """sibling order dirs first, byte order -- all entries."""
    return R.sibling_rank(corpus_entries(spark, sf), ci=False).select("root_id", "rel_path", "sibling_rank")


@query("sort_paths")
def q_sort_paths(spark, sf):
    """distinct changed paths per root in path order."""
    d = FX.changes(spark, sf).filter(F.col("kind").isin("modify", "create", "remove")).select("root_id", "path").distinct()
    return ordered_scan(d, ["root_id"], ["path"], pos="pos")


# ---------------------------------------------------------------- 2G sets
def _picks_files_only(spark, sf):
    f = FX.files(spark, sf).select("root_id", "rel_path")
    return FX.picks(spark, sf).join(f, ["root_id", "rel_path"], "left_semi")


def _checked_files(entries, picks):
    """The files a selection checks: a file's state is its expanded flag, so no roll-up is needed."""
    return S.expand(entries, picks).filter("checked AND NOT is_dir").select("root_id", "rel_path")


@query("selection_diff")
def q_selection_diff(spark, sf):
    """G1: files added/removed when directory picks are applied on top of file picks."""
    pr = pruned_entries(spark, sf)
    return S.diff(_checked_files(pr, _picks_files_only(spark, sf)), _checked_files(pr, FX.picks(spark, sf)))


@query("deselect_all")
def q_deselect_all(spark, sf):
    """Every visible entry unchecked."""
    return S.deselect_all(pruned_entries(spark, sf))


@query("select_all")
def q_select_all(spark, sf):
    """Every visible entry checked."""
    return S.select_all(pruned_entries(spark, sf))


def _toxic_snapshot(spark, sf):
    f = FX.files(spark, sf, with_doc_id=True)
    tox = FX.table(spark, sf, "labels").filter(F.col("toxic") == 1).select("doc_id")
    return f.join(tox, "doc_id", "left_semi").select("root_id", "rel_path")


@query("selection_union")
def q_selection_union(spark, sf):
    """Additive restore -- current selection ∪ a snapshot."""
    return S.union_selection(selected(spark, sf), _toxic_snapshot(spark, sf))


@query("merge_change_batches")
def q_merge_change_batches(spark, sf):
    """Several change lists concatenated, paths deduplicated, errors kept."""
    is_error = F.col("kind") == "error"
    ch = FX.changes(spark, sf).filter(F.col("kind").isin("modify", "create", "remove", "error"))
    # one read: paths meet by themselves, each error by its own event
    own = F.when(is_error, F.col("event_id"))
    return ch.groupBy("root_id", F.when(is_error, F.col("message")).otherwise(F.col("path")).alias("item"), is_error.alias("is_error"),
                      own.alias("_event")).agg(F.count(F.lit(1)).alias("_n")).drop("_event", "_n")


@query("capture_snapshot")
def q_capture_snapshot(spark, sf):
    """The selection as a set value: checked files and expanded (checked) directories."""
    st = S.expand(pruned_entries(spark, sf), FX.picks(spark, sf)).filter("checked")
    return st.select("root_id", F.when(F.col("is_dir"), F.lit("dir")).otherwise(F.lit("file")).alias("kind"),
                     "rel_path")


@query("selection_intersect")
def q_selection_intersect(spark, sf):
    """Snapshot paths that still exist in the pruned tree."""
    return S.intersect_existing(FX.picks(spark, sf), pruned_entries(spark, sf))


# ---------------------------------------------------------------- 2H
@query("search_visible")
def q_search_visible(spark, sf):
    """H5: fuzzy hits plus the directories that reveal them."""
    return S.search_visible(pruned_entries(spark, sf), FUZZY_QUERY)


@query("reload_with_patterns")
def q_reload_with_patterns(spark, sf):
    """H7: re-prune with the 'minimal' preset; surviving picks re-expanded."""
    pr = prune(corpus_entries(spark, sf), patterns=PRESETS["minimal"])
    return _checked_files(pr, FX.picks(spark, sf))


@query("hierarchy_rollup")
def q_hierarchy_rollup(spark, sf):
    """D2/C2 at size: region/nation/customer/order/line tree, a line is checked iff returned ('R').

    Nodes are paths: lines repeating an (order, line) pair are one leaf, checked
    when any of them is picked (picks select paths).
    """
    h = pinned_table(FX.hierarchy(spark, sf), "lines")  # the listing is a stored table, as entries are
    e = EN.derive_entries(h.select("root_id", "rel_path", F.lit(None).cast("bigint").alias("size")))
    picks = h.filter("picked").select("root_id", "rel_path")
    return S.selection_states(nodes(e), picks).filter("is_dir").select("root_id", "rel_path", "state")


@query("page_tree")
def q_page_tree(spark, sf):
    """D9 over web pages: one tree per host, default ignore profile, byte order, depth <= 10."""
    e = EN.derive_entries(FX.page_paths(spark, sf).select("root_id", "rel_path", "content"))
    return R.tree_lines(e, profiles=FX.profiles(spark))

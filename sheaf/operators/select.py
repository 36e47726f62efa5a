"""Hierarchical selection.

The keystone is the ancestor explosion (C2): ``(root_id, rel_path, ancestor)``
rows, paths only, Σdepth of them.  Every recursive tree walk of the reference
(propagate a check down, roll states up, prune unchecked subtrees, reveal
ancestors of search hits) becomes an equi-join or a partial aggregation over
that relation -- no recursion, no iteration, no per-root collect.  The hottest
key (a root's ``''`` ancestor) only ever meets partial aggregation or an AQE
skew-split join against a one-row side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.functions import paths as P
from sheaf.functions.classify import tokens_from_bytes
from sheaf.functions.patterns import fuzzy_regex
from sheaf.session import pinned_table

CHECKED, UNCHECKED, INDETERMINATE = "checked", "unchecked", "indeterminate"


def ancestor_pairs(entries: DataFrame, include_self: bool = False) -> DataFrame:
    """``(root_id, rel_path, ancestor, anc_depth)`` for every proper ancestor."""
    arr = P.ancestors_or_self("rel_path") if include_self else P.ancestors("rel_path")
    return entries.select("root_id", "rel_path", F.posexplode(arr).alias("anc_depth", "ancestor"))


def expand(entries: DataFrame, picks: DataFrame, stored: bool = False) -> DataFrame:
    """H1: ``entries`` + ``checked``: the node or any ancestor was picked.

    Picked directories are propagated over directories only: their ancestors
    are exploded and semi-joined to the picks.  A file is checked if it was
    picked itself or its parent is checked, so files meet one row of their own
    path and one of their parent's.  Picks that name pruned or missing paths
    match nothing.

    Picks and checked directories are stored first: their true size lets
    Catalyst broadcast them under its threshold, and the entries then stay
    where they are.  With ``stored`` the rows come from a stored table: entries
    meet the picks once, before anything else is read from them, and no
    directory is exploded where none was picked.
    """
    p = pinned_table(picks.select("root_id", "rel_path").distinct(), "picks")
    own = p.withColumn("_hit", F.lit(True))
    dirs, known = entries.filter("is_dir"), p.withColumnRenamed("rel_path", "ancestor")
    if stored:
        entries = pinned_table(entries.join(own, ["root_id", "rel_path"], "left"), "marked")
        dirs = entries.filter("is_dir")
        known = pinned_table(dirs.filter("_hit").select("root_id", F.col("rel_path").alias("ancestor")).distinct(), "picked")
        if known.isEmpty():
            return entries.withColumn("checked", F.coalesce(F.col("_hit") & ~F.col("is_dir"), F.lit(False))).drop("_hit")
    up = (dirs.select("root_id", "rel_path", F.explode(P.ancestors_or_self("rel_path")).alias("ancestor"))
          .join(known, ["root_id", "ancestor"], "left_semi")
          .select("root_id", F.col("rel_path").alias("_dir")).distinct())
    up = pinned_table(up, "checked").withColumn("_up", F.lit(True))
    marked = entries.withColumn("_dir", F.when(F.col("is_dir"), F.col("rel_path")).otherwise(F.col("parent")))
    if not stored:
        marked = marked.join(own, ["root_id", "rel_path"], "left")
    states = (marked.join(up, ["root_id", "_dir"], "left")
              .withColumn("checked", F.coalesce(F.col("_up"), F.col("_hit") & ~F.col("is_dir"), F.lit(False)))
              .drop("_dir", "_hit", "_up"))
    return pinned_table(states.select(*entries.drop("_hit").columns, "checked"), "states") if stored else states


def rollup(states: DataFrame, stored: bool = False) -> DataFrame:
    """``state`` for every entry from leaf ``checked`` flags.

    A directory with children is checked iff all its descendant leaves are,
    unchecked iff none is, else indeterminate; a childless node keeps its own
    flag.  Equal to the bottom-up recursive update by induction.

    Children are counted by parent first (files: all, checked), then only
    directories are exploded over their ancestors; a childless directory counts
    as one leaf of its own.  A file's state is its own flag, so files take part
    in one partial aggregation and no join but the last, by their unique path.
    States are read five times, by column, so they are stored first unless they
    come from a stored table already (``stored``).
    """
    if not stored:
        states = pinned_table(states, "states")
    directory = F.col("is_dir")
    files = states.filter(~directory).groupBy("root_id", F.col("parent").alias("_dir")).agg(
        F.count(F.lit(1)).alias("_n"), F.count(F.when(F.col("checked"), 1)).alias("_c"))
    dirs = states.filter(directory).select("root_id", "rel_path", "parent", "checked")
    inner = dirs.filter(F.col("parent").isNotNull()).groupBy("root_id", F.col("parent").alias("_dir")).agg(
        F.lit(0).cast("bigint").alias("_n"), F.lit(0).cast("bigint").alias("_c"))
    known = files.unionByName(inner).groupBy("root_id", "_dir").agg(F.sum("_n").alias("_n"), F.sum("_c").alias("_c"))
    own = dirs.join(known, (dirs["root_id"] == known["root_id"]) & (dirs["rel_path"] == known["_dir"]), "left").select(
        dirs["root_id"], "rel_path", F.coalesce("_n", F.lit(1)).alias("_n"),
        F.coalesce("_c", F.col("checked").cast("bigint")).alias("_c"))
    total = (own.select("root_id", F.explode(P.ancestors_or_self("rel_path")).alias("rel_path"), "_n", "_c")
             .groupBy("root_id", "rel_path").agg(F.sum("_n").alias("_n"), F.sum("_c").alias("_c")))
    flag = F.when(F.col("checked"), F.lit(CHECKED)).otherwise(F.lit(UNCHECKED))
    top = (states.filter(directory).join(total, ["root_id", "rel_path"], "left").withColumn(
        "state", F.when(F.coalesce("_n", F.lit(0)) == 0, flag).when(F.col("_c") == F.col("_n"), F.lit(CHECKED))
        .when(F.col("_c") == 0, F.lit(UNCHECKED)).otherwise(F.lit(INDETERMINATE))).drop("_n", "_c"))
    return top.unionByName(states.filter(~directory).withColumn("state", flag))


def collect_selected(states: DataFrame) -> DataFrame:
    """H2: checked files with no unchecked ancestor (subtrees under unchecked dirs skipped)."""
    cand = states.filter(~F.col("is_dir") & (F.col("state") == CHECKED))
    unchecked = states.filter(F.col("is_dir") & (F.col("state") == UNCHECKED)).select(
        "root_id", F.col("rel_path").alias("ancestor"))
    bad = (ancestor_pairs(cand.select("root_id", "rel_path"))
           .join(unchecked, ["root_id", "ancestor"], "left_semi").select("root_id", "rel_path"))
    return cand.join(bad, ["root_id", "rel_path"], "left_anti")


def selected_flat(states: DataFrame) -> DataFrame:
    """H3: every checked file, no pruning."""
    return states.filter(~F.col("is_dir") & (F.col("state") == CHECKED))


def selection_states(entries: DataFrame, picks: DataFrame) -> DataFrame:
    """H1 then D2: the usual chain."""
    return rollup(expand(entries, picks, stored=True), stored=True)


def selection_summary(selected: DataFrame) -> DataFrame:
    """Per root ``n_selected`` and Σ floor(bytes/4)."""
    return selected.groupBy("root_id").agg(
        F.count(F.lit(1)).alias("n_selected"),
        F.sum(tokens_from_bytes("size")).cast("bigint").alias("est_tokens"))


def search_visible(entries: DataFrame, query: str) -> DataFrame:
    """H5: nodes whose name fuzzy-matches, plus the directories above them (root skipped)."""
    nodes = entries.filter(F.col("rel_path") != "")
    hits = nodes.filter(F.col("name").rlike(fuzzy_regex(query))).select("root_id", "rel_path")
    ups = (ancestor_pairs(hits).filter(F.col("ancestor") != "")
           .select("root_id", F.col("ancestor").alias("rel_path")))
    return hits.unionByName(ups).distinct()


def diff(before: DataFrame, after: DataFrame, keys=("root_id", "rel_path")) -> DataFrame:
    """G1: rows added / removed between two selections (hash anti-joins, no sort)."""
    keys = list(keys)
    b, a = before.select(*keys).distinct(), after.select(*keys).distinct()
    added = a.join(b, keys, "left_anti").withColumn("change", F.lit("added"))
    removed = b.join(a, keys, "left_anti").withColumn("change", F.lit("removed"))
    return added.unionByName(removed)


def restore(entries: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Entries whose path is in the snapshot set (left semi join)."""
    return entries.join(snapshot.select("root_id", "rel_path").distinct(), ["root_id", "rel_path"], "left_semi")


def union_selection(current: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Additive restore -- never unchecks."""
    return current.select("root_id", "rel_path").union(snapshot.select("root_id", "rel_path")).distinct()


def intersect_existing(snapshot: DataFrame, entries: DataFrame) -> DataFrame:
    """Snapshot paths that still exist (stale ones vanish)."""
    return snapshot.select("root_id", "rel_path").distinct().join(
        entries.select("root_id", "rel_path"), ["root_id", "rel_path"], "left_semi")


def select_all(entries: DataFrame) -> DataFrame:
    """Every entry checked."""
    return entries.select("root_id", "rel_path", F.lit(CHECKED).alias("state"))


def deselect_all(entries: DataFrame) -> DataFrame:
    """Every entry unchecked."""
    return entries.select("root_id", "rel_path", F.lit(UNCHECKED).alias("state"))

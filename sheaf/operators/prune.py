"""Ignore-pattern pruning.

An entry disappears when it or any ancestor has a name matching any pattern of
its root's profile.  A profile is folded to ONE regex over
``'/' || rel_path || '/'`` (see ``component_regex``), so pruning is a single
RLIKE per row: no explode, no recursion, and never a join on RLIKE (which would
plan as a nested-loop join).  Very many profiles go through a name dictionary.

Profiles: ``profiles(root_id, ord, pattern)``; ``root_id`` NULL is the global
profile; a root with any rows of its own uses only those (a NULL pattern row
marks an explicitly empty profile).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.functions.patterns import component_regex
from sheaf.session import ensure_checkpoint_dir, pinned_table

LITERALS = 64  # different profiles that become literals of a plan


def match_any_component(rel_path: Column, patterns: list[str], root_name: Column | None = None) -> Column:
    """True when any component (optionally the root's own name too) matches a glob."""
    prof = component_regex(patterns)
    if prof.regex is None:
        return F.lit(False)
    return component_target(rel_path, root_name).rlike(prof.regex)


def component_target(rel_path: Column, root_name: Column | None = None) -> Column:
    """What a component regex is tested on: the path (after the root's name, if given) between slashes."""
    if root_name is None:
        return F.concat(F.lit("/"), rel_path, F.lit("/"))
    return F.concat(F.lit("/"), root_name, F.when(rel_path == "", F.lit("")).otherwise(F.lit("/")), rel_path, F.lit("/"))


def prune_with_patterns(entries: DataFrame, patterns: list[str], include_root: bool = False) -> DataFrame:
    """B11 with one pattern list for every root."""
    hit = match_any_component(F.col("rel_path"), patterns, F.col("root_id") if include_root else None)
    return entries.filter(~hit)


_RESOLVED: dict = {}  # (app id, id(profiles)) -> (profiles, root regexes, global regex); holds the frame alive


def resolve_profiles(profiles: DataFrame) -> tuple[DataFrame, str | None]:
    """``(root_id, _own, _rx)``, one row a root with a profile of its own, and the global regex; memoised per frame.

    Each pattern list is folded to its regex where its rows are (a small function over policy rows); the result is
    pinned once, so the queries that use it run no Python.  Only the global list reaches the driver.
    """
    spark = profiles.sparkSession
    key = (spark.sparkContext.applicationId, id(profiles))
    if key not in _RESOLVED:
        ensure_checkpoint_dir(spark)
        folded = (profiles.groupBy("root_id")
                  .agg(F.array_sort(F.collect_list(F.struct("ord", "pattern"))).alias("_pl"))
                  .select("root_id", F.filter(F.transform("_pl", lambda s: s["pattern"]), lambda p: p.isNotNull()).alias("plist"))
                  .mapInPandas(_fold, "root_id string, _own boolean, _rx string")).checkpoint()
        default = folded.filter(F.col("root_id").isNull()).first()
        _RESOLVED[key] = (profiles, folded.filter(F.col("root_id").isNotNull()), default["_rx"] if default else None)
    return _RESOLVED[key][1:]


def _fold(frames):
    import pandas as pd
    for f in frames:
        yield pd.DataFrame({"root_id": f["root_id"], "_own": True,
                            "_rx": [component_regex(list(p)).regex for p in f["plist"]]}, columns=["root_id", "_own", "_rx"])


def prune(entries: DataFrame, profiles: DataFrame | None = None, patterns: list[str] | None = None,
          include_root: bool = False) -> DataFrame:
    """Subtree-prune ``entries`` by a global list or per-root ``profiles``.

    Any number of profiles, and no regex is compiled for an entry: up to ``LITERALS`` different ones are literals of one
    CASE; beyond that a name dictionary is tested once for each profile and name, and blocked names are joined.  Roots
    without a profile are tested against the global literal.
    """
    if profiles is None:
        return prune_with_patterns(entries, patterns or [], include_root)
    own, default = resolve_profiles(profiles)
    target = component_target(F.col("rel_path"), F.col("root_id") if include_root else None)
    globally = target.rlike(default) if default else F.lit(False)
    few = [r["_rx"] for r in own.select("_rx").distinct().limit(LITERALS + 1).collect()]
    marked = entries.join(own, "root_id", "left")
    if len(few) <= LITERALS:
        hit = F.lit(False)
        for rx in few:
            hit = F.when(F.col("_rx") == rx, target.rlike(rx)).otherwise(hit) if rx is not None else hit
        return marked.filter(~F.when(F.col("_own"), hit).otherwise(globally)).drop("_own", "_rx")
    blocked = _blocked_by_name(marked.filter("_rx IS NOT NULL").select("root_id", "rel_path", "parent", "is_dir", "_rx"), target)
    return marked.filter(F.col("_own").isNotNull() | ~globally).drop("_own", "_rx").join(blocked, ["root_id", "rel_path"], "left_anti")


def _blocked_by_name(marked: DataFrame, target: Column) -> DataFrame:
    """``root_id, rel_path`` of entries of roots with their own profile that a component's name blocks.

    A name dictionary: each distinct (profile, component name) is tested once, whatever number of entries has it.  Only
    directories are taken apart into components; anything else meets its own name and its parent directory.
    """
    profile = F.xxhash64("_rx").alias("_p")
    names = F.filter(F.split(target, "/"), lambda x: x != "")
    parts = marked.filter("is_dir OR parent IS NULL").select("root_id", "rel_path", "_rx", profile, F.explode(F.array_distinct(names)).alias("_name"))
    last = F.substring_index("rel_path", "/", -1)
    files = marked.filter("NOT is_dir").select("root_id", "rel_path", "parent", "_rx", profile, last.alias("_name"))
    known = parts.select("_rx", "_p", "_name").unionByName(files.select("_rx", "_p", "_name")).distinct()
    bad = pinned_table(known.filter(F.rlike(F.concat(F.lit("/"), F.col("_name"), F.lit("/")), F.col("_rx"))).select("_p", "_name"), "blocked_names")
    dirs = pinned_table(parts.join(bad, ["_p", "_name"], "left_semi").select("root_id", "rel_path").distinct(), "blocked_directories")
    own = files.join(bad, ["_p", "_name"], "left_semi").select("root_id", "rel_path")
    inside = files.join(dirs.withColumnRenamed("rel_path", "parent"), ["root_id", "parent"], "left_semi").select("root_id", "rel_path")
    return dirs.unionByName(own).unionByName(inside).distinct()


def rejected_patterns(patterns: list[str]) -> list[str]:
    """Patterns the glob grammar rejects (silently skipped when matching)."""
    return list(component_regex(patterns).rejected)

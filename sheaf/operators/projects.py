"""Ignore presets by project type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.functions.patterns import DEFAULT_PATTERNS

# ---------------------------------------------------------------------------
# The documented presets, the files at a root's top that mark a type (first type first), and the
# extensions that tell it where no marker is.
PRESETS_BY_TYPE = {
    "node": ["node_modules", "dist", "build", "coverage", "*.log", ".nyc_output", "npm-debug.log*"],
    "rust": ["target", "Cargo.lock", "*.pdb", "*.exe", "*.so", "*.dylib"],
    "python": ["__pycache__", "*.pyc", "*.pyo", "venv", "env", ".pytest_cache", "dist", "build"],
    "java": ["target", "*.class", "*.jar", "*.war", "*.ear", "*.iml"],
}
MARKERS = [("rust", ["Cargo.toml"]), ("node", ["package.json"]), ("python", ["pyproject.toml", "setup.py", "requirements.txt"]),
           ("java", ["pom.xml", "build.gradle"])]
TYPE_BY_EXT = {"rs": "rust", "js": "node", "ts": "node", "py": "python", "java": "java"}
# ---------------------------------------------------------------------------


def _map(values: dict, of=F.lit) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), of(v))])


def project_types(entries: DataFrame) -> DataFrame:
    """``(root_id, project_type)``: by marker file at the top, else by the type with the most files, else ``default``.

    Both come from one aggregate over ``(root_id, type)``; of types with equally many files the last by name counts.
    """
    files = entries.filter(~F.col("is_dir"))
    rank = F.lit(None).cast("int")
    for i, (_, names) in reversed(list(enumerate(MARKERS))):
        rank = F.when((F.col("depth") == 1) & F.col("name").isin(names), i).otherwise(rank)
    kinds = files.groupBy("root_id", F.try_element_at(_map(TYPE_BY_EXT), F.col("ext")).alias("t")).agg(
        F.count(F.lit(1)).alias("n"), F.min(rank).alias("mark"))
    best = F.max(F.when(F.col("t").isNotNull(), F.struct("n", "t")))["t"]
    marked = F.get(F.array(*[F.lit(t) for t, _ in MARKERS]), F.min("mark"))
    return kinds.groupBy("root_id").agg(F.coalesce(marked, best, F.lit("default")).alias("project_type"))


def project_profiles(entries: DataFrame) -> DataFrame:
    """Profile rows ``(root_id, project_type, ord, pattern)`` of each root's preset."""
    presets = _map({**PRESETS_BY_TYPE, "default": DEFAULT_PATTERNS}, lambda v: F.array(*map(F.lit, v)))
    return project_types(entries).select("root_id", "project_type", F.posexplode(F.element_at(presets, F.col("project_type"))).alias("ord", "pattern"))

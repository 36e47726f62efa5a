"""Ignore policies from saved settings, one JSON text a root.

A policy's settings must all be there, as the desktop tool saves them; a text that is no JSON or lacks one falls back
to the default patterns.  An empty pattern list is an explicitly empty profile.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.functions.patterns import DEFAULT_PATTERNS

# The settings that a saved policy holds (last_directory may be null).
REQUIRED = {"window_width": "float", "window_height": "float", "split_position": "float", "ignore_patterns": "string",
            "include_tree": "boolean", "output_format": "string", "theme": "string"}


def parse_policies(policies: DataFrame, text: str = "policy") -> DataFrame:
    """``policies(root_id, <text>)`` -> profile rows ``(root_id, ord, pattern)``; NULL marks an empty profile."""
    schema = ", ".join(f"{k} {v}" for k, v in REQUIRED.items())
    p = F.from_json(F.col(text), schema, {"mode": "PERMISSIVE"})
    whole = F.lit(True)
    for k in REQUIRED:
        whole = whole & p[k].isNotNull()
    listed = F.transform(F.split(p["ignore_patterns"], ","), lambda x: F.trim(x))
    own = F.when(p["ignore_patterns"] == "", F.array(F.lit(None).cast("string"))).otherwise(listed)
    patterns = F.when(F.coalesce(whole, F.lit(False)), own).otherwise(F.array(*map(F.lit, DEFAULT_PATTERNS)))
    return policies.select("root_id", F.posexplode(patterns).alias("ord", "pattern"))


def read_policies(spark: SparkSession, path: str) -> DataFrame:
    """Profile rows from a folder of ``<root_id>.json`` files.

    Spark reads no empty file, so such a root has no rows, like one without a file: the global profile holds for it.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(path)
    return parse_policies(files.select(F.regexp_extract("path", r"([^/]+)\.json$", 1).alias("root_id"),
                                       F.col("content").cast("string").alias("policy")))

"""Search over names and contents.

All matching is built-in string/regex expressions over whole texts; match
offsets come from the lengths of the pieces between matches with a running sum
per text, so a text never leaves the task that holds its row.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.functions.patterns import fuzzy_regex


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def fuzzy_filter(entries: DataFrame, query: str) -> DataFrame:
    """Names containing the query's characters in order (smart case)."""
    return entries.filter((F.col("rel_path") != "") & F.col("name").rlike(fuzzy_regex(query)))


def match_count(text, query: str) -> Column:
    """Non-overlapping, case-insensitive occurrences of ``query``; '' -> 0."""
    if not query:
        return F.lit(0).cast("bigint")
    t = F.lower(_c(text))
    q = query.lower()
    return F.floor((F.length(t) - F.length(F.replace(t, F.lit(q), F.lit("")))) / len(q)).cast("bigint")


def match_positions(texts: DataFrame, key_cols: list[str], text_col: str, query: str) -> DataFrame:
    """One row per match: ``match_idx`` (0-based), ``char_offset``, wrap-around ``next_idx``/``prev_idx``."""
    q = query.lower()
    lens = F.transform(F.split(F.lower(F.col(text_col)), re.escape(q), -1), lambda x: F.length(x))
    # only the lengths of the pieces between matches leave the row, never the text
    x = texts.select(*key_cols, lens.alias("_lens")).filter(F.size("_lens") > 1)
    x = x.select(*key_cols, (F.size("_lens") - 1).alias("_n"), F.posexplode("_lens").alias("_i", "_len"))
    w = Window.partitionBy(*key_cols).orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("_before", F.sum("_len").over(w)).filter(F.col("_i") < F.col("_n"))
    off = (F.col("_before") + F.col("_i") * len(q)).cast("bigint")
    n = F.col("_n")
    return x.select(*key_cols, F.col("_i").cast("bigint").alias("match_idx"), off.alias("char_offset"),
                    F.pmod(F.col("_i") + 1, n).cast("bigint").alias("next_idx"),
                    F.pmod(F.col("_i") - 1 + n, n).cast("bigint").alias("prev_idx"),
                    n.cast("bigint").alias("match_count"))


def content_search(contents: DataFrame, pattern: str, text_col: str = "content") -> DataFrame:
    """Regex search in contents -> rows with match count and first match."""
    c = F.col(text_col)
    return (contents.filter(c.rlike(pattern))
            .withColumn("n_matches", F.regexp_count(c, F.lit(pattern)).cast("bigint"))
            .withColumn("first_match", F.regexp_extract(c, pattern, 0)))

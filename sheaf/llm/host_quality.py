"""Quality rules judged by document and by host.

Every text gets word, symbol, line and repetition counts, and fails or passes the base rules.  Rule failures are then
aggregated by host; a rule's host rates are shrunk towards the corpus by an empirical beta prior (moments of the host
rates, less binomial noise); a host whose shrunk rate of any rule is over ``max_host_rate`` is rejected, and the
verdict is joined back to its documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from sheaf.llm.shared import binary_values, free_name, quoted, stored

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Rules of a document, over the counts of ``STATS``.
RULES = {"short": "n_words < 50", "repeats": "100 * n_repeat_words > 50 * n_words"}
MAX_HOST_RATE = 0.8
MAX_STRENGTH = 1_000_000.0
_OTHER, _INNER, _SPACE, _SYMBOL = range(4)
_KIND = np.zeros(256, np.uint8)
_KIND[0x80:0xC0] = _INNER  # bytes inside a code point
_KIND[[0x20, *range(0x09, 0x0E)]] = _SPACE
_KIND[list(b"#*$%&|<>")] = _SYMBOL


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that the text has twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    if len(number) == n:
        return 0
    _, pair = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)
    _, window, count = np.unique(pair[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
    again = count[window] > 1
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift:n - 2 + shift] |= again
    return int(covered.sum())


def counts(text: bytes | None) -> tuple[int, int, int, int, int]:
    """The ``STATS`` of one text (null: all zero)."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.split()  # bytes split at \\x20 and \\x09-\\x0D
    kinds = np.bincount(_KIND[np.frombuffer(text, np.uint8)], minlength=4)
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (len(words), int(kinds[_OTHER] + kinds[_SYMBOL]), int(kinds[_SYMBOL]), len(lines) - len(set(lines)),
            repeated_words(words))


def measured(docs: DataFrame, text: str, prefix: str = "") -> DataFrame:
    """``docs`` with the ``STATS`` of its column ``text`` (names after ``prefix``)."""
    names = [prefix + s for s in STATS]
    at = docs.columns.index(text)
    schema = StructType([*docs.schema.fields, *[StructField(n, LongType()) for n in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [counts(t) for t in binary_values(batch.column(at))]
            found = np.array(rows, np.int64).reshape(-1, len(STATS))
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, found.T)], [*batch.schema.names, *names])

    return docs.mapInArrow(run, schema)


def failed(rules: dict[str, str], prefix: str = "") -> dict[str, Column]:
    """A column for each rule, and ``any``: true where a document breaks it."""
    def one(rule: str) -> Column:
        for s in STATS:
            rule = rule.replace(s, prefix + s)
        return F.expr(rule)
    each = {name: one(rule) for name, rule in rules.items()}
    anyone = F.lit(False)
    for c in each.values():
        anyone = anyone | c
    return {**each, "any": anyone}


def host_verdicts(judged: DataFrame, host: str, rules: dict[str, Column], max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One row for each non-null host: ``host``, ``host_docs``, ``host_rate`` (largest shrunk rate), ``host_kept``.

    A rule's prior is Beta(m * s, (1 - m) * s): m is the corpus rate and s = m (1 - m) / spread - 1, where the spread
    is the hosts' variance around m, weighted by documents, less what binomial noise alone gives; without any spread
    all hosts get the corpus rate.
    """
    known = judged.filter(F.col(host).isNotNull())
    fails = [F.sum(c.cast("long")).alias(f"__f_{name}") for name, c in rules.items()]
    hosts = known.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("host_docs"), *fails)
    hosts = stored(hosts, "hosts")
    n = F.col("host_docs")
    whole = hosts.agg(F.sum(n).alias("__n"), F.count("*").alias("__hosts"), *[
        x for r in rules for x in (F.sum(f"__f_{r}").alias(f"__s_{r}"),
                                   F.sum(F.col(f"__f_{r}") * F.col(f"__f_{r}") / n).alias(f"__q_{r}"))]).first()
    rates = []
    for r in rules:
        total = whole["__n"] or 1
        mean = (whole[f"__s_{r}"] or 0) / total
        noise = mean * (1 - mean) * whole["__hosts"] / total
        spread = (whole[f"__q_{r}"] or 0.0) / total - mean * mean - noise
        most = mean * (1 - mean)
        strength = min(max(most / spread - 1, 1e-6), MAX_STRENGTH) if spread * MAX_STRENGTH > most else MAX_STRENGTH
        rates.append((F.col(f"__f_{r}") + F.lit(mean * strength)) / (n + F.lit(strength)))
    rate = F.greatest(*rates) if len(rates) > 1 else rates[0]
    return hosts.select("host", "host_docs", rate.alias("host_rate"), (rate <= max_host_rate).alias("host_kept"))


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source",
          rules: dict[str, str] | None = None, max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, the ``STATS``, ``base_failed``, ``host_rate``, ``kept``.

    A null or empty text has no words and so fails the base rules.  A document without a host is judged by its own
    rules alone (``host_rate`` null).  Repeated rows each get a row; an empty table gives none.  Only the three named
    columns are read, whatever else the table has.
    """
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("__text"), F.col(host).alias("__host"))
    stats = stored(measured(source, "__text").drop("__text"), "stats")
    broken = failed(rules or RULES)
    hosts = stored(host_verdicts(stats, "__host", broken, max_host_rate).withColumnRenamed("host", "__host"), "verdicts")
    return stats.join(hosts, "__host", "left").select(
        "doc_id", *STATS, broken["any"].alias("base_failed"), "host_rate",
        (~broken["any"] & F.coalesce("host_kept", F.lit(True))).alias("kept"))


def keep(docs: DataFrame, text: str = "text", host: str = "source", rules: dict[str, str] | None = None,
         max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, all columns; nulls, ties and empty tables as there."""
    prefix = free_name(docs, "__quality_")
    broken = failed(rules or RULES, prefix)
    judged = stored(measured(docs, text, prefix), "judged")
    hosts = stored(host_verdicts(judged, host, broken, max_host_rate).filter("NOT host_kept").select(
        F.col("host").alias(f"{prefix}host")), "rejected")
    good = judged.filter(~broken["any"])
    return good.join(hosts, good[host] == hosts[f"{prefix}host"], "left_anti").select(*map(quoted, docs.columns))


SQL = r"""
WITH d AS (SELECT doc_id, source, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                  string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
tri AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM tri) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n
          FROM (SELECT doc_id, unnest(l) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY doc_id),
s AS (SELECT d.doc_id, d.source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]'))::BIGINT AS n_symbols,
             coalesce(lines.n, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
      FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN lines USING (doc_id)),
f AS (SELECT *, n_words < 50 AS f1, 100 * n_repeat_words > 50 * n_words AS f2 FROM s),
h AS (SELECT source, unnest([1, 2, 3]) AS rule, count(*) AS n,
             unnest([count(*) FILTER (f1), count(*) FILTER (f2), count(*) FILTER (f1 OR f2)]) AS k
      FROM f WHERE source IS NOT NULL GROUP BY source),
m AS (SELECT rule, sum(n) AS n, sum(k) / sum(n) AS m, sum(k * k / n) / sum(n) AS q, count(*) AS hosts FROM h GROUP BY rule),
p AS (SELECT rule, m, m * (1 - m) AS most, q - m * m - m * (1 - m) * hosts / n AS spread FROM m),
a AS (SELECT rule, m, CASE WHEN spread * 1e6 > most THEN least(greatest(most / spread - 1, 1e-6), 1e6) ELSE 1e6 END AS s FROM p),
r AS (SELECT source, max((k + m * s) / (n + s)) AS host_rate FROM h JOIN a USING (rule) GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (f1 OR f2) AS base_failed, host_rate,
       NOT (f1 OR f2) AND coalesce(host_rate <= 0.8, TRUE) AS kept
FROM f LEFT JOIN r USING (source)
"""

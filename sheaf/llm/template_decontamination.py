"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Texts become sequences of template tokens: lower-case words, with numbers, names (capitalised words inside a sentence,
but not three or more in a row, as in headings) and units (after a number) replaced by typed placeholders.  Windows of
``WINDOW`` template tokens are hash-joined with the benchmark's, and so are windows of the plain lower-case tokens, since
what counts as a name depends on case and on the neighbours.  Matches of a document and an item on one diagonal (equal
shift) that cover enough of the item are a candidate; its slots, the original values behind the placeholders, must be
consistent: equal item values stand for equal document values.  That catches verbatim copies and re-parameterised
questions alike.  Items shorter than a window are matched whole and word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.llm.shared import free_name, row_key, stored

WINDOW = 6
MIN_LITERALS = 3  # words that a window must hold beside its placeholders
MIN_TOKENS = 13  # tokens that a match must cover; of a shorter item all but one, for the word beside other text
MIN_ITEM = 3  # tokens of the shortest item that can be told
TOKEN = r"[\p{L}\p{M}]+|[0-9]+(?:[.,][0-9]+)*|[.!?:\n]"
STOPS = [".", "!", "?", ":", "\n"]
#: Units that count as a placeholder after a number.
UNITS = ["mm", "cm", "m", "km", "inch", "inches", "feet", "foot", "yards", "miles", "mile", "mg", "g", "kg", "gram", "grams",
         "pounds", "ounces", "ml", "l", "liter", "liters", "litre", "litres", "seconds", "second", "minutes", "minute",
         "hours", "hour", "days", "day", "weeks", "week", "months", "month", "years", "year", "dollars", "dollar", "cents",
         "euros", "euro", "percent", "degrees", "meters", "meter", "metres", "metre", "kilometers", "kilograms"]


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def _is_number(token: Column) -> Column:
    return (token >= "0") & (token < ":")  # a token starts with a digit, a letter or is a stop


def canonical(df: DataFrame, text: str) -> DataFrame:
    """``df`` with ``__raw`` and ``__tpl``, arrays of equal length: original and template tokens of ``text``."""
    def template(token: Column, i: Column) -> Column:
        before, low = F.get("__tok", i - 1), F.lower(token)

        def capital(j: Column) -> Column:
            return F.coalesce(F.lower(F.get("__tok", j)) != F.get("__tok", j), F.lit(False))

        heading = (capital(i - 1) & (capital(i + 1) | capital(i - 2))) | (capital(i + 1) & capital(i + 2))
        return (F.when(_is_number(token), "<num>")
                .when(low.isin(UNITS) & _is_number(before), "<unit>")
                .when((low != token) & (i > 0) & ~before.isin(STOPS) & token.rlike(r"^\p{Lu}\p{Ll}") & ~heading, "<name>")
                .otherwise(low))

    df = df.withColumn("__tok", _tokens(F.col(text)))
    df = df.withColumn("__all", F.transform("__tok", template))
    inner = lambda t: ~t.isin(STOPS)
    return (df.withColumn("__raw", F.filter("__tok", inner)).withColumn("__tpl", F.filter("__all", inner))
            .withColumn("__low", F.transform("__raw", F.lower)).drop("__tok", "__all"))


def _places(width: int) -> Column:
    """Where windows of ``width`` tokens start, from 1."""
    at = F.when(F.size("__tpl") >= width, F.sequence(F.lit(1), F.size("__tpl") - (width - 1)))
    return F.coalesce(at, F.array().cast("array<int>"))


def _window(tokens: str, i: Column) -> Column:
    """The hash of the window that starts at ``i`` (from 1) of an array of token hashes."""
    return F.xxhash64(F.slice(tokens, i, F.lit(WINDOW)))


def _hashed(df: DataFrame) -> DataFrame:
    """``df`` with ``__t`` and ``__l``, the hashes of its template and plain tokens: a token is hashed once, not once a window."""
    return df.withColumn("__t", F.transform("__tpl", lambda t: F.xxhash64(t))).withColumn("__l", F.transform("__low", lambda t: F.xxhash64(t)))


def windows(df: DataFrame, *keep: str) -> DataFrame:
    """``keep``, ``pos`` (from 0), ``h`` of all windows of ``df`` (``_hashed``): of template tokens, and where these differ of
    plain ones."""
    template = F.transform(_places(WINDOW), lambda i: F.struct((i - 1).alias("pos"), _window("__t", i).alias("h")))
    filled = F.filter(_places(WINDOW), lambda i: F.slice("__t", i, F.lit(WINDOW)) != F.slice("__l", i, F.lit(WINDOW)))
    plain = F.when(F.col("__t") != F.col("__l"), F.transform(filled, lambda i: F.struct((i - 1).alias("pos"), _window("__l", i).alias("h"))))
    both = F.when(plain.isNull(), template).otherwise(F.concat(template, plain))
    return df.select(*keep, F.explode(both).alias("w")).select(*keep, "w.pos", "w.h")


def short_windows(df: DataFrame, widths: list[int], *keep: str) -> DataFrame:
    """The same for windows of plain tokens of other ``widths``."""
    part = lambda n: F.transform(_places(n), lambda i: F.struct(
        (i - 1).alias("pos"), F.xxhash64(F.lit(n), F.slice("__l", i, F.lit(n))).alias("h")))
    return df.select(*keep, F.explode(F.concat(*map(part, widths))).alias("w")).select(*keep, "w.pos", "w.h")


def matches(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
            item_text: str = "text") -> DataFrame:
    """Contaminated pairs: ``__key`` (of the document), ``doc_id, item_id, matched_tokens, item_tokens, slots, verbatim``.

    One row for each document and item: its match with the most tokens (then the first shift).  ``slots`` counts the
    placeholders covered; ``verbatim`` says that all of them hold the item's own values.  Null or empty texts match
    nothing; items of fewer than ``MIN_ITEM`` tokens are too short to tell.  Rows equal in id and text count once, on
    both sides.  Empty tables give no row.  Whole texts are matched, and other columns are not looked at.
    """
    items = canonical(benchmark.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("__text")).dropDuplicates(), "__text")
    items = stored(items.select("item_id", row_key("item_id", "__text").alias("__item"), "__raw", "__tpl", "__low",
                                F.size("__tpl").alias("item_tokens")), "items")
    items_hashed = _hashed(items)
    own = windows(items_hashed, "__item", "item_tokens", "__tpl", "__l").withColumnRenamed("pos", "at")
    part = F.slice("__tpl", F.col("at") + 1, F.lit(WINDOW))
    literals = F.size(F.filter(part, lambda t: ~t.startswith("<")))
    plain = F.col("h") == _window("__l", F.col("at") + 1)
    own = own.filter((literals >= MIN_LITERALS) | plain).select("__item", "item_tokens", "at", F.lit(WINDOW).alias("width"), "h")
    brief = items_hashed.filter((F.col("item_tokens") >= MIN_ITEM) & (F.col("item_tokens") < WINDOW))
    widths = sorted(r[0] for r in brief.select("item_tokens").distinct().collect())  # fewer than WINDOW numbers
    if widths:
        whole = F.xxhash64(F.col("item_tokens"), F.col("__l"))
        own = own.unionByName(brief.select("__item", "item_tokens", F.lit(0).alias("at"), F.col("item_tokens").alias("width"), whole.alias("h")))
    own = stored(own, "item_windows")
    least = F.when(F.col("item_tokens") > WINDOW, F.least(F.lit(MIN_TOKENS), F.col("item_tokens") - 1)).otherwise(F.col("item_tokens"))
    few = own.agg(F.min(least).alias("n")).first()["n"] or MIN_TOKENS

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("__text")).withColumn("__key", row_key("doc_id", "__text"))
    told = _hashed(canonical(rows, "__text"))
    spots = windows(told, "__key")
    if widths:
        spots = spots.unionByName(short_windows(told, widths, "__key"))
    hits = stored(spots.join(own.select("h").distinct(), "h", "left_semi"), "hits")
    # a match of n tokens has at least n / WINDOW windows that meet: one hit of a short item keeps a document in
    enough = hits.groupBy("__key").agg(F.count_distinct("pos").alias("n"))
    some = hits.join(enough.filter(F.col("n") * WINDOW >= few).select("__key"), "__key", "left_semi")
    cover = F.array_distinct(F.flatten(F.transform(F.collect_set(F.struct("at", "width")), lambda a: F.sequence(a["at"], a["at"] + a["width"] - 1))))
    found = some.join(own, "h").groupBy("__key", "__item", (F.col("pos") - F.col("at")).alias("shift")).agg(
        cover.alias("cover"), F.first("item_tokens").alias("item_tokens"))
    found = stored(found.filter(F.size("cover") >= least).drop("item_tokens"), "candidates")

    texts = rows.join(found.select("__key").distinct(), "__key", "left_semi").dropDuplicates(["__key"])
    texts = canonical(texts, "__text").select("__key", "doc_id", F.col("__raw").alias("__have"))
    slots = F.filter("cover", lambda i: F.get("__tpl", i).isin("<num>", "<name>", "<unit>"))
    low = lambda name, i: F.lower(F.get(name, i))
    both = found.join(items.drop("__low"), "__item").join(texts, "__key").withColumn("__slots", F.transform(slots, lambda i: F.struct(
        F.get("__tpl", i).alias("type"), low("__raw", i).alias("want"), low("__have", i + F.col("shift")).alias("have"))))
    asked = F.size(F.array_distinct(F.transform("__slots", lambda s: F.struct(s["type"], s["want"]))))
    consistent = both.filter(asked == F.size(F.array_distinct("__slots")))
    same = F.forall("__slots", lambda s: s["want"].eqNullSafe(s["have"]))
    best = F.max(F.struct(F.size("cover").alias("matched_tokens"), (-F.col("shift")).alias("__shift"), "item_tokens",
                          F.size("__slots").alias("slots"), same.alias("verbatim"))).alias("m")
    return consistent.groupBy("__key", "doc_id", "__item", "item_id").agg(best).select(
        "__key", "doc_id", "item_id", "m.matched_tokens", "m.item_tokens", "m.slots", "m.verbatim")


def clean(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that match no benchmark item, all columns."""
    own = free_name(docs, "__bad")
    bad = stored(matches(docs, benchmark, doc_id, text).select(F.col("__key").alias(own)).distinct(), "contaminated")
    return docs.withColumn(own, row_key(doc_id, text)).join(bad, own, "left_anti").drop(own)


_UNITS = ", ".join(f"'{u}'" for u in UNITS)


def _sql_side(name: str, table: str, key: str) -> str:
    """Template tokens of a table: one row for each text, with lists ``raw`` and ``tpl``."""
    return rf"""{name}_t AS (SELECT DISTINCT {key} AS id, regexp_extract_all(coalesce(text, ''), '{TOKEN}') AS tok FROM {table}),
{name}_x AS (SELECT id, i, tok[i] AS t, CASE WHEN i > 1 THEN tok[i - 1] END AS b, i > 1 AND lower(tok[i - 1]) <> tok[i - 1] AS p1,
      i > 2 AND lower(tok[i - 2]) <> tok[i - 2] AS p2, coalesce(lower(tok[i + 1]) <> tok[i + 1], FALSE) AS n1,
      coalesce(lower(tok[i + 2]) <> tok[i + 2], FALSE) AS n2 FROM (SELECT id, tok, unnest(range(1, len(tok) + 1)) AS i FROM {name}_t)),
{name}_c AS (SELECT id, i, t, CASE WHEN regexp_matches(t, '^[0-9]') THEN '<num>'
      WHEN lower(t) IN ({_UNITS}) AND regexp_matches(coalesce(b, ''), '^[0-9]') THEN '<unit>'
      WHEN lower(t) <> t AND i > 1 AND b NOT IN ('.', '!', '?', ':', chr(10)) AND regexp_matches(t, '^\p{{Lu}}\p{{Ll}}')
           AND NOT ((p1 AND (n1 OR p2)) OR (n1 AND n2)) THEN '<name>'
      ELSE lower(t) END AS c FROM {name}_x WHERE t NOT IN ('.', '!', '?', ':', chr(10))),
{name} AS (SELECT id, list(t ORDER BY i) AS raw, list(lower(t) ORDER BY i) AS low, list(c ORDER BY i) AS tpl FROM {name}_c GROUP BY id),
{name}_w AS (SELECT id, i - 1 AS pos, array_to_string(p, ' ') AS h, p AS parts
      FROM (SELECT id, i, unnest([tpl[i:i + {WINDOW - 1}], low[i:i + {WINDOW - 1}]]) AS p
            FROM (SELECT id, tpl, low, unnest(range(1, len(tpl) - {WINDOW - 2})) AS i FROM {name} WHERE len(tpl) >= {WINDOW})) GROUP BY ALL)"""


SQL = rf"""
WITH {_sql_side('d', 'documents', 'doc_id')},
{_sql_side('b', 'benchmark', 'item_id')},
own AS (SELECT id, pos, h FROM b_w WHERE len([x FOR x IN parts IF x[1] <> '<']) >= {MIN_LITERALS}),
brief AS (SELECT id, len(low) AS n, array_to_string(low, ' ') AS h FROM b WHERE len(low) >= {MIN_ITEM} AND len(low) < {WINDOW}),
d_s AS (SELECT id, i - 1 AS pos, n, array_to_string(low[i:i + n - 1], ' ') AS h
        FROM (SELECT id, low, n, unnest(range(1, len(low) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM brief) WHERE len(low) >= n)),
hit AS (SELECT d_w.id AS doc_id, own.id AS item_id, d_w.pos - own.pos AS shift, own.pos, {WINDOW} AS n FROM d_w JOIN own USING (h)
        UNION ALL SELECT d_s.id, brief.id, d_s.pos, 0, n FROM d_s JOIN brief USING (n, h)),
cov AS (SELECT DISTINCT doc_id, item_id, shift, unnest(range(pos, pos + n)) AS p FROM hit),
grp AS (SELECT doc_id, item_id, shift, count(*) AS n, list(p) AS cover FROM cov GROUP BY ALL),
cand AS (SELECT grp.*, len(b.tpl) AS item_tokens, b.raw AS want, b.tpl, d.raw AS have
         FROM grp JOIN b ON b.id = item_id JOIN d ON d.id = doc_id WHERE n >= CASE WHEN len(b.tpl) > {WINDOW} THEN least({MIN_TOKENS}, len(b.tpl) - 1) ELSE len(b.tpl) END),
slot AS (SELECT doc_id, item_id, shift, n, item_tokens, tpl[p + 1] AS kind, lower(want[p + 1]) AS w, lower(have[p + 1 + shift]) AS h
         FROM (SELECT *, unnest(cover) AS p FROM cand)),
ok AS (SELECT doc_id, item_id, shift, n, item_tokens, count(*) FILTER (kind IN ('<num>', '<name>', '<unit>')) AS slots,
              count(DISTINCT kind || ' ' || w) FILTER (kind IN ('<num>', '<name>', '<unit>')) AS asked,
              count(DISTINCT kind || ' ' || w || ' ' || h) FILTER (kind IN ('<num>', '<name>', '<unit>')) AS given,
              bool_and(w = h OR kind NOT IN ('<num>', '<name>', '<unit>')) AS verbatim FROM slot GROUP BY ALL)
SELECT doc_id, item_id, n::INTEGER AS matched_tokens, item_tokens::INTEGER AS item_tokens, slots::INTEGER AS slots, verbatim
FROM ok WHERE asked = given QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n DESC, shift) = 1
"""

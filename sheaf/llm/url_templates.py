"""URL filter: path-template trees for each host, on top of host and path rules.

Level by level, every node of a host's tree keeps as literals the segments that at least ``min_count`` urls and a
share ``min_share`` of the node's urls have (so at most ``1 / min_share`` children each); all other segments are
generalised into the wildcards ``{num}`` (digits, with the extension if any) and ``{any}``.  Templates of a host that
differ in literals only are branches side by side: put in order of labelled rate, neighbours whose rates a two-
proportion test cannot tell apart are merged.  A merged template is rejected when its smoothed purity,
``(bad + s * prior) / (labelled + s)``, is high.  Its prior is the purity of what it belongs to, smoothed in the same
way step by step: the corpus, the registered domain, the host, and the same template on all hosts.  A template with
few labels or none so falls back on similar ones, however small the labelled share of its own urls is.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.llm.shared import stored

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    action: str  # block or allow
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


class Settings(NamedTuple):
    max_depth: int = 6  # levels of the tree; what lies deeper is one wildcard
    min_count: int = 5
    min_share: float = 0.02
    max_z: float = 1.96  # branches closer than this are merged
    smoothing: float = 4.0
    min_purity: float = 0.8


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def ranked(rules: list[Rule]) -> list[Rule]:
    return sorted(rules, key=lambda r: (-len(r.text), r.text))


def rule_of(rules: list[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """Text and action of the longest rule that fits: its host or a subdomain, and a path that starts with its own."""
    text, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in reversed(ranked(rules)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text, action = F.when(fits, r.text).otherwise(text), F.when(fits, r.action).otherwise(action)
    return text, action


def domain_of(host: Column) -> Column:
    """The registered domain: the last two names of a host, or all of a shorter one."""
    found = F.regexp_extract(host, r"[^.]+[.][^.]+$", 0)
    return F.when(found == "", host).otherwise(found)


def wildcard(segment: Column) -> Column:
    return F.when(segment.rlike(r"^[0-9]+(\.[A-Za-z]+)?$"),
                  F.concat(F.lit("{num}"), F.regexp_extract(segment, r"(\.[A-Za-z]+)?$", 0))).otherwise("{any}")


def templates(urls: DataFrame, s: Settings) -> DataFrame:
    """``urls`` (with ``__host``, ``__segments``) with ``__node``, the url's template in its host's tree, and
    ``__shape``, the same with ``{lit}`` for each literal."""
    now = urls.withColumn("__node", F.lit("")).withColumn("__shape", F.lit(""))
    keys = ["__host", "__node"]
    for level in range(1, s.max_depth + 1):
        now = stored(now.withColumn("__seg", F.get("__segments", F.lit(level - 1))), "level")
        child = now.filter(F.col("__seg").isNotNull()).groupBy(*keys, "__seg").agg(F.count("*").alias("__n"))
        child = stored(child, "children")
        total = child.groupBy(*keys).agg(F.sum("__n").alias("__total"))
        literal = child.join(total, keys).filter(
            (F.col("__n") >= s.min_count) & (F.col("__n") >= s.min_share * F.col("__total"))).select(*keys, "__seg", F.lit(True).alias("__lit"))
        step = F.when(F.col("__seg").isNull(), "")
        wild = F.concat(F.lit("/"), wildcard(F.col("__seg")))
        now = now.join(literal, [*keys, "__seg"], "left").withColumn(
            "__shape", F.concat("__shape", step.when(F.col("__lit"), "/{lit}").otherwise(wild))).withColumn(
            "__node", F.concat("__node", step.when(F.col("__lit"), F.concat(F.lit("/"), "__seg")).otherwise(wild))).drop("__seg", "__lit")
    deeper = F.when(F.size("__segments") > s.max_depth, "/**").otherwise("")
    return stored(now.withColumn("__node", F.concat("__node", deeper)).withColumn("__shape", F.concat("__shape", deeper)), "urls")


def merged(found: DataFrame, s: Settings) -> DataFrame:
    """Merge side-by-side branches and judge them: ``__host, __node, template_group, purity, rejected`` of each template."""
    keys = ["__host", "__shape"]
    leaf = found.groupBy(*keys, "__node").agg(F.count("*").alias("n"), F.count("__label").alias("labelled"),
                                              F.coalesce(F.sum("__label"), F.lit(0)).alias("bad"))
    leaf = stored(leaf, "templates")
    whole = leaf.agg(F.sum("bad").alias("bad"), F.sum("labelled").alias("labelled")).first()
    prior = (whole["bad"] or 0) / whole["labelled"] if whole["labelled"] else 0.0
    leaf = leaf.withColumn("domain", domain_of(F.col("__host"))).withColumn("prior", F.lit(prior))
    for of in ("domain", "__host", "__node"):  # one row a domain, a host, a template: sums are added before they are sent
        known = leaf.groupBy(of).agg(F.sum("bad").alias("b"), F.sum("labelled").alias("l"))
        leaf = leaf.join(known, of).withColumn("prior", (F.col("b") + s.smoothing * F.col("prior")) / (F.col("l") + s.smoothing)).drop("b", "l")
    rate = (F.col("bad") + 1.0) / (F.col("labelled") + 2.0)
    leaf = leaf.withColumn("rate", rate).withColumn("some", F.col("labelled") > 0)
    order = Window.partitionBy(*keys, "some").orderBy("rate", "__node")  # at most the literals of one host's shape
    before, size = F.lag("rate").over(order), F.lag("labelled").over(order)
    mean = (F.col("rate") + before) / 2
    apart = F.abs(F.col("rate") - before) >= s.max_z * F.sqrt(mean * (1 - mean) * (1.0 / F.col("labelled") + 1.0 / size))
    new = F.when(before.isNull() | ~F.col("some") | apart, 1).otherwise(0)
    leaf = leaf.withColumn("new", new).withColumn("group", F.sum("new").over(order))
    group = Window.partitionBy(*keys, "some", "group")
    labelled, bad = (F.sum(c).over(group) for c in ("labelled", "bad"))
    purity = (bad + s.smoothing * F.min("prior").over(group)) / (labelled + s.smoothing)
    return leaf.select("__host", "__node", F.min("__node").over(group).alias("template_group"), purity.alias("purity"),
                       (purity >= s.min_purity).alias("rejected"))


def judge(pages: DataFrame, rules: list[Rule], settings: Settings = Settings(), page_id: str = "page_id",
          url: str = "url", label: str | None = None) -> DataFrame:
    """One row per row of ``pages``: ``page_id, host, path, rule, verdict, template, template_group, purity``.

    ``verdict`` is the action of the longest rule that fits; elsewhere ``block`` if the url's template is rejected,
    else ``allow``.  Urls are labelled by the column ``label`` (1 bad, 0 good, null unknown); without it by the rules,
    1 where one blocks and 0 where one allows.  A null url, or one without ``://``, has empty host and path and is
    judged with all others of that kind.  Repeated rows each get a row; an empty table gives none.
    """
    host, path = split_url(F.col(url))
    rows = pages.select(F.col(page_id).alias("page_id"), host.alias("__host"), path.alias("path"),
                        (F.col(label) if label else F.lit(None)).cast("int").alias("__label"))
    text, action = rule_of(rules, F.col("__host"), F.col("path"))
    rows = rows.withColumn("rule", text).withColumn("__action", action)
    if not label:
        rows = rows.withColumn("__label", F.when(F.col("__action") == "block", 1).when(F.col("__action") == "allow", 0))
    rows = rows.withColumn("__segments", F.filter(F.split("path", "/"), lambda x: x != ""))
    found = templates(rows, settings)
    judged = found.join(merged(found, settings), ["__host", "__node"])
    own = F.when(F.col("rejected"), "block").otherwise("allow")
    return judged.select("page_id", F.col("__host").alias("host"), "path", "rule", F.coalesce("__action", own).alias("verdict"),
                         F.col("__node").alias("template"), "template_group", "purity")


def sql(rules: list[Rule], s: Settings = Settings()) -> str:
    """The same over table ``pages``, in SQL."""
    cases = {kind: "CASE " + " ".join(
        f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{getattr(r, kind)}'"
        for r in ranked(rules)) + " END" for kind in ("text", "action")}
    out = [f"""WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
p AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}'), '') AS host,
             coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
l0 AS (SELECT *, CASE action WHEN 'block' THEN 1 WHEN 'allow' THEN 0 END AS label, '' AS node, '' AS shape,
              [x FOR x IN string_split(path, '/') IF x <> ''] AS segs
       FROM (SELECT *, {cases['text']} AS rule, {cases['action']} AS action FROM p))"""]
    for k in range(1, s.max_depth + 1):
        wild = "'/' || CASE WHEN regexp_matches(seg, '^[0-9]+([.][A-Za-z]+)?$') THEN '{num}' || regexp_extract(seg, '([.][A-Za-z]+)?$') ELSE '{any}' END"
        out.append(f"""s{k} AS (SELECT *, segs[{k}] AS seg FROM l{k - 1}),
c{k} AS (SELECT host, node, seg, count(*) AS n FROM s{k} WHERE seg IS NOT NULL GROUP BY ALL),
k{k} AS (SELECT host, node, seg FROM (SELECT *, sum(n) OVER (PARTITION BY host, node) AS total FROM c{k})
         WHERE n >= {s.min_count} AND n >= {s.min_share} * total),
l{k} AS (SELECT page_id, s.host, path, rule, action, label, segs,
                s.node || CASE WHEN s.seg IS NULL THEN '' WHEN k.seg IS NOT NULL THEN '/' || s.seg ELSE {wild.replace('seg', 's.seg')} END AS node,
                shape || CASE WHEN s.seg IS NULL THEN '' WHEN k.seg IS NOT NULL THEN '/{{lit}}' ELSE {wild.replace('seg', 's.seg')} END AS shape
         FROM s{k} s LEFT JOIN k{k} k ON s.host = k.host AND s.node = k.node AND s.seg = k.seg)""")
    out.append(f"""f AS (SELECT * EXCLUDE (node, shape), node || deep AS node, shape || deep AS shape
      FROM (SELECT *, CASE WHEN len(segs) > {s.max_depth} THEN '/**' ELSE '' END AS deep FROM l{s.max_depth})),
t AS (SELECT host, shape, node, count(*) AS n, count(label) AS labelled, coalesce(sum(label), 0) AS bad FROM f GROUP BY ALL),
w AS (SELECT coalesce(sum(bad) / nullif(sum(labelled), 0), 0) AS prior FROM t),
m AS (SELECT t.*, CASE WHEN regexp_matches(host, '[^.]+[.][^.]+$') THEN regexp_extract(host, '[^.]+[.][^.]+$') ELSE host END AS domain FROM t),
m1 AS (SELECT m.*, (sum(bad) OVER (PARTITION BY domain) + {s.smoothing}::DOUBLE * prior) / (sum(labelled) OVER (PARTITION BY domain) + {s.smoothing}::DOUBLE) AS p1 FROM m, w),
m2 AS (SELECT *, (sum(bad) OVER (PARTITION BY host) + {s.smoothing}::DOUBLE * p1) / (sum(labelled) OVER (PARTITION BY host) + {s.smoothing}::DOUBLE) AS p2 FROM m1),
m3 AS (SELECT *, (sum(bad) OVER (PARTITION BY node) + {s.smoothing}::DOUBLE * p2) / (sum(labelled) OVER (PARTITION BY node) + {s.smoothing}::DOUBLE) AS p3 FROM m2),
r AS (SELECT *, (bad + 1.0::DOUBLE) / (labelled + 2.0::DOUBLE) AS rate, labelled > 0 AS known FROM m3),
b AS (SELECT *, lag(rate) OVER o AS r0, lag(labelled) OVER o AS l0 FROM r WINDOW o AS (PARTITION BY host, shape, known ORDER BY rate, node)),
n AS (SELECT *, CASE WHEN r0 IS NULL OR NOT known OR abs(rate - r0) >= {s.max_z}::DOUBLE *
             sqrt((rate + r0) / 2 * (1 - (rate + r0) / 2) * (1.0::DOUBLE / labelled + 1.0::DOUBLE / l0)) THEN 1 ELSE 0 END AS new FROM b),
g AS (SELECT *, sum(new) OVER (PARTITION BY host, shape, known ORDER BY rate, node) AS grp FROM n),
v AS (SELECT host, node, min(node) OVER e AS template_group,
             (sum(bad) OVER e + {s.smoothing}::DOUBLE * min(p3) OVER e) / (sum(labelled) OVER e + {s.smoothing}::DOUBLE) AS purity
      FROM g WINDOW e AS (PARTITION BY host, shape, known, grp))
SELECT page_id, f.host, path, rule, coalesce(action, CASE WHEN purity >= {s.min_purity} THEN 'block' ELSE 'allow' END) AS verdict,
       f.node AS template, template_group, purity
FROM f JOIN v ON f.host = v.host AND f.node = v.node""")
    return ",\n".join(out)

"""Stand-in inputs derived from the given test tables (FIXTURES.md part 2).

These builders only *shape* existing rows into the schemas the operators take
(``files``, ``picks``, ``profiles``, ``changes``, ``samples`` ...).  They do none
of the operators' work; every operator runs on whatever rows arrive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.functions.patterns import DEFAULT_PATTERNS
from sheaf.sources.tables import table

# ---------------------------------------------------------------------------
# Fixed values of the fixture layout (FIXTURES.md 2.1 / 2.2).
TOP_DIRS = ["src", "tests", "docs", "node_modules", ".cache", "_gen", "Src", "lib"]
FILE_EXTS = [".rs", ".py", ".js", ".md", ".TXT", ".tar.gz", ""]
ROOT_PROFILES = {"src0": [".*", "node_modules"], "src1": [], "src2": ["*.rs", "d?c_1*"]}
CHANGE_KINDS = {"click": "modify", "signup": "create", "purchase": "remove", "error": "error", "view": "access"}
ALERT_TTL_SECONDS = {"error": 4, "purchase": 3}  # others: 2; scaled to minutes in the fixture
SEL_OPS = {"click": "push", "view": "push", "signup": "push", "purchase": "undo", "error": "redo"}
# ---------------------------------------------------------------------------


def _div(c, k):
    return F.floor(c / k).cast("bigint")


def files(spark: SparkSession, sf_dir: str, with_doc_id: bool = False) -> DataFrame:
    """``files(root_id, rel_path, content)``: one file per document."""
    d = table(spark, sf_dir, "documents")
    doc = F.col("doc_id")
    top = F.element_at(F.array(*map(F.lit, TOP_DIRS)), (_div(doc, 20) % 8 + 1).cast("int"))
    ext = F.element_at(F.array(*map(F.lit, FILE_EXTS)), (_div(doc, 20) % 7 + 1).cast("int"))
    rel = F.concat(top, F.lit("/"), F.col("lang"), F.lit("/"),
                   F.when(doc % 11 == 0, F.lit(".")).otherwise(F.lit("")),
                   F.when(doc % 13 == 0, F.lit("Doc_")).otherwise(F.lit("doc_")),
                   doc.cast("string"), ext)
    cols = [F.col("source").alias("root_id"), rel.alias("rel_path"), F.col("text").alias("content")]
    if with_doc_id:
        cols.append(doc)
    return d.select(*cols)


def picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Explicit user picks ``(root_id, rel_path)``: files with quality 1, and ``tests`` of even roots."""
    f = files(spark, sf_dir, with_doc_id=True).select("root_id", "rel_path", "doc_id")
    good = table(spark, sf_dir, "labels").filter(F.col("quality") == 1).select("doc_id")
    file_picks = f.join(good, "doc_id", "left_semi").select("root_id", "rel_path")
    roots = f.select("root_id").distinct()
    dir_picks = (roots.filter(F.regexp_extract("root_id", r"(\d+)$", 1).cast("int") % 2 == 0)
                 .select("root_id", F.lit("tests").alias("rel_path")))
    return file_picks.unionByName(dir_picks)


PROFILE_SCHEMA = T.StructType([
    T.StructField("root_id", T.StringType()), T.StructField("ord", T.IntegerType()),
    T.StructField("pattern", T.StringType()),
])


_PROFILES: dict = {}


def profiles(spark: SparkSession) -> DataFrame:
    """Ignore policy rows; ``root_id`` NULL = global; a NULL pattern marks an empty profile.

    One DataFrame per session, so policy resolution is done once.
    """
    key = spark.sparkContext.applicationId
    if key not in _PROFILES:
        rows = [(None, i, p) for i, p in enumerate(DEFAULT_PATTERNS)]
        for root, pats in ROOT_PROFILES.items():
            rows += [(root, i, p) for i, p in enumerate(pats)] or [(root, 0, None)]
        _PROFILES[key] = spark.createDataFrame(rows, PROFILE_SCHEMA)
    return _PROFILES[key]


def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages as files: host = root, URL path (no query/fragment) = rel path.

    Static-site layout, one file a page: ``/a/b`` of page 7 is ``a/b~7.html`` and
    ``/a/b/`` (or the empty path) ``a/b/index~7.html``, so all pages of a URL
    stay and no path is a file and a directory at once.
    """
    p = table(spark, sf_dir, "pages")
    host = F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1)
    path = F.regexp_extract("url", r"^[a-z]+://[^/?#]+/?([^?#]*)", 1)
    index = F.when((path == "") | path.endswith("/"), "index").otherwise("")
    rel = F.concat(path, index, F.lit("~"), F.col("page_id").cast("string"), F.lit(".html"))
    return p.select(host.alias("root_id"), rel.alias("rel_path"), F.col("html").alias("content"), "page_id")


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as roots: ``{turn}_{role}.md`` files."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.concat(F.lit("conv"), F.col("conv_id").cast("string")).alias("root_id"),
                    F.concat(F.col("turn").cast("string"), F.lit("_"), F.col("role"), F.lit(".md")).alias("rel_path"),
                    F.col("text").alias("content"))


def hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region/nation/customer/order/line paths; leaf picked iff returnflag = 'R'."""
    r = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey", "n_name")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    # the path down to an order is made once an order; lines, the largest table, are joined and moved once
    owner = (o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey))
    owner = owner.select("o_orderkey", "r_name", F.concat_ws("/", F.col("n_name"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")),
                                                            F.concat(F.lit("o"), F.col("o_orderkey").cast("string"))).alias("_order"))
    rel = F.concat_ws("/", F.col("_order"), F.concat(F.lit("l"), F.col("l_linenumber").cast("string")))
    return li.join(owner, li.l_orderkey == owner.o_orderkey).select(
        F.col("r_name").alias("root_id"), rel.alias("rel_path"), (F.col("l_returnflag") == "R").alias("picked"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with ``ts`` as a real TIMESTAMP (the files store TIMESTAMP_NTZ)."""
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change feed ``(root_id, ts, kind, path, message, event_id)``."""
    e = events(spark, sf_dir)
    kind = F.try_element_at(F.create_map(*[F.lit(x) for kv in CHANGE_KINDS.items() for x in kv]), F.col("event_type"))
    k = F.get_json_object("props", "$.k")
    return e.select(
        (F.col("user_id") % 10).cast("string").alias("root_id"), "ts", kind.alias("kind"),
        F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("/k"), k).alias("path"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("watch error "), F.col("event_id").cast("string")))
        .alias("message"),
        "event_id")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latency samples per user: ``(key, ts, ts_us, elapsed, budget)``."""
    e = events(spark, sf_dir)
    return e.select(F.col("user_id").alias("key"), "ts", F.unix_micros("ts").alias("ts_us"),
                    F.col("value").alias("elapsed"), F.lit(10.0).alias("budget"), "event_id")


def sel_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selection history ops per session: push(paths) / undo / redo."""
    e = events(spark, sf_dir)
    op = F.try_element_at(F.create_map(*[F.lit(x) for kv in SEL_OPS.items() for x in kv]), F.col("event_type"))
    path = F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("/k"), F.get_json_object("props", "$.k"))
    return e.select(F.col("user_id").alias("session_id"), "ts", "event_id", op.alias("op"),
                    F.when(op == "push", F.array(path)).otherwise(F.array().cast("array<string>")).alias("paths"))

"""Registered queries, part 3: change feeds (A8, J1-J8, D13), workflows (L1-L13), A5/A7/A9."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from sheaf.functions import classify as C
from sheaf.functions.patterns import component_regex
from sheaf.operators import entries as EN
from sheaf.operators import pack as PK
from sheaf.operators import render as R
from sheaf.operators import search as SR
from sheaf.operators.projects import project_profiles
from sheaf.plans.ordered import ordered_scan
from sheaf.plans.queries import contents, corpus_entries, query, selected
from sheaf.session import ensure_checkpoint_dir
from sheaf.sources import fixtures as FX
from sheaf.sources.policy import parse_policies
from sheaf.streaming import changes as CH

# ---------------------------------------------------------------------------
# Fixed query parameters of the registered runs.
BATCH_GAP = "1 hour"               # fixture gap (the 500 ms throttle never binds on this data)
BATCH_GAP_US = 3_600_000_000
ALERT_TTL_MIN = {"error": 4, "warning": 3, "success": 2}   # reference TTL seconds, scaled to minutes
CONTENT_PATTERN = "[0-9]{3}-[0-9]{4}"
INCLUDE_GLOBS = ["*.{rs,py}", "Doc_*"]
MAX_FILE_BYTES = 4096
MAX_FILES = 10
SUGGESTIONS = 10
SHARE_BUDGET = 20000
SHARES = {"code": 0.6, "tests": 0.2, "docs": 0.2}
# ---------------------------------------------------------------------------


def _ntz(c: str):
    """Report timestamps as wall-clock TIMESTAMP_NTZ, as stored: independent of the session time zone."""
    return F.col(c).cast("timestamp_ntz").alias(c)


def _accepted(spark, sf):
    return CH.accepted(FX.changes(spark, sf))


def _batches(spark, sf):
    return CH.sessionize(_accepted(spark, sf), BATCH_GAP)


@query("changes_source")
def q_changes_source(spark, sf):
    """The change feed with only modify/create/remove (and watcher errors) kept."""
    return _accepted(spark, sf).select("root_id", _ntz("ts"), "kind", "path", "event_id")


@query("change_batches")
def q_change_batches(spark, sf):
    """Bursts per root separated by silences >= the gap, with their counts."""
    return CH.batch_summary(_batches(spark, sf)).select(
        "root_id", _ntz("batch_start"), _ntz("batch_last"), "n_events", "n_paths", "n_errors", "outcome")


@query("change_message")
def q_change_message(spark, sf):
    """D13: '1 file changed…' / 'N files changed…' per error-free batch."""
    return CH.batch_summary(_batches(spark, sf)).filter(F.col("outcome") == "changed").select(
        "root_id", _ntz("batch_start"), "message")


@query("distinct_changed_paths")
def q_distinct_changed_paths(spark, sf):
    """Sorted, de-duplicated changed paths per root (rows)."""
    return (FX.changes(spark, sf).filter(F.col("kind").isin(*CH.KEPT_KINDS))
            .select("root_id", "path").distinct())


@query("change_throttle")
def q_change_throttle(spark, sf):
    """Events that get reported by the leading-edge throttle (others are lost)."""
    from sheaf.plans.chains import throttle_reports
    acc = _accepted(spark, sf)
    rep = throttle_reports(acc.select("root_id", "event_id", F.unix_micros("ts").alias("_us")), BATCH_GAP_US)
    return acc.join(rep, ["root_id", "event_id"], "left_semi").select("root_id", "event_id", _ntz("ts"))


@query("error_priority")
def q_error_priority(spark, sf):
    """A batch with errors reports only 'Watcher error: ' + its errors in order."""
    return CH.error_items(_batches(spark, sf))


@query("dirty_flag")
def q_dirty_flag(spark, sf):
    """Per root, is the latest change newer than the latest generation?"""
    return CH.dirty_flags(_accepted(spark, sf)).select("root_id", _ntz("last_change"), _ntz("last_gen"), "dirty")


@query("progress_stream")
def q_progress_stream(spark, sf):
    """Progress events per root and stage."""
    return CH.progress_summary(CH.progress_events(selected(spark, sf)))


def _alerts(spark, sf):
    e = FX.events(spark, sf)
    sev = (F.when(F.col("event_type") == "error", F.lit("error"))
           .when(F.col("event_type") == "purchase", F.lit("warning")).otherwise(F.lit("success")))
    ttl = F.create_map(*[x for k, v in ALERT_TTL_MIN.items() for x in (F.lit(k), F.lit(v * 60_000_000))])
    return e.select((F.col("user_id") % 10).alias("key"), "ts", "event_id", sev.alias("severity")).withColumn(
        "ttl_us", F.try_element_at(ttl, F.col("severity")).cast("bigint"))


@query("active_alerts")
def q_active_alerts(spark, sf):
    """Each alert's display time: its TTL unless a newer alert replaces it first."""
    return CH.alert_timeline(_alerts(spark, sf))


@query("alerts_at")
def q_alerts_at(spark, sf):
    """What is shown when the last event of the log arrives."""
    return CH.alerts_at(_alerts(spark, sf))


@query("job_state")
def q_job_state(spark, sf):
    """Per job the last state (generating / ready / cancelled); errors don't change it."""
    e = FX.events(spark, sf)
    st = (F.when(F.col("event_type") == "click", "generating").when(F.col("event_type") == "purchase", "ready")
          .when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "cancelled"))
    ev = e.select(F.col("user_id").alias("job_id"), "ts", "event_id", st.alias("state")).filter(
        F.col("state").isNotNull())
    return CH.job_states(ev)


@query("history_replay")
def q_history_replay(spark, sf):
    """undo/redo replay with 20-deep stacks, distributed."""
    from sheaf.plans.history import replay
    return replay(FX.sel_ops(spark, sf))


# ---------------------------------------------------------------- 2L workflows
def _doc_items(spark, sf):
    """Selected files with document position and char-token estimate."""
    sel = selected(spark, sf).select("root_id", "rel_path", "is_dir", "ext")
    pos = R.preorder(sel, ci=True, pos="seq")
    c = contents(spark, sf).filter(F.col("error").isNull()).select("root_id", "rel_path", C.tokens_from_chars("content").alias("tokens"))
    return pos.join(c, ["root_id", "rel_path"])


@query("pack_by_budget")
def q_pack_by_budget(spark, sf):
    """L1: greedy next-fit of each root's files into sessions of <= 8000 tokens."""
    return PK.pack_next_fit(_doc_items(spark, sf).select("root_id", "seq", "tokens"), PK.SESSION_BUDGET)


@query("budget_shares")
def q_budget_shares(spark, sf):
    """L2: 60 % code / 20 % tests / 20 % docs of a 20k budget, filled in document order."""
    it = _doc_items(spark, sf)
    cat = C.file_category("ext")
    cls = (F.when(F.col("rel_path").startswith("tests/"), F.lit("tests"))
           .when(cat == "Code", F.lit("code")).when(cat == "Document", F.lit("docs")).otherwise(F.lit("other")))
    return PK.budget_shares(it.withColumn("cls", cls), SHARE_BUDGET, SHARES).select(
        "root_id", "cls", "seq", "tokens", "running", "cap")


@query("model_fit")
def q_model_fit(spark, sf):
    """L3: which context limits each root's Markdown document fits."""
    from sheaf.plans.queries import q_output_tokens
    return PK.model_fit(q_output_tokens(spark, sf)).select("root_id", "model", "fits")


def _versions(spark, sf):
    """Documents as versions of a path: key (source, lang), version order doc_id."""
    d = FX.table(spark, sf, "documents")
    return d.select(F.col("source").alias("root_id"), F.concat(F.col("lang"), F.lit(".md")).alias("path"),
                    "doc_id", F.col("text").alias("content"))


def _latest_two(spark, sf):
    """The two newest versions of each path by id and content hash; the texts stay where they are."""
    v = _versions(spark, sf).withColumn("_h", F.xxhash64("content")).drop("content")
    w = Window.partitionBy("root_id", "path").orderBy(F.col("doc_id").desc())
    return v.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= 2)


def _sections(spark, sf):
    """Status of each path by the hashes of its two newest versions, and the newest version's id."""
    pair = _latest_two(spark, sf).groupBy("root_id", "path").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("_h").alias("kinds"), F.max("doc_id").alias("doc_id"))
    status = F.when(F.col("n") == 1, "added").when(F.col("kinds") == 1, "unchanged").otherwise("changed")
    return pair.select("root_id", "path", "doc_id", status.alias("status"))


@query("changed_sections")
def q_changed_sections(spark, sf):
    """Latest vs previous version per path by content hash (a path's newest row has no newer version to lack)."""
    return _sections(spark, sf).select("root_id", "path", "status")


@query("changed_files_prompt")
def q_changed_files_prompt(spark, sf):
    """L4: Markdown fragments of the latest version of changed or added paths only."""
    ch = _sections(spark, sf).filter(F.col("status").isin("changed", "added")).select("doc_id")
    latest = _versions(spark, sf).join(ch, "doc_id", "left_semi")  # at most one id a path; AQE broadcasts them when small
    return latest.select("root_id", "path", R.file_fragment("markdown", F.col("path"), F.col("content"),
                                                           F.lit("md")).alias("fragment"))


@query("content_search")
def q_content_search(spark, sf):
    """Regex search in contents."""
    return SR.content_search(FX.files(spark, sf), CONTENT_PATTERN).select(
        "root_id", "rel_path", "n_matches", "first_match")


@query("multi_root_prompt")
def q_multi_root_prompt(spark, sf):
    """All conversations in one document: roots in order, files in tree order."""
    t = FX.transcripts(spark, sf).select("root_id", "rel_path", F.length("content").cast("bigint").alias("n_chars"),
                                         R.sort_key("rel_path", F.lit(False), True).alias("_sk"))
    t = t.withColumn("_all", F.lit(0))
    return ordered_scan(t, ["_all"], ["root_id", "_sk"], pos="doc_pos").select("doc_pos", "root_id", "rel_path",
                                                                               "n_chars")


@query("multi_root_document")
def q_multi_root_document(spark, sf):
    """The combined document of all conversations: each root's header, tree and files as rows."""
    t = FX.transcripts(spark, sf)
    e = EN.derive_entries(t)
    frags = R.fragments(EN.files_only(e), EN.corpus_contents(t), "markdown", tree=R.tree_lines(e, patterns=[]))
    return frags.select("root_id", "section", "seq", "fragment")


@query("incremental_tokens")
def q_incremental_tokens(spark, sf):
    """Token delta to the previous version of the same path, and the running delta."""
    v = _versions(spark, sf).select("root_id", "path", "doc_id", C.tokens_from_chars("content").alias("tokens"))
    x = ordered_scan(v, ["root_id", "path"], ["doc_id"], lag={"_prev": "tokens"})
    first = x.groupBy("root_id", "path").agg(F.min_by("tokens", "doc_id").alias("_first"))
    return x.join(first, ["root_id", "path"]).select(
        "root_id", "path", "doc_id", "tokens", (F.col("tokens") - F.col("_prev")).alias("delta"),
        (F.col("tokens") - F.col("_first")).alias("running_delta"))


@query("project_profiles")
def q_project_profiles(spark, sf):
    """Project type per root (marker file, else most files of a known kind) and its ignore preset."""
    return project_profiles(corpus_entries(spark, sf)).withColumn("ord", F.col("ord").cast("bigint"))


@query("include_patterns")
def q_include_patterns(spark, sf):
    """Files whose name matches an include glob (braces expanded)."""
    rx = component_regex(INCLUDE_GLOBS, braces=True).regex
    f = EN.files_only(corpus_entries(spark, sf))
    return f.filter(F.concat(F.lit("/"), F.col("name"), F.lit("/")).rlike(rx)).select("root_id", "rel_path")


@query("max_file_size")
def q_max_file_size(spark, sf):
    """Selected files up to 4 KiB, at most 10 per root in document order (the cap is the feature)."""
    sel = selected(spark, sf).filter(F.col("size") <= MAX_FILE_BYTES).withColumn(
        "_sk", R.sort_key("rel_path", "is_dir", True))
    w = Window.partitionBy("root_id").orderBy("_sk")
    return sel.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= MAX_FILES).select(
        "root_id", "rel_path", "size", F.col("rank").cast("bigint").alias("rank"))


@query("pattern_suggestions")
def q_pattern_suggestions(spark, sf):
    """Directory names holding the most byte-tokens (top 10) -- ignore candidates."""
    f = EN.files_only(corpus_entries(spark, sf))
    comps = F.slice(F.split("rel_path", "/"), 1, F.size(F.split("rel_path", "/")) - 1)
    x = f.select(F.explode(F.array_distinct(comps)).alias("component"), C.tokens_from_bytes("size").alias("t"))
    a = x.groupBy("component").agg(F.sum("t").cast("bigint").alias("tokens"), F.count(F.lit(1)).alias("n_files"))
    return a.orderBy(F.col("tokens").desc(), F.col("component")).limit(SUGGESTIONS)


@query("render_audit")
def q_render_audit(spark, sf):
    """Per root, files that could break a document."""
    j = EN.files_only(EN.derive_entries(FX.files(spark, sf), keep_content=True)).withColumn(
        "error", F.when(F.col("content").isNull(), F.lit(EN.NOT_FOUND_ERROR)))
    return j.groupBy("root_id").agg(
        F.count(F.when(F.col("name").rlike('[&"<>]'), 1)).alias("special_names"),
        F.count(F.when(F.col("content").contains("```"), 1)).alias("fences"),
        F.count(F.when(F.col("content").contains("]]>"), 1)).alias("cdata_ends"),
        F.count(F.when(C.language_of("ext") == "", 1)).alias("unknown_ext"),
        F.count(F.when(F.col("error").isNotNull(), 1)).alias("read_errors"))


# ---------------------------------------------------------------- A5 / A7 / A9
@query("utf8_errors")
def q_utf8_errors(spark, sf):
    """A5: binary contents validated as UTF-8 (hidden files carry a stray 0xFF byte)."""
    f = FX.files(spark, sf)
    raw = F.col("content").cast("binary")
    bad = F.concat(raw, F.unhex(F.lit("FF41")))
    b = f.select("root_id", "rel_path", F.when(F.col("rel_path").contains("/."), bad).otherwise(raw).alias("content"))
    return EN.decoded(b).select("root_id", "rel_path", "error")


@query("export_prompt")
def q_export_prompt(spark, sf):
    """The Markdown documents written by the export sink to the shared folder; bytes of each as read back."""
    from sheaf.plans.queries import q_assemble_markdown
    out = f"{ensure_checkpoint_dir(spark).rstrip('/')}/export-{uuid.uuid4().hex}"
    R.export(q_assemble_markdown(spark, sf), out)
    files = spark.read.format("binaryFile").load(out).withColumn("root_id", F.col("root_id").cast("string"))
    return files.groupBy("root_id").agg(F.sum("length").cast("bigint").alias("n_bytes")).select(
        "root_id", F.lit("codebase_export.md").alias("file_name"), "n_bytes")


@query("load_profiles")
def q_load_profiles(spark, sf):
    """Saved settings of each root, read by the policy loader; broken or partial ones fall back to the defaults."""
    roots = FX.files(spark, sf).select("root_id").distinct()
    n = F.regexp_extract("root_id", r"(\d+)$", 1).cast("int") % 4
    head = '{"window_width": 1200.0, "window_height": 800.0, "split_position": 0.3, "last_directory": null, "include_tree": true, '
    tail = '"output_format": "xml", "theme": "auto"'
    text = (F.when(n == 0, F.lit("{oops")).when(n == 1, F.lit(head + tail + ', "ignore_patterns": " *.TXT, tests"}'))
            .when(n == 2, F.lit(head + '"ignore_patterns": "*.md"}')).otherwise(F.lit(head + tail + ', "ignore_patterns": ""}')))
    return parse_policies(roots.select("root_id", text.alias("policy"))).withColumn("ord", F.col("ord").cast("bigint"))


# ---------------------------------------------------------------- D14 / D16 / D17
from sheaf.operators import metrics as M  # noqa: E402
from sheaf.operators.rolling import rolling_stats  # noqa: E402


@query("latency_stats")
def q_latency_stats(spark, sf):
    """Per user, rate and p50/p95/p99/max over the newest 120 positive gaps."""
    g = M.last_n(M.event_gaps(FX.samples(spark, sf)), "key", ["ts_us", "event_id"])
    s = M.latency_stats(g)
    return s.select("key", "n_samples", *[F.round(c, 6).alias(c) for c in
                                          ["avg_rate", "p50_ms", "p95_ms", "p99_ms", "max_ms"]])


@query("rolling_latency")
def q_rolling_latency(spark, sf):
    """E5/D14 rolling: at every positive gap of a user, rate and p50/p95/p99/max over the newest 120 up to it."""
    g = M.event_gaps(FX.samples(spark, sf))
    s = rolling_stats(g, "key", ["ts_us", "event_id"], "gap_us")
    return s.select("key", "event_id", "n_samples", *[F.round(c, 6).alias(c) for c in ["avg_rate", "p50_ms", "p95_ms", "p99_ms", "max_ms"]])


@query("budget_breaches")
def q_budget_breaches(spark, sf):
    """Samples whose elapsed time exceeds the budget, with the overrun ratio."""
    b = M.budget_breaches(FX.samples(spark, sf))
    return b.select("key", "event_id", "elapsed", F.round("ratio", 6).alias("ratio"))


@query("metric_growth")
def q_metric_growth(spark, sf):
    """Last minus first sampled size per user (value read as MiB), saturating at 0."""
    s = FX.samples(spark, sf).withColumn("rss", F.round(F.col("elapsed") * 1048576).cast("bigint"))
    g = M.metric_growth(s, "key", "rss", ["ts", "event_id"])
    return g.select("key", F.round("growth_mb", 6).alias("growth_mb"))

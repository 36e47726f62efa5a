"""Change feeds: batching, throttling, dirty flags, progress, alerts, job state.

Every function takes a ``changes(root_id, ts TIMESTAMP, kind, path, message,
event_id)`` frame.  ``*_stream`` variants run on a streaming DataFrame
(watermark + session windows / keyed state); the plain variants are exact
batch twins built from skew-safe ordered scans and partial aggregations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.plans.ordered import Desc, islands, ordered_scan

# ---------------------------------------------------------------------------
# Fixed values of the watcher.
KEPT_KINDS = ["modify", "create", "remove"]      # event kinds the watcher reports
THROTTLE_MS = 500                                # report throttle / debounce
ALERT_TTL_S = {"error": 4, "warning": 3, "success": 2}
MSG_ONE = "1 file changed in the watched directory"
MSG_MANY = "{n} files changed in the watched directory"
MSG_ERROR = "Watcher error: "
# ---------------------------------------------------------------------------

CHANGE_SCHEMA = T.StructType([
    T.StructField("root_id", T.StringType()), T.StructField("ts", T.TimestampType()),
    T.StructField("kind", T.StringType()), T.StructField("path", T.StringType()),
    T.StructField("message", T.StringType()), T.StructField("event_id", T.LongType()),
])


def accepted(changes: DataFrame) -> DataFrame:
    """Keep modify/create/remove and watcher errors; drop the rest (e.g. access)."""
    return changes.filter(F.col("kind").isin(*KEPT_KINDS, "error"))


def read_change_stream(spark, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """A change log directory (parquet files) as a streaming source."""
    r = spark.readStream.schema(CHANGE_SCHEMA)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return accepted(r.parquet(path))


def _gap_us(gap: str) -> int:
    num, unit = gap.split()
    mult = {"milliseconds": 1_000, "seconds": 1_000_000, "minutes": 60_000_000, "hour": 3_600_000_000,
            "hours": 3_600_000_000}[unit]
    return int(float(num) * mult)


def sessionize(changes: DataFrame, gap: str = "1 hour") -> DataFrame:
    """J1 batch twin: ``batch_start`` per event; a new batch when the silence is >= gap.

    Gaps and islands in one skew-safe ordered scan that carries the changes
    along -- equal to ``session_window(ts, gap)``.
    """
    x = changes.withColumn("_us", F.unix_micros("ts"))
    return islands(x, ["root_id"], ["_us", "event_id"], "_us", _gap_us(gap), "batch_id").drop("_us")


def batch_summary(sessionized: DataFrame) -> DataFrame:
    """J1 + J3 + D13: one row per batch; any error hides the batch's changed paths."""
    is_err = F.col("kind") == "error"
    a = sessionized.groupBy("root_id", "batch_id").agg(
        F.min("ts").alias("batch_start"), F.max("ts").alias("batch_last"),
        F.count(F.lit(1)).alias("n_events"),
        F.count_distinct(F.when(~is_err, F.col("path"))).alias("n_paths"),
        F.count(F.when(is_err, 1)).alias("n_errors"))
    return a.select(
        "root_id", "batch_start", "batch_last", "n_events", "n_paths", "n_errors",
        F.when(F.col("n_errors") > 0, F.lit("error")).otherwise(F.lit("changed")).alias("outcome"),
        F.when(F.col("n_errors") > 0, F.lit(None).cast("string"))
        .when(F.col("n_paths") == 1, F.lit(MSG_ONE))
        .otherwise(F.concat(F.col("n_paths").cast("string"), F.lit(MSG_MANY.replace("{n}", ""))))
        .alias("message"))


def error_items(sessionized: DataFrame) -> DataFrame:
    """The error text of each failing batch as ordered rows (seq 0 = prefix)."""
    e = sessionized.filter(F.col("kind") == "error").select("root_id", "batch_id", "ts", "event_id", "message")
    e = ordered_scan(e, ["root_id", "batch_id"], ["ts", "event_id"], pos="seq")
    head = e.select("root_id", "batch_id").distinct().select(
        "root_id", "batch_id", F.lit(0).cast("bigint").alias("seq"), F.lit(MSG_ERROR).alias("item"))
    return head.unionByName(e.select("root_id", "batch_id", "seq", F.col("message").alias("item")))


def _stream_batches(changes: DataFrame, gap: str, watermark: str):
    return changes.withWatermark("ts", watermark).groupBy("root_id", F.session_window("ts", gap).alias("w"))


def change_batches_stream(changes: DataFrame, gap: str = "1 hour", watermark: str = "1 hour") -> DataFrame:
    """J1 streaming: session windows per root under a watermark (append mode emits closed batches).

    The columns of :func:`batch_summary`; a window's state holds the distinct paths of one open batch.
    """
    is_err = F.col("kind") == "error"
    a = _stream_batches(changes, gap, watermark).agg(
        F.max("ts").alias("batch_last"), F.count(F.lit(1)).alias("n_events"),
        F.size(F.collect_set(F.when(~is_err, F.col("path")))).cast("bigint").alias("n_paths"),
        F.count(F.when(is_err, 1)).alias("n_errors"))
    outcome = F.when(F.col("n_errors") > 0, F.lit("error")).otherwise(F.lit("changed"))
    return a.select("root_id", F.col("w.start").alias("batch_start"), "batch_last", "n_events", "n_paths", "n_errors",
                    outcome.alias("outcome"))


def error_items_stream(changes: DataFrame, gap: str = "1 hour", watermark: str = "1 hour") -> DataFrame:
    """J3 streaming: ``(root_id, batch_start, seq, item)`` of every closed batch with errors, as :func:`error_items`."""
    errors = F.array_sort(F.collect_list(F.when(F.col("kind") == "error", F.struct("ts", "event_id", "message"))))
    a = _stream_batches(changes, gap, watermark).agg(errors.alias("e")).filter(F.size("e") > 0)
    items = F.concat(F.array(F.lit(MSG_ERROR)), F.transform("e", lambda x: x["message"]))
    return a.select("root_id", F.col("w.start").alias("batch_start"), F.posexplode(items).alias("seq", "item")).withColumn(
        "seq", F.col("seq").cast("bigint"))


def dirty_flags(changes: DataFrame, gen_kind: str = "create", change_kinds=("modify", "remove")) -> DataFrame:
    """Dirty iff the latest change is newer than the latest generation (partial maxima)."""
    a = changes.groupBy("root_id").agg(
        F.max(F.when(F.col("kind").isin(*change_kinds), F.col("ts"))).alias("last_change"),
        F.max(F.when(F.col("kind") == gen_kind, F.col("ts"))).alias("last_gen"))
    dirty = F.col("last_change").isNotNull() & (F.col("last_gen").isNull() | (F.col("last_change") > F.col("last_gen")))
    return a.withColumn("dirty", dirty)


def dirty_flags_stream(changes: DataFrame, gen_kind: str = "create", change_kinds=("modify", "remove")) -> DataFrame:
    """J4 streaming: the same maxima as a running aggregation (update mode)."""
    return dirty_flags(changes, gen_kind, change_kinds)


def progress_events(selected: DataFrame) -> DataFrame:
    """The worker's progress events per root: scanning 0/N, reading k/N, building 0/1 and 1/1."""
    from sheaf.operators.render import sort_key
    s = selected.select("root_id", "rel_path", sort_key("rel_path", "is_dir", True).alias("_sk"))
    reading = ordered_scan(s, ["root_id"], ["_sk"], pos="current")
    tot = s.groupBy("root_id").agg(F.count(F.lit(1)).alias("total"))
    reading = reading.join(tot, "root_id").select("root_id", F.lit("reading").alias("stage"), "current", "total")
    fixed = [("scanning", 0, None), ("building", 0, 1), ("building", 1, 1)]
    others = tot.select("root_id", F.inline(F.array(*[
        F.struct(F.lit(st).alias("stage"), F.lit(c).cast("bigint").alias("current"),
                 (F.col("total") if t is None else F.lit(t)).cast("bigint").alias("total"))
        for st, c, t in fixed])))
    return others.unionByName(reading.withColumn("current", F.col("current").cast("bigint"))
                              .withColumn("total", F.col("total").cast("bigint")))


def progress_summary(events: DataFrame) -> DataFrame:
    """Per (root, stage) event count and the last position reached."""
    return events.groupBy("root_id", "stage").agg(F.count(F.lit(1)).alias("n_events"),
                                                 F.max("current").alias("max_current"),
                                                 F.max("total").alias("total"))


def progress_stream(events: DataFrame) -> DataFrame:
    """J5 streaming: :func:`progress_summary` as a running aggregation over progress events (complete or update mode)."""
    return progress_summary(events)


def alerts_at(alerts: DataFrame, at_us=None, key: str = "key") -> DataFrame:
    """The alert of each key that is shown at ``at_us`` (default: the time of the last alert), and the time it has left.

    The newest alert up to then replaces all before it; it is shown until its TTL ends.
    """
    a = alerts.select(key, "event_id", "severity", F.unix_micros("ts").alias("_us"), "ttl_us")
    t = a.agg(F.max("_us")).first()[0] if at_us is None else at_us
    if t is None:
        t = 0
    newest = a.filter(F.col("_us") <= t).groupBy(key).agg(F.max(F.struct("_us", "event_id", "severity", "ttl_us")).alias("m"))
    return newest.select(key, "m.event_id", "m.severity", (F.col("m._us") + F.col("m.ttl_us") - t).alias("left_us")).filter(
        F.col("left_us") > 0)


def alerts_stream(alerts: DataFrame, key: str = "key") -> DataFrame:
    """J6 streaming: the newest alert of each key with the time it ends at, as a running maximum (update mode)."""
    m = F.max(F.struct(F.unix_micros("ts").alias("_us"), "event_id", "severity", "ttl_us")).alias("m")
    return alerts.groupBy(key).agg(m).select(key, "m.event_id", "m.severity", (F.col("m._us") + F.col("m.ttl_us")).alias("until_us"))


def alert_timeline(alerts: DataFrame, key: str = "key") -> DataFrame:
    """How long each alert is shown: until its TTL ends or a newer alert replaces it.

    ``alerts(key, ts, event_id, severity, ttl_us)``; the next alert of the key
    comes from a skew-safe descending scan (lag in reverse order = lead).
    """
    a = alerts.select(key, "event_id", "severity", F.unix_micros("ts").alias("_us"), "ttl_us")
    nxt = ordered_scan(a, [key], [Desc("_us"), Desc("event_id")], lag={"_next": "_us"})
    until = F.when(F.col("_next").isNull(), F.col("_us") + F.col("ttl_us")).otherwise(
        F.least(F.col("_us") + F.col("ttl_us"), F.col("_next")))
    return nxt.select(key, "event_id", "severity", (until - F.col("_us")).alias("shown_us"),
                      (F.col("_next").isNotNull() & (F.col("_next") < F.col("_us") + F.col("ttl_us")))
                      .alias("replaced"))


def job_states(events: DataFrame, key: str = "job_id") -> DataFrame:
    """Fold of job events: last non-error state wins, errors counted separately."""
    ordk = F.struct("ts", "event_id")
    return events.groupBy(key).agg(
        F.max_by(F.when(F.col("state") != "error", F.col("state")),
                 F.when(F.col("state") != "error", ordk)).alias("state"),
        F.count(F.when(F.col("state") == "error", 1)).alias("n_errors"))

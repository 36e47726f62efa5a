"""Keyed streams against their batch twins: alerts that end by timers, bounded history, token deltas, late rows, live progress."""

import random
import tempfile
import tracemalloc
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import functions as F

from sheaf.plans import flow_queries as FQ
from sheaf.plans.queries import QUERIES
from sheaf.sources import fixtures as FX
from sheaf.streaming import changes as CH
from sheaf.streaming import monitor as MO
from sheaf.streaming import stateful as ST
from sheaf.streaming.sorted_state import BLOCK, SortedRows
from tests.conftest import SF_SMALL


class FakeState:
    """The state store's calls that ``SortedRows`` makes, with the most bytes it held."""

    def __init__(self):
        self.held = {}

    def getMapState(self, name, key, value):
        return self

    def updateValue(self, key, value):
        self.held[key] = value

    def getValue(self, key):
        return self.held[key]

    def removeKey(self, key):
        del self.held[key]


def test_sorted_rows_merge_runs_block_by_block():
    r = random.Random(1)
    rows = [(r.randrange(50_000), i, f"p{i}") for i in range(25_000)]
    state = FakeState()
    frames = [pd.DataFrame(rows[i:i + 4000], columns=["ts", "event_id", "x"]) for i in range(0, len(rows), 4000)]
    out = list(SortedRows(state, "rows", ["ts", "event_id"]).merged(frames + [frames[0].iloc[:0]]))
    assert [tuple(x) for f in out for x in f.itertuples(index=False)] == sorted(rows)
    assert not state.held and max(len(f) for f in out) <= len(frames) * BLOCK and len(out) > 5


def test_history_of_200_000_operations_stays_under_a_fixed_memory():
    def frames(n):
        r = random.Random(3)
        for at in range(0, n, 10_000):
            yield pd.DataFrame({"ts": [r.randrange(10**9) for _ in range(10_000)], "event_id": range(at, at + 10_000),
                                "op": r.choices(["push", "undo", "redo"], k=10_000), "paths": [["some/path/of/a/file"] * 3] * 10_000})

    class Discarding(FakeState):  # the state store keeps blocks in its files, not in this process
        def updateValue(self, key, value):
            path = f"{folder}/{key[0]}-{key[1]}"
            with open(path, "wb") as f:
                f.write(value[0])

        def getValue(self, key):
            with open(f"{folder}/{key[0]}-{key[1]}", "rb") as f:
                return (f.read(),)

        def removeKey(self, key):
            pass

    folder = tempfile.mkdtemp(prefix="state-")
    state, n = {"past": [], "future": [], "current": []}, 0
    tracemalloc.start()
    for pdf in SortedRows(Discarding(), "rows", ["ts", "event_id"]).merged(frames(200_000)):
        state, out = ST.history_fold(state, list(zip(pdf["event_id"], pdf["op"], map(list, pdf["paths"]))))
        n += len(out)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 200_000 and peak < 60 << 20, peak


def test_alerts_that_end_by_timer_equal_the_batch_timeline(spark):
    alerts = FQ._alerts(spark, SF_SMALL).select("key", "ts", "event_id", "severity", "ttl_us")
    d = tempfile.mkdtemp(prefix="sheaf-alerts-")
    alerts.repartition(3).write.mode("overwrite").parquet(d)
    ck = tempfile.mkdtemp(prefix="sheaf-ck-")
    got = []
    stream = ST.alert_timeline_stream(spark.readStream.schema(alerts.schema).parquet(d), "1 day")

    def run():
        q = (stream.writeStream.foreachBatch(lambda df, _: got.extend(map(tuple, df.collect()))).option("checkpointLocation", ck)
             .outputMode("append").trigger(availableNow=True).start())
        q.awaitTermination()

    run()
    end = alerts.agg(F.max("ts")).first()[0]
    for days in (30, 60):  # time goes on without anything for the other keys
        later = spark.createDataFrame([(-1, end + pd.Timedelta(days=days), -days, "error", 1)], alerts.schema)
        later.write.mode("append").parquet(d)
        run()
    want = {tuple(r) for r in CH.alert_timeline(alerts).select("key", "event_id", "severity", "shown_us", "replaced").collect()}
    mine = [r for r in got if r[0] != -1]
    assert len(mine) == len(set(mine)) and set(mine) == want and any(r[4] for r in mine)


def test_ended_alerts_wait_for_what_may_still_replace_them():
    waiting = [(0, 1, "error", 100), (10, 2, "success", 20), (50, 3, "error", 100)]
    assert ST.ended_alerts(waiting, 5) == ([], waiting)
    assert ST.ended_alerts(waiting, 30) == ([(1, "error", 10, True), (2, "success", 20, False)], waiting[2:])


def test_token_deltas_stream_equals_batch(spark):
    versions = FQ._versions(spark, SF_SMALL).select("root_id", "path", "doc_id", FQ.C.tokens_from_chars("content").alias("tokens"))
    d, ck = tempfile.mkdtemp(prefix="sheaf-v-"), tempfile.mkdtemp(prefix="sheaf-ck-")
    got = []
    stream = ST.incremental_tokens_stream(spark.readStream.schema(versions.schema).parquet(d))
    middle = versions.agg(F.percentile("doc_id", 0.5)).first()[0]
    for some in (versions.filter(F.col("doc_id") <= middle), versions.filter(F.col("doc_id") > middle)):
        some.repartition(3).write.mode("append").parquet(d)
        q = (stream.writeStream.foreachBatch(lambda df, _: got.extend(map(tuple, df.collect()))).option("checkpointLocation", ck)
             .outputMode("update").trigger(availableNow=True).start())
        q.awaitTermination()
    assert sorted(got) == sorted(map(tuple, QUERIES["incremental_tokens"](spark, SF_SMALL).collect()))


def test_two_late_rows_are_reported(spark, tmp_path):
    def rows(*days):
        return spark.createDataFrame([("r", datetime(2024, 1, 1) + timedelta(days=d), "modify", f"p{d}", None, i) for i, d in enumerate(days)],
                                     CH.CHANGE_SCHEMA)
    d, ck = str(tmp_path / "in"), str(tmp_path / "ck")
    log = MO.LateRows(spark, str(tmp_path / "late"))
    spark.streams.addListener(log)
    try:
        total = 0
        for some in (rows(1, 2, 100), rows(101), rows(3, 4, 102)):
            some.coalesce(1).write.mode("append").parquet(d)
            stream = CH.change_batches_stream(CH.read_change_stream(spark, d), "1 hour", "1 hour")
            q = (stream.writeStream.foreachBatch(lambda df, _: df.count()).option("checkpointLocation", ck)
                 .outputMode("append").trigger(availableNow=True).start())
            q.awaitTermination()
            total += MO.late_rows(spark, q).agg(F.sum("late_rows")).first()[0] or 0
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        logged = log.table()
        assert total == 2 and logged.agg(F.sum("late_rows")).first()[0] == 2
        assert logged.count() == 1 and log.table().count() == 1  # one operator, one micro-batch
    finally:
        spark.streams.removeListener(log)


def test_live_progress_of_one_run_in_order(spark):
    seen = []
    live = MO.LiveProgress(spark, "r", report=seen.append, every=0.01)
    for stage, n in (("scanning", 2), ("reading", 5), ("building", 3)):
        with live.stage(stage):
            spark.range(1000, numPartitions=n).select(F.max(F.sha2(F.col("id").cast("string"), 256))).collect()
    rows = live.table().orderBy("us").collect()
    assert [tuple(r) for r in rows] == seen
    assert list(dict.fromkeys(r.stage for r in rows)) == ["scanning", "reading", "building"]
    for stage, n in (("scanning", 2), ("reading", 5), ("building", 3)):
        own = [(r.current, r.total) for r in rows if r.stage == stage]
        assert own[0] == (0, 0) and own[-1][0] == own[-1][1] >= n and own == sorted(own, key=lambda x: x[0])
    assert spark.sparkContext.getLocalProperty("spark.jobGroup.id") is None

"""Invariants on random inputs: ordered scan = window functions; roll-up = naive recursion."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from sheaf.operators import entries as EN
from sheaf.operators import select as S
from sheaf.plans.ordered import ordered_scan


def test_ordered_scan_matches_window_on_skewed_keys(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(3000):
        key = "hot" if i % 3 == 0 else f"k{rnd.randrange(40)}"   # one key holds a third of the rows
        rows.append((key, i, rnd.randrange(100)))
    df = spark.createDataFrame(rows, "k string, o long, v long")
    got = ordered_scan(df, ["k"], ["o"], pos="pos", cumsum={"cs": "v"}, lag={"lg": "v"})
    w = Window.partitionBy("k").orderBy("o")
    want = df.select("k", "o", "v", F.row_number().over(w).alias("pos"),
                     F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cs"),
                     F.lag("v").over(w).alias("lg"))
    a = sorted(tuple(r) for r in got.select("k", "o", "v", "pos", "cs", "lg").collect())
    b = sorted(tuple(r) for r in want.collect())
    assert a == b


def test_ordered_scan_spreads_the_hot_key(spark):
    df = spark.range(4000).select(F.lit("hot").alias("k"), F.col("id").alias("o"))
    got = ordered_scan(df, ["k"], ["o"], pos="pos", num_partitions=8)
    per_part = got.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(per_part) > 1                        # one key, many tasks
    assert sorted(r["pos"] for r in got.collect()) == list(range(1, 4001))


def _naive_rollup(paths_checked, dirs):
    """Bottom-up recursion as the GUI does it."""
    children = {}
    for p in list(paths_checked) + list(dirs):
        if p == "":
            continue
        par = p.rsplit("/", 1)[0] if "/" in p else ""
        children.setdefault(par, []).append(p)
    state = {p: ("checked" if c else "unchecked") for p, c in paths_checked.items()}

    def visit(d):
        kids = children.get(d, [])
        for k in kids:
            if k in dirs:
                visit(k)
        if not kids:
            state.setdefault(d, "unchecked")
            return
        ks = [state[k] for k in kids]
        state[d] = ("checked" if all(s == "checked" for s in ks)
                    else "unchecked" if all(s == "unchecked" for s in ks) else "indeterminate")

    visit("")
    return state


def test_rollup_equals_recursive_definition(spark):
    rnd = random.Random(3)
    files = sorted({"/".join(f"d{rnd.randrange(3)}" for _ in range(rnd.randrange(0, 4))) + f"/f{i}"
                    for i in range(60)})
    files = [f.lstrip("/") for f in files]
    f = spark.createDataFrame([("r", p, "x") for p in files], "root_id string, rel_path string, content string")
    e = EN.derive_entries(f)
    picks_list = [p for p in files if rnd.random() < 0.4] + ["d1"]
    picks = spark.createDataFrame([("r", p) for p in picks_list], "root_id string, rel_path string")
    got = {r["rel_path"]: r["state"] for r in S.selection_states(e, picks).collect()}
    dirs = {r["rel_path"] for r in e.filter("is_dir").collect()}
    checked = {p: any(p == q or p.startswith(q + "/") for q in picks_list) for p in files}
    want = _naive_rollup(checked, dirs)
    assert got == want


def test_collect_selected_subset_of_flat(spark):
    f = spark.createDataFrame([("r", "a/x", "1"), ("r", "a/y", "2"), ("r", "b/z", "3")],
                              "root_id string, rel_path string, content string")
    e = EN.derive_entries(f)
    st = S.selection_states(e, spark.createDataFrame([("r", "a")], "root_id string, rel_path string"))
    h2 = {r["rel_path"] for r in S.collect_selected(st).collect()}
    h3 = {r["rel_path"] for r in S.selected_flat(st).collect()}
    assert h2 <= h3 and h2 == {"a/x", "a/y"}


def test_batches_partition_the_accepted_events(spark):
    from sheaf.sources import fixtures as FX
    from sheaf.streaming import changes as CH
    from tests.conftest import SF_SMALL
    acc = CH.accepted(FX.changes(spark, SF_SMALL))
    s = CH.sessionize(acc, "1 hour")
    b = CH.batch_summary(s)
    assert s.count() == acc.count()
    assert b.agg(F.sum("n_events")).first()[0] == acc.count()
    # batches of one root never overlap in time
    rows = sorted((r["root_id"], r["batch_start"], r["batch_last"]) for r in b.collect())
    for (r1, s1, l1), (r2, s2, l2) in zip(rows, rows[1:]):
        if r1 == r2:
            assert l1 < s2


def test_document_tokens_come_from_fragment_lengths(spark):
    from sheaf.operators import render as R
    f = spark.createDataFrame([("r", "a.rs", "héllo"), ("r", "b/c.py", "x\n" * 50)],
                              "root_id string, rel_path string, content string")
    e = EN.derive_entries(f)
    fr = R.fragments(e.filter(~F.col("is_dir")), EN.corpus_contents(f), "markdown", tree=R.tree_lines(e, patterns=[]))
    doc = "".join(r["fragment"] for r in fr.orderBy("section", "seq").collect())
    st = R.document_stats(fr).first()
    assert st["n_chars"] == len(doc) and st["output_tokens"] == (len(doc) + 3) // 4
    assert st["n_bytes"] == len(doc.encode("utf-8"))


def test_ordered_scan_with_hot_keys_descending_orders_and_nulls(spark, monkeypatch):
    monkeypatch.setattr("sheaf.plans.ordered.HOT_ROWS", 500)
    from sheaf.plans.ordered import Desc
    rnd = random.Random(11)
    rows = [(rnd.choice(["hot", "hot", "warm", f"k{rnd.randrange(400)}"]), rnd.choice([None, *range(50)]), f"t{i:05d}", rnd.choice([None, 1, 5, -2]))
            for i in range(9000)]
    df = spark.createDataFrame(rows, "k string, a long, b string, v long").repartition(5)
    for order, native in ((["a", "b"], [F.col("a"), F.col("b")]), ([Desc("a"), "b"], [F.col("a").desc(), F.col("b")]),
                          ([F.lower("b")], [F.lower("b")]), ([F.struct("a", "b")], [F.struct("a", "b")])):
        w = Window.partitionBy("k").orderBy(*native)
        want = df.select("*", F.row_number().over(w).cast("bigint").alias("p"), F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s"),
                         F.lag("v").over(w).alias("g"), F.lag("b").over(w).alias("h"))
        got = ordered_scan(df, ["k"], order, pos="p", cumsum={"s": "v"}, lag={"g": "v", "h": "b"})
        assert got.columns == want.columns and got.exceptAll(want).count() == want.exceptAll(got).count() == 0


def test_ordered_scan_shuffles_rows_once(spark, monkeypatch):
    monkeypatch.setattr("sheaf.plans.ordered.HOT_ROWS", 500)
    df = spark.range(30_000).select((F.col("id") % 3000).alias("k"), F.col("id").alias("o"))
    plain = ordered_scan(df, ["k"], ["o"], pos="p")
    assert plain._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    skewed = ordered_scan(df.withColumn("k", F.when(F.col("o") % 3 == 0, -1).otherwise(F.col("k"))), ["k"], ["o"], pos="p")
    assert skewed.count() == 30_000 and skewed.filter("k = -1").agg(F.max("p")).first()[0] == 10_000
    skewed.collect()
    plan = skewed._jdf.queryExecution().executedPlan().toString()
    final = plan[:plan.index("Initial Plan")]
    assert "ReusedExchange" in final and "SortMergeJoin" not in final  # the pieces' last rows read the exchange of all rows


def test_islands_with_hot_keys(spark, monkeypatch):
    monkeypatch.setattr("sheaf.plans.ordered.HOT_ROWS", 500)
    from sheaf.plans.ordered import islands
    rnd = random.Random(13)
    rows = [("hot" if i % 2 else f"k{rnd.randrange(300)}", t, i) for i, t in enumerate(sorted(rnd.randrange(200_000) for _ in range(8000)))]
    df = spark.createDataFrame(rows, "k string, t long, i long").repartition(5)
    got = {r["i"]: r["n"] for r in islands(df, ["k"], ["t", "i"], "t", 60, "n").collect()}
    last, island, want = {}, {}, {}
    for k, t, i in sorted(rows, key=lambda r: r[1:]):
        island[k] = island.get(k, 0) + (k not in last or t - last[k] >= 60)
        last[k], want[i] = t, island[k]
    assert got == want and max(want.values()) > 50

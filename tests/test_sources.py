"""Sources and sinks: saved policies, raw trees, the export sink, streaming twins of batches, errors and alerts."""

import os
import tempfile

from pyspark.sql import functions as F

from sheaf.functions.patterns import DEFAULT_PATTERNS
from sheaf.operators import entries as EN
from sheaf.operators.prune import prune
from sheaf.sources import fixtures as FX
from sheaf.sources.policy import read_policies
from sheaf.sources.tree_source import read_files, read_tree, root_ids
from sheaf.streaming import changes as CH
from tests.conftest import SF_SMALL

SAVED = ('{"window_width": 1, "window_height": 2.5, "split_position": 0.3, "last_directory": null, "ignore_patterns": "%s", '
         '"include_tree": false, "output_format": "xml", "theme": "auto"}')


def test_policy_files(spark, tmp_path):
    for name, text in {"a": SAVED % "x, *.md ,", "b": "{oops", "c": SAVED % "", "d e": SAVED.replace('"theme"', '"other"') % "x", "f": "",
                       "g": SAVED.replace("false", '"no"') % "x"}.items():
        (tmp_path / f"{name}.json").write_text(text)
    (tmp_path / "note.txt").write_text("{}")
    got = {}
    for r in read_policies(spark, str(tmp_path)).orderBy("ord").collect():
        got.setdefault(r["root_id"], []).append(r["pattern"])
    assert got == {"a": ["x", "*.md", ""], "b": DEFAULT_PATTERNS, "c": [None], "d e": DEFAULT_PATTERNS, "g": DEFAULT_PATTERNS}


def test_any_number_of_profiles(spark):
    n = 20_000
    files = spark.range(n).select(F.concat(F.lit("r"), "id").alias("root_id"), F.explode(F.array(
        F.concat(F.lit("d/f"), "id", F.lit(".md")), F.lit("d/keep"))).alias("rel_path"), F.lit("x").alias("content"))
    profiles = spark.range(n - 5).select(F.concat(F.lit("r"), "id").alias("root_id"), F.lit(0).alias("ord"), F.concat(F.lit("f"), "id", F.lit("*")).alias("pattern"))
    profiles = profiles.unionByName(spark.createDataFrame([(None, 0, "kee?")], "root_id string, ord int, pattern string"))
    left = EN.files_only(prune(EN.derive_entries(files), profiles=profiles))
    assert left.filter("rel_path = 'd/keep'").count() == n - 5 and left.filter("rel_path <> 'd/keep'").count() == 5


def test_roots_of_one_name_depth_and_selected_reads(spark, tmp_path):
    for side in ("one", "two,x"):
        (tmp_path / side / "proj" / "sub").mkdir(parents=True)
        (tmp_path / side / "proj" / "a.txt").write_text(side)
        (tmp_path / side / "proj" / "sub" / "b.txt").write_text("b")
    paths = [str(tmp_path / "one" / "proj"), str(tmp_path / "two,x" / "proj")]
    ids = root_ids(paths)
    assert sorted(ids.values()) == sorted(paths) and len(ids) == 2
    rows = read_tree(spark, paths).collect()
    assert len(rows) == 8 and {r["root_id"] for r in rows} == set(ids)
    assert {(r["rel_path"], r["depth"]) for r in read_tree(spark, paths[:1], max_depth=0).collect()} == {("", 0)}
    assert {r["rel_path"] for r in read_tree(spark, paths[:1], max_depth=1).collect()} == {"", "a.txt", "sub"}
    wanted = spark.createDataFrame([(r, p) for r in ids for p in ("a.txt", "gone")], "root_id string, rel_path string")
    got = {(r["root_id"], r["rel_path"]): r["content"] for r in EN.decoded(read_files(wanted, ids)).collect()}
    assert sorted(v for v in got.values() if v) == ["one", "two,x"] and sum(v is None for v in got.values()) == 2


def test_export_writes_uris_and_refuses_to_overwrite(spark, tmp_path):
    import pytest

    from sheaf.operators import render as R
    frags = spark.createDataFrame([(f"r{i % 3}", 5, i, f"é{i}\n") for i in range(200)], "root_id string, section int, seq long, fragment string")
    for out in (str(tmp_path / "plain"), f"file://{tmp_path}/uri"):
        R.export(frags, out)
        with pytest.raises(FileExistsError):
            R.export(frags, out)
    for name in ("plain", "uri"):
        for k in range(3):
            d = tmp_path / name / f"root_id=r{k}"
            assert sorted(os.listdir(d))[0].startswith("part-")
            assert "".join((d / f).read_text(encoding="utf-8") for f in sorted(os.listdir(d))) == "".join(f"é{i}\n" for i in range(200) if i % 3 == k)


def _run(stream_df, name, mode="append"):
    q = (stream_df.writeStream.format("memory").queryName(name).outputMode(mode)
         .option("checkpointLocation", tempfile.mkdtemp(prefix="sheaf-ck-")).trigger(availableNow=True).start())
    q.awaitTermination()
    return q.sparkSession.table(name) if hasattr(q, "sparkSession") else None


def test_stream_forms_agree_with_batch(spark):
    d = tempfile.mkdtemp(prefix="sheaf-chg-")
    FX.changes(spark, SF_SMALL).repartition(4).write.mode("overwrite").parquet(d)
    batches = CH.sessionize(CH.accepted(FX.changes(spark, SF_SMALL)), "1 hour")
    cols = ["root_id", "batch_start", "batch_last", "n_events", "n_paths", "n_errors", "outcome"]
    _run(CH.change_batches_stream(CH.read_change_stream(spark, d)), "j1_full")
    got = {tuple(r) for r in spark.table("j1_full").select(*cols).collect()}
    want = {tuple(r) for r in CH.batch_summary(batches).select(*cols).collect()}
    assert got and got <= want and len(want) - len(got) <= 10
    _run(CH.error_items_stream(CH.read_change_stream(spark, d)), "j3_stream")
    start = batches.groupBy("root_id", "batch_id").agg(F.min("ts").alias("batch_start"))
    want = {tuple(r) for r in CH.error_items(batches).join(start, ["root_id", "batch_id"]).select("root_id", "batch_start", "seq", "item").collect()}
    got = {tuple(r) for r in spark.table("j3_stream").select("root_id", "batch_start", "seq", "item").collect()}
    assert got and got <= want


def test_alerts_and_progress_streams(spark):
    rows = [(k, f"2024-01-01 00:00:{s:02d}", i, sev, ttl * 1_000_000) for i, (k, s, sev, ttl) in enumerate(
        [(1, 0, "error", 4), (1, 2, "success", 2), (2, 1, "warning", 3), (3, 9, "error", 4), (1, 9, "success", 2)])]
    alerts = spark.createDataFrame(rows, "key int, ts string, event_id long, severity string, ttl_us long").withColumn("ts", F.col("ts").cast("timestamp"))
    at = lambda s: F.unix_micros(F.lit(f"2024-01-01 00:00:{s:02d}").cast("timestamp"))
    us = lambda s: spark.range(1).select(at(s)).first()[0]
    assert {(r["key"], r["event_id"], r["left_us"]) for r in CH.alerts_at(alerts, us(3)).collect()} == {(1, 1, 1_000_000), (2, 2, 1_000_000)}
    assert {r["event_id"] for r in CH.alerts_at(alerts).collect()} == {3, 4}
    assert CH.alerts_at(alerts.filter("false")).count() == 0
    d = tempfile.mkdtemp(prefix="sheaf-al-")
    alerts.write.mode("overwrite").parquet(d)
    _run(CH.alerts_stream(spark.readStream.schema(alerts.schema).parquet(d)), "j6_stream", "complete")
    assert {(r["key"], r["event_id"]) for r in spark.table("j6_stream").collect()} == {(1, 4), (2, 2), (3, 3)}
    ev = spark.createDataFrame([("r", "reading", k, 3) for k in (1, 2, 3)], "root_id string, stage string, current long, total long")
    p = tempfile.mkdtemp(prefix="sheaf-pr-")
    ev.write.mode("overwrite").parquet(p)
    _run(CH.progress_stream(spark.readStream.schema(ev.schema).parquet(p)), "j5_stream", "complete")
    assert [tuple(r) for r in spark.table("j5_stream").collect()] == [("r", "reading", 3, 3, 3)]


def test_project_types_by_marker_then_extension(spark):
    from sheaf.operators.projects import project_profiles, project_types
    names = {"m": ["Cargo.toml", "package.json", "a.py", "b.py"], "deep": ["x/Cargo.toml", "a.py", "b/c.js", "d.py"], "none": ["a.txt"],
             "tie": ["a.rs", "b.py"], "setup": ["setup.py", "a.rs", "b.rs"]}
    f = spark.createDataFrame([(r, n, "x") for r, ns in names.items() for n in ns], "root_id string, rel_path string, content string")
    e = EN.derive_entries(f)
    assert {r["root_id"]: r["project_type"] for r in project_types(e).collect()} == {
        "m": "rust", "deep": "python", "none": "default", "tie": "rust", "setup": "python"}
    got = [r["pattern"] for r in project_profiles(e).filter("root_id = 'none'").orderBy("ord").collect()]
    assert got == DEFAULT_PATTERNS


def test_command_line_packs_a_tree_and_removes_its_tables(spark, tmp_path, capsys):
    import sheaf.__main__ as command
    from sheaf import session
    root = tmp_path / "proj"
    (root / "src").mkdir(parents=True)
    (root / "src" / "a.py").write_text("print(1)\n")
    (root / "b.log").write_text("no")
    pinned = f"{session.ensure_checkpoint_dir(spark)}/pinned".replace("file:", "")
    before = set(os.listdir(pinned)) if os.path.isdir(pinned) else set()
    command.main([str(root), "--out", str(tmp_path / "out"), "--ignore", "*.log", "--progress"])
    told = capsys.readouterr()
    assert told.out.startswith("proj: ") and [x.split()[1] for x in told.err.splitlines() if x.startswith("proj: ")][0] == "scanning"
    assert list(dict.fromkeys(x.split()[1] for x in told.err.splitlines() if x.startswith("proj: "))) == ["scanning", "reading", "building"]
    text = "".join(p.read_text() for p in sorted((tmp_path / "out" / "root_id=proj").iterdir()) if not p.name.startswith("."))
    assert "### src/a.py" in text and "b.log" not in text
    assert set(os.listdir(pinned)) == before and not session._scopes


def test_name_dictionary_equals_literal_profiles(spark, monkeypatch):
    from sheaf.operators import prune as PR
    from sheaf.plans import queries as Q
    entries = Q.corpus_entries(spark, SF_SMALL)
    profiles = FX.profiles(spark)
    for include_root in (False, True):
        want = {tuple(r) for r in prune(entries, profiles=profiles, include_root=include_root).select("root_id", "rel_path").collect()}
        with monkeypatch.context() as m:
            m.setattr(PR, "LITERALS", 0)
            got = prune(entries, profiles=profiles, include_root=include_root)
            assert got.columns == entries.columns
            assert {tuple(r) for r in got.select("root_id", "rel_path").collect()} == want
    assert 0 < len(want) < entries.count()


def test_thousands_of_profiles_compile_no_regex_for_an_entry(spark):
    n = 3000
    files = spark.range(n).select(F.concat(F.lit("r"), "id").alias("root_id"), F.explode(F.array(
        F.concat(F.lit("a/skip"), "id", F.lit("/x.md")), F.lit("a/b/keep.md"), F.concat(F.lit("a/b/skip"), "id"))).alias("rel_path"), F.lit("x").alias("content"))
    profiles = spark.range(n).select(F.concat(F.lit("r"), "id").alias("root_id"), F.lit(0).alias("ord"), F.concat(F.lit("skip"), "id").alias("pattern"))
    left = prune(EN.derive_entries(files), profiles=profiles)
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert "RLIKE" not in plan  # the dictionary's tests are done: only names are joined
    assert sorted({r.rel_path for r in left.collect()}) == ["", "a", "a/b", "a/b/keep.md"] and left.count() == 4 * n

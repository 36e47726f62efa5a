"""Raw trees: work-splitting listing, stores, and the change feed of a watched tree."""

import os
import tempfile

import pytest
from pyarrow import fs as arrow_fs
from pyspark.sql import functions as F

from sheaf.sources import stores, tree_listing, tree_watch


def plant(root, files):
    for rel, text in files.items():
        path = root / rel
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)


def walked(root):
    out = {("", True)}
    for base, dirs, files in os.walk(root):
        rel = os.path.relpath(base, root)
        out |= {(os.path.normpath(os.path.join(rel, d)), True) for d in dirs}
        out |= {(os.path.normpath(os.path.join(rel, f)), False) for f in files}
    return out


def test_one_deep_root_keeps_all_tasks_busy(spark, tmp_path):
    plant(tmp_path, {f"only/one/d{i % 40}/e{i % 7}/f{i}.txt": "x" * (i % 5) for i in range(2000)})
    (tmp_path / "only" / "link").symlink_to(tmp_path / "only")
    (tmp_path / "only" / ".hidden").mkdir()
    rounds = tree_listing.list_rounds(spark, [str(tmp_path)], first_budget=4, tasks=8)
    assert 3 <= len(rounds) <= 8
    busy = [r.filter("NOT pending").select("task").distinct().count() for r in rounds]
    assert max(busy) == 8  # all of it hangs on one directory
    most = max(r["n"] for r in rounds[busy.index(8)].filter("NOT pending").groupBy("task").agg(F.count("*").alias("n")).collect())
    assert most < 2000
    rows = tree_listing.list_tree(spark, [str(tmp_path)], first_budget=4, tasks=8).collect()
    assert len(rows) == len({r.rel_path for r in rows}) and {(r.rel_path, r.is_dir) for r in rows} == walked(tmp_path) - {("only/link", True)} | {("only/link", False)}


def test_uri_and_plain_path_give_equal_rows(spark, tmp_path):
    plant(tmp_path / "a b", {"x/y.txt": "1", "z%20.txt": "22"})
    (tmp_path / "a b" / "empty").mkdir()
    plain = sorted(map(tuple, tree_listing.list_tree(spark, [str(tmp_path / "a b")]).collect()), key=repr)
    uri = sorted(map(tuple, tree_listing.list_tree(spark, [(tmp_path / "a b").as_uri()]).collect()), key=repr)
    assert plain == uri and len(plain) == 5
    contents = tree_listing.read_tree(spark, [(tmp_path / "a b").as_uri()], content=True).filter("NOT is_dir")
    assert {(r.rel_path, bytes(r.content)) for r in contents.collect()} == {("x/y.txt", b"1"), ("z%20.txt", b"22")}
    # the listing of other stores goes through Arrow's file systems
    for directory in ("", "/x", "/empty"):
        at = str(tmp_path / "a b") + directory
        assert sorted(stores.store_entries(arrow_fs.LocalFileSystem(), at)) == sorted((n, d, 0 if d else s, m) for n, d, s, m in stores.entries(at))
    assert stores.store_entries(arrow_fs.LocalFileSystem(), str(tmp_path / "gone")) is None


def test_depth_cap_missing_and_empty_roots(spark, tmp_path):
    plant(tmp_path / "r", {"a/b/c/d.txt": "x", "e.txt": "y"})
    (tmp_path / "bare").mkdir()
    paths = [str(tmp_path / "r"), str(tmp_path / "bare"), str(tmp_path / "missing")]
    got = {(r.root_id, r.rel_path) for r in tree_listing.list_tree(spark, paths, max_depth=2).collect()}
    assert got == {("r", ""), ("r", "a"), ("r", "a/b"), ("r", "e.txt"), ("bare", "")}
    assert tree_listing.list_tree(spark, []).count() == 0


@pytest.fixture
def changes(spark, tmp_path):
    root, state = tmp_path / "tree", tempfile.mkdtemp(prefix="watch-")
    plant(root, {"keep.txt": "1", "edit.txt": "1", "sub/gone.txt": "1", "sub/deep/also.txt": "1", "turn": "file"})
    stream = tree_watch.watch(spark, [str(root)], f"{state}/snapshots", parts=4)
    seen = []

    def run():
        q = (stream.writeStream.foreachBatch(lambda df, _: seen.extend(df.collect())).option("checkpointLocation", f"{state}/ck")
             .trigger(availableNow=True).start())
        q.awaitTermination()
        out = sorted((r.kind, r.path) for r in seen)
        events = [r.event_id for r in seen]
        assert len(set(events)) == len(events) and all(r.root_id == "tree" and r.ts is not None for r in seen)
        seen.clear()
        return out

    return root, run, state


def test_watched_tree_gives_exactly_the_changes_between_runs(changes):
    import shutil
    root, run, state = changes
    assert run() == []
    (root / "edit.txt").write_text("longer")
    plant(root, {"new/a/b.txt": "x", "sub/deep/added.txt": "y"})
    shutil.rmtree(root / "new" / "none", ignore_errors=True)
    (root / "sub" / "gone.txt").unlink()
    (root / "turn").unlink()
    plant(root, {"turn/inside.txt": "z"})
    assert run() == [("create", "new"), ("create", "new/a"), ("create", "new/a/b.txt"), ("create", "sub/deep/added.txt"),
                     ("create", "turn"), ("create", "turn/inside.txt"), ("modify", "edit.txt"), ("remove", "sub/gone.txt"), ("remove", "turn")]
    assert run() == []
    (root / "new" / "a" / "b.txt").write_text("changed")  # found by one task, dealt to another since
    for name in ("also.txt", "added.txt"):
        (root / "sub" / "deep" / name).unlink()
    (root / "sub" / "deep").rmdir()
    assert run() == [("modify", "new/a/b.txt"), ("remove", "sub/deep"), ("remove", "sub/deep/added.txt"), ("remove", "sub/deep/also.txt")]
    assert len([d for d in os.listdir(f"{state}/snapshots") if d.isdigit()]) <= 2  # older versions go


def test_watched_tree_feeds_the_change_operators(spark, changes):
    from sheaf.streaming import changes as CH
    assert {f.name for f in CH.CHANGE_SCHEMA} == {c.split()[0] for c in tree_watch.SCHEMA.split(", ")}

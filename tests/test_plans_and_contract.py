"""Plan shape assertions and the driver contract."""

import os
import re
import tempfile

import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL

NO_PYTHON = ["scan_entries", "ignore_by_profile", "expand_selection", "tristate_rollup", "render_tree",
             "assemble_markdown", "preorder_position", "node_counts", "event_gap", "latency_stats",
             "pattern_match_matrix", "match_navigation", "change_batches"]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NO_PYTHON)
def test_no_python_and_no_nested_loop_join(spark, name):
    p = _plan(E.queries()[name](spark, SF_SMALL))
    for bad in ("BroadcastNestedLoopJoin", "CartesianProduct", "BatchEvalPython", "ArrowEvalPython",
                "MapInArrow", "FlatMapGroupsInPandas"):
        assert bad not in p, (name, bad)


def test_scan_prunes_columns_and_pushes_filters(spark):
    from pyspark.sql import functions as F

    from sheaf.sources.tables import table
    df = table(spark, SF_SMALL, "documents").filter(F.col("source") == "src1").select("doc_id")
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(source), EqualTo(source,src1)]" in p
    assert "ReadSchema: struct<doc_id:bigint,source:string>" in p


def test_contract(spark):
    q, o = E.queries(), E.oracle_sql()
    assert len(q) >= 100 and set(o) <= set(q)
    own = {n for n in q if n != "pipeline" and not re.match(r"op[0-9]+_", n)}
    assert own == own & set(o)
    df = E.entry(spark)
    assert df.columns == ["root_id", "n_fragments", "n_chars", "n_bytes", "output_tokens"]
    assert df.count() > 0


def test_export_writes_exact_documents(spark):
    from pyspark.sql import functions as F

    from sheaf.operators import entries as EN
    from sheaf.operators import render as R
    f = spark.createDataFrame([("r1", "a.rs", "x"), ("r1", "b/c.md", "y\n"), ("r2", "z.py", "")],
                              "root_id string, rel_path string, content string")
    e = EN.derive_entries(f)
    fr = R.fragments(e.filter(~F.col("is_dir")), EN.read_contents(f.select("root_id", "rel_path"), f), "xml")
    out = os.path.join(tempfile.mkdtemp(prefix="sheaf-exp-"), "export")
    R.export(fr, out)
    for root in ("r1", "r2"):
        d = os.path.join(out, f"root_id={root}")
        text = "".join(open(os.path.join(d, n)).read() for n in sorted(os.listdir(d)) if n.startswith("part-"))
        want = "".join(r["fragment"] for r in fr.filter(F.col("root_id") == root).orderBy("section", "seq").collect())
        assert text == want




def test_tree_source_lists_hidden_and_directories(spark, tmp_path):
    from sheaf.sources.tree_source import read_tree
    root = tmp_path / "proj"
    (root / "dir1").mkdir(parents=True)
    (root / "dir2").mkdir()
    (root / "file1.txt").write_text("content")
    (root / "dir1" / "file2.txt").write_text("content")
    (root / ".hidden").write_text("h")
    (root / "_under").write_text("u")
    rows = {r["rel_path"]: r for r in read_tree(spark, [str(root)], content=True).collect()}
    assert set(rows) == {"", "dir1", "dir2", "file1.txt", "dir1/file2.txt", ".hidden", "_under"}
    assert rows["dir1"]["is_dir"] and rows["file1.txt"]["size"] == 7
    assert bytes(rows["file1.txt"]["content"]) == b"content"
    assert read_tree(spark, [str(tmp_path / "missing")]).count() == 0


@pytest.mark.parametrize("name", ["render_audit", "match_navigation", "bytes_read", "utf8_errors", "changed_sections", "progress_pct",
                                  "node_counts"])
def test_no_text_in_exchanges(spark, name):
    df = E.queries()[name](spark, SF_SMALL)
    mode = spark.sparkContext._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    for node in df._jdf.queryExecution().explainString(mode).split("\n\n"):
        if re.match(r"\(\d+\) (Broadcast)?Exchange", node):
            assert not re.search(r"\b(content|text|fragment|_raw|html)#", node), (name, node)

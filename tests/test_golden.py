"""Literal edge rows with exact expected bytes and values (FIXTURES.md part 3)."""

from pyspark.sql import functions as F

from sheaf.functions import classify as C
from sheaf.functions import paths as P
from sheaf.operators import entries as EN
from sheaf.operators import render as R
from sheaf.operators import search as SR
from sheaf.operators import select as S
from sheaf.operators.metrics import progress_pct
from sheaf.streaming.stateful import history_fold, throttle_fold


def _files(spark, rows):
    return spark.createDataFrame(rows, "root_id string, rel_path string, content string")


def _doc(spark, rows, fmt, safe=False, tree=False, patterns=None):
    f = _files(spark, rows)
    e = EN.derive_entries(f)
    sel = e.filter(~F.col("is_dir"))
    c = EN.read_contents(f.select("root_id", "rel_path"), f)
    t = R.tree_lines(e, patterns=patterns or []) if tree else None
    fr = R.fragments(sel, c, fmt, tree=t, safe=safe)
    return "".join(r["fragment"] for r in fr.orderBy("root_id", "section", "seq").collect())


def test_markdown_bytes_and_newlines(spark):
    doc = _doc(spark, [("r", "a.txt", ""), ("r", "b.rs", "x"), ("r", "c.py", "y\n")], "markdown")
    assert doc == ("# Codebase Export\n\n## Files\n\n"
                   "### a.txt\n\n```\n\n```\n\n"
                   "### b.rs\n\n```rust\nx\n```\n\n"
                   "### c.py\n\n```python\ny\n```\n\n")


def test_xml_bytes_faithful_and_safe(spark):
    rows = [("r", 'a&"b.rs', "a]]>b")]
    assert _doc(spark, rows, "xml") == (
        '<?xml version="1.0" encoding="UTF-8"?>\n<codebase>\n  <files>\n'
        '    <file path="a&"b.rs">\n<![CDATA[\na]]>b\n]]>\n    </file>\n  </files>\n</codebase>')
    safe = _doc(spark, rows, "xml", safe=True)
    assert 'path="a&amp;&quot;b.rs"' in safe and "a]]]]><![CDATA[>b" in safe


def test_markdown_fence_safe(spark):
    body = "```\ncode\n```"
    assert "```markdown\n```\ncode\n```\n```\n\n" in _doc(spark, [("r", "x.md", body)], "markdown")
    assert "````markdown\n```\ncode\n```\n````" in _doc(spark, [("r", "x.md", body)], "markdown", safe=True)


def test_tree_lines_and_block(spark):
    rows = [("proj", "src/main.rs", "m"), ("proj", "src/lib.rs", "l"), ("proj", "README.md", "r")]
    doc = _doc(spark, rows, "markdown", tree=True)
    assert doc.startswith("# Codebase Export\n\n## Directory Structure\n\n```\n"
                          "└── 📁 proj\n    ├── 📁 src\n    │   ├── 📄 lib.rs\n    │   └── 📄 main.rs\n"
                          "    └── 📄 README.md\n```\n\n## Files\n\n")


def test_ignored_root_name_omits_tree(spark):
    doc = _doc(spark, [("target", "a.rs", "x")], "markdown", tree=True, patterns=["target"])
    assert "Directory Structure" not in doc and "### a.rs" in doc


def test_depth_eleven_absent_from_tree(spark):
    rel = "/".join(str(i) for i in range(1, 12))
    lines = R.tree_lines(EN.derive_entries(_files(spark, [("r", rel, "x")])), patterns=[]).collect()
    assert len(lines) == 11          # root (depth 0) .. depth 10


def test_invalid_utf8_is_an_error_row(spark):
    df = spark.createDataFrame([("r", "bad.txt", bytearray(b"\xffA")), ("r", "ok.txt", bytearray(b"hi"))],
                               "root_id string, rel_path string, content binary")
    out = {r["rel_path"]: r for r in EN.read_contents(df.select("root_id", "rel_path"), df).collect()}
    assert out["bad.txt"]["content"] is None and "UTF-8" in out["bad.txt"]["error"]
    assert out["ok.txt"]["content"] == "hi" and out["ok.txt"]["error"] is None


def test_containment(spark):
    df = spark.createDataFrame([("/a/b", "/a/bc/f"), ("/a/b", "/a/b/../c"), ("/a/b", "/a/b/c/./d"), ("/a/b", "/a/b")],
                               "root string, path string")
    got = [r[0] for r in df.select(P.contained_in("path", "root")).collect()]
    assert got == [False, False, True, True]


def test_extension_language_category(spark):
    df = spark.createDataFrame([(".gitignore",), ("X.RS",), ("a.tar.gz",), ("noext",)], "name string")
    rows = df.select(P.extension("name").alias("e")).select(
        "e", C.language_of("e").alias("l"), C.file_category("e").alias("c")).collect()
    assert [tuple(r) for r in rows] == [("", "", "File"), ("RS", "", "Code"), ("gz", "", "Archive"), ("", "", "File")]


def test_size_class_boundary_and_tokens(spark):
    df = spark.createDataFrame([(262143, "é😀"), (262144, "x" * 4000)], "size long, t string")
    rows = df.select(C.size_class("size"), C.tokens_from_chars("t"), F.length("t"), F.octet_length("t"),
                     C.tokens_from_bytes(F.octet_length("t")), C.token_level(C.tokens_from_chars("t"))).collect()
    assert tuple(rows[0]) == ("small", 1, 2, 6, 1, "Low")
    assert tuple(rows[1]) == ("large", 1000, 4000, 4000, 1000, "Medium")


def test_empty_dir_makes_parent_indeterminate(spark):
    e = spark.createDataFrame(
        [("r", "", None, "r", "", 0, True, None), ("r", "src", "", "src", "", 1, True, None),
         ("r", "src/a.rs", "src", "a.rs", "rs", 2, False, 1), ("r", "src/empty", "src", "empty", "", 2, True, None)],
        "root_id string, rel_path string, parent string, name string, ext string, depth long, is_dir boolean, size long")
    picks = spark.createDataFrame([("r", "src/a.rs")], "root_id string, rel_path string")
    st = {r["rel_path"]: r["state"] for r in S.selection_states(e, picks).collect()}
    assert st["src"] == "indeterminate" and st["src/empty"] == "unchecked" and st["src/a.rs"] == "checked"


def test_progress_wrap_and_overlap(spark):
    df = spark.createDataFrame([(0, 0, "aaaa")], "cur long, tot long, t string")
    r = df.select(progress_pct("cur", "tot"), SR.match_count("t", "aa")).first()
    assert r[0] == 100.0 and r[1] == 2
    nav = SR.match_positions(spark.createDataFrame([("k", "x.x.x.x.x.")], "k string, t string"), ["k"], "t", "x")
    got = {r["match_idx"]: (r["next_idx"], r["prev_idx"]) for r in nav.collect()}
    assert got[4] == (0, 3) and got[0] == (1, 4)


def test_throttle_boundary():
    keep, last = throttle_fold([0, 499_000, 500_000, 999_000, 1_000_000], None, 500_000)
    assert keep == [True, False, True, False, True] and last == 1_000_000


def test_history_cap_and_redo_cleared():
    st = {"current": [], "past": [], "future": []}
    st, out = history_fold(st, [(i, "push", [f"p{i}"]) for i in range(21)])
    assert len(st["past"]) == 20 and st["past"][0] == ["p1"]
    st, out = history_fold(st, [(100, "undo", []), (101, "push", ["q"])])
    assert out[0][2] and st["future"] == [] and st["current"] == ["q"]
    st, out = history_fold({"current": [], "past": [], "future": []}, [(1, "undo", []), (2, "redo", [])])
    assert [o[2] for o in out] == [False, False]

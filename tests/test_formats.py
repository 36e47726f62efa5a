"""Document formats are classes of a registry: one that only this test defines renders, counts and exports like the others."""

import json

import pytest
from pyspark.sql import functions as F

from sheaf.operators import entries as EN
from sheaf.operators import render as R


class JsonLines(R.DocumentFormat):
    name = "jsonl"

    def header(self):
        return F.lit('{"kind": "header"}\n')

    def tree_line(self, line):
        return None

    def fragment(self, path, content, ext, safe):
        return F.concat(F.to_json(F.struct(path.alias("path"), content.alias("text"))), F.lit("\n"))


@pytest.fixture
def corpus(spark):
    rows = [("r", "b.py", 'print("x")'), ("r", "a/z.md", "line\nline"), ("s", "only.txt", "")]
    files = spark.createDataFrame(rows, "root_id string, rel_path string, content string")
    e = EN.derive_entries(files)
    return EN.files_only(e), EN.corpus_contents(files), e


def document(frags, root):
    return "".join(r.fragment for r in frags.filter(F.col("root_id") == root).orderBy("section", "seq").collect())


def test_a_third_format_from_outside(spark, corpus, tmp_path):
    sel, contents, e = corpus
    R.register_format(JsonLines())
    try:
        assert R.format_names() == ["jsonl", "markdown", "xml"]
        frags = R.fragments(sel, contents, "jsonl", tree=R.tree_lines(e, patterns=[]))
        assert [json.loads(x) for x in document(frags, "r").splitlines()] == [
            {"kind": "header"}, {"path": "a/z.md", "text": "line\nline"}, {"path": "b.py", "text": 'print("x")'}]
        assert R.document_stats(frags).filter("root_id = 's'").first()["n_fragments"] == 2
        R.export(frags, str(tmp_path / "out"))
        parts = sorted((tmp_path / "out" / "root_id=r").iterdir())
        assert "".join(p.read_text() for p in parts if not p.name.startswith(".")) == document(frags, "r")
    finally:
        R._FORMATS.pop("jsonl")


def test_unknown_and_nameless_formats_are_refused(corpus):
    sel, contents, _ = corpus
    with pytest.raises(ValueError):
        R.fragments(sel, contents, "jsonl")
    with pytest.raises(ValueError):
        R.register_format(R.DocumentFormat())
    assert document(R.fragments(sel, contents, JsonLines()), "s") == '{"kind": "header"}\n{"path":"only.txt","text":""}\n'

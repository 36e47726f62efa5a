"""The stored form of the selection: entries meet the picks once, and only picked directories are exploded."""

import pytest
from pyspark.sql import functions as F

from sheaf.operators import entries as EN
from sheaf.operators import select as S

FILES = [("r", "a/b/x"), ("r", "a/b/y"), ("r", "a/z"), ("r", "c/d//e"), ("r", "c/d/"), ("s", "x"), ("s", "k/x"), (None, "a/x")]


@pytest.fixture(scope="module")
def nodes(spark):
    files = spark.createDataFrame(FILES, "root_id string, rel_path string")
    return EN.derive_entries(files.withColumn("size", F.lit(1))).select("root_id", "rel_path", "parent", "is_dir")


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def _labels(monkeypatch):
    labels, pinned = [], S.pinned_table
    monkeypatch.setattr(S, "pinned_table", lambda df, label: labels.append(label) or pinned(df, label))
    return labels


def test_file_picks_explode_no_directory(spark, nodes, monkeypatch):
    picks = spark.createDataFrame([("r", "a/b/x"), ("r", "gone"), ("s", "k/x"), ("s", "k/x"), (None, "a/x")], "root_id string, rel_path string")
    want = _rows(S.rollup(S.expand(nodes, picks)))
    labels = _labels(monkeypatch)
    got = S.selection_states(nodes, picks)
    assert "checked" not in labels and "states" not in labels  # the old form exploded every directory, and stored all rows again
    assert got.columns == ["root_id", "rel_path", "parent", "is_dir", "checked", "state"] and _rows(got) == want
    assert ("r", "a/b", "a", True, False, "indeterminate") in want and ("s", "k", "", True, False, "checked") in want


def test_directory_picks_are_the_same_in_both_forms(spark, nodes):
    picks = spark.createDataFrame([("r", "a"), ("r", "c/d//e"), ("s", "")], "root_id string, rel_path string")
    got = S.selection_states(nodes, picks)
    assert _rows(got) == _rows(S.rollup(S.expand(nodes, picks)))
    assert ("r", "a/b/y", "a/b", False, True, "checked") in _rows(got)

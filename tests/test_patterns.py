"""Driver-side pattern logic: classification, glob compilation, presets (pure Python)."""

import re

import pytest

from sheaf.functions.patterns import (DEFAULT_PATTERNS, PRESETS, cache_matcher, classify, component_regex,
                                      expand_braces, fuzzy_regex, is_valid_glob, naive_cache_regex, name_regex,
                                      override_regex, parse_pattern_string, path_glob_regex)
from sheaf.operators.prune import rejected_patterns


def found(rx, text):
    return re.search(rx.replace("\\z", "\\Z"), text) is not None


def test_classify_order():
    assert classify("*.rs") == "glob"
    assert classify("^.*$") == "glob"          # '*' wins over the regex markers
    assert classify("^src") == "regex"
    assert classify("lock$") == "regex"
    assert classify("node_modules") == "exact"


def test_parse_pattern_string_splits_braces():
    assert parse_pattern_string(" *.{js,ts} , ,x") == ["*.{js", "ts}", "x"]
    assert parse_pattern_string("") == []


def test_presets_fixed_values():
    assert DEFAULT_PATTERNS == [".*", "node_modules", "__pycache__", "target", "build", "dist", "_*"]
    assert len(PRESETS["common"]) == 6 and len(PRESETS["minimal"]) == 2 and PRESETS["clear"] == []


def test_cache_truth_table():
    rx = cache_matcher(["*.rs", "target/**", "*.{txt,md}"])
    for path, want in [("main.rs", True), ("target/debug/build", True), ("readme.txt", True),
                       ("doc.md", True), ("main.py", False)]:
        assert found(rx, path) is want, path
    for path, want in [("docs/en/a.md", False), ("x/a.{txt,md}", True), ("a.md\n", False), ("target/a\nb", True), ("x/y.rs", True)]:
        assert found(rx, path) is want, path
    assert naive_cache_regex("[") is None and found(naive_cache_regex("a,b"), "ax") and not found(naive_cache_regex("*.a"), "x/y.a")


def test_name_globs():
    rx = name_regex(["*.rs", "d?c_1*", "[!a]x"])
    assert found(rx, "main.rs") and found(rx, "doc_12") and found(rx, "bx")
    assert not found(rx, "ax") and not found(rx, "Doc_12") and not found(rx, "x.RS")
    assert not found(rx, "a.rs\n") and found(rx, "a\nb.rs")
    assert not found(path_glob_regex("*.rs"), "a.rs\n") and found(path_glob_regex("a*"), "a/\n")


GLOBS = {"a[b]c[d": False, "[]": False, "[!]": False, "[]]": True, "[!]]": True, "[**]": True, "[z-a]": True, "***": False, "**": True,
         "a/**/b": True, "a**/b": False, "**b": False, "[a/]**": False, "": True, "[": False, "a]": True, "[!a": False, "[a": False}


def test_one_validator(spark):
    assert rejected_patterns(list(GLOBS)) == [p for p, ok in GLOBS.items() if not ok]
    df = spark.createDataFrame([(p, ok) for p, ok in GLOBS.items()], "p string, ok boolean")
    assert df.filter(is_valid_glob(df["p"]) != df["ok"]).count() == 0
    assert not found(name_regex(["[z-a]"]), "m") and found(name_regex(["[!z-a]"]), "m")


def test_override_directories_only():
    rx = override_regex(["target/", "a/b", "*.md"])
    for path, is_dir, want in [("target", False, False), ("target", True, True), ("target/x", False, True), ("x/target/y", False, True),
                               ("a/b", False, True), ("x/a/b", False, False), ("a/bc", False, False), ("x/r.md", False, True), ("r.md2", False, False)]:
        assert found(rx, path + ("/" if is_dir else "")) is want, path


@pytest.mark.parametrize("query, name, want", [("Dc1", "Doc_1", True), ("Dc1", "doc_1", False), ("dc1", "Doc_1", True), ("dc1", "d\nc1", True)])
def test_fuzzy_is_smart_case(query, name, want):
    assert found(fuzzy_regex(query), name) is want


def test_component_regex_prunes_any_level_and_rejects_bad_globs():
    prof = component_regex(DEFAULT_PATTERNS + ["a**", "x/y"])
    assert prof.rejected == ("a**",)
    rx = prof.regex
    assert re.search(rx, "/src/.hidden/a.rs/")
    assert re.search(rx, "/node_modules/pkg/")
    assert re.search(rx, "/src/_gen/")
    assert not re.search(rx, "/src/main.rs/")
    assert not re.search(rx, "/x/y/")           # patterns with '/' never match a name


def test_brace_expansion():
    assert expand_braces("*.{rs,py}") == ["*.rs", "*.py"]
    assert expand_braces("a{b,{c,d}}e") == ["abe", "ace", "ade"]

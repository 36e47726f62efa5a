"""Command line: pack directory trees into prompt documents.

    python -m sheaf /path/to/repo [/another/root ...] --out OUT_DIR
        [--format markdown|xml] [--no-tree] [--ignore '.*,node_modules,...']
        [--select rel/path,dir ...] [--safe] [--progress]

Lists the roots with the tree DataSource, prunes by the ignore patterns,
expands the selection (default: everything), renders fragments and writes one
document per root under OUT_DIR/root_id=<name>/ with exact bytes; prints the
per-root statistics (files, chars, tokens).  Uses the active cluster session
if there is one, else a local one.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sheaf import api
from sheaf.functions.patterns import DEFAULT_PATTERNS, join_patterns, parse_pattern_string


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(prog="sheaf")
    ap.add_argument("roots", nargs="+")
    ap.add_argument("--out", required=True)
    ap.add_argument("--format", choices=api.format_names(), default="markdown")
    ap.add_argument("--no-tree", action="store_true")
    ap.add_argument("--safe", action="store_true", help="escape paths, split ']]>', lengthen fences")
    ap.add_argument("--ignore", default=join_patterns(DEFAULT_PATTERNS))
    ap.add_argument("--progress", action="store_true", help="print finished and known tasks of each stage while it runs")
    ap.add_argument("--select", default="", help="comma list of rel paths to check (default: the whole root)")
    a = ap.parse_args(argv)

    from sheaf.session import ensure_checkpoint_dir, local_session, pinned_scope, pinned_table
    from sheaf.sources.stores import root_ids

    spark = SparkSession.getActiveSession() or local_session()
    ensure_checkpoint_dir(spark)
    with pinned_scope(spark):
        patterns = parse_pattern_string(a.ignore)
        live = api.LiveProgress(spark, ",".join(root_ids(a.roots)), report=lambda row: print("%s: %s %d/%d" % row[:4], file=sys.stderr) if a.progress else None)
        with live.stage("scanning"):
            entries = api.read_tree(spark, a.roots)  # names and sizes; only selected files are opened below
        pruned = api.prune(entries, patterns=patterns)
        roots = entries.select("root_id").distinct()
        picks = (roots.select("root_id", F.explode(F.array(*map(F.lit, a.select.split(",")))).alias("rel_path"))
                 if a.select else roots.select("root_id", F.lit("").alias("rel_path")))
        sel = api.expand(pruned, picks).filter(~F.col("is_dir") & F.col("checked"))
        with live.stage("reading"):
            contents = pinned_table(api.decoded(api.read_files(sel, root_ids(a.roots))), "contents")  # read once, used three times
        with live.stage("building"):
            tree = None if a.no_tree else api.tree_lines(entries, patterns=patterns)
            frags = api.fragments(sel, contents, a.format, tree=tree, safe=a.safe)
            api.export(frags, a.out)
        for r in api.document_stats(frags).orderBy("root_id").toLocalIterator():
            print(f"{r['root_id']}: {r['n_fragments']} fragments, {r['n_chars']} chars, {r['n_bytes']} bytes, {r['output_tokens']} tokens")
        for r in api.failed_summary(sel, contents).orderBy("root_id", "seq").toLocalIterator():
            print(f"{r['root_id']}: {r['item']}")


if __name__ == "__main__":
    main()

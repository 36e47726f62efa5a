import gzip

import pytest

from sheaf.llm import arc
from sheaf.llm.shared import new_path


def arc_file(version, records):
    out = arc.arc_version_block(version, "old.arc", "19990101000000") + b"\n"
    for url, date, block in records:
        out += arc.arc_line(version, url, "1.2.3.4", date, "text/html", len(block)) + block + b"\n"
    return out


def test_record_lines_of_both_versions():
    block = b"HTTP/1.0 200 OK\r\nX-Source-Id: 7\r\n\r\nbody\n1 0 fake\n"
    for version in (1, 2):
        raw = arc_file(version, [("http://a b/", "19990203040506", block), ("dns:a", "199902030405", b"")])
        for content in (raw, gzip.compress(raw)):
            got = list(arc.arc_records(content))
            assert [(v, f["URL"], b, cut) for v, f, b, cut in got[1:]] == [
                (version, "http://a b/", block, False), (version, "dns:a", b"", False)]
            assert got[0][1]["URL"] == "filedesc://old.arc"
    cut = list(arc.arc_records(arc_file(1, [("http://a/", "19990203040506", block)])[:-9]))
    assert cut[-1][3] and block.startswith(cut[-1][2]) and len(cut) == 2
    with pytest.raises(ValueError):
        list(arc.arc_records(b"nonsense\n"))
    assert list(arc.arc_records(b"")) == []
    assert [arc.iso_date(x) for x in ("19990203040506", "199902030405", "x")] == [
        "1999-02-03T04:05:06Z", "1999-02-03T04:05:00Z", "1970-01-01T00:00:00Z"]


def test_round_trip(spark):
    rows = [(1, "http://x/a b\n", "same"), (5, "http://x/2", "same"), (3, None, "same"), (4, "http://x/4", None),
            (9, "http://x/9", ""), (None, "http://x/n", "same"), (6, "http://x/6", "é\r\n\r\nWARC/1.1\r\n\n1 0 x"),
            (7, "u", "z" * 3_000_000), (8, "u", "HTTP/1.1 200 OK\r\n\r\nx"), (5, "http://x/2", "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS kind", "'x' AS value").repartition(3)
    legacy, out = new_path(spark, "arc"), new_path(spark, "warc")
    arc.write_arc(pages, legacy)
    arc.convert(spark, legacy, out)
    got = arc.read_warc(spark, out, payload=True).collect()
    assert all(r.digest_ok for r in got) and sum(r.record_type == "warcinfo" for r in got) == 3
    pages_got = [r for r in got if r.record_type != "warcinfo"]
    assert len(pages_got) == len(rows) and len({r.record_id for r in got}) == len(got)
    by_id = {r.record_id: r for r in got}
    want = {}
    for i, _, html in rows:
        want.setdefault(i, set()).add(arc.sha1_base32((html or "").encode()))
    for r in pages_got:
        assert r.payload_digest in want[r.source_id]
        if r.record_type == "response":
            assert arc.sha1_base32(r.payload) == r.payload_digest and len(r.payload) == r.payload_bytes
        else:
            of = by_id[r.refers_to_record]
            assert of.record_type == "response" and of.payload_digest == r.payload_digest and of.source_id == r.refers_to
    kinds = {}
    for r in pages_got:
        kinds.setdefault(r.source_id, []).append((r.record_type, r.refers_to))
    assert sorted(kinds[5], key=str) == [("response", None), ("revisit", 5)]
    assert kinds[1] == kinds[3] == kinds[None] == [("revisit", 5)] and kinds[4] == [("revisit", 9)]


def test_small_payloads_stay_and_empty_table(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    legacy, out = new_path(spark, "arc"), new_path(spark, "warc")
    arc.write_arc(pages, legacy)
    arc.convert(spark, legacy, out, revisit_min_bytes=3)
    got = {r.source_id: r.record_type for r in arc.read_warc(spark, out).filter("record_type <> 'warcinfo'").collect()}
    assert got == {1: "response", 2: "response", 3: "revisit", 4: "response"}
    legacy, out = new_path(spark, "arc"), new_path(spark, "warc")
    arc.write_arc(pages.filter("false"), legacy)
    arc.convert(spark, legacy, out)
    assert arc.read_warc(spark, out).filter("record_type <> 'warcinfo'").count() == 0


def test_a_page_with_the_url_of_a_version_block_is_a_page(spark):
    pages = spark.createDataFrame([(1, "filedesc://x", "same"), (2, "http://x/2", "same"), (3, "filedesc:y", "other")],
                                  "page_id long, url string, html string").coalesce(1)
    legacy, out = new_path(spark, "arc"), new_path(spark, "warc")
    arc.write_arc(pages, legacy)
    arc.convert(spark, legacy, out)
    got = {r.source_id: (r.record_type, r.refers_to) for r in arc.read_warc(spark, out).filter("record_type <> 'warcinfo'").collect()}
    assert got == {1: ("revisit", 2), 2: ("response", None), 3: ("response", None)}

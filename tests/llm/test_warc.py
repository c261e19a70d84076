"""Archives of pages that forge records, of other writers, and of edge rows."""

from __future__ import annotations

import base64
import gzip
import hashlib

from newsflow.llm import warc

PAGES = "page_id long, url string, html string, at long, file string, run binary"


def table(spark, pages):
    return spark.createDataFrame([(i, f"u{i}", h, 1, "f", None) for i, h in pages], PAGES)


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_no_header_inside_a_page_ends_the_job(spark):
    forged = [
        "x WARC/1.0\r\nWARC-Type: revisit\r\nX-Payload-Length: abc\r\nContent-Length: 0\r\n\r\n\r\n\r\n",
        "x WARC/1.0\r\nContent-Length: 99999999999999999999999\r\n\r\nq",
        "x WARC/1.0\r\nContent-Length: ١\r\nWARC-Record-ID: \r\n\r\nq",
        "x WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:zz>\r\nWARC-Refers-To: <\r\nContent-Length: 1\r\n\r\nq\r\n\r\n",
    ]
    found = {r.page_id: r for r in warc.archive_report(table(spark, list(enumerate(forged)))).collect()}
    assert {i: r.payload_digest for i, r in found.items()} == {i: digest(h) for i, h in enumerate(forged)}
    assert {r.record_type for r in found.values()} == {"response"}


def test_archives_of_other_writers(spark, tmp_path):
    def record(ident, body, kind="response"):
        return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {ident}\r\nContent-Length: {len(body)}\r\n\r\n{body}\r\n\r\n"

    ident = "<urn:uuid:6a5a3b1e-0c6f-4d0b-8e57-0d3b5a1f2c3d>"
    data = record(ident, "abc") + record("<urn:page:7>", "de") + record("<urn:page:x>", "", "warcinfo")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.gz").write_bytes(gzip.compress(data.encode()))
    found = warc.read_archives(spark, str(tmp_path / "in")).orderBy("at").collect()
    assert [(r.record_id, r.page_id, r.record_type, bytes(r.payload)) for r in found] == [
        (ident, None, "response", b"abc"), ("<urn:page:7>", 7, "response", b"de"), ("<urn:page:x>", None, "warcinfo", b"")
    ]


def test_headers_that_must_be_there(spark, tmp_path):
    records = warc.plan_records(table(spark, [(1, "same"), (2, "same"), (None, "other")]))
    warc.write_archives(records.coalesce(1), str(tmp_path / "out"))
    text = b"".join(gzip.decompress(f.read_bytes()) for f in (tmp_path / "out").glob("*.gz")).decode()
    heads = [h.split("\r\n\r\n")[0] for h in text.split("WARC/1.0\r\n")[1:]]
    assert len(heads) == 3 and all("WARC-Date: 20" in h and "WARC-Record-ID: <" in h and "Content-Length: " in h for h in heads)
    revisit = [h for h in heads if "WARC-Type: revisit" in h]
    assert len(revisit) == 1 and "WARC-Profile: http" in revisit[0] and "WARC-Refers-To: <urn:page:1>" in revisit[0]
    back = warc.read_archives(spark, str(tmp_path / "out")).collect()
    assert sorted(r.page_id or 0 for r in back) == [0, 1, 2]


def test_edge_tables(spark):
    assert warc.archive_report(table(spark, [])).count() == 0
    found = warc.archive_report(table(spark, [(3, "a"), (3, "a"), (5, "a"), (None, "a"), (None, None)])).collect()
    kinds = sorted((r.page_id or 0, r.record_type, r.refers_to) for r in found)
    assert kinds == [(0, "response", None), (0, "response", None), (3, "response", None), (3, "response", None), (5, "revisit", 3)]
    assert {r.payload_digest for r in found if r.page_id is None} == {digest("a"), digest("")}

"""Archives: an exact round trip, assembly of foreign records, odd rows."""

import base64
import gzip
import hashlib

from palimpsest.llm import warc


def test_round_trip(spark, tmp_path):
    rows = [(1, "http://a.b/x", "same"), (2, "http://a.b/y", "same"), (3, None, None), (4, "u", ""), (None, "u", "same"),
            (5, "u", "tail\r\n\r\nWARC/1.1\r\n\r\n"), (5, "u", "tail\r\n\r\nWARC/1.1\r\n\r\n"), (6, "v", "é" * 70000),
            (None, None, "only"), (7, "w", "one"), (7, "w2", "one")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, url string, html string, digest string")
    warc.write_archive(pages, f"{tmp_path}/a", records_per_file=7)
    got = warc.captures(spark, f"{tmp_path}/a").collect()
    want = []
    for page, url, html in rows:
        data = (html or "").encode()
        same = [(p, u or "") for p, u, h in rows if (h or "") == (html or "") and p is not None]
        first = max(same) if same else None
        revisit = first is not None and (page, url or "") != first
        want.append((page, url, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(),
                     "revisit" if revisit else "response", first[0] if revisit else None))
    order = lambda r: str(tuple(r))
    assert sorted(map(tuple, got), key=order) == sorted(want, key=order)
    nested = warc.assemble(warc.read_records(spark, f"{tmp_path}/a")).collect()
    payloads = {r.metadata.page_id: bytes(r.capture.payload) for r in nested if r.capture.type == "response"}
    assert payloads["6"] == ("é" * 70000).encode() and payloads["5"] == b"tail\r\n\r\nWARC/1.1\r\n\r\n"
    assert all(r.request and r.metadata for r in nested)


def test_urls_that_are_no_urls(spark, tmp_path):
    urls = ["http://a b/c", "http://a.b/{id}", "http://a.b/%zz|x", "http://a/\r\nWARC-Type: foo", "http://a/\r\n\r\nb", " http://a.b ",
            "", "\t", "é\x00\x7f", "http://[::1", "http://a.b/%20", None]
    pages = spark.createDataFrame([(i, u, f"page {i // 2}") for i, u in enumerate(urls)], "page_id int, url string, html string")
    warc.write_archive(pages, f"{tmp_path}/a")
    got = warc.captures(spark, f"{tmp_path}/a", "int").collect()
    assert {r.page_id: r.url for r in got} == dict(enumerate(urls)) and len(got) == len(urls)
    assert {r.page_id: r.refers_to for r in got} == {i: None if i % 2 else i + 1 for i in range(len(urls))}


def test_small_payloads_stay_responses_and_empty_table(spark, tmp_path):
    pages = spark.createDataFrame([(1, "a", "xy"), (2, "b", "xy"), (3, "c", "long"), (4, "d", "long")],
                                  "page_id bigint, url string, html string")
    warc.write_archive(pages, f"{tmp_path}/a", min_bytes=3)
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.captures(spark, f"{tmp_path}/a").collect()}
    assert got == {1: ("response", None), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None)}
    warc.write_archive(pages.filter("page_id < 0"), f"{tmp_path}/none")
    assert warc.captures(spark, f"{tmp_path}/none").collect() == []


def test_foreign_records_without_request(spark, tmp_path):
    def record(kind, ident, extra, block):
        head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {ident}\r\n{extra}Content-Length: {len(block)}\r\n\r\n"
        return gzip.compress(head.encode() + block + b"\r\n\r\n")
    (tmp_path / "w.gz").write_bytes(record("warcinfo", "<i>", "", b"software: x")
                                    + record("response", "<r>", "", b"HTTP/1.1 200 OK\r\n\r\nhi")
                                    + record("metadata", "<m>", "WARC-Concurrent-To: <r>\r\n", b"fetchTimeMs: 5"))
    (row,) = warc.assemble(warc.read_records(spark, str(tmp_path))).collect()
    assert bytes(row.capture.payload) == b"hi" and row.request is None and row.metadata.record_id == "<m>"

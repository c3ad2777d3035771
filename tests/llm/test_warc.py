import base64
import glob
import hashlib
import re

from voltaic.llm import queries, warc
from voltaic.session import scratch_path


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def expected(rows, min_bytes=0):
    out = []
    for page, html in rows:
        same = [p for p, h in rows if (h or "") == (html or "") and p is not None]
        size = len((html or "").encode())
        kept = max(same) if same and size >= min_bytes else None
        other = kept if kept is not None and page != kept else None
        out.append((page, size, digest(html), "response" if other is None else "revisit", other))
    return sorted(out, key=str)


ROWS = [(1, "http://a/1", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "http://a b\r\nHost: c", "<p>x</p>"), (4, "u", None), (5, "u", ""),
        (None, "u", "<p>x</p>"), (None, "u", "only here"), (6, "u", "é" * 70_000), (7, "u", "\r\n\r\nWARC/1.1\r\n"), (3, "u", "<p>x</p>"),
        (8, "u", "<p>x</p>")]


def write_read(spark, rows, **options):
    pages = spark.createDataFrame([(*r, "z", 1) for r in rows], "page_id long, url string, html string, row string, size int")
    out = scratch_path(spark, "w")
    files = warc.write_warc(pages, out, **options)
    got = warc.read_warc(spark, out, files)
    return out, sorted((tuple(r) for r in got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


def test_edge_rows(spark):
    _, got = write_read(spark, ROWS)
    assert got == expected([(p, h) for p, _, h in ROWS])


def test_small_payloads_are_all_responses(spark):
    _, got = write_read(spark, ROWS, min_bytes=9)
    assert got == expected([(p, h) for p, _, h in ROWS], 9)
    assert {r[3] for r in got} == {"response"}


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    out = scratch_path(spark, "w")
    files = warc.write_warc(pages, out)
    assert files.count() == 0 and warc.read_warc(spark, out, files).collect() == []


def test_archive_layout_dictionary_and_single_records(spark):
    rows = [(i, f"http://h/{i}", f"<html><body><p>{'common words of every page ' * 20}{i}</p></body></html>") for i in range(600)]
    out, got = write_read(spark, [*rows, (601, "http://h/601", rows[5][2])], sample_bytes=200_000)
    assert got == expected([(p, h) for p, _, h in rows] + [(601, rows[5][2])])
    payloads = {}
    for path in glob.glob(re.sub("^file:", "", out) + "/part-*.warc.zst"):
        raw = open(path, "rb").read()
        assert int.from_bytes(raw[:4], "little") == warc.SKIPPABLE_MAGIC
        for record in warc.read_frames(raw):
            rec = warc.parse_record(record)
            payloads[rec["fields"]["X-Page-ID"]] = rec
    assert payloads["7"]["payload"].decode() == rows[7][2]
    assert payloads["5"]["payload"] == b"" and payloads["5"]["fields"]["WARC-Refers-To"] == payloads["601"]["fields"]["WARC-Record-ID"]
    assert payloads["5"]["fields"]["WARC-Profile"] == warc.REVISIT_PROFILE


def test_query_on_the_smallest_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html").collect()
    assert sorted((tuple(r) for r in queries.op2_warc(spark, sf).collect()), key=str) == expected([tuple(r) for r in rows])

"""Archives against the pages that they were written from."""

import gzip
import hashlib

from meterwise.llm import registry, warc

SCHEMA = "page_id long, url string, html string, record_type string"


def table(spark, rows, chunk=warc.CHUNK, **options):
    pages = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA).repartition(2)
    archives = warc.write_archives(warc.chunk_rows(warc.records(pages), chunk), **options)
    read = warc.read_archives(spark, archives, chunk)
    return archives, read


def expected(rows):
    keeper = {}
    for page, _, html in rows:
        raw = (html or "").encode()
        if len(raw) >= 1000 and page is not None:
            keeper[raw] = max(page, keeper.get(raw, page))
    result = []
    for page, _, html in rows:
        raw = (html or "").encode()
        other = raw in keeper and keeper[raw] != page
        result.append(("" if page is None else str(page), len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if other else "response", str(keeper[raw]) if other else None))
    return sorted(result, key=str)


ROWS = [
    (1, "http://a/", "x" * 999), (2, "http://a/", "x" * 999), (3, "http://b/\r\nX: y", "é" * 500), (4, None, "é" * 500), (5, "u", None), (6, "u", ""),
    (7, "http://ü/ x", "long" * 200_000), (8, "u", "long" * 200_000), (8, "u", "long" * 200_000), (None, "u", "é" * 500), (None, "u", "z"), (9, "u", "WARC/1.1\r\n\r\n" * 200),
]


def test_round_trip_with_small_chunks(spark):
    archives, read = table(spark, ROWS, chunk=1000, file_bytes=100_000)
    assert archives.count() > 1
    got = [tuple(r) for r in warc.record_table(read).collect()]
    assert sorted(got, key=str) == expected(ROWS)


def test_payloads_and_incremental_digests(spark):
    _, read = table(spark, ROWS, chunk=1000)
    payloads = {}
    for row in read.orderBy("record_id", "chunk_no").where("record_id = '7' or record_id = '4'").collect():
        payloads[row.record_id] = payloads.get(row.record_id, b"") + row.chunk
        assert row.digest_so_far == hashlib.sha1(payloads[row.record_id]).hexdigest() and row.bytes_so_far == len(payloads[row.record_id])
        assert len(row.chunk) <= 1000
    # Page 4 is the larger of the two equal ones; page 7 is a revisit of page 8.
    assert payloads == {"7": b"", "4": ("é" * 500).encode()}


def test_every_record_is_a_gzip_member_of_warc_lines(spark):
    archives, _ = table(spark, ROWS[:4])
    for row in archives.collect():
        with gzip.open(row.path.removeprefix("file:")) as stream:
            raw = stream.read()
        assert raw.count(b"WARC/1.1\r\nWARC-Type: ") == row.records and raw.endswith(b"\r\n\r\n")
        assert b"X: y\r\n" not in raw


def test_broken_chunks_are_refused(spark):
    import pytest

    pages = spark.createDataFrame([(1, "u", "abc" * 1000, "")], SCHEMA)
    chunks = warc.chunk_rows(warc.records(pages), 100).where("chunk_no <> 3")
    with pytest.raises(Exception, match="does not follow"):
        warc.write_archives(chunks)


def test_no_pages(spark):
    archives, read = table(spark, [])
    assert archives.count() == 0 and warc.record_table(read).count() == 0


def test_query(spark):
    rows = registry.op1_warc_chunks(spark, "/root/testdata/sf0.001")
    assert rows.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"] and rows.count() == 50

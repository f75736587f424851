import hashlib

import pytest

from feedloom.llm import warc
from feedloom.llm.common import new_path

BIG = "<p>paragraph über alles</p>" * 400


@pytest.mark.parametrize("size", [0, 1, 4095, 4096, 10_000])
def test_chunked_framing(size):
    payload = bytes(range(256)) * 40
    assert warc.unchunked(warc.chunked(payload[:size], 4096)) == payload[:size]


def test_chunk_extensions_and_faults():
    assert warc.unchunked(b"3;name=x\r\nabc\r\n0\r\ntrailer: y\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.unchunked(b"3\r\nabcd\r\n0\r\n\r\n")


def test_round_trip(spark):
    pages = [(1, "http://a/ x\r\n", BIG), (2, None, BIG), (3, "u", "short"), (4, "u", "short"), (5, "u", None), (6, "u", BIG + "x"),
             (6, "u", BIG + "x"), (None, "u", BIG), (7, "u", "WARC/1.1\r\n\r\n" * 500), (-8, "u", "x" * 999), (-9, "u", "x" * 999)]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").repartition(3)
    folder = new_path(spark, "warc")
    warc.write_archives(df, folder, segment_bytes=1500, chunked_from=2000, records_per_file=5)
    rows = warc.read_pages(spark, folder).collect()
    assert len(rows) == len(pages)
    revisits = {r["page_id"]: r["refers_to"] for r in rows if r["record_type"] == "revisit"}
    assert revisits == {1: 2}
    for row in rows:
        want = [(h or "").encode() for i, _, h in pages if i == row["page_id"]]
        assert row["payload_bytes"] == len(want[0]) and row["payload_digest"] == hashlib.sha1(want[0]).hexdigest()
        assert row["record_type"] == "revisit" or bytes(row["payload"]) == want[0]
    kinds = {r["kind"]: r["n"] for r in warc.read_records(spark, folder).groupBy("kind").count().withColumnRenamed("count", "n").collect()}
    assert kinds["continuation"] > 10


def test_records_are_gzip_members():
    import gzip

    members = list(warc.records_of("1#0-0", "http://x", b"y" * 100, None, 60))
    assert all(m[-1] == 0 for m in members)
    assert gzip.decompress(b"".join(members)).count(b"WARC/1.1") == len(members) == 3


def test_a_lost_segment_is_found(spark):
    members = list(warc.records_of("1#0-0", None, b"y" * 100, None, 60))
    rows = [tuple(warc.parse_record(__import__("gzip").decompress(m))[k] for k in ("segment", "total", "block")) for m in members]
    assert [r[0] for r in rows] == [1, 2, 3] and rows[-1][1] == sum(len(r[2]) for r in rows)


def test_no_pages(spark):
    df = spark.createDataFrame([], "page_id bigint, url string, html string")
    folder = new_path(spark, "warc")
    warc.write_archives(df, folder)
    assert warc.read_pages(spark, folder).count() == 0

"""WARC archives: segmented records, chunked transfer framing and revisits, written and read by Spark.

Every record is a gzip member of its own. A response whose block is longer than `segment_bytes` is cut: the first record has
WARC-Segment-Number 1, the rest are continuation records that name the first as their origin, the last of them with the total
length. Payloads from `chunked_from` bytes are framed as chunked transfer encoding, as a server would send them. A payload that
another record already holds is written as a revisit with headers only.

Reading groups segments by origin, orders them by number, checks the total length, decodes the framing and checks the digest; a
record that does not fit raises an error.

Spark's text sink writes the files. It ends every row with a zero byte, which is the last byte of a gzip member of less than
16 MiB, so a file is exactly the members one after another.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm.common import prepare, stored

REVISIT_FROM = 1000
SEGMENT_BYTES = 32 * 1024
CHUNKED_FROM = 4096
CHUNK_BYTES = 4096
RECORDS_PER_FILE = 2000
DATE = "1970-01-01T00:00:00Z"
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")
_RECORD = (
    "page_id bigint, kind string, record_id string, origin string, segment int, total bigint, refers_to bigint, digest string,"
    " block binary"
)
_PAGE = "page_id bigint, record_type string, refers_to bigint, payload_digest string, payload_bytes bigint, payload binary"


def _header(fields: list[tuple[str, object]], length: int) -> bytes:
    lines = ["WARC/1.1", *(f"{name}: {value}" for name, value in fields if value is not None), f"Content-Length: {length}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n"


def _member(fields: list[tuple[str, object]], block: bytes) -> bytes:
    data = gzip.compress(_header(fields, len(block)) + block + b"\r\n\r\n", 6, mtime=0)
    if data[-1]:
        raise ValueError("a record must be shorter than 16 MiB")
    return data


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer framing of a payload."""
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%s\r\n" % (len(part), part) for part in parts) + b"0\r\n\r\n"


def unchunked(data: bytes) -> bytes:
    """The payload in chunked framing; extensions of a chunk and trailing fields are skipped."""
    parts, at = [], 0
    while True:
        end = data.index(b"\r\n", at)
        size = int(data[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(parts)
        if data[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk does not end where its size says")
        parts.append(data[at : at + size])
        at += size + 2


def records_of(
    name: str, url: str | None, payload: bytes, refers_to: int | None, segment_bytes: int = SEGMENT_BYTES,
    chunked_from: int = CHUNKED_FROM, date: str = DATE,
) -> Iterator[bytes]:
    """Gzip members of one page: a revisit, or a response in one or more segments."""
    digest = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    common = [("WARC-Date", date), ("WARC-Target-URI", url and _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url))]
    framed = refers_to is None and len(payload) >= chunked_from
    field = "Transfer-Encoding: chunked" if framed else f"Content-Length: {len(payload)}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{field}\r\n\r\n".encode()
    http_type = ("Content-Type", "application/http; msgtype=response")
    record = ("WARC-Record-ID", f"<urn:page:{name}>")
    if refers_to is not None:
        profile = ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        yield _member(
            [("WARC-Type", "revisit"), record, *common, profile, ("WARC-Refers-To", f"<urn:page:{refers_to}>"),
             ("WARC-Payload-Digest", digest), http_type], http,
        )
        return
    block = http + (chunked(payload) if framed else payload)
    cuts = range(0, len(block), segment_bytes)
    for k, at in enumerate(cuts, 1):
        several = len(cuts) > 1
        kind = [("WARC-Type", "response"), record] if k == 1 else [
            ("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:page:{name}/{k}>"), ("WARC-Segment-Origin-ID", f"<urn:page:{name}>")
        ]
        yield _member(
            [*kind, *common, ("WARC-Segment-Number", k if several else None),
             ("WARC-Segment-Total-Length", len(block) if several and k == len(cuts) else None),
             ("WARC-Payload-Digest", digest if k == 1 else None), http_type if k == 1 else ("Content-Type", None)],
            block[at : at + segment_bytes],
        )


def with_revisits(pages: DataFrame, revisit_from: int = REVISIT_FROM) -> DataFrame:
    """(page_id, url, html, refers_to): of pages with equal payloads of at least `revisit_from` bytes the one with the largest id
    is kept, the others refer to it. Null html is empty. Rows without an id, and rows that repeat the kept one, refer to nothing."""
    long = F.octet_length("html") >= revisit_from
    keyed = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn(
        # A page that is too short keeps a key of its own, so that short pages do not meet in one task.
        "key", F.when(long, F.sha2("html", 256)).otherwise(F.concat(F.lit("-"), F.xxhash64("html", "page_id")))
    )
    holders = stored(
        keyed.filter(long & F.col("page_id").isNotNull()).groupBy("key")
        .agg(F.max("page_id").alias("holder"), F.count("*").alias("n")).filter("n > 1").select("key", "holder"),
        "payload-holders",
    )
    return keyed.join(holders, "key", "left").select(
        "page_id", "url", "html", F.when(F.col("page_id") < F.col("holder"), F.col("holder")).alias("refers_to")
    )


def write_archives(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    segment_bytes: int = SEGMENT_BYTES, chunked_from: int = CHUNKED_FROM, records_per_file: int = RECORDS_PER_FILE,
) -> None:
    """Write every page. A file holds at most `records_per_file` records of at most `segment_bytes` each."""
    if segment_bytes > 2**23:
        raise ValueError("segments must stay below 8 MiB")
    prepare(pages.sparkSession)
    rows = with_revisits(pages.select(
        F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")
    ))

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            for page, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                # The page's id, and a number that tells rows with one id apart.
                name, n = f"{'' if page is None else page}#{part}-{n}", n + 1
                out = [m[:-1] for m in records_of(name, url, html.encode(), refers_to, segment_bytes, chunked_from)]
                yield pa.RecordBatch.from_pydict({"value": pa.array(out, pa.binary())})

    (
        rows.select("page_id", "url", "html", "refers_to").mapInArrow(members, "value binary")
        .select(F.col("value").cast("string").alias("value"))
        .write.option("lineSep", "\u0000").option("maxRecordsPerFile", records_per_file).text(folder)
    )


def _members(content: memoryview) -> Iterator[bytes]:
    """The inflated gzip members of a file, one by one."""
    at = 0
    while at < len(content):
        inflate, parts = zlib.decompressobj(31), []
        while not inflate.eof:
            piece = content[at : at + 65536]
            if not len(piece):
                raise ValueError("the archive ends inside a record")
            parts.append(inflate.decompress(piece))
            at += len(piece) - len(inflate.unused_data)
        yield b"".join(parts)


def _page(urn: str) -> int | None:
    number = re.match(r"<urn:page:(-?\d*)", urn)[1]
    return int(number) if number else None


def parse_record(data: bytes) -> dict:
    """Fields of one record, see _RECORD."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {name.lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}
    length = int(fields["content-length"])
    if rest[length:] != b"\r\n\r\n":
        raise ValueError("a block does not end where its length says")
    record = fields["warc-record-id"]
    number = fields.get("warc-segment-number")
    refers, digest, total = (fields.get(k) for k in ("warc-refers-to", "warc-payload-digest", "warc-segment-total-length"))
    return {
        "page_id": _page(record), "kind": fields["warc-type"], "record_id": record,
        "origin": fields.get("warc-segment-origin-id", record) if number else None, "segment": number and int(number),
        "total": total and int(total), "refers_to": refers and _page(refers),
        "digest": digest and base64.b32decode(digest.removeprefix("sha1:")).hex(), "block": rest[:length],
    }


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of the archives as it stands in the files."""
    prepare(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).filter("length > 0").select("content")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            ("page_id", pa.int64()), ("kind", pa.string()), ("record_id", pa.string()), ("origin", pa.string()),
            ("segment", pa.int32()), ("total", pa.int64()), ("refers_to", pa.int64()), ("digest", pa.string()), ("block", pa.binary()),
        ])
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for data in _members(memoryview(content.as_buffer())):
                    rows.append(parse_record(data))
                    if len(rows) == 100:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return files.mapInArrow(parse, _RECORD)


def _decoded(row: dict, block: bytes) -> dict:
    """The page of a whole block: framing undone, length and digest checked."""
    head, _, body = block.partition(b"\r\n\r\n")
    fields = {n.lower(): v.strip() for n, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:])}
    revisit = row["kind"] == "revisit"
    size = int(fields["content-length"]) if "content-length" in fields else None
    payload = None
    if not revisit:
        payload = unchunked(body) if fields.get("transfer-encoding") == "chunked" else body
        if size not in (None, len(payload)) or hashlib.sha1(payload).hexdigest() != row["digest"]:
            raise ValueError(f"payload of {row['record_id']} does not fit its headers")
    return {
        "page_id": row["page_id"], "record_type": row["kind"], "refers_to": row["refers_to"], "payload_digest": row["digest"],
        "payload_bytes": size if payload is None else len(payload), "payload": payload,
    }


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, record_type, refers_to, payload_digest, payload_bytes, payload) of every page in the archives; a revisit has no
    payload of its own. Only segmented records are shuffled; a task holds one payload at a time."""
    schema = pa.schema([
        ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()),
        ("payload_bytes", pa.int64()), ("payload", pa.binary()),
    ])
    records = read_records(spark, folder)

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([_decoded(row, row["block"]) for row in batch.to_pylist()], schema)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, parts, last = None, [], None

        def close() -> pa.RecordBatch:
            block = b"".join(parts)
            if last["total"] != len(block):
                raise ValueError(f"segments of {first['record_id']} do not add up to their total length")
            return pa.RecordBatch.from_pylist([_decoded(first, block)], schema)

        for batch in batches:
            for row in batch.to_pylist():
                if row["segment"] == 1:
                    if first is not None:
                        yield close()
                    first, parts = row, []
                elif first is None or row["origin"] != first["record_id"] or row["segment"] != len(parts) + 1:
                    raise ValueError(f"segment {row['segment']} of {row['origin']} does not follow the one before it")
                parts.append(row["block"])
                last = row
        if first is not None:
            yield close()

    segments = records.filter("segment is not null").repartition("origin").sortWithinPartitions("origin", "segment")
    return records.filter("segment is null").mapInArrow(single, _PAGE).unionByName(segments.mapInArrow(joined, _PAGE))

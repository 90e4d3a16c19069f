"""WARC: one gzip member per record, read sequentially with incremental decompression and digest checks."""

from __future__ import annotations

import base64
import datetime
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caseweave.llm.shared import open_folder, partitions, shared_path, store

REVISIT_BYTES = 1000
CHUNK = 1 << 16
DATE = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value of the format


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record_id(number: int | None, copy: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{number}:{copy}')}>"


def _printable(value: str | None) -> str:
    """A header value on one line; an absent one is empty."""
    return "".join(c if c > " " else "%%%02X" % ord(c) for c in value or "")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, copy: int = 1) -> bytes:
    """A response or revisit record. A revisit keeps the HTTP header, with the length of the payload it leaves out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_record_id(page_id, copy)}",
        f"WARC-Date: {DATE:%Y-%m-%dT%H:%M:%SZ}",
        f"WARC-Target-URI: {_printable(url)}",
        "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: {_digest(payload)}",
        f"WARC-Block-Digest: {_digest(block)}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers_to, 1)}", f"X-Refers-To-Page-ID: {refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    plain = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(plain) + packer.flush()


def members(file, chunk: int = CHUNK) -> Iterator[bytes]:
    """Decompressed gzip members of a stream, read in chunks; a member that is cut off is an error."""
    unpacker, parts = zlib.decompressobj(31), []
    started = False
    while data := file.read(chunk):
        while data:
            started = True
            parts.append(unpacker.decompress(data))
            data = unpacker.unused_data
            if unpacker.eof:
                yield b"".join(parts)
                unpacker, parts, started = zlib.decompressobj(31), [], False
    if started:
        raise ValueError("the archive ends within a record")


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of the one record of a member, framed by its content length."""
    head, found, rest = member.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not found or not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    length = int(fields["content-length"])
    if rest[length:] != b"\r\n\r\n":
        raise ValueError("the content length does not frame the record")
    return fields, rest[:length]


def verified(member: bytes) -> tuple[dict[str, str], bytes, int]:
    """Headers, payload found in the record and length of the whole payload, after all digests are checked."""
    fields, block = parse(member)
    if _digest(block) != fields["warc-block-digest"]:
        raise ValueError("a block digest does not match")
    head, _, payload = block.partition(b"\r\n\r\n")
    http = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:])}
    length = int(http["content-length"])
    if fields["warc-type"] == "response" and (_digest(payload) != fields["warc-payload-digest"] or len(payload) != length):
        raise ValueError("a payload digest or length does not match")
    return fields, payload, length


def write_archives(pages: DataFrame, folder: str | None = None, least: int = REVISIT_BYTES) -> DataFrame:
    """Write a record for every page, one archive per task; returns the manifest: path, records, bytes.

    Of pages with equal payloads of at least ``least`` bytes the one with the largest page_id is the response and
    the others are revisits of it. Which page refers to which is found on digests alone; the pages move once, to their
    id's archive. Null html is empty; pages with a null id are responses; rows repeated with the same id and payload
    are one response and revisits of it. Archives of failed attempts are in no manifest. An empty table gives an
    empty manifest; other columns are ignored.
    """
    spark = pages.sparkSession
    folder = folder or shared_path(spark, "warc")
    system, path = open_folder(folder)
    system.create_dir(path, recursive=True)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    payload = F.encode(F.col("html"), "UTF-8")
    marks = rows.select("page_id", F.sha1(payload).alias("digest"), F.octet_length("html").alias("size"))
    marks = store(marks.filter((F.col("size") >= least) & F.col("page_id").isNotNull()), "digests")
    groups = marks.groupBy("digest").agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("pages"))
    targets = marks.join(groups.filter("pages > 1"), "digest").select("page_id", "digest", "response").distinct()
    same = [F.col("page_id") == F.col("__page"), F.sha1(payload) == F.col("digest")]
    found = rows.join(targets.withColumnRenamed("page_id", "__page"), same[0] & same[1], "left")
    # Rows without an id are no copies of each other, so they need not meet.
    found = found.withColumn("apart", F.when(F.col("page_id").isNull(), F.monotonically_increasing_id()))
    turn = W.partitionBy("page_id", F.sha1(payload), "apart").orderBy("url")
    copy = F.when(F.col("response").isNull(), F.lit(1)).otherwise(F.row_number().over(turn))
    found = found.withColumn("copy", copy).withColumn(
        "refers_to", F.when((F.col("response") != F.col("page_id")) | (F.col("copy") > 1), F.col("response"))
    )
    found = found.select("page_id", "url", "html", "refers_to", "copy")

    def write(batches):
        name = f"pages-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
        system, path = open_folder(folder)
        records = size = 0
        with system.open_output_stream(f"{path}/{name}", compression=None) as out:
            for batch in batches:
                for page_id, url, html, refers_to, copy in zip(*(c.to_pylist() for c in batch.columns)):
                    packed = record(page_id, url, html.encode(), refers_to, copy)
                    out.write(packed)
                    records, size = records + 1, size + len(packed)
        if records:
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": [records], "bytes": [size]})

    return store(found.mapInArrow(write, "path string, records long, bytes long"), "manifest")


def read_archives(manifest: DataFrame, batch_rows: int = 512, payloads: bool = True) -> DataFrame:
    """Read archives from start to end: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (null for revisits).

    Without ``payloads`` there is no such column: they are verified, and stay where they were read.
    """
    columns = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"][: 6 + payloads]

    def read(frames):
        for frame in frames:
            for uri in frame["path"]:
                system, path = open_folder(uri)
                rows = []
                with system.open_input_stream(path, compression=None) as file:
                    for member in members(file):
                        fields, payload, length = verified(member)
                        kind = fields["warc-type"]
                        digest = base64.b32decode(fields["warc-payload-digest"].partition(":")[2]).hex()
                        refers = fields.get("x-refers-to-page-id")
                        rows.append((
                            int(fields["x-page-id"]) if fields["x-page-id"] else None, fields["warc-target-uri"], length, digest, kind,
                            int(refers) if refers else None, *([payload if kind == "response" else None] if payloads else []),
                        ))
                        if len(rows) == batch_rows:
                            yield pd.DataFrame(rows, columns=columns).astype({"page_id": "Int64", "refers_to": "Int64"})
                            rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=columns).astype({"page_id": "Int64", "refers_to": "Int64"})

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads
    return manifest.select("path").repartition(partitions(manifest.sparkSession), "path").mapInPandas(read, schema)


def archived_pages(pages: DataFrame, folder: str | None = None, least: int = REVISIT_BYTES, payloads: bool = True) -> DataFrame:
    """Write all pages as archives and read them back."""
    return read_archives(write_archives(pages, folder, least), payloads=payloads)

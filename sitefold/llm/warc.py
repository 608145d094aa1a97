"""WARC archives (operator 6): one gzip member per record, written and read in sequence.

The reader takes a gzip stream piece by piece: it inflates one member after another, splits header
and block by Content-Length, and checks the block and payload digests. It holds one record at a time.
Tasks open archives by URI, so local, HDFS, S3 and GCS folders work alike.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, staged, text_of

VERSION, STEP = b"WARC/1.1", 1 << 18
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARCHIVE_BYTES = 256 << 20


def digest(data: bytes) -> str:
    """Upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _files(uri: str):
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), urlsplit(uri).path
    return fs.FileSystem.from_uri(uri)


def _header(fields: list[tuple[str, str]]) -> bytes:
    clean = ((k, v.replace("\r", "%0D").replace("\n", "%0A")) for k, v in fields)
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in clean).encode() + b"\r\n"


def record(name: str, url: str | None, payload: bytes, refers_to: str | None, date: str) -> bytes:
    """A gzip member: a response with its payload, or a revisit with the HTTP head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{name}>"), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", url))
    if refers_to is not None:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    fields += [("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("WARC-Block-Digest", f"sha1:{digest(block)}")]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress(_header(fields) + block + b"\r\n\r\n") + deflate.flush()


def read_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of each record of a gzip stream, in order.

    Raises ValueError where a member is cut short, a length does not fit, or a digest differs.
    """
    waiting = b""
    while True:
        if not waiting and not (waiting := stream.read(STEP)):
            return
        inflate, parts = zlib.decompressobj(31), []
        while not inflate.eof:
            if not waiting and not (waiting := stream.read(STEP)):
                raise ValueError("the archive ends inside a record")
            parts.append(inflate.decompress(waiting))
            waiting = inflate.unused_data
        yield _parsed(b"".join(parts))


def _parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    head, gap, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if not gap or not version.startswith(b"WARC/1."):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.decode().partition(":") for x in lines)}
    length = int(fields["content-length"])
    block = rest[:length]
    if len(block) != length or rest[length:] != b"\r\n\r\n":
        raise ValueError("Content-Length does not frame the block")
    if "warc-block-digest" in fields and fields["warc-block-digest"] != f"sha1:{digest(block)}":
        raise ValueError("the block digest differs")
    if fields["warc-type"] == "response" and fields["warc-payload-digest"] != f"sha1:{digest(block.partition(b'\r\n\r\n')[2])}":
        raise ValueError("the payload digest differs")
    return fields, block


def revisits(pages: DataFrame, least_bytes: int) -> DataFrame:
    """(page_id, hash, refers_to) of the pages whose payload a page of smaller id has, without the payloads."""
    payload = text_of("html").cast("binary")
    light = staged(pages.where(F.length(payload) >= least_bytes).select("page_id", F.sha1(payload).alias("hash")), "payloads")
    groups = light.groupBy("hash").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n"))
    groups = staged(groups.where("n > 1 and refers_to is not null").drop("n"), "copies")
    found = light.join(groups, "hash").where("page_id is null or page_id <> refers_to")
    return staged(found.distinct(), "revisits")


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes a record per row of ``pages`` (page_id, url, html); returns (path, records, bytes) per archive.

    A task writes archives of up to ``ARCHIVE_BYTES`` under names of its own, so a task that runs again
    leaves nothing that the returned table knows of. A null html is an empty payload; a null url
    leaves out the target; a null page_id is written as null and never referred to; rows that repeat
    the smallest id of a payload are all responses. An empty table gives no archive.
    """
    links = revisits(pages, least_bytes).select(F.col("page_id").alias("page_"), F.col("hash").alias("hash_"), "refers_to")
    payload = text_of("html").cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"))
    same = F.col("page_id").eqNullSafe(F.col("page_")) & (F.sha1("payload") == F.col("hash_"))
    rows = rows.join(links, same, "left").select("page_id", "url", "payload", "refers_to")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, base = _files(folder)
        files.create_dir(base, recursive=True)
        out, done, n, size = None, [], 0, 0
        for batch in batches:
            for page, url, payload, refers in zip(batch.page_id, batch.url, batch.payload, batch.refers_to, strict=True):
                if out is None:
                    path = f"{base.rstrip('/')}/{uuid.uuid4().hex}.warc.gz"
                    out, n, size = files.open_output_stream(path, compression=None), 0, 0
                name = lambda x: None if pd.isna(x) else str(int(x))
                data = record(name(page) or "null", url, bytes(payload), name(refers), date)
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= ARCHIVE_BYTES:
                    out.close()
                    done.append((path, n, size))
                    out = None
        if out is not None:
            out.close()
            done.append((path, n, size))
        yield pd.DataFrame(done, columns=["path", "records", "bytes"])

    types = {"page_id": "string", "refers_to": "string"}  # as text, a null among longs stays exact
    rows = rows.select(*(F.col(c).cast(types[c]).alias(c) if c in types else F.col(c) for c in rows.columns))
    scheme = folder.split("://", 1)[0] if "://" in folder and not folder.startswith("file:") else ""
    prefix = f"{scheme}://" if scheme else ""
    written = staged(rows.mapInPandas(write, "path string, records long, bytes long"), "archives")
    return written.withColumn("path", F.concat(F.lit(prefix), "path"))


RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """One row per record of the archives in column ``path``; revisits have no payload of their own."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [x.split()[0] for x in RECORD.split(", ")]
        ident = lambda x: None if x is None or x == "<urn:page:null>" else int(x[len("<urn:page:") : -1])
        for batch in batches:
            for path in batch.path:
                files, base = _files(path)
                rows, held = [], 0
                with files.open_input_stream(base, compression=None) as stream:
                    for fields, block in read_records(stream):
                        head, _, body = block.partition(b"\r\n\r\n")
                        n = next(int(x.partition(b":")[2]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                        rows.append((ident(fields["warc-record-id"]), fields.get("warc-target-uri"), fields["warc-type"], ident(fields.get("warc-refers-to")), n, fields["warc-payload-digest"].removeprefix("sha1:"), body if payloads and fields["warc-type"] == "response" else None))
                        held += len(block) * payloads + 200
                        if held > 8 << 20:
                            yield pd.DataFrame(rows, columns=columns).astype({"page_id": "Int64", "refers_to": "Int64"})
                            rows, held = [], 0
                yield pd.DataFrame(rows, columns=columns).astype({"page_id": "Int64", "refers_to": "Int64"})

    # One archive may be much of the input: a task for each, which adaptive execution may not merge.
    return archives.select("path").repartitionByRange(max(1, archives.count()), "path").mapInPandas(read, RECORD)


def archive_round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """The columns of query op6, from archives in the shared folder."""
    folder = scratch(pages.sparkSession, "warc")
    archives = write_archives(pages, folder, least_bytes)
    return read_archives(archives, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")

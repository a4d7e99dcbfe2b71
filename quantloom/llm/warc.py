"""WARC archives: writing, normalising whole-file gzip streams into a member per record, and reading by offset index."""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import fresh_path, materialize

LEAST_BYTES, ARCHIVE_BYTES, LEVEL, PIECE = 100, 64 << 20, 1, 1 << 18
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def located(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def record_header(page_id: int | None, url: str | None, digest: str, refers_to: int | None, payload: bytes) -> tuple[bytes, bytes]:
    """Header of a WARC record, and its HTTP header. A revisit has no body; its HTTP header keeps the payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    lines = [f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    size = len(http) + (len(payload) if refers_to is None else 0)
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {size}"]
    return ("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode(), http


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write (page_id, url, html, digest, refers_to) as monolithic archives, each one gzip stream; returns their paths.

    Every attempt of a task writes files of its own names and only the finished attempt returns them.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = located(folder)
        store.create_dir(root, recursive=True)
        out, gz, raw, paths = None, None, 0, []

        def close() -> None:
            out.write(gz.flush())
            out.close()

        for batch in batches:
            for row in batch.to_pylist():
                if out is None or raw >= ARCHIVE_BYTES:
                    if out is not None:
                        close()
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    paths.append(f"{folder}/{name}")
                    out, gz, raw = store.open_output_stream(f"{root}/{name}", compression=None), zlib.compressobj(LEVEL, zlib.DEFLATED, 31), 0
                payload = (row["html"] or "").encode()
                head, http = record_header(row["page_id"], row["url"], row["digest"], row["refers_to"], payload)
                record = head + http + (payload if row["refers_to"] is None else b"") + b"\r\n\r\n"
                raw += len(record)
                out.write(gz.compress(record))
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], ["path"])

    return materialize(records.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(write, "path string"), "archives")


class Inflated:
    """A gzip file, of one or many members, inflated once from its beginning in pieces of bounded size."""

    def __init__(self, source):
        self.source, self.gz, self.held = source, zlib.decompressobj(31), b""
        self.rest = b""

    def more(self) -> bool:
        while True:
            data = self.rest or self.gz.unconsumed_tail or self.source.read(PIECE)
            self.rest = b""
            if not data:
                return False
            if self.gz.eof:
                self.gz = zlib.decompressobj(31)
            got = self.gz.decompress(data, PIECE * 4)
            if self.gz.eof:
                self.rest = self.gz.unused_data
            if got:
                self.held += got
                return True

    def header(self) -> bytes | None:
        """Up to the next blank line, or None at the end of the archive."""
        while (end := self.held.find(b"\r\n\r\n")) < 0:
            if not self.more():
                if self.held.strip():
                    raise ValueError("the archive ends inside a record's header")
                return None
        head, self.held = self.held[: end + 4], self.held[end + 4 :]
        return head

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.held and not self.more():
                raise ValueError("the archive ends inside a record")
            part, self.held = self.held[:n], self.held[n:]
            n -= len(part)
            yield part


def fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:] if x)}


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Inflate each archive of (path) once, rewrite every record as its own gzip member, write a sidecar offset index.

    Returns the index, (path, offset, length, record_id); beside each archive a text file .idx holds its rows. Records of
    any size stream through in pieces; an archive that ends early raises.
    """

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, root = located(folder)
        target.create_dir(root, recursive=True)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, at = located(path)
                name, offset, rows = f"{uuid.uuid4().hex}.warc.gz", 0, []
                with store.open_input_stream(at, compression=None) as source, target.open_output_stream(f"{root}/{name}", compression=None) as out:
                    stream = Inflated(source)
                    while (head := stream.header()) is not None:
                        gz = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                        known = fields(head)
                        out.write(gz.compress(head))
                        for part in stream.take(int(known["content-length"]) + 4):
                            out.write(gz.compress(part))
                        out.write(gz.flush())
                        rows.append((offset, out.tell() - offset, known["warc-record-id"]))
                        offset = out.tell()
                with target.open_output_stream(f"{root}/{name}.idx", compression=None) as out:
                    out.write("".join(f"{o} {n} {i}\n" for o, n, i in rows).encode())
                columns = list(zip(*rows, strict=True)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"] * len(rows), pa.string()), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], ["path", "offset", "length", "record_id"])

    archives = archives.repartition(max(1, min(archives.count(), 4096)), "path")
    return materialize(archives.mapInArrow(rewrite, "path string, offset long, length long, record_id string"), "index")


def read_records(index: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri of the members that an index lists."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict[str, pa.NativeFile] = {}
        page = lambda text: None if text is None or text[10:-1] == "None" else int(text[10:-1])
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                if row["path"] not in opened:
                    for file in opened.values():
                        file.close()
                    store, at = located(row["path"])
                    opened = {row["path"]: store.open_input_file(at)}
                data = zlib.decompress(opened[row["path"]].read_at(row["length"], row["offset"]), 31)
                end = data.index(b"\r\n\r\n") + 4
                known = fields(data[:end])
                http = data.index(b"\r\n\r\n", end) + 4
                body = data[http : end + int(known["content-length"])]
                stated = known["warc-payload-digest"].removeprefix("sha256:")
                size = int(fields(data[end:http])["content-length"])
                if known["warc-type"] == "response":
                    if hashlib.sha256(body).hexdigest() != stated or len(body) != size:
                        raise ValueError(f"payload of {known['warc-record-id']} differs from its digest")
                out.append((page(known["warc-record-id"]), size, stated, known["warc-type"], page(known.get("warc-refers-to")), known.get("warc-target-uri")))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out, strict=True), kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri"])

    return index.select("path", "offset", "length").mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string")


def archived(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """pages (page_id, url, html) as records (page_id, url, html, digest, refers_to).

    Of rows with equal payloads of at least so many bytes, all but those with the smallest page_id refer to it. Null html
    is an empty payload. Null page ids never refer and are never referred to; repeated rows of the smallest id are all
    responses.
    """
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    short = rows.where((F.octet_length("html") >= least) & F.col("page_id").isNotNull()).select("page_id", "digest")
    first = short.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = short.join(first, "digest").where("page_id <> first").select("page_id", "digest", F.col("first").alias("refers_to")).distinct()
    return rows.join(materialize(again, "revisits"), ["page_id", "digest"], "left")


def round_trip(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """Write pages as monolithic archives, normalise them, and read every record back by the index."""
    spark = pages.sparkSession
    raw = write_archives(archived(pages, least), fresh_path(spark, "warc-whole"))
    return read_records(normalise(raw, fresh_path(spark, "warc")))

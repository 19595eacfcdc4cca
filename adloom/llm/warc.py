"""WARC archives: capture, normalising of whole-file gzip, and reading back by offset.

A capture is often one gzip stream over a whole file, which nobody can read from the middle. The
normaliser inflates such a stream once, front to back, writes every record as a gzip member of its own
and notes where each begins: the sidecar index. On the way, records whose payload another record already
holds become revisit records, which name that record and keep digest and length of the payload.

Archives are files in a folder that driver and executors share; tasks open them through Arrow's file
systems, which know local paths and the common object stores. Every attempt of a task writes a file of
its own, and only the rows of the attempt that Spark accepts name it, so a lost executor leaves at most
an unread file behind.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from adloom.llm.rows import bounded, column, per_batch
from adloom.llm.work import Steps

LEAST = 100  # bytes of a payload worth a revisit
READ = 1 << 18
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"
_END = b"\r\n\r\n"
CAPTURED = "archive string, page_id long, payload_digest string, payload_bytes long"
INDEX = "archive string, offset long, length long, page_id long, record_type string"
PAGE = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if ":" in uri else (fs.LocalFileSystem(), uri)


def _new_file(folder: str, name: str) -> tuple[str, pa.NativeFile]:
    task = TaskContext.get()
    uri = f"{folder}/{name}-{task.partitionId()}-{task.taskAttemptId()}.warc.gz"
    system, path = _open(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return uri, system.open_output_stream(path, compression=None)


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _record(kind: str, page_id: int | None, url: str | None, digest: str, head: bytes, payload: bytes, refers_to: int | None = None) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url:
        lines.append("WARC-Target-URI: " + re.sub(r"[\r\n\0]+", " ", url))
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}"]
    lines += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(head) + len(payload)}"]
    return "\r\n".join(lines).encode() + _END + head + payload + _END


def response(page_id: int | None, url: str | None, payload: bytes, digest: str) -> bytes:
    return _record("response", page_id, url, digest, _http(len(payload)), payload)


def _http(length: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()


def parse(record: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Header fields (lower-case names), HTTP head and payload of one record."""
    at = record.index(_END)
    fields = {}
    for line in record[:at].decode().split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    block = record[at + 4: at + 4 + int(fields["content-length"])]
    cut = block.index(_END) + 4
    return fields, block[:cut], block[cut:]


def _id(value: str) -> int | None:
    text = value.removeprefix("<urn:page:").removesuffix(">")
    return None if text == "none" else int(text)


def capture(pages: DataFrame, folder: str) -> DataFrame:
    """Write every row as a response record, one gzip stream per task; a row per record says where."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri = out = None
        squeeze = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        for batch in batches:
            rows = []
            for page, url, html in zip(*(column(batch, c).to_pylist() for c in ("page_id", "url", "html"))):
                if out is None:
                    uri, out = _new_file(folder, "capture")
                payload = (html or "").encode()
                digest = hashlib.sha256(payload).hexdigest()
                out.write(squeeze.compress(response(page, url, payload, digest)))
                rows.append((uri, page, digest, len(payload)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.int64(), pa.string(), pa.int64()))],
                                                 ["archive", "page_id", "payload_digest", "payload_bytes"])
        if out is not None:
            out.write(squeeze.flush())
            out.close()

    bounded(pages.sparkSession)
    return pages.select("page_id", "url", "html").mapInArrow(run, CAPTURED)


def records(uri: str) -> Iterator[bytes]:
    """Records of a gzip file, inflated as a stream; members may hold one record, many, or a part of one."""
    system, path = _open(uri)
    with system.open_input_stream(path, compression=None) as source:
        inflate, data = zlib.decompressobj(31), bytearray()
        need = None
        raw = b""
        while True:
            raw = raw or source.read(READ)
            if not raw:
                break
            data += inflate.decompress(raw)
            raw = b""
            if inflate.eof:
                raw = inflate.unused_data
                inflate = zlib.decompressobj(31)
            at = 0
            while True:
                if need is None:
                    head = data.find(_END, at)
                    if head < 0:
                        break
                    size = re.search(rb"\r\n[Cc]ontent-[Ll]ength:\s*(\d+)", data[at:head + 2])
                    need = head - at + 4 + int(size[1]) + 4
                if len(data) - at < need:
                    break
                yield bytes(data[at: at + need])
                at, need = at + need, None
            del data[:at]


def revisits(captured: DataFrame, least: int = LEAST) -> DataFrame:
    """of (archive), page, digest, refers_to of the records whose payload a smaller page_id holds; a record is
    known by its page and its payload digest, so another payload under a repeated page_id stays a response."""
    large = captured.filter(F.col("payload_bytes") >= least)
    first = large.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("_n"))
    rows = large.join(first.filter("_n > 1 AND refers_to IS NOT NULL").drop("_n"), "payload_digest")
    return rows.filter("NOT page_id <=> refers_to").select(
        F.col("archive").alias("of"), F.col("page_id").alias("page"), F.col("payload_digest").alias("digest"), "refers_to").distinct()


def normalise(archives: DataFrame, refers: DataFrame, folder: str) -> DataFrame:
    """Rewrite whole-file archives (column archive) record by record; returns the offset index.

    `refers` (of, page, refers_to) names the records to turn into revisits. A task holds one record
    and the references of one archive at a time.
    """

    def rewrite(which: pd.DataFrame, refers_to: pd.DataFrame) -> pd.DataFrame:
        rows = []
        known = {(None if pd.isna(p) else int(p), d): int(r)
                 for p, d, r in zip(refers_to["page"], refers_to["digest"], refers_to["refers_to"])}
        for source in which["archive"]:
            uri, out = _new_file(folder, "archive-" + hashlib.sha256(source.encode()).hexdigest()[:12])
            at = 0
            with out:
                for raw in records(source):
                    fields, head, payload = parse(raw)
                    page = _id(fields["warc-record-id"])
                    digest = fields["warc-payload-digest"].removeprefix("sha256:")
                    kind = "response"
                    if (page, digest) in known and len(payload) >= LEAST:
                        kind = "revisit"
                        raw = _record(kind, page, fields.get("warc-target-uri"), digest, head, b"", known[(page, digest)])
                    squeeze = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                    member = squeeze.compress(raw) + squeeze.flush()
                    out.write(member)
                    rows.append((uri, at, len(member), page, kind))
                    at += len(member)
        made = pd.DataFrame(rows, columns=["archive", "offset", "length", "page_id", "record_type"])
        return made.astype({"page_id": "Int64"})

    which = archives.select("archive").distinct()
    # rows here are few but each stands for a whole file: a fixed number of partitions is not merged by size
    which = which.repartition(max(1, which.count()), "archive")
    return which.groupBy("archive").cogroup(refers.groupBy("of")).applyInPandas(rewrite, INDEX)


def read_back(index: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each indexed record, read by its offset."""

    def start():
        opened: dict[str, pa.NativeFile] = {}

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for archive, offset, length in zip(*(column(batch, c).to_pylist() for c in ("archive", "offset", "length"))):
                if archive not in opened:
                    for file in opened.values():
                        file.close()
                    opened.clear()
                    system, path = _open(archive)
                    opened[archive] = system.open_input_file(path)
                fields, head, payload = parse(zlib.decompress(opened[archive].read_at(length, offset), 31))
                digest = fields["warc-payload-digest"].removeprefix("sha256:")
                size = len(payload)
                if fields["warc-type"] == "revisit":
                    size = int(re.search(rb"Content-Length: (\d+)", head)[1])
                elif hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"{archive} at {offset}: the payload does not match its digest")
                refers = fields.get("warc-refers-to")
                rows.append((_id(fields["warc-record-id"]), size, digest, fields["warc-type"], _id(refers) if refers else None))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                              ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

        return step

    return per_batch(index.select("archive", "offset", "length"), start, PAGE)


def archive_pages(pages: DataFrame) -> DataFrame:
    """Capture pages, normalise the archives, and read every record back: one row per page.

    A null html is an empty payload, a null url is left out; a null page_id has a record named `none`,
    which nothing refers to. Repeated rows each have a record; of equal rows none revisits the other.
    An empty table gives no archive and no row; other columns are not looked at.
    """
    steps = Steps(pages.sparkSession, "warc")
    captured = steps.write(capture(pages, f"{steps.base}/capture"))
    refers = steps.write(revisits(captured))
    index = steps.write(normalise(captured, refers, f"{steps.base}/archives"))
    return read_back(index)

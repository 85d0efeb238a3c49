"""Web archives in ZIP packages: writing them, and reading records by range.

A package holds two stored (not compressed) members: ``archive/data.warc.gz``, in which
every WARC record is a gzip member of its own, and ``indexes/index.cdx``, one line per
record with its offset and length inside the archive member.  The reader never extracts
a package: it reads the end of the file, follows the ZIP64 locator where there is one,
parses the central directory, finds the stored members, reads the index, and then reads
just the byte ranges of the records.

Records with equal payloads share one ``response``: the one with the smallest page id.
The others are ``revisit`` records that carry the digest, the HTTP headers of the full
payload and the id they refer to, but no payload.  Digests are grouped after a partial
count; only pages that may be revisits are shuffled with their payload.

Every task writes packages under names that no other attempt uses, and only the packages
named in the stored manifest are read, so tasks that run twice leave no double records.
Packages live in a folder that driver and executors share; tasks open it with
``pyarrow.fs`` (local or mounted folders, object stores, HDFS with its client library).

Defined results: a null payload is the empty payload; equal payloads under the same page
id are all responses; a page without an id is a response and is never referred to;
control characters in an address are percent-encoded in the archive.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.llm.common import shared_folder, slot_filter, stored, with_slot_flag
from holdfast.llm.words import slices

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
PACKAGE_BYTES = 256 << 20
RANGE_BYTES = 4 << 20
URN = "urn:page:"
DATE = "2000-01-01T00:00:00Z"
# Fixed values of the ZIP format: signatures and the sizes of the fixed parts.
END, END64, LOCATOR64, ENTRY, LOCAL = b"PK\5\6", b"PK\6\6", b"PK\6\7", b"PK\1\2", b"PK\3\4"
END_SIZE, LOCATOR_SIZE, ENTRY_SIZE, LOCAL_SIZE = 22, 20, 46, 30
STORED, ZIP64_FIELD, FULL32, FULL16 = 0, 1, 0xFFFFFFFF, 0xFFFF

RECORD = (
    "page_id bigint, url string, record_type string, refers_to bigint, payload binary, "
    "payload_bytes bigint, payload_digest string"
)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def with_first_copy(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, url, html) with ``refers_to``: the response of a revisit, else null."""
    body = F.coalesce(F.col("html"), F.lit(""))
    named = pages.select("page_id", F.unhex(F.sha1(body)).alias("digest"), F.octet_length(body).alias("n")).where(
        F.col("page_id").isNotNull() & (F.col("n") >= min_bytes)
    )
    several = named.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"))
    revisits = stored(
        named.join(several.where("last > first"), "digest")
        .where("page_id > first")
        .select("page_id", "digest", F.col("first").alias("refers_to"))
        .distinct()
    )
    flags = stored(slot_filter(revisits, ["page_id"]))
    probed = with_slot_flag(pages.select("page_id", "url", "html"), flags, ["page_id"], "may_revisit")
    alone = probed.where("not may_revisit").select("page_id", "url", "html", F.lit(None).cast("long").alias("refers_to"))
    joined = (
        probed.where("may_revisit")
        .withColumn("digest", F.unhex(F.sha1(body)))
        .join(revisits, ["page_id", "digest"], "left")
        .select("page_id", "url", "html", "refers_to")
    )
    return alone.unionByName(joined)


def _record(page_id: int | None, url: str | None, html: str | None, refers_to: int | None) -> bytes:
    payload = (html or "").encode("utf-8", "surrogatepass")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (payload if refers_to is None else b"")
    address = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{URN}{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {address}",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head.append(f"WARC-Refers-To: <{URN}{refers_to}>")
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class _Package:
    """One ZIP package, written front to back."""

    def __init__(self, folder: str):
        files, root = fs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        name = f"{uuid.uuid4().hex}.wacz"
        self.path = f"{folder}/{name}"
        self.file = files.open_output_stream(f"{root}/{name}")
        self.zip = zipfile.ZipFile(self.file, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(zipfile.ZipInfo(ARCHIVE), "w", force_zip64=True)
        self.at, self.lines = 0, []

    def add(self, record: bytes, name: str) -> None:
        packer = zlib.compressobj(1, wbits=31)
        part = packer.compress(record) + packer.flush()
        self.member.write(part)
        self.lines.append(f"{self.at} {len(part)} {name}\n")
        self.at += len(part)

    def close(self) -> tuple[str, int]:
        self.member.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "".join(self.lines))
        self.zip.close()
        self.file.close()
        return self.path, len(self.lines)


def write_packages(pages: DataFrame, folder: str | None = None, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Writes (page_id, url, html, refers_to); gives the stored manifest (path, records)."""
    folder = folder or shared_folder(pages.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        package, done = None, []
        for whole in batches:
            for batch in slices(whole, "html"):
                for row in batch.to_pylist():
                    package = package or _Package(f"{folder}/packages")
                    name = "" if row["page_id"] is None else str(row["page_id"])
                    package.add(_record(row["page_id"], row["url"], row["html"], row["refers_to"]), name)
                    if package.at >= package_bytes:
                        done.append(package.close())
                        package = None
        if package:
            done.append(package.close())
        if done:
            yield pa.RecordBatch.from_pydict({"path": [d[0] for d in done], "records": [d[1] for d in done]})

    rows = pages.select("page_id", "url", "html", "refers_to").mapInArrow(write, "path string, records bigint")
    return stored(rows, f"{folder}/manifest")


def members(file: pa.NativeFile) -> dict[str, tuple[int, int]]:
    """Name to (offset, size) of the stored members, from the central directory alone."""
    size = file.size()

    def read(at: int, n: int) -> bytes:
        file.seek(at)
        return file.read(n)

    back = min(size, END_SIZE + FULL16 + LOCATOR_SIZE)
    tail = read(size - back, back)
    at = tail.rfind(END)
    if at < 0:
        raise ValueError("no end of central directory: not a ZIP file")
    count, length, start = struct.unpack("<HII", tail[at + 10 : at + 20])
    base = size - back + at - LOCATOR_SIZE
    locator = read(base, LOCATOR_SIZE) if base >= 0 else b""
    if locator.startswith(LOCATOR64):
        (where,) = struct.unpack("<Q", locator[8:16])
        record = read(where, 56)
        if not record.startswith(END64):
            raise ValueError("broken ZIP64 end of central directory")
        count, length, start = struct.unpack("<QQQ", record[32:56])
    directory = read(start, length)
    found, at = {}, 0
    for _ in range(count):
        if directory[at : at + 4] != ENTRY:
            raise ValueError("broken central directory")
        method, packed, full, name_n, extra_n, note_n, offset = struct.unpack(
            "<10xH8xIIHHH8xI", directory[at : at + ENTRY_SIZE]
        )
        name = directory[at + ENTRY_SIZE : at + ENTRY_SIZE + name_n].decode()
        extra = directory[at + ENTRY_SIZE + name_n : at + ENTRY_SIZE + name_n + extra_n]
        wide = iter(_zip64_values(extra))
        full = next(wide) if full == FULL32 else full
        packed = next(wide) if packed == FULL32 else packed
        offset = next(wide) if offset == FULL32 else offset
        at += ENTRY_SIZE + name_n + extra_n + note_n
        if method == STORED and packed == full:
            local = read(offset, LOCAL_SIZE)
            if not local.startswith(LOCAL):
                raise ValueError(f"no local header of {name}")
            found[name] = (offset + LOCAL_SIZE + sum(struct.unpack("<HH", local[26:30])), full)
    return found


def _zip64_values(extra: bytes) -> list[int]:
    at = 0
    while at + 4 <= len(extra):
        kind, n = struct.unpack("<HH", extra[at : at + 4])
        if kind == ZIP64_FIELD:
            body = extra[at + 4 : at + 4 + n]
            return list(struct.unpack(f"<{len(body) // 8}Q", body[: len(body) // 8 * 8]))
        at += 4 + n
    return []


def _parse(record: bytes) -> dict:
    head, _, block = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8").split("\r\n")[1:])
    block = block[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    declared = dict(x.split(": ", 1) for x in http.decode("utf-8").split("\r\n")[1:])
    is_response = fields["WARC-Type"] == "response"
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if is_response and payload_digest(payload) != digest:
        raise ValueError(f"{fields['WARC-Record-ID']}: the payload does not match its digest")

    def number(field: str) -> int | None:
        text = fields.get(field, "").strip("<>").removeprefix(URN)
        return int(text) if text else None

    return {
        "page_id": number("WARC-Record-ID"),
        "url": fields["WARC-Target-URI"],
        "record_type": fields["WARC-Type"],
        "refers_to": number("WARC-Refers-To"),
        "payload": payload if is_response else None,
        "payload_bytes": int(declared["Content-Length"]),
        "payload_digest": digest,
    }


def read_packages(spark: SparkSession, manifest: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The records of the packages in the manifest; tasks read ranges of whole records."""

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                files, name = fs.FileSystem.from_uri(path)
                with files.open_input_file(name) as file:
                    found = members(file)
                    start, _ = found[ARCHIVE]
                    at, size = found[INDEX]
                    file.seek(at)
                    sizes = [int(line.split(b" ")[1]) for line in file.read(size).splitlines()]
                groups: list[list[int]] = [[]]
                for n in sizes:
                    if groups[-1] and sum(groups[-1]) + n > range_bytes:
                        groups.append([])
                    groups[-1].append(n)
                begins, here = [], start
                for group in groups:
                    begins.append(here)
                    here += sum(group)
                yield pa.RecordBatch.from_pydict(
                    {
                        "path": pa.array([path] * len(groups), pa.string()),
                        "begin": pa.array(begins, pa.int64()),
                        "sizes": pa.array(groups, pa.list_(pa.int64())),
                    }
                )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema(
            [
                ("page_id", pa.int64()),
                ("url", pa.string()),
                ("record_type", pa.string()),
                ("refers_to", pa.int64()),
                ("payload", pa.binary()),
                ("payload_bytes", pa.int64()),
                ("payload_digest", pa.string()),
            ]
        )
        for batch in batches:
            for row in batch.to_pylist():
                files, name = fs.FileSystem.from_uri(row["path"])
                with files.open_input_file(name) as file:
                    file.seek(row["begin"])
                    data = memoryview(file.read(sum(row["sizes"])))
                out, at = [], 0
                for n in row["sizes"]:
                    out.append(_parse(zlib.decompress(data[at : at + n], wbits=31)))
                    at += n
                yield pa.RecordBatch.from_pylist(out, schema=kinds)

    ranges = manifest.select("path").mapInArrow(plan, "path string, begin bigint, sizes array<bigint>")
    # a fixed number: the rows are small, but each stands for a range of payloads
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return ranges.repartition(tasks, "path", "begin").mapInArrow(read, RECORD)

"""WARC records in ZIP-packaged archives.

``write_archives`` writes one WARC record for each page: gzip members of their own, gathered in stored ZIP members
``archive/data-NNNNN.warc.gz``, with ``indexes/index.cdxj`` telling each record's member, offset and length. ``Archive``
reads such a package by ranges: end record, ZIP64 locator and record, central directory, local header, then single
records, none of them by extracting a member. Files are reached by URI through pyarrow's file systems, so the shared
folder may be a mounted path or a store.

Of records with equal payloads of at least ``min_bytes``, the one with the largest page_id is a response and the
others revisit it. Rows alike in page_id and payload count as one version: those with the largest page_id are all responses.
A null html is an empty payload; a null url becomes urn:page:<page_id>; extra columns are ignored; an empty table gives
no archives and no rows. A lost task is run again and writes another file: only files named in the stored manifest are read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import fresh, stored

#: A member is closed beyond the first size, an archive beyond the second.
MEMBER_BYTES, ARCHIVE_BYTES = 16 << 20, 1 << 30
#: Digests with several records up to which the table of responses goes to every task (40 bytes of digest and id each).
SHARE_LIMIT = 200_000
SALTS = 32
#: Fixed values of the ZIP format: signatures, limits of its 16- and 32-bit fields, and the tag of the ZIP64 field.
LOCAL, CENTRAL, END, END64, LOCATOR64 = 0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50
MAX16, MAX32, TAG64 = 0xFFFF, 0xFFFFFFFF, 1


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# Writing


class ZipWriter:
    """Stored members only; 64-bit fields where needed, or always with ``zip64``."""

    def __init__(self, sink, zip64: bool = False):
        self.sink, self.zip64, self.at, self.entries = sink, zip64, 0, []

    def put(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def add(self, name: str, data: bytes) -> None:
        crc, size, raw, at = zlib.crc32(data), len(data), name.encode(), self.at
        big = self.zip64 or size >= MAX32
        extra = struct.pack("<HHQQ", TAG64, 16, size, size) if big else b""
        shown = MAX32 if big else size
        self.put(struct.pack("<IHHHHHIIIHH", LOCAL, 45 if big else 20, 0x800, 0, 0, 0x21, crc, shown, shown, len(raw), len(extra)) + raw + extra)
        self.put(data)
        self.entries.append((raw, crc, size, at))

    def close(self) -> None:
        begin = self.at
        for raw, crc, size, at in self.entries:
            wide = [x for x in (size, size, at) if self.zip64 or x >= MAX32]
            extra = struct.pack(f"<HH{len(wide)}Q", TAG64, 8 * len(wide), *wide) if wide else b""
            s, o = (MAX32 if self.zip64 or x >= MAX32 else x for x in (size, at))
            self.put(struct.pack("<IHHHHHHIIIHHHHHII", CENTRAL, 45, 45 if wide else 20, 0x800, 0, 0, 0x21, crc, s, s, len(raw), len(extra), 0, 0, 0, 0, o) + raw + extra)
        length, n = self.at - begin, len(self.entries)
        if self.zip64 or n >= MAX16 or begin >= MAX32 or length >= MAX32:
            at = self.at
            self.put(struct.pack("<IQHHIIQQQQ", END64, 44, 45, 45, 0, 0, n, n, length, begin))
            self.put(struct.pack("<IIQI", LOCATOR64, 0, at, 1))
            n, length, begin = (min(n, MAX16), min(length, MAX32), min(begin, MAX32)) if not self.zip64 else (MAX16, MAX32, MAX32)
        self.put(struct.pack("<IHHHHIIH", END, 0, 0, n, n, length, begin, 0))


def _header_value(text: str) -> str:
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in text)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit of the record that has it."""
    lines = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{page_id}>"), ("WARC-Target-URI", _header_value(url if url is not None else f"urn:page:{page_id}")), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha1:{payload_digest(payload)}"), ("X-Payload-Bytes", str(len(payload)))]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    if refers_to is not None:
        lines += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    lines += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n" + block + b"\r\n\r\n"


def _writer(folder: str, zip64: bool, member_bytes: int, archive_bytes: int):
    def run(batches):
        files, base = fs.FileSystem.from_uri(folder)
        files.create_dir(base, recursive=True)
        task = TaskContext.get()
        stem = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}" if task else uuid.uuid4().hex
        made: list[tuple[str, int]] = []
        sink = archive = None
        member, index, written = bytearray(), [], 0

        def flush():
            name = f"archive/data-{len(archive.entries):05d}.warc.gz"
            archive.add(name, bytes(member))
            for x in index[written:]:
                x["member"] = name
            member.clear()

        def finish():
            if member:
                flush()
            archive.add("indexes/index.cdxj", "".join(json.dumps(x) + "\n" for x in index).encode())
            archive.close()
            sink.close()
            made[-1] = (made[-1][0], len(index))

        for batch in batches:
            for page_id, url, html, refers in zip(*(batch.column(c) for c in ("page_id", "url", "html", "refers_to")), strict=True):
                if archive is None:
                    name = f"{stem}-{len(made):04d}.wacz"
                    sink = files.open_output_stream(f"{base}/{name}")
                    archive, index, written = ZipWriter(sink, zip64), [], 0
                    made.append((f"{folder}/{name}", 0))
                packed = zlib.compressobj(1, zlib.DEFLATED, 31)
                data = packed.compress(record(page_id.as_py(), url.as_py(), (html.as_py() or "").encode(), refers.as_py())) + packed.flush()
                index.append({"page_id": page_id.as_py(), "member": None, "offset": len(member), "length": len(data)})
                member += data
                if len(member) >= member_bytes:
                    flush()
                    written = len(index)
                    if archive.at >= archive_bytes:
                        finish()
                        archive = None
        if archive is not None:
            finish()
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in made], pa.string()), pa.array([n for _, n in made], pa.int64())], ["archive", "n_records"])

    return run


def with_references(pages: DataFrame, min_bytes: int = 0, share_limit: int = SHARE_LIMIT) -> DataFrame:
    """page_id, url, html and refers_to (the response's page_id where the page revisits one, else null)."""
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").withColumn("sha", F.unhex(F.sha1(F.coalesce("html", F.lit("")).cast("binary"))))
    size = F.octet_length(F.coalesce("html", F.lit("")))
    same = own.filter(size >= min_bytes).groupBy("sha").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).filter("n > 1").select("sha", "keeper")
    same = stored(same, "warc-same")
    if same.count() <= share_limit:
        found = own.join(F.broadcast(same), "sha", "left")
    else:  # a payload may be on a third of all pages: its rows are dealt out over SALTS tasks
        salted = same.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        found = own.withColumn("salt", F.coalesce(F.pmod("page_id", F.lit(SALTS)).cast("int"), F.lit(0))).join(salted, ["sha", "salt"], "left")
    return found.select("page_id", "url", "html", F.when(F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, zip64: bool = False, share_limit: int = SHARE_LIMIT, member_bytes: int = MEMBER_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write every page as a record below ``folder`` (a URI); returns the stored manifest (archive, n_records)."""
    records = with_references(pages, min_bytes, share_limit)
    return stored(records.mapInArrow(_writer(folder, zip64, member_bytes, archive_bytes), "archive string, n_records long"), "warc-manifest")


# Reading


class Archive:
    """Range access to a ZIP package: ``members`` from its central directory, ``read`` of any range of a stored one."""

    def __init__(self, uri: str):
        files, path = fs.FileSystem.from_uri(uri)
        self.file = files.open_input_file(path)
        self.size = self.file.size()
        self.members = self._directory()
        self.begins: dict[str, int] = {}

    def at(self, offset: int, length: int) -> bytes:
        data = self.file.read_at(length, offset)
        if len(data) != length:
            raise ValueError(f"{length} bytes at {offset} are beyond the archive's end")
        return data

    def _directory(self) -> dict[str, tuple[int, int, int]]:
        tail_at = max(0, self.size - 22 - MAX16)
        tail = self.at(tail_at, self.size - tail_at)
        end = tail.rfind(struct.pack("<I", END))
        if end < 0:
            raise ValueError("no end of central directory")
        _, _, _, _, n, length, begin, _ = struct.unpack_from("<IHHHHIIH", tail, end)
        if n == MAX16 or length == MAX32 or begin == MAX32:
            locator = self.at(tail_at + end - 20, 20)
            sign, _, at64, _ = struct.unpack("<IIQI", locator)
            if sign == LOCATOR64:
                sign, _, _, _, _, _, _, n, length, begin = struct.unpack("<IQHHIIQQQQ", self.at(at64, 56))
                if sign != END64:
                    raise ValueError("the ZIP64 locator points to no end record")
        data, at, out = self.at(begin, length), 0, {}
        for _ in range(n):
            sign, _, _, _, method, _, _, _, packed, plain, k, x, c, _, _, _, offset = struct.unpack_from("<IHHHHHHIIIHHHHHII", data, at)
            if sign != CENTRAL:
                raise ValueError("broken central directory")
            name = data[at + 46 : at + 46 + k].decode()
            plain, packed, offset = self._wide(data[at + 46 + k : at + 46 + k + x], plain, packed, offset)
            out[name] = (offset, packed, method)
            at += 46 + k + x + c
        return out

    @staticmethod
    def _wide(extra: bytes, *values: int) -> list[int]:
        """Values of the ZIP64 field in place of those that are at the 32-bit limit, in their fixed order."""
        at, out = 0, list(values)
        while at + 4 <= len(extra):
            tag, size = struct.unpack_from("<HH", extra, at)
            if tag == TAG64:
                rest = at + 4
                for i, v in enumerate(out):
                    if v == MAX32:
                        out[i] = struct.unpack_from("<Q", extra, rest)[0]
                        rest += 8
            at += 4 + size
        return out

    def begin(self, name: str) -> int:
        """Where a stored member's data begin, after its local header."""
        if name not in self.begins:
            offset, _, method = self.members[name]
            if method:
                raise ValueError(f"{name} is compressed; only stored members can be read by ranges")
            sign, *_, k, x = struct.unpack("<IHHHHHIIIHH", self.at(offset, 30))
            if sign != LOCAL:
                raise ValueError(f"no local header for {name}")
            self.begins[name] = offset + 30 + k + x
        return self.begins[name]

    def read(self, name: str, offset: int = 0, length: int | None = None) -> bytes:
        length = self.members[name][1] - offset if length is None else length
        if offset < 0 or offset + length > self.members[name][1]:
            raise ValueError("the range is outside the member")
        return self.at(self.begin(name) + offset, length)

    def index(self):
        for name in self.members:
            if name.startswith("indexes/"):
                yield from map(json.loads, self.read(name).decode().splitlines())

    def close(self) -> None:
        self.file.close()


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """A record's WARC headers (names lower-cased) and its payload after the HTTP header."""
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = {}
    for line in head.decode().split("\r\n")[1:]:
        k, _, v = line.partition(":")
        headers[k.strip().lower()] = v.strip()
    block = rest[: int(headers["content-length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


def _number(urn: str | None) -> int | None:
    text = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text.lstrip("-").isdigit() else None


def _reader(with_payload: bool):
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * with_payload
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * with_payload

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    def run(batches):
        rows, held = [], 0
        for b in batches:
            for uri in b.column("archive").to_pylist():
                archive = Archive(uri)
                for entry in archive.index():
                    headers, payload = parse(zlib.decompress(archive.read(entry["member"], entry["offset"], entry["length"]), 31))
                    kind, digest = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha1:")
                    size = len(payload) if kind == "response" else int(headers["x-payload-bytes"])
                    if kind == "response" and payload_digest(payload) != digest:
                        raise ValueError(f"{uri}: the payload of page {entry['page_id']} doesn't match its digest")
                    rows.append([_number(headers["warc-record-id"]), headers["warc-target-uri"], size, digest, kind, _number(headers.get("warc-refers-to"))] + [payload] * with_payload)
                    held += len(payload) * with_payload
                    if len(rows) >= 5000 or held > 16 << 20:
                        yield batch(rows)
                        rows, held = [], 0
                archive.close()
        if rows:
            yield batch(rows)

    return run


def read_records(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """Every record of the manifest's archives; ``payload`` only with ``with_payload`` (digests are checked either way)."""
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    n = max(1, manifest.count())
    return manifest.select("archive").repartition(n).mapInArrow(_reader(with_payload), schema)


def op2(spark, sf_dir: str) -> DataFrame:
    """op2_warc_zip: every page as a record in archives in the shared folder, read back by ranges."""
    manifest = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), fresh(spark, "warc"), min_bytes=0)
    return read_records(manifest, with_payload=False).drop("url")

"""WARC records in ZIP packages, written and read in parallel.

A package is a ZIP file with stored (uncompressed) members: the archives archive/*.warc hold the records, the indexes
indexes/*.cdxj one line a record with its archive and place. The reader never extracts a package: it reads the end of
the file, follows the ZIP64 records where they are present, walks the central directory, finds the archives and indexes
among its names, locates each stored member behind its local header and then reads only the byte ranges that the indexes
name; an archive that no index names is walked from record to record. Files are reached through pyarrow's file systems, so the
packages' folder may be any shared store.

Defined cases: a null payload is an empty one and a null url an empty one; payloads below `min_revisit` bytes are never
revisits; of equal payloads the record with the smallest id is the response (of repeated ids, each repeated row is a
record of the same kind); a null id is written as id null and read back as such; an empty table gives no package and
an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, staged

DATA, INDEX = "archive/data.warc", "indexes/index.cdxj"
MIN_REVISIT = 100
CHUNK = 4 << 20

# Signatures and sizes of the ZIP format.
END, END_SIZE = b"PK\x05\x06", 22
LOCATOR, LOCATOR_SIZE = b"PK\x06\x07", 20
END64, END64_SIZE = b"PK\x06\x06", 56
CENTRAL, CENTRAL_SIZE = b"PK\x01\x02", 46
LOCAL, LOCAL_SIZE = b"PK\x03\x04", 30
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF


@dataclass(frozen=True)
class Member:
    name: str
    stored: bool
    size: int
    header: int  # offset of the local header
    crc: int


def open_store(uri: str):
    """The file system and path of a URI or a plain local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


class Package:
    """Random access to the members of a ZIP file; read_at(n, offset) reads a range."""

    def __init__(self, read_at, size: int):
        self.read_at, self.size = read_at, size
        self.members = {m.name: m for m in self._directory()}

    def _end(self) -> tuple[int, int, int]:
        """Entries, size and offset of the central directory."""
        tail_at = max(0, self.size - END_SIZE - 0xFFFF)
        tail = self.read_at(self.size - tail_at, tail_at)
        at = tail.rfind(END)
        ends = lambda at: at + END_SIZE <= len(tail) and at + END_SIZE + struct.unpack_from("<H", tail, at + 20)[0] == len(tail)
        while at >= 0 and not ends(at):
            at = tail.rfind(END, 0, at)  # the signature stood in the comment
        if at < 0:
            raise ValueError("no end of central directory: not a ZIP file")
        entries, size, offset = struct.unpack_from("<HII", tail, at + 10)
        where = tail_at + at - LOCATOR_SIZE
        if where >= 0 and (entries == FULL16 or size == FULL32 or offset == FULL32):
            locator = self.read_at(LOCATOR_SIZE, where)
            if locator[:4] == LOCATOR:
                record = self.read_at(END64_SIZE, struct.unpack_from("<Q", locator, 8)[0])
                if record[:4] != END64:
                    raise ValueError("the ZIP64 locator points at no ZIP64 record")
                entries, size, offset = struct.unpack_from("<QQQ", record, 32)
        return entries, size, offset

    def _directory(self) -> Iterator[Member]:
        entries, size, offset = self._end()
        data, at = self.read_at(size, offset), 0
        for _ in range(entries):
            if data[at : at + 4] != CENTRAL:
                raise ValueError("broken central directory")
            flags, method = struct.unpack_from("<HH", data, at + 8)
            crc, packed, full, n_name, n_extra, n_comment = struct.unpack_from("<IIIHHH", data, at + 16)
            header = struct.unpack_from("<I", data, at + 42)[0]
            name = data[at + CENTRAL_SIZE : at + CENTRAL_SIZE + n_name].decode("utf-8" if flags & 0x800 else "cp437")
            extra, end = at + CENTRAL_SIZE + n_name, at + CENTRAL_SIZE + n_name + n_extra
            while extra + 4 <= end:
                tag, n = struct.unpack_from("<HH", data, extra)
                if tag == 1:  # ZIP64 sizes: only those that overflow, in this order
                    place = extra + 4
                    if full == FULL32:
                        full, place = struct.unpack_from("<Q", data, place)[0], place + 8
                    if packed == FULL32:
                        packed, place = struct.unpack_from("<Q", data, place)[0], place + 8
                    if header == FULL32:
                        header = struct.unpack_from("<Q", data, place)[0]
                extra += 4 + n
            yield Member(name, method == 0 and not flags & 1, full, header, crc)
            at = end + n_comment

    def start(self, name: str) -> int:
        """The offset of a stored member's first byte."""
        m = self.members[name]
        if not m.stored:
            raise ValueError(f"{name} is compressed or encrypted: its ranges can't be read")
        local = self.read_at(LOCAL_SIZE, m.header)
        if local[:4] != LOCAL:
            raise ValueError(f"{name}: no local header at {m.header}")
        n_name, n_extra = struct.unpack_from("<HH", local, 26)
        return m.header + LOCAL_SIZE + n_name + n_extra


    def lines(self, name: str) -> Iterator[bytes]:
        """The lines of a stored member, CHUNK bytes read at a time."""
        at, left, rest = self.start(name), self.members[name].size, b""
        while left:
            n = min(left, CHUNK)
            *lines, rest = (rest + self.read_at(n, at)).split(b"\n")
            at, left = at + n, left - n
            yield from lines
        if rest:
            yield rest

    def records(self) -> Iterator[tuple[str, int, int]]:
        """(archive, offset in the file, length) of every record of every archive, by the indexes where they name it."""
        archives = {n for n in self.members if n.startswith(DATA.split("/")[0] + "/") and n.endswith(".warc")}
        starts: dict[str, int] = {}
        for index in sorted(n for n in self.members if n.startswith(INDEX.split("/")[0] + "/") and n.endswith(".cdxj")):
            for line in self.lines(index):
                at = line.find(b"{")
                if at < 0:
                    continue  # a header or an empty line
                entry = json.loads(line[at:])
                name = f"{DATA.split('/')[0]}/{entry['filename']}"
                if name not in starts:
                    starts[name] = self.start(name)
                yield name, starts[name] + int(entry["offset"]), int(entry["length"])
        for name in sorted(archives - set(starts)):
            start, at, size = self.start(name), 0, self.members[name].size
            while at < size:
                head = b""
                while (cut := head.find(b"\r\n\r\n")) < 0:
                    more = self.read_at(min(4096, size - at - len(head)), start + at + len(head))
                    if not more:
                        raise ValueError(f"{name}: a record's header has no end")
                    head += more
                length = next(int(x.split(b":")[1]) for x in head[:cut].split(b"\r\n") if x.lower().startswith(b"content-length:"))
                whole = cut + 4 + length + 4
                yield name, start + at, whole
                at += whole


class PackageWriter:
    """Streams stored members into a file that needn't seek; sizes follow the data, and ZIP64 forms are always written."""

    def __init__(self, write):
        self.write_out, self.at, self.done = write, 0, []

    def _write(self, data: bytes) -> None:
        self.write_out(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        raw = name.encode()
        self.name, self.header, self.size, self.crc = raw, self.at, 0, 0
        extra = struct.pack("<HHQQ", 1, 16, 0, 0)
        # Flag 8: sizes and checksum come after the data.
        self._write(struct.pack("<4sHHHHHIIIHH", LOCAL, 45, 0x808, 0, 0, 0x21, 0, FULL32, FULL32, len(raw), len(extra)) + raw + extra)

    def add(self, data: bytes) -> None:
        self.crc, self.size = zlib.crc32(data, self.crc), self.size + len(data)
        self._write(data)

    def end(self) -> None:
        self._write(struct.pack("<4sIQQ", b"PK\x07\x08", self.crc, self.size, self.size))
        self.done.append((self.name, self.header, self.size, self.crc))

    def close(self) -> None:
        start = self.at
        for name, header, size, crc in self.done:
            extra = struct.pack("<HHQQQ", 1, 24, size, size, header)
            self._write(struct.pack("<4sHHHHHHIIIHHHHHII", CENTRAL, 45, 45, 0x808, 0, 0, 0x21, crc, FULL32, FULL32, len(name), len(extra), 0, 0, 0, 0, FULL32) + name + extra)
        size, n = self.at - start, len(self.done)
        end64 = self.at
        self._write(struct.pack("<4sQHHIIQQQQ", END64, END64_SIZE - 12, 45, 45, 0, 0, n, n, size, start))
        self._write(struct.pack("<4sIQI", LOCATOR, 0, end64, 1))
        self._write(struct.pack("<4sHHHHIIH", END, 0, 0, FULL16, FULL16, FULL32, FULL32, 0))


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record. A revisit carries no payload but its length and digest."""
    kind = "response" if refers_to is None else "revisit"
    body = payload if refers_to is None else b""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    lines += [f"WARC-Target-URI: {' '.join(url.split())}", f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """The headers and the block of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("no WARC record at this place")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    return headers, rest[: int(headers["Content-Length"])]


def plan_records(pages: DataFrame, *, id: str = "page_id", url: str = "url", html: str = "html", min_revisit: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, payload, payload_digest and refers_to (null for responses).

    The smallest id of each digest that occurs more than once is written first and joined back: only digests and ids
    are aggregated, and a digest that many pages share is one row. Spark knows that table's size; where it is within
    spark.sql.autoBroadcastJoinThreshold it is broadcast and the payloads aren't shuffled, else both sides are.
    """
    rows = pages.select(F.col(id).cast("long").alias("page_id"), F.coalesce(F.col(url).cast("string"), F.lit("")).alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha2("payload", 256))
    large = rows.where(F.length("payload") >= min_revisit).select("payload_digest", "page_id")
    first = large.groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.max("page_id").alias("last_id")).where("first_id < last_id").select("payload_digest", "first_id")
    joined = rows.join(staged(first, "repeated-digests"), "payload_digest", "left")
    return joined.select("page_id", "url", "payload", "payload_digest", F.when(F.col("page_id") > F.col("first_id"), F.col("first_id")).alias("refers_to"))


MANIFEST = "path string, records long, index_start long, index_bytes long, data_start long"


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write one package a task into folder; returns a manifest row for each package of the attempts that succeeded.

    A package's name is unique to the attempt, so an attempt that is lost or repeated leaves at most an unlisted file.
    The index is kept in memory while a task writes: about 100 bytes a record.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        out = writer = None
        index: list[bytes] = []
        path = f"{root}/pages-{uuid.uuid4().hex}.zip"
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                for page_id, url, payload, digest, refers_to in zip(*(b.column(i).slice(lo, 64).to_pylist() for i in range(5)), strict=True):
                    if writer is None:
                        store.create_dir(root, recursive=True)
                        out = store.open_output_stream(path)
                        writer = PackageWriter(out.write)
                        writer.begin(DATA)
                    data = record(page_id, url, payload, digest, refers_to)
                    entry = {"url": url, "filename": DATA.split("/")[-1], "offset": writer.size, "length": len(data), "digest": f"sha256:{digest}"}
                    index.append(f"{'null' if page_id is None else page_id} {json.dumps(entry)}\n".encode())
                    writer.add(data)
        if writer is None:
            return
        writer.end()
        writer.begin(INDEX)
        for line in index:
            writer.add(line)
        writer.end()
        writer.close()
        out.close()
        with store.open_input_file(path) as f:
            package = Package(lambda n, at: f.read_at(n, at), f.size())
            row = [path], [len(index)], [package.start(INDEX)], [package.members[INDEX].size], [package.start(DATA)]
        yield pa.RecordBatch.from_arrays([pa.array(row[0], pa.string()), *(pa.array(c, pa.int64()) for c in row[1:])], names=[x.split()[0] for x in MANIFEST.split(", ")])

    return records.mapInArrow(run, MANIFEST)


READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, intact boolean"


def _page(urn: str | None) -> int | None:
    value = urn[len("<urn:page:") : -1] if urn else "null"
    return None if value == "null" else int(value)


def read_archives(spark: SparkSession, packages: DataFrame, folder: str, *, with_payload: bool = False) -> DataFrame:
    """All records of the packages in column `path`, each read by its range.

    Every package is opened by its directory; its ranges are dealt out in pieces of about CHUNK bytes of records. A
    response's length and digest are those of the bytes that were read; `intact` is whether its record states the same.
    A revisit has the figures that its record states.
    """

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = open_store(folder)
        for b in batches:
            for path in b.column(0).to_pylist():
                spans: list[tuple[str, int, list[int], list[int]]] = []
                offsets, lengths, size, archive = [], [], 0, None
                with store.open_input_file(path) as f:
                    package = Package(lambda n, at: f.read_at(n, at), f.size())
                    for name, at, n in package.records():
                        # Records out of order or far apart begin a range of their own.
                        if offsets and (size >= CHUNK or name != archive or not 0 <= at - offsets[-1] - lengths[-1] <= CHUNK):
                            spans.append((path, len(spans), offsets, lengths))
                            offsets, lengths, size = [], [], 0
                        offsets.append(at)
                        lengths.append(n)
                        size, archive = size + n, name
                    if offsets:
                        spans.append((path, len(spans), offsets, lengths))
                columns = list(zip(*spans, strict=True)) if spans else [()] * 4
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.list_(pa.int64())), pa.array(columns[3], pa.list_(pa.int64()))],
                    names=["path", "span", "offsets", "lengths"],
                )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = open_store(folder)
        names = [x.split()[0] for x in READ.split(", ")]
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.bool_()]
        for b in batches:
            for path, offsets, lengths in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                rows = []
                with store.open_input_file(path) as f:
                    first = offsets[0]
                    data = f.read_at(offsets[-1] + lengths[-1] - first, first)  # neighbouring ranges in one read
                for at, n in zip(offsets, lengths, strict=True):
                    headers, block = parse_record(data[at - first : at - first + n])
                    kind, digest, size = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha256:"), int(headers["WARC-Payload-Length"])
                    intact = None
                    if kind != "revisit":
                        stated = size, digest
                        size, digest = len(block), hashlib.sha256(block).hexdigest()
                        intact = stated == (size, digest)
                    rows.append((_page(headers["WARC-Record-ID"]), headers["WARC-Target-URI"], size, digest, kind, _page(headers.get("WARC-Refers-To")), block if with_payload else None, intact))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    found = packages.select("path").mapInArrow(ranges, "path string, span int, offsets array<long>, lengths array<long>")
    return found.repartition(max(2, spark.sparkContext.defaultParallelism), "path", "span").mapInArrow(read, READ)


def archive_and_read(pages: DataFrame, *, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write the pages' archives into the shared folder and read every record back; a record whose payload isn't what it
    states is an error when computed."""
    spark = pages.sparkSession
    folder = f"{shared_dir(spark)}/archives-{uuid.uuid4().hex}"
    manifest = staged(write_archives(plan_records(pages, id=id, url=url, html=html), folder), "manifest")
    found = read_archives(spark, manifest, folder)
    broken = F.raise_error(F.concat(F.lit("the payload read back differs from its record: page "), F.coalesce(F.col("page_id").cast("string"), F.lit("null")))).cast("boolean")
    return found.withColumn("intact", F.when(F.col("intact").isNull() | F.col("intact"), F.col("intact")).otherwise(broken))

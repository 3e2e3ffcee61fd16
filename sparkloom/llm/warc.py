"""Web archives in ZIP packages: written, and read by range without extraction.

A package is a ZIP file with stored (uncompressed) members: archives below ``archive/``, whose records are gzip members
of their own or plain, and indexes below ``indexes/``, with a line for each record that ends in JSON and gives its
archive, offset and length. Ours have one archive and one index; the reader takes any number of both, and indexes that
are compressed (``.gz``, or deflated in the package). It parses the end record, the ZIP64 record and locator where sizes or
counts need them, the central directory and the local headers, finds the stored archives and their indexes, and reads
records by byte ranges. Packages lie in any store that pyarrow's file systems know; every task opens it by its address.

Of records with equal payloads of at least ``least`` bytes, that with the greatest id is a response and the others
are revisits that refer to it; shorter payloads are all responses.

Executors may be lost: a package's name is new for each attempt, and only names that a finished job reports are
read.

Defined results: null html is an empty payload; a null url is an empty one, and white space in it is percent-encoded; repeated rows each get a record (those
with the greatest id are all responses); a null id is kept and never referred to; an empty table gives no
packages and no rows; very long payloads are one record and one range; other columns are ignored. Records of others
whose ids aren't ours have none; records that are neither responses nor revisits are left out.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import as_bytes, hub_join, hub_limit, keep, new_path, pieces, released, small_enough, table

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
ARCHIVES, INDEXES = re.compile(r"archive/.+\.warc(\.gz)?"), re.compile(r"indexes/.+\.cdxj?(\.gz)?")
#: Fixed values of the ZIP format: signatures, and the greatest values before ZIP64.
LOCAL, CENTRAL, END, END64, LOCATOR64 = 0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50
MOST32, MOST16 = 0xFFFFFFFF, 0xFFFF
#: Bytes of a range of records, ranges that a task reads at least, and bytes of records that a package has at most.
RANGE, RANGES = 4 << 20, 2
PACKAGE = 64 << 20
#: Most tasks that ranges are dealt out to.
TASKS = 100_000
DATE = "2020-01-01T00:00:00Z"


def open_store(address: str) -> tuple[fs.FileSystem, str]:
    """The file system of an address, and the path in it."""
    if address.startswith("file:"):
        return fs.LocalFileSystem(), "/" + address[5:].lstrip("/")
    return fs.FileSystem.from_uri(address)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# -- records


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None) -> bytes:
    """A WARC record with an HTTP response, or a revisit with the headers only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<urn:page:{'' if page_id is None else page_id}>",
        "WARC-Target-URI": re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url),
        "WARC-Date": DATE,
        "WARC-Payload-Digest": f"sha1:{digest(payload)}",
        "Content-Type": "application/http; msgtype=response",
    }
    if refers_to is not None:
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<urn:page:{refers_to}>"}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items()) + f"Content-Length: {len(block)}\r\n"
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """The fields of a record: headers, HTTP headers and payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    block = rest[: int(headers["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    fields = [x.partition(":") for x in http.decode("utf-8", "replace").split("\r\n")[1:]]
    return {"headers": headers, "http": {k: v.strip() for k, _, v in fields}, "payload": payload}


def _urn(value: str) -> int | None:
    found = re.fullmatch(r"<?urn:page:(-?\d+)>?", value)
    return int(found[1]) if found else None


# -- packages


def _extra64(*values: int) -> bytes:
    return struct.pack(f"<HH{len(values)}Q", 1, 8 * len(values), *values) if values else b""


def zip_header(name: str, size: int, crc: int, zip64: bool = False) -> bytes:
    """The local header of a stored member; its length doesn't depend on size and CRC."""
    short = MOST32 if zip64 else size
    extra = _extra64(size, size) if zip64 else b""
    return struct.pack("<IHHHHHIIIHH", LOCAL, 45 if zip64 else 20, 0x800, 0, 0, 0x21, crc, short, short, len(name.encode()), len(extra)) + name.encode() + extra


def zip_end(members: list[tuple[str, int, int, int]], at: int, zip64: bool = False) -> bytes:
    """Central directory and end records for members (name, offset, size, CRC), to stand at offset ``at``."""
    out = b""
    for name, offset, size, crc in members:
        big = zip64 or max(offset, size) >= MOST32
        extra = _extra64(size, size, offset) if big else b""
        s, o = (MOST32, MOST32) if big else (size, offset)
        out += struct.pack("<IHHHHHHIIIHHHHHII", CENTRAL, 45, 45 if big else 20, 0x800, 0, 0, 0x21, crc, s, s, len(name.encode()), len(extra), 0, 0, 0, 0, o) + name.encode() + extra
    size, n, tail = len(out), len(members), b""
    if zip64 or at >= MOST32 or n >= MOST16:
        tail = struct.pack("<IQHHIIQQQQ", END64, 44, 45, 45, 0, 0, n, n, size, at) + struct.pack("<IIQI", LOCATOR64, 0, at + size, 1)
        n, size, at = MOST16, MOST32, MOST32
    return out + tail + struct.pack("<IHHHHIIH", END, 0, 0, n, n, size, at, 0)


def write_package(address: str, records: Iterator[tuple[int, bytes]], zip64: bool = False) -> int:
    """Writes a package of records (id, bytes), each a gzip member; returns their number.

    The data member streams: its local header is written last, with the member after a reserved place, so the
    package is assembled from the compressed records, which are bounded by ``PACKAGE``.
    """
    store, path = open_store(address)
    parts, lines, at, crc = [], [], 0, 0
    for page_id, data in records:
        packed = gzip.compress(data, 6, mtime=0)
        lines.append(json.dumps({"id": page_id, "filename": DATA.rpartition("/")[2], "offset": at, "length": len(packed)}))
        parts.append(packed)
        at += len(packed)
        crc = zlib.crc32(packed, crc)
    index = "".join(f"{x}\n" for x in lines).encode()
    first = zip_header(DATA, at, crc, zip64)
    second = zip_header(INDEX, len(index), zlib.crc32(index), zip64)
    with store.open_output_stream(path) as out:
        out.write(first)
        for p in parts:
            out.write(p)
        out.write(second)
        out.write(index)
        base = len(first) + at
        out.write(zip_end([(DATA, 0, at, crc), (INDEX, base, len(index), zlib.crc32(index))], base + len(second) + len(index), zip64))
    return len(lines)


class Package:
    """A ZIP package opened for reading by range."""

    def __init__(self, address: str) -> None:
        store, path = open_store(address)
        self.file = store.open_input_file(path)
        self.size = self.file.size()
        self.members = self._directory()

    def __enter__(self) -> Package:
        return self

    def __exit__(self, *_: object) -> None:
        self.file.close()

    def read(self, at: int, n: int) -> bytes:
        data = self.file.read_at(n, at)
        if len(data) != n:
            raise ValueError(f"{n} bytes at {at} are past the package's end")
        return data

    def _directory(self) -> dict[str, tuple[int, int, int, int]]:
        """name: (method, local header's offset, size stored, size in full), from the central directory."""
        tail_at = max(0, self.size - 22 - MOST16)
        tail = self.read(tail_at, self.size - tail_at)
        end = tail.rfind(struct.pack("<I", END))
        while end >= 0 and (end + 22 > len(tail) or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail)):
            end = tail.rfind(struct.pack("<I", END), 0, end)
        if end < 0:
            raise ValueError("no end of central directory: not a ZIP package")
        n, size, at = struct.unpack_from("<HII", tail, end + 10)
        if MOST16 in (n,) or MOST32 in (size, at):
            sig, _, where, _ = struct.unpack("<IIQI", self.read(tail_at + end - 20, 20))
            if sig == LOCATOR64:
                record64 = struct.unpack("<IQHHIIQQQQ", self.read(where, 56))
                if record64[0] != END64:
                    raise ValueError("no ZIP64 end record where its locator points")
                n, size, at = record64[7:]
        members, data, pos = {}, self.read(at, size), 0
        for _ in range(n):
            sig, _, _, _, method, _, _, _, packed, full, name_n, extra_n, comment_n, _, _, _, offset = struct.unpack_from("<IHHHHHHIIIHHHHHII", data, pos)
            if sig != CENTRAL:
                raise ValueError("broken central directory")
            name = data[pos + 46 : pos + 46 + name_n].decode()
            extra = data[pos + 46 + name_n : pos + 46 + name_n + extra_n]
            while len(extra) >= 4:
                kind, length = struct.unpack_from("<HH", extra)
                if kind == 1:
                    values = iter(struct.unpack_from(f"<{length // 8}Q", extra, 4))
                    full = next(values) if full == MOST32 else full
                    packed = next(values) if packed == MOST32 else packed
                    offset = next(values) if offset == MOST32 else offset
                extra = extra[4 + length :]
            members[name] = (method, offset, packed, full)
            pos += 46 + name_n + extra_n + comment_n
        return members

    def place(self, name: str) -> tuple[int, int]:
        """Where a stored member's bytes start in the package, and how many there are."""
        method, offset, packed, _ = self.members[name]
        if method != 0:
            raise ValueError(f"{name} is compressed in the package, so it has no ranges")
        head = struct.unpack("<IHHHHHIIIHH", self.read(offset, 30))
        if head[0] != LOCAL:
            raise ValueError(f"no local header of {name}")
        return offset + 30 + head[9] + head[10], packed

    def member(self, name: str) -> bytes:
        """A member's bytes in full; it may be deflated."""
        method, offset, packed, _ = self.members[name]
        head = struct.unpack("<IHHHHHIIIHH", self.read(offset, 30))
        data = self.read(offset + 30 + head[9] + head[10], packed)
        return zlib.decompress(data, -15) if method == 8 else data

    def index(self) -> Iterator[tuple[int, int]]:
        """(offset in the package, length) of each record that an index names, archive by archive."""
        places = {name.rpartition("/")[2]: self.place(name)[0] for name in self.members if ARCHIVES.fullmatch(name)}
        found = set()
        for name in sorted(self.members):
            if INDEXES.fullmatch(name):
                data = self.member(name)
                for line in (gzip.decompress(data) if name.endswith(".gz") else data).splitlines():
                    if (at := line.find(b"{")) >= 0 and "offset" in (x := json.loads(line[at:])):
                        file = x.get("filename", "").rpartition("/")[2] or next(iter(places))
                        found.add((places[file] + int(x["offset"]), int(x["length"])))
        return iter(sorted(found))


# -- on Spark


def write_archives(pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes packages of the rows ``(page_id, url, html)``; returns ``(address, n)`` of those written."""
    spark = pages.sparkSession
    folder = new_path(spark, "packages")
    store, path = open_store(folder)
    store.create_dir(path, recursive=True)
    html = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), html.alias("body"), F.sha1(html).alias("sha"), F.octet_length(html).alias("n"))
    # Only groups of more than one need to be told of. While their list is small, and for large groups whatever its
    # size, rows are told of them where they are, so equal payloads don't meet in a task.
    rows = rows.withColumn("equal", F.concat_ws(" ", "sha", "n"))
    counts = rows.where(F.col("n") >= least).groupBy("equal").agg(F.max("page_id").alias("last"), F.count("*").alias("many"))
    groups = keep(counts.where("many > 1"), "groups")
    side = small_enough(groups)
    rows = rows.join(side, "equal", "left") if side is not groups else hub_join(rows, groups, "equal", "many", hub_limit(pages.count()), "left")
    rows = rows.select("page_id", "url", "body", "last")

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        said: list[tuple[str, int]] = []
        held: list[tuple[int, bytes]] = []
        size = 0

        def close() -> None:
            nonlocal held, size
            if held:
                address = f"{folder}/{uuid.uuid4().hex}.wacz"
                said.append((address, write_package(address, iter(held))))
                held, size = [], 0

        for batch in batches:
            for part in pieces(batch, 2):
                for page_id, url, body, last in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), as_bytes(part.column(2)), part.column(3).to_pylist(), strict=True):
                    data = record(page_id, url, body, last if last is not None and last != page_id else None)
                    held.append((page_id, data))
                    size += len(data)
                    if size >= PACKAGE:
                        close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in said], pa.string()), pa.array([n for _, n in said], pa.int64())], ["address", "n"])

    return keep(rows.mapInArrow(run, "address string, n long"), "manifest")


def read_archives(packages: DataFrame) -> DataFrame:
    """The records of packages ``(address)``: ``page_id, url, record_type, refers_to, payload, payload_digest, payload_bytes``.

    Directories and indexes come first; the ranges of records that they give are then dealt out to tasks.
    """

    @released
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[str, int, list[int]]] = []
            for address in batch.column(0).to_pylist():
                with Package(address) as package:
                    at, lengths, size = 0, [], 0
                    for offset, length in package.index():
                        # A range is of records that follow one another.
                        if lengths and (offset != at + size or size + length > RANGE):
                            found.append((address, at, lengths))
                            lengths, size = [], 0
                        at = offset if not lengths else at
                        lengths.append(length)
                        size += length
                    if lengths:
                        found.append((address, at, lengths))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.int64()), pa.array([x[2] for x in found], pa.list_(pa.int64()))], ["address", "at", "lengths"]
            )

    schema = "page_id long, url string, record_type string, refers_to long, payload binary, payload_digest string, payload_bytes long"
    names = [x.split()[0] for x in schema.split(", ")]

    @released
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for address, at, lengths in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with Package(address) as package:
                    data, pos, out = package.read(at, sum(lengths)), 0, []
                    for n in lengths:
                        said = data[pos : pos + n]
                        x = parse_record(gzip.decompress(said) if said[:2] == b"\x1f\x8b" else said)
                        pos += n
                        h, revisit = x["headers"], x["headers"]["WARC-Type"] == "revisit"
                        if not revisit and h["WARC-Type"] != "response":
                            continue
                        out.append(
                            (
                                _urn(h["WARC-Record-ID"]),
                                h.get("WARC-Target-URI"),
                                h["WARC-Type"],
                                _urn(h.get("WARC-Refers-To", "")) if revisit else None,
                                None if revisit else x["payload"],
                                h.get("WARC-Payload-Digest", "").removeprefix("sha1:") if revisit else digest(x["payload"]),
                                int(x["http"].get("Content-Length", 0)) if revisit else len(x["payload"]),
                            )
                        )
                    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names)

    many = max(1, min(TASKS, packages.count()))
    ranges = keep(packages.select("address").repartition(many).mapInArrow(find, "address string, at long, lengths array<long>"), "ranges")
    # Tasks in proportion to the bytes; a plain shuffle of these few small rows would be merged into one.
    return ranges.repartition(max(1, min(TASKS, -(-ranges.count() // RANGES)))).mapInArrow(read, schema)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = read_archives(write_archives(table(spark, sf_dir, "pages")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")

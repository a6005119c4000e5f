"""WARC archives inside ZIP packages: written by tasks, read back by byte ranges.

A package holds stored (uncompressed) members: WARC archives under ``archive/`` with one gzip member
per record, CDXJ indexes under ``indexes/`` with the place of every record, and ``datapackage.json``.
Reading finds the end record at the tail of the package (with its ZIP64 form), the central directory,
and through the members' local headers the place of their bytes; then the indexes, and then every
record by its byte range. Nothing is unpacked or copied. Packages may come from other writers: with
several archives and indexes, gzipped indexes, records that no index names, and responses that hold
an HTTP message.

Packages lie in the shared checkpoint folder and are opened through Arrow's file systems, which
know local, HDFS and S3 addresses.
"""

from __future__ import annotations

import gzip
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.llm.tables import let_workers_import, map_texts, stored, whole_text
from trawl.session import qualified, scratch_dir

#: Payloads of at least this many bytes are written once; later rows refer to them.
REVISIT_BYTES = 100
#: Bytes and records after which a task starts another package.
PACKAGE_BYTES = 256 * 1024 * 1024
PACKAGE_RECORDS = 100_000
#: Bytes of records that are read at once.
RANGE_BYTES = 1024 * 1024
#: Fixed date of the records, so that equal tables give equal archives.
DATE = "2024-01-01T00:00:00Z"
ARCHIVES, INDEXES = "archive/", "indexes/"
DATA, INDEX, ABOUT = f"{ARCHIVES}data.warc.gz", f"{INDEXES}index.cdxj", "datapackage.json"

_END, _END64_PLACE, _END64, _ENTRY, _LOCAL = (
    b"PK\x05\x06", b"PK\x06\x07", b"PK\x06\x06", b"PK\x01\x02", b"PK\x03\x04")
_FULL32, _FULL16 = 0xFFFFFFFF, 0xFFFF


class RangeReader:
    """Reads byte ranges of a file and knows its size."""

    def __init__(self, uri: str):
        system, path = fs.FileSystem.from_uri(uri)
        self.file = system.open_input_file(path)
        self.size = self.file.size()

    def read(self, start: int, length: int) -> bytes:
        if start < 0 or length < 0 or start + length > self.size:
            raise ValueError("range outside the file")
        self.file.seek(start)
        return self.file.read(length)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.file.close()


def members(reader) -> dict[str, dict]:
    """Members by name from the central directory: method, sizes and the place of the local header."""
    tail_length = min(reader.size, 22 + _FULL16)
    tail = reader.read(reader.size - tail_length, tail_length)
    at = tail.rfind(_END)
    while at >= 0 and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail):
        at = tail.rfind(_END, 0, at)  # the bytes of a comment may look like an end record
    if at < 0:
        raise ValueError("no end of central directory")
    entries, length, start = struct.unpack_from("<HII", tail, at + 10)
    place = reader.size - tail_length + at
    if entries == _FULL16 or length == _FULL32 or start == _FULL32:
        if place >= 20 and (locator := reader.read(place - 20, 20))[:4] == _END64_PLACE:
            end64 = reader.read(struct.unpack_from("<Q", locator, 8)[0], 56)
            if end64[:4] != _END64:
                raise ValueError("broken ZIP64 end record")
            entries, length, start = struct.unpack_from("<QQQ", end64, 32)
    directory = reader.read(start, length)
    found, at = {}, 0
    for _ in range(entries):
        if directory[at:at + 4] != _ENTRY:
            raise ValueError("broken central directory")
        flags, method = struct.unpack_from("<HH", directory, at + 8)
        packed, size, name_length, extra_length, comment_length = struct.unpack_from("<IIHHH", directory, at + 20)
        header = struct.unpack_from("<I", directory, at + 42)[0]
        name = directory[at + 46:at + 46 + name_length].decode("utf-8" if flags & 0x800 else "cp437")
        extra = directory[at + 46 + name_length:at + 46 + name_length + extra_length]
        size, packed, header = _zip64(extra, size, packed, header)
        found[name] = {"method": method, "size": size, "packed": packed, "header": header}
        at += 46 + name_length + extra_length + comment_length
    return found


def _zip64(extra: bytes, *values: int) -> tuple[int, ...]:
    """Size, packed size and place, taken from the ZIP64 field where the 32-bit value is full."""
    at = 0
    while at + 4 <= len(extra):
        kind, length = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            wide = iter(struct.unpack_from(f"<{length // 8}Q", extra, at + 4))
            return tuple(next(wide) if value == _FULL32 else value for value in values)
        at += 4 + length
    return values


def data_start(reader, member: dict) -> int:
    """Where a stored member's bytes begin."""
    if member["method"] != 0:
        raise ValueError("only stored members can be read by ranges")
    header = reader.read(member["header"], 30)
    if header[:4] != _LOCAL:
        raise ValueError("broken local header")
    name_length, extra_length = struct.unpack_from("<HH", header, 26)
    return member["header"] + 30 + name_length + extra_length


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None, revisit: bool) -> bytes:
    """A WARC 1.1 record; a revisit has no block and names the record it refers to."""
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Date: {DATE}"]
    lines.append(f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>")
    if url:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if revisit:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{first}')}>")
        lines.append(f"X-Refers-To-Page-ID: {first}")
        payload = b""
    lines += ["Content-Type: text/html", f"Content-Length: {len(payload)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers, by lower-case names, and the payload: the block, or the body of the HTTP message in it."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines[1:])}
    length = int(headers["content-length"])
    if len(rest) < length:
        raise ValueError("record cut short")
    block = rest[:length]
    if headers.get("content-type", "").lower().startswith("application/http"):
        block = block.partition(b"\r\n\r\n")[2]
    return headers, block


def cdxj_key(url: str | None) -> str:
    """The search key of an address: its host turned round, then the rest, without blanks."""
    try:
        parts = urlsplit(url or "")
        host = ",".join(reversed((parts.hostname or "").split(".")))
    except ValueError:  # no address by the rules
        return quote(url)
    return quote(f"{host}){parts.path.lower() or '/'}" + (f"?{parts.query.lower()}" if parts.query else ""), safe="/:?&=,)%+;@!$'*~")


def cdxj_entries(text: str) -> Iterator[dict]:
    """The JSON of CDXJ lines, which follows a key and a time; lines that begin with ! are about the index."""
    for line in text.split("\n"):
        if line.strip() and not line.startswith("!"):
            yield json.loads(line[line.index("{"):])


class _Package:
    """One package while it is written; its members are stored, so ranges of them can be read."""

    def __init__(self, folder: str):
        self.uri = f"{folder}/{uuid.uuid4().hex}.wacz"
        system, path = fs.FileSystem.from_uri(self.uri)
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.stream = system.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.stream, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.data = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
        self.lines: list[str] = []
        self.bytes = 0

    def add(self, page_id, url, record: bytes) -> None:
        packer = zlib.compressobj(1, zlib.DEFLATED, 31)
        packed = packer.compress(record) + packer.flush()
        self.data.write(packed)
        place = {"url": url, "page": page_id, "offset": self.bytes, "length": len(packed), "filename": DATA.removeprefix(ARCHIVES)}
        self.lines.append(f"{cdxj_key(url)} {re.sub('[^0-9]', '', DATE)} {json.dumps(place)}")
        self.bytes += len(packed)

    def close(self) -> tuple[str, int]:
        self.data.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "\n".join(sorted(self.lines)))
        self.zip.writestr(zipfile.ZipInfo(ABOUT), json.dumps({"profile": "data-package", "wacz_version": "1.1.1"}))
        self.zip.close()
        self.stream.close()
        return self.uri, len(self.lines)


def write_packages(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes one record per row; gives ``package, records`` of all packages.

    The payload is the text in UTF-8, empty for null. Of equal payloads of at least
    ``REVISIT_BYTES`` the smallest id is the response and others revisit it; rows that repeat that
    id are responses too, and a null id is larger than any other. Every attempt of a task writes
    packages of its own; only those of the attempt that counts are in the result.
    """
    html = whole_text(html_col)
    named = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"),
        F.sha2(html, 256).alias("digest"))
    long = F.octet_length("html") >= REVISIT_BYTES
    # Only payloads that repeat: a small table, which Catalyst broadcasts when its size allows.
    repeated = named.filter(long).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    repeated = stored(repeated.filter("n > 1 AND first IS NOT NULL").select("digest", "first"))
    marked = named.join(repeated, "digest", "left")
    # A revisit's payload is written elsewhere.
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    marked = marked.select("page_id", "url", F.when(~revisit, F.col("html")).alias("html"), "digest", "first", revisit.alias("revisit"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        package, done = None, []
        for batch in batches:
            for page_id, url, html, digest, first, again in zip(*(batch.column(i) for i in range(6))):
                package = package or _Package(folder)
                payload = (html.as_py() or "").encode("utf-8", "surrogatepass")
                page_id = page_id.as_py()
                url = url.as_py()
                package.add(page_id, url, record_bytes(page_id, url, payload, digest.as_py(), first.as_py(), again.as_py()))
                if package.bytes >= PACKAGE_BYTES or len(package.lines) >= PACKAGE_RECORDS:
                    done.append(package.close())
                    package = None
        if package:
            done.append(package.close())
        yield pa.RecordBatch.from_arrays(
            [pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())],
            names=["package", "records"])

    return stored(map_texts(marked, write, "package string, records long"))


def _places(reader, directory: dict[str, dict]) -> list[tuple[int, int]]:
    """``(start, length)`` of every record that an index of the package names, in the order of the package."""
    archives = {name.removeprefix(ARCHIVES): data_start(reader, member) for name, member in directory.items()
                if name.startswith(ARCHIVES) and name.endswith(".warc.gz")}
    indexes = [name for name in directory if name.startswith(INDEXES) and re.search(r"\.cdxj?(\.gz)?$", name)]
    if not indexes:
        raise ValueError("no index in the package")
    places = set()
    for name in indexes:
        data = reader.read(data_start(reader, directory[name]), directory[name]["size"])
        for entry in cdxj_entries((gzip.decompress(data) if name.endswith(".gz") else data).decode()):
            # Some writers give the numbers as text, and no file name where there is one archive.
            base = archives[entry["filename"]] if "filename" in entry else next(iter(archives.values()))
            places.add((base + int(entry["offset"]), int(entry["length"])))
    return sorted(places)


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Byte ranges of neighbouring records of each package, from its indexes."""
    for batch in batches:
        for package in batch.column("package"):
            uri, rows = package.as_py(), []
            with RangeReader(uri) as reader:
                places = _places(reader, members(reader))
            for start, length in places:
                if not rows or start + length - rows[-1][1] > RANGE_BYTES:
                    rows.append((uri, start, [], []))
                rows[-1][2].append(start - rows[-1][1])
                rows[-1][3].append(length)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()),
                 pa.array([r[2] for r in rows], pa.list_(pa.int64())), pa.array([r[3] for r in rows], pa.list_(pa.int64()))],
                names=["package", "start", "offsets", "lengths"])


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for package, start, offsets, lengths in zip(*(batch.column(i) for i in range(4))):
            offsets, lengths = offsets.as_py(), lengths.as_py()
            with RangeReader(package.as_py()) as reader:
                data = reader.read(start.as_py(), offsets[-1] + lengths[-1])
            rows = []
            for at, length in zip(offsets, lengths):
                headers, payload = parse_record(zlib.decompress(data[at:at + length], 31))
                page, first = headers.get("x-page-id"), headers.get("x-refers-to-page-id")
                stated = headers.get("warc-payload-digest")
                rows.append((None if page is None else int(page), headers.get("warc-target-uri"), headers["warc-type"],
                             None if stated is None else stated.removeprefix("sha256:"), None if first is None else int(first), payload))
            kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)],
                names=["page_id", "url", "record_type", "stated_digest", "refers_to", "payload"])


def read_packages(packages: DataFrame) -> DataFrame:
    """``page_id, url, record_type, stated_digest, refers_to, payload`` of every record of ``package`` rows.

    Each package's directory and indexes are read by one task; its records are then dealt out as byte
    ranges of about ``RANGE_BYTES`` over all tasks. The payload of a revisit is empty. ``page_id`` and
    ``refers_to`` are null in packages of other writers; a digest by another function than SHA-256 keeps
    its name. A package without an index, or that is compressed, fails.
    """
    let_workers_import(packages.sparkSession)
    ranges = stored(packages.select("package").repartition("package").mapInArrow(
        _ranges, "package string, start long, offsets array<long>, lengths array<long>"))
    dealt = ranges.repartition(F.xxhash64("package", "start"))
    return dealt.mapInArrow(
        _records, "page_id long, url string, record_type string, stated_digest string, refers_to long, payload binary")


def archived(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of every row, after a round trip.

    Digests and lengths come from the payloads as read; a revisit has those of the record it names.
    """
    folder = qualified(pages.sparkSession, f"{scratch_dir(pages.sparkSession)}/packages")
    packages = write_packages(pages, folder, id_col, url_col, html_col)
    read = stored(read_packages(packages).select(
        "page_id", F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_digest"), "record_type", "refers_to", "stated_digest"))
    responses = read.filter("record_type = 'response'")
    # Ids may repeat with other texts, so a revisit finds its response by id and stated digest.
    named = responses.groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(
        F.max("payload_bytes").alias("payload_bytes"))
    revisits = read.filter("record_type = 'revisit'").select(
        "page_id", "refers_to", F.col("stated_digest").alias("payload_digest"), "record_type")
    resolved = revisits.join(named, ["refers_to", "payload_digest"], "left")
    lost = F.raise_error(F.concat_ws(" ", F.lit("no response for a revisit of"), "refers_to", "payload_digest"))
    resolved = resolved.withColumn("payload_bytes", F.when(F.col("payload_bytes").isNull(), lost).otherwise(F.col("payload_bytes")))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return responses.withColumn("refers_to", F.lit(None).cast("long")).select(*columns).unionByName(resolved.select(*columns))

"""WARC records in ZIP packages, read back by range.

A package is a ZIP file of stored (uncompressed) members, with ZIP64 records where sizes or offsets ask for
them: archive/data.warc.gz, one gzip member for each record, and indexes/index.cdxj, one line for each record
with its offset and length in the archive member. The reader finds the central directory from the end of the
file, locates the two stored members, and reads the index and then single records by their byte ranges;
nothing is extracted to disk, and no more of the archive than the records asked for is read.

Packages are written and read through the file system of their address (pyarrow.fs): a shared folder or an
object store that all executors reach.
"""

import gzip
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrimlake.llm.common import Scratch

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
_END, _END64, _LOCATOR, _CENTRAL, _LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
_MAX16, _MAX32 = 0xFFFF, 0xFFFFFFFF


def record(kind: str, record_id: str, url: str, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One WARC/1.1 record; a revisit has no payload of its own, but its digest and what it refers to."""
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{record_id}>", f"WARC-Target-URI: {url}",
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}", "Content-Type: text/html; charset=utf-8",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
        payload = b""
    head.append(f"Content-Length: {len(payload)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    return fields, rest[: int(fields["Content-Length"])]


class StoredZip:
    """Writes stored members in one pass: sizes and checksums go to the central directory and a data descriptor."""

    def __init__(self, out, zip64: bool = False):
        self.out, self.at, self.members, self.always64 = out, 0, [], zip64

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        raw = name.encode()
        self.name, self.head, self.crc, self.size = raw, self.at, 0, 0
        # bit 3: sizes follow the data; the ZIP64 field says that they take 8 bytes there
        self._write(struct.pack("<4s5H3I2H", _LOCAL, 45, 0x0808, 0, 0, 0x21, 0, _MAX32, _MAX32, len(raw), 20) + raw + struct.pack("<2H2Q", 1, 16, 0, 0))

    def write(self, data: bytes) -> None:
        self.crc, self.size = zlib.crc32(data, self.crc), self.size + len(data)
        self._write(data)

    def end(self) -> None:
        self._write(struct.pack("<4sI2Q", b"PK\x07\x08", self.crc, self.size, self.size))
        self.members.append((self.name, self.head, self.crc, self.size))

    def close(self) -> None:
        start = self.at
        for name, head, crc, size in self.members:
            large = self.always64 or max(size, head) >= _MAX32
            extra = struct.pack("<2H3Q", 1, 24, size, size, head) if large else b""
            shown = (_MAX32, _MAX32, _MAX32) if large else (size, size, head)
            self._write(struct.pack("<4s6H3I5H2I", _CENTRAL, 45, 45, 0x0808, 0, 0, 0x21, crc, *shown[:2], len(name), len(extra), 0, 0, 0, 0, shown[2]) + name + extra)
        length, n = self.at - start, len(self.members)
        if self.always64 or max(start, length) >= _MAX32 or n >= _MAX16:
            at = self.at
            self._write(struct.pack("<4sQ2H2I4Q", _END64, 44, 45, 45, 0, 0, n, n, length, start) + struct.pack("<4sIQI", _LOCATOR, 0, at, 1))
            start, length, n = _MAX32, _MAX32, _MAX16
        self._write(struct.pack("<4s4H2IH", _END, 0, 0, n, n, length, start, 0))


def central_directory(read: Callable[[int, int], bytes], size: int) -> dict[str, tuple[int, int]]:
    """name -> (offset of its data, length) of the stored members of a ZIP or ZIP64 file; read(offset, length)."""
    tail_at = max(0, size - 65557 - 20)
    tail = read(tail_at, size - tail_at)
    at = tail.rfind(_END)
    if at < 0:
        raise ValueError("no ZIP end record")
    n, length, start = struct.unpack_from("<H2I", tail, at + 10)
    if (_MAX16 == n or _MAX32 in (length, start)) and tail[at - 20 : at - 16] == _LOCATOR:
        (end64,) = struct.unpack_from("<Q", tail, at - 12)
        n, length, start = struct.unpack_from("<3Q", read(end64, 56), 32)
    data, at, found = read(start, length), 0, {}
    for _ in range(n):
        if data[at : at + 4] != _CENTRAL:
            raise ValueError("broken ZIP directory")
        method, packed, whole, names, extras, comments, head = (*struct.unpack_from("<H", data, at + 10), *struct.unpack_from("<2I3H", data, at + 20), *struct.unpack_from("<I", data, at + 42))
        name = data[at + 46 : at + 46 + names].decode()
        k, end = at + 46 + names, at + 46 + names + extras
        while k + 4 <= end:
            tag, n_bytes = struct.unpack_from("<2H", data, k)
            if tag == 1:  # in this order, only those that didn't fit
                values = iter(struct.unpack_from(f"<{n_bytes // 8}Q", data, k + 4))
                whole = next(values) if whole == _MAX32 else whole
                packed = next(values) if packed == _MAX32 else packed
                head = next(values) if head == _MAX32 else head
            k += 4 + n_bytes
        if method == 0:
            own = read(head, 30)
            if own[:4] != _LOCAL:
                raise ValueError("broken ZIP member")
            found[name] = (head + 30 + sum(struct.unpack_from("<2H", own, 26)), packed)
        at = end + comments
    return found


def _address(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def escaped(url: str | None) -> str:
    """The url as it stands in headers and index lines: white space, controls and other signs beyond ASCII percent-coded."""
    return quote(url or "", safe="!#$%&'()*+,/:;=?@[]~")


def _write_packages(folder: str, package_bytes: int) -> Callable:
    """Writes the rows of a task into packages of about package_bytes; gives (path, records)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _address(folder)
        package = None

        def close():
            package["zip"].end()
            package["zip"].begin(INDEX)
            for line in package["index"]:
                package["zip"].write(line)
            package["zip"].end()
            package["zip"].close()
            package["out"].close()
            fs.move(package["path"] + ".part", package["path"] + ".wacz")
            return pa.RecordBatch.from_arrays([pa.array([package["name"] + ".wacz"]), pa.array([len(package["index"])], pa.int64())], names=["path", "records"])

        for batch in batches:
            for row in batch.to_pylist():
                if package is None:
                    name = uuid.uuid4().hex
                    out = fs.open_output_stream(f"{root}/{name}.part")
                    package = {"name": name, "path": f"{root}/{name}", "out": out, "zip": StoredZip(out), "index": []}
                    package["zip"].begin(ARCHIVE)
                payload, url = (row["html"] or "").encode(), escaped(row["url"])
                kind, refers = ("revisit", str(row["first"])) if row["first"] is not None else ("response", None)
                coded = gzip.compress(record(kind, str(row["id"]), url, payload, row["digest"], refers), 1, mtime=0)
                entry = {"id": row["id"], "offset": package["zip"].size, "length": len(coded)}
                package["index"].append(f"{url} 19700101000000 {json.dumps(entry)}\n".encode())
                package["zip"].write(coded)
                if package["zip"].size >= package_bytes:
                    yield close()
                    package = None
        if package is not None:
            yield close()

    return run


def _read_packages(folder: str) -> Callable:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record that the packages' indexes list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _address(folder)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with fs.open_input_file(f"{root}/{path}") as file:
                    read = lambda at, n: file.read_at(n, at)
                    members = central_directory(read, file.size())
                    start, _ = members[ARCHIVE]
                    rows = []
                    for line in read(*members[INDEX]).decode().split("\n")[:-1]:
                        entry = json.loads(line.split(" ", 2)[2])
                        fields, body = parse_record(gzip.decompress(read(start + entry["offset"], entry["length"])))
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                        kind = fields["WARC-Type"]
                        if kind == "response" and hashlib.sha256(body).hexdigest() != digest:
                            raise ValueError(f"payload of {fields['WARC-Record-ID']} in {path} is broken")
                        refers = int(fields["WARC-Refers-To"][len("<urn:page:") : -1]) if kind == "revisit" else None
                        rows.append((entry["id"], int(fields["X-Payload-Length"]), digest, kind, refers))
                        if len(rows) == 5000:
                            yield _batch(rows)
                            rows = []
                    if rows:
                        yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def write_packages(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 100, package_bytes: int = 64 << 20) -> DataFrame:
    """Writes a WARC record for each page; returns (path, records), a row for each package in the folder, when computed.

    Of pages with equal payloads of at least least_bytes, the one with the smallest id is the response.
    A task that is run again writes new packages; only those listed in the result count.
    """
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.coalesce("html", F.lit("")), 256))
    prints = rows.where((F.octet_length("html") >= least_bytes) & F.col("id").isNotNull()).select("id", "digest")
    first = prints.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    again = prints.join(first, "digest").where("id > first").select("id", "digest", "first").distinct()
    return rows.join(again, ["id", "digest"], "left").select("id", "url", "html", "digest", "first").mapInArrow(_write_packages(folder, package_bytes), "path string, records long")


def read_packages(spark: SparkSession, packages: DataFrame, folder: str) -> DataFrame:
    """The records of the packages in column path, dealt out evenly."""
    return packages.select("path").repartition(spark.sparkContext.defaultParallelism * 2).mapInArrow(_read_packages(folder), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame, **columns) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, from packages in the shared folder.

    Null html: an empty payload, always a response. Payloads under 100 bytes: always responses. A repeated row has
    one record for each repeat, all of the same type. A null id is never a revisit nor referred to. Extra columns
    are ignored; an empty table gives no rows. Urls are percent-coded in headers and indexes, so any string will do.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    folder = f"{scratch.path}/packages"
    fs, root = _address(folder)
    fs.create_dir(root)
    packages = scratch.save(write_packages(pages, folder, **columns), "list")
    return read_packages(pages.sparkSession, packages, folder)

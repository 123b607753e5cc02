"""WARC records in ZIP packages: writing, and reading by byte ranges.

A package is a ZIP file whose members are stored without compression: a WARC file of gzip members, one
per record, and an index with the place of every record.  The reader finds the central directory from
the end of the file (ZIP64 too), reads the index by its range, and then each record by its own range;
nothing is extracted.

Tasks write packages of a bounded size into the shared folder and hand back their paths.  A task that
runs again writes new files, and only the paths of the attempt that ended well are listed.

Defined results: a null page is an empty payload; copies of a payload are revisits of the one with
the largest id, and rows that repeat that id are responses too; payloads shorter than ``at_least``
bytes are always responses; an empty table gives no package and an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import materialise, new_path

#: Fixed values of the two formats.
WARC_MEMBER, INDEX_MEMBER = "archive/data.warc.gz", "indexes/index.cdxj"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
END_OF_DIRECTORY, ZIP64_LOCATOR, ZIP64_END, DIRECTORY_ENTRY, LOCAL_ENTRY = b"PK\x05\x06", b"PK\x06\x07", b"PK\x06\x06", b"PK\x01\x02", b"PK\x03\x04"

MANIFEST = "path string, records long"
RECORDS = "page_id {id}, url string, record_type string, payload_digest string, payload_bytes long, refers_to {id}, payload binary"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id, digest: str) -> str:
    """Names a page's payload; rows that repeat an id with other payloads have records of their own."""
    return f"<urn:page:{'' if page_id is None else page_id}:{digest}>"


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to=None, revisit: bool = False, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One WARC record; a revisit keeps the head of the response and leaves the payload to the record it names."""
    body = HTTP_HEAD if revisit else HTTP_HEAD + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {date}",
        f"WARC-Target-URI: {(url or '').replace(chr(13), ' ').replace(chr(10), ' ')}", f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: {record_id(refers_to, digest)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Headers (lower-cased names) and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    out = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    out["payload"] = rest[: int(out["content-length"])].partition(b"\r\n\r\n")[2]
    return out


def _page(identifier: str | None, kind: str):
    text = (identifier or "")[len("<urn:page:") :].rpartition(":")[0]
    return None if not text else text if kind == "string" else int(text)


class Package:
    """Reads stored members of a ZIP file through ``read(offset, length)``."""

    def __init__(self, read, size: int):
        self.read, self.size = read, size
        self.members = dict(self._directory())

    def _directory(self) -> Iterator[tuple[str, tuple[int, int]]]:
        tail_at = max(0, self.size - 65_557)  # the end record and the longest comment
        tail = self.read(tail_at, self.size - tail_at)
        at = tail.rfind(END_OF_DIRECTORY)
        if at < 0:
            raise ValueError("no end of central directory")
        count, length, start = struct.unpack("<HII", tail[at + 10 : at + 20])
        locator = self.read(max(0, tail_at + at - 20), 20)
        if locator[:4] == ZIP64_LOCATOR:
            end = self.read(struct.unpack("<Q", locator[8:16])[0], 56)
            if end[:4] != ZIP64_END:
                raise ValueError("no ZIP64 end of central directory")
            count, length, start = struct.unpack("<QQQ", end[32:56])
        data, p = self.read(start, length), 0
        for _ in range(count):
            if data[p : p + 4] != DIRECTORY_ENTRY:
                raise ValueError("damaged central directory")
            method = struct.unpack("<H", data[p + 10 : p + 12])[0]
            packed, plain = struct.unpack("<II", data[p + 20 : p + 28])
            n, extra, comment = struct.unpack("<HHH", data[p + 28 : p + 34])
            offset = struct.unpack("<I", data[p + 42 : p + 46])[0]
            name = data[p + 46 : p + 46 + n].decode("utf-8")
            q, stop = p + 46 + n, p + 46 + n + extra
            while q + 4 <= stop:
                kind, size = struct.unpack("<HH", data[q : q + 4])
                if kind == 1:  # ZIP64: the values that don't fit, in this order
                    wide = iter(struct.unpack(f"<{size // 8}Q", data[q + 4 : q + 4 + size // 8 * 8]))
                    plain = next(wide) if plain == 0xFFFFFFFF else plain
                    packed = next(wide) if packed == 0xFFFFFFFF else packed
                    offset = next(wide) if offset == 0xFFFFFFFF else offset
                q += 4 + size
            if method == 0:
                yield name, (offset, packed)
            p = stop + comment

    def start(self, name: str) -> tuple[int, int]:
        """Offset and length of a stored member's bytes."""
        offset, length = self.members[name]
        local = self.read(offset, 30)
        if local[:4] != LOCAL_ENTRY:
            raise ValueError("damaged local entry")
        n, extra = struct.unpack("<HH", local[26:30])
        return offset + 30 + n + extra, length

    def index(self, block: int = 1 << 20) -> Iterator[dict]:
        """The index, line by line, read by blocks."""
        at, length = self.start(INDEX_MEMBER)
        rest = b""
        for k in range(0, length, block):
            lines = (rest + self.read(at + k, min(block, length - k))).split(b"\n")
            rest = lines.pop()
            yield from (json.loads(x) for x in lines if x)
        if rest:
            yield json.loads(rest)

    def records(self) -> Iterator[dict]:
        at, _ = self.start(WARC_MEMBER)
        for entry in self.index():
            yield parse_record(zlib.decompress(self.read(at + entry["offset"], entry["length"]), wbits=31))


def write_package(out, rows: Iterator[tuple], most: int, level: int = 1) -> tuple[int, bool]:
    """Write rows (page_id, url, payload, digest, refers_to, revisit) to one package until it holds ``most`` bytes.

    Returns the number of records and whether rows are left.
    """
    index, at, n, left = io.BytesIO(), 0, 0, False
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
        with z.open(zipfile.ZipInfo(WARC_MEMBER), "w", force_zip64=True) as member:
            for page_id, url, payload, digest, refers_to, revisit in rows:
                packer = zlib.compressobj(level, wbits=31)
                data = packer.compress(record(page_id, url, payload, digest, refers_to, revisit)) + packer.flush()
                member.write(data)
                index.write(json.dumps({"id": record_id(page_id, digest), "offset": at, "length": len(data)}).encode() + b"\n")
                at, n = at + len(data), n + 1
                if at >= most:
                    left = True
                    break
        z.writestr(zipfile.ZipInfo(INDEX_MEMBER), index.getvalue())
    return n, left


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", at_least: int = 0) -> DataFrame:
    """Rows with what a writer needs: page_id, url, payload (binary), digest (hex), refers_to, revisit.

    Equal payloads are found by their digest: the largest id is a map-side maximum of narrow rows, and
    only digests that occur again travel back to the pages.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    again = rows.where(F.octet_length("payload") >= at_least).groupBy("digest").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    again = materialise(again.where("n > 1").select(F.col("digest").alias("_d"), "first"), "copies")
    out = rows.join(again, (rows.digest == again._d) & (F.octet_length("payload") >= at_least), "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    out = out.select("page_id", "url", "payload", "digest", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"))
    return out.withColumn("payload", F.when(~F.col("revisit"), F.col("payload")))


def write_archives(records: DataFrame, folder: str, most: int = 256 << 20, level: int = 1) -> DataFrame:
    """Write the planned records into packages under ``folder``; one row (path, records) per package."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pafs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)

        def rows():
            for b in batches:
                for x in zip(*(b.column(i) for i in range(6))):
                    page_id, url, payload, digest, refers_to, revisit = (v.as_py() for v in x)
                    yield page_id, url, payload or b"", base64.b32encode(bytes.fromhex(digest)).decode(), refers_to, revisit

        todo, paths, counts = rows(), [], []
        first = next(todo, None)
        while first is not None:
            name = f"{uuid.uuid4().hex}.zip"
            with store.open_output_stream(f"{base}/{name}") as out:
                n, left = write_package(out, chain([first], todo), most, level)  # a generator around todo would close it
            paths.append(f"{folder}/{name}")
            counts.append(n)
            first = next(todo, None) if left else None
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(counts, pa.int64())], names=["path", "records"])

    return records.mapInArrow(run, MANIFEST)


def read_archives(spark: SparkSession, manifest: DataFrame, id_type: str = "bigint", batch: int = 256) -> DataFrame:
    """All records of the packages listed in ``manifest`` (path); see RECORDS for the columns.

    Packages are dealt out one by one; a task holds one record and one block of the index at a time.
    """
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[id_type]
    types = [arrow, pa.string(), pa.string(), pa.string(), pa.int64(), arrow, pa.binary()]
    names = ["page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        rows = []
        for b in batches:
            for path in b.column(0).to_pylist():
                store, local = pafs.FileSystem.from_uri(path)
                with store.open_input_file(local) as f:
                    for r in Package(lambda at, n, f=f: f.read_at(n, at), f.size()).records():
                        kind, payload = r["warc-type"], r["payload"]
                        digest = r["warc-payload-digest"].removeprefix("sha1:")
                        if kind == "response" and digest != sha1_base32(payload):
                            raise ValueError(f"damaged record {r['warc-record-id']} in {path}")
                        rows.append((_page(r["warc-record-id"], id_type), r["warc-target-uri"], kind, digest, len(payload) if kind == "response" else None, _page(r.get("warc-refers-to"), id_type), payload))
                        if len(rows) >= batch:
                            yield out(rows)
                            rows = []
        if rows:
            yield out(rows)

    dealt = manifest.select("path").repartition(max(1, min(10_000, manifest.count())))
    return dealt.mapInArrow(run, RECORDS.format(id=id_type))


def resolve(records: DataFrame) -> DataFrame:
    """Give revisits the size of the payload they stand for, from the record they name."""
    full = records.where("record_type = 'response'").select(F.col("page_id").alias("_p"), F.col("payload_digest").alias("_g"), F.col("payload_bytes").alias("_n")).distinct()
    out = records.join(full, (records.record_type == "revisit") & (records.refers_to == full._p) & (records.payload_digest == full._g), "left")
    return out.select("page_id", F.coalesce("payload_bytes", "_n").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


def round_trip(pages: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Write a table of pages to packages in the shared folder and read it back."""
    spark = pages.sparkSession
    manifest = materialise(write_archives(plan_records(pages, **options), folder or new_path(spark, "packages")), "packages")
    kind = pages.schema[options.get("id_col", "page_id")].dataType.simpleString()
    return resolve(materialise(read_archives(spark, manifest, kind).drop("payload", "url"), "records"))


WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, max(page_id) OVER (PARTITION BY hex) AS top,
      array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        CAST(((CAST('0x' || substr(hex, CAST(i // 4 AS INTEGER) * 5 + 1, 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) + 1 AS INTEGER), 1)), '') AS payload_digest FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to FROM d
"""

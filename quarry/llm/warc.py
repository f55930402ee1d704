"""Splittable reader (and writer) of gzip-compressed WARC files with a member per record.

A file is cut into byte ranges, one task each. A task looks for the gzip magic in its range, takes a candidate for a
member only if its header decodes and its content begins as a WARC record, and then follows the chain of members. It
owns the records of the members that start inside its range and reads the last of them past the range's end.

Payloads may hold gzip data themselves. Where a chain that began in mid-file breaks before it had three members, the
bytes before it are searched for a member that holds its beginning (up to LOOK_BACK of them): if there is one, the chain
was inside a payload; it is dropped and the search goes on one byte later.

Defined results
* Damaged members are skipped up to the next valid one. Zero bytes between members are allowed. Empty files and empty
  tables have no records. A member that holds several records yields all of them, at the member's offset.
* write() keeps nulls: a null url has no target header, a null html is marked as truncated, a null id has no id header.
  Repeated rows are records of their own; other columns are not written. An url with control characters is escaped.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, partition_id, written

SPLIT_BYTES = 8 << 20
MAGIC = b"\x1f\x8b\x08"
_READ = 1 << 20
LOOK_BACK = 8 << 20
RECORDS = "path string, offset long, type string, record_id string, target_uri string, headers map<string,string>, content binary"


def _member(head: dict[str, str], content: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in {**head, "Content-Length": str(len(content))}.items())
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(b"WARC/1.0\r\n" + lines.encode() + b"\r\n" + content + b"\r\n\r\n") + packer.flush()


def page_record(page_id: int | None, url: str | None, html: str | None) -> bytes:
    head = {"WARC-Type": "response", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url}')}>", "WARC-Date": "2024-01-01T00:00:00Z", "Content-Type": "application/http; msgtype=response"}
    if page_id is not None:
        head["X-Page-Id"] = str(page_id)
    if url is not None:
        head["WARC-Target-URI" if url.isprintable() and url == url.strip() else "X-Target-Json"] = url if url.isprintable() and url == url.strip() else json.dumps(url)
    if html is None:
        head["WARC-Truncated"] = "unspecified"
        return _member(head, b"")
    return _member(head, b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + html.encode())


def write(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write pages (page_id, url, html) as WARC files, one per partition; returns the written list of path and size.

    Each attempt of a task has a file of its own name; the list names those of the attempts that counted.
    """
    spark = pages.sparkSession
    folder = folder or new_path(spark, "warc")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, where = fs.FileSystem.from_uri(folder)
        files.create_dir(where, recursive=True)
        path, size, out = f"{where}/part-{partition_id():06d}-{uuid.uuid4().hex}.warc.gz", 0, None
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = zip(part.column("page_id").to_pylist(), part.column("url").to_pylist(), part.column("html").to_pylist())
                if out is None:
                    out = files.open_output_stream(path, compression=None)  # it would compress by the name
                    size += out.write(_member({"WARC-Type": "warcinfo", "WARC-Date": "2024-01-01T00:00:00Z", "Content-Type": "application/warc-fields"}, b"software: quarry\r\n"))
                size += out.write(b"".join(page_record(*row) for row in rows))
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path if "://" not in folder else f"{folder.split('://', 1)[0]}://{path}"], "size": [size]})

    return written(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(pack, "path string, size long"), "warc-list")


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """path and size of the .warc.gz files below a folder."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.warc.gz").load(folder)
    return found.select("path", F.col("length").alias("size"))


def _parse(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    at = 0
    while True:
        at = raw.find(b"WARC/", at)
        end = raw.find(b"\r\n\r\n", at) if at >= 0 else -1
        if end < 0:
            return
        head: dict[str, str] = {}
        for line in raw[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            head[name.strip().lower()] = value.strip()
        try:
            length = max(0, int(head.get("content-length", "0")))
        except ValueError:
            length = 0
        yield head, raw[end + 4 : end + 4 + length]
        at = end + 4 + length


class _File:
    """A file read forward, remembering what may be looked at again."""

    def __init__(self, path: str, size: int) -> None:
        files, where = fs.FileSystem.from_uri(path)
        self.stream, self.size, self.begin, self.data = files.open_input_file(where), size, 0, b""

    def get(self, at: int, least: int) -> bytes:
        """Bytes from at on, `least` of them if the file has as many."""
        if at < self.begin:
            self.begin, self.data = at, b""
        have = self.begin + len(self.data)
        if have < min(at + least, self.size):
            keep = self.data[at - self.begin :] if at < have else b""
            start = max(at, have) if keep else at
            self.stream.seek(start)
            self.data, self.begin = keep + self.stream.read(min(max(least - len(keep), _READ), self.size - start)), at
        return self.data[at - self.begin :]

    def find(self, at: int, end: int) -> int:
        """The first magic that begins in [at, end); -1 if there is none."""
        while at < end:
            data = self.get(at, min(_READ, end + 2 - at))
            hit = data.find(MAGIC, 0, end + 2 - at)
            if hit >= 0:
                return at + hit
            if len(data) < 3:
                return -1
            at += len(data) - 2
        return -1

    def member(self, at: int) -> tuple[bytes, int] | None:
        """Content and end of a valid WARC member at this place."""
        head = self.get(at, 4096)
        if len(head) < 18 or not head.startswith(MAGIC) or head[3] & 0xE0:
            return None
        try:
            begin = zlib.decompressobj(31).decompress(head[:4096], 16)
            if not begin.startswith(b"WARC/"):
                return None
            unpacker, parts, place = zlib.decompressobj(31), [], at
            while not unpacker.eof:
                chunk = self.get(place, 65536)
                if not chunk:
                    return None
                parts.append(unpacker.decompress(chunk))
                place += len(chunk)
            return b"".join(parts), place - len(unpacker.unused_data)
        except zlib.error:
            return None


def _range(path: str, start: int, end: int, size: int) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of the members that start in [start, end)."""
    file, at, trusted = _File(path, size), start, start == 0
    while True:
        at = file.find(at, end)
        if at < 0:
            return
        chain: list[tuple[int, bytes]] = []
        place = at
        while place < end and (found := file.member(place)):
            chain.append((place, found[0]))
            place = found[1]
            while (rest := file.get(place, 1)[:4096]) and not rest[0]:  # zero bytes
                place += len(rest) - len(rest.lstrip(b"\0"))
            if trusted or len(chain) > 2:
                trusted = True
                yield from chain
                chain = []
        whole = place >= size or place >= end and file.member(place) is not None
        if chain and not trusted and not whole and _inside_member(path, at, size):
            at += 1
            continue
        yield from chain
        at = place if place > at else at + 1


def _inside_member(path: str, at: int, size: int) -> bool:
    """Whether a valid member begins before this place and ends after it; looked for only where a chain broke."""
    file, place = _File(path, size), max(0, at - LOOK_BACK)
    while 0 <= (place := file.find(place, at)):
        found = file.member(place)
        if found and found[1] > at:
            return True
        place = found[1] if found else place + 1
    return False


def read(files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Records of the files in a list of path and size: a row per record, see RECORDS."""
    spark = files.sparkSession
    ranges = files.where("size > 0").select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    tasks = max(1, ranges.count())
    ranges = ranges.select("path", "start", F.least(F.col("start") + split_bytes, "size").alias("end"), "size").repartition(tasks)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for r in batch.to_pylist():
                for offset, raw in _range(r["path"], r["start"], r["end"], r["size"]):
                    for head, content in _parse(raw):
                        uri = json.loads(head["x-target-json"]) if "x-target-json" in head else head.get("warc-target-uri")
                        rows.append((r["path"], offset, head.get("warc-type"), head.get("warc-record-id"), uri, list(head.items()), content))
                        held += len(content)
                        if held > 8 << 20:
                            yield _batch(rows)
                            rows, held = [], 0
        if rows:
            yield _batch(rows)

    return ranges.mapInArrow(scan, RECORDS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], ["path", "offset", "type", "record_id", "target_uri", "headers", "content"])


def pages(records: DataFrame) -> DataFrame:
    """page_id, url and html of the response records."""
    text = F.col("content").cast("string")
    body = F.substring(text, F.locate("\r\n\r\n", text) + 4, F.length(text))
    return records.where("type = 'response'").select(
        F.col("headers")["x-page-id"].cast("long").alias("page_id"), F.col("target_uri").alias("url"), F.when(F.col("headers")["warc-truncated"].isNull(), body).alias("html")
    )


ORACLE_SQL = "SELECT page_id, url, html FROM pages"

"""WARC archives with a two-level capture index.

Writing: one gzip member per record, several archives per task.  The first
record of a payload of at least ``min_bytes`` is a response; the other records
of equal payload are revisits that name it.

Index: one line per record, ``key page_id archive offset length``, where the
key is the URL with its host reversed.  Lines are range-partitioned and sorted by
(key, page_id); each part is one file of blocks of ``block_lines`` compressed
lines, and a sparse directory of (first key, first page_id, offset, length) per block.
The root, one row per part, is the only thing that the driver holds.

Lookup: wanted (key, page_id) rows are range-partitioned and sorted too; a task
binary-searches the root and a part's directory, reads the one block by its
range, and from the block the record by its range.  Neighbouring wanted rows
share blocks, and each block is read about once.

Files go to the session's shared folder under names that are new for each
attempt; only those of committed tasks are in the manifest.

Defined results: null html is an empty payload.  A null URL has the empty key.
Rows may repeat: rows that tie for the smallest page_id of a payload are all
responses, and each row is a record of its own.  A payload whose rows all lack a
page_id has no smallest one: they are all responses; a null page_id is never the
smallest, and is returned as null.  Other columns are ignored, whatever their
names.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch_uri, stored
from .files import make_dir, open_input, open_output

MIN_BYTES, BLOCK_LINES, ARCHIVE_BYTES = 100, 1000, 256 << 20
#: Fixed values of the format.
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2024-01-01T00:00:00Z"
_NO_ID = 0x7FFFFFFFFFFFFFFF  # sorts records without page_id last


def url_key(url: Column) -> Column:
    """Reversed host, then the rest: ``com,example,www)/path?query``; lower-case host, no scheme, port 80/443 or fragment."""
    body = F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(body, "^([^/?]*)", 1)), "^.*@|:(80|443)$", "")
    rest = F.regexp_replace(body, "^[^/?]*", "")
    turned = F.array_join(F.reverse(F.split(host, "\\.")), ",")
    key = F.concat(turned, F.lit(")"), F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest)))
    return F.when(F.coalesce(url, F.lit("")) == "", "").otherwise(F.regexp_replace(key, "[\\s]", "%20"))


def record_roles(pages: DataFrame, min_bytes: int = MIN_BYTES, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, key, html, digest, payload_bytes, refers_to): refers_to is the response's page_id, null for responses.

    Only the digests of payloads that occur more than once are joined back; the smallest page_id is a
    partial aggregate, so the copies of a very common page never meet.
    """
    body = F.encode(F.coalesce(F.col(f"`{html}`"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").alias("url"), body.alias("html"))
    rows = rows.select("page_id", "url", url_key(F.col("url")).alias("key"), "html", F.sha2("html", 256).alias("digest"),
                       F.octet_length("html").cast("long").alias("payload_bytes"))
    first = (rows.where(F.col("payload_bytes") >= min_bytes).groupBy("digest")
             .agg(F.min("page_id").alias("__first"), F.count(F.lit(1)).alias("__n"))
             .where("__n > 1 and __first is not null").select("digest", "__first"))
    return (rows.join(first, "digest", "left")
            .withColumn("refers_to", F.when(F.col("__first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("__first")), F.col("__first")))
            .drop("__first"))


def _record_id(page_id, key: str, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{page_id} {key} {digest}'.encode()).digest()[:16], version=4)}>"


def format_record(page_id, url, key: str, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC/1.1 record: an HTTP response block, or for a revisit its head only."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if refers_to is not None else head + payload
    target = re.sub(r"[\r\n]", " ", url or "")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_record_id(page_id, key, digest)}",
             f"WARC-Date: {_DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha256:{digest}",
             "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {_REVISIT}", f"X-Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(record: bytes) -> dict:
    """Headers of a record, its payload, and the payload's size and digest (of a revisit: as stated)."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = int(re.search(rb"Content-Length: (\d+)", http)[1])
    full = fields["WARC-Type"] == "response"
    if full and len(payload) != stated:
        raise ValueError("a record was cut short")
    return {"fields": fields, "payload": payload, "bytes": stated,
            "digest": hashlib.sha256(payload).hexdigest() if full else fields["WARC-Payload-Digest"].removeprefix("sha256:")}


def write_archives(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the records of ``record_roles``; (key, page_id, archive, offset, length) per record, materialised."""
    def run(batches):
        out, at = None, 0
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if out is None or at >= archive_bytes:
                    if out:
                        out.close()
                    name, at = f"{folder}/pages-{uuid.uuid4().hex}.warc.gz", 0
                    out = open_output(name)
                press = zlib.compressobj(6, zlib.DEFLATED, 31)
                raw = format_record(r["page_id"], r["url"], r["key"], r["html"], r["digest"], r["refers_to"])
                member = press.compress(raw) + press.flush()
                out.write(member)
                rows.append((r["key"], r["page_id"], name, at, len(member)))
                at += len(member)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (
                    pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], ["key", "page_id", "archive", "offset", "length"])
        if out:
            out.close()

    records = records.select("page_id", "url", "key", "html", "digest", "refers_to")
    return stored(records.mapInArrow(run, "key string, page_id bigint, archive string, offset bigint, length bigint"), "warc-manifest")


def _order(page_id) -> int:
    return _NO_ID if page_id is None else page_id


def write_index(manifest: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> list[tuple]:
    """Write the index; the root: sorted (first key, first page_id, part file, directory offset, directory length)."""
    def run(batches):
        """One part: blocks as they come, then their directory at the end of the file."""
        out, at, lines, directory = None, 0, [], []
        name = f"{folder}/index-{uuid.uuid4().hex}.cdx"

        def flush():
            nonlocal at, lines
            data = zlib.compress("\n".join(lines).encode(), 6)
            key, page = lines[0].split("\t")[:2]
            directory.append(f"{key}\t{page}\t{at}\t{len(data)}")
            out.write(data)
            at, lines = at + len(data), []

        for batch in batches:
            for key, page, archive, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                out = out or open_output(name)
                lines.append(f"{key}\t{_order(page)}\t{archive}\t{offset}\t{length}")
                if len(lines) >= block_lines:
                    flush()
        if out:
            if lines:
                flush()
            data = zlib.compress("\n".join(directory).encode(), 6)
            out.write(data)
            out.close()
            key, page = directory[0].split("\t")[:2]
            yield pa.RecordBatch.from_pydict({"key": [key], "page": [int(page)], "file": [name], "offset": [at], "length": [len(data)]})

    order = [F.col("key"), F.coalesce("page_id", F.lit(_NO_ID))]
    parts = (manifest.repartitionByRange(*order).sortWithinPartitions(*order, "archive", "offset")
             .select("key", "page_id", "archive", "offset", "length")
             .mapInArrow(run, "key string, page bigint, file string, offset bigint, length bigint"))
    rows = stored(parts, "warc-root").collect()  # one row a part
    return sorted((r.key, r.page, r.file, r.offset, r.length) for r in rows)


class Index:
    """Reads the two-level index by binary search and range reads; keeps the last directory and block."""

    def __init__(self, root: list[tuple]):
        self.root, self.firsts = root, [r[:2] for r in root]
        self.part, self.directory, self.block_at, self.block, self.file = -1, [], None, [], None

    def _open(self, part: int) -> None:
        if part != self.part:
            _, _, name, offset, length = self.root[part]
            self.file, self.part, self.block_at = open_input(name), part, None
            rows = zlib.decompress(self.file.read_at(length, offset)).decode().split("\n")
            self.directory = [(k, int(p), int(o), int(n)) for k, p, o, n in (r.split("\t") for r in rows)]

    def _load(self, block: int) -> None:
        if self.block_at != block:
            _, _, offset, length = self.directory[block]
            lines = zlib.decompress(self.file.read_at(length, offset)).decode().split("\n")
            self.block = [(k, int(p), a, int(o), int(n)) for k, p, a, o, n in (x.split("\t") for x in lines)]
            self.block_at = block

    def find(self, key: str, page: int | None = None) -> list[tuple]:
        """Captures (key, page, archive, offset, length) of a key; of one page_id if given (``_order`` of it)."""
        wanted = (key, page) if page is not None else (key, -(1 << 63))
        out: list[tuple] = []
        # equal keys may begin in the part and block before the first that is not smaller
        part = max(0, bisect.bisect_left(self.firsts, wanted) - 1)
        while part < len(self.root) and self.firsts[part][0] <= key:
            self._open(part)
            block = max(0, bisect.bisect_left(self.directory, (*wanted, -1, -1)) - 1)
            while block < len(self.directory) and self.directory[block][:2] <= (key, page if page is not None else _NO_ID):
                self._load(block)
                at = bisect.bisect_left(self.block, (*wanted, "", -1, -1))
                while at < len(self.block) and self.block[at][0] == key and page in (None, self.block[at][1]):
                    out.append(self.block[at])
                    at += 1
                if at < len(self.block):
                    return out
                block += 1
            part += 1
        return out


def read_captures(wanted: DataFrame, root: list[tuple]) -> DataFrame:
    """Records of wanted (key, page_id): (page_id, key, payload_bytes, payload_digest, record_type, refers_to, payload).

    ``wanted`` is made distinct, as each lookup returns all captures of its key and page_id.
    """
    index = wanted.sparkSession.sparkContext.broadcast(root)  # one row a part

    def run(batches):
        captures, archives = Index(index.value), {}
        for batch in batches:
            for k in range(0, len(batch), 256):
                rows = []
                for want in batch.slice(k, 256).to_pylist():
                    for key, page, archive, offset, length in captures.find(want["key"], _order(want["page_id"])):
                        if archive not in archives:
                            if len(archives) >= 64:
                                archives.clear()
                            archives[archive] = open_input(archive)
                        got = parse_record(zlib.decompress(archives[archive].read_at(length, offset), 31))
                        fields = got["fields"]
                        own, refers = fields.get("X-Page-ID"), fields.get("X-Refers-To-Page-ID")
                        rows.append((None if own is None else int(own), key, got["bytes"], got["digest"], fields["WARC-Type"],
                                     None if refers is None else int(refers), got["payload"] if refers is None else None))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (
                        pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()))],
                        ["page_id", "key", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

    order = [F.col("key"), F.coalesce("page_id", F.lit(_NO_ID))]
    # a stated number of ranges: the keys are small, the records behind them are not, so ranges are not to be merged
    ranges = int(wanted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (wanted.select("key", "page_id").distinct().repartitionByRange(ranges, *order).sortWithinPartitions(*order)
            .mapInArrow(run, "page_id bigint, key string, payload_bytes bigint, payload_digest string, record_type string, "
                             "refers_to bigint, payload binary"))


def archive_pages(pages: DataFrame, min_bytes: int = MIN_BYTES, block_lines: int = BLOCK_LINES, page_id: str = "page_id",
                  url: str = "url", html: str = "html") -> tuple[DataFrame, list[tuple]]:
    """Write ``pages`` as archives with an index: (manifest, root)."""
    folder = make_dir(scratch_uri(pages.sparkSession, "warc"))
    manifest = write_archives(record_roles(pages, min_bytes, page_id, url, html), folder)
    return manifest, write_index(manifest, folder, block_lines)

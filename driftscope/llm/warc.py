"""WARC archives with a two-level capture index.

Pages are dealt into ranges of their reversed-host URL keys (``org,example)/x``),
ids and payload digests, and each range becomes three files:

* ``NAME.warc.gz``: the records, each a gzip member of its own;
* ``NAME.cdx.gz``: the captures in key order, ``INDEX_BLOCK`` lines to a gzip
  member: key, id, digest, offset and length of the record, kind;
* ``NAME.dir``: the sparse directory, one line per block: its first key, id and
  digest, offset and length.

The table that ``write_archives`` returns has one row per range with its first
key, id and digest.  A lookup searches that list, the directory and the block by bisection and
then reads the record's bytes alone, or ahead, as keys come in order.

Of records with equal payloads of at least ``REVISIT_BYTES`` bytes, the one with
the smallest id is a response; the others are revisits without a body, whose
HTTP header keeps the payload's length.  Where several rows share that smallest
id and payload, all of them are responses.  Rows without an id come after all
others.  Null html is an empty payload, a null URL an empty key.  Repeated rows
are repeated records, and each is found again.  Rows of one key and id may lie in
several ranges: a digest says in which, and without one all are searched.
"""

from __future__ import annotations

import gzip
import hashlib
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftscope.llm.files import NewFile, open_file
from driftscope.llm.scratch import Scratch
from driftscope.llm.urlfilter import split_url

REVISIT_BYTES = 100
INDEX_BLOCK = 2048
READ_AHEAD = 1 << 20
LEVEL = 4
DATE = "2000-01-01T00:00:00Z"
_ID = "urn:driftscope:page:"


def payload_digest(html: Column) -> Column:
    """SHA-256 of the payload in hex."""
    return F.sha2(F.coalesce(html, F.lit("")).cast("binary"), 256)


def url_key(url: Column) -> Column:
    """Labels of the host from last to first, then the rest of the URL; without white space and controls."""
    host, _ = split_url(url)
    rest = F.substring(url, F.instr(url, "://") + 3 + F.length(host), F.length(url))
    turned = F.array_join(F.reverse(F.split(host, r"\.")), ",")
    key = F.when(F.instr(url, "://") > 0, F.concat(turned, F.lit(")"), rest)).otherwise(url)
    return F.coalesce(F.regexp_replace(key, r"[\x00-\x20\x7f]", "+"), F.lit(""))


# ---- records --------------------------------------------------------------------------------------------------------

def _uri(url: str) -> str:
    return "".join(c if " " < c != "\x7f" else f"%{ord(c):02X}" for c in url)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record; a revisit if it refers to another page."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: <{_ID}{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}",
            f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response",
            f"Content-Length: {len(block)}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_uri(url)}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{_ID}{refers_to}>",
                 "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(lines: bytes) -> dict[str, str]:
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines.decode().split("\r\n")[1:])}


def _page(value: str | None) -> int | None:
    number = (value or "").strip("<>").removeprefix(_ID)
    return int(number) if number else None


def parse_record(data: bytes) -> dict[str, object]:
    """What a record says; the payload of a response is checked against its digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = _headers(head)
    block = rest[:int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = fields["warc-payload-digest"].removeprefix("sha256:")
    size = int(_headers(http)["content-length"])
    if fields["warc-type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"record {fields['warc-record-id']} is damaged")
    return {"page_id": _page(fields["warc-record-id"]), "payload_bytes": size, "payload_digest": digest,
            "record_type": fields["warc-type"], "refers_to": _page(fields.get("warc-refers-to")), "payload": payload}


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


# ---- writing --------------------------------------------------------------------------------------------------------

class _Writer:
    """The three files of one range."""

    def __init__(self, folder: str, name: str):
        self.archive, self.index, self.directory = (NewFile(f"{folder}/{name}.{x}") for x in ("warc.gz", "cdx.gz", "dir"))
        self.lines: list[str] = []
        self.first: tuple[str, str, str] | None = None
        self.records = 0

    def add(self, key: str, page_id: int | None, data: bytes, kind: str, digest: str = "") -> None:
        member = _member(data)
        number = "" if page_id is None else str(page_id)
        self.first = self.first or (key, number, digest)
        self.lines.append(f"{key}\t{number}\t{digest}\t{self.archive.size}\t{len(member)}\t{kind}")
        self.archive.write(member)
        self.records += 1
        if len(self.lines) == INDEX_BLOCK:
            self.block()

    def block(self) -> None:
        if self.lines:
            member = gzip.compress("\n".join(self.lines).encode(), LEVEL, mtime=0)
            key, number, digest = self.lines[0].split("\t")[:3]
            self.directory.write(f"{key}\t{number}\t{digest}\t{self.index.size}\t{len(member)}\n".encode())
            self.index.write(member)
            self.lines.clear()

    def finish(self) -> None:
        self.block()
        for file in (self.archive, self.index, self.directory):
            file.finish()


def captures(scratch: Scratch, pages: DataFrame, id_column: str, url_column: str, html_column: str) -> DataFrame:
    """``page_id, url, key, html, digest, refers_to``."""
    payload = F.coalesce(F.col(html_column), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_column).cast("bigint").alias("page_id"), F.col(url_column).alias("url"),
                        url_key(F.col(url_column)).alias("key"), payload.alias("html"),
                        payload_digest(F.col(html_column)).alias("digest"))
    long = rows.where(F.octet_length("html") >= REVISIT_BYTES)
    first = long.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
    # written, so that its size is known when it is joined with the payloads
    first = scratch.keep(first.where("n > 1").select("digest", "first_id"), "first")
    refers = F.when(~F.col("first_id").eqNullSafe(F.col("page_id")), F.col("first_id"))
    return rows.join(first, "digest", "left").select("page_id", "url", "key", "html", "digest", refers.alias("refers_to"))


def write_archives(scratch: Scratch, pages: DataFrame, id_column: str = "page_id", url_column: str = "url",
                   html_column: str = "html") -> DataFrame:
    """Write archives and index; ``name, first_key, first_id, first_digest, records`` of each range."""
    folder = f"{scratch.path}/archives"
    rows = captures(scratch, pages, id_column, url_column, html_column)
    by = [F.col("key"), F.col("page_id").asc_nulls_first(), F.col("digest")]
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("part", F.spark_partition_id())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, name = None, ""
        for batch in batches:
            for row in batch.to_pylist():
                if writer is None:
                    name = f"part-{row['part']:06d}"
                    writer = _Writer(folder, name)
                refers = row["refers_to"]
                writer.add(row["key"], row["page_id"], record(row["page_id"], row["url"], row["html"], row["digest"], refers),
                           "response" if refers is None else "revisit", row["digest"])
        if writer is not None:
            writer.finish()
            yield pa.RecordBatch.from_pylist([{"name": name, "first_key": writer.first[0], "first_id": writer.first[1],
                                               "first_digest": writer.first[2], "records": writer.records}])

    return scratch.keep(dealt.mapInArrow(write, "name string, first_key string, first_id string, first_digest string, "
                                                "records bigint"), "ranges")


# ---- lookup ---------------------------------------------------------------------------------------------------------

def _place(key: str, number: str, digest: str = "") -> tuple[bytes, int, int, str]:
    """Order of captures: key by code point, captures without an id first, then digests."""
    return key.encode(), int(bool(number)), int(number or 0), digest


class _Reader:
    """Reads of one file that mostly go forward."""

    def __init__(self, path: str):
        self.file, self.start, self.data = open_file(path), 0, b""
        self.size = self.file.size()

    def read(self, offset: int, length: int) -> bytes:
        if not self.start <= offset <= offset + length <= self.start + len(self.data):
            self.start = offset
            self.data = self.file.read_at(min(max(length, READ_AHEAD), self.size - offset), offset)
        return self.data[offset - self.start:offset - self.start + length]


class CaptureIndex:
    """Finds captures by key, id and digest; keeps the last range and the last block."""

    def __init__(self, folder: str, ranges: list[tuple[str, ...]]):
        self.folder = folder
        self.ranges = sorted((_place(*first), name) for *first, name in ranges)
        self.name, self.block = "", -1

    def _open(self, name: str) -> None:
        if name != self.name:
            self.name, self.block = name, -1
            self.archive, self.index = (_Reader(f"{self.folder}/{name}.{x}") for x in ("warc.gz", "cdx.gz"))
            with open_file(f"{self.folder}/{name}.dir") as source:
                lines = source.read_at(source.size(), 0).decode().splitlines()
            self.directory = [(_place(k, n, d), int(a), int(b)) for k, n, d, a, b in (x.split("\t") for x in lines)]
            self.starts = [x[0] for x in self.directory]

    def _load(self, block: int) -> None:
        if block != self.block:
            _, offset, length = self.directory[block]
            rows = [x.split("\t") for x in gzip.decompress(self.index.read(offset, length)).decode().split("\n")]
            self.block, self.rows = block, rows
            self.places = [_place(x[0], x[1], x[2]) for x in rows]

    def captures(self, key: str, number: str, digest: str | None = None) -> Iterator[bytes]:
        """The records of all captures with the key and id, and the digest if one is given."""
        place = _place(key, number, digest or "")
        wanted = place[:3] if digest is None else place
        for at in range(max(0, bisect_right(self.ranges, place, key=lambda r: r[0]) - 1), len(self.ranges)):
            first, name = self.ranges[at]
            if first[:len(wanted)] > wanted:
                return
            self._open(name)
            for block in range(max(0, bisect_left(self.starts, place) - 1), len(self.directory)):
                self._load(block)
                for line in range(bisect_left(self.places, place), len(self.rows)):
                    if self.places[line][:len(wanted)] != wanted:
                        return
                    _, _, _, offset, length, _ = self.rows[line]
                    yield gzip.decompress(self.archive.read(int(offset), int(length)))

    def find(self, key: str, number: str, skip: int = 0, digest: str | None = None) -> bytes | None:
        """The record of the capture, or of the next ones with the same place; None if there is none."""
        return next(islice(self.captures(key, number, digest), skip, None), None)


def lookup(scratch: Scratch, ranges: DataFrame, wanted: DataFrame, with_payload: bool = False) -> DataFrame:
    """Records for rows of ``key, page_id``: what ``parse_record`` gives; wanted rows without a capture give none.

    A ``digest`` in the rows tells captures of one key and id apart, so that many of them are read by many tasks.

    The list of ranges, one short row per archive, goes to every task.
    """
    folder = f"{scratch.path}/archives"
    known = [tuple(r) for r in ranges.select("first_key", "first_id", "first_digest", "name").collect()]
    digest = F.col("digest") if "digest" in wanted.columns else F.lit(None).cast("string").alias("digest")
    by = [F.col("key"), F.col("page_id").asc_nulls_first(), F.col("digest")]
    parts = int(wanted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = wanted.select("key", "page_id", digest).repartitionByRange(parts, *by).sortWithinPartitions(*by)
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * with_payload

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, last, records = CaptureIndex(folder, known), None, iter(())
        for batch in batches:
            found, size = {c: [] for c in columns}, 0
            for place in zip(*(batch[c].to_pylist() for c in ("key", "page_id", "digest"))):
                if place != last:  # repeated rows get the next records
                    key, page_id, which = last = place
                    records = index.captures(key, "" if page_id is None else str(page_id), which)
                data = next(records, None)
                if data is not None:
                    row = parse_record(data)
                    for c in columns:
                        found[c].append(row[c])
                    size += len(row["payload"]) if with_payload else 0
                if size > 1 << 26:
                    yield pa.RecordBatch.from_pydict(found, schema=schema)
                    found, size = {c: [] for c in columns}, 0
            yield pa.RecordBatch.from_pydict(found, schema=schema)

    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(),
             "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}
    schema = pa.schema([(c, kinds[c]) for c in columns])
    return dealt.mapInArrow(read, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, "
                                  "refers_to bigint" + ", payload binary" * with_payload)

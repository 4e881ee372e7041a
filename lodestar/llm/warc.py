"""WARC archives: one gzip member for each record, written as files and read by a sequential reader.

Writing. Of payloads that are equal (by 256 bits of SHA-2) the one of the largest id is a response record;
the others revisit it: their block is the HTTP header alone, whose Content-Length is that of the
whole payload. Which ids are referred to is a pre-aggregated table of the payloads that repeat. Members go to
files of a bounded size, in each task's order, through the committing file sink.

Reading. A task opens a file and goes through it once: zlib decompresses a member bit by bit, header
lines and the block are framed by Content-Length, the block goes into the digests piece by piece, and the member must end
where the record does. No more than a piece of a record is held, unless payloads are asked for. Both digests, the
block's and the payload's, are compared with those of the header. What does not hold is told in `problem`; after a
broken frame the rest of that file can't be found, and the row says so.

Defined results: null payloads are empty; null ids are written as such and come back as null, they
revisit a payload that a row with an id has and are responses otherwise; rows that bear the largest id of a payload
are all responses; null addresses are left out; line breaks and non-ASCII characters in addresses are
percent-encoded; payloads may be of any length that a row can have; an empty table gives no records; extra
columns are left out.
"""

from __future__ import annotations

import base64
import hashlib
import re
import urllib.parse
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import DataFrameSchema, SharedTables, bound_batches
from lodestar.sources import entity_files

#: Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"
#: What record ids begin with, and the date of records, so that a repeated run writes the same bytes.
ID, DATE = "urn:page:", "2000-01-01T00:00:00Z"
#: An archive is closed when it has this many bytes; a piece is what the reader holds of a file.
ARCHIVE_BYTES, PIECE = 64 << 20, 1 << 16
#: Header lines of a record, all together, may have this many bytes.
HEADER_BYTES = 1 << 20


class Broken(ValueError):
    """A file that is not what the format says."""


def digest(data: bytes) -> str:
    """Upper-case base32 of SHA-1."""
    return _base32(hashlib.sha1(data))


def _base32(of) -> str:
    return base64.b32encode(of.digest()).decode()


# --- writing -------------------------------------------------------------------------------


def header(fields: list[tuple[str, str | None]]) -> bytes:
    return "".join([f"{VERSION}\r\n", *(f"{k}: {v}\r\n" for k, v in fields if v is not None), "\r\n"]).encode()


def http_head(n_bytes: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()


def record(page_id: int | None, address: str | None, payload: bytes, refers_to: int | None) -> list[bytes]:
    """The pieces of one record, uncompressed."""
    head, of_page = http_head(len(payload)), lambda i: "null" if i is None else i
    block = [head] if refers_to is not None else [head, payload]
    sha = hashlib.sha1()
    for piece in block:
        sha.update(piece)
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<{ID}{of_page(page_id)}{'' if refers_to is None else ':revisit'}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", address and urllib.parse.quote(address, safe="!#$%&'()*+,/:;=?@[]~")),
        ("WARC-Refers-To", None if refers_to is None else f"<{ID}{refers_to}>"),
        ("WARC-Profile", None if refers_to is None else PROFILE),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
        ("WARC-Block-Digest", f"sha1:{_base32(sha)}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(sum(map(len, block)))),
    ]
    return [header(fields), *block, END]


def archive_info(name: str) -> list[bytes]:
    block = b"format: WARC File Format 1.1\r\n"
    fields = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:archive:{name}>"), ("WARC-Date", DATE), ("WARC-Filename", name),
              ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(block)))]
    return [header(fields), block, END]


def member(pieces: list[bytes], level: int = 6) -> bytes:
    """One gzip member."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return b"".join([*map(z.compress, pieces), z.flush()])


def repeated_payloads(keyed: DataFrame) -> DataFrame:
    """payload_key and first: the largest id of each payload that more rows than one have."""
    return keyed.groupBy("payload_key").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").drop("n")


def write_records(pages: DataFrame, tables: SharedTables, min_revisit_bytes: int = 0, id_col: str = "page_id", uri_col: str = "url",
                  payload_col: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Archives below tables.path("archives"); payloads below min_revisit_bytes are never revisited."""
    spark = pages.sparkSession
    bound_batches(spark)
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(uri_col).cast("string").alias("url"), payload.alias("payload"))
    long_enough = F.octet_length("payload") >= min_revisit_bytes
    keyed = rows.withColumn("payload_key", F.unhex(F.sha2("payload", 256)))
    again = tables.write(repeated_payloads(keyed.where(long_enough)), "again")
    refers = F.when(long_enough & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    told = keyed.join(again, "payload_key", "left").select("page_id", "url", "payload", refers.alias("refers_to"))
    schema = DataFrameSchema("name string, content binary")

    def archived(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, number, size = schema.arrow(), -1, archive_bytes
        for batch in batches:
            for page_id, address, text, refers_to in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "refers_to"))):
                content = member(record(page_id.as_py(), address.as_py(), text.as_py().encode(), refers_to.as_py()))
                if size >= archive_bytes:
                    number, size = number + 1, 0
                    name = f"pages-{number:05d}.warc.gz"
                    content = member(archive_info(name)) + content
                size += len(content)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([content], pa.binary())], schema=arrow)

    entity_files.write_files(told.mapInArrow(archived, "name string, content binary"), tables.path("archives"), "name", "content")
    tables.drop("again")


# --- reading -------------------------------------------------------------------------------


class Members:
    """The members of a gzip file, one after another, decompressed a piece at a time."""

    def __init__(self, stream: BinaryIO, piece: int = PIECE) -> None:
        self.stream, self.piece = stream, piece
        self.ahead = b""  # compressed, not used yet
        self.ready = b""  # decompressed, not read yet
        self.read_bytes = 0
        self.z = None

    def next(self) -> int | None:
        """The offset of the next member; None at the end of the file."""
        self.ahead = self.ahead or self._more()
        if not self.ahead:
            return None
        self.z, self.ready = zlib.decompressobj(31), b""
        return self.read_bytes - len(self.ahead)

    def _more(self) -> bytes:
        data = self.stream.read(self.piece)
        self.read_bytes += len(data)
        return data

    def read(self, n: int) -> bytes:
        """Some of the member's next n bytes, b"" at its end."""
        while not self.ready and not self.z.eof:
            self.ahead = self.ahead or self._more()
            if not self.ahead:
                raise Broken("the file ends within a member")
            try:
                self.ready = self.z.decompress(self.ahead, self.piece)
            except zlib.error as e:
                raise Broken(f"no gzip member: {e}") from e
            self.ahead = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
        out, self.ready = self.ready[:n], self.ready[n:]
        return out

    def exactly(self, n: int) -> Iterator[bytes]:
        while n:
            data = self.read(n)
            if not data:
                raise Broken("the record is shorter than its Content-Length")
            n -= len(data)
            yield data

    def lines(self, most: int = HEADER_BYTES) -> list[bytes]:
        """Lines up to an empty one, which is left out."""
        found = bytearray()
        while (end := found.find(END)) < 0:
            data = self.read(self.piece)
            if not data or len(found) > most:
                raise Broken("the header does not end")
            found += data
        self.ready = bytes(found[end + len(END) :]) + self.ready
        return bytes(found[:end]).split(b"\r\n")


def fields_of(lines: list[bytes]) -> dict[str, str]:
    """Header fields by lower-case name."""
    pairs = (line.decode("utf-8", "replace").partition(":") for line in lines[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def _length(fields: dict[str, str]) -> int | None:
    text = fields.get("content-length", "")
    return int(text) if re.fullmatch(r"[0-9]+", text) else None


class _Block:
    """Takes a block piece by piece: digests, the HTTP header before the payload, and the payload if it is kept."""

    def __init__(self, http: bool, keep: bool) -> None:
        self.whole, self.payload = hashlib.sha1(), hashlib.sha1()
        self.http, self.keep = http, keep
        self.head, self.fields = bytearray(), {}
        self.n, self.kept = 0, []

    def take(self, data: bytes) -> None:
        self.whole.update(data)
        if self.http:
            before = max(0, len(self.head) - 3)
            self.head += data
            end = self.head.find(END, before)
            if end < 0:
                if len(self.head) > HEADER_BYTES:
                    raise Broken("the HTTP header does not end")
                return
            self.http, data = False, bytes(self.head[end + len(END) :])
            self.fields = fields_of(bytes(self.head[:end]).split(b"\r\n"))
        self.payload.update(data)
        self.n += len(data)
        if self.keep:
            self.kept.append(data)


def _told(fields: dict[str, str], name: str) -> str | None:
    """A digest in a header, bare; other algorithms than SHA-1 are not compared."""
    algorithm, _, value = fields.get(name, "").partition(":")
    return value if algorithm.lower() == "sha1" else None


def records(stream: BinaryIO, with_payload: bool = False, piece: int = PIECE) -> Iterator[dict]:
    """A file's records in order; the last one tells in `problem` where reading ended before the file did."""
    members = Members(stream, piece)
    while (offset := members.next()) is not None:
        found = dict.fromkeys(("record_id", "record_type", "target_uri", "refers_to", "payload_digest", "payload_bytes", "payload", "problem")) | {"offset": offset}
        try:
            _fill(found, members, with_payload)
        except Broken as e:
            yield found | {"problem": str(e)}
            return
        yield found


def _fill(found: dict, members: Members, with_payload: bool) -> None:
    lines = members.lines()
    if not lines[0].startswith(b"WARC/"):
        raise Broken("no WARC record")
    fields = fields_of(lines)
    bare = lambda name: fields[name].strip("<>") if name in fields else None
    found |= {"record_id": bare("warc-record-id"), "record_type": fields.get("warc-type"), "target_uri": fields.get("warc-target-uri"), "refers_to": bare("warc-refers-to")}
    n = _length(fields)
    if n is None:
        raise Broken("no Content-Length")
    block = _Block(fields.get("content-type", "").startswith("application/http"), with_payload)
    for data in members.exactly(n):
        block.take(data)
    if b"".join(members.exactly(len(END))) != END or members.read(1):
        raise Broken("the record does not end where its Content-Length says")
    revisit = found["record_type"] == "revisit"
    computed, said = _base32(block.payload), _told(fields, "warc-payload-digest")
    found["payload_digest"] = said if revisit else computed
    found["payload_bytes"] = _length(block.fields) if revisit else block.n
    found["payload"] = b"".join(block.kept) if with_payload and not revisit else None
    wrong = [name for name, own, header_says in (
        ("block digest", _base32(block.whole), _told(fields, "warc-block-digest")), ("payload digest", computed, None if revisit else said),
    ) if header_says is not None and own != header_says]
    found["problem"] = ", ".join(f"the {name} differs" for name in wrong) or None


_RECORD = "path string, offset bigint, record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes bigint, problem string"
#: Rows of a batch that the reader gives on, and the payload bytes at which it is given on earlier.
ROWS, ROW_BYTES = 1024, 4 << 20


def read_records(spark: SparkSession, path: str, with_payload: bool = False, pattern: str = "*.warc.gz") -> DataFrame:
    """All records of the archives below a folder; Spark deals the files to tasks by their sizes."""
    bound_batches(spark)
    ddl = _RECORD + (", payload binary" if with_payload else "")
    schema = DataFrameSchema(ddl)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = schema.arrow()
        for batch in batches:
            for name in batch.column("path").to_pylist():
                rows, held = [], 0
                system, inner = entity_files.opened(name)
                with system.open_input_stream(inner, compression=None) as stream:
                    for found in records(stream, with_payload):
                        rows.append({"path": name} | found)
                        held += len(found["payload"] or b"")
                        if len(rows) >= ROWS or held >= ROW_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return entity_files.files_below(spark, path, pattern).select("path").mapInArrow(read, ddl)


def _page(record_id: str) -> Column:
    """The page id in a record id; null where it has none."""
    return F.regexp_extract(record_id, f"^{ID}(-?[0-9]+)", 1).try_cast("bigint")


def page_records(found: DataFrame) -> DataFrame:
    """One row per page; a record with a problem stops the query rather than pass for a good one."""
    fine = F.when(F.col("problem").isNull(), F.lit(True)).otherwise(F.raise_error(F.concat("path", F.lit(" at "), F.col("offset").cast("string"), F.lit(": "), "problem")).cast("boolean"))
    rows = found.where(fine & F.col("record_type").isin("response", "revisit"))
    return rows.select(_page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", _page("refers_to").alias("refers_to"))


def lost_references(found: DataFrame) -> DataFrame:
    """refers_to, payload_digest, n: revisits whose response isn't there with the same digest."""
    asked = found.where("record_type = 'revisit'").groupBy("refers_to", "payload_digest").agg(F.count("*").alias("n"))
    there = found.where("record_type = 'response' AND problem IS NULL").select(F.col("record_id").alias("refers_to"), "payload_digest").distinct()
    return asked.join(there, ["refers_to", "payload_digest"], "left_anti")


#: The contract's query over a table `pages` in DuckDB; base32 takes five hex digits to four letters.
ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS h, max(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, (5 * (i // 4) + 1)::INTEGER, 5))::BIGINT >> (15 - 5 * (i % 4))::INTEGER) & 31)::INTEGER + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM d
"""

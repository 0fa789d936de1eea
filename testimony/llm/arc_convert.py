"""Legacy ARC archives to WARC, and WARC archives read back.

Both formats are framed by declared lengths. Spark reads an archive as lines and a small state machine puts each
record together again: a record's bytes are taken by its length, whatever lines they hold. An archive is read by one
task, a record at a time, so archives must be compressed (which keeps Spark from splitting them) or smaller than a
split. Archives are written by Spark's text writer, whose line separator is the formats' record separator.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from testimony.functions.scale import cut

#: Payloads below this are never revisits.
REVISIT_BYTES = 100
#: Rows of one written archive at most.
FILE_ROWS = 50_000
#: Field names that an ARC version block declares, by version. Fixed values of the format.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: "


class ArcReader:
    """Lines of one ARC file to records: dicts of the fields in ARC_FIELDS, with block and truncated.

    Only the first record of a file can be its version block; a later one whose url begins alike is a record.
    """

    def __init__(self) -> None:
        self.version = 0
        self.begun = self.opening = False
        self.head: dict | None = None
        self.parts: list[bytes] = []
        self.need = 0

    def _record(self, truncated: bool) -> dict | None:
        head, block = self.head, b"".join(self.parts)
        self.head, self.parts = None, []
        if self.opening:
            self.opening = False
            first = block.split(b"\n", 1)[0].split()
            self.version = int(first[0]) if first and first[0].isdigit() and int(first[0]) in ARC_FIELDS else 1
            return None
        return head | {"block": block, "truncated": truncated}

    def feed(self, line: bytes) -> dict | None:
        if self.head is None:
            fields = line.rstrip(b"\r").decode("utf-8", "replace").split(" ")
            names = ARC_FIELDS[self.version or 1]
            opening = not self.begun and line.startswith(b"filedesc://")
            if opening:
                names = ARC_FIELDS[1] if len(fields) < len(ARC_FIELDS[2]) else ARC_FIELDS[2]
            # A content type may hold blanks; all other fields are counted from either end.
            after = len(names) - 4
            if len(fields) < len(names) or not fields[-1].isdigit():
                return None
            self.begun, self.opening = True, opening
            kind = " ".join(fields[3 : len(fields) - after])
            self.head = dict(zip(names, [*fields[:3], kind, *fields[len(fields) - after :]], strict=True))
            self.need = int(fields[-1])
            return self._record(False) if not self.need else None
        if len(line) >= self.need:
            self.parts.append(line[: self.need])
            return self._record(False)
        self.parts += [line, b"\n"]
        self.need -= len(line) + 1
        return self._record(False) if not self.need else None

    def end(self) -> dict | None:
        """What a file that stops inside a record leaves of it, without the line end that may not have been there."""
        if self.head is None:
            return None
        if self.parts[-1:] == [b"\n"]:
            self.parts.pop()
        return self._record(True)


class WarcReader:
    """Lines of one WARC file to records: lower-cased header fields, with block and truncated."""

    def __init__(self) -> None:
        self.head: dict | None = None
        self.body = False
        self.parts: list[bytes] = []
        self.need = 0

    def _record(self, truncated: bool) -> dict:
        record = self.head | {"block": b"".join(self.parts), "truncated": truncated}
        self.head, self.body, self.parts = None, False, []
        return record

    def feed(self, line: bytes) -> dict | None:
        if not self.body:
            text = line.rstrip(b"\r").decode("utf-8", "replace")
            if self.head is None:
                self.head = {} if text.startswith("WARC/") else None
            elif text:
                name, _, value = text.partition(":")
                self.head[name.strip().lower()] = value.strip()
            else:
                length = self.head.get("content-length", "0")
                self.need, self.body = int(length) if length.isdigit() else 0, True
                return self._record(False) if not self.need else None
            return None
        if len(line) >= self.need:
            self.parts.append(line[: self.need])
            return self._record(False)
        self.parts += [line, b"\n"]
        self.need -= len(line) + 1
        return self._record(False) if not self.need else None

    def end(self) -> dict | None:
        """What a file that stops inside a record leaves of it, without the line end that may not have been there."""
        if self.head is None:
            return None
        if self.parts[-1:] == [b"\n"]:
            self.parts.pop()
        return self._record(True)


def payload_of(block: bytes) -> bytes:
    """The entity behind the header of an HTTP response; any other block is its own payload."""
    if not block.startswith(b"HTTP/"):
        return block
    return block.partition(b"\r\n\r\n")[2]


def _read(spark: SparkSession, path: str, reader: type, names: dict[str, str], blocks: bool) -> DataFrame:
    """Archives under ``path`` as one row per record; ``names`` maps columns to record fields. Every row tells where its
    payload begins in the block, its size and SHA-256; without ``blocks`` the block itself is left out."""
    kinds = [("file", "string"), ("number", "long"), *((c, "string") for c in names), ("payload_at", "int"), ("payload_bytes", "long"), ("payload_sha256", "string"), ("truncated", "boolean")]
    kinds += [("block", "binary")] * blocks
    arrow = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, machine, number = None, None, 0
        held: list[tuple] = []
        size = 0

        def note(record: dict | None) -> None:
            nonlocal number, size
            if record is None:
                return
            block = record["block"]
            payload = payload_of(block)
            held.append((file, number, *(record.get(f) for f in names.values()), len(block) - len(payload), len(payload), hashlib.sha256(payload).hexdigest(), record["truncated"], *[block] * blocks))
            number += 1
            size += len(block) if blocks else 1000

        def flush() -> pa.RecordBatch:
            nonlocal size
            columns = [pa.array(list(c), arrow[k]) for c, (_, k) in zip(zip(*held, strict=True), kinds, strict=True)]
            held.clear()
            size = 0
            return pa.RecordBatch.from_arrays(columns, [n for n, _ in kinds])

        for batch in batches:
            for name, line in zip(batch.column("file").to_pylist(), batch.column("line").to_pylist(), strict=True):
                if name != file:
                    if machine is not None:
                        note(machine.end())
                    file, machine, number = name, reader(), 0
                note(machine.feed(line))
                if size > 4 << 20:
                    yield flush()
        if machine is not None:
            note(machine.end())
        if held:
            yield flush()

    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("line"))
    return lines.mapInArrow(parse, ", ".join(f"{n} {k}" for n, k in kinds))


def read_arc(spark: SparkSession, path: str, blocks: bool = True) -> DataFrame:
    """(file, number, url, ip, date, content_type, location, payload_at, payload_bytes, payload_sha256, truncated, block) of
    ARC version 1 and 2 records.

    Version blocks give the version and are no rows. Version 1 has no location. A record that its file ends before
    its declared length is truncated; lines that are no header where one is due are passed over.
    """
    names = {"url": "URL", "ip": "IP-address", "date": "Archive-date", "content_type": "Content-type", "location": "Location"}
    return _read(spark, path, ArcReader, names, blocks)


def read_warc(spark: SparkSession, path: str, blocks: bool = True) -> DataFrame:
    """(file, number, id, type, url, date, payload_digest, refers_to, source, refers_to_source, declared_bytes, payload_at,
    payload_bytes, payload_sha256, truncated, block) of WARC records; the digest is the declared one, payload_sha256
    that of the bytes found."""
    names = {"id": "warc-record-id", "type": "warc-type", "url": "warc-target-uri", "date": "warc-date", "payload_digest": "warc-payload-digest"}
    names |= {"refers_to": "warc-refers-to", "source": "x-source-id", "refers_to_source": "x-refers-to-source-id", "declared_bytes": "x-payload-length"}
    return _read(spark, path, WarcReader, names, blocks)


def write_arc(rows: DataFrame, path: str, version: int = 2, archive_date: str = "20000101000000") -> None:
    """Writes (source, url, payload) rows as gzip ARC files of HTTP responses. ``source`` goes to the location field of
    version 2, a null one as a dash; white space in a url is escaped, a null url is a dash."""
    url = F.coalesce(F.col("url"), F.lit("-"))
    for char, code in ((" ", "%20"), ("\n", "%0A"), ("\r", "%0D"), ("\t", "%09")):
        url = F.replace(url, F.lit(char), F.lit(code))
    url = F.when(url == "", "-").otherwise(url)
    payload = F.coalesce(F.col("payload"), F.lit(b""))
    head = F.concat(F.lit(_HTTP), F.octet_length(payload).cast("string"), F.lit("\r\n\r\n"))
    size = (F.octet_length(head) + F.octet_length(payload)).cast("string")
    source = F.coalesce(F.col("source").cast("string"), F.lit("-"))
    extra = [F.lit("200"), F.lit("-"), source, F.lit("0"), F.lit("-")] if version == 2 else []
    line = F.concat_ws(" ", url, F.lit("0.0.0.0"), F.lit(archive_date), F.lit("text/html"), *extra, size)
    record = F.concat(line.cast("binary"), F.lit(b"\n"), head.cast("binary"), payload)
    body = f"{version} 0 testimony\n{' '.join(ARC_FIELDS[version])}\n"
    tail = "200 - - 0 - " if version == 2 else ""
    start = f"filedesc://archive.arc 0.0.0.0 {archive_date} text/plain {tail}{len(body)}\n{body}".encode()
    _write(rows.select(record.alias("record")), path, start, "\n")


def _write(records: DataFrame, path: str, start: bytes, separator: str) -> None:
    """One file a task (and per FILE_ROWS rows), each beginning with ``start``."""

    def framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                if count % FILE_ROWS == 0:
                    yield pa.RecordBatch.from_arrays([pa.array([start], pa.binary())], ["record"])
                    count += 1
                part = batch.slice(at, FILE_ROWS - count % FILE_ROWS)
                yield pa.RecordBatch.from_arrays([part.column(0)], ["record"])
                count += part.num_rows
                at += part.num_rows

    lines = records.mapInArrow(framed, "record binary").select(F.col("record").cast("string").alias("value"))
    lines.write.option("lineSep", separator).option("compression", "gzip").option("maxRecordsPerFile", FILE_ROWS).text(path)


def _urn(*parts: Column) -> Column:
    """A stable identifier in the shape of a UUID from the given values."""
    h = F.sha2(F.concat_ws("\x1f", *parts), 256)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12)), F.lit(">"))


def _facts(arcs: DataFrame) -> DataFrame:
    source = F.when(F.col("location") != "-", F.col("location"))
    rows = arcs.withColumn("source", source)
    archive = F.element_at(F.split("file", "/"), -1)
    return rows.withColumn("id", _urn(F.col("url"), F.col("date"), F.coalesce(source, F.lit("-")), archive, F.col("number").cast("string")))


def revisits(arcs: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """(file, number, kept) of the records whose payload another one keeps, from read_arc's rows (blocks are not used).

    Of records with equal payloads of at least ``revisit_bytes`` that with the least location is kept, as a number
    where it is one; then url, file and place decide. Payloads meet as digests: the least of each is an aggregate, and
    its join back is one that AQE splits where a digest is hot.
    """
    rows = _facts(arcs).where(F.col("payload_bytes") >= revisit_bytes)
    whole = F.expr("try_cast(source as long)")
    order = F.struct(whole.isNull().alias("a"), whole.alias("b"), F.coalesce("source", F.lit("")).alias("c"), "url", "file", "number")
    least = rows.groupBy("payload_sha256").agg(F.min(F.struct(order.alias("o"), "id", "source", "url", "date")).alias("kept"), F.count("*").alias("n"))
    least = cut(least.where("n > 1").select("payload_sha256", "kept"), "arc-payloads")
    found = rows.select("file", "number", "payload_sha256").join(least, "payload_sha256")
    return found.where((F.col("file") != F.col("kept.o.file")) | (F.col("number") != F.col("kept.o.number"))).select("file", "number", "kept")


def warc_records(arcs: DataFrame, again: DataFrame) -> DataFrame:
    """(record binary): a WARC record for each row of read_arc, with ``again`` from revisits.

    Identifiers come from url, date, location and place in the archive, so a repeated conversion gives the same ones.
    The 14-digit ARC date becomes an ISO timestamp, one that is none the start of 1970. Types are response and revisit;
    a revisit keeps the HTTP header and names the record that has its payload. Digests are SHA-256. A truncated record
    says so.
    """
    rows = _facts(arcs).join(again, ["file", "number"], "left")
    kept = F.col("kept")
    revisit = kept.isNotNull()

    def iso(date: Column) -> Column:
        digits = F.when(date.rlike("^[0-9]{14}$"), date).otherwise(F.lit("19700101000000"))
        return F.regexp_replace(digits, r"^(....)(..)(..)(..)(..)(..)$", "$1-$2-$3T$4:$5:$6Z")

    def field(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))

    block = F.when(revisit, F.expr("substring(block, 1, payload_at)")).otherwise(F.col("block"))
    fields = [
        F.lit("WARC/1.1\r\n"),
        field("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        field("WARC-Record-ID", F.col("id")),
        field("WARC-Date", iso(F.col("date"))),
        field("WARC-Target-URI", F.col("url")),
        field("WARC-IP-Address", F.col("ip")),
        field("Content-Type", F.when(F.startswith("block", F.lit(b"HTTP/")), "application/http; msgtype=response").otherwise(F.col("content_type"))),
        field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_sha256"))),
        field("WARC-Block-Digest", F.concat(F.lit("sha256:"), F.sha2(block, 256))),
        F.when(F.col("truncated"), field("WARC-Truncated", F.lit("length"))),
        F.when(revisit, field("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        F.when(revisit, field("WARC-Refers-To", kept["id"])),
        F.when(revisit, field("WARC-Refers-To-Target-URI", kept["url"])),
        F.when(revisit, field("WARC-Refers-To-Date", iso(kept["date"]))),
        field("X-Source-Id", F.col("source")),
        field("X-Refers-To-Source-Id", kept["source"]),
        field("X-Payload-Length", F.col("payload_bytes").cast("string")),
        field("Content-Length", F.octet_length(block).cast("string")),
    ]
    return rows.select(F.concat(F.concat_ws("", *fields, F.lit("\r\n")).cast("binary"), block).alias("record"))


def convert_arc(spark: SparkSession, arc_path: str, warc_path: str, revisit_bytes: int = REVISIT_BYTES) -> None:
    """Converts the ARC files under one path to WARC files under another. Nothing to read gives nothing but an empty folder."""
    again = revisits(read_arc(spark, arc_path, blocks=False), revisit_bytes)
    about = "software: testimony\r\nformat: WARC File Format 1.1\r\n"
    start = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:00000000-0000-4000-8000-000000000001>\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(about)}\r\n\r\n{about}"
    _write(warc_records(read_arc(spark, arc_path), again), warc_path, start.encode(), "\r\n\r\n")


def archive_pages(spark: SparkSession, pages: DataFrame, folder: str, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Archives ``pages`` (page_id, url, html) as ARC, converts them to WARC and reads those back: (page_id, payload_bytes,
    payload_digest, record_type, refers_to) per row.

    Null html is an empty payload, a null url a dash; null page_ids come after all others and read back as null; rows
    that repeat a page_id are records of their own. Other columns are not read.
    """
    rows = pages.select(F.col("page_id").cast("long").cast("string").alias("source"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").cast("binary").alias("payload"))
    write_arc(rows, f"{folder}/arc")
    convert_arc(spark, f"{folder}/arc", f"{folder}/warc", revisit_bytes)
    found = read_warc(spark, f"{folder}/warc", blocks=False).where("type in ('response', 'revisit')")
    again = F.col("type") == "revisit"
    return found.select(
        F.col("source").cast("long").alias("page_id"),
        F.when(again, F.col("declared_bytes").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(again, F.regexp_replace("payload_digest", "^sha256:", "")).otherwise(F.col("payload_sha256")).alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.col("refers_to_source").cast("long").alias("refers_to"),
    )

"""WARC archives as a PySpark Python data source, and page archiving.

Writing: each task writes its rows as WARC/1.1 records into files of bounded
size; files take their final names when the job commits.  Reading: one
partition per file; the reader parses a record's headers first, tests the
pushed filters on them and moves past the block of every record that is not
wanted (or of all records, with option ``payload`` = ``skip``) without
decoding it.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan,
                                    GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan,
                                    LessThanOrEqual, StringStartsWith, WriterCommitMessage)

from cohort_engine.llm import fsio
from cohort_engine.llm.store import new_folder, written

REVISIT_BYTES = 1000            # equal payloads of at least this size are kept once
FILE_BYTES = 64 << 20           # a file is closed when it holds this many bytes
BATCH_BYTES = 4 << 20
READ_BYTES = 1 << 20
# Names of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
SCHEMA = ("record_type string, record_id string, target_uri string, page_id long, refers_to long, "
          "payload_digest string, payload_bytes long, payload binary")
_COLUMNS = pa.schema([("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()),
                      ("page_id", pa.int64()), ("refers_to", pa.int64()), ("payload_digest", pa.string()),
                      ("payload_bytes", pa.int64()), ("payload", pa.binary())])


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def record(row: dict, date: str) -> bytes:
    """One WARC record; a revisit has no block."""
    body = row["payload"] or b""
    revisit = row["record_type"] == "revisit"
    block = b"" if revisit else HTTP % len(body) + body
    digest = base64.b32encode(bytes.fromhex(row["payload_digest"])).decode()
    lines = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", record_id(row["page_id"], row["payload_digest"])),
             ("WARC-Date", date)]
    if row["target_uri"] is not None:
        # a header is one line: line ends in a url are written as %0D and %0A
        lines.append(("WARC-Target-URI", row["target_uri"].replace("\r", "%0D").replace("\n", "%0A")))
    lines.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    if revisit:
        lines += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(row["refers_to"], row["payload_digest"])),
                  ("X-Refers-To-Page-Id", str(row["refers_to"]))]
    if row["page_id"] is not None:
        lines.append(("X-Page-Id", str(row["page_id"])))
    lines += [("X-Payload-Length", str(len(body))), ("Content-Type", "application/http; msgtype=response"),
              ("Content-Length", str(len(block)))]
    head = "".join(f"{k}: {v}\r\n" for k, v in lines).encode("utf-8", "replace")
    return VERSION + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n"


class Input:
    """A file read forward through a buffer; skipping beyond it is a seek."""

    def __init__(self, path: str):
        self.file = fsio.open_file(path)
        self.size, self.at, self.buffer, self.base = self.file.size(), 0, b"", 0

    def _fill(self, n: int) -> None:
        if self.at < self.base or self.at + n > self.base + len(self.buffer):
            self.buffer = self.file.read_at(min(max(n, READ_BYTES), self.size - self.at), self.at)
            self.base = self.at

    def head(self) -> bytes | None:
        """Bytes up to the empty line, None at the end of the file."""
        if self.at >= self.size:
            return None
        n = 4096
        while True:
            self._fill(min(n, self.size - self.at))
            end = self.buffer.find(b"\r\n\r\n", self.at - self.base)
            if end >= 0:
                out = self.buffer[self.at - self.base:end]
                self.at = self.base + end + 4
                return out
            if self.at + n >= self.size:
                raise ValueError("a WARC record without an end of headers")
            n *= 4

    def block(self, n: int) -> bytes:
        self._fill(n)
        out = self.buffer[self.at - self.base:self.at - self.base + n]
        self.at += n
        return out


def parse(head: bytes) -> dict:
    version, *lines = head.split(b"\r\n")
    if not version.startswith(b"WARC/"):
        raise ValueError(f"no WARC record: {version[:40]!r}")
    named = {}
    for line in lines:
        name, _, value = line.partition(b":")
        named[name.strip().lower().decode()] = value.strip().decode("utf-8", "replace")
    number = lambda k: int(named[k]) if k in named else None
    _, _, digest = named.get("warc-payload-digest", "").partition(":")
    return {"record_type": named.get("warc-type"), "record_id": named.get("warc-record-id"),
            "target_uri": named.get("warc-target-uri"), "page_id": number("x-page-id"),
            "refers_to": number("x-refers-to-page-id"),
            "payload_digest": base64.b32decode(digest).hex() if digest else None,
            "payload_bytes": number("x-payload-length"), "length": int(named["content-length"])}


def _test(f):
    """A pushed filter as a function of the header values."""
    name = f.attribute[0]
    if isinstance(f, IsNull):
        return lambda r: r[name] is None
    if isinstance(f, IsNotNull):
        return lambda r: r[name] is not None
    has = lambda ok: lambda r: r[name] is not None and ok(r[name])
    if isinstance(f, EqualTo):
        return has(lambda x: x == f.value)
    if isinstance(f, In):
        return has(lambda x: x in f.value)
    if isinstance(f, GreaterThan):
        return has(lambda x: x > f.value)
    if isinstance(f, GreaterThanOrEqual):
        return has(lambda x: x >= f.value)
    if isinstance(f, LessThan):
        return has(lambda x: x < f.value)
    if isinstance(f, LessThanOrEqual):
        return has(lambda x: x <= f.value)
    return has(lambda x: x.startswith(f.value))


_TESTED = (IsNull, IsNotNull, EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, StringStartsWith)
_ORDERED = (GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)
_NUMBERS = ("page_id", "refers_to", "payload_bytes")


class WarcFile(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool):
        self.path, self.payload, self.filters = path, payload, []

    def pushFilters(self, filters):
        for f in filters:
            name = getattr(f, "attribute", ("",))
            known = len(name) == 1 and name[0] in _COLUMNS.names and name[0] != "payload"
            if isinstance(f, _TESTED) and known and (name[0] in _NUMBERS or not isinstance(f, _ORDERED)):
                self.filters.append(f)
            else:
                yield f

    def partitions(self):
        return [WarcFile(p) for p, _ in fsio.files(self.path, ".warc")]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        if partition is None:       # an archive without files
            return
        tests, source, rows, held = [_test(f) for f in self.filters], Input(partition.value), [], 0
        while (head := source.head()) is not None:
            row = parse(head)
            end = source.at + row.pop("length")
            if all(t(row) for t in tests):
                row["payload"] = None
                if self.payload and row["record_type"] != "revisit":
                    block = source.block(end - source.at)
                    row["payload"] = block[block.index(b"\r\n\r\n") + 4:]
                    held += len(block)
                rows.append(row)
                if held > BATCH_BYTES or len(rows) >= 4096:
                    yield pa.RecordBatch.from_pylist(rows, schema=_COLUMNS)
                    rows, held = [], 0
            source.at = end + 4
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_COLUMNS)


@dataclass
class Written(WriterCommitMessage):
    files: list


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, date: str):
        self.path, self.date = path, date

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        base = f"{self.path}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:8]}"
        done, out, size = [], None, 0
        for batch in iterator:
            for i in range(batch.num_rows):
                data = record(batch.slice(i, 1).to_pylist()[0], self.date)
                if out is None:
                    name = f"{base}-{len(done):04d}.warc.pending"
                    system, p = fsio.at(name)
                    system.create_dir(p.rsplit("/", 1)[0], recursive=True)
                    out, size = system.open_output_stream(p), 0
                    done.append(name)
                out.write(data)
                size += len(data)
                if size >= FILE_BYTES:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return Written(done)

    def commit(self, messages) -> None:
        for m in messages:
            for name in m.files:
                system, p = fsio.at(name)
                system.move(p, p.removesuffix(".pending"))

    def abort(self, messages) -> None:
        for m in messages:
            for name in m.files if m is not None else []:
                system, p = fsio.at(name)
                system.delete_file(p)


class WarcSource(DataSource):
    """``spark.read.format("warc").load(folder)``.  Options: ``payload`` =
    ``skip`` leaves every block unread; ``date`` for writing."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(self.options["path"], self.options.get("payload", "read") != "skip")

    def writer(self, schema, overwrite: bool):
        return WarcWriter(self.options["path"], self.options.get("date", "1970-01-01T00:00:00Z"))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def records(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """The records of ``pages`` (page_id, url, html): of equal payloads of at
    least ``least`` bytes the one with the largest page_id is the response,
    the others revisit it.

    Defined cases: null html is an empty payload; a null url writes no target;
    a null page_id is never the largest, and where all of a group are null all
    are responses; rows that repeat the largest page_id are all responses.
    """
    own = (pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("target_uri"),
                        F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
           .withColumn("payload_digest", F.sha1("payload")))
    # the table of repeated payloads is written, so its true size decides how
    # it is joined
    many = written(own.filter(F.octet_length("payload") >= least).groupBy("payload_digest")
                   .agg(F.max("page_id").alias("keep"), F.count(F.lit(1)).alias("n")).filter("n > 1 AND keep IS NOT NULL")
                   .select("payload_digest", "keep"), "warc-repeats")
    again = F.col("keep").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keep"))
    return (own.join(many, "payload_digest", "left")
            .select(F.when(again, "revisit").otherwise("response").alias("record_type"), F.lit(None).cast("string").alias("record_id"),
                    "target_uri", "page_id", F.when(again, F.col("keep")).alias("refers_to"), "payload_digest",
                    F.octet_length("payload").cast("long").alias("payload_bytes"), "payload"))


def archive(spark: SparkSession, pages: DataFrame, folder: str | None = None) -> str:
    """Writes the records of ``pages``; returns the archive's folder."""
    register(spark)
    folder = folder or new_folder(spark, "warc")
    records(pages).write.format("warc").mode("append").option("path", folder).save()
    return folder

"""WARC archives as a Spark data source: headers first, payloads only where they are wanted."""

from __future__ import annotations

import io
import json
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, WriterCommitMessage
from pyspark.sql.types import StructType

from trendloom.plans.scratch import Scratch

#: Columns of a record; all but payload and payload_bytes come from the header, payload_bytes from either.
SCHEMA = "record_id string, record_type string, target_uri string, date string, content_type string, refers_to string, payload_digest string, payload_bytes long, payload binary"
#: Header fields by column.
FIELDS = {
    "record_id": "WARC-Record-ID",
    "record_type": "WARC-Type",
    "target_uri": "WARC-Target-URI",
    "date": "WARC-Date",
    "content_type": "Content-Type",
    "refers_to": "WARC-Refers-To",
    "payload_digest": "WARC-Payload-Digest",
}
LENGTH = "WARC-Payload-Length"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Each write adds a list of its files, of a name of its own, so that no two writes overwrite each other's.
MANIFEST = re.compile(r"_manifest-[0-9a-f]+\.json")
ROLL_BYTES, BATCH_RECORDS, BATCH_BYTES = 128 << 20, 512, 16 << 20


def _open_folder(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


def _clean(value: str) -> str:
    """A header value on one line: control characters are percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record_bytes(row: dict) -> bytes:
    """One WARC record of a row of SCHEMA; its block is an HTTP response, without payload in a revisit."""
    payload = b"" if row["record_type"] == "revisit" else (row["payload"] or b"")
    n = row["payload_bytes"] if row["payload_bytes"] is not None else len(payload)
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode() + payload
    head = [f"{field}: {_clean(str(row[c]))}" for c, field in FIELDS.items() if c != "content_type" and row.get(c) is not None]
    head.append("Content-Type: " + _clean(row.get("content_type") or "application/http; msgtype=response"))
    if row["record_type"] == "revisit":
        head.append(f"WARC-Profile: {PROFILE}")
    head += [f"{LENGTH}: {n}", f"Content-Length: {len(block)}"]
    return "\r\n".join(["WARC/1.1", *head, "", ""]).encode() + block + b"\r\n\r\n"


class _Stream:
    """Bytes of one archive: lines, blocks, and skipping; gzip members are inflated as they come."""

    def __init__(self, raw: io.BufferedReader, gzipped: bool):
        self.raw, self.gzipped = raw, gzipped
        self.held = bytearray()
        self.inflate = zlib.decompressobj(31) if gzipped else None

    def _more(self) -> bool:
        while True:
            if self.inflate.eof:
                rest = self.inflate.unused_data
                self.inflate = zlib.decompressobj(31)
            else:
                rest = b""
            data = rest or self.raw.read(1 << 16)
            if not data:
                return False
            got = self.inflate.decompress(data)
            if got:
                self.held += got
                return True

    def line(self) -> bytes:
        if not self.gzipped:
            return self.raw.readline()
        while (at := self.held.find(b"\n")) < 0:
            if not self._more():
                break
        end = at + 1 if at >= 0 else len(self.held)
        out = bytes(self.held[:end])
        del self.held[:end]
        return out

    def read(self, n: int) -> bytes:
        if not self.gzipped:
            return self.raw.read(n)
        while len(self.held) < n and self._more():
            pass
        out = bytes(self.held[:n])
        del self.held[:n]
        return out

    def skip(self, n: int) -> None:
        """Passes n bytes: a seek where the file isn't compressed, else inflated and let go."""
        if not self.gzipped:
            self.raw.seek(n, io.SEEK_CUR)
            return
        while n > 0 and (self.held or self._more()):
            k = min(n, len(self.held))
            del self.held[:k]
            n -= k


def http_payload(block: bytes) -> bytes:
    """The body of an HTTP message, chunks joined and gzip or deflate undone; as it stands if that fails or the coding is another."""
    head, _, body = block.partition(b"\r\n\r\n")
    fields = dict(re.findall(r"(?m)^([\w-]+):[ \t]*([^\r\n]*?)[ \t]*\r?$", head.decode("latin-1").lower()))
    try:
        if fields.get("transfer-encoding", "").endswith("chunked"):
            at, parts = 0, []
            while (end := body.index(b"\r\n", at)) and (n := int(body[at:end].split(b";")[0], 16)):
                parts.append(body[end + 2 : end + 2 + n])
                at = end + 4 + n
            body = b"".join(parts)
        coding = fields.get("content-encoding")
        if coding in ("gzip", "x-gzip"):
            return zlib.decompress(body, 31)
        if coding == "deflate":
            return zlib.decompress(body, 15 if body[:1] == b"\x78" else -15)
    except (ValueError, zlib.error):
        pass
    return body


def read_records(stream: _Stream, wanted: list[tuple[str, frozenset]], payloads: bool, present: Iterable[str] = ()) -> Iterator[tuple]:
    """Rows of SCHEMA with one of the wanted values in each column named, none null in ``present``. A record's header decides whether its block is read or skipped."""
    columns = {field.lower(): c for c, field in FIELDS.items()}
    while first := stream.line():
        if not first.strip():
            continue
        if not first.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {first[:40]!r}")
        head: dict[str, str] = {}
        while (line := stream.line()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            head[name.strip().lower()] = value.strip()
        length = int(head["content-length"])
        row = {c: head.get(f) for f, c in columns.items()}
        if not all(row[c] in values for c, values in wanted) or any(row[c] is None for c in present):
            stream.skip(length)
            continue
        n = int(head[LENGTH.lower()]) if LENGTH.lower() in head else None
        payload = None
        if payloads and row["record_type"] != "revisit":
            block = stream.read(length)
            if "application/http" in (row["content_type"] or ""):
                payload = http_payload(block)
            else:
                payload = block
            n = len(payload)
        else:
            stream.skip(length)
        yield (*(row[c] for c in FIELDS), n, payload)


@dataclass
class ArchiveFile(InputPartition):
    path: str


def manifests(fs: pa.fs.FileSystem, folder: str) -> dict[str, list[str]]:
    """The files that each write to a folder listed, by the list's name."""
    out = {}
    for i in fs.get_file_info(pa.fs.FileSelector(folder, allow_not_found=True)):
        if MANIFEST.fullmatch(i.base_name):
            with fs.open_input_stream(f"{folder}/{i.base_name}") as f:
                out[i.base_name] = json.loads(f.read())
    return out


class WarcReader(DataSourceReader):
    """A partition for each archive file; record types and header values are pushed down to the header parser."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.payloads = str(options.get("payload", "true")).lower() == "true"
        self.wanted: list[tuple[str, frozenset]] = []
        self.present: list[str] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if isinstance(f, EqualTo) and name in FIELDS:
                self.wanted.append((name, frozenset([f.value])))
            elif isinstance(f, In) and name in FIELDS:
                self.wanted.append((name, frozenset(v for v in f.value if v is not None)))
            elif isinstance(f, IsNotNull) and name in FIELDS:
                self.present.append(name)
            else:
                yield f

    def partitions(self) -> list[ArchiveFile]:
        fs, folder = _open_folder(self.path)
        listed = manifests(fs, folder)
        if listed:
            names = [n for kept in listed.values() for n in kept]
        else:
            names = [i.base_name for i in fs.get_file_info(pa.fs.FileSelector(folder)) if i.base_name.endswith((".warc", ".warc.gz"))]
        return [ArchiveFile(n) for n in sorted(names)]

    def read(self, partition: ArchiveFile) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, ArchiveFile):
            return
        fs, folder = _open_folder(self.path)
        names = [*FIELDS, "payload_bytes", "payload"]
        types = [*[pa.string()] * len(FIELDS), pa.int64(), pa.binary()]
        rows, size = [], 0
        with fs.open_input_file(f"{folder}/{partition.path}") as f:
            for r in read_records(_Stream(io.BufferedReader(f, 1 << 20), partition.path.endswith(".gz")), self.wanted, self.payloads, self.present):
                rows.append(r)
                size += len(r[-1] or b"")
                if len(rows) >= BATCH_RECORDS or size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Each task writes files of its own names; only those of tasks that succeeded enter the manifest."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.gzipped = options.get("compression", "gzip") == "gzip"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, folder = _open_folder(self.path)
        fs.create_dir(folder, recursive=True)
        names, out, size = [], None, 0
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if out is None or size >= ROLL_BYTES:
                        if out is not None:
                            out.close()
                        names.append(f"{uuid.uuid4().hex}.warc" + ".gz" * self.gzipped)
                        out, size = fs.open_output_stream(f"{folder}/{names[-1]}", compression=None), 0
                    data = record_bytes(row)
                    if self.gzipped:
                        deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
                        data = deflate.compress(data) + deflate.flush()
                    out.write(data)
                    size += len(data)
        finally:
            if out is not None:
                out.close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        fs, folder = _open_folder(self.path)
        fs.create_dir(folder, recursive=True)
        old = manifests(fs, folder) if self.overwrite else {}
        with fs.open_output_stream(f"{folder}/_manifest-{uuid.uuid4().hex}.json", compression=None) as f:
            f.write(json.dumps(sorted(n for m in messages if m is not None for n in m.names)).encode())
        for listed, names in old.items():
            fs.delete_file(f"{folder}/{listed}")
            for n in names:
                fs.delete_file(f"{folder}/{n}")

    def abort(self, messages: list[Written | None]) -> None:
        fs, folder = _open_folder(self.path)
        for n in [n for m in messages if m is not None for n in m.names]:
            fs.delete_file(f"{folder}/{n}")


class WarcSource(DataSource):
    """``spark.read.format("warc")`` and ``df.write.format("warc")``.

    Options: path, a folder; payload, whether payloads are read (true); compression, gzip (a
    member for each record) or none.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, with predicates pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def to_records(pages: DataFrame, scratch: Scratch, least: int = 100, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Rows of SCHEMA, one for each row of pages.

    Of equal payloads of ``least`` bytes or more, that with the smallest page_id is the
    response. Smallest ids are found by digest with map-side partials; only digests that
    occur twice are joined back, from a written table, so that its size decides the join.
    """
    payload = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    rows = pages.select("page_id", "url", payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "payload_bytes": F.octet_length("payload").cast("long")})
    seen = rows.where(F.col("payload_bytes") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    repeated = scratch.save(seen.where("n > 1").select("digest", "first"), "repeated")
    rows = rows.join(repeated, "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    return rows.select(
        F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit(""))).alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.coalesce("url", F.lit("about:blank")).alias("target_uri"),
        F.lit(date).alias("date"),
        F.lit(None).cast("string").alias("content_type"),
        F.when(revisit, F.concat(F.lit("urn:page:"), F.col("first").cast("string"))).alias("refers_to"),
        F.concat(F.lit("sha256:"), "digest").alias("payload_digest"),
        "payload_bytes",
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def archive(pages: DataFrame, path: str, scratch: Scratch, compression: str = "gzip") -> None:
    """Writes pages as WARC files into a folder that all executors share."""
    register(pages.sparkSession)
    to_records(pages, scratch).write.format("warc").option("path", path).option("compression", compression).mode("append").save()


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of an archive; those of responses from the payloads themselves."""
    register(spark)
    records = spark.read.format("warc").option("path", path).load().where(F.col("record_type").isin("response", "revisit"))
    number = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d+)$", 1).try_cast("long")
    return records.select(
        number("record_id").alias("page_id"),
        F.coalesce(F.octet_length("payload").cast("long"), "payload_bytes").alias("payload_bytes"),
        F.coalesce(F.sha2("payload", 256), F.regexp_replace("payload_digest", "^sha256:", "")).alias("payload_digest"),
        "record_type",
        number("refers_to").alias("refers_to"),
    )


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes pages to an archive in the shared folder and reads it back, as read_back() does.

    A null html is an empty payload; a null url becomes about:blank; long pages are whole
    records, one at a time in memory. Rows that repeat the
    smallest page_id of their payload are responses all; a null page_id is never the smallest
    and stays null. Other columns are ignored whatever their names; an empty table gives an
    empty one.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    path = scratch.path("archive")
    archive(pages, path, scratch)
    return read_back(pages.sparkSession, path)

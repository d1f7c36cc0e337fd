"""WARC archives as a Python data source of Spark.

Writing: every task writes one gzip file, a member per record, under a name of
its own; the commit lists the files of the successful tasks in a manifest, so
that files of failed or repeated attempts are never read. Each member carries
the compressed length in the "sl" extra field, as the WARC standard proposes.

Reading: files are cut into byte ranges; a record belongs to the range in which
its member begins. Of each member only the first bytes are inflated for the
headers; if the record's type or headers fail a predicate, or no payload is
asked for, the reader jumps to the next member by the extra field (foreign
members without it are inflated and dropped).

Predicates: ``option("types", "response,revisit")``, ``option("where", json)``
with header names and values, and, with the format ``warc_filtered``, filters on
``record_type`` and the header columns.
The user schema selects columns; without ``payload`` in it none is decoded.

Null bodies are empty payloads, null ids have the record id ``page:``, line
ends in urls are percent-encoded. An empty table gives archives without records.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from leakatlas.llm.shared import broadcast_if_small

MANIFEST = "_manifest.json"
SPLIT_BYTES = 64 << 20
HEAD_BYTES = 4096
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
MEMBER = b"\x1f\x8b\x08\x04"
ID = "urn:page:"
# Columns and the headers they come from.
HEADERS = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "target_uri": "WARC-Target-URI",
    "refers_to": "WARC-Refers-To",
    "payload_digest": "WARC-Payload-Digest",
    "payload_length": "X-Payload-Length",
}
SCHEMA = ", ".join(f"{c} string" for c in HEADERS) + ", payload binary"


def open_folder(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the folder of a uri or a plain path."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(raw: bytes, level: int) -> bytes:
    """One gzip member with its own compressed and uncompressed length in "sl"."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -zlib.MAX_WBITS)
    body = packer.compress(raw) + packer.flush()
    total = 10 + 2 + 12 + len(body) + 8
    return MEMBER + bytes(4) + b"\x00\xff" + struct.pack("<H2sHII", 12, b"sl", 8, total, len(raw) & 0xFFFFFFFF) + body + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


def record(headers: dict[str, str | None], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers.items() if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class Written(WriterCommitMessage):
    name: str
    records: int


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.path, self.level = options["path"], int(options.get("level", "3"))

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, folder = open_folder(self.path)
        store.create_dir(folder)
        name, n = f"part-{uuid.uuid4().hex}.warc.gz", 0
        with store.open_output_stream(f"{folder}/{name}", compression=None) as out:
            out.write(member(record({"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n"), self.level))
            for batch in batches:
                for start in range(0, batch.num_rows, 256):
                    for row in batch.slice(start, 256).to_pylist():
                        out.write(member(self.one(row), self.level))
                        n += 1
        return Written(name, n)

    @staticmethod
    def one(row: dict) -> bytes:
        visit = row["record_type"] == "revisit"
        payload = b"" if visit else row["payload"] or b""
        uri = row["target_uri"]
        return record(
            {
                "WARC-Type": row["record_type"],
                "WARC-Record-ID": f"<{row['record_id']}>",
                "WARC-Date": "1970-01-01T00:00:00Z",
                "WARC-Target-URI": None if uri is None else "".join(f"%{ord(c):02X}" if ord(c) < 32 else c for c in uri),
                "WARC-Refers-To": f"<{row['refers_to']}>" if visit else None,
                "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if visit else None,
                "WARC-Payload-Digest": "sha1:" + base64.b32encode(bytes.fromhex(row["payload_digest"])).decode(),
                "X-Payload-Length": str(row["payload_length"] if visit else len(payload)),
                "Content-Type": "application/http; msgtype=response",
            },
            HTTP_HEAD + payload,
        )

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, folder = open_folder(self.path)
        store.create_dir(folder)
        with store.open_output_stream(f"{folder}/{MANIFEST}", compression=None) as out:
            out.write(json.dumps([m.name for m in messages if isinstance(m, Written)]).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, folder = open_folder(self.path)
        for m in messages:
            if isinstance(m, Written):
                store.delete_file(f"{folder}/{m.name}")


@dataclass
class Range(InputPartition):
    file: str
    start: int
    end: int


@dataclass
class Wanted:
    """Which records are decoded: header name -> allowed values."""

    where: dict[str, set[str]] = field(default_factory=dict)

    def add(self, header: str, values: Iterable[str]) -> None:
        values = set(values)
        self.where[header] = self.where[header] & values if header in self.where else values

    def holds(self, headers: dict[str, str]) -> bool:
        return all(headers.get(h.lower(), "").strip("<>") in values for h, values in self.where.items())


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.path, self.columns = options["path"], schema.names
        self.split = int(options.get("split_bytes", SPLIT_BYTES))
        self.wanted = Wanted()
        if options.get("types"):
            self.wanted.add("WARC-Type", options["types"].split(","))
        for header, value in json.loads(options.get("where", "{}")).items():
            self.wanted.add(header, value if isinstance(value, list) else [value])

    def partitions(self) -> list[InputPartition]:
        store, folder = open_folder(self.path)
        found = {i.base_name: i.size for i in store.get_file_info(fs.FileSelector(folder)) if i.is_file}
        if MANIFEST in found:
            with store.open_input_stream(f"{folder}/{MANIFEST}") as f:
                names = json.loads(f.read())
        else:
            names = sorted(n for n in found if n.endswith((".warc.gz", ".warc")))
        plan = [Range(n, at, min(at + self.split, found[n])) for n in names for at in range(0, found[n], self.split if n.endswith(".gz") else found[n])]
        return plan or [Range("", 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if not part.file:
            return
        store, folder = open_folder(self.path)
        rows: list[dict] = []
        held = 0
        with store.open_input_file(f"{folder}/{part.file}") as file:
            records = packed_records(file, part, self) if part.file.endswith(".gz") else plain_records(file, self)
            for row in records:
                rows.append(row)
                held += len(row.get("payload") or b"") + 200
                if held > 4 << 20:
                    yield self.batch(rows)
                    rows, held = [], 0
        if rows:
            yield self.batch(rows)

    def batch(self, rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], pa.binary() if c == "payload" else pa.string()) for c in self.columns], names=self.columns)

    def row(self, headers: dict[str, str], payload: bytes | None) -> dict:
        out: dict = {c: headers.get(HEADERS[c].lower()) for c in self.columns if c in HEADERS}
        for c in ("record_id", "refers_to"):
            if out.get(c) is not None:
                out[c] = out[c].strip("<>")
        if "payload" in self.columns:
            out["payload"] = payload
        return out


class FilteringReader(WarcReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            name = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if name in HEADERS and name != "payload_digest":
                self.wanted.add(HEADERS[name], [f.value] if isinstance(f, EqualTo) else f.value)
            else:
                yield f


def parse_headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    pairs = (line.partition(":") for line in lines[1:] if ":" in line)
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def payload_of(headers: dict[str, str], block: bytes) -> bytes:
    """The block without its HTTP head."""
    if headers.get("content-type", "").startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


def checked(headers: dict[str, str], payload: bytes) -> bytes:
    """``payload``, if it has the SHA-1 that the headers of a full record state."""
    stated = headers.get("warc-payload-digest", "")
    if headers["warc-type"] != "revisit" and stated.startswith("sha1:") and stated[5:] != digest(payload):
        raise ValueError(f"payload of {headers.get('warc-record-id')} differs from its digest")
    return payload


def next_member(file, at: int, end: int) -> int:
    """The first member that begins from ``at`` on and before ``end``; else ``end``."""
    while at < end:
        file.seek(at)
        window = file.read(min(1 << 20, end - at) + 64)
        place = window.find(MEMBER)
        while 0 <= place < end - at:
            try:
                file.seek(at + place)
                if zlib.decompressobj(31).decompress(file.read(1024), 16).startswith(b"WARC/"):
                    return at + place
            except zlib.error:
                pass
            place = window.find(MEMBER, place + 1)
        at += max(1, len(window) - 64)
    return end


def packed_records(file, part: Range, reader: WarcReader) -> Iterator[dict]:
    at = part.start if part.start == 0 else next_member(file, part.start, part.end)
    size = file.size()
    with_payload = "payload" in reader.columns
    while at < part.end:
        file.seek(at)
        raw = file.read(HEAD_BYTES)
        length = None
        if raw[:4] == MEMBER and raw[12:14] == b"sl":
            length = struct.unpack("<I", raw[16:20])[0]
        unpack = zlib.decompressobj(31)
        head = b""
        while b"\r\n\r\n" not in head:
            if not raw:
                raw = file.read(HEAD_BYTES)
                if not raw:
                    break
            head += unpack.decompress(raw, HEAD_BYTES)
            raw = unpack.unconsumed_tail
        text, _, rest = head.partition(b"\r\n\r\n")
        headers = parse_headers(text)
        wanted = headers.get("warc-type") is not None and reader.wanted.holds(headers) and (headers["warc-type"] != "warcinfo" or "WARC-Type" in reader.wanted.where)
        if length is None or (wanted and with_payload):
            parts = [rest, unpack.decompress(raw)]
            while not unpack.eof:
                raw = file.read(1 << 16 if length is None else max(1, at + length - file.tell()))
                if not raw:
                    break
                parts.append(unpack.decompress(raw))
            if length is None:
                length = (file.tell() - len(unpack.unused_data)) - at
            block = b"".join(parts)[: int(headers.get("content-length", 0))]
            if wanted:
                yield reader.row(headers, checked(headers, payload_of(headers, block)) if with_payload else None)
        elif wanted:
            yield reader.row(headers, None)
        if length <= 0:
            raise ValueError(f"broken record at byte {at} of {part.file}")
        at = min(size, at + length)


def plain_records(file, reader: WarcReader) -> Iterator[dict]:
    with_payload = "payload" in reader.columns
    at, size = 0, file.size()
    while at < size:
        file.seek(at)
        head = b""
        while b"\r\n\r\n" not in head:
            more = file.read(HEAD_BYTES)
            if not more:
                break
            head += more
        text = head.partition(b"\r\n\r\n")[0]
        headers = parse_headers(text.lstrip(b"\r\n"))
        length, begin = int(headers.get("content-length", 0)), at + len(text) + 4
        if headers.get("warc-type") and reader.wanted.holds(headers) and headers["warc-type"] != "warcinfo":
            block = None
            if with_payload:
                file.seek(begin)
                block = checked(headers, payload_of(headers, file.read(length)))
            yield reader.row(headers, block)
        at = begin + length + 4


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WarcReader(dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(dict(self.options), schema)


class FilteringWarcSource(WarcSource):
    """As WarcSource, and filters of the query are pushed into the reader.

    Spark 4.1 keeps the filters of a relation's first scan, so every query needs
    a ``load`` of its own; ``read_warc`` therefore uses the options instead.
    """

    @classmethod
    def name(cls) -> str:
        return "warc_filtered"

    def reader(self, schema: StructType) -> DataSourceReader:
        return FilteringReader(dict(self.options), schema)


def register(spark: SparkSession) -> None:
    """Make both formats known to the session and let Spark push filters into Python sources."""
    spark.dataSource.register(WarcSource)
    spark.dataSource.register(FilteringWarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_warc(spark: SparkSession, path: str, columns: str = SCHEMA, types: str = "", where: dict | None = None) -> DataFrame:
    """Records of the archives below ``path``; only what the arguments ask for is decoded."""
    register(spark)
    return spark.read.format("warc").schema(columns).option("types", types).option("where", json.dumps(where or {})).load(path)


def page_records(pages: DataFrame, page_id: str = "page_id", url: str = "url", body: str = "html", least: int = 0) -> DataFrame:
    """Records to write. Of equal payloads of at least ``least`` bytes the smallest id is the response, others revisit it."""
    source = pages.select(F.col(page_id).cast("string").alias("id"), F.col(page_id).alias("raw_id"), F.col(url).cast("string").alias("target_uri"), F.coalesce(F.col(body).cast("string"), F.lit("")).alias("body"))
    source = source.withColumn("payload_length", F.octet_length("body").cast("long")).withColumn("sha1", F.sha1("body"))
    groups = source.filter(F.col("payload_length") >= least).groupBy("sha1").agg(F.min("raw_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1 and first_id is not null").select(F.col("sha1").alias("of"), F.col("first_id"))
    marked = source.join(broadcast_if_small(groups, "warc-copies"), F.col("sha1") == F.col("of"), "left")
    visit = F.col("of").isNotNull() & ~F.col("raw_id").eqNullSafe(F.col("first_id"))
    return marked.select(
        F.when(visit, "revisit").otherwise("response").alias("record_type"),
        F.concat(F.lit(ID), F.coalesce("id", F.lit(""))).alias("record_id"),
        "target_uri",
        F.when(visit, F.concat(F.lit(ID), F.col("first_id").cast("string"))).alias("refers_to"),
        F.col("sha1").alias("payload_digest"),
        F.col("payload_length").cast("string").alias("payload_length"),
        F.when(~visit, F.encode("body", "UTF-8")).alias("payload"),
    )


def write_warc(pages: DataFrame, path: str, **names: str) -> None:
    """Write the records of ``pages`` as archives below ``path``."""
    register(pages.sparkSession)
    page_records(pages, **names).write.format("warc").mode("append").save(path)

"""WARC archives: a writer and a Python data source ("warc").

Records are gzip members of their own. The writer notes a member's length in its header (extra field ``sl``), so that the
reader inflates only as much as holds the record's headers and passes over members that it doesn't want; members without
that field are inflated and dropped, and may hold any number of records, as may a whole .warc.gz that was compressed as one
stream; .warc archives are read as they are. A record that ends too soon is an error. The reader plans partitions from the archives' sizes, takes equality and IN
predicates on record type and on header columns to itself, and decodes payloads only where the option ``payload`` asks for
it (the default).

Defined cases: a null payload is empty; a null url gives no target header; control characters and spaces in header values
are percent-coded; of rows with one page_id each gets its own record, and rows with the smallest page_id of a payload are
all responses; rows without a page_id never are revisited while another has the payload. An empty table gives an empty
table. Archives roll over at ``roll`` bytes, and files of failed tasks are in no manifest and so are never read.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from .shared import new_path

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"  # archives are made from tables that tell no date; equal input gives equal bytes
LEAST_BYTES, ROLL = 100, 256 << 20
#: Columns that records' headers give, and which header.
HEADERS = {
    "record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "warc_date": "warc-date",
    "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to", "content_type": "content-type", "payload_length": "x-payload-length",
}
SCHEMA = ", ".join([*(f"{c} string" for c in HEADERS), "content_length long", "payload binary"])


def header_value(value: str) -> str:
    return "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in value)


def record(kind: str, name: str, url: str | None, digest: str, length: int, payload: bytes, refers_to: str | None) -> bytes:
    """One WARC record; a revisit's block ends with the HTTP headers."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {DATE}"]
    lines += [f"WARC-Target-URI: {header_value(url)}"] if url else []
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {length}"]
    lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"] if kind == "revisit" else []
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member whose extra field sl holds its own length and that of its data."""
    pack = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = pack.compress(data) + pack.flush()
    total = 10 + 2 + 12 + len(body) + 8
    head = b"\x1f\x8b\x08\x04" + bytes(5) + b"\xff" + struct.pack("<H2sHII", 12, b"sl", 8, total & 0xFFFFFFFF, len(data) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def filesystem(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (pa.fs.LocalFileSystem(), path)


def write(records: DataFrame, path: str, roll: int = ROLL) -> DataFrame:
    """Write (page_id, url, html, record_type, refers_to) to archives under path; gives (file, bytes, records) of those that count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(path)
        fs.create_dir(root, recursive=True)
        out, name, size, count = None, "", 0, 0

        def closed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"file": [name], "bytes": [size], "records": [count]})

        for b in batches:
            ids, urls, html, kinds, refers = (b.column(i) for i in range(5))
            for i in range(b.num_rows):
                if out is None:
                    name, size, count = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                payload = (html[i].as_py() or "").encode()
                digest = hashlib.sha256(payload).hexdigest()
                page, refer = ids[i].as_py(), refers[i].as_py()
                data = member(record(kinds[i].as_py(), "" if page is None else str(page), urls[i].as_py(), digest, len(payload), payload, None if refer is None else str(refer)))
                out.write(data)
                size, count = size + len(data), count + 1
                if size >= roll:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    rows = records.select("page_id", F.col("url").cast("string"), F.col("html").cast("string"), "record_type", "refers_to")
    return rows.mapInArrow(run, "file string, bytes long, records long")


def parse_headers(text: bytes) -> dict[str, str]:
    out = {}
    for line in text.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if colon:
            out[name.strip().decode("ascii", "replace").lower()] = value.strip().decode("utf-8", "replace")
    return out


class Plain:
    """Bytes of an archive that isn't compressed, from a place on."""

    def __init__(self, stream: BinaryIO, at: int):
        self.stream = stream
        stream.seek(at)

    def more(self) -> bytes:
        return self.stream.read(1 << 16)


class Inflated:
    """A gzip member's data, piece by piece. at: where the member ends, once it has."""

    def __init__(self, stream: BinaryIO, chunk: bytes):
        self.stream, self.inflate, self.chunk, self.at = stream, zlib.decompressobj(31), chunk, 0

    def more(self) -> bytes:
        while not self.inflate.eof:
            data = self.inflate.decompress(self.inflate.unconsumed_tail or self.chunk or self.stream.read(1 << 16), 1 << 16)
            ended = not self.inflate.unconsumed_tail and not data and not self.chunk and self.stream.tell() >= self.stream.size()
            self.chunk = b""
            if self.inflate.eof:
                self.at = self.stream.tell() - len(self.inflate.unused_data)
            elif ended:
                raise ValueError("a gzip member ends too soon")
            if data:
                return data
        return b""


def body_of(headers: dict[str, str], block: bytes) -> bytes:
    return block.partition(b"\r\n\r\n")[2] if "application/http" in headers.get("content-type", "") else block


def records_of(source: Plain | Inflated, wanted, payload: bool, only_first: bool = False) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """The wanted records of a run of bytes, to its end. only_first: it holds one record, whose block needn't be read unless it is wanted."""
    held = b""
    while True:
        # Between records there are empty lines.
        while not (held := held.lstrip(b"\r\n")):
            if not (new := source.more()):
                return
            held = new
        while b"\r\n\r\n" not in held:
            if not (new := source.more()):
                raise ValueError("a WARC record's headers end too soon")
            held += new
        head, _, held = held.partition(b"\r\n\r\n")
        headers = parse_headers(head)
        if not head.startswith(b"WARC/"):
            raise ValueError("no WARC record where one should begin")
        take = wanted(headers)
        if only_first and not (take and payload):
            if take:
                yield headers, None
            return
        left, parts = int(headers.get("content-length", "0")), []
        while left:
            if not held and not (held := source.more()):
                raise ValueError("a WARC record's block ends too soon")
            part, held = held[:left], held[left:]
            left -= len(part)
            if take and payload:
                parts.append(part)
        if take:
            yield headers, body_of(headers, b"".join(parts)) if payload else None
        if only_first:
            return


def records_in(stream: BinaryIO, wanted, payload: bool, gzipped: bool = True) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """(headers, payload) of the records whose headers are wanted. Others are passed over by their members' lengths."""
    size, at = stream.size(), 0
    if not gzipped:
        yield from records_of(Plain(stream, 0), wanted, payload)
        return
    while at < size:
        stream.seek(at)
        chunk = stream.read(8192)
        # Members with the field sl are the writer's, of one record each.
        length = struct.unpack_from("<I", chunk, 16)[0] if len(chunk) >= 24 and chunk[3] & 4 and chunk[12:14] == b"sl" else None
        source = Inflated(stream, chunk)
        yield from records_of(source, wanted, payload, bool(length))
        at = at + length if length else source.at


@dataclass
class Files(InputPartition):
    """Archives that one task reads."""

    names: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str], fields: list[str]):
        self.path, self.manifest = options["path"], options.get("manifest", "")
        self.target = int(options.get("partition_bytes", 128 << 20))
        self.payload, self.fields = options.get("payload", "true").lower() == "true", fields
        self.tests: list[tuple[str, list]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Keeps equality and IN on header columns; the rest stays with Spark."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in HEADERS:
                self.tests.append((HEADERS[f.attribute[0]], [f.value] if isinstance(f, EqualTo) else list(f.value)))
            else:
                yield f

    def partitions(self) -> list[Files]:
        fs, root = filesystem(self.path)
        if self.manifest:
            of, place = filesystem(self.manifest)
            rows = pyarrow.parquet.read_table(place, columns=["file", "bytes"], filesystem=of).to_pydict()
            found = sorted(zip(rows["file"], rows["bytes"], strict=True))
        else:
            infos = fs.get_file_info(pa.fs.FileSelector(root, recursive=True, allow_not_found=True))
            found = sorted((i.path[len(root) :].lstrip("/"), i.size) for i in infos if i.is_file and i.path.endswith((".warc", ".warc.gz")))
        out, held, total = [], [], 0
        for name, size in found:
            held.append(name)
            total += size
            if total >= self.target:
                out.append(Files(held))
                held, total = [], 0
        return [*out, Files(held)] if held or not out else out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(self.path)
        wanted = lambda h: all(h.get(name) in values for name, values in self.tests)
        types = {"content_length": pa.int64(), "payload": pa.binary()}
        schema = pa.schema([(f, types.get(f, pa.string())) for f in self.fields])
        rows, size = [], 0
        for name in partition.names:
            with fs.open_input_file(f"{root}/{name}") as stream:
                for headers, payload in records_in(stream, wanted, self.payload and "payload" in self.fields, not name.endswith(".warc")):
                    values = {c: headers.get(h) for c, h in HEADERS.items()}
                    values |= {"content_length": int(headers.get("content-length", "0")), "payload": payload}
                    rows.append([values[f] for f in self.fields])
                    size += len(payload or b"") + 500
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


class WarcDataSource(DataSource):
    """spark.read.format("warc").load(folder); options path, manifest (Parquet of file and bytes: only these are read), payload, partition_bytes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options), [f.name for f in schema.fields])


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def read(spark: SparkSession, path: str, manifest: str | None = None, payload: bool = True) -> DataFrame:
    register(spark)
    found = spark.read.format("warc").option("payload", str(payload).lower()).option("partition_bytes", 16 << 20)
    return (found if manifest is None else found.option("manifest", manifest)).load(path)


def with_revisits(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, html, record_type, refers_to: the smallest page_id of a payload answers, the others revisit it."""
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").withColumn("digest", F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256))
    sized = own.filter(F.octet_length("html") >= least_bytes)
    firsts = sized.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1").drop("n")
    revisit = F.col("first_id").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("first_id")))
    return own.join(firsts, "digest", "left").select(
        "page_id", "url", "html", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first_id")).alias("refers_to")
    )


def round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Archive the pages and read them back: a row for each record.

    Digest and length come from the decoded payload where the record has one, and from a revisit's headers.
    """
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    manifest = new_path(spark, "manifest")
    write(with_revisits(pages), path).write.parquet(manifest)
    found = read(spark, path, manifest)
    response = F.col("record_type") == "response"
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, 'urn:page:(-?[0-9]+)', 1) AS BIGINT)")
    return found.select(
        number("record_id").alias("page_id"),
        F.when(response, F.octet_length("payload").cast("long")).otherwise(F.col("payload_length").cast("long")).alias("payload_bytes"),
        F.when(response, F.sha2("payload", 256)).otherwise(F.regexp_extract("payload_digest", "^sha256:(.*)$", 1)).alias("payload_digest"),
        "record_type",
        number("refers_to").alias("refers_to"),
    )


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first_id THEN first_id END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)"""

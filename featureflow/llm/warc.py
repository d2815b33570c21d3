"""WARC archives: a writer, a normaliser of monolithic gzip files, a reader.

``write_monolithic`` writes one WARC file per partition as a single gzip
stream, as many tools leave them.  ``normalise`` inflates each such file once,
as a stream, and rewrites every record as a gzip member of its own, with a
sidecar index of (offset, length, record id) per record, so that any record can
be read by itself.  ``read_records`` reads the records back through the index.

Pages with equal payloads of at least ``least`` bytes are stored once: the one
with the largest page id is a response, the others revisit it.

Defined results: null html is an empty payload; a null url becomes the record
id; a null page id never is the largest (a group of null ids only is all
responses); repeated rows of the largest id are all responses; an empty table
gives no records; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Bytes of a record in memory while it is copied.
CHUNK = 1 << 20
_GZIP = 31  # zlib's window bits for the gzip format
_ID = "urn:x-page:"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def with_record_types(pages: DataFrame, least: int) -> DataFrame:
    """page_id, url, payload, bytes, digest (hex SHA-1), refers_to (null: a
    response).  The largest id of a payload that several pages have comes from a
    grouped maximum and a join: most payloads are alone, so what is joined is
    small, and Spark leaves the pages in place or splits a hot payload."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url",
        F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("bytes", F.octet_length("payload").cast("long")).withColumn("digest", F.sha1("payload"))
    largest = rows.where(F.col("bytes") >= least).groupBy("digest", "bytes").agg(
        F.max("page_id").alias("largest"), F.count("*").alias("n")).where("n > 1").drop("n")
    revisit = F.col("largest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("largest"))
    return rows.join(largest, ["digest", "bytes"], "left").select(
        "page_id", "url", "payload", "bytes", "digest", F.when(revisit, F.col("largest")).alias("refers_to"))


def _base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One whole record.  A revisit has the headers of its response only; its
    payload's length stands in a header of its own."""
    name = f"{_ID}{'null' if page_id is None else page_id}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{name}>",
        f"WARC-Target-URI: {quote(url, safe='%/:?#[]@!$&()*+,;=~') if url else name}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{_base32(digest)}",
        f"WARC-Block-Digest: sha1:{_base32(hashlib.sha1(block).hexdigest())}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To: <{_ID}{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def write_monolithic(records: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", level: int = 1) -> int:
    """One gzip stream per partition, ``part-NNNNNN.warc.gz``; their number."""
    common.ship_package(records.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        fs, root = common.file_system(folder)
        out = common.AtomicFile(fs, f"{root}/part-{part:06d}.warc.gz")
        packer = zlib.compressobj(level, zlib.DEFLATED, _GZIP)
        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "payload", "digest", "refers_to")]
            for k in range(batch.num_rows):
                out.write(packer.compress(record_bytes(*(c[k].as_py() for c in columns), date)))
        out.write(packer.flush())
        out.commit()
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64())})

    parts = [r["part"] for r in records.mapInArrow(run, "part long").collect()]  # one per file
    if sorted(parts) != list(range(len(parts))):
        raise RuntimeError("a partition of the archive is missing")
    return len(parts)


class _Inflated:
    """The inflated bytes of a gzip file, read once from front to back."""

    def __init__(self, source):
        self.source, self.unpacker, self.held = source, zlib.decompressobj(_GZIP), bytearray()
        self.raw = b""

    def _more(self) -> bool:
        while True:
            if self.unpacker.eof:  # further members of the file, if any
                rest = self.unpacker.unused_data or self.source.read(CHUNK)
                if not rest:
                    return False
                self.unpacker, self.raw = zlib.decompressobj(_GZIP), rest
            elif not self.raw:
                self.raw = self.source.read(CHUNK)
                if not self.raw:
                    raise EOFError("the gzip stream is cut short")
            got = self.unpacker.decompress(self.raw, CHUNK)
            self.raw = self.unpacker.unconsumed_tail
            if got:
                self.held += got
                return True

    def head(self) -> bytes | None:
        """Up to the first empty line; None at the end."""
        while (at := self.held.find(b"\r\n\r\n")) < 0:
            if not self._more():
                if self.held:
                    raise EOFError("a record is cut short")
                return None
        out = bytes(self.held[:at + 4])
        del self.held[:at + 4]
        return out

    def body(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.held and not self._more():
                raise EOFError("a record is cut short")
            out = bytes(self.held[:min(n, CHUNK)])
            del self.held[:len(out)]
            n -= len(out)
            yield out


def parse_head(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name."""
    version, *lines = head.decode().rstrip("\r\n").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {version[:40]!r}")
    return {name.strip().lower(): value.strip() for name, _, value in (x.partition(":") for x in lines)}


def normalise_stream(source, out, level: int = 6) -> Iterator[tuple[int, int, str]]:
    """Copy the records of a gzip stream to members of their own; gives
    (offset, length, record id) of each."""
    stream, offset = _Inflated(source), 0
    while (head := stream.head()) is not None:
        fields = parse_head(head)
        packer = zlib.compressobj(level, zlib.DEFLATED, _GZIP)
        length = _put(out, packer.compress(head))
        for chunk in stream.body(int(fields["content-length"]) + 4):
            length += _put(out, packer.compress(chunk))
        length += _put(out, packer.flush())
        yield offset, length, fields["warc-record-id"]
        offset += length


def _put(out, data: bytes) -> int:
    if data:
        out.write(data)
    return len(data)


def normalise(spark: SparkSession, source: str, files: int, target: str) -> None:
    """Normalise ``part-*.warc.gz`` of one folder into another, a task per
    file; ``part-*.idx`` holds a line of JSON per record."""
    common.ship_package(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = common.file_system(source)
        out_fs, out_root = common.file_system(target)
        for batch in batches:
            for part in batch.column("id").to_pylist():
                out = common.AtomicFile(out_fs, f"{out_root}/part-{part:06d}.warc.gz")
                index = common.AtomicFile(out_fs, f"{out_root}/part-{part:06d}.idx")
                n = 0
                with fs.open_input_stream(f"{root}/part-{part:06d}.warc.gz", compression=None) as f:
                    for entry in normalise_stream(f, out):
                        index.write(json.dumps(entry).encode() + b"\n")
                        n += 1
                out.commit()
                index.commit()  # last: an index stands for a whole archive
                yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "records": pa.array([n], pa.int64())})

    done = spark.range(0, files, 1, max(1, files)).mapInArrow(run, "part long, records long").collect()  # one per file
    if len(done) != files:
        raise RuntimeError("an archive is missing")


def open_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of one member."""
    head, _, rest = zlib.decompress(data, _GZIP).partition(b"\r\n\r\n")
    fields = parse_head(head)
    return fields, rest[:int(fields["content-length"])]


def _page(name: str) -> int | None:
    text = name.strip("<>").removeprefix(_ID)
    return None if text == "null" else int(text)


_RECORDS = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                      ("record_type", pa.string()), ("refers_to", pa.int64())])


def read_records(spark: SparkSession, folder: str, files: int) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every
    record, each read by itself at its place in the index.  The payload of a
    response is checked against its digest and length."""
    common.ship_package(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = common.file_system(folder)
        for batch in batches:
            for part in batch.column("id").to_pylist():
                rows = []
                with fs.open_input_stream(f"{root}/part-{part:06d}.idx", compression=None) as f:
                    index = [json.loads(x) for x in f.read().splitlines()]
                with fs.open_input_file(f"{root}/part-{part:06d}.warc.gz") as f:
                    for offset, length, name in index:
                        f.seek(offset)
                        fields, block = open_record(f.read(length))
                        if fields["warc-record-id"] != name:
                            raise RuntimeError(f"{name}: the index points elsewhere")
                        digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
                        size, kind = int(fields["x-payload-length"]), fields["warc-type"]
                        if kind == "response":
                            payload = block.partition(b"\r\n\r\n")[2]
                            if len(payload) != size or hashlib.sha1(payload).hexdigest() != digest:
                                raise RuntimeError(f"{name}: the payload does not match its digest")
                        refers = fields.get("warc-refers-to")
                        rows.append((_page(name), size, digest, kind, _page(refers) if refers else None))
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows), _RECORDS.types)], schema=_RECORDS)

    return spark.range(0, files, 1, max(1, files)).mapInArrow(
        run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive(pages: DataFrame, least: int = 1000) -> DataFrame:
    """Write, normalise and read back; a row per page."""
    spark = pages.sparkSession
    raw, whole = common.shared_folder(spark, "warc-monolithic"), common.shared_folder(spark, "warc")
    files = write_monolithic(with_record_types(pages, least), raw)
    normalise(spark, raw, files, whole)
    common.drop_folder(raw)
    return read_records(spark, whole, files)

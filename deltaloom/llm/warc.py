"""WARC archives of pages: monolithic gzip files, their normalisation to a member for each record, and an offset index.

``write_monoliths`` lets each task write its pages as WARC records into gzip files that are one stream each. ``normalise``
inflates each such file once from start to end, writes every record as a gzip member of its own, and writes a sidecar
index with the offset and length of each member. ``read_back`` opens single records through the index.

Files lie in the shared folder and are reached by its URI. A task writes under a name of its own attempt and renames the
whole file when done, so an attempt that is lost or repeated leaves no partial file under a final name. A stream cannot
be split, so writers begin a new file after ``ROLL`` bytes. No payload is shuffled: which record of equal payloads is the
response is settled by their digests and ids alone.

Of records with equal payloads, that with the largest page_id is a response and the others are revisits of it. Defined
results: a null html is an empty payload. A null page_id is smaller than any other; records with the largest id are all
responses if an id repeats. A null url leaves the target out. An empty table gives empty archives. Other columns may have
any names; only page_id, url and html are read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_folder, small_batches, written

#: Bytes of records in one monolithic file, about.
ROLL = 32 << 20
#: Digests of repeated payloads that are sent to each executor; more are joined by a shuffle.
SENT_DIGESTS = 200_000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "file string, position long, bytes long, record string, kind string"


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'page {page_id}'.encode()).digest())}>"


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": record_id(page_id),
        "WARC-Date": DATE,
        "WARC-Target-URI": url and "".join(c if c.isprintable() else "".join(f"%{b:02X}" for b in c.encode()) for c in url),
        "WARC-Payload-Digest": f"sha1:{base32(hashlib.sha1(payload).digest())}",
        "WARC-Profile": PROFILE if revisit else None,
        "WARC-Refers-To": record_id(refers_to) if revisit else None,
        "X-Page-ID": page_id,
        "X-Refers-To-Page-ID": refers_to if revisit else None,
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": len(block),
    }
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


class Placed:
    """A file of the shared folder that appears under its name only when it is whole."""

    def __init__(self, folder: str, name: str):
        from pyarrow import fs

        self.fs, path = fs.FileSystem.from_uri(folder)
        self.fs.create_dir(path)
        self.path, self.own = f"{path}/{name}", f"{path}/_{name}.{uuid.uuid4().hex}"
        self.out, self.size = self.fs.open_output_stream(self.own, compression=None), 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.own, self.path)


def monoliths(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        names, out, packer, size = [], None, None, 0

        def end() -> None:
            out.write(packer.flush())
            out.close()

        for b in batches:
            for page_id, url, html, response in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if out is None or size > ROLL:
                    if out:
                        end()
                    names.append(f"pages-{part:06d}-{n:04d}.warc.gz")
                    out, packer, size, n = Placed(folder, names[-1]), zlib.compressobj(1, zlib.DEFLATED, 31), 0, n + 1
                data = record(page_id, url, (html or "").encode("utf-8", "surrogatepass"), response, response is not None and response != page_id)
                size += len(data)
                out.write(packer.compress(data))
        if out:
            end()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["file"])

    return run


def write_monoliths(pages: DataFrame, folder: str) -> DataFrame:
    """The pages as monolithic files; returns their names."""
    spark = pages.sparkSession
    small_batches(spark)
    digest = F.unhex(F.sha1(F.coalesce("html", F.lit("")).cast("binary")))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", digest.alias("digest"))
    repeated = written(rows.groupBy("digest").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).where("n > 1").drop("n"))
    if repeated.count() <= SENT_DIGESTS:
        repeated = F.broadcast(repeated)
    return written(rows.join(repeated, "digest", "left").select("page_id", "url", "html", "response").mapInArrow(monoliths(folder), "file string"))


def records(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The records of a gzip file, whether one stream or many members, inflated once from start to end."""
    data, inflate = b"", zlib.decompressobj(31)
    need = None
    while raw := stream.read(chunk):
        while raw:
            data += inflate.decompress(raw)
            raw = inflate.unused_data
            if inflate.eof:
                inflate = zlib.decompressobj(31)
        at = 0
        while True:
            if need is None:
                head = data.find(b"\r\n\r\n", at)
                if head < 0:
                    break
                length = next(line for line in data[at:head].split(b"\r\n") if line.lower().startswith(b"content-length:"))
                need = head + 4 - at + int(length.split(b":")[1]) + 4
            if len(data) - at < need:
                break
            yield data[at : at + need]
            at, need = at + need, None
        data = data[at:]
    if data:
        raise ValueError("the archive ends within a record")


def members(source: str, target: str, level: int = 4):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(source)
        for b in batches:
            counts = []
            for name in b.column(0).to_pylist():
                out, index, n = Placed(target, name), Placed(f"{target}/index", f"{name}.idx"), 0
                with store.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for data in records(stream):
                        fields = dict(line.split(": ", 1) for line in data[: data.index(b"\r\n\r\n")].decode().split("\r\n")[1:])
                        packer, start = zlib.compressobj(level, zlib.DEFLATED, 31), out.size
                        out.write(packer.compress(data) + packer.flush())
                        index.write(f"{name}\t{start}\t{out.size - start}\t{fields['WARC-Record-ID']}\t{fields['WARC-Type']}\n".encode())
                        n += 1
                out.close()
                index.close()
                counts.append(n)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64())], names=["file", "records"])

    return run


def normalise(files: DataFrame, source: str, target: str) -> DataFrame:
    """Each monolithic file as a file with a member for each record, beside an index; returns file, records."""
    spread = files.repartition(max(1, min(files.count(), 10_000)))
    return written(spread.mapInArrow(members(source, target), "file string, records long"))


def read_members(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        at, file = None, None
        for b in batches:
            rows = []
            for name, position, size in zip(*[c.to_pylist() for c in b.columns[:3]], strict=True):
                if name != at:
                    at, file = name, store.open_input_file(f"{base}/{name}")
                fields, block = parsed(zlib.decompress(file.read_at(size, position), 31))
                http, _, payload = block.partition(b"\r\n\r\n")
                revisit = fields["WARC-Type"] == "revisit"
                if not revisit and f"sha1:{base32(hashlib.sha1(payload).digest())}" != fields["WARC-Payload-Digest"]:
                    raise ValueError(f"the payload of {fields['WARC-Record-ID']} has another digest")
                length = int(http.decode().split("Content-Length: ")[1].split("\r\n")[0]) if revisit else len(payload)
                number = lambda k: int(fields[k]) if k in fields else None  # noqa: E731, B023
                rows.append((number("X-Page-ID"), length, fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"], number("X-Refers-To-Page-ID"), fields.get("WARC-Target-URI"), None if revisit else payload))
            cols = list(zip(*rows, strict=True)) or [()] * 7
            types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
            names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    return run


def index_of(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(INDEX).csv(f"{folder}/index", sep="\t", quote="")


def read_back(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload (null for revisits) of each record."""
    small_batches(spark)
    return index_of(spark, folder).mapInArrow(read_members(folder), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary")


def archived(pages: DataFrame) -> DataFrame:
    """Write, normalise and read back."""
    spark = pages.sparkSession
    source, target = shared_folder(spark), shared_folder(spark)
    files = write_monoliths(pages, source)
    if not normalise(files, source, target).agg(F.sum("records")).first()[0]:
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary")
    return read_back(spark, target)

"""An object store of packs: contents by their digest, each stored once, many of them in one compressed file.

A pack is a zstd stream of the length of its header (four bytes, big-endian), the header, a JSON list of digest, offset and length, and the contents one after the other;
offsets count from the first content. Tasks write packs of bounded size under names of their own below ``_staged``. Only when all tasks have ended does the
driver move the packs of the attempts that won to their place and then write one manifest that names them; readers read what
manifests name. So a task that is killed, run twice or never ends leaves nothing that a reader can see, and an aborted
job takes the files away that were staged until then. Paths may be local or of any store that pyarrow opens, and must be shared by all workers.

Null contents are left out; an empty content is an object, too. Storing a content again adds nothing.
"""

from __future__ import annotations

import json
import posixpath
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Bytes of contents in one pack; a single larger content has a pack of its own.
PACK = 32 << 20
COLUMNS = "digest string, pack string, offset bigint, length bigint, content binary"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def listed(files: fs.FileSystem, folder: str) -> list[str]:
    return sorted(f.path for f in files.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if f.is_file)


@dataclass
class Written(WriterCommitMessage):
    packs: list[str]


class PackWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path, self.job = path, uuid.uuid4().hex

    def staged(self) -> tuple[fs.FileSystem, str, str]:
        files, root = opened(self.path)
        return files, root, posixpath.join(root, "_staged", self.job)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, _, folder = self.staged()
        files.create_dir(folder, recursive=True)
        packs, held, size = [], [], 0

        def flush() -> None:
            nonlocal held, size
            if not held:
                return
            name, header, at = f"{uuid.uuid4().hex}.pack", [], 0
            for digest, content in held:
                header.append([digest, at, len(content)])
                at += len(content)
            front = json.dumps(header).encode()
            with pa.CompressedOutputStream(files.open_output_stream(posixpath.join(folder, name)), "zstd") as out:
                out.write(struct.pack(">I", len(front)) + front)
                for _, content in held:
                    out.write(content)
            packs.append(name)
            held, size = [], 0

        for b in iterator:
            for digest, content in zip(b.column("digest").to_pylist(), b.column("content").to_pylist(), strict=True):
                if held and size + len(content) > PACK:
                    flush()
                held.append((digest, content))
                size += len(content)
        flush()
        return Written(packs)

    def commit(self, messages: list[Written | None]) -> None:
        files, root, folder = self.staged()
        names = [n for m in messages if m for n in m.packs]
        for place in ("packs", "manifests"):
            files.create_dir(posixpath.join(root, place), recursive=True)
        for n in names:
            files.move(posixpath.join(folder, n), posixpath.join(root, "packs", n))
        if names:
            made = posixpath.join(folder, "manifest")
            with files.open_output_stream(made) as out:
                out.write(json.dumps(names).encode())
            files.move(made, posixpath.join(root, "manifests", f"{self.job}.json"))  # from here on, readers see the packs
        self.abort([])

    def abort(self, messages: list[Written | None]) -> None:
        files, _, folder = self.staged()
        if files.get_file_info(folder).type != fs.FileType.NotFound:
            files.delete_dir(folder)


class PackReader(DataSourceReader):
    def __init__(self, path: str, contents: bool):
        self.path, self.contents = path, contents

    def partitions(self) -> list[InputPartition]:
        files, root = opened(self.path)
        names: list[str] = []
        for m in listed(files, posixpath.join(root, "manifests")):
            with files.open_input_stream(m) as f:
                names += json.loads(f.read())
        return [InputPartition(n) for n in names]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition is None:
            return
        files, root = opened(self.path)
        with pa.CompressedInputStream(files.open_input_stream(posixpath.join(root, "packs", partition.value)), "zstd") as f:
            (size,) = struct.unpack(">I", f.read(4))
            for digest, offset, length in json.loads(f.read(size)):
                yield digest, partition.value, offset, length, f.read(length) if self.contents else None


class Packs(DataSource):
    """Format packs: options path, and contents (false: the headers only)."""

    @classmethod
    def name(cls) -> str:
        return "packs"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema) -> DataSourceReader:
        return PackReader(self.options["path"], self.options.get("contents", "true").lower() != "false")

    def writer(self, schema, overwrite: bool) -> PackWriter:
        if overwrite:
            raise ValueError("objects are added to a store, never overwritten")
        return PackWriter(self.options["path"])


def objects(spark: SparkSession, path: str, contents: bool = True) -> DataFrame:
    """digest, pack, offset, length, content of all objects of a store; content is null if only the headers are read."""
    spark.dataSource.register(Packs)
    return spark.read.format("packs").option("contents", str(contents).lower()).load(path)


def stored(rows: DataFrame, path: str) -> None:
    """The contents of rows (content, text or bytes) that the store at path does not hold are added to it. One job at a time may add to a store."""
    spark = rows.sparkSession
    known = objects(spark, path, contents=False).select("digest")
    new = rows.select(F.col("content").cast("binary").alias("content")).where("content IS NOT NULL").withColumn("digest", F.sha2("content", 256))
    new = new.join(known, "digest", "left_anti").dropDuplicates(["digest"])
    new.select("digest", "content").write.format("packs").mode("append").save(path)


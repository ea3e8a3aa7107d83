"""Bronze zone of many small objects: few containers, with an index that finds each object by range.

A task writes the objects it is given one after the other into containers, and keys, offsets and lengths into an index
beside them. Both count only once the job's commit names them: a task or a job that is cut short leaves nothing to see. Of
objects with one key the latest job's counts; within a job the last one of the container that sorts last.

Below the root: ``data/<part>.pack``, ``index/<part>.parquet`` and ``commits/<job>.json``, one line per container.
"""

from __future__ import annotations

import json
import posixpath
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs, parquet
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from dossierlake import constants as C, schemas
from dossierlake.functions import files
from dossierlake.sources.bronze import filesystem_uri

#: A container takes no further object once it holds as many bytes; and what a reading task gives out at a time.
PACK_BYTES, READ_BYTES = 256 << 20, 16 << 20
INDEX = pa.schema([("part", pa.string()), ("key", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
INDEX_DDL, COMMIT_DDL = "part string, key string, offset bigint, length bigint", "part string, job string, version bigint"


@dataclass
class Written(WriterCommitMessage):
    """The containers that one task closed."""

    parts: list[str]


class _Container:
    """One container under way; hidden names until it is closed."""

    def __init__(self, system: fs.FileSystem, base: str) -> None:
        self.system, self.base, self.part = system, base, uuid.uuid4().hex
        self.keys: list[str] = []
        self.lengths: list[int] = []
        self.size = 0
        self.out = system.open_output_stream(f"{base}/data/{self.part}.pack")

    def add(self, key: str, content: bytes) -> None:
        self.out.write(content)
        self.keys.append(key)
        self.lengths.append(len(content))
        self.size += len(content)

    def close(self) -> str:
        self.out.close()
        offsets, at = [], 0
        for length in self.lengths:
            offsets.append(at)
            at += length
        rows = pa.table([pa.array([self.part] * len(self.keys)), pa.array(self.keys), pa.array(offsets, pa.int64()), pa.array(self.lengths, pa.int64())], schema=INDEX)
        draft = f"{self.base}/index/.{self.part}"
        with self.system.open_output_stream(draft) as out:
            parquet.write_table(rows, out)
        self.system.move(draft, f"{self.base}/index/{self.part}.parquet")
        return self.part


class PackWriter(DataSourceArrowWriter):
    """Writes rows of (key, content); see the module."""

    def __init__(self, uri: str, job: str, pack_bytes: int) -> None:
        self.uri, self.job, self.pack_bytes = uri, job, pack_bytes

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, base = fs.FileSystem.from_uri(self.uri)
        parts, container = [], None
        for batch in iterator:
            for key, content in zip(batch.column("key"), batch.column("content"), strict=True):
                container = container or _Container(system, base)
                container.add(key.as_py(), content.as_py() or b"")
                if container.size >= self.pack_bytes:
                    parts.append(container.close())
                    container = None
        if container:
            parts.append(container.close())
        return Written(parts)

    def commit(self, messages: list[Written | None]) -> None:
        system, base = fs.FileSystem.from_uri(self.uri)
        version = time.time_ns() // 1000
        lines = [json.dumps({"part": part, "job": self.job, "version": version}) for message in messages if message for part in message.parts]
        draft = f"{base}/commits/.{self.job}"
        with system.open_output_stream(draft) as out:
            out.write("".join(f"{line}\n" for line in lines).encode())
        system.move(draft, f"{base}/commits/{self.job}.json")

    def abort(self, messages: list[Written | None]) -> None:
        system, base = fs.FileSystem.from_uri(self.uri)
        for part in (part for message in messages if message for part in message.parts):
            for name in (f"{base}/index/{part}.parquet", f"{base}/data/{part}.pack"):
                if system.get_file_info(name).type != fs.FileType.NotFound:
                    system.delete_file(name)


class PackSource(DataSource):
    """``df.write.format("object_packs").mode("append").save()`` with options ``uri``, ``job`` and ``pack_bytes``."""

    @classmethod
    def name(cls) -> str:
        return "object_packs"

    def schema(self) -> str:
        return "key string, content binary"

    def writer(self, schema: object, overwrite: bool) -> PackWriter:
        if overwrite:
            raise ValueError("containers are only appended; a later object of the same key replaces an earlier one")
        return PackWriter(self.options["uri"], self.options["job"], int(self.options["pack_bytes"]))


def _prepared(spark: SparkSession, root: str) -> str:
    uri = filesystem_uri(spark, root)
    system, base = fs.FileSystem.from_uri(uri)
    for name in ("data", "index", "commits"):
        system.create_dir(posixpath.join(base, name), recursive=True)
    return uri


def land_packed(objects: DataFrame, root: str, pack_bytes: int = PACK_BYTES) -> DataFrame:
    """Store rows of (key, content) in containers below ``root``, at once; returns key and length of what was stored.

    Every partition of ``objects`` fills its own containers, so their number follows the partitions; no row is shuffled. A
    null content is an empty object; a row without a key fails the job, before anything of it can be seen.
    """
    spark = objects.sparkSession
    uri, job = _prepared(spark, root), uuid.uuid4().hex
    spark.dataSource.register(PackSource)
    keyed = objects.select(F.coalesce("key", F.raise_error(F.lit("object without a key")).cast("string")).alias("key"), "content")
    keyed.write.format(PackSource.name()).mode("append").options(uri=uri, job=job, pack_bytes=str(pack_bytes)).save()
    return _entries(spark, root).where(F.col("job") == job).select("key", "length")


def _entries(spark: SparkSession, root: str) -> DataFrame:
    """Index rows of committed containers, with their job and its version."""
    _prepared(spark, root)
    index = spark.read.schema(INDEX_DDL).parquet(f"{root}/index")
    return index.join(spark.read.schema(COMMIT_DDL).json(f"{root}/commits"), "part")


def listing(spark: SparkSession, root: str, suffixes: list[str] | None = None) -> DataFrame:
    """key, modificationTime, length, part and offset of the newest object of each key, without reading any bytes of objects."""
    wanted = _entries(spark, root).where(files.has_suffix(F.col("key"), suffixes or C.UPLOAD_SUFFIXES))
    newest = wanted.groupBy("key").agg(F.max(F.struct("version", "part", "offset", "length")).alias("last"))
    return newest.select("key", F.timestamp_micros("last.version").alias("modificationTime"), "last.length", "last.part", "last.offset")


def with_content(spark: SparkSession, root: str, found: DataFrame) -> DataFrame:
    """The objects of a :func:`listing`, or of the part of one that is wanted: key, modificationTime, length and content.

    Only their ranges are read. Rows are dealt by place, so that a task opens few containers and reads them forwards.
    """
    uri = filesystem_uri(spark, root)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(uri)
        part, source = None, None
        for batch in batches:
            begin, contents, held = 0, [], 0
            for i, row in enumerate(batch.select(["part", "offset", "length"]).to_pylist()):
                if row["part"] != part:
                    if source:
                        source.close()
                    part = row["part"]
                    source = system.open_input_file(f"{base}/data/{part}.pack")
                contents.append(source.read_at(row["length"], row["offset"]))
                held += row["length"]
                if held >= READ_BYTES or i + 1 == batch.num_rows:
                    cut = batch.slice(begin, i + 1 - begin).select(["key", "modificationTime", "length"])
                    yield pa.RecordBatch.from_arrays([*cut.columns, pa.array(contents, pa.binary())], [*cut.schema.names, "content"])
                    begin, contents, held = i + 1, [], 0

    placed = found.select("key", "modificationTime", "length", "part", "offset")
    return placed.repartitionByRange("part", "offset").sortWithinPartitions("part", "offset").mapInArrow(fetch, schemas.PACKED)


def scan_packed(spark: SparkSession, root: str, suffixes: list[str] | None = None) -> DataFrame:
    """Objects with an accepted suffix, as :func:`dossierlake.sources.bronze.scan_bronze` gives them."""
    return with_content(spark, root, listing(spark, root, suffixes))

"""Archives of tables as a Spark data source, and a remote place to push them to.

``spark.write.format("semlake_archive").option("path", ..)`` writes each partition as one Arrow file, a *member*, and at the
end, on the driver, ``INDEX.json`` with every member's length and SHA-256; without an index there is no archive,
so a writer that is lost leaves nothing that can be read. Reading checks names (relative, without ``..``), lengths
before anything is read, and the SHA-256 of a member before its first row is given out.

``Remote`` is a folder of archives and a log of pointers. A push names the pointer it started from and is refused
(``Conflict``) when another one has been made since. A pull verifies all members and gates before anything is written
to the store, and all tables change in one commit."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from posixpath import normpath
from urllib.parse import urlparse

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from semlake.operators.common import ship
from semlake.sources.store import Conflict, Files

INDEX = "INDEX.json"


class Broken(ValueError):
    """An archive that must not be used."""


def place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a shared folder as workers reach it, and the folder in it."""
    url = urlparse(path)
    return (fs.LocalFileSystem(), url.path) if url.scheme in ("", "file") else fs.FileSystem.from_uri(path)


def safe(name: str) -> str:
    """A member's name, if it stays in the archive."""
    if not name or name.startswith("/") or "\\" in name or "\0" in name or normpath(name) != name or name.split("/")[0] == "..":
        raise Broken(f"unsafe member name {name!r}")
    return name


def read_index(path: str) -> dict:
    """The index, once the names and lengths of all members have been checked."""
    files, at = place(path)
    if files.get_file_info(f"{at}/{INDEX}").type != fs.FileType.File:
        raise Broken(f"{path}: no index, the archive was never finished")
    with files.open_input_file(f"{at}/{INDEX}") as f:
        index = json.loads(f.read())
    infos = files.get_file_info([f"{at}/{safe(m['name'])}" for m in index["members"]])
    for m, info in zip(index["members"], infos, strict=True):
        if info.type != fs.FileType.File or info.size != m["bytes"]:
            raise Broken(f"{path}/{m['name']}: {info.size} bytes, the index says {m['bytes']}")
    return index


def member_bytes(path: str, member: dict) -> pa.Buffer:
    files, at = place(path)
    with files.open_input_file(f"{at}/{safe(member['name'])}") as f:
        data = f.read_buffer()
    if hashlib.sha256(data).hexdigest() != member["sha256"]:
        raise Broken(f"{path}/{member['name']}: wrong checksum")
    return data


@dataclass
class Member(WriterCommitMessage):
    name: str
    sha256: str
    bytes: int
    rows: int


@dataclass
class Part(InputPartition):
    member: dict


class ArchiveWriter(DataSourceArrowWriter):
    def __init__(self, path: str, schema: StructType, overwrite: bool):
        self.path, self.schema = path, schema
        files, at = place(path)
        if files.get_file_info(f"{at}/{INDEX}").type == fs.FileType.File:
            if not overwrite:
                raise Broken(f"{path} is an archive already")
            files.delete_file(f"{at}/{INDEX}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Member:
        files, at = place(self.path)
        files.create_dir(at, recursive=True)
        kind = to_arrow_schema(self.schema)
        name, rows, digest, size = f"part-{uuid.uuid4().hex}.arrow", 0, hashlib.sha256(), 0
        with files.open_output_stream(f"{at}/{name}") as out:

            class Counted:
                """What is written passes through the digest."""

                closed = False

                def write(self, data):
                    nonlocal size
                    digest.update(data)
                    size += len(data)
                    return out.write(data)

                def flush(self):
                    pass

                def close(self):
                    self.closed = True

            with pa.PythonFile(Counted(), "w") as f, pa.ipc.new_stream(f, kind) as stream:
                for batch in iterator:
                    stream.write_batch(batch if batch.schema == kind else batch.cast(kind))
                    rows += batch.num_rows
        return Member(name, digest.hexdigest(), size, rows)

    def commit(self, messages: list) -> None:
        files, at = place(self.path)
        files.create_dir(at, recursive=True)
        index = {"schema": self.schema.json(), "members": [vars(m) for m in messages if m is not None]}
        aside = f"{at}/.{uuid.uuid4().hex}"
        with files.open_output_stream(aside) as f:
            f.write(json.dumps(index, sort_keys=True).encode())
        files.move(aside, f"{at}/{INDEX}")

    def abort(self, messages: list) -> None:
        files, at = place(self.path)
        for m in messages:
            if m is not None:
                files.delete_file(f"{at}/{m.name}")


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.index = path, read_index(path)

    def partitions(self) -> list[Part]:
        return [Part(m) for m in self.index["members"]] or [Part({})]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if partition.member:
            yield from pa.ipc.open_stream(member_bytes(self.path, partition.member))


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "semlake_archive"

    def schema(self) -> StructType:
        return StructType.fromJson(json.loads(read_index(self.options["path"])["schema"]))

    def reader(self, schema: StructType) -> ArchiveReader:
        return ArchiveReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"], schema, overwrite)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(ArchiveSource)


def write_archive(df: DataFrame, path: str) -> None:
    register(df.sparkSession)
    df.write.format("semlake_archive").option("path", path).mode("append").save()


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.read.format("semlake_archive").option("path", path).load()


def verify(spark: SparkSession, path: str) -> int:
    """Read every member and compare its checksum, member by member on the cluster; returns the rows."""
    members = read_index(path)["members"]
    if not members:
        return 0
    ship(spark)
    rows = spark.createDataFrame([(json.dumps(m),) for m in members], "m string").repartition(len(members))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [sum(b.num_rows for b in pa.ipc.open_stream(member_bytes(path, json.loads(m)))) for m in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.int64())], names=["n"])

    return sum(r[0] for r in rows.mapInArrow(each, "n bigint").collect())


class Remote:
    """Archives below a root: ``sets/<id>/<table>`` and a log of pointers ``_log/N.json``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.files = spark, Files(spark, root)

    def head(self) -> tuple[int, dict | None]:
        found = sorted(int(n[:-5]) for n in self.files.names("_log") if n[:-5].isdigit())
        return (found[-1], json.loads(self.files.read_text("_log", f"{found[-1]:08d}.json"))) if found else (0, None)

    def push(self, tables: dict[str, DataFrame], base: int, **facts) -> int:
        """Write the tables as archives and point to them. base: the pointer that these tables go back to."""
        if self.head()[0] != base:
            raise Conflict(f"{self.files.root} is at {self.head()[0]}, not at {base}: pull first")
        folder, entries = f"sets/{uuid.uuid4().hex}", {}
        for name, df in tables.items():
            write_archive(df, f"{self.files.root}/{folder}/{name}")
            index = read_index(f"{self.files.root}/{folder}/{name}")
            entries[name] = {"rows": sum(m["rows"] for m in index["members"]), "bytes": sum(m["bytes"] for m in index["members"])}
        text = json.dumps({"folder": folder, "tables": entries, "packed_at": time.time(), **facts}, sort_keys=True)
        if not self.files.write_new(text, "_log", f"{base + 1:08d}.json"):
            self.files.remove(folder)
            raise Conflict(f"{self.files.root}: another push was faster")
        return base + 1

    def pull(self) -> tuple[int, dict, dict[str, DataFrame]]:
        """(pointer, manifest, tables), all members verified."""
        number, manifest = self.head()
        if manifest is None:
            raise FileNotFoundError(f"{self.files.root} holds no archive")
        out = {}
        for name, entry in manifest["tables"].items():
            path = f"{self.files.root}/{safe(manifest['folder'])}/{safe(name)}"
            if verify(self.spark, path) != entry["rows"]:
                raise Broken(f"{path}: the manifest says {entry['rows']} rows")
            out[name] = read_archive(self.spark, path)
        return number, manifest, out

"""Tables as verified versions: a data source writer with commit and abort, and a manifest that one rename publishes.

``df.write.format("versioned")`` writes a version's parts beside those of others. Each
task reads its part back (rows from the file's footer, digest of its bytes) and reports
both in its commit message; the commit compares the parts on the file system with the messages and the expected number of
rows, writes the version's manifest and publishes it by renaming a copy to
``current.json``. A failure removes the version's folder, so readers see the old
version or the new one. Older versions are the backups; pointing back to one restores it.

``mode("append")`` keeps the parts of the current version and adds to them, without reading or
writing these. A writer whose base isn't the current version any more fails, so of
two writers that overlap one fails (where renames are atomic). Versions are read by Spark's own Parquet reader.

Options: ``expectedRows`` (of this write), ``name`` (of the version), ``publish`` (``false``: the version
waits until :meth:`Versions.point_to` or :meth:`Versions.discard`).
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime
from uuid import uuid4

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from . import shared

CURRENT, MANIFEST = "current.json", "manifest.json"


@dataclass
class Part(WriterCommitMessage):
    """What a task wrote: path below the table's folder, rows, bytes and their digest."""

    path: str
    rows: int
    size: int
    sha256: str


def _read(system: fs.FileSystem, path: str) -> dict | None:
    if system.get_file_info(path).type != fs.FileType.File:
        return None
    with system.open_input_stream(path) as file:
        return json.loads(file.read())


def _write(system: fs.FileSystem, path: str, manifest: dict) -> None:
    with system.open_output_stream(path) as out:
        out.write(json.dumps(manifest, indent=1).encode())


def publish(uri: str, manifest: dict) -> None:
    """Make a manifest the current one by one rename."""
    system, path = shared.located(uri)
    staged = f"{path}/next-{uuid4().hex}.json"
    _write(system, staged, manifest)
    system.move(staged, f"{path}/{CURRENT}")


class VersionedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "versioned"

    def __init__(self, options):
        super().__init__(options)
        self.path, self.version, self.expected = options["path"], options.get("name", ""), options.get("expectedRows")
        self.publish = options.get("publish", "true") == "true"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return VersionWriter(self, schema, overwrite)


class VersionWriter(DataSourceArrowWriter):
    def __init__(self, source: VersionedSource, schema, overwrite: bool):
        system, path = shared.located(source.path)
        self.uri, self.expected, self.overwrite, self.publish = source.path, source.expected, overwrite, source.publish
        self.version = source.version or f"v_{datetime.now():%Y%m%d_%H%M%S_%f}"
        self.base = _read(system, f"{path}/{CURRENT}")
        self.schema = schema

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        system, top = shared.located(self.uri)
        context = TaskContext.get()
        name = f"{self.version}/part-{context.partitionId():05d}-{context.taskAttemptId()}.parquet"
        system.create_dir(f"{top}/{self.version}", recursive=True)
        rows, writer = 0, None
        with system.open_output_stream(f"{top}/{name}") as out:
            for batch in iterator:
                writer = writer or pq.ParquetWriter(out, batch.schema)
                writer.write_batch(batch)
                rows += batch.num_rows
            if writer is None:  # a task without rows
                writer = pq.ParquetWriter(out, to_arrow_schema(self.schema))
            writer.close()
        digest, size = hashlib.sha256(), 0
        with system.open_input_stream(f"{top}/{name}") as back:
            while data := back.read(1 << 20):
                digest.update(data)
                size += len(data)
        with system.open_input_file(f"{top}/{name}") as back:
            found = pq.ParquetFile(back).metadata.num_rows
        if found != rows:
            raise RuntimeError(f"Part verification failed: {rows} rows were written to {name}, {found} are there.")
        return Part(name, rows, size, digest.hexdigest())

    def commit(self, messages: list[Part | None]) -> None:
        system, top = shared.located(self.uri)
        parts = [m for m in messages if m is not None]
        written = sum(p.rows for p in parts)
        sizes = [system.get_file_info(f"{top}/{p.path}").size for p in parts]
        if len(parts) != len(messages) or sizes != [p.size for p in parts] or (self.expected and written != int(self.expected)):
            raise RuntimeError(f"Temporary version verification failed: {written} rows in {len(parts)} of {len(messages)} parts, {self.expected or written} rows expected.")
        if (_read(system, f"{top}/{CURRENT}") or {}).get("version") != (self.base or {}).get("version"):
            raise RuntimeError(f"Another version was published meanwhile: {self.uri}")
        kept = [] if self.overwrite or self.base is None else self.base["parts"]
        every = kept + [vars(p) for p in sorted(parts, key=lambda p: p.path)]
        manifest = {"version": self.version, "previous": (self.base or {}).get("version"), "rows": sum(p["rows"] for p in every), "schema": json.loads(self.schema.json()), "parts": every}
        _write(system, f"{top}/{self.version}/{MANIFEST}", manifest)
        if self.publish:
            publish(self.uri, manifest)

    def abort(self, messages: list[Part | None]) -> None:
        system, top = shared.located(self.uri)
        if system.get_file_info(f"{top}/{self.version}").type == fs.FileType.Directory:
            system.delete_dir(f"{top}/{self.version}")


class Versions:
    """A table's versions under a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        spark.dataSource.register(VersionedSource)

    def manifest(self, name: str | None = None) -> dict | None:
        """That of a version, or the current one."""
        system, path = shared.located(self.folder)
        return _read(system, f"{path}/{f'{name}/{MANIFEST}' if name else CURRENT}")

    def names(self) -> list[str]:
        """Complete versions by name, which by default is their time."""
        system, path = shared.located(self.folder)
        if system.get_file_info(path).type == fs.FileType.NotFound:
            return []
        found = system.get_file_info(fs.FileSelector(path))
        return sorted(f.base_name for f in found if f.type == fs.FileType.Directory and self.manifest(f.base_name))

    def current(self) -> str | None:
        return (self.manifest() or {}).get("version")

    def read(self, name: str | None = None) -> DataFrame:
        manifest = self.manifest(name)
        if manifest is None:
            raise FileNotFoundError(f"Historical database does not exist: {self.folder}")
        return self.spark.read.schema(StructType.fromJson(manifest["schema"])).parquet(*(f"{self.folder}/{p['path']}" for p in manifest["parts"]))

    def point_to(self, name: str) -> None:
        """Restore a version."""
        manifest = self.manifest(name)
        if manifest is None:
            raise FileNotFoundError(f"No such version: {self.folder}/{name}")
        publish(self.folder, manifest)

    def discard(self, name: str) -> None:
        """Remove a version that isn't the current one and of which no other keeps parts."""
        others = [m for n in self.names() if n != name and (m := self.manifest(n))]
        if name == self.current() or any(p["path"].startswith(f"{name}/") for m in others for p in m["parts"]):
            raise ValueError(f"The version is in use: {self.folder}/{name}")
        system, path = shared.located(self.folder)
        system.delete_dir(f"{path}/{name}")

    def _save(self, df: DataFrame, mode: str, rows: int | None, name: str | None, publish: bool = True) -> str:
        name = name or f"v_{datetime.now():%Y%m%d_%H%M%S_%f}"
        if self.manifest(name):
            raise FileExistsError(f"There is a version {name} already: {self.folder}")
        writer = df.write.format("versioned").mode(mode).option("name", name).option("publish", str(publish).lower())
        try:
            (writer if rows is None else writer.option("expectedRows", str(rows))).save(self.folder)
        except PySparkException as failed:
            for said in ("verification failed", "Another version"):
                if said in str(failed):
                    raise RuntimeError([line for line in str(failed).splitlines() if said in line][-1].removeprefix("RuntimeError: ")) from failed
            raise
        return name

    def write(self, df: DataFrame, rows: int | None = None, name: str | None = None, publish: bool = True) -> str:
        """A new version of ``df``, current once it is verified. Returns its name."""
        return self._save(df, "overwrite", rows, name, publish)

    def append(self, df: DataFrame, rows: int | None = None, name: str | None = None, publish: bool = True) -> str:
        """A new version of the current rows and those of ``df``."""
        return self._save(df, "append", rows, name, publish)

    def history(self) -> DataFrame:
        """One row ``(version, previous, rows, parts)`` for each version."""
        rows = [(m["version"], m["previous"], m["rows"], len(m["parts"])) for m in map(self.manifest, self.names())]
        return self.spark.createDataFrame(rows, "version string, previous string, rows bigint, parts bigint")

    def damaged(self, name: str | None = None) -> DataFrame:
        """``(path, sha256, found)`` of the parts whose bytes aren't those of the manifest, read by tasks."""
        manifest, folder = self.manifest(name), self.folder
        parts = self.spark.createDataFrame([(p["path"], p["sha256"]) for p in manifest["parts"]], "path string, sha256 string")
        files = self.spark.read.format("binaryFile").load([f"{folder}/{p['path']}" for p in manifest["parts"]]).select(F.col("path").alias("at"), F.sha2("content", 256).alias("found"))
        # A part's name has the task attempt in it and the version's name before it.
        own = lambda c: F.substring_index(c, "/", -2)
        both = parts.withColumn("own", own("path")).join(files.withColumn("own", own("at")), "own", "left")
        return both.where("found is null or found <> sha256").select("path", "sha256", "found")

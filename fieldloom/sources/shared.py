"""Files that all machines see: scratch folders, results that outlive them, files by their URI."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from uuid import uuid4

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; only a local session without one gets it beside its warehouse."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
            shared = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"
        context.setCheckpointDir(shared)
    return context.getCheckpointDir().rstrip("/")


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A new folder in the shared one, removed in the end. Results that read it must be kept before."""
    path = f"{folder(spark)}/files-{uuid4().hex}"
    try:
        yield path
    finally:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def keep(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder, so that its inputs may go."""
    folder(df.sparkSession)
    return df.checkpoint()


def located(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI (local, HDFS, S3, GCS) or an absolute path."""
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


def files_under(uri: str, endings: tuple[str, ...]) -> list[str]:
    """Sorted paths of the files with such endings under a folder, or the one file; hidden ones aren't seen."""
    system, path = located(uri)
    info = system.get_file_info(path)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(f"Path not found: {uri}")
    if info.type == fs.FileType.File:
        return [path]
    found = system.get_file_info(fs.FileSelector(path, recursive=True))
    return sorted(f.path for f in found if f.type == fs.FileType.File and f.base_name.lower().endswith(endings) and not f.base_name.startswith((".", "_", "~")))


def write_files(rows: DataFrame, uri: str) -> int:
    """Files ``(name, content)`` written by tasks under a folder; a task that runs again writes the same files again. Returns their number."""

    def write(batches):
        system, path = located(uri)
        system.create_dir(path, recursive=True)
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content"), strict=True):
                with system.open_output_stream(f"{path}/{name}") as out:
                    out.write(content.as_py())
            yield pa.RecordBatch.from_arrays([batch.column("name")], names=["name"])

    return rows.select("name", "content").mapInArrow(write, "name string").count()

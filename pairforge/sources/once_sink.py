"""A sink that has every batch exactly once: format ``once``, for batch writes and streams.

Each task writes its rows to a file of its own, under a name no other attempt uses, and reports
it as its commit message. When all tasks are done the driver writes the batch's manifest, the list of
its files, in one move. Readers go by the manifests alone, so files of failed tasks and
of batches that were stopped are never seen; and a batch whose id has a
manifest already is not written again, so a repeated batch adds nothing. The id is the
option ``batch`` of a batch write and the number of the micro-batch of a stream.

Files are Parquet. The folder (option ``path``) is any that pyarrow's file systems reach,
as the tasks write there themselves: a path or a ``file://``, ``hdfs://`` or object store address.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType


def _at(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if ":" in path else f"file://{path}")


@dataclass
class Written(WriterCommitMessage):
    name: str
    rows: int


class _Folder:
    """What both writers do."""

    def __init__(self, path: str):
        self.path = path

    def write_rows(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = _at(self.path)
        system.create_dir(f"{root}/data", recursive=True)
        name, rows, writer = f"{uuid.uuid4().hex}.parquet", 0, None
        try:
            for batch in iterator:
                if writer is None:
                    writer = pq.ParquetWriter(f"{root}/data/{name}", batch.schema, filesystem=system)
                writer.write_batch(batch)
                rows += batch.num_rows
        finally:
            if writer is not None:
                writer.close()
        return Written(name if writer is not None else "", rows)

    def commit_as(self, batch: str, messages: list[Written | None]) -> bool:
        """Whether this call made the batch; else its files go."""
        system, root = _at(self.path)
        known = {m.rsplit("/", 1)[-1] for m in _manifests(system, root)}
        if f"{batch}.json" in known:
            self.drop(messages)
            return False
        listed = [{"file": m.name, "rows": m.rows} for m in messages if m is not None and m.name]
        system.create_dir(f"{root}/manifest", recursive=True)
        made = f"{root}/manifest/.{batch}-{uuid.uuid4().hex}"
        with system.open_output_stream(made) as out:
            out.write(json.dumps({"batch": batch, "files": listed}).encode())
        system.move(made, f"{root}/manifest/{batch}.json")
        return True

    def drop(self, messages: list[Written | None]) -> None:
        system, root = _at(self.path)
        for m in messages:
            if m is not None and m.name:
                system.delete_file(f"{root}/data/{m.name}")


def _manifests(system: fs.FileSystem, root: str) -> list[str]:
    found = system.get_file_info(fs.FileSelector(f"{root}/manifest", allow_not_found=True))
    return sorted(f.path for f in found if f.is_file and not f.base_name.startswith("."))


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, batch: str):
        self.folder, self.batch = _Folder(path), batch

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        return self.folder.write_rows(iterator)

    def commit(self, messages: list[Written | None]) -> None:
        self.folder.commit_as(self.batch, messages)

    def abort(self, messages: list[Written | None]) -> None:
        self.folder.drop(messages)


class _StreamWriter(DataSourceStreamArrowWriter):
    def __init__(self, path: str, prefix: str):
        self.folder, self.prefix = _Folder(path), prefix

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        return self.folder.write_rows(iterator)

    def commit(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        self.folder.commit_as(f"{self.prefix}{batchId}", messages)

    def abort(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        self.folder.drop(messages)


class OnceSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "once"

    def _path(self) -> str:
        if not self.options.get("path"):
            raise ValueError("the option path is missing")
        return self.options["path"]

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        batch = self.options.get("batch")
        if overwrite or not batch or "/" in batch or batch.startswith("."):
            raise ValueError("batches are appended, each with a batch id as the option batch")
        return _Writer(self._path(), batch)

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamArrowWriter:  # noqa: N802
        return _StreamWriter(self._path(), self.options.get("prefix", "stream-"))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(OnceSink)


def append(df: DataFrame, path: str, batch: str) -> None:
    """Write a batch; nothing happens if it is there."""
    register(df.sparkSession)
    df.write.format("once").mode("append").option("path", path).option("batch", batch).save()


def batches(path: str) -> dict[str, int]:
    """Rows of each batch that is there."""
    system, root = _at(path)
    found = {}
    for m in _manifests(system, root):
        with system.open_input_stream(m) as raw:
            listed = json.loads(raw.read())
        found[listed["batch"]] = sum(f["rows"] for f in listed["files"])
    return found


def read(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The rows of all batches that are there."""
    system, root = _at(path)
    files = []
    for m in _manifests(system, root):
        with system.open_input_stream(m) as raw:
            files += [f"{path.rstrip('/')}/data/{f['file']}" for f in json.loads(raw.read())["files"]]
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)

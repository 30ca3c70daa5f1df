"""[B8, B12] Rows published at once, and only while the writer's lease lasts: a Python data source.

    spark.dataSource.register(PublishSource)
    df.write.format("quill_publish").mode("overwrite").option("path", ...).option("owner", ...).option("lease", ...).save()

Each task stages a Parquet file of its own under `.staged/`, which no reader looks at; a task that dies or is tried again leaves a file that
nobody names. When all tasks are done the driver reads the lease (JSON: owner, until in seconds), and if it is the writer's still, one
move puts the manifest (the list of this write's files) in the place of the last one. So readers see all of a write or nothing, at any moment; a
writer whose lease has gone raises LeaseLost, and its files are removed. Reading gives one partition for each file of the manifest.
Paths are URIs of any file system that Arrow knows; local ones must be shared by all executors.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

MANIFEST, STAGED = "manifest.json", ".staged"


class LeaseLost(RuntimeError):
    """The lease isn't the writer's, or has run out."""


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def put_json(uri: str, value: object) -> None:
    """[B8] Writes JSON into a file beside the target and moves it there, so that readers find the old text or the new one."""
    files, path = _place(uri)
    beside = f"{path}.{uuid.uuid4().hex}.tmp"
    with files.open_output_stream(beside) as out:
        out.write(json.dumps(value).encode())
    files.move(beside, path)


def get_json(uri: str) -> object | None:
    """A JSON file; None where there is none."""
    files, path = _place(uri)
    if files.get_file_info(path).type != fs.FileType.File:
        return None
    with files.open_input_stream(path) as source:
        return json.loads(source.read())


def holds(lease: object, owner: str, now: float) -> bool:
    return isinstance(lease, dict) and lease.get("owner") == owner and isinstance(lease.get("until"), (int, float)) and lease["until"] > now


@dataclass
class Staged(WriterCommitMessage):
    name: str | None
    rows: int


class PublishWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, schema: StructType):
        self.root, self.owner, self.lease = options["path"].rstrip("/"), options["owner"], options["lease"]
        self.schema, self.run = schema, uuid.uuid4().hex
        self._check()

    def _check(self) -> None:
        if not holds(get_json(self.lease), self.owner, time.time()):
            raise LeaseLost(f"{self.owner} doesn't hold {self.lease}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        files, root = _place(self.root)
        name, rows, writer = f"{self.run}-{uuid.uuid4().hex}.parquet", 0, None
        files.create_dir(f"{root}/{STAGED}", recursive=True)
        try:
            for batch in iterator:
                if writer is None:
                    writer = pq.ParquetWriter(f"{root}/{STAGED}/{name}", batch.schema, filesystem=files)
                writer.write_batch(batch)
                rows += batch.num_rows
        finally:
            if writer is not None:
                writer.close()
        return Staged(name if rows else None, rows)

    def commit(self, messages: list[Staged | None]) -> None:
        own = [m for m in messages if m is not None and m.name]
        try:
            self._check()
        except LeaseLost:
            self.abort(messages)
            raise
        manifest = {"version": 1, "owner": self.owner, "files": [{"name": m.name, "rows": m.rows} for m in own], "schema": self.schema.json()}
        put_json(f"{self.root}/{MANIFEST}", manifest)

    def abort(self, messages: list[Staged | None]) -> None:
        """Removes whatever this run has staged, also by tasks that sent no message."""
        files, root = _place(self.root)
        for info in files.get_file_info(fs.FileSelector(f"{root}/{STAGED}", allow_not_found=True)):
            if info.base_name.startswith(self.run):
                files.delete_file(info.path)


class PublishReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.root, self.schema = options["path"].rstrip("/"), schema

    def partitions(self) -> list[InputPartition]:
        manifest = get_json(f"{self.root}/{MANIFEST}") or {"files": []}
        return [InputPartition(x["name"]) for x in manifest["files"]] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(self.schema)
        if partition.value is None:
            yield pa.RecordBatch.from_pylist([], schema=schema)
            return
        files, root = _place(self.root)
        with pq.ParquetFile(files.open_input_file(f"{root}/{STAGED}/{partition.value}")) as file:
            for batch in file.iter_batches():
                yield batch.select(schema.names).cast(schema)


class PublishSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quill_publish"

    def schema(self) -> StructType:
        manifest = get_json(f"{self.options['path'].rstrip('/')}/{MANIFEST}")
        if manifest is None:
            raise ValueError(f"nothing is published at {self.options['path']}")
        return StructType.fromJson(json.loads(manifest["schema"]))

    def reader(self, schema: StructType) -> DataSourceReader:
        return PublishReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        if not overwrite:
            raise ValueError("a publication is replaced as a whole: use mode overwrite")
        return PublishWriter(self.options, schema)

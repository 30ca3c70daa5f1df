"""Folders that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from quillspark.sources.publish import _place


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir; a temporary one only in local mode where that is unset."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        folder = "file://" + tempfile.mkdtemp(prefix="quill-")
    uri = f"{folder.rstrip('/')}/quill/{name}-{uuid.uuid4().hex}"
    files, path = _place(uri)
    files.create_dir(path, recursive=True)
    return uri


def put_text(uri: str, text: str) -> None:
    files, path = _place(uri)
    files.create_dir(path.rpartition("/")[0], recursive=True)
    with files.open_output_stream(path) as out:
        out.write(text.encode())


def written(df: DataFrame, label: str) -> DataFrame:
    """df written to a new shared folder and read back: cuts the lineage, and survives lost executors."""
    path = f"{fresh_folder(df.sparkSession, label)}/rows"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

"""[J5] Work that goes on where a killed run stopped: an idempotent keyed upsert for streams, bound to the inputs' fingerprint.

Each micro-batch is written to a folder of its own number under the fingerprint, so a batch that is run again after a crash replaces what it wrote before,
and a run over other inputs (another fingerprint) starts from nothing. A key's row is that of the latest batch; ties in a batch go to the greatest row.
State is only ever read by joins on the key, and never held by the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def accepted(spark: SparkSession, folder: str, fingerprint: str, schema: str, keys: list[str]) -> DataFrame:
    """The latest row of each key that runs of this fingerprint have written; no rows before the first."""
    path = f"{folder.rstrip('/')}/fingerprint={fingerprint}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(f"{schema}, batch long").option("basePath", path).parquet(path)
    names = [f.name for f in spark.createDataFrame([], schema).schema.fields]
    rest = [n for n in names if n not in keys]
    latest = rows.groupBy(*keys).agg(F.max(F.struct("batch", *rest)).alias("row"))  # a map-side maximum
    return latest.select(*[F.col(n) if n in keys else F.col(f"row.{n}").alias(n) for n in names])


def upsert(stream: DataFrame, folder: str, fingerprint: str, work: Callable[[DataFrame], DataFrame], keys: list[str]):
    """Starts `work` (a model call, in place of which any function of a batch stands) over the stream's new rows, and upserts what it gives; the query's
    checkpoint lies beside the state, so the next call goes on behind the last batch that was committed. Keys that are there already are worked on
    again only if they come again."""
    place = f"{folder.rstrip('/')}/fingerprint={fingerprint}"

    def write(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{place}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder.rstrip('/')}/checkpoints/{fingerprint}").trigger(availableNow=True).start()

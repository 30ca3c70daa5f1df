"""Work tables in the cluster's shared folder, and size-checked Bloom filters."""

from __future__ import annotations

import atexit
import os
import sys
import tempfile
import uuid
import zipfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import textkit as tk

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where that is unset (local runs)."""
    sc = spark.sparkContext
    place = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        place = getattr(sc, "_quill_folder", None)
        if not place:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
            place = sc._quill_folder = "file://" + tempfile.mkdtemp(prefix="quill-")
    return place.rstrip("/")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for new columns of df: a name that df has already (in any case) gets underscores behind it until it is free."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: Rows and bytes of one Arrow batch; texts are long, and each task holds a batch in the JVM and in Python.
BATCH_ROWS, BATCH_BYTES = 2_000, 8 << 20


def ship_package(spark: SparkSession) -> None:
    """Bound the Arrow batches, and make this package importable by Python workers that were not started from the repository."""
    sc = spark.sparkContext
    for name, value in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        spark.conf.set(f"spark.sql.execution.arrow.{name}", str(value))
    if getattr(sc, "_quill_shipped", False):
        return
    sc._quill_shipped = True
    if ROOT in os.environ.get("PYTHONPATH", "").split(os.pathsep) or os.path.realpath(os.getcwd()) == os.path.realpath(ROOT):
        return
    if ROOT not in sys.path:
        sys.path.insert(0, ROOT)
    bundle = os.path.join(tempfile.mkdtemp(prefix="quill-"), "quillspark.zip")
    with zipfile.ZipFile(bundle, "w") as z:
        for folder, _, names in os.walk(os.path.join(ROOT, "quillspark")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, ROOT))
    sc.addPyFile(bundle)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/quill/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _remove_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    def remove() -> None:
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session may have ended already; the folder is then the cluster's to clean
            pass

    atexit.register(remove)


SEGMENTS = 64
#: Most keys a broadcast Bloom filter is built for: 2**24 keys at 16 to 32 bits are 64 MB at most.
BLOOM_MAX_KEYS = 1 << 24


def bloom_of(keys: DataFrame, count: int):
    """Broadcast Bloom filter over the first (long) column, or None if count exceeds BLOOM_MAX_KEYS.

    At least 16 bits a key in 64 segments by the key's last six bits; each segment is built in its own
    task, so that only the bits reach the driver. Never a false negative; callers must be right with None.
    """
    if count > BLOOM_MAX_KEYS:
        return None
    bits = 1 << 10
    while bits * SEGMENTS < 16 * count:
        bits *= 2

    def build(key, table):  # without hints: Spark reads them
        part = np.zeros(bits, dtype=bool)
        h = tk.mix(table.column("k").to_numpy().astype(np.uint64))
        part[(h >> np.uint64(8)) & np.uint64(bits - 1)] = True
        part[(h >> np.uint64(36)) & np.uint64(bits - 1)] = True
        return pa.table({"segment": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(part).tobytes()], pa.binary())})

    spread = keys.select(F.col(keys.columns[0]).cast("long").alias("k")).withColumn("segment", F.expr(f"cast(k & {SEGMENTS - 1} as int)"))
    table = np.zeros((SEGMENTS, bits // 8), dtype=np.uint8)
    for row in spread.groupBy("segment").applyInArrow(build, "segment int, bits binary").collect():
        table[row.segment] = np.frombuffer(row.bits, dtype=np.uint8)
    return keys.sparkSession.sparkContext.broadcast(table)


def bloom_has(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """For each uint64 key: False if it is surely not in the filter."""
    bits = np.uint64(table.shape[1] * 8 - 1)
    segment = (keys & np.uint64(SEGMENTS - 1)).astype(np.int64)
    h = tk.mix(keys)

    def has(place: np.ndarray) -> np.ndarray:
        place = (place & bits).astype(np.int64)
        return (table[segment, place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 > 0

    return has(h >> np.uint64(8)) & has(h >> np.uint64(36))

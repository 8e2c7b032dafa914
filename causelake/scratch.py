"""Tables written to the folder that driver and executors share, and read back."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a narrow table that may be broadcast.
FEW_ROWS = 1_000_000
_WRITTEN: list[tuple[object, object]] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a local session without one gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = own.get() if own.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="causelake-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


@atexit.register
def _remove() -> None:
    for path, fs in _WRITTEN:
        try:
            fs.delete(path, True)
        except Exception:  # noqa: BLE001 - the JVM may be gone; the folder's owner clears it
            return


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: what is computed once stays so when executors are lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark._jvm.org.apache.hadoop.fs.Path(path)
    _WRITTEN.append((jvm, jvm.getFileSystem(spark._jsc.hadoopConfiguration())))
    return spark.read.schema(df.schema).parquet(path)


def sized(table: DataFrame, bound: int = FEW_ROWS) -> DataFrame:
    """A written narrow table, marked for broadcast if it has at most ``bound`` rows."""
    return F.broadcast(table) if table.count() <= bound else table

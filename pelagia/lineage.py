"""Cutting the lineage of iterative jobs: tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir.

    Where it is unset, a local master, as in tests, gets a folder of our own; on a cluster that is an error, since what
    one machine writes to its own disk the others cannot read."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="pelagia-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def cut(df: DataFrame, name: str = "step", folder: str = "steps") -> DataFrame:
    """df written as a table below spark.checkpoint.dir and read back; a lost executor then costs one step's tasks.

    The table's path is kept as `_saved_at`, for whoever wants to delete it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{folder}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made._saved_at = path
    return made


def discard(*made: DataFrame) -> None:
    """Delete tables of cut() that nothing reads any more."""
    for df in made:
        session = df.sparkSession.sparkContext
        path = session._jvm.org.apache.hadoop.fs.Path(df._saved_at)
        path.getFileSystem(session._jsc.hadoopConfiguration()).delete(path, True)

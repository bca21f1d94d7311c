"""Helpers that the operators of this package share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pelagia.lineage import cut

#: Java's regular expression for a word: what lies between the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: With this setting Spark removes a query's shuffle files when the query has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: While a table is written: no shuffle files afterwards, and batches for Python of at most 8 MB, whatever the rows' size.
WRITING = {CLEANUP: "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What save() has written inside each scratch() that is open, the outermost first.
_OPEN: list[list[DataFrame]] = []


def save(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: this cuts the lineage and survives lost executors.

    Nothing reads the query's shuffle files after that, so they need not stay until the session ends."""
    spark = df.sparkSession
    before = {k: spark.conf.get(k) for k in WRITING}
    try:
        for k, v in WRITING.items():
            spark.conf.set(k, v)
        made = cut(df, name, "tables")
        for held in _OPEN:
            held.append(made)
        return made
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def discard(*saved: DataFrame) -> None:
    """Delete tables of save() that nothing reads any more, so that long jobs do not fill the shared folder."""
    for df in saved:
        session = df.sparkSession.sparkContext
        path = session._jvm.org.apache.hadoop.fs.Path(df._saved_at)
        path.getFileSystem(session._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Delete at the end every table that save() wrote inside, but for those in the list that it yields.

    Shuffle files of counts and other actions inside go with their query, too."""
    keep: list[DataFrame] = []
    before = spark.conf.get(CLEANUP)
    made: list[DataFrame] = []
    _OPEN.append(made)
    spark.conf.set(CLEANUP, "true")
    try:
        yield keep
    finally:
        spark.conf.set(CLEANUP, before)
        _OPEN[:] = [held for held in _OPEN if held is not made]
        kept = {df._saved_at for df in keep}
        discard(*(df for df in made if df._saved_at not in kept))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def text_key(text: Column) -> Column:
    """60 bits of the MD5 of a text, as a long from 0: equal texts have equal keys, other texts spread evenly."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))

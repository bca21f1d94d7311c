"""Sharding by histogram sort: exact byte counts below candidate keys, refined until every splitter is exact.

Rows are ordered by (key of the text, doc_id). A round counts, over all partitions, the rows and bytes between evenly
spaced candidate keys; only the intervals that still hold a splitter or too many rows get finer candidates in the next
round. The driver sees a bounded histogram, never rows. Afterwards one exchange numbers the rows inside each interval.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pelagia.llm.common import save, table, text_key, text_or_empty

KEY_BITS = 60


@dataclass
class Interval:
    """Rows with a key from k0 to k1 and an id from d0 to d1; bin is the first-round interval that holds it."""

    bin: int
    k0: int
    k1: int
    d0: int
    d1: int
    rows: int
    bytes: int
    start: int = 0

    def one_text(self) -> bool:
        return self.k0 == self.k1

    def one_row(self) -> bool:
        return self.one_text() and self.d0 == self.d1


def _counted(df: DataFrame, *by: str) -> list:
    return (
        df.groupBy(*by)
        .agg(F.count("*").alias("n"), F.sum("_size").alias("b"), F.min("_k").alias("k0"), F.max("_k").alias("k1"), F.min("_d").alias("d0"), F.max("_d").alias("d1"))
        .collect()
    )


def _intervals_frame(spark: SparkSession, intervals: list[Interval], extra: list[tuple]) -> DataFrame:
    rows = [(x.bin, x.k0, x.k1, x.d0, x.d1, *e) for x, e in zip(intervals, extra, strict=True)]
    return spark.createDataFrame(rows, "_bin long, _k0 long, _k1 long, _d0 long, _d1 long, _a long, _b long, _c boolean")


def _located(df: DataFrame, intervals: DataFrame) -> DataFrame:
    """Each row with its interval. The intervals are bounded by the histogram's size, so they are broadcast."""
    inside = F.col("_k").between(F.col("_k0"), F.col("_k1")) & F.col("_d").between(F.col("_d0"), F.col("_d1"))
    return df.join(F.broadcast(intervals.withColumnRenamed("_bin", "_bin_")), (F.col("_bin") == F.col("_bin_")) & inside)


def histogram(keyed: DataFrame, n_shards: int, tolerance: float, bits: int, fanout: int) -> list[Interval]:
    """Intervals in key order; no splitter lies inside one that could still be divided.

    keyed has _bin, _k, _d, _size. A text's copies form one unit, which goes whole to the shard in which it starts;
    a unit of more than `tolerance` of a shard is divided by doc_id, so a hot text cannot unbalance the shards."""
    spark = keyed.sparkSession
    done: list[Interval] = []
    work = [Interval(r["_bin"], r["k0"], r["k1"], r["d0"], r["d1"], r["n"], r["b"]) for r in _counted(keyed, "_bin")]
    total, rows = sum(x.bytes for x in work), sum(x.rows for x in work)
    crowded = max(64, 8 * rows // (1 << bits))
    hot = tolerance * total / n_shards
    while work:
        every = sorted(done + work, key=lambda x: (x.k0, x.d0))
        at = 0
        for x in every:
            x.start = at
            at += x.bytes
        finer = []
        for x in every:
            split_here = (x.start * n_shards // total + 1) * total < (x.start + x.bytes) * n_shards
            whole_unit = x.one_row() or (x.one_text() and x.bytes <= hot)
            if (split_here and not whole_unit) or (x.rows > crowded and not x.one_row()):
                finer.append(x)
        kept = {id(x) for x in finer}
        done = [x for x in every if id(x) not in kept]
        if not finer:
            break
        steps = [(i, max(1, -(-((x.d1 - x.d0 + 1) if x.one_text() else (x.k1 - x.k0 + 1)) // fanout)), x.one_text()) for i, x in enumerate(finer)]
        probed = _located(keyed, _intervals_frame(spark, finer, steps))
        child = F.when(F.col("_c"), F.expr("(_d - _d0) div _b")).otherwise(F.expr("(_k - _k0) div _b"))
        work = [Interval(finer[r["_a"]].bin, r["k0"], r["k1"], r["d0"], r["d1"], r["n"], r["b"]) for r in _counted(probed.withColumn("_child", child), "_a", "_child")]
    return sorted(done, key=lambda x: (x.k0, x.d0))


def shard(df: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text", tolerance: float = 0.05, bits: int = 12, fanout: int = 256) -> DataFrame:
    """df with size, shard and slot; columns of these names that df has already are replaced.

    size: UTF-8 bytes of the text (null: none) plus 1. shard: 0 to n_shards - 1, of nearly equal sizes: a unit (the
    copies of a text, or one id's rows where the copies are more than `tolerance` of a shard) goes to the shard in
    which its first byte falls. slot: gapless from 0 in each shard, in the order of (key, id). A null id counts as
    the smallest id; repeated rows share a unit; an empty table gives an empty result. The histogram that the driver
    sees holds at most 2^bits intervals and `fanout` for each that is refined."""
    names = [c for c in df.columns if c not in ("size", "shard", "slot")]
    text = text_or_empty(text_col)
    keys = df.select(
        F.struct(*names).alias("_row"),
        (F.octet_length(text).cast("long") + 1).alias("_size"),
        text_key(text).alias("_k"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 62))).alias("_d"),
    ).withColumn("_bin", F.shiftright("_k", KEY_BITS - bits))
    keyed = save(keys.select("_bin", "_k", "_d", "_size"), "shard-keys")
    found = histogram(keyed, n_shards, tolerance, bits, fanout)
    total, before, places = sum(x.bytes for x in found), [0] * n_shards, []
    for x in found:
        to = min(n_shards - 1, x.start * n_shards // total)
        places.append((to, before[to], False))
        before[to] += x.rows
    placed = _located(keys, _intervals_frame(df.sparkSession, found, places))
    order = Window.partitionBy("_bin", "_k0", "_d0").orderBy("_k", "_d")
    return placed.select("_row.*", F.col("_size").alias("size"), F.col("_a").cast("int").alias("shard"), (F.col("_b") + F.row_number().over(order) - 1).alias("slot"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7 by the law `bytes`."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = shard(docs.withColumn("text_crc32", F.crc32(text_or_empty())))
    return made.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

"""Connected components of a graph of long ids, by alternating large and small stars on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pelagia.llm.common import discard, save


def _star(both: DataFrame) -> DataFrame:
    """Each edge (u, v) of `both` with m, the smallest of u and its neighbours."""
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """node and root (the smallest node that it reaches) of every node of `edges`, whose first two columns are its ends.

    Repeated, reversed and looping edges are allowed; edges with a null end are no edges. Each round is written to the
    shared folder, so no lineage grows; the edges never meet on the driver."""
    a, b = edges.columns[:2]
    flat = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now, before = save(flat.distinct(), "edges"), None
    state = _state(now)
    for _ in range(most):
        if state == before or not state[0]:
            break
        both = now.union(now.select(F.col("v"), F.col("u")))
        large = _star(both).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _star(large)
        small = small.select(F.col("v").alias("u"), "m").union(small.select("u", "m")).where("u <> m").select("u", F.col("m").alias("v")).distinct()
        old, now, before = now, save(small, "edges"), state
        discard(old)
        state = _state(now)
    else:
        raise RuntimeError(f"no fixpoint after {most} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()

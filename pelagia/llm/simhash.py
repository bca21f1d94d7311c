"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprints link when at most `radius` of their 64 bits differ. Two such fingerprints have a variant in common that is
within half the radius of both, so every fingerprint emits all variants within half the radius and equal variants meet
in a shuffle. Whatever meets there is within the radius by the triangle inequality, and is verified all the same. The
work is done on distinct fingerprints, of which a variant can gather at most as many as there are variants.

Before that, fingerprints that cannot link to any other are set aside exactly: of 8 bytes, two fingerprints within
radius 4 have at least 4 in common, so one that shares no choice of 4 bytes with another has no link to find.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pelagia.llm.common import discard, save, shuffle_partitions, table
from pelagia.llm.components import components

SPACE = re.compile(rb"[\x20\x09-\x0D]+")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None, width: int, seed: int = 42) -> int:
    """The unsigned fingerprint: a bit is 1 if it is set in more than half of the shingles' XXH64 values."""
    words = [w for w in SPACE.split((text or "").encode("utf-8").translate(LOWER)) if w]
    if not words:
        return 0
    line = b" ".join(words)
    hashes = xxhash.xxh64_intdigest
    if len(words) <= width:
        got = np.array([hashes(line, seed)], dtype=np.uint64)
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = (ends - np.array([len(w) + 1 for w in words])).tolist()
        stops = (ends[width - 1 :] - 1).tolist()
        got = np.fromiter((hashes(line[a:b], seed) for a, b in zip(starts, stops, strict=False)), dtype=np.uint64, count=len(stops))
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(got), 1 << 16):
        bits = np.unpackbits(got[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(ones * 2 > len(got)).tolist()))


def fingerprints(df: DataFrame, width: int = 5, id_col: str = "doc_id", text_col: str = "text", seed: int = 42) -> DataFrame:
    """id_col and fp, the fingerprint as a signed long, of each row of df."""

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = np.array([fingerprint(t, width, seed) for t in b[text_col]], dtype=np.uint64)
            yield pd.DataFrame({id_col: b[id_col], "fp": made.view(np.int64)})

    return df.select(id_col, text_col).mapInPandas(hashed, f"`{id_col}` {dict(df.dtypes)[id_col]}, fp long")


def masks(radius: int) -> np.ndarray:
    """All 64-bit masks of at most `radius` ones, as unsigned longs."""
    bits = [np.uint64(1) << np.uint64(i) for i in range(64)]
    out = [np.uint64(0)]
    for k in range(1, radius + 1):
        out += [np.bitwise_or.reduce(np.array(c, dtype=np.uint64)) for c in itertools.combinations(bits, k)]
    return np.array(out, dtype=np.uint64)


def _may_link(distinct: DataFrame, radius: int, n: int, blocks: int = 8) -> DataFrame:
    """The fingerprints that share all but `radius` of `blocks` equal blocks of bits with another one: a superset of those that link.

    Where just two share a choice of blocks their distance decides at once, so chance meetings open nothing."""
    size = 64 // blocks
    one = (1 << size) - 1
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    kept = [signed(sum(one << (size * i) for i in choice)) for choice in itertools.combinations(range(blocks), blocks - radius)]
    choices = F.array(*(F.struct(F.lit(i).alias("c"), F.lit(m).cast("long").alias("m")) for i, m in enumerate(kept)))
    spread = distinct.repartition(max(shuffle_partitions(distinct.sparkSession), -(-n * len(kept) // 1_000_000)))
    keyed = spread.select("fp", F.explode(choices).alias("x")).select("fp", F.xxhash64("x.c", F.col("fp").bitwiseAND(F.col("x.m"))).alias("key"))
    shared = keyed.groupBy("key").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi"), F.count("*").alias("n")).where("lo <> hi")
    shared = save(shared, "simhash-shared")
    few = shared.where((F.col("n") == 2) & (F.bit_count(F.col("lo").bitwiseXOR(F.col("hi"))) <= radius)).select(F.explode(F.array("lo", "hi")).alias("fp"))
    many = keyed.join(shared.where("n > 2").select("key").hint("merge"), "key", "left_semi").select("fp")
    return few.union(many).distinct()


def _forest(fp: np.ndarray, variant: np.ndarray, radius: int) -> pd.DataFrame:
    """A spanning forest of the fingerprints that share variants here; every edge is verified."""
    order = np.lexsort((fp, variant))
    fp, variant = fp[order], variant[order]
    same = np.flatnonzero(variant[1:] == variant[:-1])
    a, b = fp[same], fp[same + 1]
    pairs = np.unique(np.stack([a, b], axis=1), axis=0)
    differ = np.unpackbits((pairs[:, 0] ^ pairs[:, 1]).view(np.uint8).reshape(-1, 8), axis=1).sum(axis=1)
    pairs = pairs[(differ <= radius) & (differ > 0)]
    nodes, index = np.unique(pairs, return_inverse=True)
    index, parent, keep = index.reshape(-1, 2), list(range(len(nodes))), []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, (x, y) in enumerate(index.tolist()):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
            keep.append(i)
    made = pairs[keep]
    return pd.DataFrame({"a": made[:, 0].view(np.int64), "b": made[:, 1].view(np.int64)}) if keep else pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})


def links(distinct: DataFrame, radius: int = 4, rows_per_task: int = 3_000_000) -> DataFrame:
    """Edges (a, b) that connect all fingerprints of the column fp (distinct longs) which chains of links connect.

    Not all links are returned, only enough of them for the same components: each task of the shuffle on variants
    keeps a spanning forest of what meets in it. Tasks hold about `rows_per_task` variants each."""
    half = (radius + 1) // 2
    balls = masks(half)
    spark = distinct.sparkSession
    open_ = save(_may_link(distinct, radius, distinct.count()), "simhash-open") if 0 < radius < 8 else distinct
    n = max(1, math.ceil(open_.count() * len(balls) / rows_per_task), min(shuffle_partitions(spark), 8))

    def emitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            all_ = b["fp"].to_numpy().view(np.uint64)
            for i in range(0, len(all_), 128):
                part = all_[i : i + 128]
                yield pd.DataFrame({"variant": (part[:, None] ^ balls[None, :]).reshape(-1).view(np.int64), "fp": np.repeat(part, len(balls)).view(np.int64)})

    def met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [(b["fp"].to_numpy(), b["variant"].to_numpy()) for b in batches]
        if parts:
            yield _forest(np.concatenate([p[0] for p in parts]).view(np.uint64), np.concatenate([p[1] for p in parts]).view(np.uint64), radius)

    variants = open_.repartition(max(1, min(n, 64)), "fp").mapInPandas(emitted, "variant long, fp long")
    return variants.repartition(n, "variant").mapInPandas(met, "a long, b long").distinct()


def near_duplicates(df: DataFrame, width: int = 5, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, fp and component (the smallest id reachable over links) of each row of df; other columns are not read.

    Null and empty texts have the fingerprint zero and link like any other. Rows of equal fingerprints are one node;
    repeated rows are returned as often as they come. Ids are longs; a null id counts as larger than any other."""
    marked = save(fingerprints(df.withColumn(id_col, F.col(id_col).cast("long")), width, id_col, text_col), "simhash")
    least = marked.groupBy("fp").agg(F.min(id_col).alias("least"))
    found = components(links(least.select("fp"), radius))
    rooted = least.join(found, least["fp"] == found["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = save(rooted.groupBy("root").agg(F.min("least").alias("component")).join(rooted, "root").select("fp", "component"), "simhash-components")
    return marked.join(named, "fp").select(id_col, "fp", "component")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint and component of every document, with 4-word shingles as its contract says."""
    made = near_duplicates(table(spark, sf_dir, "documents"), width=4, radius=4)
    return made.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))

"""Approximate nearest neighbours on shifted space-filling curves, with a reach that is fitted to the wanted recall.

Vectors are projected to a few random directions, shifted, and ordered along a Hilbert curve; several projections give
several orders. Spark range-partitions each order, and runs of consecutive vectors become windows. A query is compared
with its own and the neighbouring windows of every curve; the merged candidates are reranked by their exact cosine. The
queries of consecutive windows meet their neighbouring windows together, in a bounded number of pieces that stream
through tasks, so what a query gives is a few rows, however many windows it needs.
Equal vectors are one entry of the windows, so a large group of copies is one query and one candidate.

How many curves and how many windows on either side are used is fitted: a bounded sample of the queries is compared with
all vectors, and the cheapest choice that finds the wanted share of the sample's true neighbours is taken. Vectors with
structure need few windows; vectors without any, whose neighbours are hardly nearer than others, need most of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pelagia.llm.common import save, table

FOUND = "query_id long, vec_id long, score double"
#: How far apart two ways to sum one cosine may be.
SLACK = 1e-9
#: Windows that a task compares at once, and cosines that it holds at once.
HELD, SCORES = 16, 1 << 21
#: Pieces that a query's windows are dealt over, on all curves together.
PIECES = 8


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """The Hilbert index of each row of cells (integers of `bits` bits in each dimension), by Skilling's transform."""
    x = cells.astype(np.uint64).T.copy()
    dims = len(x)
    q = np.uint64(1 << (bits - 1))
    while q > 1:
        p = q - np.uint64(1)
        for i in range(dims):
            high = (x[i] & q) != 0
            t = (x[0] ^ x[i]) & p
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            x[i] = np.where(high, x[i], x[i] ^ t)
        q >>= np.uint64(1)
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t, q = np.zeros(x.shape[1], dtype=np.uint64), np.uint64(1 << (bits - 1))
    while q > 1:
        t = np.where((x[dims - 1] & q) != 0, t ^ (q - np.uint64(1)), t)
        q >>= np.uint64(1)
    x ^= t
    key = np.zeros(x.shape[1], dtype=np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << np.uint64(1)) | ((x[i] >> np.uint64(b)) & np.uint64(1))
    return key.astype(np.int64)


def curve_keys(vectors: np.ndarray, curve: int, dims: int = 8, bits: int = 7) -> np.ndarray:
    """Keys of unit vectors along one curve: a random projection of its own, shifted by a random part of a cell's range."""
    rng = np.random.default_rng(1000 + curve)
    d = vectors.shape[1]
    basis = np.linalg.qr(rng.standard_normal((d, max(d, dims))).T if d < dims else rng.standard_normal((d, dims)))[0][:, :dims]
    if basis.shape[0] != d:
        basis = rng.standard_normal((d, dims)) / np.sqrt(d)
    spread = np.clip(vectors @ basis * np.sqrt(d) / 8 + 0.5, 0, 0.999)
    cells = np.floor((spread + rng.random(basis.shape[1])) / 2 * (1 << bits))
    return hilbert_keys(cells.astype(np.int64), bits)


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and vec (doubles) of the vectors that take part: all components finite, not all zero, of the commonest length."""
    v = F.col(vector_col)
    fine = df.where(F.col(id_col).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0))
    rows = fine.select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("vec"))
    usual = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("vec") == usual[0]["n"]) if usual else rows


def _matrix(rows, d: int) -> np.ndarray:
    return np.frombuffer(rows, dtype=np.float64).reshape(-1, d)


def windows(vectors: DataFrame, d: int, curve: int, size: int, n_ranges: int, is_query: Column) -> DataFrame:
    """number, ids, asks, data: the vectors in the order of a curve, `size` of them to a row, numbered along the curve."""

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.stack(b["vec"].to_numpy()) if len(b) else np.zeros((0, d))
            unit = x / np.abs(x).max(axis=1, keepdims=True)
            unit /= np.linalg.norm(unit, axis=1, keepdims=True)
            yield b.assign(key=curve_keys(unit, curve))

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        range_, at = TaskContext.get().partitionId(), 0
        held = pd.DataFrame()
        for b in batches:
            held = pd.concat([held, b]) if len(held) else b
            while len(held) >= size:
                yield _window(held[:size], range_, at)
                held, at = held[size:], at + 1
        if len(held):
            yield _window(held, range_, at)

    ordered = vectors.select("id", "vec", is_query.alias("ask")).mapInPandas(keyed, "id long, vec array<double>, ask boolean, key long")
    ordered = ordered.repartitionByRange(n_ranges, "key", "id").sortWithinPartitions("key", "id")
    made = save(ordered.mapInPandas(packed, "range int, at int, ids array<long>, asks array<boolean>, data binary"), f"curve{curve}")
    counts = {r["range"]: r["count"] for r in made.groupBy("range").count().collect()}
    first, firsts = 0, []
    for r in sorted(counts):
        firsts.append((r, first))
        first += counts[r]
    offsets = made.sparkSession.createDataFrame(firsts, "range int, first long")
    return made.join(F.broadcast(offsets), "range").select((F.col("first") + F.col("at")).alias("number"), "ids", "asks", "data")


def _window(rows: pd.DataFrame, range_: int, at: int) -> pd.DataFrame:
    x = np.ascontiguousarray(np.stack(rows["vec"].to_numpy()), dtype=np.float64)
    return pd.DataFrame([(range_, at, rows["id"].to_numpy(), rows["ask"].to_numpy(), x.tobytes())], columns=["range", "at", "ids", "asks", "data"])


def queries_of(blocks: DataFrame, d: int) -> DataFrame:
    """number, asking, asked: the queries of each window that has any."""

    def chosen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for number, ids, asks, data in zip(b["number"], b["ids"], b["asks"], b["data"], strict=True):
                take = np.asarray(asks, dtype=bool)
                if take.any():
                    yield pd.DataFrame([(number, np.asarray(ids)[take], _matrix(data, d)[take].tobytes())], columns=["number", "asking", "asked"])

    return blocks.mapInPandas(chosen, "number long, asking array<long>, asked binary")


def _best(q_ids: np.ndarray, q: np.ndarray, floors: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> pd.DataFrame:
    """For each query the k best rows of x that reach its floor, itself included."""
    norm, q_norm, found = np.sqrt((x * x).sum(axis=1)), np.sqrt((q * q).sum(axis=1)), []
    step = max(1, SCORES // max(1, len(x)))
    for i in range(0, len(q), step):
        scores = (q[i : i + step] @ x.T) / norm[None, :] / q_norm[i : i + step, None]
        floor = floors[i : i + step]
        if len(x) >= k and (floor == -np.inf).any():
            floor = np.maximum(floor, np.partition(scores, -k, axis=1)[:, -k])
        row, at = np.nonzero((scores >= floor[:, None] - SLACK) & (scores > -np.inf))
        row += i
        exact = (x[at] * q[row]).sum(axis=1) / (norm[at] * q_norm[row])
        found.append(_first_k(row, ids[at], exact, k))
    row, near, exact = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, dtype=int), ids[:0], np.zeros(0))
    return pd.DataFrame({"query_id": q_ids[row], "vec_id": near, "score": exact})


def _first_k(row: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k entries of each row with the largest scores, ties to the smaller id, in the order of the rows."""
    order = np.lexsort((ids, -scores, row))
    row, ids, scores = row[order], ids[order], scores[order]
    take = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[take], ids[take], scores[take]


def merged(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query, each neighbour once, with its rank."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _pieces(blocks: DataFrame, d: int, reach: int, pieces: int, most: int = 128) -> DataFrame:
    """part, piece, number, asking, asked, ids, data: the queries of some consecutive windows and the windows near them.

    A part has the queries of as many windows as `reach`, at most `most`; the windows within `reach` of any of them are
    dealt over `pieces`, each of which has all the part's queries. Rows hold queries or a window, the others are null."""
    wide = max(1, min(reach, most))
    part_of = lambda c: F.floor(c / wide)
    asked = queries_of(blocks, d).withColumn("part", part_of(F.col("number")))
    queries = asked.select("part", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))).alias("piece"), "number", "asking", "asked", F.lit(None).cast("array<long>").alias("ids"), F.lit(None).cast("binary").alias("data"))
    spread = blocks.select(F.explode(F.sequence(part_of(F.col("number") - reach), part_of(F.col("number") + reach))).alias("part"), F.pmod("number", F.lit(pieces)).alias("piece"), "number", F.lit(None).cast("array<long>").alias("asking"), F.lit(None).cast("binary").alias("asked"), "ids", "data")
    return queries.union(spread.join(asked.select("part").distinct(), "part", "left_semi").select(queries.columns))


def _compared(rows: DataFrame, d: int, k: int) -> DataFrame:
    """The k best of each query in the windows of its part and piece (rows as _pieces() gives them).

    A task holds the queries of one piece with the best found so far, and some windows at a time."""

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, asking, asked, best, held = None, [], [], None, []

        def best_with(held: list, best: pd.DataFrame | None) -> pd.DataFrame:
            of, q = np.concatenate(asking), _matrix(b"".join(asked), d)
            ids, x = np.concatenate([h[0] for h in held]), _matrix(b"".join(h[1] for h in held), d)
            order = np.argsort(of, kind="stable")
            of, q, floors = of[order], q[order], np.full(len(of), -np.inf)
            if best is not None:
                row, count = np.unique(np.searchsorted(of, best["query_id"].to_numpy()), return_counts=True)
                last = np.minimum.reduceat(best["score"].to_numpy(), np.cumsum(count) - count) if len(row) else np.zeros(0)
                floors[row] = np.where(count == k, last, -np.inf)
            got = _best(of, q, floors, ids, x, k)
            both = pd.concat([best, got]) if best is not None else got
            row, near, score = _first_k(*(both[c].to_numpy() for c in ("query_id", "vec_id", "score")), k)
            return pd.DataFrame({"query_id": row, "vec_id": near, "score": score})

        for b in batches:
            for part, piece, of, q, ids, data in zip(b["part"], b["piece"], b["asking"], b["asked"], b["ids"], b["data"], strict=True):
                if now != (part, piece):
                    if held and asking:
                        best = best_with(held, best)
                    if best is not None:
                        yield best
                    now, asking, asked, best, held = (part, piece), [], [], None, []
                if q is not None:
                    asking.append(np.asarray(of, dtype=np.int64))
                    asked.append(q)
                elif asking:
                    held.append((np.asarray(ids, dtype=np.int64), data))
                    if len(held) == HELD:
                        best, held = best_with(held, best), []
        if held and asking:
            best = best_with(held, best)
        if best is not None:
            yield best

    dealt = rows.repartition("part", "piece").sortWithinPartitions("part", "piece", F.col("asked").isNull(), "number")
    return dealt.select("part", "piece", "asking", "asked", "ids", "data").mapInPandas(compared, FOUND)


def true_neighbours(vectors: DataFrame, queries: DataFrame, d: int, k: int, size: int = 4096) -> DataFrame:
    """FOUND: the exact k nearest of few queries (their vectors travel with the tasks), by one pass over all vectors."""
    rows = queries.orderBy("id").collect()
    asking, asked = np.array([r["id"] for r in rows]), np.array([r["vec"] for r in rows], dtype=np.float64)

    def passed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = pd.DataFrame(columns=["query_id", "vec_id", "score"])
        for b in batches:
            for i in range(0, len(b), size):
                part = b.iloc[i : i + size]
                got = _best(asking, asked, np.full(len(asking), -np.inf), part["id"].to_numpy(), np.stack(part["vec"].to_numpy()), k)
                best = pd.concat([best, got]) if len(best) else got
                best = best.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True]).groupby("query_id").head(2 * k)
        yield best

    return merged(vectors.select("id", "vec").mapInPandas(passed, FOUND), k)


def fitted_reach(places: DataFrame, true: DataFrame, curves: int, recall: float) -> tuple[int, int]:
    """(curves, windows on either side) of the fewest windows in all that find `recall` of the true neighbours.

    places: curve, id, number of the window; true: query_id, vec_id, both of a bounded sample."""
    ask = true.select("query_id", "vec_id").distinct()
    asked = ask.join(places.toDF("curve", "query_id", "own"), "query_id").join(places.toDF("curve", "vec_id", "its"), ["curve", "vec_id"])
    rows = asked.groupBy("query_id", "vec_id", "curve").agg(F.min(F.abs(F.col("own") - F.col("its"))).alias("apart")).collect()
    pairs = sorted({(r["query_id"], r["vec_id"]) for r in rows})
    if not pairs:
        return 1, 1
    at = {p: i for i, p in enumerate(pairs)}
    apart = np.full((len(pairs), curves), np.iinfo(np.int64).max)
    for r in rows:
        apart[at[r["query_id"], r["vec_id"]], r["curve"]] = r["apart"]
    need = int(np.ceil(recall * len(pairs))) - 1
    reach = [int(np.sort(apart[:, : c + 1].min(axis=1))[need]) for c in range(curves)]
    best = min(range(curves), key=lambda c: ((c + 1) * (2 * max(1, reach[c]) + 1), c))
    return best + 1, max(1, reach[best])


def search(
    df: DataFrame,
    is_query: Column,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    curves: int = 6,
    size: int = 256,
    per_range: int = 100_000,
    recall: float = 0.96,
    sample: int = 128,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of each query row by cosine, ties to the smaller id.

    is_query: a condition on the column `id`. All vectors are in the windows of every curve. The number of curves (at
    most `curves`) and of windows is fitted so that `sample` queries, those of the smallest hashes, find `recall` of
    their true neighbours; both are bounds on what reaches the driver. Null, zero, null-holding and non-finite vectors,
    vectors of an unusual length and rows without an id take no part. Equal vectors are searched for once, as a class,
    and tie; of a class, its k + 1 smallest ids can be neighbours. Rows that repeat an id count as one neighbour, the
    nearest; queries of one id are answered together. An empty table or one without queries gives an
    empty result."""
    spark = df.sparkSession
    rows = save(usable(df, id_col, vector_col).withColumn("ask", is_query), "vectors")
    if rows.where("ask").isEmpty():
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # equal vectors are one class, numbered in the order of their smallest ids, so that ties of classes keep that order
    alike = rows.groupBy("vec").agg(F.min("id").alias("_first"), F.coalesce(F.max("ask"), F.lit(False)).alias("ask"))
    vectors = save(alike.orderBy("_first", F.xxhash64("vec")).select(F.monotonically_increasing_id().alias("id"), "vec", "ask"), "classes")
    members = save(rows.join(vectors.select(F.col("id").alias("of"), "vec"), "vec").select("of", "id", "ask").distinct(), "members")
    # a query's own row is no neighbour, in as many classes as it is
    wide = k + members.groupBy("id").count().agg(F.max("count")).first()[0]
    n, d = vectors.count(), vectors.select(F.size("vec")).first()[0]
    n_ranges = max(2, -(-n // per_range))
    orders = [save(windows(vectors, d, c, size, n_ranges, F.col("ask")), "windows") for c in range(curves)]
    few = vectors.where("ask").orderBy(F.xxhash64("id"), "id").limit(sample)
    true = save(true_neighbours(vectors, few, d, wide), "true-neighbours").where("query_id <> vec_id")
    places = reduce(DataFrame.union, (o.select(F.lit(c).alias("curve"), F.explode("ids").alias("id"), "number") for c, o in enumerate(orders)))
    used, reach = fitted_reach(places, true, curves, recall)
    found = []
    for blocks in orders[:used]:
        found.append(save(_compared(_pieces(blocks, d, reach, max(1, PIECES // used)), d, wide), "found"))
    best = merged(reduce(DataFrame.union, found), wide).select(F.col("query_id").alias("_query"), F.col("vec_id").alias("of"), "score")
    lowest = members.withColumn("_n", F.row_number().over(Window.partitionBy("of").orderBy("id"))).where(F.col("_n") <= k + 1).select("of", F.col("id").alias("vec_id"))
    asking = members.where("ask").select(F.col("of").alias("_query"), F.col("id").alias("query_id"))
    pairs = asking.join(best.join(lowest, "of"), "_query").where("query_id <> vec_id")
    return merged(pairs.select("query_id", "vec_id", "score"), k).select("query_id", "rank", "vec_id", "score")


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest other vectors found of every 50th vector."""
    return search(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5)

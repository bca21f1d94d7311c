"""Near-duplicate vectors by random-hyperplane sign hashing in several tables.

A pair whose angle is t agrees in one sign with probability 1 - t/pi, so in a table of k signs with that to the power k.
The number of tables follows from this law alone: a pair at the threshold itself stays unmet in all tables with
probability `miss` at most, closer pairs less often. Whatever meets is verified by its exact cosine in double precision.

* Equal vectors are one node with a weight. A pair is counted in the first table in which it meets, which its nodes'
  signatures tell, so no pair is ever written and none is counted twice.
* Tables are worked off in turns of `rows_at_once` rows (one table at least), whose shuffle files go at once, so disk
  never holds all tables.
* A bucket of over `block` nodes is cut into blocks, and each pair of blocks is a cell of its own, so that no task
  holds more than two blocks of a bucket. Tight groups need no cells among themselves: nodes within half the threshold
  angle of one pivot (a ball) all link with each other by the triangle inequality on the sphere, and are counted so.
* Only tables of a few counted rows are broadcast. Tables that grow with the nodes are small as files, but not in memory,
  so they are joined by shuffles and never pass through the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pelagia.llm.common import discard, save, scratch, shuffle_partitions, table
from pelagia.llm.components import components

#: A cosine this close to a bound is computed again in a fixed order, so that the shape of a block cannot decide.
DOUBT = 1e-9
#: Rows that look up a small table are spread over so many copies of it.
SALTS = 16
#: A table of so many rows at most (without vectors) may pass through the driver, to be broadcast.
FEW = 20_000


def table_count(bits: int, threshold: float, miss: float) -> int:
    """Tables of `bits` signs after which a pair at the threshold is unmet with probability `miss` at most."""
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return max(1, math.ceil(math.log(miss) / math.log1p(-meet)))


def signature_bits(n: int, bucket: int) -> int:
    """Signs a table, so that evenly spread vectors come to about `bucket` in a bucket."""
    return min(30, max(3, math.ceil(math.log2(max(n, 1) / bucket)) if n > bucket else 3))


def units(x: np.ndarray) -> np.ndarray:
    """Unit vectors of the rows; scaled first, so that squares neither overflow nor vanish."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def stacked(packed: pd.Series, kind: str) -> np.ndarray:
    """One row per packed array; all have one length."""
    return np.frombuffer(b"".join(packed), dtype=kind).reshape(len(packed), -1)


def linked(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the pairs of unit vectors whose cosine is at least the threshold."""
    cosines = a @ b.T
    i, j = np.nonzero(cosines >= threshold - DOUBT)
    near = np.flatnonzero(cosines[i, j] <= threshold + DOUBT)
    if len(near):
        again = np.array([math.fsum((a[x] * b[y]).tolist()) for x, y in zip(i[near], j[near], strict=True)])
        keep = np.ones(len(i), dtype=bool)
        keep[near[again < threshold]] = False
        i, j = i[keep], j[keep]
    return i, j


def least_labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index that each of n nodes reaches over the edges (i, j)."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        now = label.copy()
        np.minimum.at(now, label[i], low)
        np.minimum.at(now, label[j], low)
        while (now[now] != now).any():
            now = now[now]
        if (now == label).all():
            break
        label = now
    return label


def _vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """_id, _vec and the key of equal vectors; _vec is null where a vector takes no part."""
    vec = F.col(vec_col)
    sound = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(vec, lambda x: x != 0)
    # adding zero makes a negative zero a zero, so that copies have one key
    zero = F.lit(0.0).cast("float" if "float" in dict(df.dtypes)[vec_col] else "double")
    kept = df.select(F.col(id_col).cast("long").alias("_id"), F.when(sound, F.transform(vec, lambda x: x + zero)).alias("_vec"))
    return kept.withColumns({"_k": F.xxhash64(F.lit(1), "_vec"), "_l": F.xxhash64(F.lit(2), "_vec")})


def _signed(nodes: DataFrame, bits: int, tables: int, seed: int, kind: str) -> DataFrame:
    """node, weight, dim, the packed vector and the packed signatures of all tables."""

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes: dict[int, np.ndarray] = {}
        for b in batches:
            for dim, part in b.groupby("dim"):
                if dim not in planes:
                    planes[dim] = np.random.default_rng([seed, int(dim)]).standard_normal((tables * bits, int(dim)))
                x = np.array(part["vec"].tolist(), dtype=kind)
                signs = (units(x) @ planes[dim].T >= 0).reshape(len(part), tables, bits)
                values = (signs @ (1 << np.arange(bits, dtype=np.int64))).astype(np.int32)
                yield part.assign(vec=[r.tobytes() for r in x], signs=[r.tobytes() for r in values], buckets=list(values))

    spread = nodes.select("node", "weight", F.size("vec").alias("dim"), "vec")
    return spread.mapInPandas(made, "node long, weight long, dim int, vec binary, signs binary, buckets array<int>")


def matched(rows: DataFrame, small: DataFrame, key: str, how: str) -> DataFrame:
    """rows joined with small, which save() has written: broadcast if it has few rows, by a shuffle of both otherwise."""
    return rows.join(small.hint("broadcast" if small.count() <= FEW else "merge"), key, how)


def salted(rows: DataFrame, small: DataFrame, keys: list[str], by: str, few: bool = False) -> DataFrame:
    """rows left joined with small on keys; a key that holds most rows is spread over copies of its small row.

    A small table that is known to have few rows is broadcast as it is."""
    if few:
        return rows.join(F.broadcast(small), keys, "left")
    # Spark judges by the file, before the copies, and would broadcast millions of rows
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")
    return rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(copies, [*keys, "_salt"], "left").drop("_salt")


def _bucket(number: F.Column) -> F.Column:
    """One long for the length of the vectors and their signature in a table."""
    return F.col("dim").cast("long") * F.lit(1 << 32) + number


def _balls(signed: DataFrame, threshold: float, block: int, rounds: int, kind: str) -> DataFrame:
    """node and ball of nodes in tight groups: all of a ball lie within half the threshold's angle of its pivot.

    Each round looks at one table: a bucket with over `block` nodes outside any ball picks one of them as pivot."""
    close = math.cos(math.acos(threshold) / 2) + DOUBT
    found = signed.sparkSession.createDataFrame([], "node long, ball long")

    def near_pivot(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for _, part in b.groupby("dim"):
                inside = np.einsum("ij,ij->i", units(stacked(part["vec"], kind)), units(stacked(part["pivot"], kind))) >= close
                yield part.loc[inside, ["node", "ball"]]

    for t in range(rounds):
        free = (matched(signed, found, "node", "left_anti") if t else signed).withColumn("bucket", _bucket(F.col("buckets")[t]))
        hot = free.groupBy("bucket").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("node", F.lit(t)), "node")).alias("p")).where(F.col("n") > block)
        hot = save(hot.select("bucket", F.col("p.node").alias("ball")), "vector-pivots")
        if not hot.take(1):
            break
        pivots = matched(signed.select(F.col("node").alias("ball"), F.col("vec").alias("pivot")), hot, "ball", "inner")
        members = salted(free.select("node", "dim", "vec", "bucket"), pivots, ["bucket"], "node").where(F.col("pivot").isNotNull())
        found = found.union(save(members.select("node", "ball", "dim", "vec", "pivot").mapInPandas(near_pivot, "node long, ball long"), "vector-balls"))
    return found


def _blocks(signed: DataFrame, block: int) -> DataFrame:
    """The buckets of over `block` nodes: how many blocks each ball's nodes have there, and the first one's number."""
    keyed = signed.select("dim", "ball", F.posexplode("buckets").alias("t", "number")).select("t", _bucket(F.col("number")).alias("bucket"), "ball")
    sizes = keyed.groupBy("t", "bucket", "ball").agg(F.count("*").alias("n"))
    per_bucket = Window.partitionBy("t", "bucket")
    sizes = sizes.withColumn("whole", F.sum("n").over(per_bucket)).where(F.col("whole") > block)
    sizes = sizes.withColumn("own", F.ceil(F.col("n") / block).cast("int"))
    first = F.sum("own").over(per_bucket.orderBy("ball")) - F.col("own")
    sizes = sizes.withColumns({"first": first.cast("int"), "all": F.sum("own").over(per_bucket).cast("int")})
    return sizes.select("t", "bucket", "ball", "own", "first", "all")


def _cells(signed: DataFrame, blocks: DataFrame | None, tables: range, few: bool = False) -> DataFrame:
    """The rows of some tables by the cells in which they are compared.

    A bucket without blocks is one cell. Elsewhere each pair of blocks is a cell, but not two blocks of one ball."""
    # a row of table t carries the signatures of the tables before it, 4 bytes each
    picked = F.array(*(F.struct(F.lit(t).alias("t"), F.col("buckets")[t].alias("number"), F.substring("signs", 1, 4 * t).alias("signs")) for t in tables))
    keyed = signed.withColumn("x", F.explode(picked)).withColumn("bucket", _bucket(F.col("x.number")))
    keyed = keyed.select("x.t", "bucket", "node", "weight", "ball", "dim", "vec", "x.signs")
    if blocks is None:
        return keyed.withColumns({"cell": F.lit(0).cast("long"), "block": F.lit(0), "other": F.lit(0)})
    marked = salted(keyed, blocks, ["t", "bucket", "ball"], "node", few)
    number = F.coalesce(F.col("first") + F.pmod(F.xxhash64("node", F.lit(7)), F.col("own")).cast("int"), F.lit(0))
    own = lambda x: (F.col("ball") >= 0) & (x >= F.col("first")) & (x < F.col("first") + F.col("own"))
    others = F.when(F.col("all").isNull(), F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("all") - 1), lambda x: ~own(x)))
    spread = marked.withColumn("block", number).withColumn("other", F.explode(others))
    cell = F.least("block", "other").cast("long") * F.lit(1 << 31) + F.greatest("block", "other")
    return spread.withColumn("cell", cell)


def _compared(threshold: float, kind: str):
    """Per cell: the weight that each node links with, and the smallest node of the cell that its links reach."""
    plain = ["t", "bucket", "cell", "node", "weight", "ball", "block", "other"]

    def cell(rows: dict[str, np.ndarray]) -> pd.DataFrame:
        node, weight, ball, block, other = (rows[c] for c in ("node", "weight", "ball", "block", "other"))
        vec, t = units(stacked(rows["vec"], kind)), int(rows["t"][0])
        signs = stacked(rows["signs"], np.int32) if t else None
        within = bool((block == other).all())
        left = np.arange(len(node)) if within else np.flatnonzero(block < other)
        right = left if within else np.flatnonzero(block > other)
        gained, a, b = np.zeros(len(node), dtype=np.int64), [], []
        for at in range(0, len(left), 256):
            some = left[at : at + 256]
            i, j = linked(vec[some], vec[right], threshold)
            i, j = some[i], right[j]
            new = (i < j) if within else np.ones(len(i), dtype=bool)
            new &= (ball[i] != ball[j]) | (ball[i] < 0)
            i, j = i[new], j[new]
            for s in range(t if len(i) else 0):  # a pair that has met in an earlier table is counted there
                new = signs[i, s] != signs[j, s]
                i, j = i[new], j[new]
            np.add.at(gained, i, weight[j])
            np.add.at(gained, j, weight[i])
            a.append(i)
            b.append(j)
        some = np.flatnonzero(gained)
        # rows come ordered by node, so the smallest index is the smallest node
        least = least_labels(len(node), np.concatenate(a), np.concatenate(b)) if len(some) else some
        return pd.DataFrame({"node": node[some], "links": gained[some], "root": node[least[some]]})

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[dict[str, np.ndarray]] = []

        def ended() -> Iterator[pd.DataFrame]:
            if sum(len(h["node"]) for h in held) > 1:
                made = cell({c: np.concatenate([h[c] for h in held]) for c in held[0]})
                if len(made):
                    yield made
            held.clear()

        for b in batches:
            columns = {c: b[c].to_numpy() for c in [*plain, "vec", "signs"]}
            key = np.stack([columns[c] for c in ("t", "bucket", "cell")], axis=1)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
            for x, y in zip(cuts, cuts[1:], strict=False):
                if x < y:
                    if held and any(held[-1][c][0] != columns[c][x] for c in ("t", "bucket", "cell")):
                        yield from ended()
                    held.append({c: v[x:y] for c, v in columns.items()})
        yield from ended()

    return compared


def near_vectors(
    df: DataFrame,
    threshold: float = 0.95,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    miss: float = 1e-6,
    bucket: int = 512,
    block: int = 2048,
    rows_at_once: int = 250_000,
    seed: int = 7,
) -> DataFrame:
    """id_col, n_links and component_id of every row of df; other columns are not read.

    n_links is the number of other rows whose cosine with this one is at least `threshold`, component_id the smallest id
    that links reach. Vectors that are null or zero, or hold null or non-finite components, link with nothing; nor do
    vectors of different lengths with each other. Repeated rows are rows of their own. A null id is larger than any
    other: it is a component only where nothing else is reached. An empty table gives an empty result."""
    spark = df.sparkSession
    with scratch(spark) as keep:
        rows = _vectors(df, id_col, vec_col)
        valid = rows.where(F.col("_vec").isNotNull())
        nodes = valid.groupBy("_k", "_l", F.col("_vec").alias("vec")).agg(F.count("*").alias("weight"), F.min("_id").alias("least"))
        nodes = save(nodes.withColumn("node", F.monotonically_increasing_id()), "vector-nodes")
        n, kind = nodes.count(), "<f4" if "float" in dict(nodes.dtypes)["vec"] else "<f8"
        bits = signature_bits(n, bucket)
        tables = table_count(bits, threshold, miss)
        signed = save(_signed(nodes, bits, tables, seed, kind), "vector-signs")
        balls = _balls(signed, threshold, block, min(3, tables), kind)
        plain, signed = signed, matched(signed, balls, "node", "left").withColumn("ball", F.coalesce("ball", F.lit(-1).cast("long")))
        if balls.count() > FEW:  # shuffled once, not in each turn
            signed = save(signed, "vector-balled")
            discard(plain)
        blocks = save(_blocks(signed, block), "vector-blocks")
        cut_up = blocks.count()
        blocks = blocks if cut_up else None
        at_once = max(1, rows_at_once // max(n, 1))
        tasks = max(shuffle_partitions(spark), n * min(at_once, tables) // 100_000)
        found = []
        for t in range(0, tables, at_once):
            cells = _cells(signed, blocks, range(t, min(t + at_once, tables)), cut_up <= FEW)
            columns = ["t", "bucket", "cell", "node", "weight", "ball", "block", "other", "vec", "signs"]
            dealt = cells.select(*columns).repartition(tasks, "t", "bucket", "cell").sortWithinPartitions("t", "bucket", "cell", "node")
            found.append(save(dealt.mapInPandas(_compared(threshold, kind), "node long, links long, root long"), "vector-links"))
        met = found[0]
        for more in found[1:]:
            met = met.union(more)
        in_balls = save(signed.where("ball >= 0").groupBy("ball").agg(F.sum("weight").alias("all")), "vector-in-balls")
        balled = salted(signed.where("ball >= 0").select("node", "weight", "ball"), in_balls, ["ball"], "node", in_balls.count() <= FEW).select("node", (F.col("all") - F.col("weight")).alias("links"), F.col("ball").alias("root"))
        met = save(met.union(balled).groupBy("node", "root").agg(F.sum("links").alias("links")), "vector-met")
        roots = components(met.select("node", "root"))
        counted = met.groupBy("node").agg(F.sum("links").alias("links"))
        told = nodes.select("node", "_k", "_l", "weight", "least").join(counted.hint("merge"), "node", "left").join(roots.hint("merge"), "node", "left")
        told = told.select("_k", "_l", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "weight", "least", F.coalesce("root", "node").alias("root"))
        told = save(told, "vector-told")
        # partial minima are taken before the exchange, so a component of most nodes is no burden; the way back is salted
        least = told.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n")).where(F.col("n") > 1).drop("n")
        least = save(least, "vector-least")
        rooted = salted(told, least, ["root"], "_k", least.count() <= FEW)
        # a node alone is its own component
        rooted = rooted.select("_k", "_l", "n_links", F.coalesce("component_id", "least").alias("component_id"), "weight")
        answers = save(rooted, "vector-answers")
        keep.append(answers)
    # vectors with many copies are few; their rows are spread over copies of the answer, all others meet by their key
    many = answers.where(F.col("weight") > block).drop("weight")
    rest = answers.where(F.col("weight") <= block).select("_k", "_l", F.col("n_links").alias("_n"), F.col("component_id").alias("_c"))
    first = salted(rows.withColumn("_ok", F.col("_vec").isNotNull()).drop("_vec"), many, ["_k", "_l"], "_id", many.count() <= FEW)
    # rows that have their answer get a key of their own, so that they stay spread
    done = F.col("n_links").isNotNull() | ~F.col("_ok")
    second = first.withColumns({"_k": F.when(done, F.col("_id")).otherwise(F.col("_k")), "_l": F.when(~done, F.col("_l"))})
    out = second.join(rest.hint("merge"), ["_k", "_l"], "left")
    return out.select(
        F.col("_id").alias(id_col),
        F.coalesce("n_links", "_n", F.lit(0)).alias("n_links"),
        F.when(F.col("_ok"), F.coalesce("component_id", "_c")).otherwise(F.col("_id")).alias("component_id"),
    )


def op11_embedding_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, component and whether it is kept, of every vector of embeddings."""
    made = near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.95)
    return made.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


OP11_SQL = """
WITH RECURSIVE v AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), sound AS (
    SELECT vec_id, e FROM v
    WHERE e IS NOT NULL AND len([x FOR x IN e IF x IS NULL OR isnan(x) OR isinf(x)]) = 0 AND len([x FOR x IN e IF x <> 0]) > 0
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_cosine_similarity(a.e, b.e) >= 0.95
), reach AS (
    SELECT a, b FROM links
    UNION
    SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), degree AS (
    SELECT a, count(*) AS n FROM links GROUP BY a
), least AS (
    SELECT a, min(b) AS b FROM reach GROUP BY a
)
SELECT v.vec_id, CAST(coalesce(degree.n, 0) AS BIGINT) AS n_links, least(v.vec_id, coalesce(least.b, v.vec_id)) AS component_id,
       v.vec_id = least(v.vec_id, coalesce(least.b, v.vec_id)) AS kept
FROM v LEFT JOIN degree ON degree.a = v.vec_id LEFT JOIN least ON least.a = v.vec_id
"""

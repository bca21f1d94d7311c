"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

A source's documents fall into blocks by a hash of their id, so a block is a random part of its source. Exact word
counts of the blocks (a bounded table) give each source its quota of blocks: whole passes over the source and a last
part that is cut where the target is met. A binary tree deals the quotas to the output shards: at each node the left
half of the shards draws its exact number of blocks from what the node holds, so no block is drawn twice in a pass.
Inside a shard the drawn rows are put in a hashed order.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pelagia.llm.common import WORD, save, table, text_or_empty

#: No source gives more than so many times its own words.
MOST = 3
#: Hash bits that order the documents of a block.
ORDER_BITS = 40
#: Columns of a mix's result besides those of its input; input columns of these names are replaced.
MADE = ("_size", "_source_size", "_target", "_shards", "_order")


def water_fill(sizes: Sequence[int], weights: Sequence[float], total: float, most: int = MOST) -> list[float]:
    """Targets that share `total` by weight, none above most times its size; what a capped one leaves is shared again."""
    targets, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(total)
    while open_:
        per = left / sum(weights[i] for i in open_)
        full = {i for i in open_ if weights[i] * per > most * sizes[i]}
        if not full:
            for i in open_:
                targets[i] = weights[i] * per
            break
        for i in full:
            targets[i] = float(most * sizes[i])
        left -= sum(targets[i] for i in full)
        open_ -= full
    return targets


def splitting_tree(quotas: Sequence[int], n_shards: int, seed: int) -> np.ndarray:
    """How many blocks of each source each shard draws: columns sum to equal numbers of blocks, rows to the quotas."""
    rng, out = np.random.default_rng(seed), np.zeros((len(quotas), n_shards), dtype=np.int64)

    def split(held: np.ndarray, lo: int, hi: int) -> None:
        if hi - lo == 1:
            out[:, lo] = held
            return
        mid, n = (lo + hi) // 2, int(held.sum())
        want, left = n * (mid - lo) // (hi - lo), np.zeros_like(held)
        rest = n
        for i, here in enumerate(held):  # the marginals of the multivariate law, one source after the other
            rest -= int(here)
            left[i] = rng.hypergeometric(int(here), rest, want) if here and want and rest else min(int(here), want) if not rest else 0
            want -= int(left[i])
        split(left, lo, mid)
        split(held - left, mid, hi)

    split(np.asarray(quotas, dtype=np.int64), 0, n_shards)
    return out


def _measured(df: DataFrame, source_col: str, id_col: str, text_col: str, size: F.Column, seed: int) -> DataFrame:
    mixed = F.when(F.col(id_col).isNull(), F.xxhash64(F.col(text_col), F.lit(seed + 1))).otherwise(F.xxhash64(F.col(id_col), F.lit(seed)))
    order = F.pmod(F.shiftright(mixed, 20), F.lit(1 << ORDER_BITS))
    names = [c for c in df.columns if c not in MADE]
    return df.select(F.struct(*names).alias("_row"), F.col(source_col).alias("_source"), size.alias("_size"), F.pmod(mixed, F.lit(1 << 20)).alias("_block_hash"), order.alias("_order"))


def plan(sized: DataFrame, n_shards: int, seed: int, weights: Sequence[float] | None, block_words: int, max_blocks: int) -> tuple[list[tuple], list[tuple]]:
    """(source, number of blocks, words, target) for each source, and (source, block, shards, cut, shard beyond it) for each block.

    The driver holds one row for each source and at most max_blocks + one for each source for the blocks."""
    spark = sized.sparkSession
    totals = sized.groupBy("_source").agg(F.sum("_size").alias("w"), F.count("*").alias("n")).collect()
    totals.sort(key=lambda r: (r["_source"] is None, r["_source"] or ""))
    sizes, all_words, all_rows = [r["w"] for r in totals], sum(r["w"] for r in totals), sum(r["n"] for r in totals)
    given = list(weights) if weights else [1.0 + i % 3 for i in range(len(totals))]
    targets = water_fill(sizes, given, all_words)
    words, rows = max(block_words, -(-all_words * 2 // max_blocks)), max(64, -(-all_rows * 2 // max_blocks))
    counts = [min(1 << 20, max(1, -(-r["w"] // words), -(-r["n"] // rows))) for r in totals]
    sources = [(r["_source"], c, r["w"], t) for r, c, t in zip(totals, counts, targets, strict=True)]
    if not sources:
        return [], []
    blocks: dict[int, dict[int, int]] = {i: {} for i in range(len(sources))}
    place = {s[0]: i for i, s in enumerate(sources)}
    for r in blocked(sized, sources_frame(spark, sources)).groupBy("_source", "_block").agg(F.sum("_size").alias("w")).collect():
        blocks[place[r["_source"]]][r["_block"]] = r["w"]
    passes, quotas, cuts = [], [], []
    for i, (_, _, size, target) in enumerate(sources):
        whole = int(target // size) if size else 0
        left, taken, partial, cut = (target - whole * size if size else 0.0), 0.0, [], None
        for b in sorted(blocks[i]):
            if left <= 0 or taken >= left:
                break
            partial.append(b)
            if taken + blocks[i][b] > left:
                cut = (b, left - taken)
            taken += blocks[i][b]
        passes.append((whole, partial))
        cuts.append(cut)
        quotas.append(whole * len(blocks[i]) + len(partial))
    at = _cut_orders(sized, sources, cuts)
    dealt, rng = splitting_tree(quotas, n_shards, seed), np.random.default_rng(seed + 1)
    out = []
    for i, (name, *_rest) in enumerate(sources):
        whole, partial = passes[i]
        draws = [b for _ in range(whole) for b in rng.permutation(sorted(blocks[i])).tolist()] + rng.permutation(partial).astype(int).tolist()
        to = np.repeat(np.arange(n_shards), dealt[i])
        shards: dict[int, list[int]] = {b: [] for b in blocks[i]}
        for b, k in zip(draws, to.tolist(), strict=True):
            shards[b].append(k)
        for b in sorted(blocks[i]):
            cut_here = cuts[i] is not None and cuts[i][0] == b
            out.append((name, b, shards[b][:-1] if cut_here else shards[b], at[i] if cut_here else None, shards[b][-1] if cut_here else None))
    return sources, out


def _cut_orders(sized: DataFrame, sources: list[tuple], cuts: list) -> dict[int, int]:
    """For each source's cut block, the order value up to which its documents are taken: the prefix nearest to the words wanted.

    Exact counts below evenly spaced order values, refined until an interval holds one value; no rows reach the driver."""
    spark = sized.sparkSession
    rows = {i: [0, (1 << ORDER_BITS) - 1, 0, float(c[1])] for i, c in enumerate(cuts) if c}
    held = blocked(sized, sources_frame(spark, sources))
    fine, ended = 1 << 10, {}
    while rows:
        asked = [(sources[i][0], cuts[i][0], i, lo, hi, max(1, -(-(hi - lo + 1) // fine))) for i, (lo, hi, _, _) in rows.items()]
        probe = spark.createDataFrame(asked, "_s string, _b long, _i int, _lo long, _hi long, _step long")
        on = F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_block") == F.col("_b")) & F.col("_order").between(F.col("_lo"), F.col("_hi"))
        got = held.join(F.broadcast(probe), on).groupBy("_i", F.expr("(_order - _lo) div _step").alias("_c")).agg(F.sum("_size").alias("w"), F.min("_order").alias("lo"), F.max("_order").alias("hi")).collect()
        for i in list(rows):
            before, want = rows[i][2], rows[i][3]
            last = rows[i][0] - 1
            for r in sorted((r for r in got if r["_i"] == i), key=lambda r: r["_c"]):
                if before + r["w"] <= want:
                    before, last = before + r["w"], r["hi"]
                    continue
                if r["lo"] == r["hi"]:
                    ended[i] = r["hi"] if 2 * (want - before) >= r["w"] else last
                else:
                    rows[i] = [r["lo"], r["hi"], before, want]
                break
            else:
                ended[i] = last
            if i in ended:
                del rows[i]
    return ended


def sources_frame(spark: SparkSession, sources: list[tuple]) -> DataFrame:
    return spark.createDataFrame([(s, n, w, t) for s, n, w, t in sources], "_s string, _n long, _source_size long, _target double")


def blocked(sized: DataFrame, sources: DataFrame) -> DataFrame:
    return sized.join(F.broadcast(sources), F.col("_source").eqNullSafe(F.col("_s"))).drop("_s").withColumn("_block", F.pmod(F.col("_block_hash"), F.col("_n")))


def mix(
    df: DataFrame,
    n_shards: int = 8,
    seed: int = 20,
    weights: Sequence[float] | None = None,
    source_col: str = "source",
    id_col: str = "doc_id",
    text_col: str = "text",
    block_words: int = 20_000,
    max_blocks: int = 65_536,
) -> DataFrame:
    """df with _size, _source_size, _target and _shards: the shards that draw the row, one entry for each time it is taken.

    Size is the number of words (null text: none). Sources come in code-point order, a null source last; weights repeat
    1, 2, 3 unless given. Targets share all words and stop at three times a source's words. A source's taken words miss
    its target by at most half of one id's words. Rows of one id are drawn together, and so are rows of one text that
    have no id. Reruns agree, whatever the partitions. An empty table gives an empty result. The number of sources is taken to fit the driver."""
    size = F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long")
    measured = _measured(df, source_col, id_col, text_col, size, seed)
    sized = save(measured.select("_source", "_size", "_block_hash", "_order"), "mix-sizes")
    sources, blocks = plan(sized, n_shards, seed, weights, block_words, max_blocks)
    spark = df.sparkSession
    drawn = spark.createDataFrame(blocks, "_s string, _b long, _whole array<int>, _cut long, _last int")
    on = F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_block") == F.col("_b"))
    out = blocked(measured, sources_frame(spark, sources)).join(F.broadcast(drawn), on)
    last = F.when(F.col("_last").isNotNull() & (F.col("_order") <= F.col("_cut")), F.array("_last")).otherwise(F.array().cast("array<int>"))
    return out.withColumn("_shards", F.concat("_whole", last)).select("_row.*", *MADE)


def drawn_rows(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix itself: a row for each time one is taken, shard after shard, each in a hashed local order."""
    rows = mixed.select(F.struct(*columns).alias("_row"), F.xxhash64("_order").alias("_mixed"), F.posexplode("_shards").alias("_pass", "_shard"))
    placed = rows.select("_row", "_shard", F.xxhash64("_mixed", "_pass").alias("_local")).repartitionByRange("_shard", "_local")
    return placed.sortWithinPartitions("_shard", "_local").select("_row.*")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the words that the mix takes of them."""
    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select(
        "doc_id",
        F.col("_size").alias("size"),
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        (F.col("_size") * F.size("_shards")).alias("taken"),
        F.col("_shards").alias("shards"),
    )

"""Benchmark decontamination: rare gapped n-gram seeds join passages to test items, Smith-Waterman alignment scores them.

A seed is four words in order, next to each other or with one word left out between two of them (GAPS). Its hash does
not tell which, so a seed outlives replaced, inserted and omitted words alike. A copy that keeps at least two words for
each edit has a number of an item's seeds that grows with the item's length (`least_seeds`), so that many of the item's
seeds need not be looked up: those that would meet the most passages are left out, and no such copy is lost.

A Bloom filter of fixed size finds the texts' seeds without a shuffle; what it lets through joins the rare seeds exactly.
Alignment is local and works on words, so insertions, deletions and replaced words only lower the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pelagia.llm.common import save, table
from pelagia.llm.rolling import chunks, spread_hashes, word_hashes

MATCH, MISMATCH, GAP = 2, -1, -1
#: Bits of the largest filter (16 MB); a larger benchmark only lets more seeds through to the exact join.
MOST_BITS = 1 << 27
#: Where a seed's four words stand from its first: every set of gaps of at most one word in all.
GAPS = ((0, 1, 2, 3), (0, 1, 3, 4), (0, 1, 2, 4), (0, 2, 3, 4))


def item_words(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """item and words (array of word hashes) of each test item; rows of one id stay apart."""

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = []
            for _, raws in chunks(b[text_col], lower=True):
                words, text = word_hashes(raws)
                at = np.searchsorted(text, np.arange(len(raws) + 1))
                made += [words[at[i] : at[i + 1]].view(np.int64) for i in range(len(raws))]
            yield pd.DataFrame({"item": b[item_col], "words": made})

    return benchmark.select(F.col(item_col).cast("long"), text_col).mapInPandas(hashed, "item long, words array<long>")


def seed_hashes(words: np.ndarray, text: np.ndarray) -> np.ndarray:
    """The hashes of the seeds that start at each word, a row for each of GAPS; zero where a seed would leave its text."""
    return np.stack([spread_hashes(words, text, places) for places in GAPS])


@lru_cache(maxsize=1)
def _bounds(most: int) -> np.ndarray:
    """[weight - 1, length]: the least of seeds - weight * (kept - 2 * edits) over all strings of kept and edited words."""
    masks = [sum(1 << (places[-1] - p) for p in places) for places in GAPS]
    out = np.zeros((4, most + 1), dtype=np.int64)
    for weight in range(1, 5):
        least = {0: 0}  # by the last five words as bits, edited ones before the first
        for length in range(1, most + 1):
            after: dict[int, int] = {}
            for last, value in least.items():
                for kept in (0, 1):
                    bits = (last << 1 | kept) & 31
                    new = value + sum(bits & mask == mask for mask in masks) - weight * (1 if kept else -2)
                    after[bits] = min(after.get(bits, new), new)
            least = after
            out[weight - 1, length] = min(least.values())
    return out


def least_seeds(length: int, most: int = 300) -> int:
    """A number of seeds that every copy of an item of so many words has, if it keeps two words for each edit or more.

    Such a copy is a string of kept and edited words, at least as long as the item. Where kept - 2 * edits is not negative,
    seeds - weight * (kept - 2 * edits) is no more than the number of seeds, so its minimum over all strings is a bound
    from below, whatever the weight. A longer string's minimum is at least the sum of those of its parts, so lengths up to
    twice the item's decide, and the bound for `most` words stands for longer items."""
    n = min(length, most)
    return int(max(0, _bounds(2 * most)[:, n : 2 * n].min(axis=1, initial=1 << 30).max())) if n else 0


def item_seeds(items: DataFrame) -> DataFrame:
    """hash, item, slots (how often the seed is in the item), spare (slots of the item that need not be looked up)."""

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for item, words in zip(b["item"], b["words"], strict=True):
                words = np.asarray(words, dtype=np.int64).view(np.uint64)
                hashes = seed_hashes(words, np.zeros(len(words), dtype=np.int64))
                seeds, slots = np.unique(hashes[hashes != 0], return_counts=True)
                yield pd.DataFrame({"hash": seeds.view(np.int64), "item": item, "slots": slots, "spare": max(0, least_seeds(len(words)) - 1)})

    return items.mapInPandas(made, "hash long, item long, slots int, spare int")


def rare_seeds(seeds: DataFrame, hits: DataFrame) -> DataFrame:
    """hash and item of the seeds that find all copies: of each item, those that would meet most go, as many as it can spare.

    What a seed meets is the number of passages times the number of items that hold it."""
    texts, items = hits.groupBy("hash").agg(F.count("*").alias("n_texts")), seeds.groupBy("hash").agg(F.count("*").alias("n_items"))
    met = seeds.join(texts, "hash").join(items, "hash").withColumn("meets", F.col("n_texts") * F.col("n_items"))
    most_first = Window.partitionBy("item").orderBy(F.col("meets").desc(), "hash").rowsBetween(Window.unboundedPreceding, 0)
    return met.withColumn("passed", F.sum("slots").over(most_first)).where("passed > spare").select("hash", "item")


def _filter(seeds: DataFrame) -> tuple[bytes, int]:
    """A Bloom filter of the seeds' hashes, of 64 bits for each but never over MOST_BITS; its words are put together by Spark."""
    n = seeds.select("hash").distinct().count()
    bits = min(MOST_BITS, 1 << max(16, (64 * max(1, n) - 1).bit_length()))
    both = F.explode(F.array(F.col("hash").bitwiseAND(bits - 1), F.shiftrightunsigned("hash", 32).bitwiseAND(bits - 1)))
    words = seeds.select(both.alias("at")).selectExpr("shiftright(at, 5) AS w", "shiftleft(1L, CAST(at & 31 AS INT)) AS b")
    out = np.zeros(bits // 32, dtype=np.uint32)
    for part in words.groupBy("w").agg(F.bit_or("b").alias("b")).toLocalIterator():
        out[part["w"]] = part["b"]
    return out.tobytes(), bits


def _passes(grams: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    """Which hashes the filter lets through; the second bit is looked up only where the first is set."""
    mask = np.uint64(len(bitmap) * 32 - 1)

    def is_set(at: np.ndarray) -> np.ndarray:
        return (bitmap[(at >> np.uint64(5)).astype(np.int64)] >> (at & np.uint64(31)).astype(np.uint32)) & 1 == 1

    out = is_set(grams & mask) & (grams != 0)
    out[out] = is_set((grams[out] >> np.uint64(32)) & mask)
    return out


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """(score, end in the item, end in the passage) of the best local alignment by Smith-Waterman; ends are exclusive."""
    n = len(passage)
    before, gaps = np.zeros(n + 1, dtype=np.int64), GAP * np.arange(n + 1)
    best = (0, 0, 0)
    for i, w in enumerate(item):
        row = np.zeros(n + 1, dtype=np.int64)
        row[1:] = np.maximum(0, np.maximum(before[:-1] + np.where(passage == w, MATCH, MISMATCH), before[1:] + GAP))
        row = np.maximum.accumulate(row - gaps) + gaps
        j = int(np.argmax(row))
        if row[j] > best[0]:
            best = (int(row[j]), i + 1, j)
        before = row
    return best


def aligned_span(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int, int, int]:
    """(score, start and end in the item, start and end in the passage) of the best local alignment."""
    score, i, j = align(item, passage)
    if not score:
        return 0, 0, 0, 0, 0
    _, a, b = align(item[:i][::-1], passage[:j][::-1])
    return score, i - a, i, j - b, j


def passages(docs: DataFrame, seeds: DataFrame, reach: int, id_col: str, text_col: str) -> DataFrame:
    """id, start, words, hashes: each stretch of `reach` words around seeds that the filter lets through, with these seeds."""
    bits, _ = _filter(seeds)

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bitmap = np.frombuffer(bits, dtype=np.uint32)
        for b in batches:
            rows = []
            for first, raws in chunks(b[text_col], lower=True):
                words, text = word_hashes(raws)
                grams = seed_hashes(words, text)
                passed = _passes(grams, bitmap)
                hit = np.flatnonzero(passed.any(axis=0))
                if not len(hit):
                    continue
                lo_text, hi_text = np.searchsorted(text, text[hit]), np.searchsorted(text, text[hit], side="right")
                cut = np.flatnonzero((text[hit][1:] != text[hit][:-1]) | (np.diff(hit) > 2 * reach)) + 1
                for part in np.split(np.arange(len(hit)), cut):
                    i, j = part[0], part[-1]
                    lo, hi = max(lo_text[i], hit[i] - reach), min(hi_text[j], hit[j] + reach)
                    hashes = np.unique(grams[:, hit[part]][passed[:, hit[part]]])
                    rows.append((b[id_col].iat[first + int(text[hit[i]])], int(lo - lo_text[i]), words[lo:hi].view(np.int64), hashes.view(np.int64)))
            if rows:
                yield pd.DataFrame(rows, columns=["id", "start", "words", "hashes"])

    return docs.select(F.col(id_col).cast("long").alias(id_col), text_col).mapInPandas(found, "id long, start int, words array<long>, hashes array<long>")


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    least: float = 0.5,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """id_col, item_col, score, matched, start, end: the best passage for each document and test item that scores `least`.

    score: the alignment's share of the item's highest score, from 0 to 1; start and end count words. Every copy is found
    that scores `least` and keeps at least two words of the item for each word replaced, inserted or left out, whatever the
    other documents hold, if the item has 19 words or more; shorter items, or copies with more edits, are found where a rare
    seed is left. Items of under four words and empty texts have no seeds; null ids are no matches; rows of one id are read
    as one document; ties go to the first passage. Very long texts give a passage for each stretch with seeds; an empty table of
    documents or items gives an empty result. Other columns, whatever their names, are not read."""
    items = save(item_words(benchmark, item_col, item_text_col).where("item is not null"), "items")
    seeds = save(item_seeds(items).groupBy("hash", "item").agg(F.max("slots").alias("slots"), F.min("spare").alias("spare")), "seeds")
    reach = items.agg(F.coalesce(F.max(F.size("words")), F.lit(0))).first()[0]
    found = save(passages(docs, seeds, reach + reach // 2 + GAPS[-1][-1] + 1, id_col, text_col).where("id is not null"), "passages")
    hits = found.select("id", "start", F.explode("hashes").alias("hash"))
    pairs = hits.join(rare_seeds(seeds, hits), "hash").select("id", "start", "item").distinct()
    targets = items.select("item", F.col("words").alias("item_words"), F.size("words").alias("size"), F.size(F.array_distinct("words")).alias("n_distinct"))
    joined = pairs.join(found.select("id", "start", "words"), ["id", "start"]).join(targets, "item")
    shared = F.size(F.array_intersect("item_words", "words"))  # each word that is not shared is a place without a MATCH
    joined = joined.where(F.col("size") - (F.col("n_distinct") - shared) >= least * F.col("size"))

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for id_, start, item, words, target in zip(b["id"], b["start"], b["item"], b["words"], b["item_words"], strict=True):
                if np.isin(target, words).sum() < least * len(target):  # MATCH for each would not reach the score
                    continue
                score, i0, i1, j0, j1 = aligned_span(np.asarray(target), np.asarray(words))
                rows.append((id_, item, score / (MATCH * len(target)), i1 - i0, start + j0, start + j1))
            if rows:
                yield pd.DataFrame(rows, columns=["id", "item", "score", "matched", "start", "end"])

    made = joined.select("id", "start", "item", "words", "item_words").mapInPandas(scored, "id long, item long, score double, matched int, start int, end int")
    best = made.where(F.col("score") >= least).groupBy("id", "item").agg(F.max(F.struct("score", "matched", (-F.col("start")).alias("s"), "end")).alias("x"))
    return best.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "x.score", "x.matched", (-F.col("x.s")).alias("start"), "x.end")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a copy of a test item, exact or edited, with the item, the score and the place in words."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))

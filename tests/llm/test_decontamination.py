"""Seeds of edited copies, their bound, and the answers of a plain alignment of all pairs."""

from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pelagia.llm import decontamination
from pelagia.llm.decontamination import GAPS, contaminated, least_seeds


def fewest_seeds(length: int) -> int:
    """The least number of seeds of a string of that length with two kept words for each edit, by all counts of kept words."""
    held = {((), 0): 0}
    for _ in range(length):
        after = {}
        for (tail, kept), n in held.items():
            for k in (0, 1):
                string = (*tail, k)
                more = sum(all(string[len(string) - 1 - places[-1] + p] for p in places) for places in GAPS if len(string) > places[-1])
                key = (string[-4:], kept + k)
                after[key] = min(after.get(key, 1 << 30), n + more)
        held = after
    return min(n for (_, kept), n in held.items() if kept >= 2 * (length - kept))


def test_the_bound_on_seeds_is_one():
    exact = {n: fewest_seeds(n) for n in range(1, 70)}
    assert all(exact[n] >= 1 for n in range(19, 70))
    for n in range(1, 47):
        assert least_seeds(n) <= min(exact[m] for m in range(n, n * 3 // 2 + 1))
    assert least_seeds(40) >= 3 and least_seeds(5000) == least_seeds(300) > 40


def edited(words: list[str], every: int, how: str, at: int) -> list[str]:
    out = []
    for i, w in enumerate(words):
        hit = i % every == at
        if how == "inserted":
            out += [w, f"extra{i}"] if hit else [w]
        elif not (hit and how == "left out"):
            out.append(f"other{i}" if hit else w)
    return out


@pytest.mark.parametrize("every", [3, 4, 5])
def test_copies_with_many_edits_are_all_found(spark, every):
    rng = np.random.default_rng(every)
    items = [[f"w{x}" for x in rng.integers(0, 300, 24 + 3 * (i % 7))] for i in range(50)]
    docs = []
    for i, item in enumerate(items):
        for k, how in enumerate(("replaced", "inserted", "left out")):
            docs.append((10 * i + k, f"some words before {' '.join(edited(item, every, how, i % every))} and some after"))
    found = contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string"))
    got = {(r["doc_id"], r["item_id"]) for r in found.collect()}
    assert got == {(10 * i + k, i) for i in range(50) for k in range(3)}


@pytest.mark.parametrize("phrase, share", [("which of the following", 0.001), ("which of the following is", 0.61)])
def test_phrases_of_all_items_lose_no_copy(spark, phrase, share):
    """Of the seeds that all items and documents share, as many as can be spared are not looked up."""
    rng = np.random.default_rng(9)
    items = [phrase + " " + " ".join(f"u{x}" for x in rng.integers(0, 10**6, 35)) for _ in range(200)]
    docs = [f"d{i} asks {phrase} so{i} and {' '.join(f'v{x}' for x in rng.integers(0, 10**6, 30))}" for i in range(2000)]
    docs[77] += " " + items[5]
    made = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert [(r["doc_id"], r["item_id"], r["score"]) for r in contaminated(made, bench).collect()] == [(77, 5, 1.0)]
    words = decontamination.item_words(bench, "item_id", "text")
    seeds = decontamination.item_seeds(words)
    hits = decontamination.passages(made, seeds, 60, "doc_id", "text").select("id", "start", F.explode("hashes").alias("hash"))
    assert hits.join(decontamination.rare_seeds(seeds, hits), "hash").count() < share * hits.join(seeds, "hash").count()


def plain_score(item: list[str], text: list[str]) -> float:
    """The share of an item's highest score that the best local alignment with a whole text reaches, cell by cell of a column."""
    known = {w: i for i, w in enumerate(dict.fromkeys(item))}
    b = np.array([known.get(w, -1) for w in text], dtype=np.int64)
    column, best = np.zeros(len(item) + 1, dtype=np.int64), 0
    a = np.array([known[w] for w in item])
    for x in b:
        diagonal = column[:-1] + np.where(a == x, 2, -1)
        column = np.r_[0, np.maximum(0, np.maximum(diagonal, column[1:] - 1))]
        best = max(best, int((column := np.maximum.accumulate(column + np.arange(len(column))) - np.arange(len(column))).max()))
    return best / (2 * len(item))


def test_answers_equal_the_alignment_of_all_pairs(spark, sf):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in contaminated(docs, items).collect()}
    tokens = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower())
    bench = [(r["item_id"], tokens(r["text"])) for r in items.collect()]
    expected = {}
    for r in docs.collect():
        text = tokens(r["text"])
        held = set(text)
        for item, words in bench:
            if words and sum(w in held for w in words) * 2 >= len(words) and (score := plain_score(words, text)) >= 0.5:
                expected[r["doc_id"], item] = max(score, expected.get((r["doc_id"], item), 0))
    assert expected and got.keys() == expected.keys()
    assert all(abs(got[k] - v) < 1e-12 for k, v in expected.items())


def test_columns_with_clashing_names(spark):
    item = " ".join(f"item{i}" for i in range(20))
    docs = spark.createDataFrame([(1, item), (1, item), (None, item), (2, None), (3, "x " * 300_000 + item)], "doc_id long, text string")
    docs = docs.select("*", *(F.lit("x").alias(c) for c in ("id", "start", "words", "hashes", "hash", "item", "item_words", "score")))
    bench = spark.createDataFrame([(7, item), (None, item)], "item_id long, text string").withColumn("words", F.lit(1)).withColumn("slots", F.lit(2))
    got = {(r["doc_id"], r["item_id"], r["start"]) for r in contaminated(docs, bench).collect()}
    assert got == {(1, 7, 0), (3, 7, 300_000)}

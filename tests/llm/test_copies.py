"""Large groups of copies are one entry of the searches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from pelagia.llm import neighbours, similar


def test_copies_of_a_vector_are_searched_for_once(spark, monkeypatch):
    x = np.random.default_rng(3).normal(size=(400, 8))
    x[100:] = x[100]  # 300 copies, whose ids are 1000 to 1299
    ids = np.concatenate([np.arange(100), np.arange(1000, 1300)])
    compare, rows = neighbours._compared, []

    def counted(near, d, k):
        made = compare(near, d, k)
        rows.append(made.count())
        return made

    monkeypatch.setattr(neighbours, "_compared", counted)
    got = neighbours.search(spark.createDataFrame(pd.DataFrame({"vec_id": ids, "embedding": x.tolist()})), F.col("id") % 10 == 0, k=5, size=32).orderBy("query_id", "rank").collect()
    found = {q: [r.vec_id for r in got if r.query_id == q] for q in ids[ids % 10 == 0].tolist()}
    assert all(len(v) == 5 for v in found.values()) and len(got) == 40 * 5
    assert all(v == [n for n in range(1000, 1006) if n != q][:5] for q, v in found.items() if q >= 1000)
    assert rows and sum(rows) <= 11 * 6 * 4 * 6  # 11 different queries, 6 of each of at most 4 windows, 6 curves


def test_frequent_shingles_come_without_a_sort_on_the_driver(spark):
    texts = [(k, " ".join([f"w{m}" for m in range(60)] + [f"x{k // 2}-{m}" for m in range(200)])) for k in range(40)]
    rows = spark.createDataFrame(texts, "id long, text string").withColumn("key", F.md5("text"))
    token, n = similar.hot_shingles(rows, 40, 5, 1000, 10_000)
    assert len(token) == 56 + 20 * 200 and (np.diff(token.astype(object)) > 0).all() and (n == 40).sum() == 56 and n.min() == 2
    some, m = similar.hot_shingles(rows, 40, 5, 1000, 1000)
    assert 850 < len(some) < 1150 and (m == 40).sum() == 56 and set(some.tolist()) <= set(token.tolist())
    few, _ = similar.hot_shingles(rows, 40, 5, 1000, 50)
    assert 20 < len(few) < 56
    none, _ = similar.hot_shingles(rows.limit(0), 0, 5, 1000, 50)
    assert len(none) == 0


def test_rows_of_a_search_do_not_grow_with_the_windows(spark, monkeypatch):
    """Vectors without structure, which need most windows of the table: a query gives a few rows for each of its pieces."""
    compare, rows = neighbours._compared, []

    def counted(near, d, k):
        made = compare(near, d, k)
        rows.append(made.count())
        return made

    monkeypatch.setattr(neighbours, "_compared", counted)
    x = np.random.default_rng(4).normal(size=(1200, 24))
    got = neighbours.search(spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(1200), "embedding": x.tolist()})), F.col("id") % 50 == 0, k=5, size=16, curves=1)
    assert got.count() == 24 * 5
    assert sum(rows) <= 24 * 6 * 8  # 24 queries, 6 of each of 8 pieces; before, 6 of each of up to 75 windows


def test_texts_with_a_common_passage_only_do_not_meet(spark, monkeypatch):
    """A frequent passage that the sample of frequent shingles has not seen: it is too short for a link."""
    meet, rows = similar.met, []

    def counted(*args):
        made = meet(*args)
        rows.append(made.count())
        return made

    monkeypatch.setattr(similar, "met", counted)
    common, texts = " ".join(f"c{m}" for m in range(10)), {}
    for k in range(60):
        own = [f"x{k}-{m}" for m in range(150)]
        texts[2 * k] = " ".join([*own, common])
        own[30 + k % 5] = "changed"
        texts[2 * k + 1] = " ".join([common, *own])
    found = similar.groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), sample=1).collect()
    assert {r["doc_id"]: r["group"] for r in found} == {i: i - i % 2 for i in texts}
    assert sum(rows) == 0


def test_bitmaps_lose_no_pair():
    """Sets of exactly 0.8 meet whatever bits their bitmaps hold, the sign included; sets of a half do not."""
    rng = np.random.default_rng(8)
    for _ in range(50):
        a = rng.integers(0, 1 << 63, 180, dtype=np.uint64) * np.uint64(2)
        for shared, others, want in ((160, 20, 1), (120, 60, 0)):
            b = np.concatenate([a[:shared], rng.integers(0, 1 << 63, others, dtype=np.uint64)])
            rows = pd.DataFrame({"token": 1, "node": [1, 2], "size": 180, "pos": 0, "comp": [1, 2], "n": 2, "r": [1, 2], "bits": similar.bitmaps([a, b])})
            assert sum(len(m) for m in similar.meetings(iter([rows]), 0.8, 24, 8)) == want

"""Embedding near-duplicates, the audit of filter orders and spelling variants, against brute force and SQL."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import brute_later
from pelagia.llm import embedding_duplicates, filter_audit, spelling
from pelagia.llm.queries import ORACLES, QUERIES

CLASHES = ("node", "weight", "ball", "bucket", "cell", "block", "t", "n", "mask", "part", "_fp", "_id", "_k", "word", "root", "step")


def clashing(df):
    return df.select("*", *(F.lit("x").alias(c) for c in CLASHES))


@pytest.mark.parametrize("name", ["op11_embedding_duplicates", "op12_filter_audit"])
def test_queries_equal_their_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, want = QUERIES[name](spark, sf), con.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())


def vectors(seed: int) -> list[tuple]:
    """Tight and wide groups, copies, scaled copies, vectors of another length, and all that takes no part."""
    rng = np.random.default_rng(seed)
    unit = lambda x: x / np.linalg.norm(x)
    made = []
    for size, noise in ((60, 0.05), (40, 0.2), (25, 0.28), (5, 0.01)):
        centre = unit(rng.standard_normal(16))
        made += [unit(centre + noise * unit(rng.standard_normal(16))) for _ in range(size)]
    made += [unit(rng.standard_normal(16)) for _ in range(60)]
    made += [made[0]] * 30 + [made[3] * 1e-3, made[3] * 7.0, -made[3]]
    made += [unit(rng.standard_normal(3)) for _ in range(10)]
    rows = [(i, [float(v) for v in x]) for i, x in enumerate(np.array(made, dtype=object)[rng.permutation(len(made))])]
    rows += [(1000, None), (1001, []), (1002, [0.0] * 16), (1003, [float("nan")] + [1.0] * 15), (1004, [None] + [1.0] * 15), (1005, [float("inf")] + [1.0] * 15)]
    rows += [(None, rows[0][1]), (None, None), (7, rows[7][1]), (7, rows[8][1]), (1006, [-0.0, 0.0, 1.0]), (1007, [0.0, 0.0, 1.0])]
    return rows


@pytest.mark.parametrize(("kind", "block", "bucket"), [("double", 2048, 128), ("double", 7, 500), ("float", 20, 40)])
def test_near_vectors_equal_brute_force(spark, kind, block, bucket):
    rows = vectors(3)
    if kind == "float":
        rows = [(i, v and [x if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    df = clashing(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>"))
    got = embedding_duplicates.near_vectors(df, 0.95, block=block, bucket=bucket, rows_at_once=300)
    key = lambda r: tuple((v is None, v or 0) for v in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute_later.near_vectors(rows, 0.95), key=key)


def test_near_vectors_of_an_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embedding_duplicates.near_vectors(df).collect() == []


def test_tables_that_grow_with_the_vectors_are_not_broadcast(spark, monkeypatch):
    """A table that is small as a file passes through the driver only where it is known to have few rows."""
    small = spark.range(1000).selectExpr("id AS root", "id AS least")
    plan = lambda few: embedding_duplicates.salted(spark.range(100).selectExpr("id AS root"), small, ["root"], "root", few)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan(False) and "Generate explode" not in plan(True)
    written, save = [], embedding_duplicates.save
    monkeypatch.setattr(embedding_duplicates, "save", lambda df, name: written.append((name, df._jdf.queryExecution().executedPlan().toString())) or save(df, name))
    monkeypatch.setattr(embedding_duplicates, "FEW", 0)
    rows = vectors(5)
    got = embedding_duplicates.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 0.95, block=7, bucket=500)
    key = lambda r: tuple((v is None, v or 0) for v in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute_later.near_vectors(rows, 0.95), key=key)
    assert {"vector-told", "vector-answers", "vector-balled"} <= {name for name, _ in written} and not [name for name, text in written if "Broadcast" in text]


def test_tables_meet_pairs_at_the_threshold():
    for bits in (3, 9, 20):
        meet = (1 - np.arccos(0.95) / np.pi) ** bits
        assert (1 - meet) ** embedding_duplicates.table_count(bits, 0.95, 1e-6) <= 1e-6


def documents() -> list[tuple]:
    rng = np.random.default_rng(5)
    names = ["alpha", "Beta", "GAMMA", "delta#", "eps|ilon", "zeta"]
    texts = [" ".join(rng.choice(names[: 1 + k % 6], size=int(rng.integers(1, 160)))) for k in range(30)]
    texts += [" ".join(f"w{i}" for i in range(int(n))) for n in (99, 100, 125, 300)] + ["   " * 60, "A" * 300_000, " ".join(f"x{i}" for i in range(50_000))]
    rows = [(int(i), texts[int(rng.integers(len(texts)))], [None, "", "en", "fr"][i % 4]) for i in range(150)]
    rows += [(500 + i, "copied text", "en") for i in range(80)] + [(500, "copied text", "en"), (500, "another", "en")]
    return rows + [(None, "copied text", "en"), (None, None, None), (1, None, "de"), (2, "", "de"), (0, "copied text", "it"), (None, "only without", "en"), (9, "only without", "en")]


def test_audit_equals_running_every_order(spark):
    docs = documents()
    labels = [(i, i % 3 == 0, None if i % 5 == 0 else i % 2) for i in range(0, 600, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (9999, 1, 1)]
    labels = [(i, int(q), x) for i, q, x in labels]
    got = filter_audit.audit(
        clashing(spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(5)), clashing(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    )
    rows = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got.collect()}
    assert rows == brute_later.audit(docs, labels)


def test_copies_are_found_across_many_tasks(spark):
    """One text over most tasks, and ids that repeat: only rows with a smaller id of the same text are copies."""
    rows = [(i // 2, "hot" if i % 3 else f"text {i % 50}", "en") for i in range(2000)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        got = filter_audit.failure_masks(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    least = {}
    for i, t, _ in rows:
        least[t] = min(i, least.get(t, i))
    want = sorted((i, 16 if least[t] < i else 0) for i, t, _ in rows)
    assert sorted((r.doc_id, r.mask & 16) for r in got) == want


def test_audit_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(none, labels).collect() == []
    one = filter_audit.audit(spark.createDataFrame([(1, "x", "en")], none.schema), labels)
    assert one.count() == 600 and one.where("good_lost + toxic_lost > 0").count() == 0


def spelled() -> list[tuple]:
    rng = np.random.default_rng(11)
    base = ["paper", "papers", "papeér", "water", "wate", "winter", "printer", "sprinter", "aaaaa", "aaaaaa", "aaaaaaa", "àáâãä", "under", "thunder", "letters", "lettres"]
    words = list(base)
    for w in base:
        for _ in range(12):
            k, c = int(rng.integers(len(w) + 1)), chr(int(rng.choice([97, 98, 101, 0xE9, 0xFF, 0xD7])))
            words.append((w[:k] + c + w[k:], w[:k] + c + w[k + 1 :], w[:k] + w[k + 1 :], w.upper())[int(rng.integers(4))])
    docs = [(i, " ".join(rng.choice(words, size=80)) + "-Straße7Wasser_Ābcdef") for i in range(40)]
    return docs + [(None, "paper " * 300), (3, None), (4, ""), (5, "paper water"), (5, "paper water"), (6, "letters" * 40_000), (7, "winter " * 30_000)]


@pytest.mark.parametrize("most", [50_000, 4])
def test_spelling_variants_equal_brute_force(spark, monkeypatch, most):
    docs = spelled()
    pairs = spelling.near_pairs
    monkeypatch.setattr(spelling, "near_pairs", lambda words: pairs(words, most=most))
    got = spelling.variants(clashing(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)))
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got.collect()} == brute_later.spelling(docs)
    assert got.dtypes == [("word", "string"), ("form", "string"), ("root", "string"), ("n", "bigint"), ("n_near", "bigint"), ("form_n", "bigint")]


def test_spelling_query_equals_brute_force(spark, sf):
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in QUERIES["op13_spelling_variants"](spark, sf).collect()}
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got == brute_later.spelling(docs)


def test_spelling_of_an_empty_table(spark):
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_automaton_numbers_words_without_gaps_and_is_minimal():
    words = sorted({"".join(p) for p in __import__("itertools").product("abc", repeat=4)} | {"abcab", "x", "abcax"})
    a = spelling.Automaton()
    for w in words:
        a.add(w)
    a.done()
    for k, w in enumerate(words):
        state, number = a.walk(0, w, 0)
        assert a.final[state] and number == k
    # all words of three letters in four places share their endings
    assert len(a.next) < 25

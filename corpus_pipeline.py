"""The corpus pipeline: toxicity, near-duplicates, benchmark decontamination, mixing, sharding.

Each stage reads what its predecessor has written and returns the rows that go on, so a lost executor costs one stage's
tasks. All stages but the last return the columns of `documents`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pelagia.llm.common import save, scratch, table, text_key, text_or_empty
from pelagia.llm.decontamination import contaminated
from pelagia.llm.mixing import drawn_rows, mix
from pelagia.llm.sharding import shard
from pelagia.llm.similar import groups
from pelagia.llm.toxicity import fit, with_features

#: Documents of this score or more are rejected.
TOXIC = 0.7


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it learns from the labelled rows that are not held out.

    Null and empty texts score like texts without a hit and stay; repeated rows are judged alike; ids are not needed; an
    empty table gives an empty result; further columns stay, those with names that scoring uses too."""
    model = fit(docs, table(spark, sf_dir, "labels"))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("text").alias("_text"))
    return model.score(with_features(rows, model.lexicon, "_text")).where(F.col("score") < TOXIC).select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of texts with a similarity of 0.8 or more on 5-word shingles.

    Rows that repeat a document's id and text go as well. Rows without an id stay only where no row with one is alike;
    null texts count as empty ones. An empty table gives an empty result; columns that documents has besides stay."""
    key = F.md5(F.coalesce(F.col("text"), F.lit("")))
    with scratch(spark) as keep:
        kept = save(groups(docs).where("first").select(F.struct("text_key", F.col("doc_id").alias("id")).alias("_kept")).distinct(), "kept")
        keep.append(kept)
    own = F.struct(key.alias("text_key"), F.col("doc_id").cast("long").alias("id"))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), own.alias("_own"))
    once = rows.join(kept, F.col("_own") == F.col("_kept"), "left_semi").groupBy("_own").agg(F.first("_row").alias("_row"))
    return once.select("_row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a copy, exact or edited, of a test item.

    Rows of one id go together; a row without an id is judged by its text alone. Null and empty texts stay; an empty
    table, of documents or of items, removes nothing; further columns stay, whatever their names."""
    own = F.coalesce(F.col("doc_id").cast("long"), -1 - text_key(text_or_empty()))
    with scratch(spark) as keep:
        found = save(contaminated(docs.select(own.alias("_own"), "text"), table(spark, sf_dir, "benchmark"), id_col="_own").select("_own").distinct(), "contaminated")
        keep.append(found)
    return docs.select(F.struct(*docs.columns).alias("_row"), own.alias("_own")).join(found, "_own", "left_anti").select("_row.*")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it, so rows are repeated and dropped.

    A null text has no words and a null source is a source; rows without an id are drawn by their text; an empty table
    gives an empty result; further columns stay."""
    return drawn_rows(mix(docs), docs.columns)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their size in bytes, their shard and their slot in it.

    A null text has no bytes, a null id sorts first, repeated rows get a slot each, an empty table gives an empty result;
    columns named size, shard or slot are replaced, others stay."""
    return shard(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: The classifier, the fingerprints and the alignment are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

"""How filters interact: what each removes in every order, from one pass over the texts.

Rows are range-sorted by (fingerprint of the text, doc_id), within a task by (fingerprint, text, doc_id), and compared
with their predecessors, so copies are found by their full texts. A text that goes on past the end of a task is told
by a small table of the tasks' last texts, against which the rows of each task's first fingerprint are held. Every row
ends as a mask of the filters that it fails; masks are counted by part, and all orders follow from these counts.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pelagia.llm.common import save, scratch, shuffle_partitions, table, text_or_empty

#: Each filter is a bit of a mask, in this order.
FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
MARKS = re.compile(r"[#$%&*|]")
#: A task's rows are written with their mask; boundary holds the digest of a text of the task's first fingerprint.
MASKED = "_id long, part string, mask int, task int, boundary binary, last boolean"


def failures(text: str) -> int:
    """The bits of the filters A to D that a text fails."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes are split at the six ASCII white-space characters
    capitals = len(raw) - len(raw.translate(None, CAPITALS))
    fails = (len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * capitals > 10 * len(text), MARKS.search(text) is not None)
    return sum(1 << i for i, failed in enumerate(fails) if failed)


def _masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one task, ordered by (fingerprint, text, id), with their masks.

    Bit E is set where a row of this task has the same text and a smaller id. The rows of the first fingerprint carry a
    digest of their text, and one row more for each text of the last fingerprint says that the task ends with it."""
    task = TaskContext.get().partitionId()
    first, fp, text, least, bits, digest, ending = None, None, None, None, 0, None, {}
    for b in batches:
        out = []
        for k, t, i, part in zip(*(b.column(c).to_pylist() for c in ("_fp", "_text", "_id", "part")), strict=True):
            first = k if first is None else first
            if k != fp:
                fp, text, ending = k, None, {}
            if t != text:
                text, least, bits = t, i, failures(t)
                digest = hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest()
                if i is not None:
                    ending[digest] = True
            copy = i is not None and least is not None and least < i
            out.append((i, part, bits | COPY * copy, task, digest if k == first and i is not None else None, False))
        if out:
            yield _batch(out)
    if ending:
        yield _batch([(None, None, 0, task, d, True) for d in ending])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.bool_())
    columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=["_id", "part", "mask", "task", "boundary", "last"])


def failure_masks(docs: DataFrame) -> DataFrame:
    """doc_id, part (the language, empty if null) and mask, the bits of the filters A to E that the text fails.

    A null text counts as empty. Rows without an id are no copies and make none; rows that repeat an id and its text are
    no copies of each other, since neither id is smaller. An empty table gives an empty result; other columns are not
    read. Texts stream through the tasks in batches of bounded bytes, however long a group of copies is."""
    spark = docs.sparkSession
    named = docs.select(F.col("doc_id").cast("long").alias("_id"), text_or_empty().alias("_text"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"))
    keyed = named.withColumn("_fp", F.xxhash64("_text"))
    dealt = keyed.repartitionByRange(shuffle_partitions(spark), F.col("_fp"), F.col("_id").asc_nulls_last())
    ordered = dealt.sortWithinPartitions(F.col("_fp"), F.col("_text"), F.col("_id").asc_nulls_last())
    made = save(ordered.select("_fp", "_text", "_id", "part").mapInArrow(_masked, MASKED), "filter-masks")
    # one row a task, or more only where different texts share a 64-bit fingerprint
    ends = made.where("last").groupBy("boundary").agg(F.min("task").alias("_first"))
    rows = made.where("not last")
    # by-range exchange: rows of one text in an earlier task have smaller ids, as equal (fingerprint, id) stay together
    starts = rows.where("boundary is not null").select("task", "boundary").distinct().join(ends, "boundary").where("_first < task")
    told = starts.select("task", "boundary", F.lit(True).alias("_told"))
    copy = F.when(F.col("_told"), F.col("mask").bitwiseOR(F.lit(COPY))).otherwise(F.col("mask"))
    return rows.join(told, ["task", "boundary"], "left").select(F.col("_id").alias("doc_id"), "part", copy.cast("int").alias("mask"))


def mask_counts(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask and the number of documents n, of those labelled good and of those labelled toxic.

    An id with several labels counts once for each mark that one of them gives; labels without an id mark nothing."""
    marked = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")
    )
    # equal rows are counted before they meet labels, so an id that most rows repeat is a few rows there
    counted = masks.groupBy("doc_id", "part", "mask").agg(F.count("*").alias("n")).join(marked, "doc_id", "left")
    number = lambda c: F.coalesce(F.sum(F.when(F.col(c), F.col("n"))), F.lit(0)).alias(c)
    return counted.groupBy("part", "mask").agg(F.sum("n").alias("n"), number("good"), number("toxic"))


def interactions(counts: DataFrame) -> DataFrame:
    """The counters of every part, order of the filters and step, from counts of masks: at most 32 rows a part."""
    orders = ["".join(p) for p in itertools.permutations(FILTERS)]
    rows = counts.withColumn("filter_order", F.explode(F.lit(orders))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    place = {f: F.instr("filter_order", f) for f in FILTERS}
    bits = lambda when: sum((F.when(when(place[f]), F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(FILTERS)), F.lit(0))
    rows = rows.withColumns({"own": bits(lambda at: at == F.col("step")), "before": bits(lambda at: at < F.col("step"))})
    rows = rows.withColumns({"fails": F.col("mask").bitwiseAND(F.col("own")) != 0, "out": F.col("mask").bitwiseAND(F.col("before")) != 0})
    total = lambda when, of: F.sum(F.when(when, of).otherwise(F.lit(0))).cast("long")
    fails, out, n = F.col("fails"), F.col("out"), F.col("n")
    made = rows.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~out, n).alias("kept"),
        total(fails & ~out, n).alias("removed"),
        total(fails & out, n).alias("redundant"),
        total(F.col("mask") == F.col("own"), n).alias("unique_fails"),
        total(fails & ~out, F.col("good")).alias("good_lost"),
        total(fails & ~out, F.col("toxic")).alias("toxic_lost"),
        # over all orders, the documents of a mask go by each of its filters in an equal share
        total(fails, n * (F.lit(len(orders)) / F.bit_count("mask")).cast("long")).alias("shapley"),
    )
    return made


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The counters of all filter orders by part; nulls, ties and empty tables as failure_masks and mask_counts say."""
    with scratch(docs.sparkSession) as keep:
        counts = save(mask_counts(failure_masks(docs), labels), "filter-counts")
        keep.append(counts)
    return interactions(counts)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters on all documents, in all 120 orders."""
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP12_SQL = r"""
WITH RECURSIVE d AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents
), w AS (
    SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM d
), m AS (
    SELECT w.doc_id, part,
           CAST(len(words) < 100 AS INT) + 2 * CAST(100 * len(list_distinct(words)) < 80 * len(words) AS INT)
           + 4 * CAST(100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) AS INT)
           + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(least < w.doc_id, false) AS INT) AS mask,
           coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
    FROM w LEFT JOIN (SELECT doc_id, max(CAST(coalesce(quality = 1, false) AS INT)) AS good, max(CAST(coalesce(toxic = 1, false) AS INT)) AS toxic FROM labels GROUP BY doc_id) l
    ON w.doc_id = l.doc_id
), c AS (
    SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask
), f AS (
    SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) t(letter, bit)
), o AS (
    SELECT letter AS filter_order, 0 AS before, bit AS own, 1 AS step FROM f
    UNION ALL
    SELECT filter_order || letter, before + own, bit, step + 1 FROM o JOIN f ON ((before + own) & bit) = 0
), s AS (
    SELECT a.filter_order, p.step, p.before, p.own FROM o a JOIN o p ON a.step = 5 AND starts_with(a.filter_order, p.filter_order)
), x AS (
    SELECT part, filter_order, step, own,
           CAST(sum(CASE WHEN mask & (before + own) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
           CAST(sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
           CAST(sum(CASE WHEN mask & own <> 0 AND mask & before <> 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
           CAST(sum(CASE WHEN mask = own THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
           CAST(sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost,
           CAST(sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
    FROM c CROSS JOIN s GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM x
"""

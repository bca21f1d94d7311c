"""Words that differ by one code point, found with two minimal acyclic automata.

A near word has either the first half of a word in common with it or the second. So a forward automaton of the words
is walked along the first half exactly and completed with one error, and a backward automaton, of the reversed words,
along the reversed second half; what both find is one pair. A state of an automaton knows how many words end below it,
which numbers the words in their order without a gap (a perfect hash), so that a task keeps words and counts as arrays.

Words are dealt to tasks by their length and half (less one code point, which an error may take), the words that look
for near ones by the three lengths these can have. So no automaton holds the whole vocabulary, and a half that very
many words share is split among several automata, all of which are asked.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pelagia.llm.common import save, scratch, shuffle_partitions, table
from pelagia.llm.embedding_duplicates import FEW, salted

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: After A-Z have become a-z: the letters that make words.
RUN = re.compile("[a-zÀ-ÿ]+")
#: A task's counts are handed on when it holds so many words.
HELD = 200_000


class Automaton:
    """The minimal acyclic automaton of words that come in code-point order, without repeats."""

    def __init__(self) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.final: list[bool] = [False]
        self.below: list[int] = []
        self._known: dict[tuple, int] = {}
        self._open: list[tuple[int, str, int]] = []
        self._last = ""

    def add(self, word: str) -> None:
        same = 0
        for x, y in zip(word, self._last, strict=False):
            if x != y:
                break
            same += 1
        self._close(same)
        state = self._open[-1][2] if self._open else 0
        for c in word[same:]:
            self.next.append({})
            self.final.append(False)
            self.next[state][c] = len(self.next) - 1
            self._open.append((state, c, len(self.next) - 1))
            state = len(self.next) - 1
        self.final[state] = True
        self._last = word

    def _close(self, depth: int) -> None:
        """States below `depth` of the last word change no more: equal ones become one."""
        while len(self._open) > depth:
            parent, c, state = self._open.pop()
            key = (self.final[state], *self.next[state].items())
            known = self._known.setdefault(key, state)
            if known != state:
                self.next[parent][c] = known
                if state == len(self.next) - 1:
                    self.next.pop()
                    self.final.pop()

    def done(self) -> Automaton:
        """Close the last word and count the words below each state; targets are made before their sources are closed."""
        self._close(0)
        below: dict[int, int] = {}
        stack = [0]
        while stack:
            state = stack[-1]
            missing = [t for t in self.next[state].values() if t not in below]
            if missing:
                stack.extend(missing)
                continue
            stack.pop()
            below[state] = self.final[state] + sum(below[t] for t in self.next[state].values())
        self.below = [below.get(s, 0) for s in range(len(self.next))]
        self._known.clear()
        return self

    def step(self, state: int, c: str, number: int) -> tuple[int, int]:
        """The state behind c and the number of its first word; -1 where no word goes on with c."""
        number += self.final[state]
        for d, t in self.next[state].items():
            if d == c:
                return t, number
            number += self.below[t]
        return -1, number

    def walk(self, state: int, rest: str, number: int) -> tuple[int, int]:
        for c in rest:
            if c not in self.next[state]:
                return -1, number
            state, number = self.step(state, c, number)
        return state, number

    def near(self, word: str, exact: int, change: int) -> set[int]:
        """Numbers of the words that share the first `exact` code points and differ by one error behind them.

        change: -1 a code point less than `word`, 0 another one, 1 one more."""
        found: set[int] = set()
        state, number = self.walk(0, word[:exact], 0)
        for at in range(exact, len(word) + 1):
            if state < 0:
                break
            if change == -1 and at < len(word):
                end, no = self.walk(state, word[at + 1 :], number)
                if end >= 0 and self.final[end]:
                    found.add(no)
            elif change >= 0 and (at < len(word) or change == 1):
                rest, no = word[at + 1 - change :], number + self.final[state]
                for c, t in self.next[state].items():
                    if change or c != word[at]:
                        end, hit = self.walk(t, rest, no)
                        if end >= 0 and self.final[end]:
                            found.add(hit)
                    no += self.below[t]
            if at < len(word):
                state, number = self.walk(state, word[at], number)
        return found


def runs(text: str | None, doc_id: int | None) -> Iterator[tuple[str, int]]:
    """(word, times) of a text: its lower-cased runs, of which one in 97 loses a code point, as a checksum decides."""
    if not text:
        return
    lowered = text.encode("utf-8", "surrogatepass").translate(LOWER).decode("utf-8", "surrogatepass")
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, times in Counter(RUN.findall(lowered)).items():
        if len(run) >= 5:
            h = zlib.crc32(run.encode(), start)
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            yield run, times


def word_counts(docs: DataFrame, least_length: int = 5, least_count: int = 3) -> DataFrame:
    """word and n, its occurrences, of the words of at least `least_length` code points (5 or more) and occurrences.

    Null and empty texts have none; a null id counts as an empty one in the checksum; repeated rows count each time. A
    task hands on counts whenever it holds many words, and these are added up before they are exchanged."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def given() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for b in batches:
            for i, t in zip(b.column("_id").to_pylist(), b.column("_text").to_pylist(), strict=True):
                for word, times in runs(t, i):
                    if len(word) >= least_length:
                        held[word] += times
                if len(held) >= HELD:
                    yield given()
                    held.clear()
        if held:
            yield given()

    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").alias("_text"))
    return texts.mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words, from rows ordered by direction, dictionary before queries, and word."""
    way, automaton, words, counts = None, Automaton(), [], []
    ready = False
    for b in batches:
        out: list[tuple] = []
        for backward, asks, word, n, change in zip(*(b.column(c).to_pylist() for c in ("backward", "asks", "word", "n", "change")), strict=True):
            if backward != way:
                way, automaton, words, counts, ready = backward, Automaton(), [], [], False
            if not asks:
                automaton.add(word)
                words.append(word)
                counts.append(n)
                continue
            if not ready:
                automaton.done()
                ready = True
            half = len(word) // 2
            for k in automaton.near(word, len(word) - half if backward else half, change) if words else ():
                near = words[k]
                out.append((word[::-1], near[::-1], counts[k]) if backward else (word, near, counts[k]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.string(), pa.string(), pa.int64()), strict=True)], names=["word", "near", "near_n"])


def near_pairs(words: DataFrame, most: int = 50_000) -> DataFrame:
    """word, near and near_n, each word's near words once; words: distinct `word` with `n`, of 5 code points or more.

    An automaton holds the words of the halves that its task gets; halves of over `most` words are split."""
    spark = words.sparkSession
    both = F.explode(F.array(F.struct(F.lit(False).alias("backward"), F.col("word").alias("w")), F.struct(F.lit(True).alias("backward"), F.reverse("word").alias("w"))))
    turned = words.select("n", both.alias("x")).select("n", "x.*").withColumn("size", F.length("w"))
    # a word of the dictionary, of this size, is sought by its first half less what an error may take
    known = turned.select("backward", F.lit(False).alias("asks"), "w", "n", F.lit(0).alias("change"), "size")
    asking = turned.withColumn("change", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).select("backward", F.lit(True).alias("asks"), "w", F.lit(0).cast("long").alias("n"), "change", (F.col("size") + F.col("change")).alias("size"))
    # forwards the exact half is size // 2 long, backwards one more where the size is odd: at least this for all three sizes
    rows = known.union(asking).where("size >= 5").withColumn("half", F.expr("substr(w, 1, (size - 1) div 2)"))
    sizes = rows.where("not asks").groupBy("backward", "size", "half").agg(F.count("*").alias("c")).where(F.col("c") > most)
    split = save(sizes.select("backward", "size", "half", F.ceil(F.col("c") / most).cast("int").alias("parts")), "spelling-split")
    dealt = salted(rows, split, ["backward", "size", "half"], "w", split.count() <= FEW)
    parts = F.coalesce("parts", F.lit(1))
    own = F.when(F.col("asks"), F.sequence(F.lit(0), parts - 1)).otherwise(F.array(F.pmod(F.xxhash64("w"), parts).cast("int")))
    dealt = dealt.withColumn("part", F.explode(own))
    tasks = max(shuffle_partitions(spark), -(-2 * words.count() // most))
    ordered = dealt.repartition(tasks, "backward", "size", "half", "part").sortWithinPartitions("backward", "asks", "w")
    found = ordered.select("backward", "asks", F.col("w").alias("word"), "n", "change").mapInArrow(_found, "word string, near string, near_n long")
    return found.repartition(shuffle_partitions(spark), "word").distinct()


def variants(docs: DataFrame, least_length: int = 5, least_count: int = 3, ratio: int = 2) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of docs; nulls, ties and empty tables as word_counts says.

    The form is the most frequent near word (the smallest of equals) if it has at least `ratio` times the word's
    occurrences; the root is the end of the chain of forms. Chains are followed from their roots: a level per round,
    and counts grow by `ratio` at each, so there are at most log(largest count) rounds."""
    with scratch(docs.sparkSession) as keep:
        words = save(word_counts(docs, least_length, least_count), "spelling-words")
        # the largest count wins, then the smallest word
        best = F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("near"))).alias("best")
        near = near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), best)
        told = words.join(near, "word", "left").withColumns({"n_near": F.coalesce("n_near", F.lit(0)), "most": -F.col("best.m")})
        formed = F.col("most") >= ratio * F.col("n")
        told = told.select("word", "n", "n_near", F.when(formed, F.col("best.near")).alias("form"), F.when(formed, F.col("most")).alias("form_n"))
        told = save(told, "spelling-forms")
        level = told.where("form is null").select("word", F.col("word").alias("root"))
        found, level = [level], told.where("form is null").select(F.col("word").alias("form"), F.col("word").alias("root"))
        while True:
            level = save(told.where("form is not null").select("word", "form").join(level, "form").select(F.col("word").alias("form"), "root"), "spelling-roots")
            if not level.take(1):
                break
            found.append(level.select(F.col("form").alias("word"), "root"))
        roots = found[0]
        for more in found[1:]:
            roots = roots.union(more)
        made = save(told.join(roots, "word").select("word", "form", "root", "n", "n_near", "form_n"), "spelling-variants")
        keep.append(made)
    return made


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms and roots of all words of documents with at least 5 code points and 3 occurrences."""
    return variants(table(spark, sf_dir, "documents"))

"""Toxicity: gradient-boosted trees over dense text features, with isotonic calibration.

The lexicon holds a short list of insults and what the labels teach: words and word beginnings that are significantly
more frequent in toxic documents. Features are densities and counts of lexicon words, how near they stand to the second
person, capitals, punctuation and obfuscation. Three disjoint folds of the labelled rows teach the lexicon, the trees
and the calibration, so that no stage sees its own training rows as easier than new ones.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pelagia.llm.common import save, table

#: Insults to begin with, and words of the second person in the corpus's languages.
INSULTS = frozenset("idiot moron stupid loser trash scum clown pathetic worthless disgusting dumb imbecile garbage vermin filth".split())
SECOND_PERSON = frozenset("you your yours yourself youre u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer usted ustedes tú ti tus vosotros".split())
LEET = str.maketrans("013457@$!|", "oieastasil")

WORD = re.compile(r"\S+")
SEPARATED = re.compile(r"(?<!\w)[^\W\d_](?:[.\-*_][^\W\d_]){2,}(?!\w)")
LETTERS = re.compile(r"[^\W\d_]+")
CAPITAL = re.compile(r"[A-ZÀ-ÖØ-Þ]")
FEATURES = ("insults", "learned", "weight", "best", "hits", "per_second_person", "capitals", "shouted", "exclamations", "questions", "obfuscated", "obfuscated_hits", "length")
NEAR = 5
#: Columns that scoring makes.
OWN = ("features", "score", "_vector", "_raw", "_probability", "_prediction")
LONGEST_PREFIX = 8


def pieces(word: str) -> set[str]:
    """A word as a whole (=word) and its beginnings of 3 to 8 letters (^beginning)."""
    return {"=" + word} | {"^" + word[:n] for n in range(3, min(LONGEST_PREFIX, len(word)) + 1)}


def document_pieces(text: str) -> set[str]:
    out: set[str] = set()
    for w in set(LETTERS.findall(text.lower())):
        out |= pieces(w)
    return out


class Words(dict):
    """What is known of a token, made when it is first met: letters, capitals and flags, packed into one number."""

    SIDE, SECOND, SHOUTED, INSULT, LEARNED, OBFUSCATED, FOUND_OBFUSCATED = 28, 56, 57, 58, 59, 60, 61
    HIT = 1 << INSULT | 1 << LEARNED

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon, self.weights, self.heads = lexicon, {}, {p[1:4] for p in lexicon}

    def weight(self, word: str) -> float:
        if word[:3] not in self.heads:
            return 0.0
        return max((self.lexicon[p] for p in pieces(word) if p in self.lexicon), default=0.0)

    def __missing__(self, token: str) -> int:
        low = token.lower()
        plain_word = low.isalpha()
        word = low if plain_word else "".join(LETTERS.findall(low))
        w, insult, hidden, found = self.weight(word), word in INSULTS, False, False
        if not plain_word and not w and not insult:
            core = low.strip(".,;:!?\"'()[]")
            if core and not core.isalpha():
                plain = "".join(LETTERS.findall(core.translate(LEET)))
                if plain and (plain != word or SEPARATED.search(core)):
                    hidden = any(c.isalpha() for c in core)
                    w, insult = self.weight(plain), plain in INSULTS
                    found = bool(w or insult)
        if w:
            self.weights[token] = w
        made = len(token) if plain_word and len(low) == len(token) else sum(map(str.isalpha, token))
        if token != low:
            made |= len(CAPITAL.findall(token)) << self.SIDE | (len(token) > 2 and token.isupper()) << self.SHOUTED
        made |= (word in SECOND_PERSON) << self.SECOND | insult << self.INSULT | (w > 0) << self.LEARNED | hidden << self.OBFUSCATED | found << self.FOUND_OBFUSCATED
        self[token] = made
        return made


def features(text: str | None, words: Words, most_held: int = 100_000) -> list[float]:
    """The dense features of a text, in the order of FEATURES; an empty text gives zeros. words is emptied when it is full."""
    text = text or ""
    tokens = WORD.findall(text)
    n = max(1, len(tokens))
    if len(words) > most_held:
        words.clear()
    known = np.fromiter(map(words.__getitem__, tokens), dtype=np.int64, count=len(tokens))
    on = lambda k: (known >> k) & 1
    hits, persons = np.flatnonzero(known & words.HIT), np.flatnonzero(on(words.SECOND))
    found = [words.weights.get(tokens[i], 0.0) for i in hits.tolist()]
    near = 0
    if len(hits) and len(persons):
        at = np.searchsorted(persons, hits)
        p = np.r_[-(10**9), persons, 10**9]
        near = int(np.sum(np.minimum(hits - p[at], p[at + 1] - hits) <= NEAR))
    side = (1 << words.SIDE) - 1
    letters, capitals = int((known & side).sum()), int((known >> words.SIDE & side).sum())
    count = lambda k: int(on(k).sum()) / n
    shouts, asks = text.count("!") / n, text.count("?") / n
    densities = [count(words.INSULT), count(words.LEARNED), sum(found) / n, max(found, default=0.0), math.log1p(len(hits)), near / n]
    return densities + [capitals / max(1, letters), count(words.SHOUTED), shouts, asks, count(words.OBFUSCATED), count(words.FOUND_OBFUSCATED), math.log1p(len(tokens))]


def is_held_out(id_: Column) -> Column:
    """Rows that no training sees: crc32 of the id as text leaves 1 when divided by 3. A null id is not held out."""
    return F.coalesce(F.crc32(id_.cast("string")) % 3 == 1, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """At most `most` labelled training rows, those of the smallest hash: fold, text, label. Held-out rows never enter."""
    known = labels.where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull() & ~is_held_out(F.col(id_col)))
    chosen = known.groupBy(id_col).agg(F.max("toxic").cast("double").alias("label")).orderBy(F.xxhash64(id_col), id_col).limit(most)
    mixed = F.pmod(F.xxhash64(id_col, F.lit(7)), F.lit(10))
    fold = F.when(mixed < 4, 0).when(mixed < 8, 1).otherwise(2)
    texts = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.join(chosen, id_col).select(id_col, fold.alias("fold"), "text", "label")


def learn_lexicon(sample: DataFrame, least: float = 12.0) -> dict[str, float]:
    """Pieces that are more frequent in toxic documents by a likelihood ratio of `least`, with their log odds.

    The sample is bounded, and so is what it teaches."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        toxic, clean = Counter(), Counter()
        for b in batches:
            for text, label in zip(b["text"], b["label"], strict=True):
                (toxic if label else clean).update(document_pieces(text))
        if toxic:
            yield pd.DataFrame({"piece": list(toxic), "t": list(toxic.values()), "c": [clean[p] for p in toxic]})
        rest = [p for p in clean if p not in toxic]
        for i in range(0, len(rest), 100_000):
            part = rest[i : i + 100_000]
            yield pd.DataFrame({"piece": part, "t": [0] * len(part), "c": [clean[p] for p in part]})

    size = sample.groupBy().agg(F.coalesce(F.sum("label"), F.lit(0.0)).alias("t"), F.count("*").alias("n")).first()
    n_toxic, n_clean = size["t"], size["n"] - size["t"]
    if not n_toxic or not n_clean:
        return {}
    counts = sample.select("text", "label").mapInPandas(counted, "piece string, t long, c long").groupBy("piece").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    t, c = F.col("t").cast("double"), F.col("c").cast("double")
    rate = (t + c) / (n_toxic + n_clean)
    part = lambda seen, of: F.when(seen > 0, seen * F.log(seen / (of * rate))).otherwise(0.0) + F.when(of - seen > 0, (of - seen) * F.log((of - seen) / (of * (1 - rate)))).otherwise(0.0)
    odds = F.log(((t + 0.5) / (n_toxic + 1)) / ((c + 0.5) / (n_clean + 1)))
    scored = counts.where((F.col("t") >= 3) & (t / n_toxic > 2 * c / n_clean)).select("piece", (2 * (part(t, n_toxic) + part(c, n_clean))).alias("ratio"), odds.alias("odds"))
    best = scored.where((F.col("ratio") >= least) & (F.col("odds") > 2)).collect()
    return {r["piece"]: r["odds"] for r in best}


def with_features(df: DataFrame, lexicon: dict[str, float], text_col: str = "text") -> DataFrame:
    """df without text_col, with `features` as an array in the order of FEATURES; columns of the names in OWN are replaced."""
    names = [c for c in df.columns if c != text_col and c not in OWN]
    kinds = dict(df.dtypes)

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words(lexicon)
        for b in batches:
            yield b[names].assign(features=[features(t, words) for t in b[text_col]])

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in names), "features array<double>"])
    return df.select(*names, text_col).mapInPandas(measured, schema)


class Model:
    """A fitted lexicon, the trees and the calibration's steps (boundaries and values)."""

    def __init__(self, lexicon: dict[str, float], trees, steps: tuple[list[float], list[float]]):
        self.lexicon, self.trees, self.steps = lexicon, trees, steps

    def score(self, measured: DataFrame) -> DataFrame:
        """measured (with `features`) and its calibrated `score`; without trees, the share of words that are hits decides."""
        if self.trees is None:
            hit = F.greatest(F.col("features")[FEATURES.index("insults")], F.col("features")[FEATURES.index("learned")])
            return measured.withColumn("score", 1 - F.exp(-20 * hit))
        got = self.trees.transform(measured.withColumn("_vector", array_to_vector("features")))
        raw = vector_to_array("_probability")[1]
        return got.withColumn("score", calibrated(raw, *self.steps)).drop("_vector", "_raw", "_probability", "_prediction")


def pool_adjacent(raw: np.ndarray, label: np.ndarray) -> tuple[list[float], list[float]]:
    """Isotonic regression: boundaries of the raw score and the calibrated values there, by pooling adjacent violators.

    One row of each label is added to each end's pool, so that few rows do not give certainty."""
    order = np.lexsort((label, raw))
    pools: list[list[float]] = []
    for x, y in zip(raw[order], label[order], strict=True):
        pools.append([float(y), 1.0, float(x), float(x)])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [pools[-1][0] + last[0], pools[-1][1] + last[1], pools[-1][2], last[3]]
    places, values = [], []
    for good, n, lo, hi in pools:
        value = (good + 0.02) / (n + 0.04) if n > 1 else good * 0.5 + 0.25
        for x in dict.fromkeys((lo, hi)):
            if places and x <= places[-1]:
                continue
            places.append(x)
            values.append(max(value, values[-1] if values else 0.0))
    return places, values


def calibrated(raw: Column, places: list[float], values: list[float]) -> Column:
    """Piecewise linear between the boundaries, plus a trace of the raw score so that ties keep its order."""
    if not places:
        return raw
    xs, ys = F.array(*map(F.lit, places)), F.array(*map(F.lit, values))
    below = F.size(F.filter(xs, lambda x: x <= raw))
    lo, hi = F.greatest(below, F.lit(1)), F.least(below + 1, F.lit(len(places)))
    x0, x1, y0, y1 = F.element_at(xs, lo), F.element_at(xs, hi), F.element_at(ys, lo), F.element_at(ys, hi)
    between = F.when(x1 > x0, y0 + (y1 - y0) * F.least(F.greatest((raw - x0) / (x1 - x0), F.lit(0.0)), F.lit(1.0))).otherwise(y0)
    return between * 0.998 + raw * 0.001 + 0.0005


def fit(docs: DataFrame, labels: DataFrame, most: int = 20_000, rounds: int = 15, depth: int = 3) -> Model:
    """Train on at most `most` labelled rows (a documented bound) that are not held out.

    Where a fold has fewer than two labels of a kind, as in an empty table, the model has no trees and scores by the
    share of hits alone. Null labels and null ids teach nothing; repeated labels of an id count once, the toxic one."""
    sample = save(labelled_sample(docs, labels, most).repartition(12, "doc_id"), "toxic-sample")
    lexicon = learn_lexicon(sample.where("fold = 0"))
    measured = save(with_features(sample.where("fold > 0"), lexicon).coalesce(2).sortWithinPartitions("doc_id"), "toxic-features")
    sizes = {r["fold"]: (r["t"], r["n"]) for r in measured.groupBy("fold").agg(F.sum("label").alias("t"), F.count("*").alias("n")).collect()}
    if len(sizes) < 2 or any(t < 2 or n - t < 2 for t, n in sizes.values()):
        return Model(lexicon, None, ([], []))
    learner = GBTClassifier(featuresCol="_vector", labelCol="label", predictionCol="_prediction", maxIter=rounds, maxDepth=depth, stepSize=0.3, minInstancesPerNode=2, seed=11)
    learner = learner.setProbabilityCol("_probability").setRawPredictionCol("_raw")
    trees = learner.fit(measured.where("fold = 1").withColumn("_vector", array_to_vector("features")))
    held = trees.transform(measured.where("fold = 2").withColumn("_vector", array_to_vector("features"))).select(vector_to_array("_probability")[1].alias("raw"), "label").toPandas()
    return Model(lexicon, trees, pool_adjacent(held["raw"].to_numpy(), held["label"].to_numpy()))


def score_toxicity(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs without the text, with `features` and `score` from 0 to 1.

    Empty and null texts score as texts without a hit, and equal texts, repeated rows included, score the same. Ids,
    null ones too, are carried along and never read; an empty table gives an empty result; columns of df named like
    those in OWN are replaced."""
    return model.score(with_features(docs, model.lexicon, text_col))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    scored = score_toxicity(docs, model)
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), F.to_json("features").alias("features"))

"""Near-duplicate groups: ball hashing proposes links, word shingles decide them, shared prefixes find what is left.

A text is its set of distinct word shingles. Texts whose SimHash fingerprints are close are the first candidates; what
the shingles confirm of them gives components, so that large groups of copies collapse at once. Then texts of different
components meet that share a shingle in their prefixes, which any two texts of the wanted similarity do. In prefixes
that are half as long again such texts share many shingles, so a text that shares few with other components is left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pelagia.llm.common import discard, save
from pelagia.llm.components import components
from pelagia.llm.rolling import NOT_SPACE, chunks, ngram_hashes, word_hashes
from pelagia.llm.simhash import links

PAIRS = "left boolean, a long, b long, size int, pos int"
MEETING = ("token", "node", "size", "pos", "comp", "n", "r")


def shingle_sets(texts: Iterable[str | None], width: int) -> Iterator[list[np.ndarray]]:
    """The distinct hashes of each text's shingles of `width` words, ascending, in lists of some hundred texts.

    A text of fewer words is one shingle; texts without words are all equal."""
    for _, raws in chunks(texts):
        words, text = word_hashes(raws, NOT_SPACE)
        grams, edge = ngram_hashes(words, text, width), np.searchsorted(text, np.arange(len(raws) + 1)).tolist()
        made = []
        for a, b in zip(edge, edge[1:], strict=False):
            if b - a >= width:
                made.append(np.unique(grams[a : b - width + 1]))
            else:
                made.append(ngram_hashes(words[a:b], text[a:b], b - a)[:1] if b > a else np.zeros(1, dtype=np.uint64))
        yield made


def set_fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """The fingerprint of each set: a bit is 1 if it is set in more than half of the members."""
    sizes = np.array([len(s) for s in sets])
    bits = np.unpackbits(np.concatenate(sets).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.add.reduceat(bits, np.cumsum(sizes) - sizes, axis=0, dtype=np.int32)
    return np.packbits(ones * 2 > sizes[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]


def bitmaps(sets: list[np.ndarray], longs: int = 8, most: int = 4096) -> list[np.ndarray]:
    """For each set the parity of its members at each of 64 * `longs` places: two bitmaps differ in no more bits than sets in members."""
    out, n = [], 64 * longs
    for i in range(0, len(sets), most):
        part = sets[i : i + most]
        places = np.repeat(np.arange(len(part)) * n, [len(s) for s in part]) + (np.concatenate(part) >> np.uint64(20)).astype(np.int64) % n
        odd = np.bincount(places, minlength=len(part) * n).astype(np.uint8) & 1
        out += list(np.packbits(odd.reshape(-1, n), axis=1, bitorder="little").view(np.int64))
    return out


def prefix_length(size: int, similarity: float) -> int:
    """Two sets of a Jaccard similarity of `similarity` share one of their first members of this number, in any common order."""
    return size - math.ceil(similarity * size - 1e-9) + 1


def common_members(size: int, similarity: float) -> int:
    """Two sets of at least this size and of that similarity share so many of their first prefix_length + common_members - 1 members.

    Of k common members the first n are followed by k - n others, which a prefix longer by n - 1 can spare."""
    return min(math.ceil(similarity * size - 1e-9), max(1, prefix_length(size, similarity) // 2))


def hot_shingles(rows: DataFrame, n_texts: int, width: int, sample: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """About the `most` shingles that most of about `sample` texts hold, ascending, and how many do.

    Of those at the last count taken, a share by their hash is taken; all that reaches the driver is the result."""

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for sets in shingle_sets(b["text"], width):
                yield pd.DataFrame({"token": np.concatenate(sets).view(np.int64)})

    some = rows.where(F.pmod(F.xxhash64("key"), F.lit(max(1, n_texts // sample))) == 0).select("text")
    held = save(some.mapInPandas(listed, "token long").groupBy("token").agg(F.count("*").alias("n")).where("n > 1"), "hot")
    # the count from which on all are taken follows from how many shingles have each count, so nothing is sorted as a whole
    least, share, room = 2, 1.0, most
    for r in held.groupBy("n").agg(F.count("*").alias("c")).orderBy(F.desc("n")).limit(most).collect():
        least, share, room = r["n"], min(1.0, room / r["c"]), room - r["c"]
        if room <= 0:
            break
    parts = 1 << 20
    part = F.pmod(F.xxhash64("token"), F.lit(parts)) < int(share * parts)
    found = held.where((F.col("n") > least) | ((F.col("n") == least) & part)).toArrow()
    discard(held)
    token, n = found["token"].to_numpy().view(np.uint64), found["n"].to_numpy()
    order = np.argsort(token)
    return token[order], n[order]


def prefixes(sets: list[np.ndarray], similarity: float, hot: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """The prefix of each set and what common_members() adds to it, where frequent shingles come last, so that few of them are in one."""
    flat, edge = np.concatenate(sets), np.cumsum([0, *(len(s) for s in sets)])
    rank = np.zeros(len(flat), dtype=np.int64)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, flat), len(hot) - 1)
        rank = np.where(hot[at] == flat, counts[at], 0)
    busy = np.maximum.reduceat(rank, edge[:-1]) > 0
    out = []
    for s, a, b, some in zip(sets, edge[:-1].tolist(), edge[1:].tolist(), busy.tolist(), strict=True):
        n = prefix_length(len(s), similarity) + common_members(len(s), similarity) - 1
        out.append(s[np.argsort(rank[a:b], kind="stable")[:n]] if some else s[:n])
    return out


def _may_be_alike(sa: np.ndarray, pa: np.ndarray, sb: np.ndarray, pb: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets of these sizes, whose first common member has these places, can reach the similarity."""
    need = np.ceil(similarity / (1 + similarity) * (sa + sb) - 1e-9)
    return np.minimum(sa - pa, sb - pb) >= need


def _most_apart(sa: np.ndarray, sb: np.ndarray, similarity: float) -> np.ndarray:
    """How many members, at most, two sets of these sizes and of the similarity do not share."""
    return sa + sb - 2 * np.ceil(similarity / (1 + similarity) * (sa + sb) - 1e-9)


def meetings(batches: Iterator[pd.DataFrame], similarity: float, small: int, pivots: int) -> Iterator[pd.DataFrame]:
    """Pairs to verify (left is false) and members still to be compared (left is true).

    Rows come sorted by token and r, a member's place among the n that share the token: first those with the fewest
    rarer shingles, which are like the most others. Members of one component need no pair. A token of up to `small`
    members gives all other pairs. Of a larger one the first `pivots` members are compared with all, and the rest stays
    for the next round. Pairs whose bitmaps (column bits, if there is one) differ too much are no pairs. Only the pivots and
    one small token are held."""
    carry: pd.DataFrame | None = None
    open_: dict | None = None
    for b in batches:
        if not len(b):
            continue
        if carry is not None:
            b = pd.concat([carry, b], ignore_index=True)
            carry = None
        token, node, size, pos, comp, n, r = (b[c].to_numpy() for c in MEETING)
        bits = np.stack(b["bits"].to_numpy()).view(np.uint64) if "bits" in b else np.zeros((len(b), 1), dtype=np.uint64)
        if n[-1] <= small and r[-1] < n[-1]:
            cut = int(np.searchsorted(np.cumsum(token[::-1] != token[-1]), 1))
            carry = b.iloc[len(b) - cut :]
            token, node, size, pos, comp, n, r = (b[c].to_numpy()[: len(b) - cut] for c in MEETING)
            bits = bits[: len(b) - cut]
        firsts, seconds, left = [], [], []

        def take(na, sa, pa, ca, xa, nb, sb, pb, cb, xb) -> None:
            ok = (ca != cb) & _may_be_alike(sa, pa, sb, pb, similarity)
            at = np.flatnonzero(ok)
            apart = np.bitwise_count((xa if xa.ndim == 1 else xa[at]) ^ xb[at]).sum(axis=1, dtype=np.int64)
            ok[at] = apart <= _most_apart(sa, sb, similarity)[at]
            firsts.append(np.minimum(na, nb)[ok])
            seconds.append(np.maximum(na, nb)[ok])

        rows = np.flatnonzero(n <= small)
        for d in range(1, int(n[rows].max(initial=1))):
            rows = rows[r[rows] + d <= n[rows]]
            take(*(x[rows] for x in (node, size, pos, comp, bits)), *(x[rows + d] for x in (node, size, pos, comp, bits)))
        big = np.flatnonzero(n > small)
        for part in np.split(big, np.flatnonzero(np.diff(token[big])) + 1) if len(big) else ():
            if open_ is None or open_["token"] != token[part[0]]:
                open_ = {"token": token[part[0]], "held": []}
            new = part[r[part] <= pivots]
            for i in new.tolist():
                later = part[part > i]
                take(node[i], size[i], pos[i], comp[i], bits[i], *(x[later] for x in (node, size, pos, comp, bits)))
            rest = part[r[part] > pivots]
            for one in open_["held"]:
                take(*one, *(x[part] for x in (node, size, pos, comp, bits)))
            open_["held"] += [(node[i], size[i], pos[i], comp[i], bits[i]) for i in new.tolist()]
            left.append(rest)
        pairs = np.unique(np.stack([np.concatenate(firsts), np.concatenate(seconds)], axis=1), axis=0) if firsts else np.zeros((0, 2), dtype=np.int64)
        if len(pairs):
            yield pd.DataFrame({"left": False, "a": pairs[:, 0], "b": pairs[:, 1], "size": 0, "pos": 0})
        for rest in filter(len, left):
            yield pd.DataFrame({"left": True, "a": node[rest], "b": token[rest], "size": size[rest], "pos": pos[rest]})


def linkable(shared: DataFrame, label: DataFrame, similarity: float, rounds: int = 2) -> DataFrame:
    """The members within prefixes of those texts that can still have a link to another component, by the number of what they share.

    A text's partners have at least `similarity` of its size, so it shares common_members() of that size with each of them;
    texts left out are no partners of others, so counting again leaves out more."""
    one, least = Window.partitionBy("token"), F.ceil(similarity * F.col("size") - 1e-9)
    need = F.ceil(similarity * least - 1e-9)
    common = F.least(need, F.greatest(F.lit(1), F.floor((least - need + 1) / 2)))
    rows = shared.join(label, "node")
    for _ in range(rounds):
        ends = rows.withColumn("first", F.min("comp").over(one)).withColumn("most", F.max("comp").over(one))
        apart = save(ends.where("first < most").drop("first", "most"), "apart")
        able = apart.groupBy("node", "size").agg(F.count("*").alias("n")).where(F.col("n") >= common).select("node")
        rows = apart.join(able, "node", "left_semi")
    return save(rows.where(F.col("pos") <= F.col("size") - least).select("token", "node", "size", "pos"), "linkable")


def met(members: DataFrame, label: DataFrame, marks: DataFrame, similarity: float, small: int, pivots: int) -> DataFrame:
    """The rows of meetings() for members (token, node, size, pos) with the components that label gives them and the bitmaps of marks."""
    one = Window.partitionBy("token")
    ranked = members.join(label, "node").join(marks, "node").withColumn("r", F.row_number().over(one.orderBy("pos", "node"))).withColumn("n", F.count("*").over(one))
    apart = ranked.withColumn("first", F.min("comp").over(one)).withColumn("most", F.max("comp").over(one)).where("first < most").select(*MEETING, "bits")
    return apart.mapInPandas(lambda batches: meetings(batches, similarity, small, pivots), PAIRS)


def stars(members: DataFrame, label: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of each member and the first one of its shingle, where their components differ.

    What they confirm collapses the large groups, so that met() has little left to compare."""
    one = Window.partitionBy("token")
    rows = members.join(label, "node").withColumn("n", F.count("*").over(one)).withColumn("head", F.min(F.struct("pos", "node", "size", "comp")).over(one))
    ends = rows.where((F.col("n") > 1) & (F.col("comp") != F.col("head.comp"))).select(F.least("node", "head.node").alias("a"), F.greatest("node", "head.node").alias("b"), F.col("size").alias("sa"), F.col("head.size").alias("sb"), F.col("pos").alias("pa"), F.col("head.pos").alias("pb"))
    need = F.ceil(similarity / (1 + similarity) * (F.col("sa") + F.col("sb")) - 1e-9)
    return ends.where(F.least(F.col("sa") - F.col("pa"), F.col("sb") - F.col("pb")) >= need).select("a", "b").distinct()


def node_of(id_: Column, key: Column) -> Column:
    """The id, and for a null id a number of the text's own above all ids, from 2^62."""
    return F.coalesce(id_, F.lit(1 << 62) + F.xxhash64(key).bitwiseAND((1 << 61) - 1))


def groups(
    df: DataFrame,
    width: int = 5,
    similarity: float = 0.8,
    radius: int = 4,
    id_col: str = "doc_id",
    text_col: str = "text",
    small: int = 24,
    pivots: int = 8,
    sample: int = 20_000,
    most_hot: int = 1 << 18,
) -> DataFrame:
    """id_col, text_key (MD5 of the text), group (the smallest id that it is linked with) and first of each row of df.

    Links join texts whose sets of `width`-word shingles have a Jaccard similarity of at least `similarity`. The first
    candidates are texts whose fingerprints lie within `radius` bits; afterwards all texts of different components meet
    that share a shingle in their prefixes, which every link does, so no link between two components is left out. Texts
    that share too few shingles with other components for any link are left out before (see common_members). Every
    link is verified on the shingles. `first` marks the row of a group that has its smallest id (repeated rows alike).
    Equal texts are one node; null and empty texts are equal to each other. A null id counts as larger than any other; a
    group of such rows only has a null as its id and is marked on one text. Ids are longs below 2^62. Other columns are
    not read. An empty table gives an empty result. Frequent shingles of about `sample` texts (`most_hot` of them reach
    the tasks) only set the order that prefixes are taken in, which no link depends on."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("key", F.md5("text"))
    hot, counts = hot_shingles(rows, df.count(), width, sample, most_hot)

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at = 0
            for sets in shingle_sets(b["text"], width):
                here = b.iloc[at : at + len(sets)]
                firsts = [p.view(np.int64) for p in prefixes(sets, similarity, hot, counts)]
                yield pd.DataFrame({"id": here["id"].astype("Int64"), "key": here["key"], "fp": set_fingerprints(sets).view(np.int64), "size": [len(s) for s in sets], "bits": bitmaps(sets), "tokens": firsts})
                at += len(sets)

    def shingled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at = 0
            for sets in shingle_sets(b["text"], width):
                yield pd.DataFrame({"id": b["id"].iloc[at : at + len(sets)], "shingles": [s.view(np.int64) for s in sets]})
                at += len(sets)

    marked = save(rows.mapInPandas(measured, "id long, key string, fp long, size int, bits array<long>, tokens array<long>").withColumn("node", node_of(F.col("id"), F.col("key"))), "marked")
    listed = save(marked.groupBy("key").agg(F.min("node").alias("node"), F.first("fp").alias("fp"), F.first("size").alias("size"), F.first("bits").alias("bits"), F.first("tokens").alias("tokens")), "prefixes")
    texts, whole = save(listed.select("key", "node", "fp"), "texts"), marked
    marked, marks = save(whole.select("id", "key", "node"), "rows"), save(listed.select("node", "bits"), "bitmaps")
    discard(whole)

    def verified(pairs: DataFrame) -> DataFrame:
        """The links among pairs (a, b)."""
        ends = pairs.select("a").union(pairs.select("b")).distinct().toDF("node")
        named = save(texts.join(ends, "node").select("node", "key"), "ends")
        held = rows.withColumn("node", node_of(F.col("id"), F.col("key"))).join(named, ["node", "key"]).select(F.col("node").alias("id"), "text")
        sets = save(held.mapInPandas(shingled, "id long, shingles array<long>").dropDuplicates(["id"]), "shingles")
        joined = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
        both = joined.select("a", "b", F.size(F.array_intersect("x", "y")).alias("c"), (F.size("x") + F.size("y")).alias("s"))
        made = save(both.where(F.col("c") / (F.col("s") - F.col("c")) >= similarity).select("a", "b"), "links")
        discard(sets, named, pairs)
        return made

    def relabelled(label: DataFrame, new: DataFrame) -> DataFrame:
        ends = new.join(label.toDF("a", "ca"), "a").join(label.toDF("b", "cb"), "b").select("ca", "cb").distinct()
        joined = components(ends).toDF("comp", "root")
        made = save(label.join(joined, "comp", "left").select("node", F.coalesce("root", "comp").alias("comp")), "labels")
        discard(label, new)
        return made

    owner = save(texts.groupBy("fp").agg(F.min("node").alias("owner")), "owners")
    same = texts.join(owner, "fp").where("node <> owner").select(F.col("owner").alias("a"), F.col("node").alias("b"))
    near = links(owner.select("fp"), radius)
    near = near.join(owner.toDF("a", "na"), "a").join(owner.toDF("b", "nb"), "b").select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b"))
    found = verified(save(same.union(near).distinct(), "pairs"))
    label = save(texts.select("node").join(components(found), "node", "left").select("node", F.coalesce("root", "node").alias("comp")), "labels")
    discard(owner, found)
    held = listed.select("node", "size", F.posexplode("tokens").alias("pos", "token"))
    shared = save(held.withColumn("n", F.count("*").over(Window.partitionBy("token"))).where("n > 1").drop("n"), "shared")
    discard(listed)
    members = linkable(shared, label, similarity)
    label = relabelled(label, verified(save(stars(members, label, similarity), "pairs")))
    discard(members)
    members = before = linkable(shared, label, similarity)
    discard(shared)
    while True:
        step = save(met(members, label, marks, similarity, small, pivots), "meetings")
        discard(before)
        label, before = relabelled(label, verified(save(step.where("not left").select("a", "b").distinct(), "pairs"))), step
        members = step.where("left").select(F.col("b").alias("token"), F.col("a").alias("node"), "size", "pos")
        if members.isEmpty():
            break
        pivots *= 8
    named = save(texts.join(label, "node").select("key", "node", F.col("comp").alias("group")), "groups")
    out = marked.select("id", "key", F.col("node").alias("own")).join(named, "key")
    real = F.when(F.col("group") < (1 << 62), F.col("group"))
    return out.select(F.col("id").alias(id_col), F.col("key").alias("text_key"), real.alias("group"), (F.col("own") == F.col("group")).alias("first"))

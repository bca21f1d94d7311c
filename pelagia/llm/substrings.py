"""Exact removal of repeated byte strings by bucket-pointer refinement.

Strings of `length` bytes that start in several documents share their q-grams. Equal q-grams form a bucket, and a
bucket is refined by the bucket identifiers at later offsets: first by those of the whole stretch that one q-gram stands
for, then, only where a bucket falls apart, string by string. The pointers that a refinement finds are reused: only a
class's first document goes on to the next one, and only where its bucket is still shared with some bytes more on
either side.

One q-gram stands for all strings of which it is the smallest by hash (a minimizer), so each string is in exactly one
bucket, equal strings are in equal buckets, and about one position in 16 enters the shuffle. Deeper refinement, to a full
suffix order, would not change the result: strings longer than `length` are covered by those of that length. Strings are
equal when two independent 64-bit hashes of their bytes are; each refinement compares at least that many bits.

A task deals its stretches to parts by bucket and sends each part arrays, so rows of the shuffle hold some thousand
stretches. Before that, what has a smaller document in the same task is answered at once; so copies of one text, however
many, send one stretch for each task and place.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pelagia.llm.common import discard, save, shuffle_partitions, table
from pelagia.llm.rolling import BASE, INVERSE, mixed, powers, window_hashes

#: Positions that are looked at together; their numbers take the low bits of a key.
PLACE_BITS = 18
#: Stretches or strings that a task holds before it deals them, and that a part is meant to have.
HELD, PER_PART = 250_000, 300_000
#: The columns of a stretch and of a string on their way to a part.
STRETCH = {"bucket": np.uint64, "deep": np.uint64, "doc": np.int64, "copy": np.int64, "start": np.int32, "off": np.uint8, "n": np.uint8, "side": np.uint32}
STRING = {"one": np.uint64, "two": np.uint64, "doc": np.int64, "copy": np.int64, "start": np.int32}
RANGE = "open boolean, doc long, copy long, start int, end int"
#: Bytes on either side of a bucket's q-gram that a stretch carries a hash of.
SIDE = 10


def slices(texts: Sequence[str | None], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, text's index, first byte in the text, end in these bytes) of runs of texts; long texts in overlapping parts."""
    most = (1 << PLACE_BITS) - length
    held: list[tuple[int, int, bytes]] = []
    size = 0
    for i, t in enumerate(texts):
        raw = (t or "").encode("utf-8", "surrogatepass")
        for at in range(0, max(0, len(raw) - length + 1), most):
            part = raw[at : at + most + length - 1]
            if held and size + len(part) > most:
                yield _joined(held)
                held, size = [], 0
            held.append((i, at, part))
            size += len(part)
    if held:
        yield _joined(held)


def _joined(held: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data = np.frombuffer(b"".join(h[2] for h in held), dtype=np.uint8)
    return data, np.array([h[0] for h in held]), np.array([h[1] for h in held]), np.cumsum([len(h[2]) for h in held])


def stretches(texts: Sequence[str | None], length: int, q: int) -> Iterator[dict[str, np.ndarray]]:
    """The columns of STRETCH without doc and copy, and `text`, the text's index, of each stretch of strings with one minimizer.

    off: the minimizer's place from the stretch's start; n: its number of strings; deep: a hash of the bucket
    identifiers of all q-grams in the stretch and of off and n; side: hashes of the bytes before and after the q-gram."""
    low = np.uint64((1 << (PLACE_BITS + 1)) - 1)
    span = length - q + 1
    for data, text, first, end in slices(texts, length):
        ids = window_hashes(data, q)
        least = ids & ~low
        least |= np.arange(len(ids), dtype=np.uint64)
        width = 1
        while width * 2 <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < span:
            least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
        place = (least & low).astype(np.int64)
        valid = np.ones(len(place) + 1, dtype=bool)
        for e in end.tolist():
            valid[max(0, e - length + 1) : e] = False
        valid[-1] = False
        new = np.ones(len(place) + 1, dtype=bool)
        new[1:-1] = place[1:] != place[:-1]
        new[1:] |= valid[1:] != valid[:-1]
        edge = np.flatnonzero(new)
        n = np.diff(edge)
        start = edge[:-1]
        fine = valid[start]
        start, n = start[fine], n[fine]
        anchor = place[start]
        part = np.searchsorted(end, start, side="right")
        origin = np.concatenate([[0], end[:-1]])[part] - first[part]
        up, down = _powers(len(ids))
        total = np.concatenate([[np.uint64(0)], np.cumsum(ids * up, dtype=np.uint64)])
        body = (total[start + n - 1 + span] - total[start]) * down[start]
        near = window_hashes(data, SIDE) >> np.uint64(48)
        left, right = near[np.maximum(anchor - SIDE, 0)], near[np.minimum(anchor + q, len(near) - 1)]
        yield {
            "text": text[part],
            "bucket": ids[anchor],
            "deep": mixed(body + ((anchor - start) * 128 + n).astype(np.uint64)),
            "start": (start - origin).astype(np.int32),
            "off": (anchor - start).astype(np.uint8),
            "n": n.astype(np.uint8),
            "side": (left << np.uint64(16) | right).astype(np.uint32),
        }


@lru_cache(maxsize=1)
def _all_powers() -> tuple[np.ndarray, np.ndarray]:
    return powers(BASE, 1 << PLACE_BITS), powers(INVERSE, 1 << PLACE_BITS)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = _all_powers()
    return up[:n], down[:n]


def _bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)


def merged(doc: np.ndarray, copy: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The ranges of each document with those that touch put together."""
    if not len(doc):
        return doc, copy, start, end
    order = np.lexsort((start, copy, doc))
    doc, copy, start, end = doc[order], copy[order], start[order].astype(np.int64), end[order].astype(np.int64)
    run = np.cumsum(np.r_[0, (doc[1:] != doc[:-1]) | (copy[1:] != copy[:-1])]) << 33
    reach = np.maximum.accumulate(run + end)
    new = np.flatnonzero(np.r_[True, (run + start)[1:] > reach[:-1]])
    last = np.r_[new[1:], len(doc)] - 1
    return doc[new], copy[new], start[new].astype(np.int32), (reach[last] - run[last]).astype(np.int32)


def ranges_frame(open_: bool, doc: np.ndarray, copy: np.ndarray, start: np.ndarray, end: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"open": open_, "doc": doc, "copy": copy, "start": start, "end": end}).astype({"start": np.int32, "end": np.int32})


def dealt(rows: dict[str, np.ndarray], keys: tuple[str, str], lengths: np.ndarray, parts: int) -> pd.DataFrame:
    """part, the columns of rows as bytes, and `known`, ranges whose string has a smaller document right here.

    Rows of equal keys are equal strings or stretches; only those of the smallest document here go on."""
    one, two = rows[keys[0]], rows[keys[1]]
    order = np.argsort(one ^ two * np.uint64(BASE), kind="stable")
    value = (one ^ two * np.uint64(BASE))[order]
    head = np.flatnonzero(np.r_[True, value[1:] != value[:-1]])
    group = np.cumsum(np.r_[0, value[1:] != value[:-1]])
    same = (one[order] == one[order][head][group]) & (two[order] == two[order][head][group])
    doc = rows["doc"][order]
    least = np.minimum.reduceat(np.where(same, doc, np.iinfo(np.int64).max), head)
    late = order[same & (doc > least[group])]
    known = np.stack([x.astype(np.int64) for x in merged(rows["doc"][late], rows["copy"][late], rows["start"][late], rows["start"][late] + lengths[late])], axis=1)
    stay = order[~(same & (doc > least[group]))]
    part = ((one[stay] >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)
    by = np.argsort(part, kind="stable")
    stay, part = stay[by], part[by]
    cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.zeros(0, dtype=np.int64)
    ends = np.r_[cut[1:], len(part)]
    made = {"part": part[cut], "known": [b""] * len(cut)}
    for c, values in rows.items():
        flat = np.ascontiguousarray(values[stay])
        made[c] = [flat[i:j].tobytes() for i, j in zip(cut.tolist(), ends.tolist(), strict=True)]
    if len(cut):
        made["known"][0] = known.tobytes()
    return pd.DataFrame(made)


def received(rows: pd.DataFrame, columns: dict[str, type]) -> tuple[dict[str, np.ndarray], pd.DataFrame]:
    """The columns of a part and its known ranges."""
    known = np.frombuffer(b"".join(rows["known"]), dtype=np.int64).reshape(-1, 4)
    return {c: np.frombuffer(b"".join(rows[c]), dtype=t) for c, t in columns.items()}, ranges_frame(False, *known.T)


def _sent(columns: dict[str, type]) -> str:
    return "part long, known binary, " + ", ".join(f"{c} binary" for c in columns)


def _shared(group: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which rows are of a group (ascending numbers) that several documents are in."""
    head = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[head, len(group)])
    return np.repeat(np.minimum.reduceat(doc, head) < np.maximum.reduceat(doc, head), size)


def refined(rows: dict[str, np.ndarray], length: int, q: int) -> Iterator[pd.DataFrame]:
    """Ranges of the stretches that a smaller document has too, and the strings (open) that a further refinement must compare."""
    order = np.argsort(rows["bucket"], kind="stable")
    bucket = rows["bucket"][order]
    order = order[_shared(bucket, rows["doc"][order])]
    if not len(order):
        return
    order = order[np.lexsort((rows["doc"][order], rows["deep"][order], rows["bucket"][order]))]
    bucket, deep, doc, copy, start, off, n, side = (rows[c][order] for c in STRETCH)
    off, n, side = off.astype(np.int64), n.astype(np.int64), side.astype(np.uint64)
    new_bucket = np.r_[True, bucket[1:] != bucket[:-1]]
    new_class = new_bucket | np.r_[True, deep[1:] != deep[:-1]]
    classes, number = np.cumsum(new_class) - 1, np.cumsum(new_bucket) - 1
    first = doc == doc[np.flatnonzero(new_class)][classes]
    yield ranges_frame(False, *merged(*(x[~first] for x in (doc, copy, start, start + n + (length - 1)))))
    apart = (np.bincount(number[new_class]) > 1)[number] & first
    doc, copy, start, off, n, side, number = (x[apart] for x in (doc, copy, start, off, n, side, number.astype(np.uint64)))
    left, right, most = side >> np.uint64(16), side & np.uint64(0xFFFF), length - q
    # a string whose q-gram stands `o` bytes after its start holds SIDE bytes before it if o >= SIDE, and after it if o <= most - SIDE
    for lo, hi in ((0, min(SIDE, most - SIDE + 1) - 1), (SIDE, most - SIDE), (max(SIDE, most - SIDE + 1), most), (most - SIDE + 1, SIDE - 1)):
        o0, o1 = np.maximum(off - n + 1, lo), np.minimum(off, hi)
        here = np.flatnonzero(o0 <= o1)
        if not len(here):
            continue
        bits = (left[here] << np.uint64(16) if lo >= SIDE else np.uint64(0)) | (right[here] if hi <= most - SIDE else np.uint64(0))
        key = number[here] << np.uint64(32) | bits
        by = np.argsort(key, kind="stable")
        here = here[by][_shared(key[by], doc[here][by])]
        begin = start[here] + (off[here] - o1[here])
        yield ranges_frame(True, doc[here], copy[here], begin, begin + (o1[here] - o0[here]) + 1)


def window_ids(data: np.ndarray, length: int, q: int) -> np.ndarray:
    """The identity of each string of `length` bytes: the bucket identifiers of the q-grams that cover it, put together."""
    ids = window_hashes(data, q)
    k, out = len(data) - length + 1, None
    for offset in [*range(0, length - q, q), length - q]:
        part = ids[offset : offset + k]
        out = part.copy() if out is None else mixed(out * np.uint64(BASE) + part)
    return out


def _batched(made: Iterator[dict[str, np.ndarray]], keys: tuple[str, str], length: int, parts: int) -> Iterator[pd.DataFrame]:
    """dealt() of some million rows at a time."""
    held, size = [], 0

    def out() -> pd.DataFrame:
        rows = {c: np.concatenate([h[c] for h in held]) for c in held[0]}
        return dealt(rows, keys, rows["n"].astype(np.int32) + (length - 1) if "n" in rows else np.full(size, length, dtype=np.int32), parts)

    for rows in made:
        held.append(rows)
        size += len(rows["doc"])
        if size >= HELD:
            yield out()
            held, size = [], 0
    if size:
        yield out()


def repeated_ranges(docs: DataFrame, length: int = 50, q: int = 20) -> DataFrame:
    """doc, copy and ranges (start, end in bytes; they may overlap) that cover what a smaller document holds as well.

    docs: doc (long, not null), copy (long, which tells rows of one doc with different texts apart) and text."""
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()["bytes"]
    usual = shuffle_partitions(docs.sparkSession)
    parts = max(usual, math.ceil(total * 2 / (length - q + 2) / PER_PART))

    def stretched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def every() -> Iterator[dict[str, np.ndarray]]:
            for b in batches:
                doc, copy = b["doc"].to_numpy(), b["copy"].to_numpy()
                for rows in stretches(b["text"], length, q):
                    text = rows.pop("text")
                    yield {c: doc[text] if c == "doc" else copy[text] if c == "copy" else rows[c] for c in STRETCH}

        return _batched(every(), ("bucket", "deep"), length, parts)

    def one_part(rows: pd.DataFrame) -> pd.DataFrame:
        got, known = received(rows, STRETCH)
        return pd.concat([known, *refined(got, length, q)], ignore_index=True)

    found = save(docs.mapInPandas(stretched, _sent(STRETCH)).groupBy("part").applyInPandas(one_part, RANGE), "stretches")
    asked = found.where("open").groupBy("doc", "copy").agg(F.collect_list(F.struct("start", "end")).alias("places"))
    strings = found.where("open").agg(F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0)).alias("n")).first()["n"]
    more = max(usual, math.ceil(strings / PER_PART))

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def every() -> Iterator[dict[str, np.ndarray]]:
            for b in batches:
                for doc, copy, text, places in zip(b["doc"], b["copy"], b["text"], b["places"], strict=True):
                    data = _bytes(text)
                    wanted = np.zeros(len(data) + 1, dtype=np.int32)
                    np.add.at(wanted, np.array([p["start"] for p in places]), 1)
                    np.add.at(wanted, np.array([p["end"] for p in places]), -1)
                    start = np.flatnonzero(np.cumsum(wanted) > 0).astype(np.int32)
                    one, two = window_ids(data, length, q)[start], window_hashes(data, length)[start]
                    yield {"one": one, "two": two, "doc": np.full(len(start), doc), "copy": np.full(len(start), copy), "start": start}

        return _batched(every(), ("one", "two"), length, more)

    def pointed(rows: pd.DataFrame) -> pd.DataFrame:
        got, known = received(rows, STRING)
        order = np.lexsort((got["doc"], got["two"], got["one"]))
        one, two, doc = got["one"][order], got["two"][order], got["doc"][order]
        new = np.r_[True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])]
        late = order[doc > doc[np.flatnonzero(new)][np.cumsum(new) - 1]] if len(order) else order
        start = got["start"][late]
        return pd.concat([known, ranges_frame(False, *merged(got["doc"][late], got["copy"][late], start, start + length))], ignore_index=True)

    texts = docs.join(asked, ["doc", "copy"]).select("doc", "copy", "text", "places")
    single = save(texts.mapInPandas(compared, _sent(STRING)).groupBy("part").applyInPandas(pointed, RANGE), "strings")
    both = found.where("not open").union(single).groupBy("doc", "copy").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))
    made = save(both, "ranges")
    discard(found, single)
    return made


def covered(size: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of `size` bytes lie in at least one range."""
    depth = np.zeros(size + 1, dtype=np.int64)
    np.add.at(depth, starts, 1)
    np.add.at(depth, ends, -1)
    return np.cumsum(depth[:-1]) > 0


def told_apart(docs: DataFrame) -> DataFrame:
    """docs (doc, text) with `copy`: 0, or a number of the text where rows of one doc have different texts."""
    number = F.xxhash64("text")
    several = save(docs.where("doc is not null").groupBy("doc").agg(F.min(number).alias("lo"), F.max(number).alias("hi")).where("lo < hi").select("doc", F.lit(True).alias("several")), "several")
    if several.isEmpty():
        return docs.withColumn("copy", F.lit(0).cast("long"))
    return docs.join(several, "doc", "left").select("doc", "text", F.when(F.col("several"), number).otherwise(F.lit(0)).cast("long").alias("copy"))


def remove_repeats(df: DataFrame, length: int = 50, q: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, kept (the remaining bytes), n_bytes, n_removed and spans (maximal removed runs) of each row of df.

    A byte goes if a string of `length` bytes that covers it also starts in a row with a smaller id. Null texts are
    empty; rows of one id don't remove from each other; rows without an id keep all and remove nothing; other columns
    are not read; an empty table gives an empty result. Texts are shorter than 2 GB. length must exceed q + 1, by less than 127."""
    docs = told_apart(df.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text")))
    ranges = repeated_ranges(docs.where("doc is not null"), length, q)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, text, gone in zip(b["doc"], b["text"], b["ranges"], strict=True):
                data = _bytes(text)
                if gone is None or not len(gone):
                    rows.append((doc, data.tobytes(), len(data), 0, []))
                    continue
                out = covered(len(data), np.array([r["start"] for r in gone]), np.array([r["end"] for r in gone]))
                edge = np.flatnonzero(np.diff(np.concatenate([[0], out.view(np.int8), [0]])))
                spans = [{"start": int(s), "end": int(e)} for s, e in zip(edge[::2], edge[1::2], strict=True)]
                rows.append((doc, data[~out].tobytes(), len(data), int(out.sum()), spans))
            out_ = pd.DataFrame(rows, columns=[id_col, "kept", "n_bytes", "n_removed", "spans"])
            yield out_.astype({id_col: "Int64"})

    joined = docs.join(ranges, ["doc", "copy"], "left").select("doc", "text", "ranges")
    return joined.mapInPandas(cut, f"`{id_col}` long, kept binary, n_bytes long, n_removed long, spans array<struct<start:bigint,end:bigint>>")


def op5_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document keeps when 50-byte strings of smaller documents go, as a digest."""
    made = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))

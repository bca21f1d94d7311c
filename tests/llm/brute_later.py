"""Plain answers for the operators on vectors, filter orders and spellings."""

from __future__ import annotations

import itertools
import math
import re
import zlib
from collections import Counter


def reached(n: int, pairs: list[tuple[int, int]]) -> list[set[int]]:
    """The nodes that each of n nodes reaches, itself included."""
    out, todo = [{i} for i in range(n)], list(pairs)
    for a, b in todo:
        if out[a] is not out[b]:
            out[a] |= out[b]
            for x in out[a]:
                out[x] = out[a]
    return out


def near_vectors(rows: list[tuple], threshold: float) -> list[tuple]:
    """(id, links, component) of each row, by comparing all with all."""

    def cosine(a, b):
        if a is None or b is None or len(a) != len(b) or any(x is None or not math.isfinite(x) for x in [*a, *b]):
            return -2.0
        x, y = math.fsum(v * v for v in a), math.fsum(v * v for v in b)
        return math.fsum(p * q for p, q in zip(a, b, strict=True)) / math.sqrt(x) / math.sqrt(y) if x and y else -2.0

    pairs = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if cosine(rows[i][1], rows[j][1]) >= threshold]
    sets, links = reached(len(rows), pairs), Counter(x for p in pairs for x in p)
    least = [min((rows[k][0] for k in s if rows[k][0] is not None), default=None) for s in sets]
    return [(rows[i][0], links[i], least[i]) for i in range(len(rows))]


def audit(docs: list[tuple], labels: list[tuple]) -> dict[tuple, tuple]:
    """The counters by (part, order, step), by running each order; docs: (id, text, lang)."""

    def fails(i, text):
        words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
        out = {"A"} if len(words) < 100 else set()
        out |= {"B"} if 100 * len(set(words)) < 80 * len(words) else set()
        out |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 10 * len(text) else set()
        out |= {"D"} if re.search("[#$%&*|]", text) else set()
        return out | ({"E"} if i is not None and any(j is not None and j < i and t == text for j, t, _ in rows) else set())

    rows = [(i, t or "", lang or "") for i, t, lang in docs]
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, x in labels if x == 1}
    failing = [(i, part, fails(i, t)) for i, t, part in rows]
    out, removed_by = {}, Counter()
    for part in {p for _, p, _ in failing}:
        for order in map("".join, itertools.permutations("ABCDE")):
            alive = [(i, f) for i, p, f in failing if p == part]
            everyone = list(alive)
            for k, letter in enumerate(order):
                removed = [(i, f) for i, f in alive if letter in f]
                redundant = sum(letter in f for _, f in everyone) - len(removed)
                alive = [(i, f) for i, f in alive if letter not in f]
                removed_by[part, letter] += len(removed)
                lost = [i for i, _ in removed if i is not None]
                only = sum(f == {letter} for _, f in everyone)
                out[part, order, k + 1] = (len(alive), len(removed), redundant, only, sum(i in good for i in lost), sum(i in toxic for i in lost))
    return {k: (*v, removed_by[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def spelling(docs: list[tuple]) -> dict[str, tuple]:
    """(form, root, n, n_near, form_n) by word; docs: (id, text)."""
    n: Counter[str] = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{low}".encode())
            n[low if h % 97 else low[: h % len(low)] + low[h % len(low) + 1 :]] += 1
    words = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    around = {w: [v for v in words if near(w, v)] for w in words}
    form = {}
    for w, c in words.items():
        best = min(around[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 2 * c else None
    out = {}
    for w, c in words.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, c, len(around[w]), words.get(form[w]))
    return out

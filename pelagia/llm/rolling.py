"""Polynomial hashes of words and of byte strings, for whole batches of texts at once."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

#: Fixed value: an odd multiplier; its powers modulo 2^64 never vanish, and its inverse is below.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)

#: Bytes of a word: ASCII letters and digits, and all of what is not ASCII; letters A-Z count as a-z.
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[ord("A") : ord("Z") + 1] += 32
IN_WORD = np.zeros(256, dtype=bool)
IN_WORD[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(128, 256)]] = True
#: Bytes of what stands between the six ASCII white-space characters.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on unsigned longs that spreads its input over all bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def chunks(texts: Sequence[str | None], most: int = 1 << 21, lower: bool = False) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, UTF-8 bytes) of runs of texts of about `most` bytes; a longer text is a run of its own."""
    first, held, size = 0, [], 0
    for i, t in enumerate(texts):
        raw = ((t or "").lower() if lower else t or "").encode("utf-8", "surrogatepass")
        if held and size + len(raw) > most:
            yield first, held
            first, held, size = i, [], 0
        held.append(raw)
        size += len(raw)
    if held:
        yield first, held


def word_hashes(raws: Sequence[bytes], in_word: np.ndarray = IN_WORD) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, index of its text), words in order over all texts of a run; in_word: which bytes make words."""
    data = LOWERED[np.frombuffer(b" ".join(raws) + b" ", dtype=np.uint8)]
    inside = in_word[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]
    up, down = powers(BASE, len(data)), powers(INVERSE, len(data))
    total = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, dtype=np.uint64)])
    values = (total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64)
    limits = np.cumsum([len(r) + 1 for r in raws])
    return mixed(values), np.searchsorted(limits, starts, side="right")


def ngram_hashes(words: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """The hash of the n-gram that starts at each word; zero where it would leave its text."""
    return spread_hashes(words, text, range(n))


def spread_hashes(words: np.ndarray, text: np.ndarray, places: Sequence[int]) -> np.ndarray:
    """The hash of the words at these places from each word, whatever the places; zero where one would leave its text."""
    out = np.zeros(len(words), dtype=np.uint64)
    k = len(words) - places[-1]
    if k > 0:
        value = words[:k].copy()
        for i in places[1:]:
            value = value * np.uint64(BASE) + words[i : i + k]
        whole = text[:k] == text[places[-1] :]
        out[:k] = np.where(whole, np.maximum(mixed(value), np.uint64(1)), np.uint64(0))
    return out


def window_hashes(data: np.ndarray, n: int) -> np.ndarray:
    """The hash of each n-byte string of a byte array; equal strings have equal hashes wherever they are.

    By doubling: hashes of 1, 2, 4, ... bytes are put together for the binary digits of n."""
    k = len(data) - n + 1
    if k <= 0:
        return np.zeros(0, dtype=np.uint64)
    value, power, width, at = None, data.astype(np.uint64), 1, 0
    power += np.uint64(1)
    while True:
        factor = np.uint64(pow(BASE, width, 1 << 64))
        if n & width:
            value = power[at : at + k].copy() if value is None else value * factor
            if at:
                value += power[at : at + k]
            at += width
        if at == n:
            break
        wider = power[:-width] * factor
        wider += power[width:]
        power, width = wider, width * 2
    value ^= value >> np.uint64(32)
    value *= np.uint64(0xC4CEB9FE1A85EC53)
    value ^= value >> np.uint64(29)
    return value

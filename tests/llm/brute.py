"""Plain answers for small fixtures, which the operators' results must equal."""

from __future__ import annotations

import hashlib

import numpy as np


def repeats(rows: list[tuple[int, str | None]], length: int = 50) -> dict[int, tuple[int, int, int, str]]:
    """(n_bytes, n_removed, n_spans, kept_sha256) by id, with a dictionary of all strings."""
    first: dict[bytes, int] = {}
    texts = {i: (t or "").encode() for i, t in rows}
    for i, t in texts.items():
        for p in range(len(t) - length + 1):
            s = t[p : p + length]
            first[s] = min(i, first.get(s, i))
    out = {}
    for i, t in texts.items():
        gone = np.zeros(len(t) + 1, dtype=bool)
        for p in range(len(t) - length + 1):
            if first[t[p : p + length]] < i:
                gone[p : p + length] = True
        runs = int(np.sum(gone[1:-1] & ~gone[:-2])) + int(gone[0]) if t else 0
        out[i] = (len(t), int(gone[:-1].sum()), runs, hashlib.sha256(bytes(b for b, g in zip(t, gone[:-1], strict=True) if not g)).hexdigest())
    return out

"""Secret scans with a recursive decoding worklist.

A text is the first layer. Each layer is scanned with the base patterns and then unwrapped: its URL and Unicode escapes
give one new layer of the whole text, each base64 run gives a layer of its own, inflated first where the bytes
are compressed, and so do compressed bytes in URL escapes. Bytes that are not UTF-8 are read as Latin-1, so every decoded
layer is scanned. A layer equal to one that it came from ends its branch, so the worklist reaches a fixpoint. Each layer
maps spans to the layer that it came from, so a finding in the fourth layer still has a place in the document.

Escapes of escapes give a layer for each of the first DEEP levels; deeper ones are resolved together in one pass over the
text, so a text costs time in proportion to its length however deep it is nested.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import accumulate
from urllib.parse import unquote_to_bytes

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession

from pelagia.llm.common import table

#: The kinds of secrets in their order, with their patterns; `assign` needs 6 characters in group 2.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
UNICODE = re.compile(r"(?:\\u[0-9A-Fa-f]{4})+|\\U[0-9A-Fa-f]{8}|\\u\{[0-9A-Fa-f]{1,6}\}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};")
#: A run of escapes of either kind.
ESCAPES = re.compile(rf"{URL.pattern}|{UNICODE.pattern}")
WRAPPED = re.compile(r"(?:[A-Za-z0-9+/]{60,76}\r?\n)+[A-Za-z0-9+/]{1,76}={0,2}")
#: The shortest secret, an assignment of 12 characters, takes 16 in base64.
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
PIECE = re.compile(r"[A-Za-z0-9]{16,}={0,2}")
#: Control characters that no written text holds.
CONTROL = re.compile(r"[\x00-\x08\x0b\x0e-\x1f\x7f]")

#: Compressed bytes in URL escapes, by the magic numbers of gzip, bzip2, xz, zstd and zlib; then what quoting leaves.
PACKED_URL = re.compile(r"(?:%1[fF]%8[bB]|BZh|%[fF][dD]7zXZ|(?:%28|\()%[bB]5(?:%2[fF]|/)%[fF][dD]|(?:%78|x)%(?:01|5[eE]|9[cC]|[dD][aA]))(?:%[0-9A-Fa-f]{2}|[A-Za-z0-9_.~/+-])+")
#: One escape at the end of a text, and the characters that can end one.
ONE_ESCAPE = re.compile(rf"(?:%[0-9A-Fa-f]{{2}}|\\u[0-9A-Fa-f]{{4}}|{UNICODE.pattern.split('|', 1)[1]})\Z")
ESCAPE_ENDS = frozenset("0123456789abcdefABCDEF;}")
#: Levels of escapes of escapes that are layers of their own.
DEEP = 16
#: Characters of an inflated layer that are scanned together, and how many of them two neighbouring parts share.
PART, OVERLAP = 16 << 20, 1 << 20

Span = tuple[str, int, int]


@dataclass
class Layer:
    """A text with the layer that it came from; to_parent maps a span of this text to one of the parent's."""

    text: str
    parent: Layer | None = None
    to_parent: Callable[[int, int], tuple[int, int]] | None = None
    escapes: int = 0

    def span(self, start: int, end: int) -> tuple[int, int]:
        here = self
        while here.parent is not None:
            start, end = here.to_parent(start, end)
            here = here.parent
        return start, end


def base_spans(text: str) -> list[Span]:
    """Leftmost matches of each kind that do not overlap within it."""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return found


def _unescaped(match: re.Match) -> str | None:
    s = match[0]
    try:
        if s.startswith("&#"):
            return chr(int(s[3:-1], 16) if s[2] in "xX" else int(s[2:-1]))
        if s.startswith("\\u{"):
            return chr(int(s[3:-1], 16))
        if s.startswith("\\u"):
            units = b"".join(int(s[i + 2 : i + 6], 16).to_bytes(2, "big") for i in range(0, len(s), 6))
            return units.decode("utf-16-be")
        return chr(int(s[2:], 16))
    except (ValueError, OverflowError):
        return None


def _read(data: bytes) -> str:
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("latin-1")


def _unescaped_run(match: re.Match) -> str | None:
    return _read(unquote_to_bytes(match[0])) if match[0][0] == "%" else _unescaped(match)


def _resolved(layer: Layer) -> Layer | None:
    """The whole text with all escapes decoded from left to right, and again where that makes new ones, in one pass."""
    out: list[str] = []
    begin: list[int] = []
    until: list[int] = []
    changed = False
    for i, c in enumerate(layer.text):
        out.append(c)
        begin.append(i)
        until.append(i + 1)
        while out[-1] in ESCAPE_ENDS:
            m = ONE_ESCAPE.search("".join(out[-12:]))
            got = (chr(int(m[0][1:], 16)) if m[0][0] == "%" else _unescaped(m)) if m else None
            if not got or 0xD800 <= ord(got[0]) <= 0xDFFF:
                break
            k = len(m[0])
            first, last = begin[-k], until[-1]
            del out[-k:], begin[-k:], until[-k:]
            out.append(got)
            begin.append(first)
            until.append(last)
            changed = True
    return Layer("".join(out), layer, lambda a, b: (begin[a], until[max(a, b - 1)])) if changed else None


def _replaced(layer: Layer, pattern: re.Pattern, decode: Callable[[re.Match], str | None]) -> Layer | None:
    """The whole text with each match decoded; a span inside a decoded run maps to the whole run, others shift."""
    out, new_at, old_at, last, size = [], [0], [0], 0, 0
    whole: list[bool] = [False]
    for m in pattern.finditer(layer.text):
        got = decode(m)
        if got is None or not got or any(0xD800 <= ord(c) <= 0xDFFF for c in got):
            continue
        out += [layer.text[last : m.start()], got]
        size += m.start() - last
        for at, old, w in ((size, m.start(), True), (size + len(got), m.end(), False)):
            new_at.append(at)
            old_at.append(old)
            whole.append(w)
        size += len(got)
        last = m.end()
    if not out:
        return None
    out.append(layer.text[last:])
    new_at.append(1 << 62)
    old_at.append(len(layer.text))

    def back(start: int, end: int) -> tuple[int, int]:
        i, j = bisect_right(new_at, start) - 1, bisect_right(new_at, max(start, end - 1)) - 1
        first = old_at[i] if whole[i] else old_at[i] + start - new_at[i]
        return first, old_at[j + 1] if whole[j] else old_at[j] + end - new_at[j]

    return Layer("".join(out), layer, back, layer.escapes + 1)


def _streams(data: bytes) -> Iterator[bytes]:
    """What compressed bytes stand for, in pieces: all members one after the other; nothing if they are not compressed."""
    kind = None
    while data:
        if data[:2] == b"\x1f\x8b" or (len(data) > 2 and data[0] == 0x78 and (data[0] * 256 + data[1]) % 31 == 0):
            kind, one = "zlib", zlib.decompressobj(wbits=47)
        elif data[:3] == b"BZh":
            kind, one = "bz2", bz2.BZ2Decompressor()
        elif data[:6] == b"\xfd7zXZ\x00":
            kind, one = "xz", lzma.LZMADecompressor()
        elif data[:4] == b"\x28\xb5\x2f\xfd":
            with zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True) as reader:
                while got := reader.read(1 << 20):
                    yield got
            return
        elif kind is None and len(data) >= 12 and _is_deflate(data):
            kind, one = "zlib", zlib.decompressobj(wbits=-15)
        else:
            return
        while data and not one.eof:
            got = one.decompress(data, 1 << 20)
            if kind == "zlib":
                data = one.unconsumed_tail
                if not got and not data:
                    break
            else:
                data = b""
            if got:
                yield got
            while kind != "zlib" and not one.eof and not one.needs_input:
                yield one.decompress(b"", 1 << 20)
        data = one.unused_data if one.eof else b""


def _is_deflate(data: bytes) -> bool:
    """Whether all bytes are one whole raw deflate stream, read in pieces."""
    one = zlib.decompressobj(wbits=-15)
    try:
        while data and not one.eof:
            if not one.decompress(data, 1 << 20) and not one.unconsumed_tail:
                break
            data = one.unconsumed_tail
    except zlib.error:
        return False
    return one.eof and not one.unused_data


def _inflated(data: bytes) -> Iterator[bytes]:
    """_streams in overlapping parts of PART bytes; what comes before a fault counts."""
    held = b""
    try:
        for piece in _streams(data):
            held += piece
            if len(held) >= PART:
                yield held
                held = held[-OVERLAP:]
    except (OSError, EOFError, zlib.error, lzma.LZMAError, zstandard.ZstdError, ValueError):
        pass
    if held:
        yield held


def _unpacked(data: bytes) -> tuple[list[bytes] | Iterator[bytes], bool]:
    """The parts that bytes stand for, inflated as often as they are compressed, and whether they were."""
    first = next(found := _inflated(data), None)
    if first is None:
        return [data], False

    def parts() -> Iterator[bytes]:
        for p in (q for part in ([first], found) for q in part):
            if p == data:  # a stream that inflates to itself
                yield p
            else:
                yield from _unpacked(p)[0]

    return parts(), True


def _decoded(run: str) -> bytes | None:
    """The bytes of a base64 run; a last digit that no byte needs is left over."""
    body = run.rstrip("=").translate({45: 43, 95: 47})
    if len(body) % 4 == 1:
        body = body[:-1]
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4))
    except (binascii.Error, ValueError):
        return None


def _from_bytes(layer: Layer, start: int, end: int, data: bytes, places: list[int]) -> Iterator[Layer]:
    """Layers of the bytes that stand between start and end; places: where each base64 digit is, empty for other bytes."""
    parts, inflated = _unpacked(data)
    if inflated or not places:
        for part in parts if inflated else ():
            yield Layer(_read(part), layer, lambda a, b: (start, end))
        return
    text = _read(data)
    byte = None if len(text) == len(data) else [0, *accumulate(len(c.encode()) for c in text)]

    def back(a: int, b: int) -> tuple[int, int]:
        first, last = (a, b) if byte is None else (byte[a], byte[b])
        return places[first // 3 * 4], places[min(len(places), -(-last // 3) * 4) - 1] + 1

    yield Layer(text, layer, back)


def _is_text(data: bytes) -> bool:
    try:
        return not CONTROL.search(data.decode("utf-8"))
    except UnicodeDecodeError:
        return False


def _from_base64(layer: Layer, tried: set[tuple[str, tuple[int, int]]]) -> Iterator[Layer]:
    """Layers of the layer's base64 runs; a run that an earlier layer held at the same place, as tried tells, is done.

    A run with signs between letters can be several runs, so its pieces are tried unless the whole is text or compressed."""
    whole_from, whole_to = [], []

    def attempt(start: int, end: int) -> list[Layer]:
        run = layer.text[start:end]
        if (key := (run, layer.span(start, end))) in tried:
            return []
        tried.add(key)
        data = _decoded(run.replace("\r", "").replace("\n", ""))
        if data is None or len(data) < 6:
            return []
        return list(_from_bytes(layer, start, end, data, [start + i for i, c in enumerate(run) if c not in "\r\n="]))

    for m in WRAPPED.finditer(layer.text):
        if made := attempt(m.start(), m.end()):
            whole_from.append(m.start())
            whole_to.append(m.end())
            yield from made
    for m in BASE64.finditer(layer.text):
        at = bisect_right(whole_from, m.start()) - 1
        if at >= 0 and m.start() < whole_to[at]:
            continue
        yield from attempt(m.start(), m.end())
        if re.search(r"[/_+-]", m[0]) and not ((data := _decoded(m[0])) and (_is_text(data) or next(_inflated(data), None))):
            for p in PIECE.finditer(layer.text, m.start(), m.end()):
                if p.span() != m.span():
                    yield from attempt(p.start(), p.end())
    for m in PACKED_URL.finditer(layer.text) if "%" in layer.text else ():
        yield from _from_bytes(layer, m.start(), m.end(), unquote_to_bytes(m[0].replace("+", " ")), [])


def unwrapped(layer: Layer, tried: set[tuple[str, tuple[int, int]]]) -> Iterator[Layer]:
    made = _replaced(layer, ESCAPES, _unescaped_run) if layer.escapes < DEEP else _resolved(layer)
    if made is not None:
        yield made
    yield from _from_base64(layer, tried)


def scan(text: str | None) -> tuple[list[Span], list[Span], int]:
    """(base spans, all spans, number of layers) of a text, each list by start and then in the order of KINDS."""
    root = Layer(text or "")
    base = base_spans(root.text)
    spans, seen, tried, work = set(base), set(), set(), [root]
    while work:
        layer = work.pop()
        for made in unwrapped(layer, tried):
            digest = hashlib.md5(made.text.encode("utf-8", "surrogatepass")).digest()
            place = made.span(0, len(made.text)) if made.text else None
            if place is None or (digest, place) in seen:
                continue
            up = layer
            while up is not None and up.text != made.text:
                up = up.parent
            if up is not None:  # a layer that decodes to one of its ancestors
                continue
            seen.add((digest, place))
            spans.update((kind, *made.span(a, b)) for kind, a, b in base_spans(made.text))
            work.append(made)
    order = lambda s: (s[1], KINDS.index(s[0]), s[2])
    return sorted(base, key=order), sorted(spans, key=order), len(seen) + 1


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: id_col, base and spans (arrays of kind, start, end in code points), n_layers.

    Null and empty texts have no spans; repeated rows, repeated ids and null ids are answered row by row; an empty table
    gives an empty result; other columns, whatever their names, are not read. Spans of one place and kind count once.
    Inflated bytes are read in overlapping parts of 16 MB, so a run within them of over 1 MB can be cut at a part's end."""
    span = "array<struct<kind:string,start:bigint,end:bigint>>"

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [scan(t) for t in b[text_col]]
            as_rows = lambda spans: [{"kind": k, "start": s, "end": e} for k, s, e in spans]
            yield pd.DataFrame({id_col: b[id_col], "base": [as_rows(g[0]) for g in got], "spans": [as_rows(g[1]) for g in got], "n_layers": [g[2] for g in got]})

    kind = dict(df.dtypes)[id_col]
    return df.select(id_col, text_col).mapInPandas(found, f"`{id_col}` {kind}, base {span}, spans {span}, n_layers bigint")


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their base spans counted and digested, and all spans."""
    from pyspark.sql import functions as F

    found = find_secrets(table(spark, sf_dir, "documents"))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *(count(k) for k in KINDS), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), "n_layers")

"""Each operator on awkward inputs, against plain versions where SQL has none."""

from __future__ import annotations

import base64
import bz2
import gzip
import hashlib
import lzma
import re
import urllib.parse
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from brute import repeats
from pelagia.llm import chat, components, decontamination, html, mixing, neighbours, secrets, sharding, similar, simhash, substrings, toxicity
from pelagia.llm.queries import ORACLES, QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977} other{i % 31}" for i in range(6000))


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns whose names operators use."""
    rows = [
        (1, "the quick brown fox jumps over the lazy dog and runs far away from here today", "en", "a", 1),
        (2, "the quick brown fox jumps over the lazy dog and runs far away from here today", "en", "a", 1),
        (2, "the quick brown fox jumps over the lazy dog and runs far away from here today", "en", "a", 1),
        (3, None, None, None, None),
        (4, "", "en", "b", 0),
        (5, LONG, "en", "b", 5),
        (6, LONG + " tail", "en", None, 5),
        (None, "no id at all", "en", "a", 3),
        (7, "ÀÉ ünïcode \U0001f600 text with several words in a line of its own", "fr", "c", 4),
    ]
    return spark.createDataFrame(rows, DOCS).select("*", *(F.lit("x").alias(c) for c in ("_size", "shard", "slot", "_k", "features", "score", "spans", "group", "fp", "_row", "key")))


def test_secrets_unwrap_layers_and_map_spans():
    inner = "password=hunter22 ok"
    packed = base64.b64encode(gzip.compress(inner.encode())).decode()
    twice = base64.b64encode(f"data {packed}".encode()).decode()
    for text, kind, start, end in (
        (f"zz {twice} yy", "assign", None, None),
        ("a " + urllib.parse.quote("token: abcdef123", "") + " b", "assign", 2, 22),
        ("a \\u0074oken=abcdefgh b", "assign", 2, 21),
        ("q " + base64.b64encode(b"secret=abcdefgh").decode() + " r", "assign", 2, 22),
        ("AKIA" + "Q" * 16, "access", 0, 20),
        ("x " + "0f" * 12 + " y", "hex", 2, 26),
    ):
        base, spans, _ = secrets.scan(text)
        found = [s for s in spans if s[0] == kind]
        assert found, text
        assert set(base) <= set(spans)
        if start is not None:
            assert found[0][1:] == (start, end)
    assert secrets.scan(None)[:2] == ([], []) and secrets.scan("secret=abc")[0] == []
    assert secrets.scan("Token = 'abcdef'")[0] == [("assign", 0, 15)]


def _levels(text, depth=5):
    """Kinds found in a text and in what it decodes to, level by level, by other means than the operator's."""
    kinds = {k for k, _, _ in secrets.base_spans(text)}
    if depth:
        whole = urllib.parse.unquote(text, errors="replace")
        pieces = [whole] if whole != text else []
        for run in re.findall(r"[A-Za-z0-9+/]{16,}={0,2}", text):
            try:
                data = base64.b64decode(run)
            except ValueError:
                continue
            for open_ in (gzip.decompress, bz2.decompress, lzma.decompress, lambda x: zlib.decompress(x, -15), bytes):
                try:
                    pieces.append(open_(data).decode("latin-1"))
                except (OSError, EOFError, ValueError, zlib.error, lzma.LZMAError):
                    continue
        for p in pieces:
            kinds |= _levels(p, depth - 1)
    return kinds


@pytest.mark.parametrize("seed", range(30))
def test_random_wrappings_are_unwrapped(seed):
    rng = np.random.default_rng(seed)
    raw = zlib.compressobj(wbits=-15)
    wraps = [
        lambda t: base64.b64encode(t.encode()).decode(),
        lambda t: base64.b64encode(gzip.compress(t.encode("utf-8"))).decode(),
        lambda t: base64.b64encode(bz2.compress(t.encode())).decode(),
        lambda t: base64.b64encode(lzma.compress(t.encode())).decode(),
        lambda t: base64.b64encode(raw.copy().compress(t.encode()) + (lambda z: z.compress(t.encode()) + z.flush())(raw.copy())).decode(),
        lambda t: urllib.parse.quote(t, ""),
    ]
    text = "é\u00a0 ok password=hunter2222 " + "0f" * 13
    for k in rng.integers(0, len(wraps), 3):
        text = f"before {wraps[k](text)} after"
    assert _levels(text) <= {k for k, _, _ in secrets.scan(text)[1]}
    assert {"assign", "hex"} <= {k for k, _, _ in secrets.scan(text)[1]}


def test_layers_of_any_bytes_are_scanned():
    for data in ("mot de passe é: token=abcdef99".encode("latin-1"), b"x\0y token=abcdef99", b"\xfftoken=abcdef99 zz", gzip.compress(b"nothing ") + gzip.compress(b"token=abcdef99")):
        text = f"q {base64.b64encode(data).decode()} r"
        assert any(k == "assign" for k, _, _ in secrets.scan(text)[1]), data
    quoted = urllib.parse.quote(gzip.compress(b"token=abcdef99 and more"), safe="")
    assert ("assign", 2, 2 + len(quoted)) in secrets.scan(f"q {quoted} r")[1]


def test_deep_escapes_cost_linear_time():
    import time

    began = time.time()
    for text in ("%" + "25" * 20_000 + "41", "&" + "#38;" * 5_000 + "#65;", "\\u005c" + "u005c" * 5_000 + "u0041"):
        assert secrets.scan(text)[2] <= 2 * secrets.DEEP + 4
    assert time.time() - began < 8
    for levels in (12, 18):
        text = "secret%" + "25" * levels + "3Dabcdefgh"
        assert ("assign", 0, len(text)) in secrets.scan(text + ";")[1]


def test_secrets_of_awkward_rows(spark, awkward):
    rows = secrets.find_secrets(awkward.union(awkward)).collect()
    assert len(rows) == 2 * awkward.count() and all(r["n_layers"] == 1 for r in rows if r["doc_id"] in (3, 4))
    assert secrets.find_secrets(awkward.where("false")).count() == 0


def test_a_layer_that_decodes_to_itself_ends():
    assert secrets.scan("%25" * 50 + "%41")[2] < 100


@pytest.mark.parametrize("seed", range(3))
def test_base_spans_equal_the_contract(seed):
    import re

    rng = np.random.default_rng(seed)
    words = ["token", "=", ":", " ", "api_key", "passwd", '"', "abc", "ABCDEF", "AKIA", "Z9" * 9, "0a" * 7, "/", "secret", "é", "\n"]
    text = "".join(rng.choice(words, 400))
    want = [("assign", m.start(), m.end()) for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    want += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    want += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    assert sorted(secrets.base_spans(text)) == sorted(want)


def test_pages_keep_the_article_only():
    page = """<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><a href=x>Home</a></nav>
    <div class="cookie-notice">We use cookies</div><div id="content"><h2>Head &amp; more</h2><p>First  para <b>bo</b>ld.<p>Second<br>line with text enough to be the article.</p>
    <form><input value=q>Search</form><script>var a="<p>no</p>"</script></div><aside>Related</aside><div class="comments"><p>Nice!</p></div><footer>&copy; me</footer></body></html>"""
    assert html.extract(page) == "Head & more First para bold. Second line with text enough to be the article."
    assert html.extract(None) == "" and html.extract("") == "" and html.extract("<nav>a</nav>") == ""
    assert html.extract("just text &lt;here") == "just text <here"
    assert html.extract("<p>" * 3000 + "deep") == "deep"


#: Pages with what is the article marked by hand.
LABELLED = [
    ('<div class="content with-sidebar"><p>real article body text</p></div>', "real article body text"),
    ('<article><h1>On science</h1><div class="social-science"><p>Social science is a field of study.</p></div><div class="social-share"><a href=x>Share</a></div></article>', "On science Social science is a field of study."),
    ('<body><div id="site-header">Logo</div><div class="post"><div class="post-header"><h1>Title here</h1></div><p>Body of the post, which is long enough.</p></div><ul class="main-menu"><li><a>a</a></ul></body>', "Title here Body of the post, which is long enough."),
    ('<main><p>One paragraph with words, and a <a href="x">link</a> in it.</p><ul><li>first point<li>second point</ul></main><div class="comment-list"><p>me too</p></div>', "One paragraph with words, and a link in it. first point second point"),
    ('<body><nav><a href="/">Home</a></nav><table><tr><td>Cell one text<td>Cell two text</table><div class="cookie-banner">We use cookies</div></body>', "Cell one text Cell two text"),
    ('<p title="a > b">Greater &gt; than</p><!-- <p>no</p> --><p>5 < 6 and more</p>', "Greater > than 5 < 6 and more"),
]


@pytest.mark.parametrize("page, article", LABELLED)
def test_labelled_pages(page, article):
    assert html.extract(page) == article


def test_hostile_markup_is_read_in_linear_time():
    import time

    began = time.time()
    for part in ('<a b="', "<a ", "<![CDATA[", "</x>", "<p></div>", "<!-- ", "<a b='\">", '<i a="> ', "<li>", "<p", "&#", "<b><p></b>"):
        html.extract(part * (1_000_000 // len(part)) if part not in ("<li>", "<p></div>", "<b><p></b>") else part * 20_000)
    assert time.time() - began < 30


def test_pages_of_awkward_rows(spark):
    rows = [(1, None, None, "x"), (1, "", "u", None), (2, "<p>" + "long text " * 100_000, "u", "x"), (2, "<p>same", "u", "x"), (2, "<p>same", "u", "x"), (None, "plain", None, None)]
    made = html.main_text(spark.createDataFrame(rows, "page_id long, html string, url string, text string"))
    assert made.columns == ["page_id", "url", "text"]
    assert sorted(len(r["text"]) for r in made.collect()) == [0, 0, 4, 4, 5, 999_999]
    assert html.main_text(spark.createDataFrame([], "page_id long, html string")).count() == 0


def test_pages_of_the_table(spark, sf):
    rows = QUERIES["op3_html_extraction"](spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/pages.parquet").count()
    assert all(r["n_chars"] == len(r["text"]) > 0 for r in rows)


def test_mix_meets_its_targets(spark, sf):
    rows = QUERIES["op2_mixing"](spark, sf).collect()
    source = {r["doc_id"]: r["source"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    by = {}
    for r in rows:
        assert r["taken"] <= 3 * r["size"] and r["taken"] == r["size"] * len(r["shards"])
        t = by.setdefault(source[r["doc_id"]], [0, 0, r["target"]])
        t[0] += r["taken"]
        t[1] = max(t[1], r["size"])
    assert all(abs(taken - target) <= largest for taken, largest, target in by.values())
    assert sum(t[2] for t in by.values()) == pytest.approx(sum(r["size"] for r in rows))
    assert {(r["doc_id"], tuple(r["shards"])) for r in QUERIES["op2_mixing"](spark, sf).collect()} == {(r["doc_id"], tuple(r["shards"])) for r in rows}


def test_mix_sizes_and_targets_equal_plain_counts(spark, sf):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    size = {i: len(re.findall("[^\x20\x09-\x0d]+", r["text"] or "")) for i, r in docs.items()}
    names = sorted({r["source"] for r in docs.values()}, key=lambda s: (s is None, s or ""))
    of = {s: sum(size[i] for i, r in docs.items() if r["source"] == s) for s in names}
    weight = {s: 1 + k % 3 for k, s in enumerate(names)}
    target, left, open_ = {}, float(sum(of.values())), set(names)
    while True:  # the plain way: cap the worst source, share again
        share = {s: left * weight[s] / sum(weight[t] for t in open_) for s in open_}
        worst = max(open_, key=lambda s: share[s] - 3 * of[s])
        if share[worst] <= 3 * of[worst]:
            target |= share
            break
        target[worst] = 3.0 * of[worst]
        left -= target[worst]
        open_.remove(worst)
    for r in QUERIES["op2_mixing"](spark, sf).collect():
        s = docs[r["doc_id"]]["source"]
        assert (r["size"], r["source_size"]) == (size[r["doc_id"]], of[s]) and r["target"] == pytest.approx(target[s])


def test_water_filling_caps_and_reshares():
    assert mixing.water_fill([10, 1000], [3, 1], 1010) == [30.0, 980.0]
    assert mixing.water_fill([10, 10], [1, 2], 20) == pytest.approx([20 / 3, 40 / 3])


def test_splitting_tree_keeps_quotas():
    t = mixing.splitting_tree([7, 0, 20], 4, 3)
    assert t.sum(axis=1).tolist() == [7, 0, 20] and max(t.sum(axis=0)) - min(t.sum(axis=0)) <= 1


def test_mix_of_awkward_rows(spark, awkward):
    made = mixing.mix(awkward)
    assert made.count() == awkward.count()
    assert set(awkward.columns) <= set(made.columns)
    assert mixing.drawn_rows(made, ["doc_id", "text"]).columns == ["doc_id", "text"]
    assert mixing.mix(awkward.where("false")).count() == 0


def test_benchmark_copies_are_found_and_clean_ones_left(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    words = item.split()
    edited = " ".join(w if i % 7 else "changed" for i, w in enumerate(words))
    docs = spark.createDataFrame([(1, f"before {item} after"), (2, f"x {edited.upper()} y"), (3, "alpha beta gamma delta only"), (4, None), (5, ""), (6, LONG), (6, LONG), (None, item)], "doc_id long, text string")
    bench = spark.createDataFrame([(10, item), (11, None), (12, "too short"), (13, item)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontamination.contaminated(docs, bench).collect()}
    assert set(got) == {(1, 10), (1, 13), (2, 10), (2, 13)}
    assert got[1, 10]["score"] == 1 and (got[1, 10]["start"], got[1, 10]["end"]) == (1, 21)
    assert decontamination.contaminated(docs.where("false"), bench).count() == 0
    assert decontamination.contaminated(docs, bench.where("false")).count() == 0


@pytest.mark.parametrize("replaced", [(4, 9, 13), (4, 9, 14)])
def test_edited_copies_are_found_however_often_they_leaked(spark, replaced):
    words = [f"item{i}" for i in range(17)]
    copy = " ".join("other" if i in replaced else w for i, w in enumerate(words))
    docs = spark.createDataFrame([(i, f"page {i} begins here {copy} and ends") for i in range(60)] + [(60, "nothing of it")], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    got = decontamination.contaminated(docs, items).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(60)) and {round(r["score"], 3) for r in got} == {0.735}


def test_alignment_equals_the_plain_recurrence():
    rng = np.random.default_rng(5)
    for _ in range(20):
        a, b = rng.integers(0, 5, 12), rng.integers(0, 5, 30)
        h = np.zeros((13, 31), dtype=int)
        for i in range(1, 13):
            for j in range(1, 31):
                h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        assert decontamination.align(a, b)[0] == h.max()


def test_repeats_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    want = repeats([tuple(r) for r in docs.collect()])
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in QUERIES["op5_repeated_substrings"](spark, sf).collect()}
    assert got == want


@pytest.mark.parametrize("seed", range(2))
def test_repeats_of_low_entropy_texts(spark, seed):
    rng = np.random.default_rng(seed)
    parts = ["".join(rng.choice(list("ab"), n)) for n in (60, 45, 130, 52)] + ["a" * 200, "é" * 40]
    rows = [(i, "".join(parts[k] for k in rng.integers(0, len(parts), rng.integers(0, 5)))) for i in range(25)]
    made = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], len(r["spans"]), hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in made.collect()}
    assert got == repeats(rows)


def test_repeats_of_one_id_with_many_texts(spark):
    """700 texts of one id: each row gets its own ranges."""
    shared = " ".join(f"common{i}" for i in range(20))
    rows = [(1, shared)] + [(5, "x" * i + shared + "y" * (i % 7)) for i in range(700)]
    got = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 701 and sum(r["n_removed"] for r in got if r["doc_id"] == 5) == 700 * len(shared)
    assert sorted(bytes(r["kept"]).decode() for r in got if r["doc_id"] == 5) == sorted("x" * i + "y" * (i % 7) for i in range(700))


def test_repeats_of_awkward_rows(spark, awkward):
    rows = substrings.remove_repeats(awkward).collect()
    assert len(rows) == awkward.count()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r["n_removed"])
    assert by[1] == [0] and by[2] == [77, 77] and by[None] == [0] and by[3] == [0]
    assert by[6] == [len(LONG)]
    assert substrings.remove_repeats(awkward.where("false")).count() == 0


def _linked(fps: dict[int, int], radius: int) -> dict[int, int]:
    parent = {i: i for i in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(fps)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in ids}


def test_simhash_components_equal_brute_force(spark, sf):
    rows = QUERIES["op6_simhash"](spark, sf).collect()
    fps = {r["doc_id"]: int(r["fingerprint"], 16) for r in rows}
    assert {r["doc_id"]: r["component_id"] for r in rows} == _linked(fps, 4)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    from xxhash import xxh64_intdigest

    for i in list(texts)[:40]:
        words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in texts[i] or "").translate({k: " " for k in range(9, 14)}).split(" ") if w]
        h = [xxh64_intdigest(" ".join(words[k : k + 4]), 42) for k in range(max(1, len(words) - 3))] if words else []
        assert fps[i] == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_links_at_the_radius(spark):
    rng = np.random.default_rng(2)
    base = [int(x) for x in rng.integers(0, 1 << 63, 40)]
    fps = set(base)
    for x in base[:20]:
        for _ in range(4):
            y = x
            for b in rng.choice(63, rng.integers(1, 7), replace=False):
                y ^= 1 << int(b)
            fps.add(y)
    ids = dict(enumerate(sorted(fps)))
    edges = simhash.links(spark.createDataFrame([(v,) for v in ids.values()], "fp long"), 4)
    got = {r["node"]: r["root"] for r in components.components(edges).collect()}
    want = _linked(ids, 4)
    assert all(got.get(ids[i], ids[i]) == ids[r] for i, r in want.items())


def test_groups_verify_their_links(spark, awkward):
    base = [f"w{i}" for i in range(400)]
    near = base[:200] + ["edited"] + base[201:]
    docs = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(base)), (4, " ".join(f"z{i}" for i in range(400))), (5, " ".join(base[:150]))], "doc_id long, text string")
    assert {r["doc_id"]: r["group"] for r in similar.groups(docs).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}
    got = similar.groups(awkward).collect()
    assert len(got) == awkward.count()
    assert {r["group"] for r in got if r["doc_id"] in (1, 2)} == {1} and {r["group"] for r in got if r["doc_id"] in (3, 4)} == {3}
    assert [(r["group"], r["first"]) for r in got if r["doc_id"] is None] == [(None, True)]
    assert simhash.near_duplicates(awkward).count() == awkward.count() and similar.groups(awkward.where("false")).count() == 0


def _alike(texts, least=0.8):
    """The smallest id that each text reaches over links of this similarity, by comparing all with all."""
    split = lambda t: [w for w in re.split("[\\x20\\x09-\\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in ((i, split(t)) for i, t in texts.items())}
    root = {i: i for i in texts}
    for a in texts:
        for b in texts:
            if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= least and root[a] != root[b]:
                lo, hi = sorted((root[a], root[b]))
                root = {k: lo if v == hi else v for k, v in root.items()}
    return root


def test_groups_equal_brute_force_on_the_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = similar.groups(docs).collect()
    assert {r["doc_id"]: r["group"] for r in got} == _alike(texts)
    assert sorted(r["doc_id"] for r in got if r["first"]) == sorted(set(_alike(texts).values()))


def test_groups_find_texts_with_an_added_paragraph(spark):
    """Copies with a block of other words, which change the words' fingerprints in more than 4 bits."""
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = {}
    for k in range(40):
        words = rng.choice(vocabulary, 200).tolist()
        texts[2 * k] = " ".join(words)
        texts[2 * k + 1] = " ".join(words + rng.choice(vocabulary, 30 + k % 20).tolist())
    got = {r["doc_id"]: r["group"] for r in similar.groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == _alike(texts) and sum(i != g for i, g in got.items()) >= 35


def test_groups_find_links_past_the_owner(spark):
    """Texts of the same words in other orders: all fingerprints are equal, the smallest id is like none of them."""
    rng = np.random.default_rng(6)
    words, texts = [f"w{i}" for i in range(100)], {}
    for k in range(30):
        mine = rng.permutation(words).tolist()
        texts[3 * k] = " ".join(mine)
        for i in (1, 2):
            mine[40 * i], mine[40 * i + 1] = mine[40 * i + 1], mine[40 * i]
            texts[3 * k + i] = " ".join(mine)
    texts = {0: " ".join(words)} | {i + 1: t for i, t in texts.items()}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["group"] for r in similar.groups(docs, small=2, pivots=1).collect()}
    assert got == _alike(texts) and sum(i != g for i, g in got.items()) == 60


@pytest.mark.parametrize("batch", [1, 7, 50, 1000])
def test_meetings_in_rounds_lose_no_pair(batch):
    rng = np.random.default_rng(7)
    n = 300
    frame = pd.DataFrame({"token": np.r_[rng.integers(0, 3, n - 40), rng.integers(3, 20, 40)], "node": rng.permutation(n), "size": 10, "pos": 0}).astype(np.int64)
    frame["comp"] = np.where(frame["node"] % 4 == 0, frame["node"], 1)
    want = {(min(a.node, b.node), max(a.node, b.node)) for a in frame.itertuples() for b in frame.itertuples() if a.token == b.token and a.comp != b.comp}
    got, pivots, rounds = set(), 2, 0
    comps = frame[["node", "comp"]].drop_duplicates()
    members = frame[["token", "node", "size", "pos"]]
    while len(members):
        rows = members.merge(comps, on="node").sort_values(["token", "pos", "node"], ignore_index=True)
        of = rows.groupby("token")
        rows["r"], rows["n"] = of.cumcount() + 1, of["node"].transform("size")
        rows = rows[of["comp"].transform("nunique") > 1]
        made = pd.concat([*similar.meetings((rows.iloc[i : i + batch] for i in range(0, len(rows), batch)), 0.8, 8, pivots), pd.DataFrame(columns=["left", "a", "b", "size", "pos"])])
        left = made["left"].astype(bool)
        got |= set(made.loc[~left, ["a", "b"]].itertuples(index=False, name=None))
        members = made.loc[left, ["b", "a", "size", "pos"]].set_axis(["token", "node", "size", "pos"], axis=1).astype(np.int64)
        pivots, rounds = pivots * 4, rounds + 1
    assert got == want and rounds > 1


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(160, 101), (7, 7), (None, 3), (5, 4)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 161)}


def test_toxicity_scores(spark, sf):
    sf = sf.replace("0.001", "0.01")
    rows = QUERIES["op7_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    right = np.mean([r["predicted"] == r["toxic"] for r in held])
    assert right > 0.93 and all(0 <= r["score"] <= 1 for r in rows)
    assert np.mean([r["predicted"] for r in held if r["toxic"] == 1]) > 0.6
    assert np.mean([r["predicted"] for r in held if r["toxic"] == 0]) < 0.02


def test_toxicity_of_awkward_rows(spark, awkward):
    none = toxicity.fit(awkward.select("doc_id", "text"), spark.createDataFrame([], "doc_id long, toxic int"))
    rows = toxicity.score_toxicity(awkward.select("doc_id", "text", "score"), none).collect()
    assert len(rows) == awkward.count() and all(r["score"] == 0 for r in rows)
    assert toxicity.features("you 1d10t, YOU idiot!", toxicity.Words({}))[0] > 0 and toxicity.features(None, toxicity.Words({})) == [0.0] * len(toxicity.FEATURES)
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, toxic int")
    docs = spark.createDataFrame([(i, ("you idiot scum " if i % 2 else "fine words here ") + f"number {i}") for i in range(300)], "doc_id long, text string")
    model = toxicity.fit(docs, labels)
    fitted = toxicity.score_toxicity(awkward.select("doc_id", "text", "score", "features"), model).collect()
    assert model.trees is not None and len(fitted) == awkward.count() and all(0 <= r["score"] <= 1 for r in fitted)
    assert toxicity.score_toxicity(docs.where("false"), model).count() == 0
    assert toxicity.fit(docs.where("false"), labels).trees is None


def test_features_equal_the_plain_counts():
    """Each feature of a text once more, by a loop over its words."""
    lexicon = {"=idiot": 3.0, "^scu": 2.0}
    text = "You are an IDIOT, said Émile; sc.u.m and 1d10t! Fine words: scumbag? your hat."
    got = dict(zip(toxicity.FEATURES, toxicity.features(text, toxicity.Words(lexicon)), strict=True))
    tokens = text.split()
    n = len(tokens)
    assert got["length"] == pytest.approx(np.log1p(n)) and got["exclamations"] == 1 / n and got["questions"] == 1 / n
    assert got["learned"] == 4 / n and got["best"] == 3.0 and got["weight"] == pytest.approx(10.0 / n) and got["insults"] == 3 / n
    assert got["capitals"] == pytest.approx(sum(c.isupper() for c in text) / sum(c.isalpha() for c in text)) and got["shouted"] == 1 / n
    assert got["hits"] == pytest.approx(np.log1p(4)) and got["per_second_person"] == 3 / n


def test_isotonic_values_rise():
    raw = np.array([0.1, 0.2, 0.3, 0.4, 0.8, 0.9])
    places, values = toxicity.pool_adjacent(raw, np.array([0, 1, 0, 0, 1, 1]))
    assert places == sorted(places) and values == sorted(values) and values[0] < 0.5 < values[-1]


def _recall(got, ids, x, is_query, k=5):
    """The share of the true neighbours that got (query_id, vec_id, score rows) holds; scores must be exact."""
    norm, found, hits, asked = np.sqrt((x * x).sum(axis=1)), {}, 0, 0
    for r in got:
        found.setdefault(r["query_id"], {})[r["vec_id"]] = r["score"]
    at = {i: k for k, i in enumerate(ids.tolist())}
    for q in np.flatnonzero(is_query):
        s = (x * x[q]).sum(axis=1) / (norm * norm[q])
        mine = found[ids[q]]
        assert ids[q] not in mine and all(s[at[i]] == pytest.approx(v, abs=1e-12) for i, v in mine.items())
        s[q] = -9
        hits += len(set(ids[np.lexsort((ids, -s))[:k]].tolist()) & set(mine))
        asked += k
    return hits / asked


@pytest.mark.parametrize("scale", ["0.001", "0.1"])
def test_neighbours_against_brute_force(spark, sf, scale):
    sf = sf.replace("0.001", scale)
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").where("embedding IS NOT NULL").select("vec_id", "embedding").collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=float)
    got = QUERIES["op8_nearest_neighbours"](spark, sf).orderBy("query_id", "rank").collect()
    assert _recall(got, ids, x, ids % 50 == 0) >= 0.9
    assert all(a["score"] >= b["score"] for a, b in zip(got, got[1:], strict=False) if a["query_id"] == b["query_id"])


def test_neighbours_of_clustered_vectors_need_few_windows(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((150, 24))
    x = np.repeat(centres, 40, axis=0) + 0.1 * rng.standard_normal((6000, 24))
    ids = np.arange(6000)
    fit, chosen = neighbours.fitted_reach, []
    monkeypatch.setattr(neighbours, "fitted_reach", lambda *a: chosen.append(fit(*a)) or chosen[-1])
    got = neighbours.search(spark.createDataFrame(pd.DataFrame({"vec_id": ids, "embedding": x.tolist()})), F.col("id") % 50 == 0, size=64).collect()
    assert _recall(got, ids, x, ids % 50 == 0) >= 0.9
    assert chosen[0][0] * (2 * chosen[0][1] + 1) <= 30  # of 94 windows, on each of so many curves


def test_neighbours_of_ties_and_repeated_ids(spark):
    rows = [(i, [1.0, 0.0]) for i in range(8)] + [(9, [0.0, 1.0]), (9, [0.0, 2.0])]
    got = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") == 0, k=3, size=4).orderBy("rank").collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in got] == [(1, 1, 1.0), (2, 2, 1.0), (3, 3, 1.0)]
    assert neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.lit(False)).count() == 0


def test_neighbours_of_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [[1.0, 0.0], [1.0, 0.0], [2.0, 0.0], [0.0, 1.0], None, [0.0, 0.0], [nan, 1.0], [inf, 1.0], [1.0, None], [1.0], [1.0, 1.0]]
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))
    rows = neighbours.search(df, F.col("id") % 10 == 0, k=5, size=2, per_range=3).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"]) for r in rows] == [(0, 1), (0, 2), (0, 10), (0, 3), (10, 0), (10, 1), (10, 2), (10, 3)]
    assert neighbours.search(df.where("false"), F.col("id") % 10 == 0).count() == 0


def test_hilbert_keys_visit_every_cell_by_single_steps():
    cells = np.array([(a, b, c) for a in range(4) for b in range(4) for c in range(4)])
    keys = neighbours.hilbert_keys(cells, 2)
    assert sorted(keys.tolist()) == list(range(64))
    path = cells[np.argsort(keys)]
    assert np.abs(np.diff(path, axis=0)).sum(axis=1).max() == 1


def test_chat_round_trip_with_parts(spark):
    part = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
    tricky = "a\\<|b <\\| <|im_end|>\n\\\\ 中"
    rows = [
        (1, 0, "us%er\n", [("text", tricky, None, None, None, None, None), ("image", None, "i.png", 56, 29, None, None), ("audio", None, "s.wav", None, None, 1.5, None)]),
        (1, 1, "assistant", [("text", "ok", None, None, None, None, None), ("document", None, "d.pdf", None, None, None, 2)]),
        (2, 0, None, None),
        (None, 0, "assistant", [("text", None, None, None, None, None, None)]),
    ]
    made = chat.format_chat(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{part}>"))
    got = {r["conv"]: r for r in made.withColumn("turns", chat.parse_chat(F.col("formatted"))).collect()}
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [("us%er\n", tricky + "<|image|><|audio|>"), ("assistant", "ok<|document|>")]
    assert [(a["ref"], a["tokens"]) for a in got[1]["attachments"]] == [("i.png", 4), ("s.wav", 38), ("d.pdf", 2048)] and got[1]["expanded_tokens"] == 2090
    assert [(t["role"], t["text"]) for t in got[2]["turns"]] == [("", "")] and len(got) == 3
    assert chat.format_chat(spark.createDataFrame([], f"conv_id long, turn long, role string, parts array<{part}>")).count() == 0


def test_chat_equals_its_oracle(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    want = con.sql(ORACLES["op9_chat_formatting"])
    got = QUERIES["op9_chat_formatting"](spark, sf).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_shards_are_even_and_gapless(spark, sf):
    rows = QUERIES["op10_sharding"](spark, sf).collect()
    total, largest = sum(r["size"] for r in rows), max(r["size"] for r in rows)
    for k in range(8):
        mine = [r for r in rows if r["shard"] == k]
        assert sorted(r["slot"] for r in mine) == list(range(len(mine)))
        assert abs(sum(r["size"] for r in mine) - total / 8) <= max(largest, 0.06 * total / 8)


def test_shards_equal_a_sort_of_all_rows(spark, sf):
    """The first byte of each text's copies, in the order of the keys, decides their shard; slots count on in that order."""
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = {r["doc_id"]: r for r in QUERIES["op10_sharding"](spark, sf).collect()}
    key = lambda i: int(hashlib.md5(texts[i].encode()).hexdigest()[:15], 16)
    size = {i: len(t.encode()) + 1 for i, t in texts.items()}
    total, at, began, slots = sum(size.values()), 0, {}, {}
    copies = {}
    for i in texts:
        copies[texts[i]] = copies.get(texts[i], 0) + size[i]
    for i in sorted(texts, key=lambda i: (key(i), i)):
        unit = texts[i] if copies[texts[i]] <= 0.05 * total / 8 else i
        began.setdefault(unit, at)
        at += size[i]
        shard = min(7, began[unit] * 8 // total)
        assert (rows[i]["shard"], rows[i]["slot"], rows[i]["size"], rows[i]["text_crc32"]) == (shard, slots.get(shard, 0), size[i], zlib.crc32(texts[i].encode()))
        slots[shard] = slots.get(shard, 0) + 1


def test_shards_of_awkward_and_hot_rows(spark, awkward):
    made = sharding.shard(awkward, 4)
    assert made.count() == awkward.count() and made.columns == [*[c for c in awkward.columns if c not in ("size", "shard", "slot")], "size", "shard", "slot"]
    hot = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "same text").otherwise(F.concat(F.lit("t"), F.col("id").cast("string"))).alias("text"))
    sizes = {r["shard"]: r["s"] for r in sharding.shard(hot).groupBy("shard").agg(F.sum("size").alias("s")).collect()}
    assert max(sizes.values()) < 1.05 * min(sizes.values())
    assert sharding.shard(awkward.where("false")).count() == 0


@pytest.mark.parametrize("name", ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"])
def test_stages_of_awkward_rows(spark, awkward, sf, name):
    import corpus_pipeline

    stage = dict(corpus_pipeline.STAGES)[name]
    docs = awkward.union(awkward.where("doc_id is null"))
    made = stage(spark, docs, sf)
    rows, kept = made.collect(), {"toxicity": docs.count(), "decontamination": docs.count(), "sharding": docs.count(), "near_duplicates": 5}
    assert name not in kept or len(rows) == kept[name]
    assert made.columns == (docs.columns if name != "sharding" else [*[c for c in docs.columns if c not in ("size", "shard", "slot")], "size", "shard", "slot"])
    if name == "near_duplicates":
        assert sorted((r["doc_id"] for r in rows), key=str) == [1, 3, 5, 7, None]
    assert stage(spark, docs.where("false"), sf).count() == 0


def test_decontamination_of_rows_without_an_id(spark, sf):
    import corpus_pipeline

    item = spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").first()["text"]
    docs = spark.createDataFrame([(None, f"some words before {item}"), (None, "clean words only"), (7, "clean too")], "doc_id long, text string")
    assert sorted(r["text"] for r in corpus_pipeline.decontamination(spark, docs, sf).collect()) == ["clean too", "clean words only"]


def test_pipeline_takes_its_decisions(spark, sf):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    near = corpus_pipeline.near_duplicates(spark, docs, sf)
    assert near.columns == docs.columns and near.count() == near.select("text").distinct().count() < docs.count()
    clean = corpus_pipeline.decontamination(spark, docs, sf)
    items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert not any(i in r["text"] for r in clean.collect() for i in items)
    done = corpus_pipeline.run(spark, sf)
    assert done.columns == [*docs.columns, "size", "shard", "slot"] and done.count() > 0

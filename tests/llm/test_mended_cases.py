"""Cases that single operators once got wrong: left-over digits, doubled spans, mixed escapes, forms around a page."""

from __future__ import annotations

import base64
import time

import pytest
from pyspark.sql import functions as F

from pelagia.llm import html, secrets, toxicity


@pytest.mark.parametrize("tail", ["", "A", "AA", "AAA", "AAAA"])
def test_base64_with_digits_left_over(tail):
    run = base64.b64encode(b"password=abcdefgh123").decode().rstrip("=") + tail
    spans = secrets.scan(f"x {run} y")[1]
    assert [k for k, _, _ in spans] == ["assign"]
    assert spans[0][1] == 2 and 2 + 26 <= spans[0][2] <= 2 + len(run)


def test_a_run_that_is_text_gives_no_second_span():
    found = 0
    for i in range(400):
        run = base64.b64encode(f"~~?{i}~?>password=abc{i}defgh~?".encode()).decode()
        if "/" in run or "+" in run:
            found += 1
            assert len(secrets.scan(f"x {run} y")[1]) == 1, run
    assert found > 50


def test_runs_parted_by_signs_are_still_tried():
    run = base64.b64encode(b"token=abcdefgh9").decode().rstrip("=")
    for text in (f"/var/x/{run}/y", f"id-{run}-{run}"):
        assert any(k == "assign" for k, _, _ in secrets.scan(text)[1]), text


@pytest.mark.parametrize("wrapped", ["pass%77ord\\u003d%61bcdefgh", "&#112;assword%3Dabc\\x64efgh", "pass\\u0077ord%253Dabcdefgh", "password%5Cu003dabcdefgh"])
def test_escapes_of_both_kinds_together(wrapped):
    assert secrets.scan(f"x {wrapped} y")[1] == [("assign", 2, 2 + len(wrapped))]


def test_mixed_deep_escapes_take_linear_time():
    took = []
    for n in (500, 1500):
        text = " ".join(f"%{'25' * (i % 40)}41\\u005c{'u005c' * (i % 30)}u0041" for i in range(n))
        began = time.time()
        secrets.scan(text)
        took.append((time.time() - began) / len(text))
    assert took[1] < 2.5 * took[0] and took[1] * 100_000 < 15


ARTICLE = "<h1>On tides</h1><p>The tide at the pier rose for six hours, and then it fell again.</p><p>Boats waited, as they always do, until noon.</p>"
TEXT = "On tides The tide at the pier rose for six hours, and then it fell again. Boats waited, as they always do, until noon."


def test_a_form_around_the_page_is_the_page():
    page = f"<body><form id=aspnetForm><input type=hidden value=x><div class=nav><a href=a>Home</a></div><div id=main>{ARTICLE}</div><select><option>one</select></form></body>"
    assert html.extract(page) == TEXT
    assert html.extract(f"<body><div>{ARTICLE}</div><form><p>Write to us, we answer within a day.</p><button>Send</button></form></body>") == TEXT
    assert html.extract(f"<body><form class=search-form>{ARTICLE}</form><p>Little else.</p></body>") == "Little else."


def test_references_of_a_marked_article_stay():
    links = "".join(f"<li><a href=x{i}>Source number {i}</a></li>" for i in range(4))
    assert html.extract(f"<body><article>{ARTICLE}<ul>{links}</ul></article></body>") == TEXT + "".join(f" Source number {i}" for i in range(4))
    assert html.extract(f"<body><ul>{links}</ul><div>{ARTICLE}</div></body>") == TEXT


def test_rows_without_an_id_are_not_held_out(spark):
    got = spark.createDataFrame([(None,), (1,), (2,), (3,)], "doc_id long").select("doc_id", toxicity.is_held_out(F.col("doc_id")).alias("held_out")).collect()
    assert got[0]["held_out"] is False and all(r["held_out"] is not None for r in got)

"""Identifiers and markup of WARC derivatives."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from plazaflow.llm import warc


def test_identifiers_of_null_and_repeated_pages(spark):
    rows = [(None, "u", "<p>a"), (None, "u", "<p>b"), (None, None, None), (1, None, "<p>a"), (1, "u", "<p>a"), (1, "u", "<p>c"), (1, "u", "<p>c"), (2, "u", "<p>a")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(c) for c in ("record_id", "_read", "content", "payload", "r")})
    got = warc.derivatives(warc.responses(pages), keep=["page_id"]).collect()
    assert len(got) == 2 * len(rows) and all(r.record_id and r.refers_to for r in got)
    assert len({r.refers_to for r in got}) == len(set(rows)) and len({r.record_id for r in got}) == 2 * len(set(rows))
    for r in got:
        assert r.record_id != r.refers_to and (r.record_type != "conversion" or r.content in {"a", "b", "c", ""})
    of = {(r.page_id, r.target_uri, r.content): r.refers_to for r in got if r.record_type == "conversion"}
    assert of[None, "u", "a"] != of[None, "u", "b"] and of[1, "u", "a"] != of[2, "u", "a"]


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<p title='a>b'>x</p>y", "x\ny"), ("a<script>var x = 1;", "a"), ("a<!-- <p>b", "a"), ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2"), ("&eacute;&#8217;&lt;b&gt;", "é’<b>"), ("<head><title>T</title><body>b", "b"),
        ("<style>p{}</style>a<br/>b<HR>c", "a\nb\nc"), ("a <b> b</b>  c\t\n<div> d </div> \n <p>e", "a b c\nd\ne"), ("<a href='x", ""), ("", ""), ("<", "<"), ("<header>h</header><p>x", "h\nx"),
    ],
)
def test_plain_text(page, text):
    assert warc.read_page(page)[3] == text


def test_titles_links_and_languages():
    page = "<html lang = fr><head><title> A\n &amp; B </title></head><!-- <a href=no> --><a href=/x>1</a><A HREF='y z'>2</A><a data-href=no title=\"href='no'\">3</a><script><a href=no></script>"
    assert warc.read_page(page)[:3] == ("A & B", "fr", ["/x", "y z"])


@pytest.mark.parametrize("page", ["<script>" * 50_000, "<!-- " * 60_000, "<p title='a" * 40_000, "<head>" * 50_000, "<title>" * 50_000, "<" * 300_000, "&" * 300_000, "<a href=" * 40_000, " " * 300_000 + "x", "\n " * 150_000, "<p> " * 80_000])
def test_reading_is_linear(page):
    began = time.time()
    warc.read_page(page)
    assert time.time() - began < 4

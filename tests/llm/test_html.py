"""Tag-path ratios decide what a page's article is; reading is linear."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from plazaflow.llm import htmltext

from ..conftest import MEDIUM

LINE = "A long line of the article, with marks; it is clearly a part of it, as anyone who reads it can see."
SHORT = "Bread is cheap today."


def renamed(page):
    """The page without a tag or a class that names what it is."""
    return page.replace("<article>", '<div class="q1">').replace("</article>", "</div>").replace('class="ad"', 'class="q7"')


def test_without_ratios_most_pages_change(spark, monkeypatch):
    pages = [r.html for r in spark.read.parquet(f"{MEDIUM}/pages.parquet").collect()]
    texts = [htmltext.main_text(p) for p in pages]
    nameless = [htmltext.main_text(renamed(p)) for p in pages]
    assert sum(a == b for a, b in zip(texts, nameless, strict=True)) >= 0.9 * len(pages)
    monkeypatch.setattr(htmltext, "ratios", lambda nodes, width=2: [1.0] * len(nodes))
    assert sum(htmltext.main_text(p) != t for p, t in zip(pages, texts, strict=True)) >= 0.9 * len(pages)
    assert sum(htmltext.main_text(renamed(p)) != t for p, t in zip(pages, nameless, strict=True)) >= 0.9 * len(pages)


def test_path_ratios_are_fused_and_smoothed():
    _, nodes = htmltext.text_nodes(f"<div><h2>T</h2><p>{LINE}</p><p>x</p></div><div>bare</div><p><a href=x>only a link</a></p>")
    heading, first, second, bare, link = htmltext.ratios(nodes)
    assert first == pytest.approx(second, rel=0.5) and heading > 0.5 * first and bare < 0.4 * first and link < bare
    assert htmltext.threshold([5, 5, 5], [10, 10, 10]) == 0 and 1 < htmltext.threshold([1, 1, 30, 40], [10, 10, 50, 50]) < 30


@pytest.mark.parametrize(
    "body",
    [
        f"<div><h1>T</h1><p>{LINE}</p><p>{LINE}</p><figure><img src=x><figcaption>A caption.</figcaption></figure></div>",
        f'<div><h1>T</h1><p>{LINE}</p><p>{LINE}</p><div class="legal">A caption.</div></div>',
        f'<section class="share-of-market"><h1>T</h1><p>{LINE}</p><p>{LINE}</p><div class="notice-board">A caption.</div></section>',
        f"<div><header><h1>T</h1><p>By one</p></header><p>{LINE}</p><p>{LINE}</p><p><a href=x>A caption.</a></p></div>",
        f"<h1>T</h1><p>{LINE}</p><p>{LINE}</p><p>A caption.</p>",
        f"<h1>T</h1><div><p>{LINE}</p><p>{LINE}</p><p>A caption.</p></div>",
    ],
)
def test_all_of_the_article_is_kept(body):
    page = f"<html><head><title>x</title></head><body><header><h1>Site</h1></header><nav><a href=1>Home</a></nav><div class=q>{SHORT}</div>{body}<div id=z>{SHORT}</div><footer>{LINE}</footer></body></html>"
    assert htmltext.main_text(page) == "\n".join(["T", LINE, LINE, "A caption."])


def test_menus_in_the_article_go_and_formulas_stay():
    page = f"<div><p>{LINE}</p><p>{LINE} <math><mi>x</mi><mo>=</mo><mn>2</mn></math></p><ul><li><a href=1>One</a><li><a href=2>Two</a><li><a href=3>Three</a></ul></div>"
    assert htmltext.main_text(page) == f"{LINE}\n{LINE} x=2"


@pytest.mark.parametrize(
    "page",
    [
        "<div>" * 100_000 + "</x>" * 100_000, "<div>" * 60_000 + "<li></li>" * 60_000, "<li><ul>" + "<div>" * 60_000 + "<li></li>" * 60_000, '<p title="' * 60_000, "<p a='\" " * 60_000, "<!-- " * 100_000, "<script>" * 100_000,
        "<" * 300_000, "<p>a</p>" * 60_000, "<a href='x'>" * 60_000, "<div><p>a b, c.</p>" * 60_000, "&" * 300_000, "<table><tr><td>" * 30_000 + "</tr>" * 60_000,
    ],
)
def test_reading_is_linear(page):
    began = time.time()
    htmltext.main_text(page)
    assert time.time() - began < 8


def test_rows_of_odd_pages(spark):
    rows = [(1, None, None), (None, "u", ""), (2, "u", "<p>a"), (2, "u", "<p>a"), (3, "v", f"<p>{LINE}</p>" * 3000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit(1), "n_chars": F.lit("x"), "path": F.lit(0)})
    got = sorted(((r.page_id, r.url, r.text) for r in htmltext.extract_main_text(pages).collect()), key=str)
    assert got == sorted([(1, None, ""), (None, "u", ""), (2, "u", "a"), (2, "u", "a"), (3, "v", "\n".join([LINE] * 3000))], key=str)
    assert htmltext.extract_main_text(pages.where("false")).count() == 0


def test_sibling_blocks_take_linear_time():
    import time

    for block in ("<section><div><p>Some words, and more.</p></div></section>", "<div>Words, words and words.</div>", "<div><h2>T</h2><p>Some words.</p></div>"):
        began = time.time()
        htmltext.main_text(f"<body>{block * 16_000}</body>")
        assert time.time() - began < 6


PROSE = "<p>This is a paragraph of the article, with some words, and it goes on for a while.</p>"


def test_readers_notices_and_references():
    line = PROSE[3:-4]
    talk = "<section class='discussion'><p>I think so, too, thanks for this.</p><p>No, never, it is wrong.</p></section>"
    assert htmltext.main_text(f"<body><article><h1>T</h1>{PROSE * 2}</article>{talk}</body>") == f"T\n{line}\n{line}"
    notice = "<div class='cookie-notice'><p>We use cookies to make this site better, read more.</p></div>"
    assert htmltext.main_text(f"<body><div><h1>Hi</h1><p>Short.</p></div>{notice}</body>") == "Hi\nShort."
    assert htmltext.main_text(f"<body><article><h1>T</h1>{PROSE}<p class='comment'>A remark, by the author.</p>{PROSE}</article></body>") == f"T\n{line}\nA remark, by the author.\n{line}"
    links = "".join(f"<li><a href='#'>Reference number {k}</a></li>" for k in range(6))
    for lead in ("<h2>References</h2>", "<p>See also:</p>"):
        got = htmltext.main_text(f"<body><article><h1>T</h1>{PROSE * 2}{lead}<ul>{links}</ul></article></body>")
        assert got.endswith("Reference number 5") and got.count("Reference number") == 6
    # a menu at the top of the same block, and one that is named, still go
    assert "Reference" not in htmltext.main_text(f"<body><article><ul>{links}</ul><h1>T</h1>{PROSE * 2}</article></body>")
    assert "Reference" not in htmltext.main_text(f"<body><article><h1>T</h1>{PROSE * 2}<h2>More</h2><ul class='related'>{links}</ul></article></body>")

"""WARC derivatives: linked metadata and plain-text conversion records of responses.

From each response record come two records that refer to it: ``metadata`` (title, language, links, sizes, the source's
headers and digests, as warc-fields) and ``conversion`` (its plain text). Both name the response in refers_to, keep its
target URI and date, and carry its source headers and digests beside digests of their own block. Record identifiers derive
from the response's by hashing, so the same input gives the same records again.

A page is read once, from left to right, each part of its markup by one possessive pattern, so the time is linear in its
length whatever is unclosed. Comments, scripts, styles, noscript and template elements and the head are no text; one that
is not closed reaches to the page's end, an unclosed head to the body. Named and numeric character references that end in
a semicolon are decoded, a no-break space to a space. Links and the language are read from attributes with double, single
or no quotes, the first of a name in its tag; link targets stay as they are written. The SQL form knows fewer references
and double quotes only, which are all that the test pages use.

All of it is done on the scan, without a shuffle. A null payload is an empty one; null headers are empty. A response of a
page is known by page_id, url and content, null or not, so different captures have different identifiers; rows that are
equal in all three are one capture and have equal records. A record without an identifier gets derivatives with null
identifiers. Every response gives exactly two records. Other columns are ignored.
"""

from __future__ import annotations

import re
from html import unescape
from html.entities import html5

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches

DATE = "2024-01-01T00:00:00Z"
# fixed values: patterns of the SQL form of the query
DROPPED = r"(?is)<!--.*?-->|<(script|style|noscript|template)\b.*?</(script|style|noscript|template)\s*>|<head\b.*?</head\s*>"
BREAKS = r"(?i)<(/?(p|div|article|section|h[1-6]|ul|ol|li|table|tr|nav|footer|header|aside|blockquote|pre)|br|hr)\b[^>]*>"
TAGS = r"(?s)<[^>]*>"
TITLE = r"(?is)<title[^>]*>(.*?)</title\s*>"
LANGUAGE = r'(?is)<html[^>]*\blang="([^"]*)"'
LINKS = r'(?is)<a\b[^>]*\bhref="([^"]*)"'
REFERENCES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]

REFERENCE = re.compile(r"&(?:#[0-9]++|#[xX][0-9a-fA-F]++|[a-zA-Z][a-zA-Z0-9]*+);")
MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^"'>]++|"[^"]*+"|'[^']*+'|["'])*+)(?:>|\Z)""", re.DOTALL)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]++)))?""")
BLANKS = re.compile(r"[ \t\r\n\f]+")
# fixed values: elements of the HTML standard
NO_TEXT = {tag: re.compile(rf"</{tag}\s*+>", re.IGNORECASE) for tag in ("script", "style", "noscript", "template")}
HEAD_END = re.compile(r"</head\s*+>|(?=<body[\s/>])", re.IGNORECASE)
TITLE_END = re.compile(r"</title\s*+>", re.IGNORECASE)
BLOCKS = frozenset("p div article section h1 h2 h3 h4 h5 h6 ul ol li table tr nav footer header aside blockquote pre br hr".split())


def urn(key: Column) -> Column:
    """A stable urn:uuid of a text."""
    h = F.md5(key.cast("binary"))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def sha1(column: Column) -> Column:
    return F.concat(F.lit("sha1:"), F.sha1(column.cast("binary")))


def _reference(match: re.Match[str]) -> str:
    name = match[0]
    if name == "&nbsp;":
        return " "
    return unescape(name) if name[1] == "#" else html5.get(name[1:], name)


def unescaped(text: str) -> str:
    """``text`` with its character references decoded once."""
    return REFERENCE.sub(_reference, text) if "&" in text else text


def attribute(tag: str, name: str) -> str | None:
    """The value of a tag's first attribute of a name, where it has one."""
    for m in ATTRIBUTE.finditer(tag):
        if m[1].lower() == name and m.lastindex > 1:
            return m[m.lastindex]
    return None


def read_page(html: str) -> tuple[str, str, list[str], str]:
    """The title, language, link targets and plain text (a line per block) of a page."""
    title, lang, links, parts = None, None, [], []
    at, head_ends = 0, 0
    while True:
        m = MARKUP.search(html, at)
        if at >= head_ends:
            parts.append(unescaped(BLANKS.sub(" ", html[at : m.start()] if m else html[at:])))
        if not m:
            break
        at = m.end()
        closing, tag = m[1], (m[2] or "").lower()
        if closing or not tag:
            if tag in BLOCKS and at >= head_ends:
                parts.append("\n")
            continue
        if tag in NO_TEXT:
            end = NO_TEXT[tag].search(html, at)
            at = end.end() if end else len(html)
        elif tag == "head" and at >= head_ends:
            end = HEAD_END.search(html, at)
            head_ends = end.end() if end else len(html)
        elif tag == "title" and title is None:
            end = TITLE_END.search(html, at)
            title = BLANKS.sub(" ", unescaped(html[at : end.start()])).strip(" ") if end else ""
        elif tag == "html" and lang is None:
            lang = attribute(m[3], "lang") or ""
        elif tag == "a" and (target := attribute(m[3], "href")) is not None:
            links.append(target)
        elif tag in BLOCKS and at >= head_ends:
            parts.append("\n")
    lines = (re.sub(" +", " ", line) for line in "".join(parts).split("\n"))
    # blanks around a line are those beside its breaks; a line of blanks is none
    return title or "", lang or "", links, "\n".join(x for x in (line.strip(" ") for line in lines) if x)


def page_parts(html: Column) -> Column:
    """A struct of a page's title, lang, links and text."""

    @F.arrow_udf("title string, lang string, links array<string>, text string")
    def work(pages: pa.Array) -> pa.Array:
        columns = list(zip(*(read_page(t or "") for t in pages.to_pylist()), strict=True)) or [()] * 4
        kinds = (pa.string(), pa.string(), pa.list_(pa.string()), pa.string())
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["title", "lang", "links", "text"])

    return work(html)


def responses(pages: DataFrame, *, date: str = DATE) -> DataFrame:
    """Response records of a table of pages: record_id, target_uri, warc_date, headers, payload."""
    payload = F.coalesce("html", F.lit(""))
    headers = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(payload).cast("string"))
    return pages.select(
        "page_id",
        urn(F.concat_ws("|", F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("url", F.lit("")), F.sha1(payload.cast("binary")))).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit(date).alias("warc_date"),
        headers.alias("headers"),
        payload.alias("payload"),
    )


def derivatives(records: DataFrame, *, keep: list[str] | None = None) -> DataFrame:
    """Two records of each response, with ``keep`` columns carried along.

    Columns: record_type, record_id, refers_to, target_uri, warc_date, content_type, source_headers, source_payload_digest,
    source_block_digest, content, content_length, block_digest.
    """
    bound_batches(records.sparkSession)
    payload, headers = F.coalesce("payload", F.lit("")), F.coalesce("headers", F.lit(""))
    source = records.select(
        *(keep or []),
        F.col("record_id").alias("refers_to"),
        "target_uri",
        "warc_date",
        headers.alias("source_headers"),
        sha1(payload).alias("source_payload_digest"),
        sha1(F.concat(headers, F.lit("\r\n\r\n"), payload)).alias("source_block_digest"),
        payload.alias("_payload"),
    )
    payload = F.col("_payload")
    source = source.withColumn("_read", page_parts(payload))
    links = F.col("_read.links")
    fields = F.concat(
        F.lit("title: "), F.col("_read.title"),
        F.lit("\r\nlanguage: "), F.col("_read.lang"),
        F.lit("\r\npayload-length: "), F.octet_length(payload).cast("string"),
        F.lit("\r\npayload-digest: "), F.col("source_payload_digest"),
        F.lit("\r\noutlinks: "), F.size(links).cast("string"),
        F.array_join(F.transform(links, lambda u: F.concat(F.lit("\r\noutlink: "), u)), ""),
        F.lit("\r\n"),
    )
    record = lambda kind, mime, content: F.struct(F.lit(kind).alias("record_type"), F.lit(mime).alias("content_type"), content.alias("content"))
    both = F.array(record("metadata", "application/warc-fields", fields), record("conversion", "text/plain; charset=utf-8", F.col("_read.text")))
    rows = source.withColumn("r", F.explode(both)).select("*", "r.*").drop("r", "_payload", "_read")
    return rows.withColumns(
        {
            "record_id": urn(F.concat(F.col("record_type"), F.lit("|"), F.col("refers_to"))),
            "content_length": F.octet_length("content").cast("long"),
            "block_digest": sha1(F.col("content")),
        }
    )


def serialized(records: DataFrame) -> DataFrame:
    """Each derivative as the text of one WARC/1.1 record."""
    named = [
        ("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target_uri"),
        ("WARC-Date", "warc_date"), ("WARC-Block-Digest", "block_digest"), ("Content-Type", "content_type"), ("Content-Length", "content_length"),
    ]
    head = F.concat_ws("\r\n", F.lit("WARC/1.1"), *(F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{n}: "), F.col(c).cast("string"))) for n, c in named))
    return records.select("record_id", F.concat(head, F.lit("\r\n\r\n"), "content", F.lit("\r\n\r\n")).alias("record"))

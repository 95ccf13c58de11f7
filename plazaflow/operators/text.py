"""Text to graph: mentions, citations, links and similarity."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

URL = r"https?://[^\s<>\"')\]]+"


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"[.!?\n]+"), lambda s: F.trim(s)), lambda s: s != "")


def sentence_with(text: Column, word: Column, clip: int = 200) -> Column:
    """The first sentence that contains a word, clipped."""
    return F.substring(F.get(F.filter(sentences(text), lambda s: F.contains(s, word)), 0), 1, clip)


def word_pairs(text: Column) -> Column:
    """The set of pairs of neighbouring words, lower-cased."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    # two runs over the words, as looking each up by its place would split the text anew
    pairs = F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat_ws(" ", a, b))
    return F.when(F.size(words) > 1, F.array_distinct(pairs))


def mentions(docs: DataFrame, doc: str, names: DataFrame, name: str) -> DataFrame:
    """(doc, name): which documents have a name among their words, by joining words instead of searching each name."""
    words = docs.select(doc, F.explode(F.array_distinct(F.split(F.lower("text"), r"[^a-z]+"))).alias("_w")).where("_w <> ''")
    return words.join(names.select(F.lower(name).alias("_w"), name).distinct(), "_w").select(doc, name)


def links_once(links: DataFrame, order: str) -> DataFrame:
    """Undirected links (kind, a, b), the first of each kind and pair."""
    keyed = links.withColumns({"_x": F.least("a", "b"), "_y": F.greatest("a", "b")})
    first = keyed.groupBy("kind", "_x", "_y").agg(F.min_by(F.struct("a", "b", "why"), F.col(order)).alias("l"))
    return first.select("kind", "l.*")


def similarity(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """``pairs`` with the Ratcliff-Obershelp ratio of two texts, batch by batch."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(ratio=[difflib.SequenceMatcher(None, a or "", b or "", autojunk=False).ratio() for a, b in zip(f[left], f[right], strict=True)])

    return pairs.mapInPandas(work, pairs.withColumn("ratio", F.lit(0.0)).schema)


def running_pages(lines: DataFrame, doc: str, at: str, text: str) -> DataFrame:
    """Each line's page (the last heading before it), kind of block and text without its mark."""
    from pyspark.sql import Window

    line = F.col(text)
    kind = F.when(line.rlike("^#+ "), "heading").when(line.rlike(r"^[-*] "), "list").when(line.startswith("|"), "table").when(F.trim(line) == "", "blank").otherwise("paragraph")
    up = Window.partitionBy(doc).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    page = F.last(F.when(kind == "heading", F.regexp_replace(line, "^#+ ", "")), ignorenulls=True).over(up)
    return lines.select(doc, at, kind.alias("kind"), page.alias("page"), F.regexp_replace(line, r"^(#+|[-*]) ", "").alias("body"))

"""Quality rules with distribution divergence against language references.

Fixed rules come first: counts of words, symbols, duplicate lines and repeated three-word windows. A text that passes them
is compared with references of each language, histograms of character classes and of common words summed over all
documents of that language: the Jensen-Shannon distance to the nearest language must stay under a limit for both, where
the words' is corrected for the divergence that a sample of that size has by chance. Each comparison has a minimum length, under which a histogram says too little and the text passes it.

Every word of the corpus is counted by language; tasks add up their own counts before they meet by word. A language's most
frequent words are its common words, all others share one bin. The references of the ``most_langs`` most frequent languages
are kept, so what is sent to the tasks is as large for any corpus.

Words: maximal runs of characters other than ASCII white space. Null and empty texts have no words and fail. Documents
without a language count for no reference but are judged like all others; without any reference only the fixed rules
hold. Every row gives one row. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count, repeat
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, in_batches

SPACES, SYMBOLS = " \t\n\x0b\x0c\r", "[#*$%&|<>]"
COMMON, CLASSES = 60, 8
#: Words that a task counts before it hands its counts on.
HELD_WORDS = 200_000
#: Class of each UTF-8 byte: lower, upper, digit, white space, sentence marks, symbols, other ASCII, non-ASCII; 8 for none.
CLASS_OF = np.array(
    [
        8 if 0x80 <= b < 0xC0 else 7 if b >= 0x80 else 0 if chr(b).islower() else 1 if chr(b).isupper() else 2 if chr(b).isdigit()
        else 3 if chr(b) in SPACES else 4 if chr(b) in ".,;:!?'\"()-" else 5 if chr(b) in SYMBOLS else 6
        for b in range(256)
    ],
    np.uint8,
)


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode("utf-8", "replace").split()
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    n = len(words)
    repeated = 0
    if n > 3:
        number: defaultdict[bytes, int] = defaultdict(count().__next__)
        ids = np.fromiter(map(number.__getitem__, words), np.int64, n)
        _, pair = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)
        _, window, counts = np.unique(pair[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
        again = counts[window] > 1
        cover = np.zeros(n, bool)
        for k in range(3):
            cover[k : k + n - 2] |= again
        repeated = int(cover.sum())
    return n, chars, symbols, len(lines) - len(set(lines)), repeated


def class_counts(text: bytes) -> np.ndarray:
    """Counts of character classes."""
    return np.bincount(CLASS_OF[np.frombuffer(text, np.uint8)], minlength=CLASSES + 1)[:CLASSES]


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2, 0 to 1) of a distribution to each row of ``q``."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=-1)
        right = np.where(q > 0, q * np.log2(q / m), 0).sum(axis=-1)
    return np.sqrt(np.maximum(0, (left + right) / 2))


class References:
    """Character-class and common-word shares of each language."""

    def __init__(self, classes: dict[str, np.ndarray], words: dict[str, list[tuple[bytes, int]]], totals: dict[str, int], common: int) -> None:
        self.langs = sorted(k for k, n in totals.items() if n > 0 and classes[k].sum() > 0)
        self.classes = np.array([classes[k] / classes[k].sum() for k in self.langs])
        lists = [sorted(words[k], key=lambda x: (-x[1], x[0]))[:common] for k in self.langs]
        self.number = {w: k for k, w in enumerate(sorted({w for x in lists for w, _ in x}))}
        # of each language: which words, none (the last number) where it has fewer, and their shares with that of all others last
        none = len(self.number)
        self.common = np.array([[self.number[w] for w, _ in x] + [none] * (common - len(x)) for x in lists]).reshape(len(self.langs), common)
        shares = [np.array([n for _, n in x] + [0] * (common - len(x))) / totals[k] for k, x in zip(self.langs, lists, strict=True)]
        self.words = np.array([np.append(x, max(0.0, 1 - x.sum())) for x in shares])

    def word_counts(self, words: list[bytes]) -> np.ndarray:
        """How often each common word of any language is among ``words``, with a 0 last."""
        found = np.fromiter(map(self.number.get, words, repeat(len(self.number))), np.int64, len(words))
        out = np.bincount(found, minlength=len(self.number) + 1)
        out[-1] = 0
        return out

    def divergence(self, classes: np.ndarray, words: np.ndarray, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's distances to the nearest reference, that of words less what a sample of their number shows by chance."""
        by_class = distance((classes / np.maximum(1, classes.sum(axis=1, keepdims=True)))[:, None], self.classes).min(axis=1)
        of = words[:, self.common]
        shares = np.concatenate([of, totals[:, None, None] - of.sum(axis=2, keepdims=True)], axis=2) / np.maximum(1, totals)[:, None, None]
        by_word = distance(shares, self.words).min(axis=1)
        chance = self.words.shape[1] / (8 * log(2) * np.maximum(1, totals))
        return by_class, np.sqrt(np.maximum(0, by_word**2 - chance))


def references(docs: DataFrame, *, common: int = COMMON, most_langs: int = 100) -> References:
    """The references of the most frequent languages, over all documents that have one."""
    known = docs.where("text is not null and lang is not null").select("text", "lang")

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: defaultdict[str, Counter[bytes]] = defaultdict(Counter)
        classes: defaultdict[str, np.ndarray] = defaultdict(lambda: np.zeros(CLASSES, np.int64))
        held = 0

        def handed() -> pa.RecordBatch:
            rows = [(lang, w, n, None) for lang, c in words.items() for w, n in c.items()] + [(lang, None, 0, x.tolist()) for lang, x in classes.items()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.string(), pa.binary(), pa.int64(), pa.list_(pa.int64())), strict=True)], ["lang", "word", "n", "classes"])

        for batch in batches:
            for text, lang in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist(), strict=True):
                before = len(words[lang])
                words[lang].update(text.lower().split())
                held += len(words[lang]) - before + 1
                classes[lang] += class_counts(text)
                if held >= HELD_WORDS:
                    yield handed()
                    words.clear()
                    classes.clear()
                    held = 0
        if classes:
            yield handed()

    counted = durable(in_batches(known, partial, "lang string, word binary, n long, classes array<long>").groupBy("lang", "word").agg(F.sum("n").alias("n"), *(F.sum(F.get("classes", k)).alias(f"c{k}") for k in range(CLASSES))))
    totals = counted.groupBy("lang").agg(F.sum("n").alias("n"), *(F.sum(f"c{k}").alias(f"c{k}") for k in range(CLASSES))).orderBy(F.desc("n"), "lang").limit(most_langs).collect()
    chosen = counted.where(F.col("word").isNotNull() & F.col("lang").isin([r["lang"] for r in totals]))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    top: defaultdict[str, list[tuple[bytes, int]]] = defaultdict(list)
    for r in chosen.select("lang", "word", "n", rank.alias("rank")).where(F.col("rank") <= common).collect():
        top[r["lang"]].append((bytes(r["word"]), r["n"]))
    classes = {r["lang"]: np.array([r[f"c{k}"] for k in range(CLASSES)], np.float64) for r in totals}
    return References(classes, top, {r["lang"]: r["n"] for r in totals}, common)


def quality_rules(
    docs: DataFrame,
    *,
    max_class_distance: float = 0.3,
    max_word_distance: float = 0.33,
    min_chars: int = 200,
    min_words: int = 50,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """The fixed counts, base_failed, both distances (null under their minimum length) and kept, for each document."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    held = docs.sparkSession.sparkContext.broadcast(references(source))
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance", "kept"]

    def judged(known: References, texts: list[str | None]) -> list[tuple]:
        """The counts, base_failed, both distances and kept of some texts."""
        raw = [(t or "").encode("utf-8", "replace") for t in texts]
        counts = [base_counts(t) for t in texts]
        sizes = np.array([c[0] for c in counts])
        by_class, by_word, chars = np.zeros(len(texts)), np.zeros(len(texts)), np.zeros(len(texts))
        if known.langs:
            classes = np.array([class_counts(t) for t in raw])
            words = np.array([known.word_counts(t.lower().split()) for t in raw])
            by_class, by_word = known.divergence(classes, words, sizes)
            chars = classes.sum(axis=1)
        rows = []
        for c, a, b, size in zip(counts, by_class.tolist(), by_word.tolist(), chars, strict=True):
            failed = c[0] < 50 or 100 * c[4] > 50 * c[0]
            a, b = a if known.langs and size >= min_chars else None, b if known.langs and c[0] >= min_words else None
            rows.append((*c, failed, a, b, not failed and (a or 0) <= max_class_distance and (b or 0) <= max_word_distance))
        return rows

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        at_once = max(1, 2000 // max(1, len(known.langs)))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            rows = [row for k in range(0, len(texts), at_once) for row in judged(known, texts[k : k + at_once])]
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.float64(), pa.bool_()]
            columns = list(zip(*rows, strict=True)) or [()] * 9
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, class_distance double, word_distance double, kept boolean"
    return in_batches(source.select("doc_id", "text"), work, schema)

"""The verdict of the quality rules against a plain computation over the whole table."""

from __future__ import annotations

from collections import Counter, defaultdict
from math import log, log2, sqrt

import pytest

from plazaflow.llm import rules

from ..conftest import SMALL


def kind(char: str) -> int:
    """A character's class: lower, upper, digit, white space, sentence mark, symbol, other ASCII, other."""
    if ord(char) > 127:
        return 7
    for k, has in enumerate((str.islower, str.isupper, str.isdigit)):
        if has(char):
            return k
    return 3 if char in " \t\n\x0b\x0c\r" else 4 if char in ".,;:!?'\"()-" else 5 if char in "#*$%&|<>" else 6


def apart(p: list[float], q: list[float]) -> float:
    """Jensen-Shannon distance of two distributions."""
    both = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
    half = lambda x: sum(a * log2(a / m) for a, m in zip(x, both, strict=True) if a)
    return sqrt(max(0.0, (half(p) + half(q)) / 2))


def shares(counts: list[int]) -> list[float]:
    return [c / max(1, sum(counts)) for c in counts]


def words_of(text: str) -> list[str]:
    # letters past ASCII keep their case
    return "".join(c.lower() if c.isascii() else c for c in text).translate({ord(c): " " for c in "\t\n\x0b\x0c\r"}).split(" ")


def test_verdict(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    words, classes = defaultdict(Counter), defaultdict(Counter)
    for d in docs:
        if d.text is not None and d.lang is not None:
            words[d.lang].update(w for w in words_of(d.text) if w)
            classes[d.lang].update(map(kind, d.text))
    common = {g: [w for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0].encode()))[:60]] for g, c in words.items()}

    def bins(counts: Counter, of: list[str]) -> list[float]:
        found = [counts[w] for w in of]
        return shares([*found, *[0] * (60 - len(of)), sum(counts.values()) - sum(found)])

    got = {r.doc_id: r for r in rules.quality_rules(spark.createDataFrame(docs, spark.read.parquet(f"{SMALL}/documents.parquet").schema)).collect()}
    kept = 0
    for d in docs:
        text = d.text or ""
        own, letters = Counter(w for w in words_of(text) if w), Counter(map(kind, text))
        n = sum(own.values())
        r = got[d.doc_id]
        by_class = min(apart(shares([letters[k] for k in range(8)]), shares([c[k] for k in range(8)])) for c in classes.values()) if letters.total() >= 200 else None
        by_word = None
        if n >= 50:
            nearest = min(apart(bins(own, common[g]), bins(words[g], common[g])) for g in words)
            by_word = sqrt(max(0.0, nearest**2 - 61 / (8 * log(2) * n)))
        assert r.class_distance == (by_class if by_class is None else pytest.approx(by_class, abs=1e-9))
        assert r.word_distance == (by_word if by_word is None else pytest.approx(by_word, abs=1e-9))
        verdict = not r.base_failed and (by_class or 0) <= 0.3 and (by_word or 0) <= 0.33
        assert r.kept == verdict and r.n_words == n
        kept += verdict
    assert 0 < kept < len(docs)

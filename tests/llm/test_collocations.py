"""Collocations against counting every phrase of every place."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plazaflow.llm import collocations as c

SCHEMA = "doc_id long, text string, lang string"


def brute(rows, longest, min_count, percent):
    counts, total = Counter(), Counter()
    for _, text, lang in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = [w for w in re.split("[ \t]+", piece) if w]
            total[lang or "und"] += len(words)
            for m in range(1, longest + 1):
                counts.update((lang or "und", tuple(words[i : i + m])) for i in range(len(words) - m + 1))
    kept = {k: n for k, n in counts.items() if n >= min_count and len(k[1]) > 1}
    outer = Counter()
    for (lang, p), n in kept.items():
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                outer[lang, p[i : i + m]] = max(outer[lang, p[i : i + m]], n)
    out = []
    for (lang, p), a in kept.items():
        if 100 * outer[lang, p] >= percent * a:
            continue
        n = total[lang]
        score, k = min((1000 * a * n // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p)))
        out.append((lang, " ".join(p), a, counts[lang, p[:k]], counts[lang, p[k:]], n, score))
    return sorted(out)


def rows_of(seed):
    rng = random.Random(seed)
    words = ["the", "The", "of", "x\x00y", "x\x01", "\x01", "\x00", "new", "york", "Ünd", "ﬁ", "a", "a\x01b", "🙂"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r\n", "\x0b"]) for _ in range(n))
    rows = [(k, text(rng.randint(0, 30)), rng.choice(["en", "en", "en", "fr", None])) for k in range(120)]
    rows += [(200, None, "en"), (201, "", "en"), (202, " .,; ", None), (None, "new york the of", None), (203, "many of the same words again", "en")]
    rows += [(300 + k, "a passage of eight words that is here often, new york", "de") for k in range(60)] + [(203, "many of the same words again", "en")] * 3
    return [*rows, (400, "word " * 400, "und"), (401, text(3000), "fr")]


@pytest.mark.parametrize(("seed", "longest", "min_count", "percent"), [(1, 5, 3, 100), (2, 5, 8, 60), (3, 2, 2, 100), (4, 3, 5, 100)])
def test_all_phrases(spark, monkeypatch, seed, longest, min_count, percent):
    rows = rows_of(seed)
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({n: F.lit(n) for n in ("phrase", "n", "key", "_range", "lefts")})
    got = c.collocations(docs, longest=longest, min_count=min_count, percent=percent)
    want = brute(rows, longest, min_count, percent)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 10


def test_shards_and_parts_are_cut_anywhere(spark, monkeypatch):
    rows = rows_of(9)
    for size, chunk in ((50, 7), (1, 1), (700, 40)):
        text, other = " ".join(r[1] for r in rows if r[1]), "New york, the of a"
        numbers, got = c._Numbers(), Counter()
        names = lambda ids: [list(numbers)[i] for i in ids]  # noqa: B023, E731
        monkeypatch.setattr(c, "CHUNK", chunk)
        for ids, own in c.numbered(c.END.join([text.encode(), other.encode()]), numbers, 4):
            for p, n in zip(*map(lambda x: sum(map(list, x), []), zip(*c.trie("en", list(numbers), np.append(ids, 0), np.arange(len(ids) + 1) < own, 1, 4, None), strict=True)), strict=True):
                got[p] += int(n)
        want = Counter()
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text + "\n" + other)):
            w = [c.escaped(x.encode()) for x in re.split("[ \t]+", piece) if x]
            want.update(c.SEP.join(w[i : i + m]) for m in range(1, 5) for i in range(len(w) - m + 1))
        assert got == want and names([0]) == [c.END] and size


def test_small_shards_give_the_same(spark, monkeypatch):
    local = [(t, g) for _, t, g in rows_of(5)]
    batches = [pa.RecordBatch.from_arrays([pa.array([t for t, _ in local[k : k + 9]], pa.string()), pa.array([g for _, g in local[k : k + 9]], pa.string())], ["text", "lang"]) for k in range(0, len(local), 9)]
    monkeypatch.setattr(c, "in_batches", lambda df, work, schema: work)

    def counts():
        out, shards = Counter(), 0
        for b in c.tries(None, 1, 5, None)(iter(batches)):
            shards += 1
            for lang, phrase, n in zip(*(x.to_pylist() for x in b.columns), strict=True):
                out[lang, phrase] += n
        return out, shards

    whole, few = counts()
    for k, v in {"SHARD": 40, "VOCABULARY": 6, "CHUNK": 30}.items():
        monkeypatch.setattr(c, k, v)
    cut, many = counts()
    assert cut == whole and many > 10 * few


def test_pairs_by_slices(spark, monkeypatch):
    rows = rows_of(6)
    docs = spark.createDataFrame([(t, g) for _, t, g in rows], "text string, lang string")
    every = spark.sparkContext.broadcast(np.full(c.BITS // 64 + 1, np.uint64(0xFFFFFFFFFFFFFFFF)))
    got = {r.place for r in c.frequent_pairs(docs, every, 5, 4).collect()}
    counts = Counter({(lang, p): n for lang, p, n in map(tuple, c.tries(docs, 2, 2, None).collect()) for p in [bytes(p)]})
    total = Counter()
    for r in c.tries(docs, 2, 2, None).collect():
        total[r.lang, bytes(r.phrase)] += r.n
    want = set()
    for (lang, p), n in total.items():
        h = c.word_hash(lang, p.split(c.SEP))
        if n >= 4:
            want.add(int(c.pair_number(h[:1], h[1:])[0]) % c.BITS)
    assert got == want and len(counts) > 20


def test_packing_of_numbers():
    rng = np.random.default_rng(2)
    for n in (0, 1, 5, 1000):
        numbers, counts = np.unique(rng.integers(0, c.PAIRS, n)), rng.integers(1, 2**31, n)
        a, b = c.unpacked(c.packed(numbers, counts[: len(numbers)]))
        assert a.tolist() == numbers.tolist() and b.tolist() == counts[: len(numbers)].tolist()
    numbers, counts = c.summed(np.array([5, 3, 5, 9, 3]), np.array([1, 2, 3, 4, 5]))
    assert numbers.tolist() == [3, 5, 9] and counts.tolist() == [7, 4, 4]


def test_collisions_lose_nothing():
    table = np.full(c.BITS // 64 + 1, np.uint64(0xFFFFFFFFFFFFFFFF))
    words = [c.END, b"a", b"b", b"c"]
    ids, own = np.array([1, 2, 3, 1, 2, 0, 3, 3, 0]), np.ones(9, bool)
    every = [(p, n.tolist()) for p, n in c.trie("en", words, ids, own, 1, 3, None)]
    assert [(p, n.tolist()) for p, n in c.trie("en", words, ids, own, 1, 3, c.Bits(table, True))][1:] == every[1:]
    assert [(p, n.tolist()) for p, n in c.trie("en", words, ids, own, 1, 3, c.Bits(table, False))] == every


def test_ranges_that_begin_inside_a_subtree(spark):
    phrases = [(b"\x00".join(p), k) for k, p in enumerate([[b"a"], [b"a", b"b"], [b"a", b"b", b"c"], [b"a", b"b", b"d"], [b"b"], [b"b", b"z"], [b"bb"], [b"bb", b"c"]], 1)]
    n = dict(phrases)
    df = spark.createDataFrame([("en", bytearray(p), k) for p, k in phrases] + [("fr", bytearray(p), 10 * k) for p, k in phrases], "lang string, phrase binary, n long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = c.with_parts(df, "phrase", "lefts").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for r in got:
        w = bytes(r.phrase).split(b"\x00")
        assert r.lefts == [n[b"\x00".join(w[:k])] * (10 if r.lang == "fr" else 1) for k in range(1, len(w))]
    assert len(got) == 16


def test_ranks_and_empty(spark):
    docs = spark.createDataFrame(rows_of(1), SCHEMA)
    top = c.first_of_each(c.collocations(docs, min_count=3), most=4).collect()
    for lang in {r.lang for r in top}:
        of = sorted((r for r in top if r.lang == lang), key=lambda r: r.rank)
        assert [r.rank for r in of] == list(range(1, len(of) + 1)) and len(of) <= 4
        assert [(-r.score, -r.a, r.phrase.encode()) for r in of] == sorted((-r.score, -r.a, r.phrase.encode()) for r in of)
    assert c.first_of_each(c.collocations(docs.where("false"))).count() == 0
    assert c.collocations(docs, min_count=10**6).count() == 0


def test_scores_past_64_bits(spark):
    big = 10**14
    df = spark.createDataFrame([("en", bytearray(b"a\x00b"), 10**13, big, [3 * 10**13], [2 * 10**13])], "lang string, phrase binary, n long, total long, lefts array<long>, rights array<long>")
    assert c.candidates(df).first().score == 1000 * 10**13 * big // (6 * 10**26)

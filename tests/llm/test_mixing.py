"""Mixing against sorting by hash, on odd and ordinary tables."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from plazaflow.llm import mixing

SCHEMA = "doc_id long, text string, source string"


def brute(rows, weights=(3, 1, 2), percent=150, most=2):
    """(doc_id, source, size, source_size, target, taken) by exact sharing and one sorted pass a source."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    key = lambda d, t: int(md5(str(d) if d is not None else "text " + md5(t or ""))[:15], 16)
    sums = defaultdict(int)
    for _, text, source in rows:
        sums[source] += size(text)
    order = sorted(sums, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    goal, free, left = {}, set(order), Fraction(percent * sum(sums.values()), 100)
    while free:
        unit = left / sum(weight[s] for s in free)
        over = {s for s in free if unit * weight[s] > most * sums[s] or not sums[s]}
        if not over:
            goal |= {s: unit * weight[s] for s in free}
            break
        goal |= {s: Fraction(most * sums[s]) for s in over}
        left -= sum(most * sums[s] for s in over)
        free -= over
    limit, whole = {}, {}
    for s in order:
        whole[s] = int(goal[s] // sums[s]) if sums[s] else 0
        rest, at, limit[s] = goal[s] - whole[s] * sums[s], 0, -1
        by_hash = Counter()
        for d, text, source in rows:
            if source == s and size(text):
                by_hash[key(d, text)] += size(text)
        for h in sorted(by_hash) if rest else ():
            if abs(at + by_hash[h] - rest) < abs(at - rest):
                limit[s] = h
            at += by_hash[h]
            if at > rest:
                break
    return sorted(((d, s, size(t), sums[s], float(goal[s]), size(t) * (whole[s] + (key(d, t) <= limit[s]))) for d, t, s in rows), key=str)


def tables():
    rng = random.Random(5)
    text = lambda n: " \t\n".join(rng.choice(["a", "Ünd", "c d"]) for _ in range(n))
    hot = [(k, text(rng.choice([1, 3, 8])), "hot") for k in range(300)]
    odd = [(1, None, "x"), (2, "", "x"), (3, " \n ", None), (None, "no id", "x"), (None, "no id", "x"), (None, None, None), (4, text(5000), None), (5, "same row", "é"), (5, "same row", "é"), (5, "same id", "z"), (6, "\x0b one\x0ctwo\r\n ", "zz")]
    small = [(1000 + k, text(rng.randint(0, 40)), f"s{k % 23}") for k in range(200)]
    return {"odd": hot + odd + small, "one": [(1, "one two three", "a")], "blank": [(1, None, None), (2, "", "a")], "even": [(k, "w", "a") for k in range(10)], "many": [(k, "w " * (k % 7), f"{k % 90}") for k in range(400)]}


@pytest.mark.parametrize("name", tables())
def test_mix(spark, name):
    rows = tables()[name]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(c) for c in ("size", "hash", "target", "limit", "_source", "row", "place")})
    got = sorted(map(tuple, mixing.mix(docs).select("doc_id", "source", "size", "source_size", "target", "taken").collect()), key=str)
    assert [x[:4] + x[5:] for x in got] == [x[:4] + x[5:] for x in brute(rows)]
    assert [x[4] for x in got] == pytest.approx([x[4] for x in brute(rows)], rel=1e-12)


def test_a_larger_budget_takes_all_of_a_smaller_one(spark):
    docs = spark.createDataFrame(tables()["odd"], SCHEMA)
    took = [{str(r.doc_id) + str(r.source): r.taken for r in mixing.mix(docs, percent=p, most=4).collect()} for p in (30, 90, 150, 250)]
    for less, more in zip(took, took[1:], strict=False):
        assert all(less[k] <= more[k] for k in less) and sum(less.values()) < sum(more.values())


def test_wide_tables_of_sources_go_by_a_join(spark, monkeypatch):
    rows = tables()["many"]
    docs = spark.createDataFrame(rows, SCHEMA)
    few = sorted(map(tuple, mixing.mix(docs).collect()))
    monkeypatch.setattr(mixing, "SMALL", 3)
    assert sorted(map(tuple, mixing.mix(docs).collect())) == few


def test_the_mix_holds_rows_as_often_as_they_are_taken(spark):
    docs = spark.createDataFrame(tables()["odd"], SCHEMA).withColumns({c: F.lit(c) for c in ("row", "hash", "some", "limit")})
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    want = Counter()
    for r in mixing.mix(docs).collect():
        want[r.doc_id, r.size] += r.taken // r.size if r.size else 0
    got = Counter((r.doc_id, r.n) for r in mixed.select("doc_id", mixing.words(F.col("text")).alias("n")).collect())
    assert got == +want


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert mixing.mix(docs).count() == 0 and mixing.mixed(docs).count() == 0


def test_no_python_in_the_plan(spark):
    plan = mixing.sized(spark.createDataFrame(tables()["odd"], SCHEMA), "doc_id", "text", "source")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan.replace("LocalTableScan", "")

"""Rows, not ids, decide in the pipeline's stages; one stored index serves several benchmarks."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plazaflow.llm import decontam, neardup, pii


NAMES = ["_id", "key", "row", "h1", "found", "least", "_key", "check", "component", "id"]


def with_clashes(df):
    return df.withColumns({c: F.lit(c) for c in NAMES})


def test_masking_goes_by_row(spark):
    docs = [(k, f"Please call us at +1 (555) 010-{1000 + k} today.") for k in range(12)]
    call, other = "You may call us at 555-0199-33 today.", "An entirely different text of the same document id, without any."
    docs += [(50, call), (50, other), (None, call), (None, None), (51, "")]
    df = with_clashes(spark.createDataFrame(docs, "doc_id long, text string"))
    got = pii.masked(df)
    assert got.columns == df.columns and got.count() == len(docs)
    want = call.replace("555-0199-33", "<phone>")
    texts = sorted((str(r.doc_id), str(r.text)) for r in got.collect() if r.doc_id not in range(12))
    assert texts == sorted([("50", want), ("50", other), ("None", want), ("None", "None"), ("51", "")])
    shuffled = pii.masked(df, broadcast_bytes=0)
    assert sorted(map(str, shuffled.collect())) == sorted(map(str, got.collect()))
    assert pii.masked(df.where("false")).count() == 0


def test_context_is_whole_words_however_far(spark):
    far = "telephone" + " " * 500 + "number" + "-" * 300
    assert pii.Context(f"{far} 1").before(len(far) + 1) == "telephone number"
    assert pii.Context("Über ñandu12").before(10) == "über ñandu" and pii.Context("").before(0) == ""


LINE = "one text with quite a few words that some rows have and that others have in nearly the same way as it is here"


def test_one_of_each_group_goes_by_row(spark):
    other = "totally other words that have nothing in common with the rest of the rows but share an id"
    docs = [(1, LINE), (1, other), (2, LINE), (3, LINE + " again"), (None, LINE), (None, "a text without an id that stands alone in this table"), (None, None), (7, None), (8, ""), (8, ""), (9, "  \t"), (4, "lone"), (4, "lone"), (None, "lone too"), (None, "lone too")]
    df = with_clashes(spark.createDataFrame(docs, "doc_id long, text string"))
    got = neardup.one_of_each_group(df)
    assert got.columns == df.columns
    want = [(1, LINE), (1, other), (None, "a text without an id that stands alone in this table"), (None, None), (7, None), (8, ""), (8, ""), (9, "  \t"), (4, "lone"), (None, "lone too")]
    assert sorted(map(str, ((r.doc_id, r.text) for r in got.collect()))) == sorted(map(str, want))
    assert neardup.one_of_each_group(df.where("false")).count() == 0


def test_many_repeated_rows_cost_no_pairs(spark):
    near = LINE.replace("quite", "rather")
    docs = [(1, LINE)] * 400 + [(2, near)] * 400 + [(k, LINE) for k in range(10, 300)] + [(None, LINE)] * 50
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = [(r.doc_id, r.text) for r in neardup.one_of_each_group(df, percent=50).collect()]
    assert got == [(1, LINE)]
    groups = neardup.near_duplicates(df, width=5, percent=50)
    assert groups.count() == len(docs) and {r.component_id for r in groups.collect()} == {1, None}


def test_contaminated_rows_go_whatever_the_columns(spark):
    leak = " ".join(f"w{k}" for k in range(12))
    docs = with_clashes(spark.createDataFrame([(None, f"x {leak} y"), (1, leak), (1, "clean"), (2, None), (3, "")], "doc_id long, text string"))
    items = spark.createDataFrame([(5, leak), (None, "clean"), (6, None)], "item_id long, text string")
    for rows in (200_000, 0):
        got = decontam.without_contaminated(docs, items, broadcast_rows=rows)
        assert got.columns == docs.columns and sorted(str(r.text) for r in got.collect()) == ["", "None", "clean"]
    assert decontam.without_contaminated(docs.where("false"), items).count() == 0
    assert decontam.without_contaminated(docs, items.where("false")).count() == 5


def test_one_stored_index_serves_two_benchmarks(spark):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(60)]
    docs = spark.createDataFrame([(k, " ".join(rng.choice(words) for _ in range(200))) for k in range(60)], "doc_id long, text string").repartition(5)
    texts = {r.doc_id: r.text.split() for r in docs.collect()}
    index = decontam.build_index(docs, shard_words=900)
    assert index.agg(F.sum(F.size("doc_ids"))).first()[0] == 60
    for seed in (1, 2):
        pick = random.Random(seed)
        items = [(k, " ".join(texts[d][a : a + 15])) for k in range(8) for d, a in [(pick.randrange(60), pick.randrange(180))]]
        items.append((90, " ".join(texts[3] + texts[4] + texts[5])))
        bench = spark.createDataFrame(items, "item_id long, text string")
        fresh = sorted(map(str, decontam.digest(decontam.contamination(docs, bench)).collect()))
        for options in ({}, {"block_chars": 100}, {"block_chars": 400}):
            assert sorted(map(str, decontam.digest(decontam.contamination(docs, bench, index=index, **options)).collect())) == fresh
    # blocks of a search belong to the same rows even where the source has no fixed order
    mixed = docs.repartition(3, F.rand())
    assert sorted(map(str, decontam.digest(decontam.contamination(mixed, bench, block_chars=100)).collect())) == fresh


def test_windows_are_bounded_in_bytes():
    rng = random.Random(4)
    text = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(280_000)).encode()
    test = decontam.Windows([(1, text)], 10)
    assert len(text) < 2_000_000 and sum(x.nbytes for x in (test.grid, test.bounds, test.items)) + len(test.blob) < 20_000_000


def shingled(text, width):
    w = (text or "").encode().lower().split()
    return set(zip(*(w[k:] for k in range(width)), strict=False)) if len(w) >= width else {tuple(w)} if w else set()


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_recall_of_links_against_all_rows(spark, width, percent):
    """Every link of the documents whose id is divisible by 20 is inside one group: brute force against all rows."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    group = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs, width=width, percent=percent).collect()}
    rows = docs.collect()
    number: dict = {}
    sets = {r.doc_id: np.array(sorted(number.setdefault(s, len(number)) for s in shingled(r.text, width)), np.int64) for r in rows}
    by_shingle: dict[int, list[int]] = {}
    for d, s in sets.items():
        for x in s.tolist():
            by_shingle.setdefault(x, []).append(d)
    links = missed = 0
    for d in (k for k in sets if k % 20 == 0):
        common: dict[int, int] = {}
        for x in sets[d].tolist():
            for other in by_shingle[x]:
                common[other] = common.get(other, 0) + 1
        for other, n in common.items():
            if other != d and 100 * n >= percent * (len(sets[d]) + len(sets[other]) - n):
                links += 1
                missed += group[d] != group[other]
    assert links > 20 and missed == 0
    assert set(group) == {r.doc_id for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id").collect()}



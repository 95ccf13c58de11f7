"""Whitening against exact integers and a dense eigendecomposition."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from plazaflow.llm import whitening as w

from ..conftest import MEDIUM

SCHEMA = "vec_id long, embedding array<double>"


def expected(rows, k=8):
    good = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    sizes = [len(v) for _, v in good]
    d = max(set(sizes), key=lambda s: (sizes.count(s), s))
    good = [(i, v) for i, v in good if len(v) == d]
    x = [[math.floor(Fraction(1024) * Fraction(c)) + 100000 for c in v] for _, v in good]
    n, s = len(x), [sum(col) for col in zip(*x, strict=True)]
    t = [[n * a - b for a, b in zip(row, s, strict=True)] for row in x]
    centred = np.array([[float(Fraction(a, n)) for a in row] for row in t])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    trace = float(sum(Fraction(a * a, n * n) for row in t for a in row) / n)
    return [i for i, _ in good], n, [sum(a * a for a in row) for row in t], centred @ axes / np.sqrt(values), values / trace


def held_against(got, rows, k=8):
    ids, n, deviations, white, shares = expected(rows, k)
    by = {}
    for r in got:
        by.setdefault((str(r.vec_id), r.component), []).append(r)
    assert len(got) == len(ids) * white.shape[1] and {r.n for r in got} == {n}
    table = np.array([[by[str(i), c + 1][0].whitened for c in range(white.shape[1])] for i in ids])
    assert np.abs(np.abs(table) - np.abs(white)).max() < 1e-7
    assert all(np.allclose(table[:, c], white[:, c], atol=1e-6) or np.allclose(table[:, c], -white[:, c], atol=1e-6) for c in range(white.shape[1]))
    assert [by[str(i), 1][0].deviation for i in ids] == [v if v < 2**63 else None for v in deviations]
    assert np.allclose([by[str(ids[0]), c + 1][0].explained for c in range(white.shape[1])], shares, rtol=1e-9)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-8


def test_table(spark):
    df = spark.read.parquet(f"{MEDIUM}/embeddings.parquet")
    held_against(w.whiten(df).collect(), [(r.vec_id, r.embedding) for r in df.collect()])


@pytest.mark.parametrize("scale", [1e-2, 1.0, 1e6, 1e13, 1e40])
def test_exact_at_any_scale(spark, scale):
    rng = np.random.default_rng(3)
    rows = [(k, (rng.standard_normal(5) * [9, 7, 5, 3, 1] * scale).tolist()) for k in range(40)]
    got = w.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    if scale < 1:
        assert len(got) == 200  # steps of 1/1024 are coarse here
    held_against(got, rows)


def test_odd_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(k, rng.standard_normal(3).tolist()) for k in range(30)] + [(40, None), (41, []), (42, [1.0, None, 2.0]), (43, [1.0, math.nan, 2.0]), (44, [math.inf, 1.0, 1.0]), (45, [1.0, 2.0]), (None, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(c) for c in ("vector", "part", "n", "component", "d")})
    held_against(w.whiten(df).collect(), rows)
    doubled = w.whiten(df.unionByName(df)).collect()
    assert len(doubled) == 2 * 31 * 3 and {r.n for r in doubled} == {62}


def test_tables_without_spread(spark):
    one = spark.createDataFrame([(1, [1.0, 2.0])], SCHEMA)
    assert w.whiten(one).count() == 0 and w.whiten(one.where("false")).count() == 0
    assert w.whiten(spark.createDataFrame([(k, [1.0, 2.0]) for k in range(5)], SCHEMA)).count() == 0
    line = w.whiten(spark.createDataFrame([(k, [float(k), 2.0 * k, 0.5]) for k in range(5)], SCHEMA)).collect()
    assert {r.component for r in line} == {1} and line[0].explained == pytest.approx(1)


@pytest.mark.parametrize(("d", "width", "kind"), [(300, 8, "falling"), (300, 16, "equal"), (40, 8, "low"), (12, 16, "falling"), (200, 8, "blind")])
def test_lanczos(d, width, kind):
    rng = np.random.default_rng(6)
    q = np.linalg.qr(rng.standard_normal((d, d)))[0]
    values = {"falling": 0.9 ** np.arange(d), "equal": np.r_[np.full(12, 5.0), np.ones(d - 12)], "low": np.r_[3.0, 2.0, np.zeros(d - 2)], "blind": np.r_[9.0, 8.0, 7.0, np.full(d - 3, 1e-3)]}[kind]
    passes = []

    def product(block):
        passes.append(block.shape[1])
        return q @ (values[:, None] * (q.T @ block))

    found, axes, residuals = w.block_lanczos(product, d, 8, width)
    want = np.sort(values)[::-1][:8]
    assert np.allclose(found[: len(want)], want, atol=1e-11) and residuals.max() < 1e-10
    assert np.abs(axes.T @ axes - np.eye(axes.shape[1])).max() < 1e-12 and sum(passes) <= d
    if kind == "falling" and d == 300:
        assert sum(passes) < d


def test_breakdown_restarts():
    basis = np.eye(6)[:, :2]
    more = w.orthonormal(np.zeros((6, 3)), basis, 3, 1.0, np.random.default_rng(1))
    assert more.shape == (6, 3) and np.abs(np.hstack([basis, more]).T @ np.hstack([basis, more]) - np.eye(5)).max() < 1e-12


def test_sums_do_not_depend_on_partitions(spark):
    df = spark.read.parquet(f"{MEDIUM}/embeddings.parquet")
    a = {(r.vec_id, r.component): r.whitened for r in w.whiten(df).collect()}
    b = {(r.vec_id, r.component): r.whitened for r in w.whiten(df.repartition(7, "label")).collect()}
    assert a.keys() == b.keys() and max(abs(a[k] - b[k]) for k in a) < 1e-6

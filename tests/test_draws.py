"""Draws of many pairs at once against hashlib and against brute force."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from plazaflow.catalog import QUERIES
from plazaflow.functions import draws as D
from plazaflow.operators import stochastic as K

from .conftest import SMALL


def plain(seed, c, s):
    return (int(hashlib.md5("|".join(str(v) for v in (seed, c, s, 0) if v is not None).encode()).hexdigest()[:8], 16) + 0.5) / 4294967296.0


def test_uniforms_are_those_of_the_text():
    rng = random.Random(3)
    for m in range(1, 20):
        for n in (1, 2, 5, 19):
            heads, tails = ([str(rng.randrange(10 ** (k - 1), 10**k)) for _ in range(3)] for k in (m, n))
            got = D.uniforms(D.heads(np.array([f"7|{h}|".encode() for h in heads])), D.tails(np.array([t.encode() for t in tails]), m + 3, b"|0"))
            assert got.tolist() == [[plain(7, h, t) for t in tails] for h in heads]
    with pytest.raises(ValueError):
        D.tails(np.array([b"1" * 30]), 24, b"|0")


@pytest.mark.parametrize("within", [None, 4.0])
@pytest.mark.parametrize("pairs", [1, 50, 1 << 15])
def test_least_draws(spark, within, pairs):
    rng = random.Random(5)
    spot = lambda: None if rng.random() < 0.1 else float(rng.randrange(60))
    people = [(k, rng.randrange(4), spot()) for k in [*range(95, 140), -3, 10**12]] + [(None, 1, 3.0), (500, 9, 1.0), (501, None, 1.0)]
    options = [(s, rng.randrange(3), spot()) for s in [*range(2, 60, 3), *range(98, 120), -7, 10**15]] + [(300, 3, None), (None, 1, 2.0)]
    df = lambda rows, k: spark.createDataFrame(rows, f"{k} long, {k}_g int, {k}_x double")
    cost = lambda x, y, s: np.abs(x - y) / 3 - np.log(1.0 + s % 2)
    got = {r.c: (r.s, r.near) for r in K.least_draws(df(people, "c"), df(options, "s"), ("c", "s"), ("c_g", "s_g"), ("c_x", "s_x"), 7, cost, within, pairs).collect()}
    want = {}
    for c, g, x in people:
        met = [(s, y) for s, h, y in options if h == g and s is not None]
        drawn = [(abs(x - y) / 3 - math.log(1.0 + s % 2) + math.log(-math.log(plain(7, c, s))), s, abs(x - y)) for s, y in met if x is not None and y is not None]
        close = [d for d in drawn if within is not None and d[2] <= within]
        if met and g is not None:
            want[c] = (min(close or drawn, default=(0, None))[1], bool(close))
    assert got == want and any(s is None for s, _ in want.values()) and (within is None or len({n for _, n in want.values()}) == 2)


def test_equal_costs_go_to_the_smaller_id(spark):
    people, options = spark.range(40).selectExpr("id AS c", "0 AS g", "0D AS x"), spark.range(30).selectExpr("29 - id AS s", "0 AS h", "CAST(id AS DOUBLE) AS y")
    even = lambda x, y, s: np.full(np.broadcast(x, y).shape, np.inf)
    assert {r.s for r in K.least_draws(people, options, ("c", "s"), ("g", "h"), ("x", "y"), 7, even, pairs=64).collect()} == {0}


@pytest.mark.parametrize("name", ["softmin_choice", "gravity_choice"])
def test_choices_draw_without_texts_of_pairs(spark, name):
    """A text, a hash and a number from its digits for each pair were some 5 CPU microseconds."""
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().toString()
    assert "md5" not in plan and "transform" not in plan and "CoGroup" in plan

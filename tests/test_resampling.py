"""Exact resampling and grouped quantiles against plain versions."""

import math
import random

import numpy as np
import pytest

from antecede.operators import evaluation as e, resampling as rs


@pytest.mark.parametrize("cell", [256, 8])
def test_each_sample_draws_as_many_clusters_as_there_are(spark, monkeypatch, cell):
    monkeypatch.setattr(rs, "CELL", cell)
    rng = random.Random(3)
    rows = [(k % 300, "x" if k % 300 % 3 else "y", rng.gauss(1, 2), rng.uniform(1, 2)) for k in range(900)]
    df = spark.createDataFrame(rows, "g int, c string, a double, b double")
    got = rs.drawn_sums(df, ["c"], "a", "b", "g", 400, 7).collect()
    n = {c: len({g for g, x, *_ in rows if x == c}) for c in "xy"}
    assert len(got) == 800 and all(r["draws"] == n[r["c"]] for r in got)
    again = {(r["c"], r["sample"]): r["a"] for r in rs.drawn_sums(df.repartition(7), ["c"], "a", "b", "g", 400, 7).collect()}
    assert {(r["c"], r["sample"]): pytest.approx(r["a"]) for r in got} == again
    # A sample's mean and variance are those of n draws with replacement.
    for c in "xy":
        sums = {}
        for g, x, a, _ in rows:
            if x == c:
                sums[g] = sums.get(g, 0.0) + a
        v = np.array(list(sums.values()))
        drawn = np.array([r["a"] for r in got if r["c"] == c])
        assert drawn.mean() == pytest.approx(v.sum(), abs=5 * v.std() * math.sqrt(len(v) / 400))
        assert drawn.std() == pytest.approx(v.std() * math.sqrt(len(v)), rel=0.15)
    assert rs.drawn_sums(df.limit(0), [], "a", "b", "g", 10, 7).collect() == []


def test_exact_interval_is_that_of_a_plain_resampler(spark, monkeypatch):
    monkeypatch.setattr(rs, "CELL", 16)
    rng = random.Random(5)
    rows = [(k % 150, rng.gauss(1, 3), rng.uniform(1, 2)) for k in range(450)]
    df = spark.createDataFrame(rows, "g int, a double, b double")
    got = e.bootstrap_ratio(df, "a", "b", "g", 1500, draws="exact").first()
    a, b = np.zeros(150), np.zeros(150)
    for g, x, y in rows:
        a[g] += x
        b[g] += y
    at = np.random.default_rng(1).integers(0, 150, (3000, 150))
    low, high = np.quantile(a[at].sum(1) / b[at].sum(1), [0.05, 0.95])
    assert got["estimate"] == pytest.approx(a.sum() / b.sum())
    assert (got["lower"], got["upper"]) == (pytest.approx(low, abs=0.08 * (high - low)), pytest.approx(high, abs=0.08 * (high - low)))


def test_splits_are_multinomial():
    sizes = {(0, 0): 10, (1, 0): 6, (1, 1): 4, (2, 0): 5, (2, 1): 1, (2, 3): 4}
    drawn = [rs.cell_draws(1, "", 2, cell, [sizes[level, cell >> (2 - level)] for level in range(3)], 5000) for cell in (0, 1, 3)]
    assert (sum(drawn) == 10).all()
    assert [d.mean() for d in drawn] == [pytest.approx(x, abs=0.15) for x in (5, 1, 4)]
    assert [d.var() for d in drawn] == [pytest.approx(10 * p * (1 - p), rel=0.15) for p in (0.5, 0.1, 0.4)]


@pytest.mark.parametrize("parts", [1024, 3])
def test_quantiles_of_groups(spark, monkeypatch, parts):
    monkeypatch.setattr(rs, "PARTS", parts)
    rng = random.Random(8)
    rows = []
    for k in range(1500):
        g = "hot" if k % 2 else rng.choice(["a", "b", None])
        v = rng.choice([None, 0.0, 1e300, -1e308, rng.gauss(0, 1), float(rng.randint(0, 3)), rng.gauss(0, 1) * 1e-9])
        rows.append((g, v))
    rows += [("one", 4.0), ("none", None), *(("same", 7.0) for _ in range(200))]
    shares = [0.0, 0.1, 0.5, 0.77, 1.0]
    want = {}
    for g in {g for g, _ in rows}:
        v = sorted(x for y, x in rows if y == g and x is not None)
        if v:
            want[g] = []
            for s in shares:
                p = s * (len(v) - 1)
                a, b = v[int(p)], v[min(int(p) + 1, len(v) - 1)]
                want[g].append(pytest.approx(a + (p - int(p)) * (b - a), rel=1e-9))
    df = spark.createDataFrame(rows, "g string, v double")
    for most in (100, 1_000_000):
        got = {r["g"]: r["q"] for r in rs.group_quantiles(df, ["g"], "v", shares, most=most).collect()}
        assert got == want

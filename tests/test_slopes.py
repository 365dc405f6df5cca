"""The slope selection against all pairs."""

import numpy as np
import pytest

from lotlens.operators import slopes, stats


def pairwise(x, y):
    a, b = np.triu_indices(len(x), 1)
    some = x[a] != x[b]
    return np.median((y[b] - y[a])[some] / (x[b] - x[a])[some]) if some.any() else None


def test_inversions():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 17, 64, 200):
        values = rng.integers(0, max(1, n // 2) + 1, n).astype(float)
        want = {(i, j) for i in range(n) for j in range(i + 1, n) if values[i] > values[j]}
        assert slopes.inversions(values) == len(want)
        a, b = slopes.inversions(values, listed=True)
        assert set(zip(a.tolist(), b.tolist())) == want and len(a) == len(want)


@pytest.mark.parametrize("kind", ["plain", "ties in x", "whole numbers", "flat", "line", "wild"])
@pytest.mark.parametrize("n", [2, 3, 4, 30, 301])
@pytest.mark.parametrize("all_pairs", [0, 250_000])
def test_equals_the_median_of_all_pairs(kind, n, all_pairs, monkeypatch):
    monkeypatch.setattr(slopes, "ALL_PAIRS", all_pairs)
    rng = np.random.default_rng(n)
    x = rng.random(n) * 100_000 if kind in ("plain", "wild") else rng.integers(0, 12, n).astype(float)
    y = {"flat": np.zeros(n), "line": 3 * x, "whole numbers": rng.integers(0, 9, n).astype(float)}.get(kind, 40_000 - 0.09 * x + rng.normal(0, 900, n))
    if kind == "wild":
        y = y * 10.0 ** rng.integers(-8, 9, n)
    want, got = pairwise(x, y), slopes.median_slope(x, y)
    assert (want is None) == (got is None)
    if want is not None:
        assert got == pytest.approx(want, rel=1e-11, abs=1e-11)


def test_many_points():
    rng = np.random.default_rng(7)
    x = rng.random(40_000) * 200_000
    y = 50_000 - 0.09 * x + rng.normal(0, 500, len(x))
    slope = slopes.median_slope(x, y)
    assert slope == pytest.approx(-0.09, abs=1e-3)
    below = slopes._below(x, y, slope)
    assert abs(below - len(x) * (len(x) - 1) // 4) <= 1


def test_large_groups_give_the_same_lines(spark):
    rng = np.random.default_rng(3)
    rows = [(g, float(a), float(40_000 - 0.1 * a + e), i) for g in "abc" for i, (a, e) in enumerate(zip(rng.integers(0, 150, 120) * 1000, rng.normal(0, 800, 120)))]
    rows += [("two", 1.0, 2.0, 1), ("two", 2.0, 3.0, 2), ("one x", 5.0, 1.0, 1), ("one x", 5.0, 2.0, 2), ("one x", 5.0, 3.0, 3), ("null", None, 1.0, 1), ("null", 1.0, None, 2), ("null", 3.0, 5.0, 3)]
    df = spark.createDataFrame(rows, "g string, x double, y double, i int")
    small = {r.g: r.asDict() for r in stats.theil_sen(df, ["g"], "x", "y", "i").collect()}
    large = {r.g: r.asDict() for r in stats.theil_sen(df, ["g"], "x", "y", "i", large=True).collect()}
    assert small.keys() == large.keys() == {"a", "b", "c"}
    for g, row in small.items():
        assert large[g] == {k: v if isinstance(v, str) else pytest.approx(v, rel=1e-9) for k, v in row.items()}

"""Operator 12 against a plain covariance in numpy."""

from __future__ import annotations

import math

import numpy as np
import pytest

from papyra.llm.whitening import centred, deviations, r_factor, whiten


def plain(vectors, components=32):
    """Rows by (id, component): n, deviation, |whitened|, explained."""
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    m = np.array(x, float) - np.array(sums) / n
    values, axes = np.linalg.eigh(m.T @ m / n)
    order = np.argsort(-values)
    values, axes = values[order], axes[:, order]
    out = {}
    for (i, _), row, own in zip(vectors, m, x, strict=True):
        deviation = sum((n * c - s) ** 2 for c, s in zip(own, sums, strict=True))
        for k in range(min(components, len(values))):
            out.setdefault((i, k + 1), []).append((n, deviation, abs(row @ axes[:, k]) / math.sqrt(values[k]), values[k] / values.sum()))
    return out


def held(rows):
    out = {}
    for r in rows:
        out.setdefault((r["vec_id"], r["component"]), []).append(r)
    return out


def vectors(n, dim, seed=1):
    r = np.random.default_rng(seed)
    mixed = r.normal(size=(n, dim)) @ r.normal(size=(dim, dim)) + 3
    return [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(mixed)]


@pytest.mark.parametrize(("n", "dim", "parts"), [(300, 7, 40), (90, 40, 3), (500, 3, 1)])
def test_equals_plain_covariance(spark, n, dim, parts):
    data = vectors(n, dim)
    table = spark.createDataFrame(data, "vec_id long, embedding array<float>").repartition(parts)
    rows = whiten(table).collect()
    want, got = plain(data), held(rows)
    assert set(got) == set(want)
    for key, (w,) in want.items():
        (g,) = got[key]
        assert (g["n"], g["deviation"]) == w[:2]
        assert abs(g["whitened"]) == pytest.approx(w[2], abs=1e-7)
        assert g["explained"] == pytest.approx(w[3], rel=1e-9)
    y = np.zeros((n, max(r["component"] for r in rows)))
    for r in rows:
        y[r["vec_id"], r["component"] - 1] = r["whitened"]
    y -= y.mean(axis=0)
    error = np.abs(y.T @ y / n - np.eye(y.shape[1])).max()
    assert error < 1e-9 and len({r["identity_error"] for r in rows}) == 1
    assert rows[0]["identity_error"] == pytest.approx(error, abs=1e-10)


def test_odd_rows(spark):
    data = vectors(40, 3)
    odd = [(100, None), (101, [1.0, None, 2.0]), (102, [float("nan")] * 3), (103, [float("inf"), 0.0, 0.0]), (104, [])]
    table = spark.createDataFrame([(i, v, 9, "x") for i, v in data + odd + [data[0], (None, data[1][1])]], "vec_id long, embedding array<float>, component int, n string")
    rows = whiten(table).collect()
    want = plain(data + [data[0], (None, data[1][1])])
    assert {k: len(v) for k, v in held(rows).items()} == {k: len(v) for k, v in want.items()}
    assert {r["n"] for r in rows} == {42}


def test_without_variance_and_empty(spark):
    schema = "vec_id long, embedding array<float>"
    assert whiten(spark.createDataFrame([], schema)).count() == 0
    assert whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 5, schema)).count() == 0
    flat = [(i, [float(i), 7.0, 2.0 * i]) for i in range(20)]  # one direction only
    rows = whiten(spark.createDataFrame(flat, schema)).collect()
    assert {r["component"] for r in rows} == {1} and rows[0]["explained"] == pytest.approx(1) and rows[0]["identity_error"] < 1e-9


def test_two_lengths(spark):
    a, b = vectors(20, 2), [(50 + i, v) for i, v in vectors(30, 4)]
    rows = whiten(spark.createDataFrame(a + b, "vec_id long, embedding array<float>")).collect()
    assert {(r["vec_id"] < 50, r["n"], r["component"]) for r in rows} == {(True, 20, 1), (True, 20, 2)} | {(False, 30, k) for k in range(1, 5)}


def test_wide_numbers_stay_exact():
    x = np.array([[2**50, 3], [-(2**50), 5]])
    d = centred(x, 10**9, np.array([7, 8], dtype=object))
    assert d.tolist() == [[10**9 * 2**50 - 7, 3 * 10**9 - 8], [-(10**9) * 2**50 - 7, 5 * 10**9 - 8]]
    assert deviations(d) == [None, None]
    assert deviations(np.array([[3_000_000_000, 1]])) == [9_000_000_000_000_000_001]
    m = np.random.default_rng(2).normal(size=(50, 4))
    parts = r_factor(m[30:], r_factor(m[:30]))
    assert np.allclose(parts.T @ parts, m.T @ m)

"""Whitening against exact integers and a dense decomposition."""

import collections
import math

import numpy as np
import pytest

from estatum.llm import whitening

SCHEMA = "vec_id long, embedding array<double>"


def check(rows, vectors, tolerance=1e-9):
    """Rows of whiten against brute force over {id: vector}, by position in the table."""
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in vectors]
    d, n = max(map(len, x)), len(x)
    x = [v + [1_000_000] * (d - len(v)) for v in x]
    s = [sum(c) for c in zip(*x, strict=True)]
    y = [[n * c - t for c, t in zip(v, s, strict=True)] for v in x]
    a = np.array([[c / n for c in v] for v in y])
    values, axes = np.linalg.eigh((a.T @ a / n).astype(float))
    values, axes = values[::-1], axes[:, ::-1]
    by = collections.defaultdict(dict)
    for r in rows:
        by[r.vec_id, r.deviation].setdefault(r.component, []).append(r)
    k = min(32, int((values > 1e-9 * values[0]).sum()))
    keys = [(i, sum(c * c for c in v)) for (i, _), v in zip(vectors, y, strict=True)]
    assert set(by) == set(keys)
    for parts in by.values():
        assert sorted(parts) == list(range(1, k + 1))
        assert all(r.n == n and abs(r.explained - values[r.component - 1] / values.sum()) < 1e-9 and r.identity_error < 1e-9 for p in parts.values() for r in p)
    z = np.array([[by[i][c][0].whitened for c in range(1, k + 1)] for i in keys])
    assert np.abs(z.T @ z / n - np.eye(k)).max() < 1e-9
    want = a @ axes[:, :k] / np.sqrt(values[:k])
    gaps = [min([abs(values[c] - values[o]) for o in range(d) if o != c] or [1]) > 1e-3 * values[0] for c in range(k)]
    for c in np.flatnonzero(gaps):
        assert min(np.abs(z[:, c] - want[:, c]).max(), np.abs(z[:, c] + want[:, c]).max()) < tolerance * 1e3
    return z


def test_query(spark, folder):
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()
    check(whitening.op12_whitening(spark, folder).collect(), [tuple(r) for r in rows])


def test_awkward_rows(spark):
    rng = np.random.default_rng(0)
    good = [(i, (rng.normal(size=5) * [5, 3, 2, 1, 0.5]).tolist()) for i in range(60)] + [(7, [1.0, 2.0, 3.0, 4.0, 5.0]), (8, [9.0]), (9, [])]
    bad = [(100, None), (101, [1.0, None, 1.0, 1.0, 1.0]), (102, [float("nan")] * 5), (103, [float("inf"), 0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(*r, "x") for r in good + bad], SCHEMA + ", n string").repartition(3)
    out = whitening.whiten(df).collect()
    assert {r.vec_id for r in out} == {i for i, _ in good}
    check([r for r in out], good)
    ids = spark.createDataFrame([(None, [1.0, 2.0]), (1, [3.0, 1.0])], SCHEMA)
    assert {r.vec_id for r in whitening.whiten(ids).collect()} == {None, 1}


def test_dependent_and_constant_columns(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(-40, 40, (200, 3))
    v = [(i, [a / 64, (2 * a) / 64, 1.0, b / 64, (a + b) / 64, c / 6400000]) for i, (a, b, c) in enumerate(x.tolist())]
    out = whitening.whiten(spark.createDataFrame(v, SCHEMA)).collect()
    assert {r.component for r in out} == {1, 2, 3} and all(r.identity_error < 1e-9 for r in out)
    check(out, v)


def test_narrow_components(spark):
    """Small components beside great ones: the covariance alone has lost them."""
    rng = np.random.default_rng(2)
    base = rng.integers(-(2**30), 2**30, 400)
    v = [(i, [int(b) / 64, (int(b) + int(e)) / 64]) for i, (b, e) in enumerate(zip(base, rng.integers(-2, 3, 400), strict=True))]
    out = whitening.whiten(spark.createDataFrame(v, SCHEMA)).collect()
    assert {r.component for r in out} == {1, 2} and all(r.identity_error < 1e-4 for r in out)


def test_great_entries(spark):
    v = [(1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [2.0**50, 3.0])]
    x = [[min(max(math.floor(64 * c), -(2**62)), 2**62) + 1_000_000 for c in a] for _, a in v]
    s = [sum(c) for c in zip(*x, strict=True)]
    out = whitening.whiten(spark.createDataFrame(v, SCHEMA)).collect()
    for r in out:
        assert r.deviation == min(sum((3 * c - t) ** 2 for c, t in zip(x[r.vec_id - 1], s, strict=True)), 2**63 - 1)


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0]), (2, [1.0])], [(1, [])], [(1, None)]])
def test_nothing_to_whiten(spark, rows):
    out = whitening.whiten(spark.createDataFrame(rows, SCHEMA))
    assert out.count() == 0 and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]

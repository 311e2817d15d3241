"""Whitening against NumPy; weights, repeats, hot vectors, odd entries."""

import math

import numpy as np
import pytest

from assayloom.llm import whitening as op

SCHEMA = "vec_id long, embedding array<float>, label int, component int, x string"


def rows_of(x, ids=None):
    return [(int(i) if i is not None else None, None if v is None else [None if c is None else float(c) for c in v], 0, 1, "x") for i, v in zip(ids or range(len(x)), x)]


def plain(x, most=16):
    """x-vectors of rows; n, sums, whitened and explained by row."""
    v = np.floor(64 * np.array(x, np.float32).astype(float)).astype(np.int64) + 1_000_000
    u = np.unique(v, axis=0)
    n, s = len(u), u.sum(0)
    c = u - s / n
    cov = c.T @ c / n
    e, q = np.linalg.eigh(cov)
    e, q = e[::-1][:most], q[:, ::-1][:, :most]
    return n, [int(d) for d in ((n * v - s) ** 2).sum(1)], (v - s / n) @ q / np.sqrt(e), e / np.trace(cov)


def test_against_numpy_with_repeats_and_null_ids(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 24)) * np.linspace(1, 3, 24)
    x[200:] = x[5]                      # a third of all rows is one vector
    ids = [None if 40 <= k < 150 else k for k in range(300)]
    got = op.whiten(spark.createDataFrame(rows_of(x, ids), SCHEMA).repartition(4), ["vec_id"]).collect()
    n, dev, white, share = plain(x)
    assert len(got) == 300 * 16 and {r.n for r in got} == {n} == {200}
    by_id = {}
    for r in got:
        by_id.setdefault(r.vec_id, []).append(r)
    assert len(by_id[None]) == 110 * 16
    for k in (0, 5, 39, 150, 199, 200, 299):
        mine = sorted(by_id[k], key=lambda r: r.component)
        assert {r.deviation for r in mine} == {dev[k]}
        np.testing.assert_allclose(np.abs([r.whitened for r in mine]), np.abs(white[k]), atol=1e-9)
        np.testing.assert_allclose([r.explained for r in mine], share, rtol=1e-9)
    assert {r.identity_error for r in got}.pop() < 1e-9
    # one sign for all rows
    sign = {c: {np.sign(r.whitened) * np.sign(white[k][c - 1]) for k in range(150, 200) for r in by_id[k] if r.component == c} for c in range(1, 17)}
    assert all(len(s) == 1 for s in sign.values())


def test_counts_as_weights(spark):
    rng = np.random.default_rng(2)
    x = np.repeat(rng.normal(size=(30, 5)), rng.integers(1, 9, 30), axis=0)
    got = op.whiten(spark.createDataFrame(rows_of(x), SCHEMA), weights="count").toPandas()
    v = np.floor(64 * x.astype(np.float32).astype(float))
    e = np.sort(np.linalg.eigvalsh(np.cov(v.T, bias=True)))[::-1]
    assert got.n.unique().tolist() == [len(x)] and got.identity_error.max() < 1e-9
    np.testing.assert_allclose(got.groupby("component").explained.first(), e / e.sum(), rtol=1e-9)


def test_rows_that_take_no_part_and_short_vectors(spark):
    x = [[1, 2, 3], None, [1, None, 2], [math.nan, 1, 1], [math.inf, 1, 1], [], [4, 0, 1], [2, 2], [0, 5, 2], [1, 2, 3]]
    got = op.whiten(spark.createDataFrame(rows_of(x), SCHEMA)).collect()
    assert {r.vec_id for r in got} == {0, 6, 7, 8, 9} and len(got) == 15
    n, dev, _, _ = plain([[1, 2, 3], [4, 0, 1], [2, 2, 0], [0, 5, 2]])
    assert {r.n for r in got} == {n} and {(r.vec_id, r.deviation) for r in got} == {(0, dev[0]), (9, dev[0]), (6, dev[1]), (7, dev[2]), (8, dev[3])}


@pytest.mark.parametrize("x", [[], [None, [None]], [[]]])
def test_empty(spark, x):
    got = op.whiten(spark.createDataFrame(rows_of(x), SCHEMA))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and got.collect() == []


def test_constant_data_has_no_scale(spark):
    got = op.whiten(spark.createDataFrame(rows_of([[1, 2]] * 7), SCHEMA)).collect()
    assert len(got) == 14 and all(r.whitened is None and r.deviation == 0 and r.n == 1 and r.identity_error == 0 for r in got)


def test_huge_entries_saturate(spark):
    x = [[1e30, 1.0], [-1e30, 2.0], [3.0, 4.0], [5.0, 1.0]]
    got = op.whiten(spark.createDataFrame([(k, v, 0, 1, "x") for k, v in enumerate(x)], SCHEMA.replace("float", "double"))).collect()
    assert len(got) == 8 and all(math.isfinite(r.whitened) for r in got if r.component == 1) and all(r.deviation is None for r in got)


def test_kept_columns_may_have_the_names_of_helpers(spark):
    got = op.whiten(spark.createDataFrame(rows_of([[1, 2], [2, 1], [3, 3]]), SCHEMA), ["x", "label"])
    assert got.columns[:2] == ["x", "label"] and got.count() == 6


def test_sums_are_exact():
    n, big = 3, [3 * (1 << 53) + 1, -5]
    c = op.Centre(n, big)
    x = np.array([[1 << 53, -2]], np.int64)
    assert c.deviation(x) == [(n * (1 << 53) - big[0]) ** 2 + (n * -2 + 5) ** 2]

"""Keyed bijections of ranks, and the frames of responses in random orders that they make."""

import numpy as np
import pytest
from test_pls import data, frame

from latentspark.operators import resample


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 20, 100, 1000, 1025, (1 << 16) + 1])
def test_bijections_are_one_to_one(n):
    got = resample.bijection(np.arange(n), n, resample.round_keys(7, "a", 20, n))
    assert all((np.sort(row) == np.arange(n)).all() for row in got)
    some = np.random.default_rng(0).permutation(n)[:7]
    np.testing.assert_array_equal(resample.bijection(some, n, resample.round_keys(7, "a", 20, n)), got[:, some])


def test_wide_ranks_use_64_bits():
    n = (1 << 33) + 5
    some = np.arange(n - 300, n)
    got = resample.bijection(some, n, resample.round_keys(1, "b", 3, n))
    assert got.min() >= 0 and got.max() < n and all(len(np.unique(row)) == 300 for row in got)


@pytest.mark.parametrize("n", [4, 6, 12, 20, 33])
def test_orders_are_alike(n):
    """Pairs of places of two ranks: chi-square within four standard deviations of its mean."""
    got = resample.bijection(np.arange(n), n, resample.round_keys(3, "c", 12_000, n))
    for a, b in ((0, 1), (1, n - 1)):
        seen = np.zeros((n, n))
        np.add.at(seen, (got[:, a], got[:, b]), 1)
        off, want = ~np.eye(n, dtype=bool), 12_000 / (n * (n - 1))
        chi, df = ((seen[off] - want) ** 2 / want).sum(), n * (n - 1) - 1
        assert abs(chi - df) < 4 * np.sqrt(2 * df)


def test_permuted_frames(spark, monkeypatch):
    x, y, w = data(40, 3)
    f = frame(spark, x, y, w)
    rows = lambda g: g.rows.toPandas().sort_values("row_id")
    sent = rows(resample.permuted(f, 5, "p", 6))
    got = np.array(sent.y.to_list())
    np.testing.assert_array_equal(got[:, 0], y)
    assert all(sorted(got[:, j]) == sorted(y) and (got[:, j] != y).any() for j in range(7) if j) and len({tuple(c) for c in got.T}) == 7
    np.testing.assert_array_equal(np.array(sent.x.to_list()), x)
    np.testing.assert_array_equal(sent.w, w)
    other = rows(resample.permuted(frame(spark, x, y, w, parts=7), 5, "p", 6))
    np.testing.assert_array_equal(np.array(other.y.to_list()), got)
    monkeypatch.setattr(resample, "SENT", 0)  # joined instead of broadcast
    joined = rows(resample.permuted(f, 5, "p", 6))
    np.testing.assert_array_equal(np.array(joined.y.to_list()), got)
    np.testing.assert_array_equal(joined.w, w)

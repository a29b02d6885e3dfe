"""Rejections without an effect: rates of all methods, and p-values against single tests of single simulations."""

import numpy as np
import pytest
from test_pls import data, frame

import latentspark as ls
from latentspark import errors
from latentspark.operators import calibration, fit, inference, moments, resample

SMALL = {"raw_perm": {"n_perm": 400}, "split_exact": {"n_perm": 400, "n_splits": 8}, "split_nb": {"n_splits": 40}}


@pytest.mark.parametrize("weighted,keep", [(False, None), (True, None), (True, 2)])
def test_no_method_rejects_too_often(spark, weighted, keep):
    """The effect that the data hold is gone in every simulation."""
    x, y, w = data(60, 6, snr=3.0)
    r = ls.pls1_calibration(frame(spark, x, y, w if weighted else None), args=SMALL, seed=11, keep=keep)
    rates = r.rates.toPandas().set_index("method")
    assert set(rates.index) == set(inference.METHODS) and (rates.n_sim == 200).all()
    assert rates.calibrated.all(), rates
    p = r.p_values.toPandas()
    assert len(p) == 1000 and p.pvalue.between(0, 1).all()
    for m, own in p.groupby("method"):
        assert (own.pvalue <= 0.05).sum() == rates.rejected[m]
    exact = p[p.method == "split_exact"].pvalue  # uniform where the null is exact
    assert abs(exact.mean() - 0.5) < 4 * np.sqrt((1 / 200 + 1 / 400) / 12)


@pytest.mark.parametrize("k,weighted", [(1, False), (2, True)])
def test_p_values_are_those_of_single_tests(spark, monkeypatch, k, weighted):
    x, y, w = data(40, 6)
    f = frame(spark, x, y, w if weighted else None)
    run = lambda: ls.pls1_calibration(f, k, methods=("score", "split_nb", "e"), n_sim=6, args={"split_nb": {"n_splits": 5}}, seed=4)
    by = lambda r: r.p_values.toPandas().set_index(["method", "simulation"]).pvalue
    got = by(run())
    moved = resample.permuted(f, 4, "simulated", 6).rows.toPandas().sort_values("row_id")
    orders = np.array(moved.y.to_list())
    for i in (0, 5):
        g = frame(spark, x, orders[:, 1 + i], w if weighted else None)
        for m, a in (("score", {}), ("split_nb", {"n_splits": 5, "force": True}), ("e", {})):
            assert got[m, i] == pytest.approx(ls.pls1_confirmatory_test(g, k, method=m, args=a, seed=4).pvalue, abs=1e-9)
    monkeypatch.setattr(fit, "MANY", 1)  # over rows
    np.testing.assert_allclose(by(run()), got, atol=1e-9)


def test_pooled_p_counts_ties_and_failures():
    p = calibration.pooled_p(np.array([9.0, 1.0, 2.0, 5.0, 0.0, 2.0, np.nan, 3.0]), 3)
    np.testing.assert_allclose(p, [4 / 5, 4 / 5, 2 / 5])


def test_pooled_statistics_are_those_of_the_tests(spark):
    """The first draws of a simulated frame, tested by themselves, have the statistics that the pool holds."""
    x, y, _ = data(40, 4)
    f = frame(spark, x, y)
    info = moments.validate(f)
    pool = resample.permuted(f, 4, "simulated", 9)
    r2 = inference.held_out_r2(*inference.fold_sums(pool, info, 1, 5, 4, None))
    order = np.array(pool.rows.toPandas().sort_values("row_id").y.to_list())[:, 3]
    assert ls.pls1_confirmatory_test(frame(spark, x, order), method="raw_perm", args={"n_perm": 3}, seed=4).statistic == pytest.approx(r2[3], abs=1e-9)


def test_arguments(spark):
    x, y, _ = data(20, 3)
    f = frame(spark, x, y)
    for bad in ({"alpha": 0.0}, {"n_sim": 0}, {"methods": ("score",), "args": {"e": {}}}, {"methods": ("none",)}, {"args": {"raw_perm": {"n_perm": 0}}}):
        with pytest.raises(errors.InvalidArgument):
            ls.pls1_calibration(f, **bad)

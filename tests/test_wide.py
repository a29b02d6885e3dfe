"""Row forms of fits, tests and intervals against moment forms, against plain NumPy, on many and on nearly collinear features."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from rowform import pls1, standardise
from test_pls import data, frame

import latentspark as ls
from latentspark.operators import fit, inference, moments, resample, selection, wide


def array_frame(spark, x, y, w=None, parts=3):
    """Many features as one array column."""
    rows = pd.DataFrame({"id": range(len(x)), "x": [v.tolist() for v in x], "y": y} | ({} if w is None else {"w": w}))
    return ls.feature_frame(spark.createDataFrame(rows).repartition(parts), "x", "y", "id", None if w is None else "w", d=x.shape[1])


@pytest.mark.parametrize("method,k,keep,args,weighted", [("raw_perm", 2, 3, {"n_perm": 5}, True), ("split_exact", 1, None, {"n_perm": 30, "n_splits": 4}, True), ("split_exact", 2, 3, {"n_perm": 4, "n_splits": 3}, False), ("split_nb", 2, None, {"n_splits": 6, "force": True}, True), ("score", 1, None, {}, True), ("e", 2, None, {}, True)])
def test_row_tests_equal_moment_tests(spark, monkeypatch, method, k, keep, args, weighted):
    x, y, w = data(40, 6, snr=0.3)
    f = frame(spark, x, y, w if weighted else None)
    run = lambda: ls.pls1_confirmatory_test(f, k, method=method, args=args, seed=5, keep=keep)
    want = run()
    monkeypatch.setattr(fit, "MANY", 1)
    got = run()
    assert got.pvalue == pytest.approx(want.pvalue, abs=1e-9) and got.statistic == pytest.approx(want.statistic, abs=1e-8)
    assert got.stable_rank == pytest.approx(want.stable_rank, rel=1e-8) if want.stable_rank else got.stable_rank is None


def test_row_selection_and_intervals_equal_moments(spark, monkeypatch):
    x, y, w = data(120, 6, snr=1)
    w[:30] = 0
    f = frame(spark, x, y, w)
    info = moments.validate(f)
    cand = [(1, None), (3, None), (2, 2)]
    cv = lambda: selection.fold_scores(f, info, 3, 4, cand).toPandas().sort_values(["fold", "candidate"]).r2.to_numpy()
    ci = lambda: ls.pls1_confirmatory_test(f, 2, method="score", ci=True, n_boot=100, seed=4).ci
    null = lambda: ls.pls1_perm_null(f, 2, n_perm=100, seed=4).per_feature.toPandas().sort_values("feature").to_numpy()
    bic = lambda: ls.pls1_find_k_optimal(f, 3, selector="bic").bic_scores
    pre = lambda: np.array(ls.preprocess(f).rows.toPandas().sort_values("row_id").x.to_list())
    want = cv(), ci(), null(), bic(), pre()
    monkeypatch.setattr(fit, "MANY", 1)
    got = cv(), ci(), null(), bic(), pre()
    np.testing.assert_allclose(got[0], want[0], atol=1e-8)
    sort = lambda c: c.per_feature.toPandas().sort_values("feature").to_numpy()
    np.testing.assert_allclose(sort(got[1]), sort(want[1]), atol=1e-7)
    assert got[1].holdout_corr.point == pytest.approx(want[1].holdout_corr.point, abs=1e-8)
    np.testing.assert_allclose(got[2], want[2], atol=1e-7)
    assert got[3] == pytest.approx(want[3])
    np.testing.assert_allclose(got[4], want[4], atol=1e-9)


def plain_split_z(x, y, splits, k, w=None):
    """Correlations in the held-out halves, by the textbook's rows."""
    out = []
    for tr in splits:
        coef, *_ = pls1(x[tr], y[tr], k, None if w is None else w[tr])
        _, mean, sd = standardise(x[tr], None if w is None else w[tr])
        root = np.ones((~tr).sum()) if w is None else np.sqrt(w[~tr] / w[~tr].mean())
        out.append(np.corrcoef(((x[~tr] - mean) / sd * root[:, None]) @ coef, y[~tr] * root)[0, 1])
    return np.array(out)


@pytest.mark.parametrize("weighted", [True])
def test_five_thousand_features(spark, monkeypatch, weighted):
    """split_exact by tiles of rows with rows, and by fits over rows; score from rows x rows."""
    monkeypatch.setattr(wide, "TILE_ROWS", 13)  # several tiles
    rng = np.random.default_rng(1)
    n, d = 30, 5000
    x = rng.normal(size=(n, d)) + 3
    y, w = x[:, :40].sum(1) + rng.normal(size=n), rng.uniform(0.5, 2, n) if weighted else None
    f = array_frame(spark, x, y, w)
    info = moments.validate(f)
    perms = resample.permuted(f, 5, "perm", 12)
    assert wide.kernel_is_cheaper(15, 15, d, 113) and not wide.kernel_is_cheaper(15, 15, d, 1)
    ranked = resample.ranks(f.rows, 5, "split", 3).toPandas()
    splits = [np.isin(np.arange(n), ranked[(ranked.b == b) & (ranked["rank"] < 15)].row_id) for b in range(3)]
    ys = np.array(perms.rows.orderBy("row_id").toPandas().y.to_list())
    sets = resample.halves(f.rows, 5, "split", 3, 15)
    want = np.array([plain_split_z(x, ys[:, j], splits, 1, w) for j in range(13)]).T
    tiles = wide.split_tiles(perms, sets, 3)
    np.testing.assert_allclose(np.array([tiles[b] for b in range(3)]), want, atol=1e-9)
    by_fits = inference.split_rows(f, info, sets, [0, 1, 2], 2, None).toPandas().sort_values("b").r
    np.testing.assert_allclose(by_fits, plain_split_z(x, y, splits, 2, w), atol=1e-8)

    p, t = inference.score_rows(f)
    xs, ys1 = standardise(x, w)[0], standardise(y[:, None], w)[0][:, 0]
    root = np.ones(n) if w is None else np.sqrt(w * n / w.sum())
    xs, ys1 = xs * root[:, None], ys1 * root
    e = np.linalg.eigvalsh(xs @ xs.T)
    assert t == pytest.approx(((xs.T @ ys1) ** 2).sum(), rel=1e-10)
    assert p == pytest.approx(inference.matched(t, e.sum(), (e * e).sum())[0], rel=1e-9)
    assert inference.gate(f, info).stable_rank == pytest.approx(e.sum() / e[-1], rel=1e-8)


def test_square_norm_from_either_side(spark, monkeypatch):
    monkeypatch.setattr(wide, "RANGE", 8 * 9 * 4)
    rng = np.random.default_rng(2)
    for n, d in ((40, 9), (9, 40)):
        x, w = rng.normal(size=(n, d)), rng.uniform(1, 2, n)
        f = array_frame(spark, x, x[:, 0], w)
        z = standardise(x, w)[0] * np.sqrt(w * n / w.sum())[:, None]
        got = wide.square_norm(f, wide.standards(f, None, [0], range(0))[0])
        assert got == pytest.approx(((z.T @ z) ** 2).sum(), rel=1e-10)


def test_chooser_takes_both_ways(spark, monkeypatch):
    monkeypatch.setattr(fit, "MANY", 1)
    taken = []
    own = wide.split_tiles
    monkeypatch.setattr(wide, "split_tiles", lambda *a: taken.append(1) or own(*a))
    x, y, _ = data(12, 60)
    f = frame(spark, x, y)
    for n_perm, tiles in ((2, 0), (120, 1)):
        taken.clear()
        r = ls.pls1_confirmatory_test(f, 1, method="split_exact", args={"n_perm": n_perm, "n_splits": 2}, seed=1)
        assert len(taken) == tiles and 0 < r.pvalue <= 1


def collinear():
    x, y, _ = data(90, 2, snr=1)
    return np.column_stack([x, x + np.random.default_rng(8).normal(size=x.shape) * 1e-5]), y


def test_nearly_collinear_intervals_and_folds_go_over_rows(spark, monkeypatch):
    again = []
    for module, name, place in ((inference, "subsample_rows", 2), (selection, "fold_score_rows", 2)):
        own = getattr(module, name)
        monkeypatch.setattr(module, name, lambda *a, own=own, place=place: again.append(len(a[place])) or own(*a))
    x, y = collinear()
    f = frame(spark, x, y)
    k = 3
    whole = ls.pls1_fit(f, k)
    ci = ls.pls1_confirmatory_test(f, k, method="score", ci=True, n_boot=100, seed=4).ci
    assert ci.n_boot_finite == 100
    table = ci.per_feature.toPandas().sort_values("feature")
    np.testing.assert_allclose(table.beta_ref, whole.beta, rtol=1e-9)
    info = moments.validate(f)
    got = selection.fold_scores(f, info, 9, 3, [(k, None)]).toPandas().sort_values("fold").r2.to_numpy()
    rank = {v["row_id"]: v["rank"] for v in resample.ranks(f.rows, 9, "fold", 1).collect()}
    fold = np.array([rank[i] // 30 for i in range(90)])
    for j in range(3):
        tr = fold != j
        _, beta, b0, *_ = pls1(x[tr], y[tr], k)
        res, tot = ((y[~tr] - x[~tr] @ beta - b0) ** 2).sum(), ((y[~tr] - y[~tr].mean()) ** 2).sum()
        assert got[j] == pytest.approx(1 - res / tot, abs=1e-6)
    assert again == [100, 3]


def test_sets_equal_single_fits(spark, monkeypatch):
    monkeypatch.setattr(wide, "RANGE", 8 * 6 * 20)  # several ranges
    x, y, w = data(50, 6)
    f = frame(spark, x, y, w)
    labels = F.array(F.lit(0), F.pmod(F.col("row_id"), F.lit(2)).cast("int") + 1)
    seen = {}
    for some in wide.fit_sets(f, labels, [0, 1, 2], 3, 4):
        seen |= some
    for s, own in ((0, np.full(50, True)), (1, np.arange(50) % 2 == 0), (2, np.arange(50) % 2 == 1)):
        coef, _, _, w_, *_ = pls1(x[own], y[own], 3, w[own], 4)
        np.testing.assert_allclose(seen[s].coef(0), coef, atol=1e-9)
        np.testing.assert_allclose(seen[s].weights(0), w_, atol=1e-9)
        assert seen[s].n_eff == pytest.approx(w[own].sum() ** 2 / (w[own] ** 2).sum())

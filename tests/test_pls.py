import math

import numpy as np
import pandas as pd
import pytest
from rowform import pls1, standardise

import latentspark as ls
from latentspark import errors, results
from latentspark.operators.fit import preprocess
from latentspark.sources.frame import feature_frame
from latentspark.functions import kernels, special
from latentspark.operators import fit, moments, resample
from latentspark.operators.inference import split_correlations
from latentspark.streaming.moments import stream_totals


def data(n=60, d=6, seed=1, snr=2.0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) + np.arange(d) * 10
    return x, snr * (x[:, 0] + x[:, 1]) + rng.normal(size=n), rng.uniform(0.5, 2, n)


def frame(spark, x, y, w=None, parts=3):
    pdf = pd.DataFrame(x, columns=[f"x{j}" for j in range(x.shape[1])]).assign(id=range(len(x)), y=y)
    if w is not None:
        pdf["w"] = w
    df = spark.createDataFrame(pdf).repartition(parts)
    return ls.feature_frame(df, [f"x{j}" for j in range(x.shape[1])], "y", "id", "w" if w is not None else None)


@pytest.mark.parametrize("k,keep,weighted", [(1, None, False), (3, None, False), (2, None, True), (2, 2, False), (2, 3, True)])
def test_fit_equals_row_form(spark, k, keep, weighted):
    x, y, w = data()
    w = w if weighted else None
    m = ls.pls1_fit(frame(spark, x, y, w), k, keep=keep)
    coef, beta, intercept, *_ = pls1(x, y, k, w, keep)
    np.testing.assert_allclose(m.coef, coef, atol=1e-9)
    np.testing.assert_allclose(m.beta, beta, atol=1e-9)
    assert m.intercept == pytest.approx(intercept, abs=1e-7)
    assert m.weighted == weighted


@pytest.mark.parametrize("k,keep,weighted", [(1, None, False), (3, None, True), (2, 3, True)])
def test_row_fit_equals_moment_fit(spark, monkeypatch, k, keep, weighted):
    x, y, w = data()
    f = frame(spark, x, y, w if weighted else None)
    want = ls.pls1_fit(f, k, keep=keep)
    monkeypatch.setattr(fit, "MANY", 1)
    got = ls.pls1_fit(f, k, keep=keep)
    for name in ("coef", "beta", "w", "p", "q", "x_mean", "x_scale"):
        np.testing.assert_allclose(getattr(got, name), getattr(want, name), atol=1e-9)
    assert got.intercept == pytest.approx(want.intercept, abs=1e-8)


def test_nearly_collinear_features_fit_over_rows(spark):
    x, y, _ = data()
    x = np.column_stack([x, x + np.random.default_rng(8).normal(size=x.shape) * 1e-6])
    _, beta, b0, *_ = pls1(x, y, 8)
    m = ls.pls1_fit(frame(spark, x, y), 8)
    assert m.k_used == 8
    np.testing.assert_allclose(x @ m.beta + m.intercept, x @ beta + b0, atol=1e-3)


def test_many_features(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(20, 300)) + 50, rng.normal(size=20)
    np.testing.assert_allclose(ls.pls1_fit(frame(spark, x, y), 2).coef, pls1(x, y, 2)[0], atol=1e-9)


def test_full_rank_fit_is_weighted_least_squares(spark):
    x, y, w = data(30, 4)
    m = ls.pls1_fit(frame(spark, x, y, w), 4)
    a = np.column_stack([np.ones(30), x]) * np.sqrt(w)[:, None]
    sol = np.linalg.lstsq(a, y * np.sqrt(w), rcond=None)[0]
    np.testing.assert_allclose([m.intercept, *m.beta], sol, atol=1e-7)


def test_weights_laws(spark):
    x, y, _ = data(40, 4)
    plain = ls.pls1_fit(frame(spark, x, y), 2)
    uniform = ls.pls1_fit(frame(spark, x, y, np.full(40, 3.0)), 2)
    np.testing.assert_allclose(uniform.beta, plain.beta, atol=1e-10)
    assert not uniform.weighted
    times = np.resize([1, 2, 1, 3], 40)
    copies = ls.pls1_fit(frame(spark, np.repeat(x, times, 0), np.repeat(y, times)), 2)
    np.testing.assert_allclose(ls.pls1_fit(frame(spark, x, y, times.astype(float)), 2).beta, copies.beta, atol=1e-9)


def test_sparse_with_all_features_is_dense(spark):
    x, y, _ = data()
    np.testing.assert_array_equal(ls.spls1_fit(frame(spark, x, y, parts=1), 2, 6).coef, ls.pls1_fit(frame(spark, x, y, parts=1), 2).coef)


def test_preprocess_predict_scores_and_rotation(spark):
    x, y, w = data()
    f = frame(spark, x, y, w)
    p = ls.preprocess(f)
    rows = p.rows.toPandas().sort_values("row_id")
    xs, mean, sd = standardise(x, w)
    np.testing.assert_allclose(np.array(rows.x.to_list()), xs, atol=1e-9)
    np.testing.assert_allclose(p.x_mean, mean, atol=1e-9)
    assert rows.w.mean() == pytest.approx(1) and p.n_eff == pytest.approx(w.sum() ** 2 / (w**2).sum())
    m = ls.pls1_fit(f, 2)
    got = ls.pls1_predict(m, f.rows).toPandas().sort_values("row_id").prediction
    np.testing.assert_allclose(got, x @ m.beta + m.intercept, atol=1e-8)
    t = np.array(ls.scores(m, f).toPandas().sort_values("row_id").scores.to_list())
    np.testing.assert_allclose(t, xs @ kernels.score_weights(m.w, m.p), atol=1e-9)
    r = ls.rotate(m)
    spun = np.array(ls.scores(r, f).toPandas().sort_values("row_id").scores.to_list())
    np.testing.assert_allclose(spun, t @ r.rotation_spec.r, atol=1e-9)
    np.testing.assert_allclose(r.p @ r.q, m.p @ m.q, atol=1e-10)
    with pytest.raises(errors.AlreadyRotated):
        ls.rotate(r)
    pre = ls.pls1_fit(f.with_rows(p.rows), 2, pre_standardized=True)
    np.testing.assert_allclose(pre.coef, m.coef, atol=1e-9)


def test_varimax_improves_and_is_orthogonal():
    a = np.random.default_rng(0).normal(size=(20, 3))
    r, sweeps, _ = kernels.varimax(a)
    np.testing.assert_allclose(r.T @ r, np.eye(3), atol=1e-12)
    unit = kernels.row_unit(a)
    assert sweeps > 1 and kernels.varimax_criterion(unit @ r) >= kernels.varimax_criterion(unit)


def test_special_functions():
    assert special.t_sf(2.228138852, 10) == pytest.approx(0.025, abs=1e-8)
    assert special.t_sf(-1.0, 1) == pytest.approx(0.75)
    assert special.chi2_sf(18.307038, 10) == pytest.approx(0.05, abs=1e-7)
    assert special.chi2_sf(400, 2) == pytest.approx(math.exp(-200), rel=1e-10)
    assert special.betainc(2, 3, 0.4) == pytest.approx(0.5248)
    assert math.isnan(special.t_sf(1, 0)) and special.chi2_sf(-1, 3) == 1


def test_constant_and_duplicate_columns(spark):
    x, y, _ = data()
    x = np.column_stack([x, np.full(60, 1000.1), x[:, 0]])
    m = ls.pls1_fit(frame(spark, x, y), 2)
    assert m.coef[6] == 0 and m.coef[0] == pytest.approx(m.coef[7])
    assert ls.pls1_fit(frame(spark, np.column_stack([x[:, 0], x[:, 0], x[:, 0]]), y), 3).k_used == 1


@pytest.mark.parametrize("weighted", [False, True])
def test_split_correlations_equal_rows(spark, weighted):
    x, y, w = data(40, 5)
    w = w if weighted else None
    f = frame(spark, x, y, w)
    info = moments.validate(f)
    got = {r["b"]: r["r"] for r in split_correlations(f, info, 2, 4, 7, None).collect()}
    for b in range(4):
        inside = [r["row_id"] for r in resample.ranks(f.rows, 7, "split", 4).filter(f"b = {b} and rank < 20").collect()]
        tr = np.isin(np.arange(40), inside)
        coef, *_ = pls1(x[tr], y[tr], 2, None if w is None else w[tr])
        _, mean, sd = standardise(x[tr], None if w is None else w[tr])
        root = np.ones(20) if w is None else np.sqrt(w[~tr] / w[~tr].mean())
        t = ((x[~tr] - mean) / sd * root[:, None]) @ coef
        assert got[b] == pytest.approx(np.corrcoef(t, y[~tr] * root)[0, 1], abs=1e-8)


def test_draws_do_not_depend_on_partitions(spark):
    x, y, _ = data(30, 3)
    a, b = (resample.ranks(frame(spark, x, y, parts=p).rows, 5, "t", 3).toPandas().sort_values(["b", "row_id"])["rank"].tolist() for p in (1, 7))
    assert a == b and sorted(a[:30]) == list(range(30))


@pytest.mark.parametrize("method,args", [("raw_perm", {"n_perm": 40}), ("split_nb", {"n_splits": 10, "force": True}), ("split_exact", {"n_perm": 40, "n_splits": 5}), ("score", {}), ("e", {})])
def test_methods_tell_signal_from_noise(spark, method, args):
    x, y, w = data(80, 6, snr=3)
    rng = np.random.default_rng(3)
    hit = ls.pls1_confirmatory_test(frame(spark, x, y), 1, method=method, args=args, seed=1)
    miss = ls.pls1_confirmatory_test(frame(spark, x, rng.normal(size=80), w), 1, method=method, args=args, seed=1)
    assert hit.pvalue < 0.05 < miss.pvalue and hit.method == method
    again = ls.pls1_confirmatory_test(frame(spark, x, y, parts=5), 1, method=method, args=args, seed=1)
    assert again.pvalue == pytest.approx(hit.pvalue, abs=1e-9)


def test_gate_reroutes(spark):
    x, y, _ = data(20, 3)
    assert ls.split_nb_gate(frame(spark, x, y)).fires
    with pytest.warns(UserWarning):
        r = ls.pls1_confirmatory_test(frame(spark, x, y), 1, method="split_nb", args={"n_splits": 3}, seed=2)
    assert r.method == "split_exact" and r.n_perm == 1000 and r.n_splits == 3


def test_selection(spark):
    x, y, w = data(80, 6, snr=3)
    f = frame(spark, x, y)
    r = ls.pls1_find_k_optimal(f, 4, seed=3)
    assert 1 <= r.k_star <= 4 and r.cv_scores[r.k_star] >= max(r.cv_scores.values()) - r.cv_scores_se[max(r.cv_scores, key=r.cv_scores.get)]
    top = ls.pls1_find_k_optimal(f, 4, selector="r2_max", seed=3)
    assert top.cv_scores[top.k_star] == max(top.cv_scores.values())
    bic = ls.pls1_find_k_optimal(frame(spark, x, y, w), 4, selector="bic")
    assert bic.bic_scores[bic.k_star] == min(bic.bic_scores.values())
    keep = ls.spls1_find_keep_optimal(f, 1, seed=3)
    assert keep.keep_grid == [1, 2, 4, 6] and keep.keep_star in keep.keep_grid
    seq = ls.pls1_find_k_sequence(f, 3, test_method="split_nb", args={"n_splits": 10, "force": True}, seed=3)
    assert seq.k_star >= 1 and seq.pvalues[0] < 0.05
    m = ls.pls1_fit(f, "optimal", k_max=3, seed=3)
    assert m.selection_result.k_star == m.k_used


def test_fold_scores_equal_rows(spark):
    x, y, _ = data(30, 4)
    f = frame(spark, x, y)
    r = ls.pls1_find_k_optimal(f, 2, args={"n_folds": 3}, seed=9)
    rank = {v["row_id"]: v["rank"] for v in resample.ranks(f.rows, 9, "fold", 1).collect()}
    fold, scores = np.array([rank[i] // 10 for i in range(30)]), []
    for j in range(3):
        tr = fold != j
        _, beta, b0, *_ = pls1(x[tr], y[tr], 2)
        res, tot = ((y[~tr] - x[~tr] @ beta - b0) ** 2).sum(), ((y[~tr] - y[~tr].mean()) ** 2).sum()
        scores.append(1 - res / tot)
    assert r.cv_scores[2] == pytest.approx(np.mean(scores), abs=1e-9)


def test_interval_perm_null_and_stability(spark):
    x, y, w = data(80, 6, snr=3)
    f = frame(spark, x, y, w)
    ci = ls.pls1_confirmatory_test(f, 1, method="score", ci=True, n_boot=100, seed=4).ci
    t = ci.per_feature.toPandas().sort_values("feature")
    assert ci.holdout_corr.lower < ci.holdout_corr.point < ci.holdout_corr.upper and (t.beta_ci_lower < t.beta_ci_upper).all() and t.beta_sign_z_signed.iloc[0] > 5
    null = ls.pls1_perm_null(f, 2, n_perm=100, seed=4, return_perm_matrix=True)
    p = null.per_feature.toPandas().sort_values("feature")
    np.testing.assert_allclose(p.beta_ref, ls.pls1_fit(f, 2).coef, atol=1e-9)
    beta = np.array(null.perms.toPandas().beta.to_list())
    np.testing.assert_allclose(p.beta_perm_sd, beta.std(0, ddof=1), atol=1e-12)
    assert len(beta) == 100 and p.beta_perm_z.iloc[0] > 3
    s = ls.pls1_rotation_stability(f, 2, n_boot=100, seed=4)
    assert s.n_boot_finite == 100 and s.variance_ratio.lower <= s.variance_ratio.point <= s.variance_ratio.upper


def test_error_codes(spark):
    x, y, w = data(20, 3)
    cases = [(lambda: ls.pls1_fit(frame(spark, x, y), 4), "k_exceeds_max"), (lambda: ls.pls1_fit(frame(spark, x, np.where(np.arange(20) == 3, np.nan, y)), 1), "non_finite_input"), (lambda: ls.pls1_fit(frame(spark, x, y, -w), 1), "invalid_weights"), (lambda: ls.pls1_fit(frame(spark, x, y, np.eye(20)[0]), 1), "invalid_weights"), (lambda: ls.pls1_confirmatory_test(frame(spark, x, y), 1, method="score", args={"n_perm": 3}), "invalid_args"), (lambda: ls.pls1_confirmatory_test(frame(spark, x, y), 1, method="none"), "invalid_argument"), (lambda: ls.rotate(x, method="quartimax"), "rotation_method_not_implemented"), (lambda: ls.spls1_fit(frame(spark, x, y), 1, 9), "invalid_argument"), (lambda: ls.feature_frame(spark.range(3), ["a"], None, "id"), "dimension_mismatch")]
    doubled = ls.feature_frame(spark.createDataFrame([(1, 2.0, 3.0)] * 9, "id long, a double, b double"), ["a"], "b", "id")
    cases.append((lambda: ls.pls1_find_k_optimal(doubled, 1), "invalid_argument"))
    for call, code in cases:
        try:
            call()
            raised = None
        except errors.LatentError as e:
            raised = e.code
        assert raised == code


def test_streamed_moments_equal_batch(spark, tmp_path):
    x, y, _ = data(50, 3)
    f = frame(spark, x + 1e9, y, parts=4)
    folder = str(tmp_path / "rows")
    f.rows.write.parquet(folder)

    def streamed():
        stream = spark.readStream.schema(f.rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)
        return stream_totals(f.with_rows(stream), str(tmp_path / "blocks"), str(tmp_path / "check"))

    centre, got = streamed()
    # Around a centre among the rows large means cost no digits.
    near = np.column_stack([x + 1e9, y]) - centre
    np.testing.assert_allclose(got.xx1, near[:, :3].T @ near[:, :3], rtol=1e-12)
    assert got.rows == 50 and np.abs(centre[:3] - 1e9 - x.mean(0)).max() < 2
    f.rows.limit(20).write.mode("append").parquet(folder)
    again, more = streamed()
    assert (again == centre).all() and more.rows == 70
    # Nothing new: the sum is read, batches are not.
    spark.createDataFrame([(0, [0.0])], "label int, block array<double>").write.mode("overwrite").parquet(str(tmp_path / "blocks" / "batches" / "batch=0"))
    np.testing.assert_array_equal(streamed()[1].xx1, more.xx1)


def test_responses_alone_are_standardised(spark):
    y = np.array([1.0, 2.0, 4.0, 9.0])
    df = spark.createDataFrame([(i, float(v), 1.0 + i) for i, v in enumerate(y)], "row_id long, y double, w double")
    p = preprocess(feature_frame(df, [], "y", weights="w"))
    w = np.arange(1.0, 5.0)
    mean = (w @ y) / w.sum()
    scale = np.sqrt(w @ (y - mean) ** 2 / w.sum())
    assert len(p.x_mean) == 0 and p.y_mean[0] == pytest.approx(mean) and p.y_scale[0] == pytest.approx(scale)
    got = {r["row_id"]: r["y"][0] for r in p.rows.collect()}
    assert [got[i] for i in range(4)] == pytest.approx(((y - mean) / scale).tolist())


def test_records_come_back():
    ci = results.CIScalar(0.5, 0.1, 0.9, 0.2)
    stability = results.RotationStabilityResult("varimax", 100, 20, 0.7, 0.95, 3, ci, [ci, results.CIScalar(1.0, 0.0, 2.0, 0.5)], 1.0, 2.0, [1.0, 0.5], [2.0, 1.5], False, 99, 40.0)
    assert results.RotationStabilityResult.from_dict(stability.to_dict() | {"unknown": 1}) == stability
    rotated = results.RotateResult(np.eye(2), results.RotationSpec("varimax", {"max_sweeps": 5}, np.array([[0.6, -0.8], [0.8, 0.6]]), 4, 1e-9, False))
    back = results.RotateResult.from_dict(rotated.to_dict())
    assert isinstance(back.spec, results.RotationSpec) and back.spec.args == {"max_sweeps": 5} and back.spec.sweeps == 4
    np.testing.assert_array_equal(back.spec.r, rotated.spec.r)
    np.testing.assert_array_equal(back.w_rot, rotated.w_rot)
    gate = results.SplitNbGateResult(True, 2.5, 30.0)
    assert results.SplitNbGateResult.from_dict(gate.to_dict()) == gate

"""Whether varimax axes are steadier over subsamples than the unrotated ones."""

import math

import numpy as np
from pyspark.sql import functions as F

from latentspark.errors import InvalidArgument, RotationMethodNotImplemented
from latentspark.functions import kernels
from latentspark.operators import moments, resample
from latentspark.operators.fit import centre_of, check_k, fit_moments, varimax_args
from latentspark.operators.inference import check_resamples, subsample_size
from latentspark.results import CIScalar, RotationStabilityResult
from latentspark.sources.frame import Frame

PAIRED = 1000


def pls1_rotation_stability(frame: Frame, k: int, *, method: str = "varimax", rotation_args: dict | None = None, l: np.ndarray | None = None, n_boot: int = 1000, m_rate: float = 0.7, level: float = 0.95, max_skip_rate: float = 0.01, pre_standardized: bool = False, seed: int | None = None) -> RotationStabilityResult:  # noqa: E741
    """Mean squared deviation of the weights from the whole fit's, rotated over unrotated, with paired bootstrap bounds."""
    if method != "varimax":
        raise RotationMethodNotImplemented(f"no rotation {method!r}")
    if not 2 <= k <= 7:
        raise InvalidArgument("k must be from 2 to 7")
    a = varimax_args(rotation_args)
    info = moments.validate(frame, unique=True)
    check_k(info, frame, k)
    seed, n = resample.resolve_seed(seed), info["n"]
    m = subsample_size(n, k, n_boot, m_rate, level, max_skip_rate)
    centre = centre_of(info, pre_standardized)
    ref, _ = fit_moments(moments.total(frame, centre), centre, k, None, pre_standardized)
    if ref.k_used < k:
        raise InvalidArgument(f"the data hold {ref.k_used} of {k} components")
    turn = lambda w: w @ kernels.varimax(w if l is None else np.asarray(l, float), a["kaiser_normalize"], a["max_iter"], a["tol"])[0]
    plain, rotated = ref.w, turn(ref.w)
    weighted = frame.weighted

    def work(b: int, sample: moments.Moments) -> list[tuple]:
        missing = [math.nan] * k
        if sample.n_eff < k + 1 or sample.n[1] <= 0:
            return [(b, missing, missing)]
        # Means and scales are unweighted here even with weights, unlike in the interval's subsamples; the fit is weighted.
        s = moments.standard(sample if pre_standardized or not weighted else sample.unweighted(), pre_standardized)
        if weighted and not pre_standardized:
            f, sw = sample.n[0] / sample.n[1], sample.n[1]
            gram = f * (sample.xxw - np.outer(s.x_mean, sample.xw) - np.outer(sample.xw, s.x_mean) + sw * np.outer(s.x_mean, s.x_mean)) / np.outer(s.x_scale, s.x_scale)
            cross = f * (sample.xyw[:, 0] - s.x_mean * sample.yw[0] - s.y_mean[0] * sample.xw + sw * s.y_mean[0] * s.x_mean) / s.x_scale / s.y_scale[0]
        else:
            gram, cross = s.gram, s.cross[:, 0]
        fit = kernels.pls1(gram, cross, k)
        if fit.k_used < k:
            return [(b, missing, missing)]
        squares = lambda w, to: ((kernels.signed_permutation(w, to) - to) ** 2).sum(0).tolist()
        near = fit.w @ kernels.procrustes(fit.w, plain)
        return [(b, squares(fit.w, plain), squares(turn(near), rotated))]

    # One set a draw: the subsample.
    blocks = moments.set_blocks(frame, resample.subsets(frame.rows, seed, "stability", n_boot, m), centre, n_boot)
    rows = moments.per_set(blocks, frame, work, "b int, unrot array<double>, rot array<double>").orderBy("b").collect()  # 2k numbers a draw
    u, v = (np.array([r[c] for r in rows], float).reshape(len(rows), k) for c in ("unrot", "rot"))
    fine = np.isfinite(u).all(1) & np.isfinite(v).all(1)
    check_resamples(int((~fine).sum()), 0, n_boot, 1.0, max_skip_rate)
    return reduce_ratio(u[fine], v[fine], n_boot, m, m_rate, level, seed, info["n_eff"])


def reduce_ratio(u: np.ndarray, v: np.ndarray, n_boot: int, m: int, m_rate: float, level: float, seed: int, n_eff: float) -> RotationStabilityResult:
    draws = np.random.default_rng(seed).integers(0, len(u), (PAIRED, len(u)))
    ub, vb = u[draws].mean(1), v[draws].mean(1)
    mean_u, mean_v = u.mean(0), v.mean(0)

    def ci(point_u: float, point_v: float, bu: np.ndarray, bv: np.ndarray) -> CIScalar:
        point = point_v / point_u if point_u else math.nan
        stars = bv[bu > 0] / bu[bu > 0] if mean_u.sum() else np.empty(0)
        if not len(stars):
            return CIScalar(point, math.nan, math.nan, math.nan)
        tail = (1 - level) / 2
        return CIScalar(point, kernels.quantile(stars, tail), kernels.quantile(stars, 1 - tail), float(stars.std(ddof=1)) if len(stars) > 1 else 0.0)

    total = ci(mean_u.sum(), mean_v.sum(), ub.sum(1), vb.sum(1))
    axes = [ci(mean_u[j], mean_v[j], ub[:, j], vb[:, j]) for j in range(u.shape[1])]
    degenerate = bool(not mean_u.sum() or (ub.sum(1) <= 0).mean() > 0.01)
    return RotationStabilityResult("varimax", n_boot, m, m_rate, level, seed, total, axes, float(mean_u.sum()), float(mean_v.sum()), mean_u.tolist(), mean_v.tolist(), degenerate, len(u), n_eff)

"""Confirmatory tests, subsampling intervals and the permutation null.

Resamples are row sets; their moment blocks come from one pass over the rows, and the small fits run in the tasks that
hold the blocks.
"""

import math
import warnings
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latentspark.errors import InvalidArgs, InvalidArgument, PermNullDegenerate, ResampleFailureRateExceeded, ResamplingDegenerate
from latentspark.functions import kernels, special
from latentspark.operators import fit as fits
from latentspark.operators import moments, resample, wide
from latentspark.operators.fit import centre_of, check_k
from latentspark.operators.moments import Moments
from latentspark.results import CIScalar, ConfirmatoryCI, ConfirmatoryTestResult, PermNullResult, SplitNbGateResult
from latentspark.sources.frame import Frame, Y

#: Arguments of each method, with their defaults.
METHODS = {"raw_perm": {"n_perm": 1000, "n_folds": 5}, "split_nb": {"n_splits": 50, "force": False}, "split_exact": {"n_perm": 1000, "n_splits": 50}, "score": {}, "e": {}}
_LEAST = {"n_perm": 1, "n_splits": 2, "n_folds": 2}


def method_args(method: str, args: dict | None) -> dict:
    if method not in METHODS:
        raise InvalidArgument(f"no method {method!r}")
    if unknown := set(args or {}) - set(METHODS[method]):
        raise InvalidArgs(f"{method} takes no {sorted(unknown)}")
    out = METHODS[method] | (args or {})
    for name, least in _LEAST.items():
        if out.get(name, least) < least:
            raise InvalidArgument(f"{name} must be {least} at least")
    return out


# ---- pairs of row sets


def pair_blocks(frame: Frame, sets: Column, centre: np.ndarray, pairs: int) -> DataFrame:
    """Blocks of sets 0 to 2 pairs - 1, with 2b and 2b + 1 in one partition."""
    return moments.set_blocks(frame, sets, centre, 2 * pairs, (F.expr("label div 2"),))


def per_pair(blocks: DataFrame, frame: Frame, work, schema: str) -> DataFrame:
    """Runs work(b, sets 2b, sets 2b + 1) where both blocks meet: blocks as `pair_blocks` gives them."""
    d, q, weighted = frame.d, frame.q, frame.weighted
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches):
        held = {}
        for batch in batches:
            rows = []
            for label, block in zip(batch.label, batch.block, strict=True):
                b, side = divmod(int(label), 2)
                held.setdefault(b, {})[side] = Moments.unflat(block, d, q, weighted)
                if len(held[b]) == 2:
                    both = held.pop(b)
                    rows += work(b, both[0], both[1])
            yield pd.DataFrame(rows, columns=names)

    return blocks.mapInPandas(run, schema)


def correlation(g: np.ndarray, mean: np.ndarray, b: Moments, y: int, flat: float, none: float) -> float:
    """Pearson's r of the score (x - mean)g and y, both times root weights, over the rows of b; y must be around 0."""
    n, sw, _, _ = b.n
    if n < 2 or sw <= 0:
        return none
    f = n / sw  # weights of mean 1
    t1, y1 = math.sqrt(f) * (g @ (b.xr - mean * b.n[2])), math.sqrt(f) * b.yr[y]
    second = b.xxw - np.outer(b.xw, mean) - np.outer(mean, b.xw) + sw * np.outer(mean, mean)
    tt = f * (g @ second @ g) - t1 * t1 / n
    ty = f * (g @ (b.xyw[:, y] - mean * b.yw[y])) - t1 * y1 / n
    yy = f * b.yyw[y] - y1 * y1 / n
    if not (tt > flat and yy > flat):
        return none
    return float(np.clip(ty / math.sqrt(tt * yy), -1, 1))


def raw_y(m: Moments, centre: np.ndarray, d: int) -> Moments:
    """m with y around 0 instead of the centre."""
    return m.shifted(np.concatenate([np.zeros(d), -centre[d:]]))


def split_correlations(frame: Frame, info: dict, k: int, n_splits: int, seed: int, keep: int | None) -> DataFrame:
    """b, response, r: correlation in the held-out half, for each split and response column.

    From moments; over rows for many features, and for the splits whose fits lose digits by moments."""
    n, d, q = info["n"], frame.d, frame.q
    if n < k + 5:
        raise InvalidArgument(f"{n} rows are too few for k={k} in split halves")
    sets = resample.halves(frame.rows, seed, "split", n_splits, kernels.split_size(n, k))
    if d > fits.MANY:
        return split_rows(frame, info, sets, list(range(n_splits)), k, keep)
    centre = np.concatenate([info["centre"][:d], np.repeat(info["centre"][d], q)])

    def work(b: int, train: Moments, test: Moments) -> list[tuple]:
        s, test = moments.standard(train), raw_y(test, centre, d)
        out = []
        for j in range(q):
            f = kernels.pls1(s.gram, s.cross[:, j], k, keep)
            out.append((b, j, correlation(f.coef / s.x_scale, s.x_mean, test, j, 1e-15, 0.0) if f.k_used else 0.0, fits.near(f, k)))
        return out

    r = per_pair(pair_blocks(frame, sets, centre, n_splits), frame, work, "b int, response int, r double, near boolean").persist()
    again = sorted(x["b"] for x in r.filter("near").select("b").distinct().collect())  # splits
    r_moments = r.drop("near")
    return r_moments.filter(~F.col("b").isin(again)).unionAll(split_rows(frame, info, sets, again, k, keep)) if again else r_moments


def split_rows(frame: Frame, info: dict, sets: Column, splits: list[int], k: int, keep: int | None) -> DataFrame:
    """`split_correlations` over rows, for some splits: by tiles of rows with rows where that takes fewer products."""
    n_train = kernels.split_size(info["n"], k)
    found: list[pd.DataFrame] = []
    if k == 1 and (keep is None or keep == frame.d) and frame.d > fits.MANY and wide.kernel_is_cheaper(n_train, info["n"] - n_train, frame.d, frame.q):
        for b, r in wide.split_tiles(frame, sets, len(splits)).items():
            found.append(pd.DataFrame({"b": b, "response": range(frame.q), "r": r}))
    else:
        for some in wide.fit_sets(frame, sets, [2 * b for b in splits], k, keep):
            scorers = {}
            for s, f in some.items():
                columns = np.arange(len(f.responses))
                scorers[s + 1] = wide.scorer(f, np.column_stack([f.coef(j) for j in columns]), columns, standardised=False)
            for s, v in wide.score_sets(frame, sets, scorers).items():
                f = some[s - 1]
                r = np.where(f.k_used > 0, v.correlations(1e-15, 0.0), 0.0)
                found.append(pd.DataFrame({"b": (s - 1) // 2, "response": np.array(f.responses), "r": r}))
    every = pd.concat(found) if found else pd.DataFrame({"b": [], "response": [], "r": []})  # splits x responses numbers
    return frame.rows.sparkSession.createDataFrame(every, "b int, response int, r double")


def fisher_z(r):
    return F.atanh(F.greatest(F.least(r, F.lit(0.9999)), F.lit(-0.9999)))


def exceedance(null: DataFrame, statistic: str, observed: float) -> tuple[float, int]:
    """(#{statistics that are NaN or reach the observed one} + 1) / (B + 1), and how many are NaN."""
    s = F.col(statistic)
    r = null.agg(F.count("*").alias("n"), F.count_if(F.isnan(s) | (s >= observed)).alias("over"), F.count_if(F.isnan(s)).alias("nan")).first()
    return (r["over"] + 1) / (r["n"] + 1), r["nan"]


# ---- the gate and the methods


def gate_of(m: Moments, n_eff: float) -> SplitNbGateResult:
    """The asymptotic split test is unsafe for few features or rows, or where one direction dominates."""
    rank = kernels.stable_rank(moments.standard(m).gram)
    return SplitNbGateResult(bool(len(m.x1) <= 4 or n_eff < 25 or rank < 3), rank, n_eff)


def gate(frame: Frame, info: dict) -> SplitNbGateResult:
    """The gate of a frame; with many features the largest eigenvalue is found over rows."""
    if frame.d <= fits.MANY:
        return gate_of(moments.total(frame, info["centre"]), info["n_eff"])
    rank = wide.stable_rank(frame, wide.standards(frame, None, [0], range(0))[0])
    return SplitNbGateResult(bool(frame.d <= 4 or info["n_eff"] < 25 or rank < 3), rank, info["n_eff"])


def split_nb_gate(frame: Frame) -> SplitNbGateResult:
    return gate(frame, moments.validate(frame))


def _raw_perm(frame: Frame, info: dict, k: int, a: dict, seed: int, keep: int | None) -> tuple:
    perms = resample.permuted(frame, seed, "perm", a["n_perm"])
    return raw_perm_p(*fold_sums(perms, info, k, a["n_folds"], seed, keep), a["n_perm"])


def fold_sums(frame: Frame, info: dict, k: int, n_folds: int, seed: int, keep: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Residual and total sums of squares of each response over all held-out folds.

    From moments; over rows for many features, and for the folds whose fits lose digits by moments."""
    d, q, n_folds = frame.d, frame.q, min(n_folds, info["n"])
    sets = resample.folds(frame.rows, seed, info["n"], n_folds)
    if d > fits.MANY:
        return fold_rows(frame, sets, list(range(n_folds)), k, keep)
    centre = np.concatenate([info["centre"][:d], np.repeat(info["centre"][d], q)])

    def work(b: int, train: Moments, val: Moments) -> list[tuple]:
        s, v = moments.standard(train), val.unweighted()
        out = []
        for j in range(q):
            f = kernels.pls1(s.gram, s.cross[:, j], k, keep)
            out.append((b, j, *residuals(v, s, f.coef, j), fits.near(f, k)))
        return out

    sums = per_pair(pair_blocks(frame, sets, centre, n_folds), frame, work, "b int, response int, ss_res double, ss_tot double, near boolean").persist()
    again = sorted(x["b"] for x in sums.filter("near").select("b").distinct().collect())  # folds
    fine = sums.filter(~F.col("b").isin(again)).groupBy("response").agg(F.sum("ss_res").alias("res"), F.sum("ss_tot").alias("tot")).collect()  # a row a response
    sums.unpersist()
    res, tot = fold_rows(frame, sets, again, k, keep) if again else (np.zeros(q), np.zeros(q))
    for r in fine:
        res[r["response"]] += r["res"]
        tot[r["response"]] += r["tot"]
    return res, tot


def fold_rows(frame: Frame, sets: Column, folds: list[int], k: int, keep: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Residual and total sums of squares of each response over the held-out rows of some folds, fitted and summed over rows."""
    res, tot = np.zeros(frame.q), np.zeros(frame.q)
    for some in wide.fit_sets(frame, sets, [2 * b for b in folds], k, keep):
        scorers = {s + 1: wide.scorer(f, np.column_stack([f.coef(j) for j in range(len(f.responses))]), np.arange(len(f.responses)), True, plain=True) for s, f in some.items()}
        for s, v in wide.score_sets(frame, sets, scorers).items():
            columns = some[s - 1].responses
            more = v.residuals()
            res[columns.start : columns.stop] += more[0]
            tot[columns.start : columns.stop] += more[1]
    return res, tot


def held_out_r2(res: np.ndarray, tot: np.ndarray) -> np.ndarray:
    return np.where(tot > 0, 1 - res / np.where(tot > 0, tot, 1), 0.0)


def raw_perm_p(res: np.ndarray, tot: np.ndarray, n_perm: int) -> tuple:
    r2 = held_out_r2(res, tot)
    nan = int(np.isnan(r2[1:]).sum())
    if 2 * nan > n_perm:
        raise PermNullDegenerate(f"{nan} of {n_perm} permutations failed")
    return (int((np.isnan(r2[1:]) | (r2[1:] >= r2[0])).sum()) + 1) / (n_perm + 1), float(r2[0]), None


def residuals(v: Moments, s: moments.Standard, coef: np.ndarray, j: int) -> tuple[float, float]:
    """Weighted residual and total sums of squares of standardised y in the rows of v (weights of mean 1)."""
    n, sw = v.n[0], v.n[1] if v.n[1] > 0 else 1.0
    f, g = n / sw, coef / s.x_scale
    scale, my = s.y_scale[j], s.y_mean[j]
    second = v.xxw - np.outer(v.xw, s.x_mean) - np.outer(s.x_mean, v.xw) + sw * np.outer(s.x_mean, s.x_mean)
    yy = (v.yyw[j] - 2 * my * v.yw[j] + sw * my * my) / scale**2
    y1 = (v.yw[j] - sw * my) / scale
    ty = g @ (v.xyw[:, j] - s.x_mean * v.yw[j] - my * v.xw + sw * my * s.x_mean) / scale
    return float(f * (yy - 2 * ty + g @ second @ g)), float(f * (yy - y1 * y1 / sw))


def _split_nb(frame: Frame, info: dict, k: int, a: dict, seed: int, keep: int | None) -> tuple:
    r = split_correlations(frame, info, k, a["n_splits"], seed, keep).select(fisher_z(F.col("r")).alias("z"))
    row = r.agg(F.avg("z").alias("mean"), F.var_samp("z").alias("var"), F.count("*").alias("n")).first()
    return split_nb_p(row["mean"], row["var"], row["n"], info["n"], k, frame.weighted)


def split_nb_p(mean: float, var: float | None, splits: int, n: int, k: int, weighted: bool) -> tuple:
    """p, correlation and its reliability, from mean and variance of the splits' Fisher z."""
    n_train = kernels.split_size(n, k)
    n_test = n - n_train
    se = max(math.sqrt(var or 0.0) * math.sqrt(1 / splits + n_test / n_train), 1e-15)
    rho = None if weighted or n_test < 4 else float(np.clip(1 - var * (n_test - 3), 0, 1))
    return special.t_sf(mean / se, splits - 1), math.tanh(mean), rho


def _split_exact(frame: Frame, info: dict, k: int, a: dict, seed: int, keep: int | None) -> tuple:
    perms = resample.permuted(frame, seed, "perm", a["n_perm"])
    r = split_correlations(perms, info, k, a["n_splits"], seed, keep)
    z = r.groupBy("response").agg(F.avg(fisher_z(F.col("r"))).alias("z")).persist()
    observed = z.filter("response = 0").first()["z"]
    p, _ = exceedance(z.filter("response > 0"), "z", observed)
    z.unpersist()
    return p, math.tanh(observed), None


def score_test(m: Moments, pre_standardized: bool = False) -> tuple[float, float]:
    """p and T = ||X'y||^2, with T / scale as chi-square of df matched in mean and variance; no fit."""
    s = moments.standard(m, pre_standardized)
    return matched(float(s.cross[:, 0] @ s.cross[:, 0]), float(np.trace(s.gram)), float((s.gram**2).sum()))


def score_rows(frame: Frame, pre_standardized: bool = False) -> tuple[float, float]:
    """`score_test` without a matrix of features x features."""
    f = wide.standards(frame, None, [0], range(1), pre_standardized)[0]
    c, trace = wide.covariance(frame, f)
    return matched(float(c[:, 0] @ c[:, 0]), trace, wide.square_norm(frame, f))


def matched(t: float, s1: float, s2: float) -> tuple[float, float]:
    """p of T and T, from the sum of the eigenvalues and of their squares."""
    if abs(s1) < 1e-15 or s2 < 1e-30:
        return 1.0, t
    return special.chi2_sf(t * s1 / s2, s1 * s1 / s2), t


def _e(frame: Frame, info: dict, k: int, seed: int, keep: int | None) -> tuple:
    log_e = float(log_e_values(frame, info, k, seed, keep)[0])
    return e_p(log_e), log_e, None


def e_p(log_e: float) -> float:
    return min(1.0, math.exp(-max(log_e, 0.0)))


def log_e_values(frame: Frame, info: dict, k: int, seed: int, keep: int | None) -> np.ndarray:
    """log of the e value of each response, in one split for all."""
    n, d, q = info["n"], frame.d, frame.q
    if n < k + 5:
        raise InvalidArgument(f"{n} rows are too few for k={k} in split halves")
    sets = resample.halves(frame.rows, seed, "split", 1, kernels.split_size(n, k))
    # Of each response: variance of the fit in its own half, then sums over the other half.
    alt, res, square, first = (np.zeros(q) for _ in range(4))
    by_moments = d <= fits.MANY
    if by_moments:
        both = moments.collected(pair_blocks(frame, sets, np.concatenate([info["centre"][:d], np.repeat(info["centre"][d], q)]), 1), frame)
        train, test = both[0], both[1]
        s = moments.standard(train)
        found = [kernels.pls1(s.gram, s.cross[:, j], k, keep) for j in range(q)]
        by_moments = not any(fits.near(f, k) for f in found)
    # The null model is the mean of root-weighted y in the test half.
    if by_moments:
        n_te, sw = test.n[0], test.n[1] if test.n[1] > 0 else 1.0
        for j, f in enumerate(found):
            alt[j] = residuals(train, s, f.coef, j)[0] / train.n[0]
            res[j], _ = residuals(test, s, f.coef, j)
        square = (n_te / sw) * (test.yyw - 2 * s.y_mean * test.yw + sw * s.y_mean**2) / s.y_scale**2
        first = math.sqrt(n_te / sw) * (test.yr - s.y_mean * test.n[2]) / s.y_scale
    else:
        for some in wide.fit_sets(frame, sets, [0], k, keep):
            f = some[0]
            columns = np.arange(len(f.responses))
            one = wide.scorer(f, np.column_stack([f.coef(j) for j in columns]), columns, True)
            seen = wide.score_sets(frame, sets, {0: one, 1: one})
            own = slice(f.responses.start, f.responses.stop)
            n_te, unit = seen[1].n, seen[1].n / seen[1].sw if seen[1].sw > 0 else 0.0
            alt[own], res[own] = seen[0].residuals()[0] / seen[0].n, seen[1].residuals()[0]
            square[own], first[own] = unit * seen[1].wyy, math.sqrt(unit) * seen[1].ry
    null_ss = square - first * first / n_te
    ll = lambda var, ss: -0.5 * n_te * np.log(2 * math.pi * np.maximum(var, 1e-30)) - 0.5 * ss / np.maximum(var, 1e-30)
    return ll(alt, res) - ll(null_ss / n_te, null_ss)


def pls1_confirmatory_test(frame: Frame, k: int = 1, *, method: str, args: dict | None = None, ci: bool = False, n_boot: int = 1000, m_rate: float = 0.7, level: float = 0.95, max_failure_rate: float = 0.01, max_skip_rate: float = 0.01, pre_standardized: bool = False, seed: int | None = None, keep: int | None = None, _gate: SplitNbGateResult | None = None) -> ConfirmatoryTestResult:
    """Whether y depends on X at all. method: raw_perm, split_nb, split_exact, score or e; args: that method's.

    split_nb runs as split_exact where the gate says so, unless forced; the result names what ran."""
    a = method_args(method, args)
    if ci and keep is not None:
        raise InvalidArgument("intervals are for dense fits")
    info = moments.validate(frame, unique=method != "score" or ci)
    check_k(info, frame, k, keep)
    seed = resample.resolve_seed(seed)
    rank = None
    if method == "split_nb":
        found = _gate or gate(frame, info)
        rank = found.stable_rank
        if found.fires and not a["force"]:
            warnings.warn(f"split_nb is unsafe here (stable rank {rank:.2f}, {frame.d} features, {info['n_eff']:.3g} rows): split_exact runs", stacklevel=2)
            method, a = "split_exact", {"n_perm": 1000, "n_splits": a["n_splits"]}
    if method == "score":
        if frame.d > fits.MANY:
            p, statistic = score_rows(frame, pre_standardized)
        else:
            p, statistic = score_test(moments.total(frame, centre_of(info, pre_standardized)), pre_standardized)
        rho = None
    elif method == "e":
        p, statistic, rho = _e(frame, info, k, seed, keep)
    else:
        run = {"raw_perm": _raw_perm, "split_nb": _split_nb, "split_exact": _split_exact}[method]
        p, statistic, rho = run(frame, info, k, a, seed, keep)
    bundle = confirmatory_ci(frame, k, n_boot, m_rate, level, max_failure_rate, max_skip_rate, pre_standardized, seed, info) if ci else None
    return ConfirmatoryTestResult(p, statistic, method, k, a.get("n_perm"), a.get("n_splits"), seed, rho, rank, info["n_eff"], bundle)


# ---- subsampling


def subsample_size(n: int, k: int, n_boot: int, m_rate: float, level: float, *rates: float) -> int:
    if not 0.5 < m_rate < 0.95 or not 0.5 <= level <= 0.99 or n_boot < 100 or any(not 0 <= r <= 1 for r in rates):
        raise InvalidArgument("m_rate must lie in (0.5, 0.95), level in [0.5, 0.99], rates in [0, 1], n_boot be 100 at least")
    m = math.ceil(n**m_rate)
    if m < k + 2 or m >= n:
        raise InvalidArgument(f"subsamples of {m} rows don't suit {n} rows and k={k}")
    return m


FITS = "b int, status string, r double, beta array<double>, leverage array<double>"


def subsample_fits(frame: Frame, info: dict, k: int, m: int, n_boot: int, pre_standardized: bool, seed: int) -> DataFrame:
    """b, status (ok, skipped: too few effective rows, failed: fewer components), r (held-out correlation), beta, leverage.

    From moments; over rows for many features, and for the subsamples whose fits lose digits by moments."""
    sets = resample.halves(frame.rows, seed, "subsample", n_boot, m)
    if frame.d > fits.MANY:
        return subsample_rows(frame, sets, list(range(n_boot)), k, pre_standardized)
    centre = centre_of(info, pre_standardized)

    def work(b: int, sample: Moments, rest: Moments) -> list[tuple]:
        if sample.n_eff < k + 1 or sample.n[1] <= 0:
            return [(b, "skipped", math.nan, [], [])]
        s = moments.standard(sample, pre_standardized)
        f = kernels.pls1(s.gram, s.cross[:, 0], k)
        if fits.near(f, k):
            return [(b, "near", math.nan, [], [])]
        r = correlation(f.coef / s.x_scale, s.x_mean, rest.unweighted(), 0, 1e-30, math.nan)
        return [(b, "ok", r, (f.coef * s.y_scale[0] / s.x_scale).tolist(), kernels.leverage(f.w).tolist())]

    found = per_pair(pair_blocks(frame, sets, centre, n_boot), frame, work, FITS).persist()
    again = sorted(x["b"] for x in found.filter("status = 'near'").select("b").collect())  # subsamples
    return found.filter("status <> 'near'").unionAll(subsample_rows(frame, sets, again, k, pre_standardized)) if again else found


def subsample_rows(frame: Frame, sets: Column, draws: list[int], k: int, pre_standardized: bool) -> DataFrame:
    """`subsample_fits` over rows, for some subsamples: a range of them at a time on the driver, RANGE bytes."""
    spark, parts = frame.rows.sparkSession, []
    for some in wide.fit_sets(frame, sets, [2 * b for b in draws], k, pre_standardized=pre_standardized):
        rows, scorers = [], {}
        for s, f in some.items():
            if f.n_eff < k + 1 or f.sw <= 0:
                rows.append((s // 2, "skipped", math.nan, [], []))
            elif f.k_used[0] < k:
                rows.append((s // 2, "failed", math.nan, [], []))
            else:
                scorers[s + 1] = wide.scorer(f, f.coef(0)[:, None], np.zeros(1, int), True, plain=True)
        for s, v in wide.score_sets(frame, sets, scorers).items() if scorers else ():
            f = some[s - 1]
            rows.append((s // 2, "ok", float(v.correlations(1e-30, math.nan)[0]), (f.coef(0) * f.y_scale[0] / f.scale).tolist(), kernels.leverage(f.weights(0)).tolist()))
        parts.append(spark.createDataFrame(rows, FITS))
    return reduce(DataFrame.unionAll, parts)


def scaled_interval(point: float, low: float, high: float, sd: float | None, shrink: float) -> CIScalar:
    """From quantiles and standard deviation of the resamples' differences to the point."""
    return CIScalar(point, point - shrink * high, point - shrink * low, shrink * (sd or 0.0))


def wald_interval(r: list[float], n: int, m: int, level: float) -> CIScalar:
    """Fisher-z interval of the mean held-out correlation, its variance inflated for overlapping subsamples."""
    seen = [v for v in r if not math.isnan(v)]
    inner = np.array([v for v in seen if abs(v) < 1])
    if not len(inner):
        point = float(np.mean(seen)) if seen else 0.0
        return CIScalar(point, point, point, 0.0)
    z = np.arctanh(inner)
    se = math.sqrt((1 / len(z) + (n - m) / m) * (z.var(ddof=1) if len(z) > 1 else 0.0))
    half, point = special.normal_inv(0.5 + level / 2) * se, float(inner.mean())
    return CIScalar(point, math.tanh(math.atanh(point) - half), math.tanh(math.atanh(point) + half), se)


def feature_intervals(found: DataFrame, beta: np.ndarray, lev: np.ndarray, n: int, m: int, level: float) -> DataFrame:
    """One row a feature, from the resamples' rows: quantiles, deviations and sign counts, aggregated by Spark."""
    spark = found.sparkSession
    points = spark.createDataFrame([(i, float(b), float(v)) for i, (b, v) in enumerate(zip(beta, lev, strict=True))], "feature int, beta_ref double, leverage_ref double")
    long = found.select(F.posexplode(F.arrays_zip("beta", "leverage")).alias("feature", "v")).select("feature", "v.beta", "v.leverage")
    delta = long.join(F.broadcast(points), "feature").withColumns({"db": F.col("beta") - F.col("beta_ref"), "dl": F.col("leverage") - F.col("leverage_ref")})
    tails = [(1 - level) / 2, 1 - (1 - level) / 2]
    quantiles = F.array(*map(F.lit, tails))
    stats = delta.groupBy("feature", "beta_ref", "leverage_ref").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("beta") > 0).alias("pos"),
        F.count_if(F.col("beta") < 0).alias("neg"),
        F.percentile("db", quantiles).alias("qb"),
        F.percentile("dl", quantiles).alias("ql"),
        F.coalesce(F.stddev_samp("db"), F.lit(0.0)).alias("sb"),
        F.coalesce(F.stddev_samp("dl"), F.lit(0.0)).alias("sl"),
    )
    shrink = math.sqrt(m / n)
    agree = F.when(F.col("beta_ref") > 0, F.col("pos")).when(F.col("beta_ref") < 0, F.col("neg")).otherwise(F.greatest("pos", "neg")) / F.col("n")
    z = (2 * agree - 1) * F.sqrt("n")
    signed = F.when(F.col("beta_ref") > 0, F.abs(z)).when(F.col("beta_ref") < 0, -F.abs(z)).otherwise(z)
    bound = lambda p, q, i: F.col(p) - shrink * F.get(F.col(q), F.lit(i))
    return stats.select(
        "feature",
        "beta_ref",
        "leverage_ref",
        z.alias("beta_sign_z"),
        signed.alias("beta_sign_z_signed"),
        bound("leverage_ref", "ql", 1).alias("leverage_ci_lower"),
        bound("leverage_ref", "ql", 0).alias("leverage_ci_upper"),
        (shrink * F.col("sl")).alias("leverage_ci_se"),
        bound("beta_ref", "qb", 1).alias("beta_ci_lower"),
        bound("beta_ref", "qb", 0).alias("beta_ci_upper"),
        (shrink * F.col("sb")).alias("beta_ci_se"),
    )


def check_resamples(skipped: int, failed: int, n_boot: int, max_failure_rate: float, max_skip_rate: float) -> None:
    if skipped / n_boot > max_skip_rate:
        raise ResamplingDegenerate(f"{skipped} of {n_boot} resamples had too few effective rows")
    if (skipped + failed) / n_boot > max_failure_rate:
        raise ResampleFailureRateExceeded(f"{skipped + failed} of {n_boot} resamples failed")


def confirmatory_ci(frame: Frame, k: int, n_boot: int, m_rate: float, level: float, max_failure_rate: float, max_skip_rate: float, pre_standardized: bool, seed: int, info: dict | None = None) -> ConfirmatoryCI:
    """info: what `validate` found with unique=True, where that has been done."""
    info = info or moments.validate(frame, unique=True)
    n, m = info["n"], subsample_size(info["n"], k, n_boot, m_rate, level, max_failure_rate, max_skip_rate)
    model = fits.fitted(frame, info, k, None, pre_standardized)
    found = subsample_fits(frame, info, k, m, n_boot, pre_standardized, seed).persist()
    seen = {r["status"]: r["count"] for r in found.groupBy("status").count().collect()}
    check_resamples(seen.get("skipped", 0), seen.get("failed", 0), n_boot, max_failure_rate, max_skip_rate)
    ok = found.filter("status = 'ok'")
    r = [x["r"] for x in ok.select("r").collect()]  # n_boot numbers
    table = feature_intervals(ok, model.beta, kernels.leverage(model.w), n, m, level)
    table = table.sparkSession.createDataFrame(table.collect(), table.schema)  # one row a feature
    found.unpersist()
    return ConfirmatoryCI(n_boot, m, m_rate, level, wald_interval(r, n, m, level), seen.get("ok", 0), sum(not math.isnan(v) for v in r), table)


# ---- permutation null


def pls1_perm_null(frame: Frame, k: int, *, n_perm: int = 1000, return_perm_matrix: bool = False, pre_standardized: bool = False, seed: int | None = None) -> PermNullResult:
    """Coefficients (standardised scale) under random orders of y; weights keep their rows. No multiplicity correction."""
    if n_perm < 100:
        raise InvalidArgument("n_perm must be 100 at least")
    info = moments.validate(frame, unique=True)
    check_k(info, frame, k)
    seed, d = resample.resolve_seed(seed), frame.d
    perms = resample.permuted(frame, seed, "null", n_perm)
    null_fits = null_rows if d > fits.MANY else null_moments
    every = null_fits(frame, perms, info, k, pre_standardized)
    long = every.select("perm_id", F.posexplode("beta").alias("feature", "b"))
    null, fine = F.col("perm_id") > 0, ~F.isnan("b")
    stats = long.groupBy("feature").agg(F.max(F.when(~null, F.col("b"))).alias("beta_ref"), F.avg(F.when(null & fine, F.col("b"))).alias("mean"), F.stddev_samp(F.when(null & fine, F.col("b"))).alias("sd"))
    sd = F.coalesce("sd", F.lit(0.0))
    z = F.when(sd > 1.4901161193847656e-8, F.try_divide("beta_ref", sd)).otherwise(float("nan"))
    per_feature = stats.select("feature", "beta_ref", F.coalesce("mean", F.lit(0.0)).alias("beta_perm_mean"), sd.alias("beta_perm_sd"), z.alias("beta_perm_z"))
    return PermNullResult(n_perm, k, seed, info["n_eff"], per_feature, every.filter(null) if return_perm_matrix else None)


NULL = "perm_id int, beta array<double>"


def null_moments(frame: Frame, perms: Frame, info: dict, k: int, pre_standardized: bool) -> DataFrame:
    """Coefficients of every response, from one block of moments; over rows where the observed one loses digits by moments."""
    d, centre = frame.d, centre_of(info, pre_standardized)
    m = moments.total(perms, np.concatenate([centre[:d], np.repeat(centre[d], perms.q)]))
    s = moments.standard(m, pre_standardized)
    # y is standardised once, then permuted: every column has the first one's mean and scale.
    f, sw = m.n[0] / m.n[1], m.n[1]
    cross = f * (m.xyw - np.outer(s.x_mean, m.yw) - s.y_mean[0] * m.xw[:, None] + sw * s.y_mean[0] * s.x_mean[:, None]) / s.x_scale[:, None] / s.y_scale[0]
    spark = frame.rows.sparkSession
    shared = spark.sparkContext.broadcast((s.gram, cross))

    def run(batches):
        gram, all_cross = shared.value
        for batch in batches:
            found = [kernels.pls1(gram, all_cross[:, i], k) for i in batch.id]
            beta = [f.coef if f.k_used == k else np.full(len(gram), np.nan) for f in found]
            yield pd.DataFrame({"perm_id": batch.id.astype("int32"), "beta": beta})

    if fits.near(kernels.pls1(s.gram, cross[:, 0], k), k):
        return null_rows(frame, perms, info, k, pre_standardized)
    parts = max(1, min(spark.sparkContext.defaultParallelism, perms.q // 50))
    return spark.range(perms.q).repartition(parts).mapInPandas(run, NULL)


def null_rows(frame: Frame, perms: Frame, info: dict, k: int, pre_standardized: bool) -> DataFrame:
    """Coefficients of every response, fitted over rows, a range of them at a time on the driver."""
    if not pre_standardized:
        s = wide.standards(frame, None, [0], range(1))[0]
        y_mean, y_scale = float(s.y_mean[0]), float(s.y_scale[0])
        perms = perms.with_rows(perms.rows.withColumn(Y, F.transform(Y, lambda v: (v - y_mean) / y_scale)))
    parts = []
    for some in wide.fit_sets(perms, None, [0], k, pre_standardized=pre_standardized, y_as_is=True):
        f = some[0]
        rows = [(f.responses[j], (f.coef(j) if f.k_used[j] == k else np.full(frame.d, np.nan)).tolist()) for j in range(len(f.responses))]
        parts.append(frame.rows.sparkSession.createDataFrame(rows, NULL))
    return reduce(DataFrame.unionAll, parts)

"""How many components, and how many features in each."""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latentspark.errors import InvalidArgs, InvalidArgument, SequenceNoRejection
from latentspark.functions import kernels
from latentspark.operators import fit as fits
from latentspark.operators import moments, resample, wide
from latentspark.operators.fit import check_k, preprocess
from latentspark.operators.inference import METHODS, SplitNbGateResult, correlation, fisher_z, gate, method_args, pair_blocks, per_pair, pls1_confirmatory_test, residuals, split_nb_p
from latentspark.operators.rowwise import matrix
from latentspark.results import FindKeepOptimalResult, FindKOptimalResult, FindKSequenceResult
from latentspark.sources.frame import WEIGHT, Frame, X, Y

SELECTORS = ("r2_se", "r2_max", "bic")


def resolve_k(frame: Frame, mode: str, k_max: int | None, args: dict | None, seed: int | None, keep: int | None):
    """k and the selection's result for the string modes of a fit."""
    allowed = {"optimal": {"selector", "diagnostic", "args"}, "sequence": {"test_method", "alpha", "args"}}
    if mode not in allowed:
        raise InvalidArgument(f"k must be a number, optimal or sequence, not {mode!r}")
    if k_max is None:
        raise InvalidArgument("k_max is needed to find k")
    if unknown := set(args or {}) - allowed[mode]:
        raise InvalidArgs(f"unknown find_k_args: {sorted(unknown)}")
    find = pls1_find_k_optimal if mode == "optimal" else pls1_find_k_sequence
    found = find(frame, k_max, seed=seed, keep=keep, **(args or {}))
    if found.k_star == 0:
        raise SequenceNoRejection("no component is significant")
    return found.k_star, found


def fold_scores(frame: Frame, info: dict, seed: int, n_folds: int, candidates: list[tuple[int, int | None]]) -> DataFrame:
    """fold, candidate, r2 of each (k, keep) in each fold: weighted, on rows that the fit did not see. All k of one keep
    come from one fit; a k that the fold's data cannot reach is NaN. From moments; over rows for many features, and for the folds whose
    fits lose digits by moments."""
    centre = info["centre"]
    sets = resample.folds(frame.rows, seed, info["n"], n_folds)
    if frame.d > fits.MANY:
        return fold_score_rows(frame, sets, list(range(n_folds)), candidates)

    def work(b: int, train: moments.Moments, val: moments.Moments) -> list[tuple]:
        if train.n[1] <= 0:
            train = train.unweighted()
        if val.n[1] <= 0:
            val = val.unweighted()
        s, out = moments.standard(train), []
        for keep in dict.fromkeys(c[1] for c in candidates):
            mine = [(i, k) for i, (k, c) in enumerate(candidates) if c == keep]
            f = kernels.pls1(s.gram, s.cross[:, 0], max(k for _, k in mine), keep)
            near = fits.near(f, max(k for _, k in mine))
            for i, k in mine:
                if k > f.k_used:
                    out.append((b, i, math.nan, near))
                    continue
                res, tot = residuals(val, s, kernels.coef_at(f.w, f.p, f.q, k), 0)
                out.append((b, i, 1 - res / tot if tot > 0 else 0.0, near))
        return out

    found = per_pair(pair_blocks(frame, sets, centre, n_folds), frame, work, "fold int, candidate int, r2 double, near boolean").persist()
    again = sorted(r["fold"] for r in found.filter("near").select("fold").distinct().collect())  # folds
    scores = found.drop("near")
    return scores.filter(~F.col("fold").isin(again)).unionAll(fold_score_rows(frame, sets, again, candidates)) if again else scores


def fold_score_rows(frame: Frame, sets: Column, folds: list[int], candidates: list[tuple[int, int | None]]) -> DataFrame:
    """`fold_scores` over rows, for some folds."""
    out = []
    for keep in dict.fromkeys(c[1] for c in candidates):
        mine = [(i, k) for i, (k, c) in enumerate(candidates) if c == keep]
        for some in wide.fit_sets(frame, sets, [2 * b for b in folds], max(k for _, k in mine), keep, fill_weights=True):
            scorers = {}
            for s, f in some.items():
                g = np.column_stack([f.coef(0, k) for _, k in mine])
                scorers[s + 1] = wide.scorer(f, g, np.zeros(len(mine), int), True)
            seen = wide.score_sets(frame, sets, scorers)
            empty = {s: scorers[s] for s, v in seen.items() if v.sw <= 0}
            for c in empty.values():  # held-out rows without weight count alike
                c.plain = True
            seen |= wide.score_sets(frame, sets, empty) if empty else {}
            for s, v in seen.items():
                res, tot = v.residuals()
                r2 = np.where(tot > 0, 1 - res / np.where(tot > 0, tot, 1), 0.0)
                out += [((s - 1) // 2, i, float(r2[at]) if k <= some[s - 1].k_used[0] else math.nan) for at, (i, k) in enumerate(mine)]
    return frame.rows.sparkSession.createDataFrame(out, "fold int, candidate int, r2 double")


def over_folds(scores: DataFrame, n: int) -> tuple[list[float], list[float]]:
    """Mean and standard error over the finite folds of each candidate."""
    fine = F.when(~F.isnan("r2"), F.col("r2"))
    rows = scores.groupBy("candidate").agg(F.avg(fine).alias("mean"), F.coalesce(F.stddev_samp(fine), F.lit(0.0)).alias("sd"), F.count(fine).alias("n")).collect()
    found = {r["candidate"]: (r["mean"], r["sd"] / math.sqrt(r["n"])) for r in rows if r["n"]}
    nan = (math.nan, math.nan)
    return [found.get(i, nan)[0] for i in range(n)], [found.get(i, nan)[1] for i in range(n)]


def best(mean: list[float]) -> int:
    """Place of the largest finite mean, the last of equal ones."""
    finite = [i for i, v in enumerate(mean) if math.isfinite(v)]
    return max(finite, key=lambda i: (mean[i], i)) if finite else 0


def one_se(mean: list[float], se: list[float]) -> int:
    """The first place whose mean is within one standard error of the best."""
    top = best(mean)
    if not math.isfinite(mean[top]):
        return top
    return next(i for i, v in enumerate(mean) if math.isfinite(v) and v >= mean[top] - se[top])


def bic_scores(m: moments.Moments, n_eff: float, k_max: int, keep: int | None) -> dict[int, float]:
    s = moments.standard(m)
    f = kernels.pls1(s.gram, s.cross[:, 0], k_max, keep)
    out = {}
    for k in range(1, f.k_used + 1):
        c = kernels.coef_at(f.w, f.p, f.q, k)
        ssr = float(s.y_square[0] - 2 * c @ s.cross[:, 0] + c @ s.gram @ c)
        out[k] = n_eff * math.log(max(ssr, 1e-300) / n_eff) + k * math.log(n_eff)
    return out


def bic_rows(frame: Frame, n_eff: float, k_max: int, keep: int | None) -> dict[int, float]:
    """`bic_scores` over rows: each component takes its share of y's sum of squares."""
    f = next(wide.fit_sets(frame, None, [0], k_max, keep))[0]
    out, ssr = {}, float(f.square[0])
    for k in range(1, int(f.k_used[0]) + 1):
        ssr -= float(f.q[k - 1][0] ** 2 * f.tt[k - 1][0])
        out[k] = n_eff * math.log(max(ssr, 1e-300) / n_eff) + k * math.log(n_eff)
    return out


def pls1_find_k_optimal(frame: Frame, k_max: int, *, selector: str = "r2_se", diagnostic: str | None = None, args: dict | None = None, seed: int | None = None, keep: int | None = None) -> FindKOptimalResult:
    """The number of components by cross-validated R2 (r2_max, or r2_se: the smallest within one standard error) or BIC.

    diagnostic: a test method; p-values of every component are then reported, without stopping."""
    if selector not in SELECTORS:
        raise InvalidArgument(f"no selector {selector!r}")
    args = dict(args or {})
    own = set() if selector == "bic" else {"n_folds"}
    if diagnostic is not None and diagnostic != "score":
        own |= set(METHODS.get(diagnostic, {}))
    if unknown := set(args) - own:
        raise InvalidArgs(f"{selector} takes no {sorted(unknown)}")
    n_folds = args.get("n_folds", 5)
    if n_folds < 2:
        raise InvalidArgument("n_folds must be 2 at least")
    info = moments.validate(frame, unique=True)
    check_k(info, frame, k_max, keep)
    seed, n = resample.resolve_seed(seed), info["n"]
    cv = se = bic = pvalues = rank = None
    if selector == "bic":
        bic = bic_rows(frame, info["n_eff"], k_max, keep) if frame.d > fits.MANY else bic_scores(moments.total(frame, info["centre"]), info["n_eff"], k_max, keep)
        k_star = min(bic, key=lambda k: (bic[k], k), default=1)
    else:
        folds = max(min(n_folds, n - 2), 2)
        top = max(min(k_max, n - folds - 2), 1)
        mean, err = over_folds(fold_scores(frame, info, seed, folds, [(k, keep) for k in range(1, top + 1)]), top)
        k_star = 1 + (best(mean) if selector == "r2_max" else one_se(mean, err))
        cv, se = dict(enumerate(mean, 1)), dict(enumerate(err, 1))
    if diagnostic is not None:
        test_args = {a: v for a, v in args.items() if a in METHODS.get(diagnostic, {})}
        pvalues, rank = _sequence(frame, info, k_max, diagnostic, test_args, 0.0, seed, keep, stop=False)
    return FindKOptimalResult(k_star, selector, cv, se, bic, pvalues, diagnostic, seed, info["n_eff"], rank)


def pls1_find_k_sequence(frame: Frame, k_max: int, *, test_method: str = "split_nb", alpha: float = 0.05, args: dict | None = None, seed: int | None = None, keep: int | None = None) -> FindKSequenceResult:
    """Tests component after component on what the earlier ones leave, up to the first that is not significant."""
    if not 0 < alpha < 1:
        raise InvalidArgument("alpha must lie between 0 and 1")
    info = moments.validate(frame, unique=True)
    check_k(info, frame, k_max, keep)
    seed = resample.resolve_seed(seed)
    pvalues, rank = _sequence(frame, info, k_max, test_method, args, alpha, seed, keep, stop=True)
    k_star = next((i for i, p in enumerate(pvalues) if not p < alpha), k_max)
    return FindKSequenceResult(k_star, pvalues, test_method, alpha, seed, info["n_eff"], rank)


def _sequence(frame: Frame, info: dict, k_max: int, method: str, args: dict | None, alpha: float, seed: int, keep: int | None, stop: bool) -> tuple[list[float], float | None]:
    if method == "score":
        raise InvalidArgs("the score test is not for sequences")
    method_args(method, args)
    seen: SplitNbGateResult | None = None
    if method == "split_nb":  # decided once, on the data as they are
        seen = gate(frame, info)
    f = fits.fitted(frame, info, k_max, keep)
    by_blocks = method == "split_nb" and frame.d <= fits.MANY and (method_args(method, args)["force"] or not seen.fires)
    if by_blocks and (found := sequence_of_blocks(frame, info, f, k_max, method_args(method, args)["n_splits"], seed, keep)):
        first = next((i for i, p in enumerate(found) if not p < alpha), len(found)) if stop else len(found)
        return [p if i <= first else math.nan for i, p in enumerate(found + [math.nan] * (k_max - len(found)))], seen.stable_rank
    base = preprocess(frame)
    rows = frame.with_rows(base.rows.persist())
    out = [math.nan] * k_max
    try:
        for h in range(1, min(k_max, f.k_used + 1) + 1):
            left = deflated(rows, f, h - 1)
            out[h - 1] = pls1_confirmatory_test(left, 1, method=method, args=args, pre_standardized=True, seed=seed + h, keep=keep, _gate=seen).pvalue
            if stop and not out[h - 1] < alpha:
                break
    finally:
        base.rows.unpersist()
    return out, seen.stable_rank if seen else None


#: A column of which components leave less than this share of its variance: blocks hold too few digits of the rest.
EXPLAINED = 1e-9


def sequence_of_blocks(frame: Frame, info: dict, f, k_max: int, n_splits: int, seed: int, keep: int | None) -> list[float] | None:
    """p of the split test for each component on what the earlier ones leave, from one pass of blocks for all of them.

    Taking components out is linear in x and y, so each set's block is mapped instead of its rows. (Rows of weight 0, which keep what components would take, are in
    none of the sums with weights.) None: digits are lost somewhere, and rows must be deflated."""
    top, d, n = min(k_max, f.k_used + 1), frame.d, info["n"]
    if n < 6:
        raise InvalidArgument(f"{n} rows are too few for k=1 in split halves")
    halves = lambda h: resample.halves(frame.rows, seed + h, "split", n_splits, kernels.split_size(n, 1))
    after = lambda sets, first: F.transform(sets, lambda s: s + F.lit(first))
    labels = [after(halves(h), 2 * n_splits * (h - 1)) for h in range(1, top + 1)]
    s = moments.standard(moments.total(frame, info["centre"]))
    unit = np.diag(1 / s.x_scale)
    maps = [(unit, np.zeros(d))]
    for h in range(1, top):
        r = kernels.score_weights(f.w[:, :h], f.p[:, :h])
        maps.append(((np.eye(d) - f.p[:, :h] @ r.T) @ unit, (r @ f.q[:h]) @ unit))
    move = np.concatenate([s.x_mean, s.y_mean])
    flat = np.diag(s.gram) <= 0

    def work(b: int, train: moments.Moments, test: moments.Moments) -> list[tuple]:
        a, c = maps[b // n_splits]
        inside, outside = (moments.mapped(m.shifted(move), a, c, s.y_scale[0]) for m in (train, test))
        st = moments.standard(inside)
        sw = inside.n[1] if inside.n[1] > 0 else 1.0
        left = np.diag(inside.xxw) / sw - (inside.xw / sw) ** 2
        fit = kernels.pls1(st.gram, st.cross[:, 0], 1, keep)
        r = correlation(fit.coef / st.x_scale, st.x_mean, outside, 0, 1e-15, 0.0) if fit.k_used else 0.0
        return [(b // n_splits, r, bool((left[~flat] < EXPLAINED).any()) or fits.near(fit, 1))]

    blocks = pair_blocks(frame, F.concat(*labels), info["centre"], top * n_splits)
    found = per_pair(blocks, frame, work, "h int, r double, near boolean")
    z = fisher_z(F.col("r"))
    rows = found.groupBy("h").agg(F.avg(z).alias("mean"), F.var_samp(z).alias("var"), F.max("near").alias("near")).orderBy("h").collect()  # a row a component
    if any(r["near"] for r in rows):
        return None
    return [split_nb_p(r["mean"], r["var"], n_splits, n, 1, frame.weighted)[0] for r in rows]


def deflated(frame: Frame, f, components: int) -> Frame:
    """Standardised rows without their first components; rows of weight 0 stay as they are."""
    if components == 0:
        return frame
    w, p, q = f.w[:, :components], f.p[:, :components], f.q[:components]
    r = kernels.score_weights(w, p)
    weighted, d, width, names = frame.weighted, frame.d, frame.q, frame.rows.columns

    def run(batches):
        for b in batches:
            x, y = matrix(b, X, d), matrix(b, Y, width)
            t = x @ r
            if weighted:
                t[b.column(WEIGHT).to_numpy(zero_copy_only=False) == 0] = 0
            left = {X: x - t @ p.T, Y: y - (t @ q)[:, None]}
            columns = [b.column(c) if c not in left else pa.ListArray.from_arrays(pa.array(np.arange(len(t) + 1) * left[c].shape[1], pa.int32()), pa.array(left[c].ravel())) for c in names]
            yield pa.RecordBatch.from_arrays(columns, names)

    return frame.with_rows(frame.rows.mapInArrow(run, frame.rows.schema))


def spls1_find_keep_optimal(frame: Frame, k: int, *, args: dict | None = None, seed: int | None = None) -> FindKeepOptimalResult:
    """The fewest features a component within one standard error of the best cross-validated R2."""
    if unknown := set(args or {}) - {"n_folds"}:
        raise InvalidArgs(f"unknown arguments: {sorted(unknown)}")
    info = moments.validate(frame, unique=True)
    check_k(info, frame, k)
    seed, n = resample.resolve_seed(seed), info["n"]
    n_folds = (args or {}).get("n_folds", 5)
    if n_folds < 2:
        raise InvalidArgument("n_folds must be 2 at least")
    grid = kernels.keep_grid(frame.d)
    folds = max(min(n_folds, n - 2), 2)
    mean, err = over_folds(fold_scores(frame, info, seed, folds, [(k, g) for g in grid]), len(grid))
    at = one_se(mean, err)
    return FindKeepOptimalResult(grid[at], k, dict(zip(grid, mean, strict=True)), dict(zip(grid, err, strict=True)), grid, seed, info["n_eff"])


def spls1_find_k_optimal(frame: Frame, k_max: int, keep: int, **options) -> FindKOptimalResult:
    return pls1_find_k_optimal(frame, k_max, keep=keep, **options)


def spls1_find_k_sequence(frame: Frame, k_max: int, keep: int, **options) -> FindKSequenceResult:
    return pls1_find_k_sequence(frame, k_max, keep=keep, **options)

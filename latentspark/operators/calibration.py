"""How often the tests reject where nothing is there: simulations on the frame at hand.

A simulation is the frame with its responses in a random order, so y has nothing to do with features and weights. All simulations are
responses of one frame: each method takes as many passes for all of them as for one, and what is summed grows with their number only in the small
side, features x responses.
"""

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from latentspark.errors import InvalidArgument
from latentspark.operators import fit as fits
from latentspark.operators import inference, moments, resample, wide
from latentspark.operators.fit import check_k
from latentspark.results import CalibrationResult
from latentspark.sources.frame import Frame

POOLED = ("raw_perm", "split_exact")


def score_p(sims: Frame, info: dict) -> np.ndarray:
    """The score test's p for every response."""
    d, q = sims.d, sims.q
    if d <= fits.MANY:
        s = moments.standard(moments.total(sims, np.concatenate([info["centre"][:d], np.repeat(info["centre"][d], q)])))
        t, s1, s2 = (s.cross**2).sum(0), float(np.trace(s.gram)), float((s.gram**2).sum())
    else:
        t, s1, s2 = np.zeros(q), 0.0, None
        for _, responses in wide.ranges([0], d, q, 1):
            f = wide.standards(sims, None, [0], responses)[0]
            c, s1 = wide.covariance(sims, f)
            t[responses.start : responses.stop] = (c * c).sum(0)
            s2 = wide.square_norm(sims, f) if s2 is None else s2
    return np.array([inference.matched(float(v), s1, s2)[0] for v in t])


def split_nb_p(sims: Frame, info: dict, k: int, n_splits: int, seed: int, keep: int | None) -> np.ndarray:
    """The split test's p for every response, without its gate."""
    z = inference.split_correlations(sims, info, k, n_splits, seed, keep).select("response", inference.fisher_z(F.col("r")).alias("z"))
    rows = z.groupBy("response").agg(F.avg("z").alias("mean"), F.var_samp("z").alias("var"), F.count("*").alias("n")).collect()  # a row a response
    out = np.ones(sims.q)
    for r in rows:
        out[r["response"]] = inference.split_nb_p(r["mean"], r["var"], r["n"], info["n"], k, sims.weighted)[0]
    return out


def pooled_p(statistics: np.ndarray, n_sim: int) -> np.ndarray:
    """p of statistics 1 to n_sim among those after them, as `inference.exceedance` has it. Statistic 0 is the observed response's."""
    null = np.sort(np.where(np.isnan(statistics[n_sim + 1 :]), np.inf, statistics[n_sim + 1 :]))
    return (len(null) - np.searchsorted(null, statistics[1 : n_sim + 1], "left") + 1) / (len(null) + 1)


def pls1_calibration(frame: Frame, k: int = 1, *, methods: tuple[str, ...] = tuple(inference.METHODS), n_sim: int = 200, args: dict[str, dict] | None = None, alpha: float = 0.05, seed: int | None = None, keep: int | None = None) -> CalibrationResult:
    """Rejections at `alpha` of each method in n_sim simulations without an effect; args: those of the methods, by name.

    split_nb runs without its gate, so that its own rate is seen. The responses in random orders that raw_perm and split_exact compare with are
    drawn once, n_perm of them, for all simulations: they are as good as each simulation's own, but shared, which the bound on the
    rate allows for: alpha plus three standard deviations, alpha (1 - alpha) (1 / n_sim + 1 / n_perm). A rate below it counts as calibrated. Splits and
    folds are shared, too."""
    args = args or {}
    if unknown := set(args) - set(methods):
        raise InvalidArgument(f"arguments for methods that are not run: {sorted(unknown)}")
    given = {m: inference.method_args(m, args.get(m)) for m in methods}
    if n_sim < 1 or not 0 < alpha < 1:
        raise InvalidArgument("n_sim must be 1 at least, alpha lie between 0 and 1")
    info = moments.validate(frame, unique=True)
    check_k(info, frame, k, keep)
    seed = resample.resolve_seed(seed)
    sims = lambda more=0: resample.permuted(frame, seed, "simulated", n_sim + more)
    found, rates = [], []
    for m, a in given.items():
        if m == "raw_perm":
            p = pooled_p(inference.held_out_r2(*inference.fold_sums(sims(a["n_perm"]), info, k, a["n_folds"], seed, keep)), n_sim)
        elif m == "split_exact":
            r = inference.split_correlations(sims(a["n_perm"]), info, k, a["n_splits"], seed, keep)
            rows = r.groupBy("response").agg(F.avg(inference.fisher_z(F.col("r"))).alias("z")).collect()  # a row a response
            z = np.empty(1 + n_sim + a["n_perm"])
            z[[x["response"] for x in rows]] = [x["z"] for x in rows]
            p = pooled_p(z, n_sim)
        elif m == "split_nb":
            p = split_nb_p(sims(), info, k, a["n_splits"], seed, keep)[1:]
        elif m == "score":
            p = score_p(sims(), info)[1:]
        else:
            p = np.array([inference.e_p(v) for v in inference.log_e_values(sims(), info, k, seed, keep)[1:]])
        found.append(pd.DataFrame({"method": m, "simulation": range(n_sim), "pvalue": p}))
        rejected = int((p <= alpha).sum())
        bound = alpha + 3 * math.sqrt(alpha * (1 - alpha) * (1 / n_sim + (1 / a["n_perm"] if m in POOLED else 0)))
        rates.append((m, n_sim, rejected, rejected / n_sim, bound, rejected / n_sim <= bound))
    spark = frame.rows.sparkSession
    return CalibrationResult(
        alpha,
        n_sim,
        k,
        seed,
        info["n_eff"],
        spark.createDataFrame(rates, "method string, n_sim int, rejected int, rate double, bound double, calibrated boolean"),
        spark.createDataFrame(pd.concat(found), "method string, simulation int, pvalue double"),
    )

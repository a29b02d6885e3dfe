"""The library's operators as queries over the driver's tables, and the same in SQL.

The frame is the embeddings table: 64 features, y = 4 (x_1 + x_2) + 0.05 (label - 4.5), weights 0.5 + (vec_id mod 7) / 4 where
weighted. Feature numbers are from 0. Doubles are rounded on both sides.
"""

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latentspark.functions import kernels
from latentspark.operators import fit as fits
from latentspark.operators import inference, moments, resample, selection
from latentspark.operators.calibration import pls1_calibration
from latentspark.operators.rotation_stability import pls1_rotation_stability
from latentspark.sources.frame import Frame, feature_frame

D, SEED = 64, 20
_Y = "4 * (CAST(embedding[{0}] AS DOUBLE) + CAST(embedding[{1}] AS DOUBLE)) + 0.05 * (label - 4.5)"


def embeddings(spark: SparkSession, sf_dir: str, weighted: bool = False) -> Frame:
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    x = F.transform("embedding", lambda v: v.cast("double"))
    cols = [F.col("vec_id").alias("row_id"), x.alias("x"), F.expr(_Y.format(1, 2)).alias("y"), (0.5 + F.pmod("vec_id", F.lit(7)) / 4.0).alias("w")]
    return feature_frame(df.select(*cols), "x", "y", "row_id", "w" if weighted else None, d=D)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, and no negative zeros."""
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def by_feature(spark: SparkSession, **columns) -> DataFrame:
    rows = [(j, *map(float, v)) for j, v in enumerate(zip(*columns.values(), strict=True))]
    return rounded(spark.createDataFrame(rows, "feature int, " + ", ".join(f"{c} double" for c in columns)))


def _total(f: Frame):
    info = moments.validate(f)
    return moments.total(f, info["centre"]), info


# ---- moments and standardisation


def standardize(spark, sf_dir):
    p = fits.preprocess(embeddings(spark, sf_dir, True))
    return rounded(p.rows.select("row_id", F.posexplode("x").alias("feature", "value")))


def column_moments(spark, sf_dir):
    f = embeddings(spark, sf_dir, True)
    p = fits.preprocess(f)
    return by_feature(spark, mean=p.x_mean, scale=p.x_scale)


def kish_n_eff(spark, sf_dir):
    f = embeddings(spark, sf_dir, True)
    return rounded(f.rows.agg((F.sum("w") ** 2 / F.sum(F.col("w") * F.col("w"))).alias("n_eff")))


def gram(spark, sf_dir):
    m, _ = _total(embeddings(spark, sf_dir))
    g = moments.standard(m).gram
    return rounded(spark.createDataFrame([(i, j, float(g[i, j])) for i in range(D) for j in range(i, D)], "i int, j int, value double"), 5)


def cross_moment(spark, sf_dir):
    m, _ = _total(embeddings(spark, sf_dir, True))
    return by_feature(spark, value=moments.standard(m).cross[:, 0])


def lineitem_gram(spark, sf_dir):
    """Moments of a table without a row id: one aggregation, partial in every task."""
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("0L AS row_id", "l_quantity", "l_discount", "l_tax", "l_extendedprice")
    f = feature_frame(df, ["l_quantity", "l_discount", "l_tax"], "l_extendedprice")
    m, _ = _total(f)
    s = moments.standard(m)
    n = s.rows
    return rounded(spark.createDataFrame([(i, float(s.cross[i, 0] / n), float(s.gram[i, 0] / n)) for i in range(3)], "feature int, corr_y double, corr_first double"))


# ---- fits


def pls1_k1_coef(spark, sf_dir):
    m = fits.pls1_fit(embeddings(spark, sf_dir))
    return by_feature(spark, coef=m.coef, beta=m.beta)


def pls1_k1_predict(spark, sf_dir):
    f = embeddings(spark, sf_dir)
    return rounded(fits.pls1_predict(fits.pls1_fit(f), f.rows).select("row_id", "prediction"))


def pls1_k2_coef(spark, sf_dir):
    return by_feature(spark, coef=fits.pls1_fit(embeddings(spark, sf_dir), 2).coef)


def pls1_weighted_k1_coef(spark, sf_dir):
    return by_feature(spark, coef=fits.pls1_fit(embeddings(spark, sf_dir, True)).coef)


def spls1_topk(spark, sf_dir):
    return by_feature(spark, coef=fits.spls1_fit(embeddings(spark, sf_dir), 1, 8).coef)


def scores_k1(spark, sf_dir):
    f = embeddings(spark, sf_dir)
    return rounded(fits.scores(fits.pls1_fit(f), f).select("row_id", F.col("scores")[0].alias("score")))


def deflated_y(spark, sf_dir):
    """Responses after one component is taken out."""
    f = embeddings(spark, sf_dir)
    m, _ = _total(f)
    s = moments.standard(m)
    one = kernels.pls1(s.gram, s.cross[:, 0], 1)
    left = selection.deflated(f.with_rows(fits.preprocess(f).rows), one, 1)
    return rounded(left.rows.select("row_id", F.col("y")[0].alias("y")))


def leverage_k1(spark, sf_dir):
    return by_feature(spark, leverage=kernels.leverage(fits.pls1_fit(embeddings(spark, sf_dir)).w))


def score_stat(spark, sf_dir):
    m, _ = _total(embeddings(spark, sf_dir))
    s = moments.standard(m)
    s1, s2 = np.trace(s.gram), (s.gram**2).sum()
    _, t = inference.score_test(m)
    return rounded(spark.createDataFrame([(float(t), float(s2 / s1), float(s1 * s1 / s2))], "statistic double, scale double, df double"), 4)


def bic_by_k(spark, sf_dir):
    m, info = _total(embeddings(spark, sf_dir))
    return rounded(spark.createDataFrame([(k, v) for k, v in selection.bic_scores(m, info["n_eff"], 2, None).items()], "k int, bic double"))


def stable_rank(spark, sf_dir):
    return rounded(inference.split_nb_gate(embeddings(spark, sf_dir)).to_df(spark))


def rotate(spark, sf_dir):
    m = fits.rotate(fits.pls1_fit(embeddings(spark, sf_dir), 3))
    return by_feature(spark, w1=m.w[:, 0], w2=m.w[:, 1], w3=m.w[:, 2])


# ---- resampling


def fold_assign(spark, sf_dir):
    f = embeddings(spark, sf_dir)
    n = f.rows.count()
    return resample.ranks(f.rows, SEED, "fold", 1).select("row_id", resample.fold_of(F.col("rank"), n, 5).alias("fold"))


def split_assign(spark, sf_dir):
    f = embeddings(spark, sf_dir)
    n_train = kernels.split_size(f.rows.count(), 1)
    return resample.ranks(f.rows, SEED, "split", 4).select("row_id", "b", (F.col("rank") < n_train).alias("train"))


def permute_rows(spark, sf_dir):
    return resample.ranks(embeddings(spark, sf_dir).rows, SEED, "perm", 2).select("row_id", "b", F.col("rank").cast("long").alias("place"))


def subsample_assign(spark, sf_dir):
    f = embeddings(spark, sf_dir)
    m = int(np.ceil(f.rows.count() ** 0.7))
    return resample.ranks(f.rows, SEED, "subsample", 3).filter(F.col("rank") < m).select("b", "row_id")


def split_r(spark, sf_dir):
    f = embeddings(spark, sf_dir)
    r = inference.split_correlations(f, moments.validate(f), 1, 4, SEED, None)
    return rounded(r.select("b", "r"))


def split_r_weighted(spark, sf_dir):
    f = embeddings(spark, sf_dir, True)
    return rounded(inference.split_correlations(f, moments.validate(f), 1, 20, SEED, None).select("b", "r"))


def split_r_k2(spark, sf_dir):
    """Two components in each half."""
    f = embeddings(spark, sf_dir)
    return rounded(inference.split_correlations(f, moments.validate(f), 2, 20, SEED, None).select("b", "r"))


def split_r_sparse(spark, sf_dir):
    """One component of eight features in each half."""
    f = embeddings(spark, sf_dir)
    return rounded(inference.split_correlations(f, moments.validate(f), 1, 20, SEED, 8).select("b", "r"))


def ci_holdout(spark, sf_dir):
    """The interval of the held-out correlation over 1000 subsamples."""
    f = embeddings(spark, sf_dir)
    info = moments.validate(f)
    m = inference.subsample_size(info["n"], 1, 1000, 0.7, 0.95)
    r = [x["r"] for x in inference.subsample_fits(f, info, 1, m, 1000, False, SEED).select("r").collect()]
    ci = inference.wald_interval(r, info["n"], m, 0.95)
    return rounded(spark.createDataFrame([(ci.point, ci.lower, ci.upper, ci.sd)], "point double, lower double, upper double, se double"))


def mean_fisher_z(spark, sf_dir):
    f = embeddings(spark, sf_dir)
    r = inference.split_correlations(f, moments.validate(f), 1, 4, SEED, None)
    return rounded(r.agg(F.avg(inference.fisher_z(F.col("r"))).alias("z")))


def cv_r2(spark, sf_dir):
    """R2 of one component in each fold."""
    f = embeddings(spark, sf_dir)
    s = selection.fold_scores(f, moments.validate(f), SEED, 5, [(1, None)])
    return rounded(s.select("fold", "r2"))


def cv_mean_se(spark, sf_dir):
    f = embeddings(spark, sf_dir)
    mean, se = selection.over_folds(selection.fold_scores(f, moments.validate(f), SEED, 5, [(1, None)]), 1)
    return rounded(spark.createDataFrame([(mean[0], se[0])], "mean double, se double"))


def quantile7(spark, sf_dir):
    f = embeddings(spark, sf_dir)
    qs = [0.025, 0.25, 0.5, 0.975]
    y = f.rows.select(F.col("y")[0].alias("y"))
    found = y.agg(*[F.percentile("y", q).alias(f"q{i}") for i, q in enumerate(qs)])
    return rounded(found)


def sign_z(spark, sf_dir):
    """Sign agreement of features with the first covariance's sign, over 4 halves."""
    f = embeddings(spark, sf_dir)
    m, info = _total(f)
    ref = moments.standard(m).cross[:, 0]
    sets = resample.halves(f.rows, SEED, "split", 4, kernels.split_size(info["n"], 1), both=False)
    work = lambda b, s: [(b, j, float(v)) for j, v in enumerate(moments.standard(s).cross[:, 0])]
    each = moments.per_set(moments.set_blocks(f, sets, info["centre"], 8), f, work, "b int, feature int, beta double")
    refs = spark.createDataFrame([(j, float(v)) for j, v in enumerate(ref)], "feature int, ref double")
    agree = F.avg((F.signum("beta") == F.signum("ref")).cast("double"))
    return rounded(each.join(F.broadcast(refs), "feature").groupBy("feature").agg(((2 * agree - 1) * F.sqrt(F.count("*"))).alias("z")))


def perm_cross(spark, sf_dir):
    """Covariance of the first feature with y in 20 random orders, and its exceedance p."""
    p = resample.permuted(embeddings(spark, sf_dir), SEED, "perm", 20)
    info = moments.validate(p)
    c = moments.standard(moments.total(p, info["centre"])).cross[0] / info["n"]
    over = int((c[1:] >= c[0]).sum())
    return rounded(spark.createDataFrame([(float(c[0]), (over + 1) / 21)], "observed double, p double"))


def pls1_perm_null(spark, sf_dir):
    return rounded(inference.pls1_perm_null(embeddings(spark, sf_dir), 1, seed=SEED).per_feature)


def _test(method: str, **args):
    def run(spark, sf_dir):
        return rounded(inference.pls1_confirmatory_test(embeddings(spark, sf_dir), 1, method=method, args=args, seed=SEED).to_df(spark))

    run.__name__ = f"test_{method}"
    return run


def test_score(spark, sf_dir):
    """The statistic is some hundred thousand, so it is given to three digits."""
    r = inference.pls1_confirmatory_test(embeddings(spark, sf_dir), 1, method="score", seed=SEED).to_df(spark)
    return rounded(r).withColumn("statistic", F.round("statistic", 3))


def confirmatory_ci(spark, sf_dir):
    ci = inference.pls1_confirmatory_test(embeddings(spark, sf_dir), 1, method="score", ci=True, seed=SEED).ci
    return rounded(ci.per_feature)


def find_k_optimal(spark, sf_dir):
    r = selection.pls1_find_k_optimal(embeddings(spark, sf_dir), 4, seed=SEED)
    return rounded(spark.createDataFrame([(k, v, r.cv_scores_se[k], k == r.k_star) for k, v in r.cv_scores.items()], "k int, r2 double, se double, chosen boolean"))


def find_k_sequence(spark, sf_dir):
    r = selection.pls1_find_k_sequence(embeddings(spark, sf_dir), 3, seed=SEED)
    return rounded(spark.createDataFrame([(k, float(p), k == r.k_star) for k, p in enumerate(r.pvalues, 1)], "k int, pvalue double, chosen boolean"))


def find_keep_optimal(spark, sf_dir):
    r = selection.spls1_find_keep_optimal(embeddings(spark, sf_dir), 1, seed=SEED)
    return rounded(spark.createDataFrame([(k, v, r.cv_scores_se[k], k == r.keep_star) for k, v in r.cv_scores.items()], "keep int, r2 double, se double, chosen boolean"))


def rotation_stability(spark, sf_dir):
    return pls1_rotation_stability(embeddings(spark, sf_dir), 2, seed=SEED).to_df(spark)


def _calibrate(*methods: str):
    """p of 200 simulations without an effect."""

    def run(spark, sf_dir):
        return rounded(pls1_calibration(embeddings(spark, sf_dir), methods=methods, seed=SEED).p_values)

    run.__name__ = "calibrate_" + "_".join(methods)
    return run


_ALL = (standardize, column_moments, kish_n_eff, gram, cross_moment, lineitem_gram, pls1_k1_coef, pls1_k1_predict, pls1_k2_coef, pls1_weighted_k1_coef, spls1_topk, scores_k1, deflated_y, leverage_k1, score_stat, bic_by_k, stable_rank, rotate, fold_assign, split_assign, permute_rows, subsample_assign, split_r, mean_fisher_z, cv_r2, cv_mean_se, quantile7, sign_z, perm_cross, pls1_perm_null, confirmatory_ci, find_k_optimal, find_k_sequence, find_keep_optimal, rotation_stability, _test("raw_perm"), _test("split_nb"), _test("split_exact"), test_score, _test("e"), split_r_weighted, split_r_k2, split_r_sparse, ci_holdout, _calibrate("score", "split_nb", "e"), _calibrate("raw_perm"), _calibrate("split_exact"))
QUERIES = {f.__name__: f for f in _ALL}

# ---- the same in SQL

#: Long form: (row_id, feature, x), y and w of each row, standardised z with weights of mean 1.
_LONG = f"""
base AS (SELECT vec_id AS row_id, embedding, {_Y.format(2, 3)} AS y, 0.5 + (vec_id % 7) / 4.0 AS w FROM embeddings),
long AS (SELECT row_id, y, WEIGHT AS w, unnest(range(0, 64)) AS feature, CAST(unnest(embedding) AS DOUBLE) AS x FROM base),
col AS (SELECT feature, sum(w * x) / sum(w) AS mean, sqrt(sum(w * x * x) / sum(w) - (sum(w * x) / sum(w)) ** 2) AS scale FROM long GROUP BY feature),
resp AS (SELECT count(*) AS n, sum(WEIGHT) AS sw, sum(WEIGHT * y) / sum(WEIGHT) AS my, sqrt(sum(WEIGHT * y * y) / sum(WEIGHT) - (sum(WEIGHT * y) / sum(WEIGHT)) ** 2) AS sy FROM base),
z AS (SELECT row_id, feature, (x - mean) / scale AS z, (y - my) / sy AS zy, w * n / sw AS w FROM long JOIN col USING (feature), resp)"""
_PLAIN, _WEIGHTED = _LONG.replace("WEIGHT", "1.0"), _LONG.replace("WEIGHT", "w")
_S = "s AS (SELECT feature, sum(w * z * zy) AS s FROM z GROUP BY feature)"
_K1 = f"""{_S},
w1 AS (SELECT feature, s / sqrt((SELECT sum(s * s) FROM s)) AS v FROM s),
t1 AS (SELECT row_id, any_value(zy) AS zy, any_value(w) AS w, sum(z * v) AS t FROM z JOIN w1 USING (feature) GROUP BY row_id),
q1 AS (SELECT sum(w * t * zy) / sum(w * t * t) AS q, sum(w * t * t) AS tt FROM t1)"""
_K2 = f"""{_K1},
p1 AS (SELECT feature, sum(z * t) / (SELECT tt FROM q1) AS p FROM z JOIN t1 USING (row_id) GROUP BY feature),
z2 AS (SELECT row_id, feature, z - t * p AS z, z.zy - t * q AS zy FROM z JOIN t1 USING (row_id) JOIN p1 USING (feature), q1),
s2 AS (SELECT feature, sum(z * zy) AS s FROM z2 GROUP BY feature),
w2 AS (SELECT feature, s / sqrt((SELECT sum(s * s) FROM s2)) AS v FROM s2),
t2 AS (SELECT row_id, any_value(zy) AS zy, sum(z * v) AS t FROM z2 JOIN w2 USING (feature) GROUP BY row_id),
q2 AS (SELECT sum(t * zy) / sum(t * t) AS q FROM t2),
pw AS (SELECT sum(p1.p * w2.v) AS c FROM p1 JOIN w2 USING (feature)),
coef2 AS (SELECT feature, w1.v * (q1.q - c * q2.q) + w2.v * q2.q AS coef FROM w1 JOIN w2 USING (feature), q1, q2, pw)"""
_R = lambda e, name, digits=6: f"round({e}, {digits}) + 0.0 AS {name}"


def _ranked(label: str, draws: int) -> str:
    return f"""drawn AS (SELECT vec_id AS row_id, b, row_number() OVER (PARTITION BY b ORDER BY md5(concat_ws(':', '{SEED}', '{label}', b, vec_id)), vec_id) - 1 AS rank
FROM embeddings, (SELECT CAST(unnest(range(0, {draws})) AS INTEGER) AS b))"""


def _once(source: str) -> str:
    """One pass through the bijection's network for rows (b, r0, v, t) of source, in SQL: 8 rounds, as for more than 16 rows."""
    q = f"SELECT b, r0, t, ks, low, mlow, mhigh, v & mlow AS lo, v >> low AS hi FROM {source} JOIN keys USING (b), bits"
    for i in range(8):
        src, dst, mask = ("lo", "hi", "mhigh") if i % 2 == 0 else ("hi", "lo", "mlow")
        q = f"SELECT *, (xor({src}, ks[{i + 1}]) * {resample.MIX[0]}) & 4294967295 AS h FROM ({q})"
        q = f"SELECT * EXCLUDE (h), (xor(h, h >> 15) * {resample.MIX[1]}) & 4294967295 AS h FROM ({q})"
        q = f"SELECT * EXCLUDE (h, {dst}), xor({dst}, xor(h, h >> 13) & {mask}) AS {dst} FROM ({q})"
    return f"SELECT b, r0, lo | (hi << low) AS v, t + 1 AS t FROM ({q})"


def _moved(label: str, draws: int) -> str:
    """perm (b, row_id, source): whose y a row gets in draw b, by a keyed bijection of the rows' ranks; needs WITH RECURSIVE."""
    return f"""home AS (SELECT vec_id AS row_id, row_number() OVER (ORDER BY md5(concat_ws(':', '{SEED}', '{label}-base', 0, vec_id)), vec_id) - 1 AS rank FROM embeddings),
bits AS (SELECT n, bits - bits // 2 AS low, (1 << (bits - bits // 2)) - 1 AS mlow, (1 << (bits // 2)) - 1 AS mhigh FROM (SELECT count(*) AS n, CAST(ceil(log2(count(*))) AS BIGINT) AS bits FROM embeddings)),
keys AS (SELECT b, list(key ORDER BY i) AS ks FROM (SELECT b, i, CAST('0x' || md5(concat_ws(':', '{SEED}', '{label}', b, i))[1:8] AS BIGINT) AS key FROM (SELECT unnest(range(0, {draws})) AS b), (SELECT unnest(range(0, 8)) AS i)) GROUP BY b),
walk AS (SELECT b, rank AS r0, rank AS v, CAST(0 AS BIGINT) AS t FROM home, keys UNION ALL {_once("(SELECT walk.* FROM walk, bits WHERE t = 0 OR v >= n)")}),
perm AS (SELECT CAST(b AS INTEGER) AS b, a.row_id, c.row_id AS source FROM walk JOIN home a ON a.rank = r0 JOIN home c ON c.rank = v WHERE t > 0)"""


_N = "(SELECT count(*) FROM embeddings)"
_HALF = f"least(greatest({_N} // 2, 3), {_N} - 3)"
#: k = 1 on the training rows of each draw, seen on the others; `inside` tells them apart.
_HALVES = """
long AS (SELECT b, inside, base.row_id, y, unnest(range(0, 64)) AS feature, CAST(unnest(embedding) AS DOUBLE) AS x FROM base JOIN member USING (row_id)),
col AS (SELECT b, feature, avg(x) AS mean, stddev_pop(x) AS scale FROM long WHERE inside GROUP BY b, feature),
resp AS (SELECT b, avg(y) AS my, stddev_pop(y) AS sy FROM base JOIN member USING (row_id) WHERE inside GROUP BY b),
z AS (SELECT b, inside, row_id, feature, (x - mean) / scale AS z, (y - my) / sy AS zy FROM long JOIN col USING (b, feature) JOIN resp USING (b)),
s AS (SELECT b, feature, sum(z * zy) AS s FROM z WHERE inside GROUP BY b, feature),
t AS (SELECT b, inside, row_id, any_value(zy) AS zy, sum(z * s) AS t FROM z JOIN s USING (b, feature) GROUP BY b, inside, row_id)"""
_BASE = f"base AS (SELECT vec_id AS row_id, embedding, {_Y.format(2, 3)} AS y FROM embeddings)"
_SPLIT = f"WITH {_BASE}, {_ranked('split', 4)}, member AS (SELECT row_id, b, rank < {_HALF} AS inside FROM drawn), {_HALVES}"
_FOLD = "CASE WHEN rank < (n % 5) * (n // 5 + 1) THEN rank // (n // 5 + 1) ELSE n % 5 + (rank - (n % 5) * (n // 5 + 1)) // (n // 5) END"
_FOLD_HALVES = f"""WITH {_BASE}, {_ranked('fold', 1)}, cut AS (SELECT row_id, CAST({_FOLD} AS INTEGER) AS fold FROM drawn, (SELECT count(*) AS n FROM embeddings)),
member AS (SELECT row_id, f AS b, fold <> f AS inside FROM cut, (SELECT CAST(unnest(range(0, 5)) AS INTEGER) AS f)), {_HALVES}"""
_FOLDS = f"""{_FOLD_HALVES},
q AS (SELECT b, sum(t * zy) / sum(t * t) AS q FROM t WHERE inside GROUP BY b),
r AS (SELECT b AS fold, 1 - sum((zy - t * q) ** 2) / (count(*) * var_pop(zy)) AS r2 FROM t JOIN q USING (b) WHERE NOT inside GROUP BY b)"""

#: k = 1 on the training rows of each set f, for y (b = -1) and y in 1000 random orders, seen on the other rows.
_PERMUTED = f"""WITH RECURSIVE {_BASE}, MEMBER, {_moved('perm', 1000)},
moved AS (SELECT b, perm.row_id, base.y FROM perm JOIN base ON base.row_id = source UNION ALL SELECT -1, row_id, y FROM base),
long AS (SELECT f, inside, base.row_id, unnest(range(0, 64)) AS feature, CAST(unnest(embedding) AS DOUBLE) AS x FROM base JOIN member USING (row_id)),
col AS (SELECT f, feature, avg(x) AS mean, stddev_pop(x) AS scale FROM long WHERE inside GROUP BY f, feature),
z AS (SELECT f, inside, row_id, feature, (x - mean) / scale AS z FROM long JOIN col USING (f, feature)),
resp AS (SELECT f, b, avg(y) AS my, stddev_pop(y) AS sy FROM moved JOIN member USING (row_id) WHERE inside GROUP BY f, b),
zy AS (SELECT f, b, row_id, inside, (y - my) / sy AS zy FROM moved JOIN member USING (row_id) JOIN resp USING (f, b)),
s AS (SELECT f, b, feature, sum(z * zy) AS s FROM z JOIN zy USING (f, row_id) WHERE zy.inside GROUP BY f, b, feature),
t AS (SELECT f, b, row_id, sum(z * s) AS t FROM z JOIN s USING (f, feature) GROUP BY f, b, row_id),
q AS (SELECT f, b, sum(t * zy) / sum(t * t) AS q FROM t JOIN zy USING (f, b, row_id) WHERE inside GROUP BY f, b)"""
_IN_FOLDS = f"{_ranked('fold', 1)}, cut AS (SELECT row_id, CAST({_FOLD} AS INTEGER) AS fold FROM drawn, (SELECT count(*) AS n FROM embeddings)), member AS (SELECT row_id, f, fold <> f AS inside FROM cut, (SELECT CAST(unnest(range(0, 5)) AS INTEGER) AS f))"
_IN_SPLITS = f"{_ranked('split', 50)}, member AS (SELECT row_id, b AS f, rank < {_HALF} AS inside FROM drawn)"
_FOLDED = f"""{_PERMUTED.replace('MEMBER', _IN_FOLDS)},
v AS (SELECT f, b, sum((zy - t * q) ** 2) AS res, count(*) * var_pop(zy) AS tot FROM t JOIN zy USING (f, b, row_id) JOIN q USING (f, b) WHERE NOT inside GROUP BY f, b),
r AS (SELECT b, 1 - sum(res) / sum(tot) AS r2 FROM v GROUP BY b)"""
#: Mean Fisher z over 50 halves, for y (b = -1) and y in 1000 random orders.
_EXACT = f"""WITH RECURSIVE {_BASE}, {_IN_SPLITS}, {_moved('perm', 1000)},
moved AS (SELECT b, perm.row_id, base.y FROM perm JOIN base ON base.row_id = source UNION ALL SELECT -1, row_id, y FROM base),
long AS (SELECT f, inside, base.row_id, unnest(range(0, 64)) AS feature, CAST(unnest(embedding) AS DOUBLE) AS x FROM base JOIN member USING (row_id)),
col AS (SELECT f, feature, avg(x) AS mean, stddev_pop(x) AS scale FROM long WHERE inside GROUP BY f, feature),
z AS (SELECT f, inside, row_id, feature, (x - mean) / scale AS z FROM long JOIN col USING (f, feature)),
zl AS (SELECT f, feature, list(z ORDER BY row_id) AS zs FROM z WHERE inside GROUP BY f, feature),
yl AS (SELECT f, b, list(y ORDER BY row_id) AS ys FROM moved JOIN member USING (row_id) WHERE inside GROUP BY f, b),
s AS (SELECT f, b, list(list_dot_product(zs, ys) ORDER BY feature) AS s FROM zl JOIN yl USING (f) GROUP BY f, b),
xl AS (SELECT f, row_id, list(z ORDER BY feature) AS xs FROM z WHERE NOT inside GROUP BY f, row_id),
t AS (SELECT f, b, row_id, list_dot_product(xs, s) AS t FROM xl JOIN s USING (f)),
r AS (SELECT f, b, greatest(least(corr(t, y), 0.9999), -0.9999) AS r FROM t JOIN moved USING (b, row_id) GROUP BY f, b),
m AS (SELECT b, avg(atanh(r)) AS z FROM r GROUP BY b)"""
_MOVED, _SIMULATED = _moved("perm", 1000), _moved("simulated", 1200)


def _pooled(ctes: str, table: str, method: str, statistic: str) -> str:
    """p of simulations 0 to 199 among the 1000 that follow."""
    over = f"(sum(CASE WHEN other.{statistic} >= own.{statistic} THEN 1 ELSE 0 END) + 1) / 1001"
    return f"{ctes.replace(_MOVED, _SIMULATED)} SELECT '{method}' AS method, own.b AS simulation, {_R(over, 'pvalue')} FROM {table} own JOIN {table} other ON own.b BETWEEN 0 AND 199 AND other.b >= 200 GROUP BY own.b"


def _components(z: str, k: int, by: str = "b") -> str:
    """z1 to z{k + 1}: rows (by, inside, row_id, feature, z, zy) of z without their first components, fitted to the rows inside; q1 to qk."""
    out = [f"z1 AS (SELECT {by}, inside, row_id, feature, z, zy FROM {z})"]
    for a in range(1, k + 1):
        out.append(f"""s{a} AS (SELECT {by}, feature, sum(z * zy) AS s FROM z{a} WHERE inside GROUP BY {by}, feature),
w{a} AS (SELECT {by}, feature, s / sqrt(sum(s * s) OVER (PARTITION BY {by})) AS v FROM s{a}),
t{a} AS (SELECT {by}, inside, row_id, any_value(zy) AS zy, sum(z * v) AS t FROM z{a} JOIN w{a} USING ({by}, feature) GROUP BY {by}, inside, row_id),
q{a} AS (SELECT {by}, sum(t * zy) / sum(t * t) AS q, sum(t * t) AS tt FROM t{a} WHERE inside GROUP BY {by}),
p{a} AS (SELECT {by}, feature, sum(z * t) / any_value(tt) AS p FROM z{a} JOIN t{a} USING ({by}, row_id) JOIN q{a} USING ({by}) WHERE z{a}.inside GROUP BY {by}, feature),
z{a + 1} AS (SELECT {by}, z{a}.inside, row_id, feature, z - t * p AS z, z{a}.zy - t * q AS zy FROM z{a} JOIN t{a} USING ({by}, row_id) JOIN p{a} USING ({by}, feature) JOIN q{a} USING ({by}))""")
    return ",\n".join(out)


#: Trace and largest eigenvalue of the Gram matrix, by power iteration.
_RANK = f"""{_PLAIN}, gm AS (SELECT a.feature AS i, b.feature AS j, sum(a.z * b.z) AS g FROM z a JOIN z b USING (row_id) GROUP BY 1, 2),
gl AS (SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(g ORDER BY j) AS r FROM gm GROUP BY i)),
power AS (SELECT 0 AS step, list_transform(range(64), lambda e: 1 / (1.0 + e)) AS v
  UNION ALL SELECT step + 1, list_transform(u, lambda e: e / sqrt(list_dot_product(u, u))) FROM (SELECT step, list_transform(m, lambda r: list_dot_product(r, v)) AS u FROM power, gl WHERE step < 3000)),
rank AS (SELECT (SELECT sum(g) FROM gm WHERE i = j) / list_dot_product(v, list_transform(m, lambda r: list_dot_product(r, v))) AS stable_rank FROM power, gl WHERE step = 3000)"""
#: p of Student's t with 49 degrees of freedom.
_P49 = "(0.5 - (atan(t / 7) + sin(atan(t / 7)) * list_sum(list_transform(range(24), lambda j: coalesce(list_product(list_transform(range(1, j + 1), lambda i: 2.0 * i / (2 * i + 1))), 1) * cos(atan(t / 7)) ** (2 * j + 1)))) / pi())"


def _split_nb(h: int) -> str:
    """pv{h} (p, mean, var, n_test) of the split test with 50 splits by seed SEED + h of rows x{h} (row_id, feature, x, y)."""
    ranked = _ranked("split", 50).replace("drawn AS", f"drawn{h} AS").replace(f"'{SEED}'", f"'{SEED + h}'")
    return f"""{ranked}, m{h} AS (SELECT row_id, b, rank < {_HALF} AS inside FROM drawn{h}),
c{h} AS (SELECT b, feature, avg(x) AS mean, stddev_pop(x) AS scale FROM x{h} JOIN m{h} USING (row_id) WHERE inside GROUP BY b, feature),
n{h} AS (SELECT b, inside, row_id, feature, (x - mean) / scale AS z, y FROM x{h} JOIN m{h} USING (row_id) JOIN c{h} USING (b, feature)),
g{h} AS (SELECT b, feature, sum(z * y) AS s FROM n{h} WHERE inside GROUP BY b, feature),
r{h} AS (SELECT b, greatest(least(corr(t, y), 0.9999), -0.9999) AS r FROM (SELECT b, row_id, any_value(y) AS y, sum(z * s) AS t FROM n{h} JOIN g{h} USING (b, feature) WHERE NOT inside GROUP BY b, row_id) GROUP BY b),
f{h} AS (SELECT avg(atanh(r)) AS mean, var_samp(atanh(r)) AS var, {_HALF} AS n_train, {_N} - {_HALF} AS n_test FROM r{h}),
pv{h} AS (SELECT {_P49} AS p, mean, var, n_test FROM (SELECT *, mean / greatest(sqrt(var) * sqrt(1 / 50 + n_test / n_train), 1e-15) AS t FROM f{h}))"""


_LONG_X = "SELECT row_id, y, unnest(range(0, 64)) AS feature, CAST(unnest(embedding) AS DOUBLE) AS x FROM base"
_SPLIT20 = _SPLIT.replace("range(0, 4)", "range(0, 20)")
_BLANK = f"CAST({SEED} AS BIGINT) AS seed"

ORACLES = {
    "stable_rank": f"WITH RECURSIVE {_RANK} SELECT stable_rank < 3 OR {_N} < 25 AS fires, {_R('stable_rank', 'stable_rank')}, CAST({_N} AS DOUBLE) AS n_eff FROM rank",
    "find_k_optimal": f"""{_FOLD_HALVES}, {_components('z', 4)},
tot AS (SELECT b, count(*) * var_pop(zy) AS tot FROM t1 WHERE NOT inside GROUP BY b),
r AS (""" + " UNION ALL ".join(f"SELECT {k} AS k, b, 1 - sum((t{k}.zy - t * q) ** 2) / any_value(tot) AS r2 FROM t{k} JOIN q{k} USING (b) JOIN tot USING (b) WHERE NOT inside GROUP BY b" for k in range(1, 5)) + f"""),
f AS (SELECT k, avg(r2) AS r2, stddev_samp(r2) / sqrt(count(*)) AS se FROM r GROUP BY k),
best AS (SELECT r2 - se AS least FROM f ORDER BY r2 DESC, k DESC LIMIT 1)
SELECT CAST(k AS BIGINT) AS k, {_R('r2', 'r2')}, {_R('se', 'se')}, k = (SELECT min(k) FROM f, best WHERE r2 >= least) AS chosen FROM f""",
    "find_k_sequence": f"""WITH {_PLAIN}, whole AS (SELECT 0 AS b, true AS inside, row_id, feature, z, zy FROM z), {_components('whole', 2)},
""" + ",\n".join(f"x{h} AS (SELECT row_id, feature, z AS x, zy AS y FROM z{h}), {_split_nb(h)}" for h in (1, 2, 3)) + f""",
p AS (""" + " UNION ALL ".join(f"SELECT {h} AS k, p FROM pv{h}" for h in (1, 2, 3)) + f"""),
star AS (SELECT coalesce(min(k) - 1, 3) AS star FROM p WHERE p >= 0.05)
SELECT CAST(k AS BIGINT) AS k, CASE WHEN k <= star + 1 THEN {_R('p', 'x').removesuffix(' AS x')} ELSE 'NaN'::DOUBLE END AS pvalue, k = star AS chosen FROM p, star""",
    "test_split_nb": f"""WITH RECURSIVE {_RANK}, x0 AS (SELECT row_id, feature, x, y FROM long), {_split_nb(0)}
SELECT {_R('p', 'pvalue')}, {_R('tanh(mean)', 'statistic')}, 'split_nb' AS method, CAST(1 AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS n_perm, CAST(50 AS BIGINT) AS n_splits, {_BLANK},
  {_R('least(greatest(1 - var * (n_test - 3), 0), 1)', 'rho_hat')}, {_R('stable_rank', 'stable_rank')}, CAST({_N} AS DOUBLE) AS n_eff, CAST(NULL AS VARCHAR) AS ci FROM pv0, rank""",
    "test_score": f"""WITH RECURSIVE {_PLAIN}, {_S}, g AS (SELECT sum(a.z * b.z) AS g, a.feature AS i, b.feature AS j FROM z a JOIN z b USING (row_id) GROUP BY 2, 3),
l AS (SELECT sum(CASE WHEN i = j THEN g ELSE 0 END) AS s1, sum(g * g) AS s2 FROM g),
o AS (SELECT (SELECT sum(s * s) FROM s) AS t, s1 * s1 / s2 / 2 AS a, (SELECT sum(s * s) FROM s) * s1 / s2 / 2 AS x FROM l),
series AS (SELECT 0 AS i, 1 / a AS term, 1 / a AS total FROM o UNION ALL SELECT i + 1, term * x / (a + i + 1), total + term * x / (a + i + 1) FROM series, o WHERE i < 5000 AND term > 0)
SELECT {_R('greatest(0, 1 - exp(a * ln(x) - x - lgamma(a)) * total)', 'pvalue')}, round(t, 3) AS statistic, 'score' AS method, CAST(1 AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS n_perm, CAST(NULL AS VARCHAR) AS n_splits, {_BLANK},
  CAST(NULL AS VARCHAR) AS rho_hat, CAST(NULL AS VARCHAR) AS stable_rank, CAST({_N} AS DOUBLE) AS n_eff, CAST(NULL AS VARCHAR) AS ci FROM o, (SELECT max(total) AS total FROM series)""",
    "split_r_weighted": f"""WITH base AS (SELECT vec_id AS row_id, embedding, {_Y.format(2, 3)} AS y, 0.5 + (vec_id % 7) / 4.0 AS w FROM embeddings), {_ranked('split', 20)}, member AS (SELECT row_id, b, rank < {_HALF} AS inside FROM drawn),
long AS (SELECT b, inside, base.row_id, y, w, unnest(range(0, 64)) AS feature, CAST(unnest(embedding) AS DOUBLE) AS x FROM base JOIN member USING (row_id)),
col AS (SELECT b, feature, sum(w * x) / sum(w) AS mean, sqrt(sum(w * x * x) / sum(w) - (sum(w * x) / sum(w)) ** 2) AS scale FROM long WHERE inside GROUP BY b, feature),
z AS (SELECT b, inside, row_id, feature, w, y, (x - mean) / scale AS z FROM long JOIN col USING (b, feature)),
s AS (SELECT b, feature, sum(w * z * y) AS s FROM z WHERE inside GROUP BY b, feature),
t AS (SELECT b, row_id, any_value(w) AS w, any_value(y) AS y, sum(z * s) AS t FROM z JOIN s USING (b, feature) WHERE NOT inside GROUP BY b, row_id)
SELECT b, {_R('corr(sqrt(w) * t, sqrt(w) * y)', 'r')} FROM t GROUP BY b""",
    "split_r_k2": f"{_SPLIT20}, {_components('z', 2)}, d AS (SELECT b, row_id, any_value(z1.zy) AS y, any_value(z1.zy - z3.zy) AS t FROM z1 JOIN z3 USING (b, row_id, feature) WHERE NOT z1.inside GROUP BY b, row_id) SELECT b, {_R('corr(t, y)', 'r')} FROM d GROUP BY b",
    "split_r_sparse": _SPLIT20.replace("s AS (SELECT b, feature, sum(z * zy) AS s FROM z WHERE inside GROUP BY b, feature)", "s0 AS (SELECT b, feature, sum(z * zy) AS s FROM z WHERE inside GROUP BY b, feature), s AS (SELECT b, feature, CASE WHEN row_number() OVER (PARTITION BY b ORDER BY abs(s) DESC, feature) <= 8 THEN s ELSE 0 END AS s FROM s0)")
    + f" SELECT b, {_R('corr(t, zy)', 'r')} FROM t WHERE NOT inside GROUP BY b",
    "ci_holdout": f"""WITH {_BASE}, {_ranked('subsample', 1000)}, m AS (SELECT ceil({_N} ** 0.7) AS m, {_N} AS n), member AS (SELECT row_id, b, rank < m AS inside FROM drawn, m), {_HALVES},
r AS (SELECT b, corr(t, zy) AS r FROM t WHERE NOT inside GROUP BY b),
i AS (SELECT avg(r) AS point, sqrt((1 / count(*) + any_value((n - m) / m)) * var_samp(atanh(r))) AS se FROM r, m)
SELECT {_R('point', 'point')}, {_R('tanh(atanh(point) - 1.959963984540054 * se)', 'lower')}, {_R('tanh(atanh(point) + 1.959963984540054 * se)', 'upper')}, {_R('se', 'se')} FROM i""",
    "standardize": f"WITH {_WEIGHTED} SELECT row_id, CAST(feature AS INTEGER) AS feature, {_R('z', 'value')} FROM z",
    "column_moments": f"WITH {_WEIGHTED} SELECT CAST(feature AS INTEGER) AS feature, {_R('mean', 'mean')}, {_R('scale', 'scale')} FROM col",
    "kish_n_eff": f"SELECT {_R('sum(w) ** 2 / sum(w * w)', 'n_eff')} FROM (SELECT 0.5 + (vec_id % 7) / 4.0 AS w FROM embeddings)",
    "gram": f"WITH {_PLAIN} SELECT CAST(a.feature AS INTEGER) AS i, CAST(b.feature AS INTEGER) AS j, {_R('sum(a.z * b.z)', 'value', 5)} FROM z a JOIN z b ON a.row_id = b.row_id AND a.feature <= b.feature GROUP BY 1, 2",
    "cross_moment": f"WITH {_WEIGHTED}, {_S} SELECT CAST(feature AS INTEGER) AS feature, {_R('s', 'value')} FROM s",
    "lineitem_gram": "WITH l AS (SELECT CAST(l_quantity AS DOUBLE) AS q, CAST(l_discount AS DOUBLE) AS d, CAST(l_tax AS DOUBLE) AS t, CAST(l_extendedprice AS DOUBLE) AS p FROM lineitem) "
    + " UNION ALL ".join(f"SELECT {i} AS feature, {_R(f'corr({c}, p)', 'corr_y')}, {_R(f'corr({c}, q)', 'corr_first')} FROM l" for i, c in enumerate("qdt")),
    "pls1_k1_coef": f"WITH {_PLAIN}, {_K1} SELECT CAST(feature AS INTEGER) AS feature, {_R('v * q', 'coef')}, {_R('v * q * sy / scale', 'beta')} FROM w1 JOIN col USING (feature), q1, resp",
    "pls1_k1_predict": f"WITH {_PLAIN}, {_K1} SELECT row_id, {_R('my + sy * q * t', 'prediction')} FROM t1, q1, resp",
    "pls1_k2_coef": f"WITH {_PLAIN}, {_K2} SELECT CAST(feature AS INTEGER) AS feature, {_R('coef', 'coef')} FROM coef2",
    "pls1_weighted_k1_coef": f"WITH {_WEIGHTED}, {_K1} SELECT CAST(feature AS INTEGER) AS feature, {_R('v * q', 'coef')} FROM w1, q1",
    "spls1_topk": f"WITH {_PLAIN}, {_S.replace('s AS', 's0 AS', 1)}, s AS (SELECT feature, CASE WHEN row_number() OVER (ORDER BY abs(s) DESC, feature) <= 8 THEN s ELSE 0 END AS s FROM s0), {_K1.removeprefix(_S + ',')} SELECT CAST(feature AS INTEGER) AS feature, {_R('v * q', 'coef')} FROM w1, q1",
    "scores_k1": f"WITH {_PLAIN}, {_K1} SELECT row_id, {_R('t', 'score')} FROM t1",
    "deflated_y": f"WITH {_PLAIN}, {_K1} SELECT row_id, {_R('zy - t * q', 'y')} FROM t1, q1",
    "leverage_k1": f"WITH {_PLAIN}, {_K1} SELECT CAST(feature AS INTEGER) AS feature, {_R('v * v', 'leverage')} FROM w1",
    "score_stat": f"WITH {_PLAIN}, {_S}, g AS (SELECT sum(a.z * b.z) AS g, a.feature AS i, b.feature AS j FROM z a JOIN z b USING (row_id) GROUP BY 2, 3), l AS (SELECT sum(CASE WHEN i = j THEN g ELSE 0 END) AS s1, sum(g * g) AS s2 FROM g) SELECT {_R('(SELECT sum(s * s) FROM s)', 'statistic', 4)}, {_R('s2 / s1', 'scale', 4)}, {_R('s1 * s1 / s2', 'df', 4)} FROM l",
    "bic_by_k": f"WITH {_PLAIN}, {_K2}, ssr AS (SELECT 1 AS k, sum((zy - t * q) ** 2) AS ssr, count(*) AS n FROM t1, q1 UNION ALL SELECT 2, sum((t2.zy - t2.t * q2.q) ** 2), count(*) FROM t2, q2) SELECT k, {_R('n * ln(ssr / n) + k * ln(n)', 'bic')} FROM ssr",
    "fold_assign": f"WITH {_ranked('fold', 1)} SELECT row_id, CAST({_FOLD} AS INTEGER) AS fold FROM drawn, (SELECT count(*) AS n FROM embeddings)",
    "split_assign": f"WITH {_ranked('split', 4)} SELECT row_id, b, rank < {_HALF} AS train FROM drawn",
    "permute_rows": f"WITH {_ranked('perm', 2)} SELECT row_id, b, CAST(rank AS BIGINT) AS place FROM drawn",
    "subsample_assign": f"WITH {_ranked('subsample', 3)} SELECT b, row_id FROM drawn WHERE rank < ceil({_N} ** 0.7)",
    "split_r": f"{_SPLIT} SELECT b, {_R('corr(t, zy)', 'r')} FROM t WHERE NOT inside GROUP BY b",
    "mean_fisher_z": f"{_SPLIT}, r AS (SELECT b, greatest(least(corr(t, zy), 0.9999), -0.9999) AS r FROM t WHERE NOT inside GROUP BY b) SELECT {_R('avg(atanh(r))', 'z')} FROM r",
    "cv_r2": f"{_FOLDS} SELECT fold, {_R('r2', 'r2')} FROM r",
    "cv_mean_se": f"{_FOLDS} SELECT {_R('avg(r2)', 'mean')}, {_R('stddev_samp(r2) / sqrt(count(*))', 'se')} FROM r",
    "quantile7": f"WITH {_BASE} SELECT " + ", ".join(_R(f"quantile_cont(y, {q})", f"q{i}") for i, q in enumerate((0.025, 0.25, 0.5, 0.975))) + " FROM base",
    "sign_z": f"{_SPLIT}, whole AS (SELECT y, unnest(range(0, 64)) AS feature, CAST(unnest(embedding) AS DOUBLE) AS x FROM base), ref AS (SELECT feature, covar_pop(x, y) AS r FROM whole GROUP BY feature) SELECT CAST(feature AS INTEGER) AS feature, {_R('(2 * avg(CASE WHEN sign(s) = sign(r) THEN 1.0 ELSE 0.0 END) - 1) * sqrt(count(*))', 'z')} FROM s JOIN ref USING (feature) GROUP BY feature",
    "perm_cross": f"WITH RECURSIVE {_BASE}, {_moved('perm', 20)}, moved AS (SELECT perm.row_id, b, base.y FROM perm JOIN base ON base.row_id = source), c AS (SELECT b, corr(CAST(embedding[1] AS DOUBLE), moved.y) AS c FROM moved JOIN base USING (row_id) GROUP BY b), o AS (SELECT corr(CAST(embedding[1] AS DOUBLE), y) AS c FROM base) SELECT {_R('any_value(o.c)', 'observed')}, {_R('(sum(CASE WHEN c.c >= o.c THEN 1 ELSE 0 END) + 1) / 21', 'p')} FROM c, o",
    "pls1_perm_null": f"""WITH RECURSIVE {_PLAIN}, {_moved('null', 1000)},
ys AS (SELECT DISTINCT row_id, zy FROM z),
moved AS (SELECT b, perm.row_id, ys.zy FROM perm JOIN ys ON ys.row_id = source UNION ALL SELECT -1, row_id, zy FROM ys),
s AS (SELECT b, feature, sum(z.z * moved.zy) AS s FROM moved JOIN z USING (row_id) GROUP BY b, feature),
t AS (SELECT b, row_id, sum(z.z * s) AS t FROM z JOIN s USING (feature) GROUP BY b, row_id),
q AS (SELECT b, sum(t * zy) / sum(t * t) AS q FROM t JOIN moved USING (b, row_id) GROUP BY b),
c AS (SELECT b, feature, s * q AS coef FROM s JOIN q USING (b)),
n AS (SELECT feature, max(CASE WHEN b < 0 THEN coef END) AS ref, avg(coef) FILTER (b >= 0) AS mean, stddev_samp(coef) FILTER (b >= 0) AS sd FROM c GROUP BY feature)
SELECT CAST(feature AS INTEGER) AS feature, {_R('ref', 'beta_ref')}, {_R('mean', 'beta_perm_mean')}, {_R('sd', 'beta_perm_sd')}, {_R('ref / sd', 'beta_perm_z')} FROM n""",
    "confirmatory_ci": f"""WITH {_BASE}, {_ranked('subsample', 1000)}, m AS (SELECT ceil({_N} ** 0.7) AS m, {_N} AS n),
member AS (SELECT row_id, b, rank < m AS inside FROM drawn, m UNION ALL SELECT vec_id, -1, true FROM embeddings), {_HALVES},
q AS (SELECT b, sum(t * zy) / sum(t * t) AS q FROM t WHERE inside GROUP BY b),
size AS (SELECT b, sum(s * s) AS ss FROM s GROUP BY b),
f AS (SELECT b, feature, s * q * sy / scale AS beta, s * s / ss AS lev FROM s JOIN q USING (b) JOIN size USING (b) JOIN col USING (b, feature) JOIN resp USING (b)),
ref AS (SELECT feature, beta AS rb, lev AS rl FROM f WHERE b < 0),
a AS (SELECT feature, rb, rl, count(*) AS n, sum(CASE WHEN sign(beta) = sign(rb) THEN 1.0 ELSE 0.0 END) / count(*) AS agree,
  quantile_cont(beta - rb, 0.025) AS b0, quantile_cont(beta - rb, 0.975) AS b1, stddev_samp(beta - rb) AS bs,
  quantile_cont(lev - rl, 0.025) AS l0, quantile_cont(lev - rl, 0.975) AS l1, stddev_samp(lev - rl) AS ls
  FROM f JOIN ref USING (feature) WHERE b >= 0 GROUP BY feature, rb, rl),
k AS (SELECT a.*, sqrt(m.m / m.n) AS c, (2 * agree - 1) * sqrt(a.n) AS z FROM a, m)
SELECT CAST(feature AS INTEGER) AS feature, {_R('rb', 'beta_ref')}, {_R('rl', 'leverage_ref')}, {_R('z', 'beta_sign_z')}, {_R('sign(rb) * abs(z)', 'beta_sign_z_signed')},
  {_R('rl - c * l1', 'leverage_ci_lower')}, {_R('rl - c * l0', 'leverage_ci_upper')}, {_R('c * ls', 'leverage_ci_se')}, {_R('rb - c * b1', 'beta_ci_lower')}, {_R('rb - c * b0', 'beta_ci_upper')}, {_R('c * bs', 'beta_ci_se')} FROM k""",
    "find_keep_optimal": f"""{_FOLD_HALVES},
grid AS (SELECT unnest([1, 2, 4, 8, 16, 32, 64]) AS keep),
sk AS (SELECT b, feature, keep, CASE WHEN row_number() OVER (PARTITION BY b, keep ORDER BY abs(s) DESC, feature) <= keep THEN s ELSE 0 END AS s FROM s, grid),
tk AS (SELECT b, inside, row_id, keep, any_value(zy) AS zy, sum(z * sk.s) AS t FROM z JOIN sk USING (b, feature) GROUP BY b, inside, row_id, keep),
q AS (SELECT b, keep, sum(t * zy) / sum(t * t) AS q FROM tk WHERE inside GROUP BY b, keep),
r AS (SELECT b, keep, 1 - sum((zy - t * q) ** 2) / (count(*) * var_pop(zy)) AS r2 FROM tk JOIN q USING (b, keep) WHERE NOT inside GROUP BY b, keep),
f AS (SELECT keep, avg(r2) AS r2, stddev_samp(r2) / sqrt(count(*)) AS se FROM r GROUP BY keep),
best AS (SELECT r2 - se AS least FROM f ORDER BY r2 DESC, keep DESC LIMIT 1)
SELECT CAST(keep AS INTEGER) AS keep, {_R('r2', 'r2')}, {_R('se', 'se')}, keep = (SELECT min(keep) FROM f, best WHERE r2 >= least) AS chosen FROM f""",
    "test_raw_perm": f"""{_FOLDED},
o AS (SELECT r2 AS o FROM r WHERE b < 0)
SELECT {_R('(sum(CASE WHEN r2 >= o THEN 1 ELSE 0 END) + 1) / 1001', 'pvalue')}, {_R('any_value(o)', 'statistic')}, 'raw_perm' AS method, CAST(1 AS BIGINT) AS k, CAST(1000 AS BIGINT) AS n_perm,
  CAST(NULL AS VARCHAR) AS n_splits, CAST({SEED} AS BIGINT) AS seed, CAST(NULL AS VARCHAR) AS rho_hat, CAST(NULL AS VARCHAR) AS stable_rank, CAST({_N} AS DOUBLE) AS n_eff, CAST(NULL AS VARCHAR) AS ci FROM r, o WHERE b >= 0""",
    "test_split_exact": f"""{_EXACT},
o AS (SELECT z AS o FROM m WHERE b < 0)
SELECT {_R('(sum(CASE WHEN z >= o THEN 1 ELSE 0 END) + 1) / 1001', 'pvalue')}, {_R('tanh(any_value(o))', 'statistic')}, 'split_exact' AS method, CAST(1 AS BIGINT) AS k, CAST(1000 AS BIGINT) AS n_perm,
  CAST(50 AS BIGINT) AS n_splits, CAST({SEED} AS BIGINT) AS seed, CAST(NULL AS VARCHAR) AS rho_hat, CAST(NULL AS VARCHAR) AS stable_rank, CAST({_N} AS DOUBLE) AS n_eff, CAST(NULL AS VARCHAR) AS ci FROM m, o WHERE b >= 0""",
    "test_e": f"""WITH {_BASE}, {_ranked('split', 1)}, member AS (SELECT row_id, b, rank < {_HALF} AS inside FROM drawn), {_HALVES},
q AS (SELECT sum(t * zy) / sum(t * t) AS q FROM t WHERE inside),
alt AS (SELECT sum((zy - t * q) ** 2) / count(*) AS var FROM t, q WHERE inside),
te AS (SELECT count(*) AS n, sum((zy - t * q) ** 2) AS res, var_pop(zy) AS null_var FROM t, q WHERE NOT inside),
e AS (SELECT (-0.5 * n * ln(2 * pi() * var) - 0.5 * res / var) - (-0.5 * n * ln(2 * pi() * null_var) - 0.5 * n) AS e FROM te, alt)
SELECT {_R('least(1, exp(-greatest(e, 0)))', 'pvalue')}, {_R('e', 'statistic')}, 'e' AS method, CAST(1 AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS n_perm, CAST(NULL AS VARCHAR) AS n_splits, CAST({SEED} AS BIGINT) AS seed,
  CAST(NULL AS VARCHAR) AS rho_hat, CAST(NULL AS VARCHAR) AS stable_rank, CAST({_N} AS DOUBLE) AS n_eff, CAST(NULL AS VARCHAR) AS ci FROM e""",
    "calibrate_raw_perm": _pooled(_FOLDED, "r", "raw_perm", "r2"),
    "calibrate_split_exact": _pooled(_EXACT, "m", "split_exact", "z"),
    "calibrate_score_split_nb_e": f"""WITH RECURSIVE {_PLAIN}, {_IN_SPLITS}, {_moved('simulated', 200)},
sim AS (SELECT b, perm.row_id, base.y FROM perm JOIN base ON base.row_id = source),
g AS (SELECT sum(a.z * b.z) AS g, a.feature AS i, b.feature AS j FROM z a JOIN z b USING (row_id) GROUP BY 2, 3),
l AS (SELECT sum(CASE WHEN i = j THEN g ELSE 0 END) AS s1, sum(g * g) AS s2 FROM g),
zf AS (SELECT feature, list(z ORDER BY row_id) AS zs FROM z GROUP BY feature),
yf AS (SELECT b, list((y - my) / sy ORDER BY row_id) AS ys FROM sim, resp GROUP BY b),
o AS (SELECT b, any_value(s1 * s1 / s2 / 2) AS a, sum(list_dot_product(zs, ys) ** 2) * any_value(s1 / s2 / 2) AS x FROM zf, yf, l GROUP BY b),
series AS (SELECT b, a, x, 0 AS i, 1 / a AS term, 1 / a AS total FROM o UNION ALL SELECT b, a, x, i + 1, term * x / (a + i + 1), total + term * x / (a + i + 1) FROM series WHERE term > total * 1e-18),
score AS (SELECT b, greatest(0, 1 - exp(a * ln(x) - x - lgamma(a)) * max(total)) AS p FROM series GROUP BY b, a, x),
hl AS (SELECT f, inside, base.row_id, unnest(range(0, 64)) AS feature, CAST(unnest(embedding) AS DOUBLE) AS x FROM base JOIN member USING (row_id)),
hc AS (SELECT f, feature, avg(x) AS mean, stddev_pop(x) AS scale FROM hl WHERE inside GROUP BY f, feature),
hz AS (SELECT f, inside, row_id, feature, (x - mean) / scale AS z FROM hl JOIN hc USING (f, feature)),
zl AS (SELECT f, feature, list(z ORDER BY row_id) AS zs FROM hz WHERE inside GROUP BY f, feature),
yl AS (SELECT f, b, list(y ORDER BY row_id) AS ys FROM sim JOIN member USING (row_id) WHERE inside GROUP BY f, b),
s AS (SELECT f, b, list(list_dot_product(zs, ys) ORDER BY feature) AS s FROM zl JOIN yl USING (f) GROUP BY f, b),
xl AS (SELECT f, inside, row_id, list(z ORDER BY feature) AS xs FROM hz GROUP BY f, inside, row_id),
t AS (SELECT f, b, inside, row_id, list_dot_product(xs, s) AS t FROM xl JOIN s USING (f) WHERE f = 0 OR NOT inside),
r AS (SELECT f, b, greatest(least(corr(t, y), 0.9999), -0.9999) AS r FROM t JOIN sim USING (b, row_id) WHERE NOT inside GROUP BY f, b),
nb AS (SELECT b, {_P49} AS p FROM (SELECT b, avg(atanh(r)) / greatest(stddev_samp(atanh(r)) * sqrt(1 / 50 + ({_N} - {_HALF}) / {_HALF}), 1e-15) AS t FROM r GROUP BY b)),
hy AS (SELECT b, avg(y) AS my, stddev_pop(y) AS sy FROM sim JOIN member USING (row_id) WHERE f = 0 AND inside GROUP BY b),
e0 AS (SELECT b, inside, t, (y - my) / sy AS zy FROM t JOIN sim USING (b, row_id) JOIN hy USING (b) WHERE f = 0),
q AS (SELECT b, sum(t * zy) / sum(t * t) AS q FROM e0 WHERE inside GROUP BY b),
alt AS (SELECT b, sum((zy - t * q) ** 2) / count(*) AS var FROM e0 JOIN q USING (b) WHERE inside GROUP BY b),
te AS (SELECT b, count(*) AS n, sum((zy - t * q) ** 2) AS res, var_pop(zy) AS null_var FROM e0 JOIN q USING (b) WHERE NOT inside GROUP BY b),
e AS (SELECT b, (-0.5 * n * ln(2 * pi() * var) - 0.5 * res / var) - (-0.5 * n * ln(2 * pi() * null_var) - 0.5 * n) AS e FROM te JOIN alt USING (b))
SELECT 'score' AS method, CAST(b AS INTEGER) AS simulation, {_R('p', 'pvalue')} FROM score UNION ALL SELECT 'split_nb', CAST(b AS INTEGER), {_R('p', 'pvalue')} FROM nb UNION ALL SELECT 'e', CAST(b AS INTEGER), {_R('least(1, exp(-greatest(e, 0)))', 'pvalue')} FROM e""",
}

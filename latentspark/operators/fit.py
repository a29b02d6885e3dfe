"""Standardisation, fits, prediction and rotation of a model."""

from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latentspark.errors import AlreadyRotated, DimensionMismatch, InvalidArgs, InvalidArgument, InvalidInput, InvalidWeights, KExceedsMax, RotationMethodNotImplemented
from latentspark.functions import kernels
from latentspark.operators import moments, wide
from latentspark.operators.rowwise import matrix, row_fit
from latentspark.results import Pls1Model, PreprocessResult, RotateResult, RotationSpec
from latentspark.sources.frame import WEIGHT, Frame, X, Y


#: More features than this are fitted over rows; components whose share of the variance is below NEAR are, too.
MANY, NEAR = 2000, 1e-8


def check_k(info: dict, frame: Frame, k: int, keep: int | None = None, rows: float | None = None) -> None:
    """k within the features and the effective rows; keep within the features."""
    if k < 1:
        raise InvalidArgument("k must be 1 at least")
    if k > frame.d:
        raise KExceedsMax(f"k={k} exceeds the {frame.d} features")
    if keep is not None and not 1 <= keep <= frame.d:
        raise InvalidArgument(f"keep must be from 1 to {frame.d}")
    if (rows if rows is not None else info["n_eff"]) < k + 1:
        message = f"effectively {info['n_eff']:.3g} rows are too few for k={k}"
        raise InvalidWeights(message, "insufficient_effective_n") if frame.weighted else InvalidArgument(message)


def centre_of(info: dict, pre_standardized: bool) -> np.ndarray:
    return np.zeros_like(info["centre"]) if pre_standardized else info["centre"]


def preprocess(frame: Frame) -> PreprocessResult:
    """Rows with x and y standardised by weighted means and standard deviations (divisor n), and weights of mean 1.

    Two scans: one validates and finds the centre, one sums; the rows themselves are a lazy projection."""
    info = moments.validate(frame)
    if frame.d > MANY:
        s = wide.standards(frame, None, [0], range(frame.q))[0]
        x_mean, y_mean, x_scale, y_scale = s.mean, s.y_mean, s.scale, s.y_scale
    else:
        s = moments.standard(moments.total(frame, info["centre"]))
        mean = np.concatenate([s.x_mean, s.y_mean]) + info["centre"]
        x_mean, y_mean, x_scale, y_scale = mean[: frame.d], mean[frame.d :], s.x_scale, s.y_scale
    rows = frame.rows.withColumns({X: _scaled(X, x_mean, x_scale), Y: _scaled(Y, y_mean, y_scale)})
    if frame.weighted:
        rows = rows.withColumn(WEIGHT, F.col(WEIGHT) * (info["n"] / info["sw"]))
    return PreprocessResult(rows, x_mean, x_scale, y_mean, y_scale, info["n_eff"] if frame.weighted else None)


def _array(values: np.ndarray) -> Column:
    return F.lit([float(v) for v in values]) if len(values) else F.array().cast("array<double>")


def _scaled(column: str, mean: np.ndarray, scale: np.ndarray) -> Column:
    centred = F.zip_with(F.col(column), _array(mean), lambda a, b: a - b)
    return F.zip_with(centred, _array(scale), lambda a, b: a / b)


def fit_moments(m: moments.Moments, centre: np.ndarray, k: int, keep: int | None, pre_standardized: bool = False) -> tuple[Pls1Model, moments.Standard]:
    s = moments.standard(m, pre_standardized)
    f = kernels.pls1(s.gram, s.cross[:, 0], k, keep)
    d = len(f.coef)
    beta = f.coef if pre_standardized else f.coef * s.y_scale[0] / s.x_scale
    x_mean = s.x_mean + centre[:d]
    intercept = 0.0 if pre_standardized else float(s.y_mean[0] + centre[d] - beta @ x_mean)
    return Pls1Model(f.w, f.p, f.q, f.coef, beta, intercept, f.k_used, x_mean, s.x_scale, pre_standardized, keep=keep, least=f.least), s


def fit_rows(frame: Frame, k: int, keep: int | None, pre_standardized: bool) -> Pls1Model:
    """The fit without a matrix of all pairs of features: two passes a component."""
    f, x_mean, x_scale, y_mean, y_scale = row_fit(frame, k, keep, pre_standardized)
    beta = f.coef if pre_standardized else f.coef * y_scale / x_scale
    intercept = 0.0 if pre_standardized else y_mean - float(beta @ x_mean)
    return Pls1Model(f.w, f.p, f.q, f.coef, beta, intercept, f.k_used, x_mean, x_scale, pre_standardized, keep=keep)


def near(f, k: int) -> bool:
    """Nearly collinear features, or too few components: rows keep the digits that moments lose."""
    return f.least < NEAR or f.k_used < k


def fitted(frame: Frame, info: dict, k: int, keep: int | None = None, pre_standardized: bool = False) -> Pls1Model:
    """The fit by moments, or over rows where features are many or nearly collinear."""
    if frame.d <= MANY:
        centre = centre_of(info, pre_standardized)
        model, _ = fit_moments(moments.total(frame, centre), centre, k, keep, pre_standardized)
        if not near(model, k):
            return model
    return fit_rows(frame, k, keep, pre_standardized)


def pls1_fit(frame: Frame, k=1, *, k_max: int | None = None, find_k_args: dict | None = None, pre_standardized: bool = False, seed: int | None = None, keep: int | None = None) -> Pls1Model:
    """k: a number of components, or "optimal" or "sequence" to have it found (k_max, find_k_args, seed)."""
    selection = None
    if isinstance(k, str):
        from latentspark.operators.selection import resolve_k

        k, selection = resolve_k(frame, k, k_max, find_k_args, seed, keep)
    info = moments.validate(frame)
    check_k(info, frame, k, keep)
    model = fitted(frame, info, k, keep, pre_standardized)
    if pre_standardized and model.k_used < k:
        raise InvalidInput(f"the data hold {model.k_used} of {k} components")
    return replace(model, weighted=frame.weighted and not info["uniform"], n_eff=info["n_eff"], selection_result=selection)


def spls1_fit(frame: Frame, k: int, keep: int, *, pre_standardized: bool = False) -> Pls1Model:
    """Each weight vector keeps its `keep` largest entries; keep = d is the dense fit."""
    return pls1_fit(frame, k, pre_standardized=pre_standardized, keep=keep)


def pls1_predict(model: Pls1Model, rows: DataFrame, features: list[str] | str = X, name: str = "prediction") -> DataFrame:
    """rows with the prediction as one more column: an expression over the feature columns, no shuffle."""
    columns = [features] if isinstance(features, str) else features
    if len(columns) > 1 or not rows.schema[columns[0]].dataType.typeName() == "array":
        if len(columns) != len(model.beta):
            raise DimensionMismatch(f"{len(columns)} features, the model has {len(model.beta)}")
        x = F.array(*[F.col(c).cast("double") for c in columns])
    else:
        x = F.col(columns[0])
    products = F.zip_with(x, _array(model.beta), lambda a, b: a.cast("double") * b)
    return rows.withColumn(name, F.aggregate(products, F.lit(0.0), lambda s, v: s + v) + F.lit(float(model.intercept)))


def project(frame: Frame, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, name: str = "scores") -> DataFrame:
    """row_id and an array of scores: standardised x times weights, in NumPy over Arrow batches."""

    def run(batches):
        for b in batches:
            t = ((matrix(b, X, len(mean)) - mean) / scale) @ weights
            ends = pa.array(np.arange(len(t) + 1) * t.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("row_id"), pa.ListArray.from_arrays(ends, pa.array(t.ravel()))], ["row_id", name])

    kind = frame.rows.schema["row_id"].dataType.simpleString()
    return frame.rows.select("row_id", X).mapInArrow(run, f"row_id {kind}, {name} array<double>")


def scores(model: Pls1Model, frame: Frame) -> DataFrame:
    """The rows' scores T (lazy), rotated if the model is."""
    r = kernels.score_weights(model.w, model.p)
    return project(frame, model.x_mean, model.x_scale, r)


VARIMAX = {"max_iter": 50, "tol": 1e-8, "kaiser_normalize": True}


def varimax_args(args: dict | None) -> dict:
    if unknown := set(args or {}) - set(VARIMAX):
        raise InvalidArgs(f"unknown arguments: {sorted(unknown)}")
    return VARIMAX | (args or {})


def rotate(target, *, method: str = "varimax", l: np.ndarray | None = None, args: dict | None = None):  # noqa: E741
    """Rotates a weight matrix (RotateResult) or a model (Pls1Model); l: loadings to simplify instead of the weights.

    A rotated model predicts as before: coef, beta and intercept stay."""
    if method != "varimax":
        raise RotationMethodNotImplemented(f"no rotation {method!r}")
    args = varimax_args(args)
    model = target if isinstance(target, Pls1Model) else None
    w = np.asarray(model.w if model else target, float)
    if model and model.rotation_spec is not None:
        raise AlreadyRotated("the model is rotated")
    if l is not None and np.shape(l)[1] != w.shape[1]:
        raise DimensionMismatch("loadings and weights differ in components")
    basis = w if l is None else np.asarray(l, float)
    if not np.isfinite(basis).all() or not np.isfinite(w).all():
        raise InvalidInput("not finite", code="non_finite_input")
    r, sweeps, value = kernels.varimax(basis, args["kaiser_normalize"], args["max_iter"], args["tol"])
    spec = RotationSpec(method, args, r, sweeps, value, l is not None)
    if model is None:
        return RotateResult(w @ r, spec)
    return replace(model, w=w @ r, p=model.p @ r, q=r.T @ model.q, rotation_spec=spec)

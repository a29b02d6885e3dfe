"""Results: small records, and DataFrames where there is a row for each feature, candidate or resample."""

from dataclasses import asdict, dataclass, field, fields, is_dataclass
from types import UnionType
from typing import get_args, get_origin, get_type_hints

import numpy as np
from pyspark.sql import DataFrame, SparkSession


class Record:
    def to_dict(self) -> dict:
        """Plain Python values, nested ones too; DataFrames are left out."""
        return {f.name: _plain(getattr(self, f.name)) for f in fields(self) if not isinstance(getattr(self, f.name), DataFrame)}

    def to_df(self, spark: SparkSession) -> DataFrame:
        """One row; values without a column type of their own are JSON."""
        import json

        row = {k: v if isinstance(v, int | float | str | bool) else None if v is None else json.dumps(v) for k, v in self.to_dict().items()}
        kinds = {int: "long", float: "double", bool: "boolean"}
        return spark.createDataFrame([tuple(row.values())], ", ".join(f"`{k}` {kinds.get(type(v), 'string')}" for k, v in row.items()))

    @classmethod
    def from_dict(cls, values: dict):
        """The record again, records inside it too; missing fields take their defaults, unknown names are left out."""
        kinds = get_type_hints(cls)
        return cls(**{f.name: _typed(values[f.name], kinds[f.name]) for f in fields(cls) if f.name in values})


def _typed(v, kind):
    """A plain value as the field's type has it: arrays, records and lists of records; all else stays."""
    options = get_args(kind) if isinstance(kind, UnionType) else (kind,)
    for option in options:
        if isinstance(v, dict) and isinstance(option, type) and issubclass(option, Record):
            return option.from_dict(v)
        if isinstance(v, list) and option is np.ndarray:
            return np.array(v, float)
        if isinstance(v, list) and get_origin(option) is list:
            return [_typed(x, get_args(option)[0]) for x in v]
    return v


def _plain(v):
    if isinstance(v, np.ndarray):
        return v.tolist()
    if isinstance(v, np.generic):
        return v.item()
    if isinstance(v, list | tuple):
        return [_plain(x) for x in v]
    if isinstance(v, dict):
        return {k: _plain(x) for k, x in v.items()}
    return {k: _plain(x) for k, x in asdict(v).items()} if is_dataclass(v) else v


@dataclass
class PreprocessResult(Record):
    rows: DataFrame
    x_mean: np.ndarray
    x_scale: np.ndarray
    y_mean: np.ndarray
    y_scale: np.ndarray
    n_eff: float | None


@dataclass
class RotationSpec(Record):
    method: str
    args: dict
    r: np.ndarray
    sweeps: int
    v_converged: float
    l_was_provided: bool


@dataclass
class RotateResult(Record):
    w_rot: np.ndarray
    spec: RotationSpec


@dataclass
class Pls1Model(Record):
    """w, p: feature x component; q, coef (standardised scale), beta and intercept (raw scale); x_mean and x_scale."""

    w: np.ndarray
    p: np.ndarray
    q: np.ndarray
    coef: np.ndarray
    beta: np.ndarray
    intercept: float
    k_used: int
    x_mean: np.ndarray
    x_scale: np.ndarray
    pre_standardized: bool = False
    weighted: bool = False
    n_eff: float | None = None
    keep: int | None = None
    rotation_spec: RotationSpec | None = None
    selection_result: object = None
    #: The smallest share of the data's variance that a component has.
    least: float = 1.0


@dataclass
class CIScalar(Record):
    point: float
    lower: float
    upper: float
    sd: float


@dataclass
class ConfirmatoryCI(Record):
    """per_feature: feature, leverage and beta with bounds, standard errors and sign statistics."""

    n_boot: int
    m: int
    m_rate: float
    level: float
    holdout_corr: CIScalar
    n_boot_finite: int
    n_boot_finite_holdout_corr: int
    per_feature: DataFrame = field(repr=False, default=None)


@dataclass
class ConfirmatoryTestResult(Record):
    pvalue: float
    statistic: float
    method: str
    k: int
    n_perm: int | None
    n_splits: int | None
    seed: int
    rho_hat: float | None
    stable_rank: float | None
    n_eff: float
    ci: ConfirmatoryCI | None = None


@dataclass
class FindKOptimalResult(Record):
    k_star: int
    selector: str
    cv_scores: dict | None
    cv_scores_se: dict | None
    bic_scores: dict | None
    pvalues: list | None
    diagnostic: str | None
    seed: int
    n_eff: float
    stable_rank: float | None = None


@dataclass
class FindKSequenceResult(Record):
    k_star: int
    pvalues: list
    test_method: str
    alpha: float
    seed: int
    n_eff: float
    stable_rank: float | None = None


@dataclass
class FindKeepOptimalResult(Record):
    keep_star: int
    k: int
    cv_scores: dict
    cv_scores_se: dict
    keep_grid: list
    seed: int
    n_eff: float


@dataclass
class SplitNbGateResult(Record):
    fires: bool
    stable_rank: float
    n_eff: float


@dataclass
class PermNullResult(Record):
    """per_feature: feature, beta_ref, beta_perm_mean, beta_perm_sd, beta_perm_z; perms: perm_id, beta (lazy)."""

    n_perm: int
    k: int
    seed: int
    n_eff: float
    per_feature: DataFrame = field(repr=False, default=None)
    perms: DataFrame | None = field(repr=False, default=None)


@dataclass
class RotationStabilityResult(Record):
    method: str
    n_boot: int
    m: int
    m_rate: float
    level: float
    seed: int
    variance_ratio: CIScalar
    variance_ratio_per_axis: list[CIScalar]
    variance_unrot: float
    variance_rot: float
    variance_unrot_per_axis: list
    variance_rot_per_axis: list
    degenerate_baseline: bool
    n_boot_finite: int
    n_eff: float


@dataclass
class CalibrationResult(Record):
    """rates: method, n_sim, rejected, rate, bound (alpha and three standard deviations of the rate), calibrated; p_values: method, simulation, pvalue."""

    alpha: float
    n_sim: int
    k: int
    seed: int
    n_eff: float
    rates: DataFrame = field(repr=False, default=None)
    p_values: DataFrame = field(repr=False, default=None)

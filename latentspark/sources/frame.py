"""The feature frame: a DataFrame with named roles."""

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latentspark.errors import DimensionMismatch, InvalidArgument

#: Columns of a prepared frame.
ID, X, Y, WEIGHT = "row_id", "x", "y", "w"


@dataclass(frozen=True)
class Frame:
    """rows: row_id, x array<double>, y array<double> (one or more responses) and w double where weighted.

    Only the named columns are read, so scans are pruned to them. d and q are known without a job."""

    rows: DataFrame
    d: int
    q: int
    weighted: bool

    def with_rows(self, rows: DataFrame, **changes) -> "Frame":
        return replace(self, rows=rows, **changes)


def _array(df: DataFrame, columns: list[str], size: int | None) -> tuple[Column, int]:
    if not columns:
        return F.array().cast("array<double>"), 0
    kinds = [df.schema[c].dataType for c in columns]
    if len(columns) == 1 and isinstance(kinds[0], T.ArrayType):
        if size is None:
            raise InvalidArgument("the length of an array column must be given", code="invalid_argument")
        return F.transform(F.col(columns[0]), lambda v: v.cast("double")), size
    for c, kind in zip(columns, kinds, strict=True):
        if not isinstance(kind, T.NumericType | T.BooleanType):
            raise InvalidArgument(f"{c} is not numeric")
    return F.array(*[F.col(c).cast("double") for c in columns]), len(columns)


def feature_frame(df: DataFrame, features: list[str] | str, y: list[str] | str | None = None, row_id: str = "row_id", weights: str | None = None, d: int | None = None) -> Frame:
    """features: numeric columns, or one array column with its length d; none: responses alone, for `preprocess`. y: response columns;
    none: no response.

    Values are cast to double. row_id must be unique for everything that resamples."""
    features = [features] if isinstance(features, str) else features
    responses = [] if y is None else [y] if isinstance(y, str) else y
    missing = [c for c in [*features, *responses, row_id, *([weights] if weights else [])] if c not in df.columns]
    if missing:
        raise DimensionMismatch(f"no such columns: {missing}")
    x, size = _array(df, features, d)
    columns = [F.col(row_id).alias(ID), x.alias(X), F.array(*[F.col(c).cast("double") for c in responses]).cast("array<double>").alias(Y)]
    if weights:
        columns.append(F.col(weights).cast("double").alias(WEIGHT))
    return Frame(df.select(*columns), size, len(responses), bool(weights))


def read_frame(spark, path: str, *args, **kwargs) -> Frame:
    """`feature_frame` over a Parquet path."""
    return feature_frame(spark.read.parquet(path), *args, **kwargs)

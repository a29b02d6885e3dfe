"""PLS1 over rows: for many features, where a features x features matrix is out of reach.

Each component takes two passes that sum one vector of d numbers; the rows stay where they are and nothing of size d x d or
n x n is made. It also serves where covariance form loses digits (nearly collinear features).
"""

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latentspark.functions.kernels import FLAT, Fit, coef_at, top_keep
from latentspark.sources.frame import WEIGHT, Frame, X, Y

#: Shares of the start's covariance and variance below which a component is noise; rows carry more digits than moments.
STOP, FLAT_SCORES = 1e-13, 1e-22
#: Blocks of one label that a task combines, at most.
FAN_IN = 64


def matrix(batch: pa.RecordBatch, column: str, width: int) -> np.ndarray:
    """An array column, each row `width` long, as a matrix; no Python object is made of a row."""
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)


def segments(lists: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Each label of an array column, with the places of its rows: after one sort they lie together."""
    member = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    labels = lists.flatten().to_numpy(zero_copy_only=False)
    order = np.argsort(labels, kind="stable")
    labels, member = labels[order], member[order]
    cuts = np.flatnonzero(np.append(True, labels[1:] != labels[:-1])) if len(labels) else np.empty(0, np.int64)
    for at, end in zip(cuts, np.append(cuts[1:], len(labels)), strict=True):
        yield int(labels[at]), member[at:end]


def width(spark: SparkSession) -> int:
    """Tasks that sum rows, at most: some for each core, not one for each piece of the input."""
    return max(FAN_IN, 2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def few(rows: DataFrame) -> DataFrame:
    """rows in `width` partitions at most, without a shuffle: what tasks emit grows with the cores, not with the rows."""
    return rows.coalesce(width(rows.sparkSession))


def merged(parts: DataFrame, combine: Callable[[np.ndarray, np.ndarray], np.ndarray], by=("label",)) -> DataFrame:
    """label, block: the blocks (label, block) of up to `width` tasks, combined for each label. Tasks combine those of FAN_IN others
    each, level by level, until no more than FAN_IN are left; blocks stream through in order, one label's in memory. Labels with the same `by` end in one
    partition, in order."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, total = None, None
        for batch in batches:
            for label, near, block in zip(batch.label, batch.near, batch.block, strict=True):
                if (label, near) == key:
                    total = combine(total, block)
                    continue
                if key is not None:
                    yield pd.DataFrame({"label": [key[0]], "near": [key[1]], "block": [total]})
                key, total = (label, near), np.array(block)
        if key is not None:
            yield pd.DataFrame({"label": [key[0]], "near": [key[1]], "block": [total]})

    kind = "label int, near int, block array<double>"
    left = width(parts.sparkSession)
    parts = parts.withColumn("near", F.spark_partition_id())
    while left > FAN_IN:
        parts = parts.withColumn("near", F.floor(F.col("near") / FAN_IN).cast("int")).select("label", "near", "block")
        parts = parts.repartition("label", "near").sortWithinPartitions("label", "near").mapInPandas(add, kind)
        left = math.ceil(left / FAN_IN)
    parts = parts.select("label", F.lit(0).alias("near"), "block").repartition(*by).sortWithinPartitions("label")
    return parts.mapInPandas(add, kind).select("label", "block")


def row_sums(frame: Frame, size: int, work: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], combine=np.add) -> np.ndarray:
    """Combines a vector of `size` numbers over all rows; work: x, y, w of a batch to such a vector."""
    weighted, d, q = frame.weighted, frame.d, frame.q

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                v = work(matrix(b, X, d), matrix(b, Y, q), b.column(WEIGHT).to_numpy(zero_copy_only=False) if weighted else np.ones(b.num_rows))
                total = v if total is None else combine(total, v)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total], pa.list_(pa.float64()))], ["label", "block"])

    columns = [X, Y, *([WEIGHT] if weighted else [])]
    parts = few(frame.rows.select(*columns)).mapInArrow(local, "label int, block array<double>")
    r = merged(parts, combine).first()
    return np.zeros(size) if r is None else np.array(r["block"])


def column_means(frame: Frame) -> np.ndarray:
    """Plain means of x and y: the centre of sums."""
    s = row_sums(frame, frame.d + frame.q + 1, lambda x, y, w: np.concatenate([x.sum(0), y.sum(0), [len(x)]]))
    return s[:-1] / max(1.0, s[-1])


def row_fit(frame: Frame, k: int, keep: int | None = None, pre_standardized: bool = False) -> tuple[Fit, np.ndarray, np.ndarray, float, float]:
    """The fit of the first response, and the means and scales of x and y."""
    d = frame.d
    mean = np.zeros(d + 1)
    scale, sw, n = np.ones(d + 1), 0.0, 0.0
    s = row_sums(frame, d + 3, lambda x, y, w: np.concatenate([w @ x, [w @ y[:, 0], w.sum(), len(w)]]))
    sw, n = s[-2], s[-1]
    if not pre_standardized:
        mean = s[:-2] / sw
        m = mean
        var = row_sums(frame, d + 1, lambda x, y, w: np.append(w @ (x - m[:d]) ** 2, w @ (y[:, 0] - m[d]) ** 2)) / sw
        high = row_sums(frame, 2 * d + 2, lambda x, y, w: np.concatenate([x.max(0), [y[:, 0].max()], -x.min(0), [-y[:, 0].min()]]), np.maximum)
        sd = np.sqrt(var)
        scale = np.where((sd > FLAT) & (high[: d + 1] > -high[d + 1 :]), sd, 1.0)
    unit = n / sw
    ws, ps, qs, rs = [], [], [], []

    def left(x, y, c=None):
        """Standardised x, and y without the components so far."""
        xs = (x - mean[:d]) / scale[:d]
        ys = (y[:, 0] - mean[d]) / scale[d]
        return xs, ys - (xs @ np.array(rs).T @ np.array(qs) if rs else 0)

    norm0 = trace0 = None
    for _ in range(k):

        def cross(x, y, w):
            xs, ys = left(x, y)
            return np.append(w @ (xs * ys[:, None]), w @ (xs * xs).sum(1)) * unit

        c = row_sums(frame, d + 1, cross)
        c, trace = c[:-1], c[-1]
        norm0, trace0 = (np.linalg.norm(c), trace) if norm0 is None else (norm0, trace0)
        if not np.linalg.norm(c) > STOP * max(norm0, 1e-300):
            break
        c = top_keep(c, keep)
        v = c / np.linalg.norm(c)
        r = v - sum(((p @ v) * old for p, old in zip(ps, rs, strict=True)), np.zeros(d))

        def loadings(x, y, w, r=r):
            xs, ys = left(x, y)
            t = xs @ r
            return np.concatenate([(w * t) @ xs, [w @ (t * ys), w @ (t * t)]]) * unit

        p = row_sums(frame, d + 2, loadings)
        tt = p[-1]
        if not tt > FLAT_SCORES * trace0:
            break
        ws.append(v)
        ps.append(p[:-2] / tt)
        qs.append(p[-2] / tt)
        rs.append(r)
    w, p = (np.array(m).T.reshape(d, len(m)) for m in (ws, ps))
    q = np.array(qs)
    return Fit(w, p, q, coef_at(w, p, q, len(qs)), len(qs)), mean[:d], scale[:d], float(mean[d]), float(scale[d])

"""Moment blocks: what fits and tests need of any set of rows, as additive sums.

One scan makes the block of a whole frame; one more makes the blocks of many overlapping row sets at a time, or, where they are too
many for a task's memory, of a range of them. Sums are taken around a common centre. Tasks accumulate their rows in NumPy and emit one block
for each set; they are some for each core, so what is shuffled does not depend on the number of rows. Blocks are packed: a triangle of each
symmetric matrix, and of frames without weights the plain sums alone.
"""

from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latentspark.errors import DimensionMismatch, InvalidArgument, InvalidWeights, NonFiniteInput
from latentspark.functions.kernels import FLAT
from latentspark.operators.rowwise import column_means, few, matrix, merged, segments
from latentspark.sources.frame import ID, WEIGHT, Frame, X, Y

BLOCK = "label int, block array<double>"
#: Bytes of blocks that a task holds; more sets are summed in ranges, a scan each.
HELD = 1 << 28


@lru_cache(maxsize=4)
def _triangle(d: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(d)


@dataclass
class Moments:
    """Sums over a set of rows: plain ones (suffix 1), with weights (w) and with root weights (r), around a centre."""

    n: np.ndarray  # rows, sum of w, of sqrt(w), of w squared
    x1: np.ndarray
    xr: np.ndarray
    xw: np.ndarray
    y1: np.ndarray
    yr: np.ndarray
    yw: np.ndarray
    xx1: np.ndarray
    xxw: np.ndarray
    xy1: np.ndarray
    xyw: np.ndarray
    yy1: np.ndarray
    yyw: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @staticmethod
    def shapes(d: int, q: int) -> dict[str, tuple]:
        return {"n": (4,), "x1": (d,), "xr": (d,), "xw": (d,), "y1": (q,), "yr": (q,), "yw": (q,), "xx1": (d, d), "xxw": (d, d), "xy1": (d, q), "xyw": (d, q), "yy1": (q,), "yyw": (q,), "low": (d + q,), "high": (d + q,)}

    @classmethod
    def of(cls, x: np.ndarray, y: np.ndarray, w: np.ndarray | None) -> "Moments":
        v = np.column_stack([x, y])
        low, high = (v.min(0), v.max(0)) if len(v) else (np.full(v.shape[1], np.inf), np.full(v.shape[1], -np.inf))
        x1, y1, xx, xy, yy = x.sum(0), y.sum(0), x.T @ x, x.T @ y, (y * y).sum(0)
        if w is None:
            return cls(np.full(4, float(len(x))), x1, x1, x1, y1, y1, y1, xx, xx, xy, xy, yy, yy, low, high)
        r, wx = np.sqrt(w), w[:, None] * x
        n = np.array([len(w), w.sum(), r.sum(), (w * w).sum()])
        return cls(n, x1, r @ x, wx.sum(0), y1, r @ y, w @ y, xx, wx.T @ x, xy, wx.T @ y, yy, w @ (y * y), low, high)

    @classmethod
    def packed(cls, d: int, q: int, weighted: bool) -> list[tuple[str, tuple]]:
        """Names and shapes in a block, in order; without weights the sums with weights are the plain ones."""
        shapes = cls.shapes(d, q)
        left_out = () if weighted else ("xr", "xw", "yr", "yw", "xxw", "xyw", "yyw")
        return [(f.name, shapes[f.name]) for f in fields(cls) if f.name not in left_out]

    @classmethod
    def size(cls, d: int, q: int, weighted: bool) -> int:
        """Numbers in a block."""
        return sum(d * (d + 1) // 2 if k.startswith("xx") else int(np.prod(s)) for k, s in cls.packed(d, q, weighted))

    def flat(self, weighted: bool = True) -> np.ndarray:
        d, q = len(self.x1), len(self.y1)
        return np.concatenate([getattr(self, k)[_triangle(d)] if k.startswith("xx") else getattr(self, k).ravel() for k, _ in self.packed(d, q, weighted)])

    @classmethod
    def unflat(cls, v: np.ndarray, d: int, q: int, weighted: bool = True) -> "Moments":
        out, at = {}, 0
        for k, s in cls.packed(d, q, weighted):
            if k.startswith("xx"):
                n, half = d * (d + 1) // 2, np.zeros((d, d))
                half[_triangle(d)] = v[at : at + n]
                out[k] = half + half.T - np.diag(np.diag(half))
            else:
                n = int(np.prod(s))
                out[k] = np.asarray(v[at : at + n], float).reshape(s)
            at += n
        if not weighted:
            out |= {"xr": out["x1"], "xw": out["x1"], "yr": out["y1"], "yw": out["y1"], "xxw": out["xx1"], "xyw": out["xy1"], "yyw": out["yy1"]}
        return cls(**out)

    @property
    def rows(self) -> int:
        return int(round(self.n[0]))

    @property
    def n_eff(self) -> float:
        """Kish's effective number of rows."""
        return float(self.n[1] ** 2 / self.n[3]) if self.n[3] > 0 else 0.0

    def unweighted(self) -> "Moments":
        n = np.full(4, self.n[0])
        return Moments(n, self.x1, self.x1, self.x1, self.y1, self.y1, self.y1, self.xx1, self.xx1, self.xy1, self.xy1, self.yy1, self.yy1, self.low, self.high)

    def shifted(self, centre: np.ndarray) -> "Moments":
        """The same sums around another centre: this one's plus `centre`."""
        d = len(self.x1)
        cx, cy = centre[:d], centre[d:]
        move2 = lambda s, xs, n: s - np.outer(xs, cx) - np.outer(cx, xs) + n * np.outer(cx, cx)
        cross = lambda s, xs, ys, n: s - np.outer(xs, cy) - np.outer(cx, ys) + n * np.outer(cx, cy)
        n1, nw, nr, _ = self.n
        return Moments(
            n=self.n,
            x1=self.x1 - n1 * cx,
            xr=self.xr - nr * cx,
            xw=self.xw - nw * cx,
            y1=self.y1 - n1 * cy,
            yr=self.yr - nr * cy,
            yw=self.yw - nw * cy,
            xx1=move2(self.xx1, self.x1, n1),
            xxw=move2(self.xxw, self.xw, nw),
            xy1=cross(self.xy1, self.x1, self.y1, n1),
            xyw=cross(self.xyw, self.xw, self.yw, nw),
            yy1=self.yy1 - 2 * cy * self.y1 + n1 * cy**2,
            yyw=self.yyw - 2 * cy * self.yw + nw * cy**2,
            low=self.low - centre,
            high=self.high - centre,
        )


def mapped(m: Moments, a: np.ndarray, b: np.ndarray, y_scale: float) -> Moments:
    """The moments of a x and y / y_scale - b x, from those of x and one response y. Least and largest values are not known: all columns count
    as varying."""
    one = np.full(len(m.low), 1.0)
    y = lambda ys, xs: ys / y_scale - b @ xs
    cross = lambda xy, xx: a @ (xy / y_scale - (xx @ b)[:, None])
    square = lambda yy, xy, xx: yy / y_scale**2 - 2 * (b @ xy) / y_scale + b @ xx @ b
    return Moments(
        n=m.n,
        x1=a @ m.x1,
        xr=a @ m.xr,
        xw=a @ m.xw,
        y1=y(m.y1, m.x1),
        yr=y(m.yr, m.xr),
        yw=y(m.yw, m.xw),
        xx1=a @ m.xx1 @ a.T,
        xxw=a @ m.xxw @ a.T,
        xy1=cross(m.xy1, m.xx1),
        xyw=cross(m.xyw, m.xxw),
        yy1=square(m.yy1, m.xy1, m.xx1),
        yyw=square(m.yyw, m.xyw, m.xxw),
        low=-one,
        high=one,
    )


@dataclass
class Standard:
    """Weighted means and scales of a row set, and the moments of the standardised data with weights of mean 1."""

    x_mean: np.ndarray
    x_scale: np.ndarray
    y_mean: np.ndarray
    y_scale: np.ndarray
    gram: np.ndarray
    cross: np.ndarray
    y_square: np.ndarray
    rows: int


def standard(m: Moments, pre_standardized: bool = False) -> Standard:
    """A column that is constant, or whose standard deviation (divisor n) is next to nothing, keeps scale 1."""
    n, d, q = m.n[0], len(m.x1), len(m.y1)
    sw = m.n[1] if m.n[1] > 0 else 1.0
    if pre_standardized:
        x_mean, y_mean, x_scale, y_scale = np.zeros(d), np.zeros(q), np.ones(d), np.ones(q)
    else:
        x_mean, y_mean = m.xw / sw, m.yw / sw
        var = np.concatenate([np.diag(m.xxw) / sw - x_mean**2, m.yyw / sw - y_mean**2])
        sd = np.sqrt(np.maximum(var, 0))
        scale = np.where((sd > FLAT) & (m.high > m.low), sd, 1.0)
        x_scale, y_scale = scale[:d], scale[d:]
    f = n / sw
    gram = f * (m.xxw - np.outer(x_mean, m.xw) - np.outer(m.xw, x_mean) + sw * np.outer(x_mean, x_mean)) / np.outer(x_scale, x_scale)
    cross = f * (m.xyw - np.outer(x_mean, m.yw) - np.outer(m.xw, y_mean) + sw * np.outer(x_mean, y_mean)) / np.outer(x_scale, y_scale)
    y_square = f * (m.yyw - 2 * y_mean * m.yw + sw * y_mean**2) / y_scale**2
    return Standard(x_mean, x_scale, y_mean, y_scale, gram, cross, y_square, m.rows)


def adding(ends: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Combines two blocks whose last 2 * ends numbers are least and largest values."""

    def add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = a + b
        np.minimum(a[-2 * ends : -ends], b[-2 * ends : -ends], out=out[-2 * ends : -ends])
        np.maximum(a[-ends:], b[-ends:], out=out[-ends:])
        return out

    return add


def set_blocks(frame: Frame, sets: Column | None, centre: np.ndarray, n_sets: int = 1, by: tuple = ("label",)) -> DataFrame:
    """label, block: moments of overlapping row sets. sets: labels from 0 to n_sets - 1 of a row as an array column over the frame's rows; None: one
    set, 0, of all rows. Sets with the same `by` end in one partition, in order.

    A task holds HELD bytes of blocks at most: where all sets are more, each scan sums a range of them. What is shuffled is a block for each set and
    task."""
    d, q, weighted = frame.d, frame.q, frame.weighted
    rows = frame.rows.withColumn("labels", F.array(F.lit(0)) if sets is None else sets)
    most = max(1, HELD // (8 * Moments.size(d, q, weighted)))
    add = adding(d + q)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            x, y = matrix(batch, X, d) - centre[:d], matrix(batch, Y, q) - centre[d:]
            w = batch.column(WEIGHT).to_numpy(zero_copy_only=False) if weighted else None
            for label, own in segments(batch.column("labels")):
                whole = len(own) == len(x)
                part = Moments.of(x, y, w) if whole else Moments.of(x[own], y[own], None if w is None else w[own])
                flat = part.flat(weighted)
                totals[label] = add(totals[label], flat) if label in totals else flat
        for label, block in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([label], pa.int32()), pa.array([block], pa.list_(pa.float64()))], ["label", "block"])

    columns = [X, Y, *([WEIGHT] if weighted else []), "labels"]
    parts = []
    for low in range(0, n_sets, most):
        mine = rows
        if n_sets > most:
            mine = rows.withColumn("labels", F.expr(f"filter(labels, s -> s >= {low} AND s < {low + most})")).filter(F.size("labels") > 0)
        parts.append(few(mine.select(*columns)).mapInArrow(gather, BLOCK))
    return merged(reduce(DataFrame.unionAll, parts), add, by)


def collected(blocks: DataFrame, frame: Frame) -> dict[int, Moments]:
    """Blocks of a few sets (folds, halves) on the driver."""
    return {r["label"]: Moments.unflat(np.array(r["block"]), frame.d, frame.q, frame.weighted) for r in blocks.collect()}


def per_set(blocks: DataFrame, frame: Frame, work: Callable[[int, Moments], list[tuple]], schema: str) -> DataFrame:
    """Runs small algebra on each set's moments where they are; work returns rows of the schema."""
    d, q, weighted = frame.d, frame.q, frame.weighted
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [r for label, block in zip(batch.label, batch.block, strict=True) for r in work(int(label), Moments.unflat(block, d, q, weighted))]
            yield pd.DataFrame(rows, columns=names)

    return blocks.mapInPandas(run, schema)


def validate(frame: Frame, unique: bool = False) -> dict:
    """One aggregation over the frame: rows, finite values, lengths, weights, column means (the centre).

    unique: also that no two rows have one id, which everything that draws rows relies on."""
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    arrays = [X, Y]
    wrong = F.greatest(*[F.max(F.coalesce((F.col(c).isNull() | F.exists(c, bad)).cast("int"), F.lit(1))) for c in arrays])
    size = F.greatest(F.max((F.size(X) != frame.d).cast("int")), F.max((F.size(Y) != frame.q).cast("int")))
    aggs = [F.count("*").alias("n"), wrong.alias("bad"), size.alias("size")]
    aggs += [F.avg(F.get(X, F.lit(j))).alias(f"x{j}") for j in range(frame.d)] if frame.d <= 200 else []
    aggs += [F.avg(F.get(Y, F.lit(j))).alias(f"y{j}") for j in range(frame.q)] if frame.q <= 200 else []
    if frame.weighted:
        w = F.col(WEIGHT)
        aggs += [F.max(bad(w).cast("int")).alias("w_bad"), F.min(w).alias("w_min"), F.max(w).alias("w_max"), F.sum(w).alias("sw"), F.sum(w * w).alias("sw2")]
    r = frame.rows.agg(*aggs).first().asDict()
    if not r["n"]:
        raise DimensionMismatch("no rows")
    if r["bad"] or (frame.weighted and r["w_bad"]):
        raise NonFiniteInput("null, NaN or infinite values")
    if r["size"]:
        raise DimensionMismatch("arrays of unequal length")
    if frame.weighted:
        if r["w_min"] < 0:
            raise InvalidWeights("negative weights", "negative")
        if r["w_max"] == 0:
            raise InvalidWeights("all weights are zero", "all_zero")
    if unique and frame.rows.select(ID).distinct().count() < r["n"]:
        raise InvalidArgument("row ids are not unique")
    mean = lambda c, n: np.array([r.get(f"{c}{j}", 0.0) for j in range(n)])
    r["centre"] = np.concatenate([mean("x", frame.d), mean("y", frame.q)]) if max(frame.d, frame.q) <= 200 else column_means(frame)
    r["n_eff"] = r["sw"] ** 2 / r["sw2"] if frame.weighted else float(r["n"])
    r["uniform"] = not frame.weighted or max(abs(r["w_max"] * r["n"] / r["sw"] - 1), abs(r["w_min"] * r["n"] / r["sw"] - 1)) < 1e-12
    return r


#: Products that are summed by Spark's own expressions; more go through NumPy.
PLAIN = 40


def total(frame: Frame, centre: np.ndarray) -> Moments:
    """The moments of all rows. Of few columns they are sums of Spark's own, without Python."""
    d, q = frame.d, frame.q
    if d * (d + 1) // 2 + d * q + q <= PLAIN:
        return _summed_plainly(frame, centre)
    return collected(set_blocks(frame, None, centre), frame)[0]


def _summed_plainly(frame: Frame, centre: np.ndarray) -> Moments:
    d, q = frame.d, frame.q
    value = lambda c, j: F.get(X if c == "x" else Y, F.lit(j)) - F.lit(float(centre[j if c == "x" else d + j]))
    x, y = [value("x", j) for j in range(d)], [value("y", j) for j in range(q)]
    one = F.lit(1.0)
    w = {"1": one, "r": F.sqrt(WEIGHT), "w": F.col(WEIGHT)} if frame.weighted else {"1": one}
    sums = {"n0": F.count("*").cast("double")}
    if frame.weighted:
        sums |= {"n1": F.sum(WEIGHT), "n2": F.sum(w["r"]), "n3": F.sum(w["w"] * w["w"])}
    for k, v in w.items():
        sums |= {f"x{k}_{i}": F.sum(v * x[i]) for i in range(d)} | {f"y{k}_{j}": F.sum(v * y[j]) for j in range(q)}
        if k != "r":
            sums |= {f"xx{k}_{i}_{j}": F.sum(v * x[i] * x[j]) for i in range(d) for j in range(i, d)}
            sums |= {f"xy{k}_{i}_{j}": F.sum(v * x[i] * y[j]) for i in range(d) for j in range(q)} | {f"yy{k}_{j}": F.sum(v * y[j] * y[j]) for j in range(q)}
    sums |= {f"low_{i}": F.min(c) for i, c in enumerate([*x, *y])} | {f"high_{i}": F.max(c) for i, c in enumerate([*x, *y])}
    r = frame.rows.agg(*[F.coalesce(c, F.lit(0.0)).alias(k) for k, c in sums.items()]).first().asDict()
    flat = [r["n0"], *([r["n1"], r["n2"], r["n3"]] if frame.weighted else [r["n0"]] * 3)]
    for name, shape in Moments.packed(d, q, frame.weighted)[1:]:
        if name.startswith("xx"):
            flat += [r[f"{name}_{i}_{j}"] for i in range(d) for j in range(i, d)]
        else:
            flat += [r["_".join([name, *map(str, at)])] for at in np.ndindex(*shape)]
    return Moments.unflat(np.array(flat, float), d, q, frame.weighted)

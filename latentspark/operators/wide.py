"""Fits and tests over rows, of many row sets at a time: for many features, and where covariance form loses digits.

Nothing here is of size features x features. Each pass over the rows sums one vector or matrix of (features x responses) numbers for every set; what the
sets' fits need of the passes before is broadcast. Sets are cut into ranges whose numbers fit RANGE bytes, and so are
the responses of a set.

With more features than rows the products of rows with rows are fewer than those of features with rows: `split_tiles` and `square_norm` then
work on tiles of row blocks. A block of rows stays in its task while all blocks stream by.
"""

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latentspark.functions.kernels import FLAT, coef_at, top_keep
from latentspark.operators.rowwise import FLAT_SCORES, STOP, few, matrix, merged, row_sums, segments
from latentspark.sources.frame import ID, WEIGHT, Frame, X, Y

BLOCK = "label int, block array<double>"
#: Bytes of states that are broadcast, and of sums that a task holds, at a time.
RANGE = 1 << 26
#: Rows of a block of a tile; fewer where rows are so long that a block would exceed RANGE.
TILE_ROWS = 512


@dataclass
class SetFit:
    """Fits of one row set: of each response of a range. Means and scales are those of the set; w, p, q have one entry a component."""

    responses: range
    n: float
    sw: float
    sw2: float
    mean: np.ndarray
    scale: np.ndarray
    y_mean: np.ndarray
    y_scale: np.ndarray
    plain: bool = False
    w: list[np.ndarray] = field(default_factory=list)
    p: list[np.ndarray] = field(default_factory=list)
    r: list[np.ndarray] = field(default_factory=list)
    q: list[np.ndarray] = field(default_factory=list)
    tt: list[np.ndarray] = field(default_factory=list)
    k_used: np.ndarray | None = None
    norm0: np.ndarray | None = None
    trace0: float = 0.0
    square: np.ndarray | None = None

    @property
    def n_eff(self) -> float:
        return self.sw * self.sw / self.sw2 if self.sw2 > 0 else 0.0

    @property
    def unit(self) -> float:
        return self.n / self.sw if self.sw > 0 else 0.0

    def weights(self, j: int) -> np.ndarray:
        """W of the j-th response of the range."""
        k = int(self.k_used[j])
        return np.array([w[:, j] for w in self.w[:k]]).T.reshape(len(self.mean), k)

    def coef(self, j: int, k: int | None = None) -> np.ndarray:
        """Coefficients (standardised) of the first k components for the j-th response of the range."""
        used = int(self.k_used[j])
        p = np.array([p[:, j] for p in self.p[:used]]).T.reshape(len(self.mean), used)
        return coef_at(self.weights(j), p, np.array([q[j] for q in self.q[:used]]), used if k is None else k)


def set_sums(frame: Frame, labels: Column | None, states: dict[int, object], work: Callable, maxima: int = 0) -> dict[int, np.ndarray]:
    """For each label of `states`: work(state, x, y, w), a vector, added up over the label's rows; its last `maxima` numbers are maxima.

    labels: an array column over the frame's rows; None: all rows have label 0."""
    spark = frame.rows.sparkSession
    d, q, weighted = frame.d, frame.q, frame.weighted
    shared = spark.sparkContext.broadcast(states)

    def add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = a + b
        if maxima:
            np.maximum(a[-maxima:], b[-maxima:], out=out[-maxima:])
        return out

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            x, y = matrix(batch, X, d), matrix(batch, Y, q)
            w = batch.column(WEIGHT).to_numpy(zero_copy_only=False) if weighted else np.ones(len(x))
            for label, own in segments(batch.column("labels")):
                if label not in shared.value:
                    continue
                v = work(shared.value[label], x, y, w) if len(own) == len(x) else work(shared.value[label], x[own], y[own], w[own])
                totals[label] = add(totals[label], v) if label in totals else v
        for label, v in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([label], pa.int32()), pa.array([v], pa.list_(pa.float64()))], ["label", "block"])

    rows = frame.rows.withColumn("labels", F.array(F.lit(0)) if labels is None else labels)
    columns = [X, Y, *([WEIGHT] if weighted else []), "labels"]
    out = {r["label"]: np.array(r["block"]) for r in merged(few(rows.select(*columns)).mapInArrow(gather, BLOCK), add).collect()}  # RANGE bytes
    shared.destroy()
    return out


def ranges(sets: list[int], d: int, q: int, k: int) -> Iterator[tuple[list[int], range]]:
    """Sets and responses whose states fit RANGE bytes together: means, scales and, for each response, 3 k + 2 vectors of d numbers."""
    most = max(1, (RANGE // (8 * d) - 4) // (3 * k + 2))
    if q > most:
        for s in sets:
            for at in range(0, q, most):
                yield [s], range(at, min(q, at + most))
        return
    step = max(1, RANGE // (8 * d * (4 + q * (3 * k + 2))))
    for at in range(0, len(sets), step):
        yield sets[at : at + step], range(q)


def standards(frame: Frame, labels: Column | None, sets: list[int], responses: range, pre_standardized: bool = False, fill_weights: bool = False) -> dict[int, SetFit]:
    """Weighted means and scales of x and y in each set: two passes. fill_weights: a set of weights 0 counts all its rows alike.
    Sets without rows are left out."""
    d, q = frame.d, len(responses)
    columns = slice(responses.start, responses.stop)

    def first(plain, x, y, w):
        w, y = np.ones(len(x)) if plain else w, y[:, columns]
        return np.concatenate([[len(x), w.sum(), w @ w], w @ x, w @ y, x.max(0), y.max(0), -x.min(0), -y.min(0)])

    found = set_sums(frame, labels, dict.fromkeys(sets, False), first, 2 * (d + q))
    plain = {s for s, v in found.items() if v[1] <= 0 and fill_weights}
    if plain:
        found |= set_sums(frame, labels, dict.fromkeys(plain, True), first, 2 * (d + q))
    out = {}
    for s, v in found.items():
        out[s] = SetFit(responses, *v[:3], np.zeros(d), np.ones(d), np.zeros(q), np.ones(q), s in plain)
        if not pre_standardized and v[1] > 0:
            means = v[3 : 3 + d + q] / v[1]
            out[s].mean, out[s].y_mean = means[:d], means[d:]
    if pre_standardized:
        return out

    def second(state, x, y, w):
        mean, y_mean, plain = state
        w = np.ones(len(x)) if plain else w
        return np.concatenate([w @ (x - mean) ** 2, w @ (y[:, columns] - y_mean) ** 2])

    for s, v in set_sums(frame, labels, {s: (f.mean, f.y_mean, f.plain) for s, f in out.items()}, second).items():
        high, low = found[s][-2 * (d + q) : -(d + q)], -found[s][-(d + q) :]
        sd = np.sqrt(v / out[s].sw) if out[s].sw > 0 else np.zeros(d + q)
        scale = np.where((sd > FLAT) & (high > low), sd, 1.0)
        out[s].scale, out[s].y_scale = scale[:d], scale[d:]
    return out


def _left(f: tuple, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Standardised x, standardised y without the components so far, and weights."""
    columns, mean, scale, y_mean, y_scale, plain, rs, qs = f
    z, y = (x - mean) / scale, (y[:, columns] - y_mean) / y_scale
    for r, q in zip(rs, qs, strict=True):
        y = y - (z @ r) * q
    return z, y, np.ones(len(x)) if plain else w


def _state(f: SetFit) -> tuple:
    return slice(f.responses.start, f.responses.stop), f.mean, f.scale, f.y_mean, f.y_scale, f.plain, f.r, f.q


def _cross(f, x, y, w):
    z, y, w = _left(f, x, y, w)
    return np.concatenate([(z.T @ (w[:, None] * y)).ravel(), [w @ (z * z).sum(1)], w @ (y * y)])


def _loadings(state, x, y, w):
    f, r = state
    z, y, w = _left(f, x, y, w)
    t = z @ r
    return np.concatenate([(z.T @ (w[:, None] * t)).ravel(), w @ (t * y), w @ (t * t)])


def fit_sets(frame: Frame, labels: Column | None, sets: list[int], k: int, keep: int | None = None, pre_standardized: bool = False, fill_weights: bool = False, y_as_is: bool = False) -> Iterator[dict[int, SetFit]]:
    """Fits of every response in every set, a range at a time: two passes for means and scales, and two for each component. y_as_is: responses are
    standardised already."""
    d = frame.d
    for some, responses in ranges(sets, d, frame.q, k):
        fits = standards(frame, labels, some, responses, pre_standardized, fill_weights)
        q = len(responses)
        for f in fits.values():
            f.k_used = np.zeros(q, int)
            if y_as_is:
                f.y_mean, f.y_scale = np.zeros(q), np.ones(q)
        for a in range(k):
            sums = set_sums(frame, labels, {s: _state(f) for s, f in fits.items()}, _cross)
            directions = {}
            for s, f in fits.items():
                c = sums[s][: d * q].reshape(d, q) * f.unit
                norm = np.linalg.norm(c, axis=0)
                if a == 0:
                    f.norm0, f.trace0, f.square = norm, float(sums[s][d * q]) * f.unit, sums[s][d * q + 1 :] * f.unit
                going = (f.k_used == a) & (norm > STOP * np.maximum(f.norm0, 1e-300))
                w = np.zeros((d, q))
                for j in np.flatnonzero(going):
                    kept = top_keep(c[:, j], keep)
                    w[:, j] = kept / np.linalg.norm(kept)
                r = w.copy()
                for p, old in zip(f.p, f.r, strict=True):
                    r -= old * (p * w).sum(0)
                directions[s] = (w, r)
            if not any((w != 0).any() for w, _ in directions.values()):
                break
            sums = set_sums(frame, labels, {s: (_state(f), directions[s][1]) for s, f in fits.items()}, _loadings)
            for s, f in fits.items():
                w, r = directions[s]
                p = sums[s][: d * q].reshape(d, q) * f.unit
                ty, tt = sums[s][d * q : d * q + q] * f.unit, sums[s][d * q + q :] * f.unit
                fine = (w != 0).any(0) & (tt > FLAT_SCORES * f.trace0)
                tt = np.where(fine, tt, 1.0)
                f.w.append(np.where(fine, w, 0))
                f.r.append(np.where(fine, r, 0))
                f.p.append(np.where(fine, p / tt, 0))
                f.q.append(np.where(fine, ty / tt, 0))
                f.tt.append(np.where(fine, tt, 0))
                f.k_used = f.k_used + fine
        yield fits


def covariance(frame: Frame, f: SetFit) -> tuple[np.ndarray, float]:
    """X'y of the standardised data, a column for each response of the range, and the trace of X'X."""
    v = set_sums(frame, None, {0: _state(f)}, _cross)[0] * f.unit
    d, q = frame.d, len(f.responses)
    return v[: d * q].reshape(d, q), float(v[d * q])


# ---- scores in other rows


@dataclass
class Scorer:
    """Columns of scores (x - mean) g, each beside a response: (y - y_mean) / y_scale. plain: weights count as 1."""

    mean: np.ndarray
    g: np.ndarray
    columns: np.ndarray
    y_mean: np.ndarray
    y_scale: np.ndarray
    plain: bool = False


@dataclass
class Scored:
    """Sums over the rows of a set, with weights w and their roots r: of the score t, the response y and the rest e = y - t."""

    n: float
    sw: float
    rt: np.ndarray
    ry: np.ndarray
    wtt: np.ndarray
    wty: np.ndarray
    wyy: np.ndarray
    wy: np.ndarray
    wee: np.ndarray

    @classmethod
    def of(cls, v: np.ndarray) -> "Scored":
        return cls(v[0], v[1], *v[2:].reshape(7, -1))

    def correlations(self, flat: float, none: float) -> np.ndarray:
        """Pearson's r of score and response, both times root weights."""
        out = np.full(len(self.rt), none)
        if self.n < 2 or self.sw <= 0:
            return out
        f = self.n / self.sw
        tt, yy = f * (self.wtt - self.rt**2 / self.n), f * (self.wyy - self.ry**2 / self.n)
        fine = (tt > flat) & (yy > flat)
        out[fine] = np.clip((f * (self.wty - self.rt * self.ry / self.n))[fine] / np.sqrt(tt * yy)[fine], -1, 1)
        return out

    def residuals(self) -> tuple[np.ndarray, np.ndarray]:
        """Weighted residual and total sums of squares, weights of mean 1."""
        f = self.n / self.sw if self.sw > 0 else 0.0
        return f * self.wee, f * (self.wyy - self.wy**2 / (self.sw if self.sw > 0 else 1.0))


def _score(s: Scorer, x, y, w):
    t, y = (x - s.mean) @ s.g, (y[:, s.columns] - s.y_mean) / s.y_scale
    w = np.ones(len(x)) if s.plain else w
    return _sums(t, y, w)


def _sums(t: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    r, e = np.sqrt(w), y - t
    return np.concatenate([[len(t), w.sum()], r @ t, r @ y, w @ (t * t), w @ (t * y), w @ (y * y), w @ y, w @ (e * e)])


def score_sets(frame: Frame, labels: Column | None, scorers: dict[int, Scorer]) -> dict[int, Scored]:
    """One pass: sums of scores and responses over the rows of each label."""
    return {s: Scored.of(v) for s, v in set_sums(frame, labels, scorers, _score).items()}


def scorer(f: SetFit, g: np.ndarray, columns: np.ndarray, standardised: bool, plain: bool = False) -> Scorer:
    """g: coefficients in standardised x; columns: places in the fit's range. standardised: the response, too; else it stays as it is, which root weights
    tell apart from a centred one."""
    one = np.ones(len(columns))
    y_mean, y_scale = (f.y_mean[columns], f.y_scale[columns]) if standardised else (0 * one, one)
    return Scorer(f.mean, g / f.scale[:, None], columns + f.responses.start, y_mean, y_scale, plain)


# ---- products of rows with rows


def kernel_is_cheaper(n_train: int, n_test: int, d: int, responses: int) -> bool:
    """Whether scores of test rows are had with fewer products as (rows x rows) x responses than as rows x (features x responses)."""
    return n_test * n_train * (d + responses) < (n_train + n_test) * d * responses


def tiles(frame: Frame, labels: Column, work: Callable, schema: str) -> DataFrame:
    """work(block, others): `block` is (x, y, w, labels) of some rows, `others` yields the same of all rows, some at a time; work yields record batches.

    Each row lies in one block and meets every block: blocks x rows are shuffled, which pays where rows are few and long. A task holds its block
    and one batch."""
    d, q, weighted = frame.d, frame.q, frame.weighted
    n = frame.rows.count()
    size = max(1, min(TILE_ROWS, RANGE // (8 * (d + q))))
    blocks = max(1, math.ceil(n / size))
    rows = frame.rows.withColumns({"labels": labels, "own": F.pmod(F.xxhash64(ID), F.lit(blocks)).cast("int")})
    columns = [X, Y, *([WEIGHT] if weighted else []), "labels"]
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    copies = rows.select("own", F.lit(0).alias("side"), *columns).unionAll(rows.select(every.alias("own"), F.lit(1).alias("side"), *columns))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, tuple]]:
        for batch in batches:
            own, side = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("own", "side"))
            cuts = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (side[1:] != side[:-1]))) if len(own) else []
            for at, end in zip(cuts, np.append(cuts[1:], len(own)), strict=True) if len(own) else ():
                for low in range(at, end, size):
                    piece = batch.slice(low, min(size, end - low))
                    w = piece.column(WEIGHT).to_numpy(zero_copy_only=False) if weighted else np.ones(piece.num_rows)
                    member = dict(segments(piece.column("labels")))
                    yield int(own[at]), int(side[at]), (matrix(piece, X, d), matrix(piece, Y, q), w, member)

    def joined(held: list[tuple]) -> tuple:
        at, member = 0, {}
        for x, _, _, found in held:
            for label, places in found.items():
                member.setdefault(label, []).append(places + at)
            at += len(x)
        return (*[np.concatenate([h[i] for h in held]) for i in range(3)], {label: np.concatenate(p) for label, p in member.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = parts(batches)
        ahead = next(source, None)
        while ahead is not None:
            current, held = ahead[0], []
            while ahead is not None and ahead[:2] == (current, 0):
                held.append(ahead[2])
                ahead = next(source, None)
            # Copies of other rows come for blocks without rows of their own, too.
            def others():
                nonlocal ahead
                while ahead is not None and ahead[0] == current:
                    yield ahead[2]
                    ahead = next(source, None)

            if held:
                yield from work(joined(held), others())
            else:
                for _ in others():
                    pass

    return copies.repartition(blocks, "own").sortWithinPartitions("own", "side").mapInArrow(run, schema)


def split_tiles(frame: Frame, labels: Column, splits: int) -> dict[int, np.ndarray]:
    """Correlations of one-component scores with every response in set 2b + 1, fitted in set 2b, for each split b, from tiles of rows with rows:
    the scores are (Z_test Z_train') (w y_train), up to a factor."""
    d, q = frame.d, frame.q
    out = {}
    step = max(1, min(RANGE // (16 * d), RANGE // (8 * q * TILE_ROWS)))
    for low in range(0, splits, step):
        some = range(low, min(splits, low + step))
        stats = standards(frame, labels, [2 * b for b in some], range(0))
        shared = frame.rows.sparkSession.sparkContext.broadcast({s: (f.mean, f.scale) for s, f in stats.items()})

        def work(block, others, some=some, shared=shared):
            x, y, w, member = block
            tests, scores = {}, {}
            for b in some:
                if 2 * b in shared.value and len(own := member.get(2 * b + 1, ())):
                    mean, scale = shared.value[2 * b]
                    tests[b], scores[b] = (own, (x[own] - mean) / scale), np.zeros((len(own), q))
            for x2, y2, w2, member2 in others:
                for b, (_, z) in tests.items():
                    if len(own := member2.get(2 * b, ())):
                        mean, scale = shared.value[2 * b]
                        scores[b] += (z @ ((x2[own] - mean) / scale).T) @ (w2[own, None] * y2[own])
            for b, (own, _) in tests.items():
                v = _sums(scores[b], y[own], w[own])
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([v], pa.list_(pa.float64()))], ["label", "block"])

        sums = merged(tiles(frame, labels, work, BLOCK), np.add).collect()  # 7 numbers a split and response
        shared.destroy()
        for r in sums:
            s = Scored.of(np.array(r["block"]))
            train = stats[2 * r["label"]]
            out[r["label"]] = s.correlations(1e-15, 0.0) if train.sw > 0 else np.zeros(q)
    return out


def square_norm(frame: Frame, f: SetFit) -> float:
    """The sum of squares of all entries of the standardised data's Gram matrix, from whichever of rows x rows and features x features is smaller."""
    d, unit = frame.d, f.unit
    if f.n < d:
        mean, scale = f.mean, f.scale

        def work(block, others):
            z, total = np.sqrt(block[2] * unit)[:, None] * (block[0] - mean) / scale, 0.0
            for x2, _, w2, _ in others:
                k = z @ (np.sqrt(w2 * unit)[:, None] * (x2 - mean) / scale).T
                total += float((k * k).sum())
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([[total]], pa.list_(pa.float64()))], ["label", "block"])

        return float(merged(tiles(frame.with_rows(frame.rows.withColumn(Y, F.array().cast("array<double>")), q=0), F.array(F.lit(0)), work, BLOCK), np.add).first()["block"][0])
    # Strips of features against all features, as many as a task holds.
    strip = max(1, min(d, RANGE // (8 * d)))
    total = 0.0
    for low in range(0, d, strip):
        high = min(d, low + strip)

        def work(state, x, y, w, low=low, high=high):
            mean, scale = state
            z = (x - mean) / scale
            return ((w[:, None] * z[:, low:high]).T @ z[:, low:]).ravel() * unit

        g = set_sums(frame, None, {0: (f.mean, f.scale)}, work)[0].reshape(high - low, d - low)
        own = g[:, : high - low]
        total += float((own * own).sum()) + 2 * float((g[:, high - low :] ** 2).sum())
    return total


# ---- the largest eigenvalue


def top_eigenvalue(frame: Frame, f: SetFit, tolerance: float = 1e-10) -> float:
    """The largest eigenvalue of the standardised data's Gram matrix by Lanczos steps, a pass over the rows each; the vectors so far are kept orthogonal.

    Ends where the residual's bound says that the eigenvalue is known to the tolerance, or where the space is exhausted."""
    mean, scale, unit = f.mean, f.scale, f.unit

    def times(v: np.ndarray) -> np.ndarray:
        def work(x, y, w):
            z = (x - mean) / scale
            return z.T @ (w * (z @ v)) * unit

        return row_sums(frame, len(v), work)

    basis, alpha, beta = [], [], []
    v = np.random.default_rng(0).normal(size=frame.d)
    v /= np.linalg.norm(v)
    value = 0.0
    while len(basis) < min(frame.d, f.n):
        basis.append(v)
        u = times(v)
        alpha.append(float(u @ v))
        for _ in range(2):
            u = u - np.array(basis).T @ (np.array(basis) @ u)
        rest = float(np.linalg.norm(u))
        t = np.diag(alpha) + np.diag(beta, 1) + np.diag(beta, -1)
        e, s = np.linalg.eigh(t)
        value, gap = float(e[-1]), float(e[-1] - e[-2]) if len(e) > 1 else 0.0
        bound = rest * abs(float(s[-1, -1]))
        if rest <= 1e-13 * max(value, 1e-300) or (gap > bound and bound * bound / gap <= tolerance * value):
            break
        beta.append(rest)
        v = u / rest
    return value


def stable_rank(frame: Frame, f: SetFit) -> float:
    """Trace over the largest eigenvalue."""
    mean, scale, unit = f.mean, f.scale, f.unit
    trace = float(row_sums(frame, 1, lambda x, y, w: np.array([w @ (((x - mean) / scale) ** 2).sum(1) * unit]))[0])
    top = top_eigenvalue(frame, f)
    return trace / top if top > 0 else 0.0

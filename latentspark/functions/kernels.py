"""Dense algebra on moments: small matrices, on the driver or inside a task."""

import itertools
import math
from dataclasses import dataclass

import numpy as np

#: Standard deviations up to this are taken as none; their columns keep scale 1.
FLAT = 1e-12
#: A component is dropped where its covariance or variance falls below this share of the start's.
STOP = 1e-12


@dataclass
class Fit:
    """A PLS1 fit in standardised coordinates: loadings P, weights W, y-loadings Q, coef; k_used may be below k."""

    w: np.ndarray
    p: np.ndarray
    q: np.ndarray
    coef: np.ndarray
    k_used: int
    #: The smallest variance of a component's scores, as a share of the data's: near 0, covariance form loses digits.
    least: float = 1.0


def top_keep(s: np.ndarray, keep: int | None) -> np.ndarray:
    """s with all but its `keep` largest magnitudes at 0; ties go to the first."""
    if keep is None or keep >= len(s):
        return s
    out = np.zeros_like(s)
    kept = np.lexsort((np.arange(len(s)), -np.abs(s)))[:keep]
    out[kept] = s[kept]
    return out


def pls1(gram: np.ndarray, cross: np.ndarray, k: int, keep: int | None = None) -> Fit:
    """PLS1 in covariance form: gram = X'X and cross = X'y of standardised data."""
    s, c = gram.copy(), cross.copy()
    norm0, trace0 = np.linalg.norm(cross), np.trace(gram)
    ws, ps, qs, least = [], [], [], 1.0
    for _ in range(k):
        if not np.linalg.norm(c) > max(1e-14, STOP * norm0):
            break
        w = top_keep(c, keep)
        w = w / np.linalg.norm(w)
        sw = s @ w
        tau = float(w @ sw)
        if not tau > max(1e-14, STOP * trace0):
            break
        least = min(least, tau / trace0)
        p, q = sw / tau, float(c @ w) / tau
        s -= tau * np.outer(p, p)
        c = c - tau * q * p
        ws.append(w)
        ps.append(p)
        qs.append(q)
    d = len(cross)
    w, p = (np.array(m).T.reshape(d, len(m)) for m in (ws, ps))
    q = np.array(qs)
    return Fit(w, p, q, coef_at(w, p, q, len(qs)), len(qs), least)


def coef_at(w: np.ndarray, p: np.ndarray, q: np.ndarray, k: int) -> np.ndarray:
    """Coefficients of the first k components."""
    k = min(k, w.shape[1])
    if k == 0:
        return np.zeros(w.shape[0])
    return w[:, :k] @ np.linalg.solve(p[:, :k].T @ w[:, :k], q[:k])


def score_weights(w: np.ndarray, p: np.ndarray) -> np.ndarray:
    """R with T = XR."""
    return w @ np.linalg.inv(p.T @ w) if w.shape[1] else w


def stable_rank(gram: np.ndarray) -> float:
    top = float(np.linalg.eigvalsh(gram)[-1]) if gram.size else 0.0
    return float(np.trace(gram)) / top if top > 0 else 0.0


def leverage(w: np.ndarray) -> np.ndarray:
    """The diagonal of the projection onto the columns of w."""
    return np.einsum("ij,jk,ik->i", w, np.linalg.pinv(w.T @ w), w)


def quantile(values: np.ndarray, q: float) -> float:
    """Linear interpolation between order statistics; none: NaN."""
    v = np.sort(np.asarray(values, float))
    return float(np.quantile(v, min(max(q, 0.0), 1.0))) if len(v) else math.nan


def fold_sizes(n: int, folds: int) -> list[int]:
    return [n // folds + (i < n % folds) for i in range(folds)]


def split_size(n: int, k: int) -> int:
    """Training rows of a half split: half, but k + 2 at least and n - 3 at most."""
    return min(max(n // 2, k + 2), n - 3)


def keep_grid(d: int) -> list[int]:
    """1, 2, 4, ... below d, then d."""
    grid, v = [], 1
    while v < d:
        grid.append(v)
        v *= 2
    return [*grid, d]


def row_unit(a: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(a, axis=1, keepdims=True)
    return a / np.where(n > FLAT, n, 1)


def varimax_criterion(a: np.ndarray) -> float:
    return float((a**2).var(axis=0).sum())


def varimax(a: np.ndarray, normalize: bool = True, sweeps: int = 50, tol: float = 1e-8) -> tuple[np.ndarray, int, float]:
    """Rotation R that maximises the varimax criterion of a @ R, by sweeps over pairs of axes; sweeps done; the criterion.

    A single axis is left as it is."""
    k = a.shape[1]
    if k < 2:
        return np.eye(k), 0, varimax_criterion(a)
    target = row_unit(a) if normalize else a.copy()
    r, value, n = np.eye(k), varimax_criterion(target), 0
    for n in range(1, sweeps + 1):
        for i, j in itertools.combinations(range(k), 2):
            x, y = target[:, i], target[:, j]
            u, v = x * x - y * y, 2 * x * y
            # The angle that maximises the summed variance of squared entries in this plane.
            num = 2 * (u @ v - u.sum() * v.sum() / len(u))
            den = u @ u - v @ v - (u.sum() ** 2 - v.sum() ** 2) / len(u)
            angle = math.atan2(num, den) / 4
            turn = np.array([[math.cos(angle), -math.sin(angle)], [math.sin(angle), math.cos(angle)]])
            target[:, [i, j]] = target[:, [i, j]] @ turn
            r[:, [i, j]] = r[:, [i, j]] @ turn
        new = varimax_criterion(target)
        if new - value < tol:
            break  # the value reported is the one before the last sweep
        value = new
    return r, n, value


def procrustes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The orthogonal R that brings a @ R closest to b."""
    u, _, vt = np.linalg.svd(a.T @ b)
    return u @ vt


def signed_permutation(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a with columns reordered and signed to be closest to b (k up to 7, by enumeration)."""
    dots = a.T @ b
    k = len(dots)
    best = max(itertools.permutations(range(k)), key=lambda o: sum(abs(dots[i, j]) for j, i in enumerate(o)))
    return np.column_stack([a[:, i] * (1 if dots[i, j] >= 0 else -1) for j, i in enumerate(best)])

"""PLS1 over rows, as the textbooks have it: what the moment form is held against."""

import numpy as np


def standardise(v, w=None):
    w = np.ones(len(v)) if w is None else w * len(v) / w.sum()
    mean = (w[:, None] * v).sum(0) / len(v)
    sd = np.sqrt((w[:, None] * (v - mean) ** 2).sum(0) / len(v))
    return (v - mean) / np.where(sd > 1e-12, sd, 1), mean, np.where(sd > 1e-12, sd, 1)


def pls1(x, y, k, w=None, keep=None):
    """coef, beta, intercept, W, P, Q of NIPALS on standardised, root-weighted rows."""
    xs, mx, sx = standardise(x, w)
    ys, my, sy = (a[:, 0] if a.ndim > 1 else a[0] for a in standardise(y[:, None], w))
    root = np.ones(len(x)) if w is None else np.sqrt(w * len(w) / w.sum())
    e, f = xs * root[:, None], ys * root
    ws, ps, qs = [], [], []
    for _ in range(k):
        u = e.T @ f
        if keep is not None and keep < len(u):
            drop = np.lexsort((np.arange(len(u)), -abs(u)))[keep:]
            u[drop] = 0
        u = u / np.linalg.norm(u)
        t = e @ u
        p, q = e.T @ t / (t @ t), f @ t / (t @ t)
        e, f = e - np.outer(t, p), f - q * t
        ws.append(u)
        ps.append(p)
        qs.append(q)
    w_, p_, q_ = np.array(ws).T, np.array(ps).T, np.array(qs)
    coef = w_ @ np.linalg.solve(p_.T @ w_, q_)
    beta = coef * sy / sx
    return coef, beta, my - beta @ mx, w_, p_, q_

"""A small causal self-attention model in numpy.

Each token is predicted from the tokens before it in its window: embeddings with positions, one masked
attention layer, a feed-forward layer, and a softmax in two steps (first the cluster of the next token,
then the token in it). A cluster's tokens either all begin a word or all go on with one, so the first step also gives
the chance that a word ends. Everything runs on batches of windows.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Tokens of a window, and how many of them only serve as context after a text's first window.
WINDOW, OVERLAP = 32, 8
#: Width of the model.
DIM = 16
#: Clusters of the tokens of a kind, in the order of their frequency: tokens of a cluster, up to which number.
SIZES = ((32, 256), (128, 2048), (1024, 1 << 16))
BATCH = 512
#: Tokens that a share learns from at a time.
HELD = 1 << 19
#: Windows that the first fit sees in all, where there are fewer.
ENOUGH = 60_000
#: As much as a core's cache holds: windows of a part, rows of a softmax, weights that take a step at a time.
PART, ROWS, STEP = 64, 2048, 1 << 14
#: Parts whose positions are scored at a time.
AT_ONCE = 64
_CAUSAL = np.tril(np.ones((WINDOW, WINDOW), np.float32))


class Weights(dict):
    """Arrays by name. Tokens below `begin` begin a word, the others go on with one; each of the two kinds is numbered by
    frequency and has clusters of its own, so the clusters also tell whether a word ends."""

    def __init__(self, begin: int, arrays: dict):
        super().__init__(arrays)
        self.begin = begin

    def __reduce__(self):
        return Weights, (self.begin, dict(self))


def edges(begin: int, vocab: int) -> tuple[np.ndarray, int]:
    """First token of each cluster, and the end of the last one; and how many clusters hold tokens that begin a word."""
    out, at, kinds = [0], 0, []
    for first, end in ((0, begin), (begin, vocab)):
        for size, last in SIZES:
            while at < min(end, first + last):
                at = min(at + size, end)
                out.append(at)
        kinds.append(len(out) - 1)
    return np.array(out), kinds[0]


def clusters(w: Weights) -> tuple[np.ndarray, np.ndarray, int]:
    """Edges of the clusters, the cluster of each token, and the number of clusters that begin words."""
    e, first = edges(w.begin, len(w["embed"]))
    return e, np.repeat(np.arange(len(e) - 1, dtype=np.uint8), np.diff(e)), first


def shapes(begin: int, vocab: int) -> dict[str, tuple[int, ...]]:
    n = len(edges(begin, vocab)[0]) - 1
    return {"embed": (vocab, DIM), "place": (WINDOW, DIM), "qkv": (DIM, 3 * DIM), "up": (DIM, 2 * DIM), "up_b": (2 * DIM,), "down": (2 * DIM, DIM), "cluster": (DIM, n), "cluster_b": (n,), "inner": (vocab, DIM), "inner_b": (vocab,)}


def initial(counts: np.ndarray, begin: int, seed: int = 3) -> Weights:
    """Weights before training; the softmax starts from how often each token occurs."""
    rng = np.random.default_rng(seed)
    scale = {"embed": 0.3, "place": 0.1, "cluster": 0.3 / np.sqrt(DIM), "inner": 0.3 / np.sqrt(DIM)}
    w = Weights(begin, {k: rng.normal(0, scale.get(k, 1 / np.sqrt(s[0])), s).astype(np.float32) if len(s) > 1 else np.zeros(s, np.float32) for k, s in shapes(begin, len(counts)).items()})
    share = (counts + 0.5) / (counts.sum() + 0.5 * len(counts))
    e, of, _ = clusters(w)
    whole = np.add.reduceat(share, e[:-1])
    w["cluster_b"] = np.log(whole).astype(np.float32)
    w["inner_b"] = np.log(share / whole[of]).astype(np.float32)
    return w


def flat(w: dict) -> np.ndarray:
    return np.concatenate([v.ravel() for v in w.values()])


def unflat(v: np.ndarray, begin: int, vocab: int) -> Weights:
    out, at = {}, 0
    for k, s in shapes(begin, vocab).items():
        n = int(np.prod(s))
        out[k], at = v[at : at + n].reshape(s), at + n
    return Weights(begin, out)


@dataclass
class Windows:
    inputs: np.ndarray  # windows x WINDOW: the token before each position
    targets: np.ndarray
    scored: np.ndarray  # whether the window scores the position


def windows(tokens: np.ndarray, lengths: np.ndarray, start: int, part: int = 1 << 15) -> Iterator[Windows]:
    """Overlapping windows over texts that follow each other in `tokens`, up to `part` at a time: each token is scored in
    exactly one window, and in order. `start` stands before every text."""
    step = WINDOW - OVERLAP
    per_text = 1 + np.maximum(0, -(-(lengths - WINDOW) // step))
    all_texts = np.repeat(np.arange(len(lengths)), per_text)
    all_nth = np.arange(len(all_texts)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    begin = np.cumsum(lengths) - lengths
    for lo in range(0, len(all_texts), part):
        text, nth = all_texts[lo : lo + part], all_nth[lo : lo + part]
        place = nth[:, None] * step + np.arange(WINDOW)[None, :]
        inside = place < lengths[text][:, None]
        at = np.where(inside, begin[text][:, None] + place, 0)
        before = np.where(place > 0, tokens[np.maximum(at - 1, 0)], start)
        scored = inside & ((nth[:, None] == 0) | (np.arange(WINDOW)[None, :] >= OVERLAP))
        yield Windows(np.where(inside, before, start), tokens[at], scored)


class _Part:
    """The network on some windows: what the head takes, for the scored positions, and the gradient back from there. Positions before `lo`
    only serve as context in all of these windows, so nothing but keys and values is made of them."""

    def __init__(self, w: Weights, inputs: np.ndarray, scored: np.ndarray, lo: int):
        self.n, self.lo, scale = len(inputs), lo, np.repeat(np.float32([1 / np.sqrt(DIM), 1]), (DIM, 2 * DIM))
        self.x = w["embed"].take(inputs, axis=0)
        self.x += w["place"]
        self.qkv = (_rows(self.x) @ (w["qkv"] * scale)).reshape(self.n, WINDOW, 3 * DIM)
        self.q, self.k, self.v = self.qkv[:, lo:, :DIM], self.qkv[..., DIM : 2 * DIM], self.qkv[..., 2 * DIM :]
        a = np.matmul(self.q, self.k.transpose(0, 2, 1))
        np.minimum(a, 40, out=a)
        np.exp(a, out=a)
        a *= _CAUSAL[lo:]
        a /= a @ np.ones((WINDOW, 1), a.dtype)
        self.a, self.y = a, np.matmul(a, self.v)
        self.at = np.flatnonzero(scored[:, lo:])
        self.h = _rows(self.y + self.x[:, lo:]).take(self.at, axis=0)
        self.r = self.h @ w["up"]
        self.r += w["up_b"]
        np.maximum(self.r, 0, out=self.r)
        self.z = self.r @ w["down"]
        self.z += self.h

    def back(self, w: Weights, dz: np.ndarray, g: dict) -> np.ndarray:
        """Adds to the gradients in g but the tokens' own; gives that of each input. dz: of the loss, by z."""
        lo, one = self.lo, np.ones(len(dz), dz.dtype)
        g["down"] += self.r.T @ dz
        du = dz @ w["down"].T
        du *= self.r > 0
        g["up"] += self.h.T @ du
        g["up_b"] += one @ du
        dh = du @ w["up"].T
        dh += dz
        dy = np.zeros_like(self.y)
        _rows(dy)[self.at] = dh
        # A softmax's gradient needs the mean of da under a, which is dy times y.
        ds = np.matmul(dy, self.v.transpose(0, 2, 1))
        ds -= (dy * self.y) @ np.ones((DIM, 1), dy.dtype)
        ds *= self.a
        d = np.empty_like(self.qkv)
        d[:, :lo, :DIM] = 0
        # self.q is scaled, this part of d is by the queries as they were before.
        np.multiply(np.matmul(ds, self.k), np.float32(1 / np.sqrt(DIM)), out=d[:, lo:, :DIM])
        d[..., DIM : 2 * DIM] = np.matmul(ds.transpose(0, 2, 1), self.q)
        d[..., 2 * DIM :] = np.matmul(self.a.transpose(0, 2, 1), dy)
        g["qkv"] += _rows(self.x).T @ _rows(d)
        dx = (_rows(d) @ w["qkv"].T).reshape(self.x.shape)
        dx[:, lo:] += dy
        g["place"] += dx.sum(0)
        return dx


def _rows(m: np.ndarray) -> np.ndarray:
    return m.reshape(-1, m.shape[-1])


def _whole_first(scored: np.ndarray) -> tuple[np.ndarray, int]:
    """The order of windows that puts those first which score some of their first OVERLAP positions, and how many these are."""
    whole = scored[:, :OVERLAP].any(1)
    return np.argsort(~whole, kind="stable"), int(whole.sum())


def _parts(n: int, whole: int) -> Iterator[tuple[slice, int]]:
    """Slices of up to PART of n windows, and from which position on each slice scores: the first `whole` windows from their first one."""
    for lo, begin, end in ((0, 0, whole), (OVERLAP, whole, n)):
        for at in range(begin, end, PART):
            yield slice(at, min(at + PART, end)), lo


def _exp(z: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """z becomes its own exponential, bounded on both sides. Where in it the targets are, and their exponents."""
    np.clip(z, -80, 80, out=z)
    at = np.arange(0, z.size, z.shape[1]) + target
    own = z.ravel()[at]
    np.exp(z, out=z)
    return at, own


def _sums(z: np.ndarray) -> np.ndarray:
    return z @ np.ones(z.shape[1], z.dtype)


def log_chances(w: Weights, tokens: np.ndarray, lengths: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Natural log chances of every token of texts that follow each other in `tokens`: that a token of its kind comes, and that it is
    this one of its kind. Their sum is the token's chance."""
    kind, rest = [np.empty(0, np.float32)], [np.empty(0, np.float32)]
    for win in windows(tokens, lengths, start, part=PART * AT_ONCE):
        order, whole = _whole_first(win.scored)
        inputs, scored, targets = win.inputs[order], win.scored[order], win.targets[order]
        place = (np.cumsum(win.scored) - 1).reshape(win.scored.shape)[order]
        out = np.empty((2, int(win.scored.sum())), np.float32)
        z = np.concatenate([_Part(w, inputs[s], scored[s], lo).z for s, lo in _parts(len(order), whole)])
        out[:, place[scored]] = _head(w, z, targets[scored])
        kind.append(out[0])
        rest.append(out[1])
    return np.concatenate(kind), np.concatenate(rest)


def _head(w: Weights, h: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Two rows: of each target the log chances of its kind, and of it among its kind."""
    e, of, first = clusters(w)
    order = np.argsort(of[target], kind="stable")
    h, target = h[order], target[order]
    cluster, begins = of[target], target < w.begin
    kinds = np.zeros((len(e) - 1, 2), h.dtype)
    kinds[:first, 0] = kinds[first:, 1] = 1
    found = np.empty((2, len(h)), h.dtype)
    for at in range(0, len(h), ROWS):
        rows = slice(at, at + ROWS)
        z = h[rows] @ w["cluster"]
        z += w["cluster_b"]
        _, own = _exp(z, cluster[rows])
        mass = z @ kinds
        mine = np.log(np.where(begins[rows], mass[:, 0], mass[:, 1]))
        found[0, rows], found[1, rows] = mine - np.log(mass[:, 0] + mass[:, 1]), own - mine
    ends = np.searchsorted(cluster, np.arange(len(e)))
    for c in np.flatnonzero(np.diff(ends)):
        inner = slice(e[c], e[c + 1])
        for at in range(ends[c], ends[c + 1], ROWS):
            rows = slice(at, min(at + ROWS, ends[c + 1]))
            z = h[rows] @ w["inner"][inner].T
            z += w["inner_b"][inner]
            _, own = _exp(z, target[rows] - e[c])
            found[1, rows] += own - np.log(_sums(z))
    out = np.empty_like(found)
    out[:, order] = found
    return out


def _softmax_gradient(z: np.ndarray, target: np.ndarray, n: int) -> float:
    """Sum of the negative log softmax at the targets; z becomes the gradient of that sum over n."""
    at, own = _exp(z, target)
    total = _sums(z)
    z *= (1 / (total * n))[:, None]
    z.ravel()[at] -= z.dtype.type(1 / n)
    return float(np.log(total).sum() - own.sum())


def gradient(w: Weights, inputs: np.ndarray, targets: np.ndarray, scored: np.ndarray, g: dict | None = None) -> tuple[dict, float]:
    """Gradient of the mean negative log chance, and that mean. g: zeros to put the gradient in."""
    g = {k: np.zeros_like(v) for k, v in w.items()} if g is None else g
    order, whole = _whole_first(scored)
    inputs, targets, scored = inputs[order], targets[order], scored[order]
    parts = [(s, _Part(w, inputs[s], scored[s], lo)) for s, lo in _parts(len(order), whole)]
    e, of, _ = clusters(w)
    t = targets[scored]
    by = np.argsort(of[t], kind="stable")
    t = t[by]
    n, cluster = max(1, len(t)), of[t]
    hz = np.concatenate([p.z for _, p in parts])[by]
    dh, loss = np.empty_like(hz), 0.0
    for at in range(0, len(t), ROWS):
        rows = slice(at, at + ROWS)
        d = hz[rows] @ w["cluster"]
        d += w["cluster_b"]
        loss += _softmax_gradient(d, cluster[rows], n)
        g["cluster"] += hz[rows].T @ d
        g["cluster_b"] += np.ones(len(d), d.dtype) @ d
        np.matmul(d, w["cluster"].T, out=dh[rows])
    ends = np.searchsorted(cluster, np.arange(len(e)))
    for c in np.flatnonzero(np.diff(ends)):
        rows, own = slice(ends[c], ends[c + 1]), slice(e[c], e[c + 1])
        inner, h = w["inner"][own], hz[rows]
        d = h @ inner.T
        d += w["inner_b"][own]
        loss += _softmax_gradient(d, t[rows] - e[c], n)
        np.matmul(d.T, h, out=g["inner"][own])
        np.matmul(np.ones(len(d), d.dtype), d, out=g["inner_b"][own])
        dh[rows] += d @ inner
    dz, at = np.empty_like(dh), 0
    dz[by] = dh
    dx = np.empty((*inputs.shape, DIM), hz.dtype)
    for s, p in parts:
        dx[s] = p.back(w, dz[at : at + len(p.z)], g)
        at += len(p.z)
    met = inputs.ravel()
    order = np.argsort(met.astype(np.uint16), kind="stable")
    met = met[order]
    first = np.flatnonzero(np.append(True, met[1:] != met[:-1]))
    g["embed"][met[first]] = np.add.reduceat(_rows(dx)[order], first)
    return g, float(loss) / n


class Adam:
    """Weights that learn; `squares` sums the squared gradients that each weight met. Weights take a step some at a time, so what one needs
    stays in the cache; those that have met no gradient yet stay where they are. `grad` is zero between steps."""

    def __init__(self, w: Weights):
        self.v, self.i = flat(w), 0
        self.w = unflat(self.v, w.begin, len(w["embed"]))
        self.m, self.s, self.squares, self.grad = (np.zeros_like(self.v) for _ in range(4))
        self.g = unflat(self.grad, w.begin, len(w["embed"]))
        self.met = [False] * -(-len(self.v) // STEP)

    def step(self, win: Windows, rate: float) -> None:
        gradient(self.w, win.inputs, win.targets, win.scored, self.g)
        self.i += 1
        # m and s hold ten and a hundred times the running means; the factors of both, and of what they lack at the start, are one number each.
        bias = np.sqrt(0.01 / (1 - 0.99**self.i))
        now, tiny = np.float32(rate * min(1, self.i / 50) * 0.1 / (1 - 0.9**self.i) / bias), np.float32(1e-8 / bias)
        for part, at in enumerate(range(0, len(self.v), STEP)):
            # Ids that don't occur have no gradient, and nothing in m and s.
            self.met[part] = self.met[part] or bool(self.grad[at : at + STEP].any())
            if not self.met[part]:
                continue
            grad, m, s, squares, v = (x[at : at + STEP] for x in (self.grad, self.m, self.s, self.squares, self.v))
            m *= np.float32(0.9)
            m += grad
            grad *= grad
            squares += grad
            s *= np.float32(0.99)
            s += grad
            np.sqrt(s, out=grad)
            grad += tiny
            np.divide(m, grad, out=grad)
            grad *= now
            v -= grad
            grad.fill(0)


def train(w: Weights, tokens: np.ndarray, lengths: np.ndarray, start: int, rate: float = 0.01, seed: int = 0, batch: int = 64) -> Weights:
    """Adam over the windows, in an order drawn from the seed; few windows are seen up to 8 times."""
    if not len(tokens):
        return w
    win = next(windows(tokens, lengths, start, part=1 << 60))
    adam = Adam(w)
    epochs = max(1, min(8, round(ENOUGH / len(win.inputs))))
    rng, steps = np.random.default_rng(seed), epochs * -(-len(win.inputs) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(win.inputs))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            adam.step(Windows(win.inputs[rows], win.targets[rows], win.scored[rows]), rate * (1 - 0.9 * (adam.i + 1) / steps))
    return adam.w


class Share:
    """Weights that learn from one share of the documents, a batch of documents at a time."""

    def __init__(self, w: Weights, start: int, documents: float, rate: float = 0.003):
        self.adam, self.start, self.documents, self.rate = Adam(w), start, documents, rate
        self.held, self.tokens, self.done, self.rng = [], 0, 0, np.random.default_rng(0)

    def add(self, tokens: np.ndarray) -> None:
        self.held.append(tokens)
        self.tokens += len(tokens)
        if self.tokens >= HELD:
            self.learn()

    def learn(self) -> None:
        if not self.held:
            return
        flat_, lengths = np.concatenate(self.held), np.array([len(x) for x in self.held])
        self.done += len(self.held)
        self.held, self.tokens = [], 0
        rate = self.rate * max(0.1, 1 - 0.9 * self.done / self.documents)
        for win in windows(flat_, lengths, self.start):
            order = self.rng.permutation(len(win.inputs))
            for at in range(0, len(order), BATCH):
                rows = order[at : at + BATCH]
                self.adam.step(Windows(win.inputs[rows], win.targets[rows], win.scored[rows]), rate)

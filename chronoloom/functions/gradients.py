"""Forward and backward passes of the trained cells, on the rows of one Arrow batch.

A forward pass returns its result and what the backward pass needs; a backward pass takes
the gradient of the result and returns that of the inputs, and adds that of the weights to
``g``. Weights are dictionaries of small arrays, nested ones flattened to dotted names."""

from __future__ import annotations

import numpy as np

Weights = dict[str, np.ndarray]


def flattened(weights: dict, prefix: str = "") -> Weights:
    """Nested dictionaries and lists as one, by dotted names, in the order of the names."""
    out: Weights = {}
    for key, value in weights.items() if isinstance(weights, dict) else enumerate(weights):
        if isinstance(value, (dict, list)):
            out |= flattened(value, f"{prefix}{key}.")
        else:
            out[f"{prefix}{key}"] = np.asarray(value, dtype=float)
    return dict(sorted(out.items()))


def part(weights: Weights, prefix: str) -> Weights:
    """The weights below a prefix."""
    return {k[len(prefix) + 1 :]: v for k, v in weights.items() if k.startswith(f"{prefix}.")}


def within(g: Weights, prefix: str) -> Weights:
    """Gradients of a part under its prefix."""
    return {f"{prefix}.{k}": v for k, v in g.items()}


def zeros(weights: Weights) -> Weights:
    return {k: np.zeros_like(v) for k, v in weights.items()}


def packed(weights: Weights) -> np.ndarray:
    return np.concatenate([weights[k].ravel() for k in sorted(weights)]) if weights else np.zeros(0)


def unpacked(values: np.ndarray, like: Weights) -> Weights:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = values[at : at + like[k].size].reshape(like[k].shape)
        at += like[k].size
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def linear_back(dy: np.ndarray, x: np.ndarray, w: Weights, g: Weights, matrix: str, bias: str | None = None) -> np.ndarray:
    g[matrix] += x.T @ dy
    if bias:
        g[bias] += dy.sum(axis=0)
    return dy @ w[matrix].T


def gru(x: np.ndarray, h: np.ndarray, w: Weights):
    """Gates reset, update, new of rows x and states h; w: wi, wh, bi, bh."""
    d = h.shape[1]
    a, b = x @ w["wi"] + w["bi"], h @ w["wh"] + w["bh"]
    r, z = sigmoid(a[:, :d] + b[:, :d]), sigmoid(a[:, d : 2 * d] + b[:, d : 2 * d])
    n = np.tanh(a[:, 2 * d :] + r * b[:, 2 * d :])
    return (1 - z) * n + z * h, (x, h, b[:, 2 * d :], r, z, n)


def gru_back(dy: np.ndarray, kept, w: Weights, g: Weights):
    x, h, b_new, r, z, n = kept
    dn = dy * (1 - z) * (1 - n * n)
    dz = dy * (h - n) * z * (1 - z)
    dr = dn * b_new * r * (1 - r)
    da = np.concatenate([dr, dz, dn], axis=1)
    db = np.concatenate([dr, dz, dn * r], axis=1)
    return linear_back(da, x, w, g, "wi", "bi"), linear_back(db, h, w, g, "wh", "bh") + dy * z


def lstm(x: np.ndarray, h: np.ndarray, c: np.ndarray, w: Weights):
    """Gates input, forget, cell, output."""
    s = x @ w["wi"] + w["bi"] + h @ w["wh"] + w["bh"]
    i, f, m, o = np.split(s, 4, axis=1)
    i, f, m, o = sigmoid(i), sigmoid(f), np.tanh(m), sigmoid(o)
    new = f * c + i * m
    t = np.tanh(new)
    return (o * t, new), (x, h, c, i, f, m, o, t)


def lstm_back(dh: np.ndarray, dc: np.ndarray, kept, w: Weights, g: Weights):
    x, h, c, i, f, m, o, t = kept
    dc = dc + dh * o * (1 - t * t)
    ds = np.concatenate([dc * m * i * (1 - i), dc * c * f * (1 - f), dc * i * (1 - m * m), dh * t * o * (1 - o)], axis=1)
    dx = linear_back(ds, x, w, g, "wi", "bi")
    return dx, linear_back(ds, h, w, g, "wh", "bh"), dc * f


def tgcn(x: np.ndarray, h: np.ndarray, w: Weights):
    """Gates from thirds of x, each joined to the state: u, r and the candidate c."""
    xu, xr, xc = np.split(x, 3, axis=1)
    iu, ir = np.concatenate([xu, h], axis=1), np.concatenate([xr, h], axis=1)
    u, r = sigmoid(iu @ w["u"] + w["bu"]), sigmoid(ir @ w["r"] + w["br"])
    ic = np.concatenate([xc, r * h], axis=1)
    c = np.tanh(ic @ w["c"] + w["bc"])
    return u * h + (1 - u) * c, (h, iu, ir, ic, u, r, c)


def tgcn_back(dy: np.ndarray, kept, w: Weights, g: Weights):
    h, iu, ir, ic, u, r, c = kept
    d = h.shape[1]
    dic = linear_back(dy * (1 - u) * (1 - c * c), ic, w, g, "c", "bc")
    diu = linear_back(dy * (h - c) * u * (1 - u), iu, w, g, "u", "bu")
    dir_ = linear_back(dic[:, d:] * h * r * (1 - r), ir, w, g, "r", "br")
    dx = np.concatenate([diu[:, :d], dir_[:, :d], dic[:, :d]], axis=1)
    return dx, dy * u + diu[:, d:] + dir_[:, d:] + dic[:, d:] * r


def time_codes(dt: np.ndarray, dim: int) -> np.ndarray:
    """cos(dt * 10 ** (-9 i / (dim - 1))) for i below dim."""
    return np.cos(dt[:, None] * 10.0 ** (-9.0 * np.arange(dim) / max(1, dim - 1))[None, :])


def attention(own: np.ndarray, near: np.ndarray, dt: np.ndarray, count: np.ndarray, w: Weights, heads: int, dim_time: int):
    """A vector for each root: several heads over its neighbours, whose rows ``near``
    (features of node and event) follow one another, ``count`` of them for each root."""
    d = w["v"].shape[1]
    each = d // heads
    root = np.repeat(np.arange(len(own)), count)
    query = np.concatenate([own, time_codes(np.zeros(len(own)), dim_time)], axis=1)
    key = np.concatenate([near, time_codes(dt, dim_time)], axis=1)
    q, k, v = query @ w["q"] + w["bq"], key @ w["k"] + w["bk"], key @ w["v"] + w["bv"]
    score = (q[root] * k).reshape(-1, heads, each).sum(axis=2)
    steep = np.where(score < 0, 0.2, 1.0)
    some = np.flatnonzero(count)
    at = (np.cumsum(count) - count)[some]
    a = np.zeros((len(near), heads))
    if len(at):
        raised = score * steep
        top = np.maximum.reduceat(raised, at, axis=0)
        raised = np.exp(raised - np.repeat(top, count[some], axis=0))
        a = raised / np.repeat(np.add.reduceat(raised, at, axis=0), count[some], axis=0)
    agg = np.zeros((len(own), d))
    if len(at):
        agg[some] = np.add.reduceat((a[:, :, None] * v.reshape(-1, heads, each)).reshape(-1, d), at, axis=0)
    joined = np.concatenate([agg, own], axis=1)
    y = joined @ w["out"] + w["bout"]
    live = np.maximum(y, 0)
    spread = np.sqrt(live.var(axis=1, keepdims=True) + 1e-5)
    out = (live - live.mean(axis=1, keepdims=True)) / spread
    return out, (query, key, q, k, v, root, steep, a, some, at, count, joined, y, spread, out, heads)


def attention_back(dy: np.ndarray, kept, w: Weights, g: Weights) -> None:
    query, key, q, k, v, root, steep, a, some, at, count, joined, y, spread, out, heads = kept
    d = v.shape[1]
    each = d // heads
    dlive = (dy - dy.mean(axis=1, keepdims=True) - out * (dy * out).mean(axis=1, keepdims=True)) / spread
    djoined = linear_back(dlive * (y > 0), joined, w, g, "out", "bout")
    if not len(at):
        return
    dagg = djoined[:, :d][root].reshape(-1, heads, each)
    dv = (a[:, :, None] * dagg).reshape(-1, d)
    da = (dagg * v.reshape(-1, heads, each)).sum(axis=2)
    total = np.repeat(np.add.reduceat(a * da, at, axis=0), count[some], axis=0)
    ds = np.repeat(a * (da - total) * steep, each, axis=1)
    dq = np.zeros_like(q)
    dq[some] = np.add.reduceat(ds * k, at, axis=0)
    linear_back(dq, query, w, g, "q", "bq")
    linear_back(ds * q[root], key, w, g, "k", "bk")
    linear_back(dv, key, w, g, "v", "bv")


def link(src: np.ndarray, dst: np.ndarray, w: Weights):
    """Logits of pairs: out(relu(src_map(src) + dst_map(dst)))."""
    y = src @ w["src"] + w["bsrc"] + dst @ w["dst"] + w["bdst"]
    live = np.maximum(y, 0)
    return (live @ w["out"] + w["bout"])[:, 0], (src, dst, y, live)


def link_back(dlogit: np.ndarray, kept, w: Weights, g: Weights):
    src, dst, y, live = kept
    dy = linear_back(dlogit[:, None], live, w, g, "out", "bout") * (y > 0)
    return linear_back(dy, src, w, g, "src", "bsrc"), linear_back(dy, dst, w, g, "dst", "bdst")


def cross_entropy(logit: np.ndarray, label: float) -> tuple[np.ndarray, np.ndarray]:
    """Binary cross-entropy of each logit and its derivative."""
    return np.maximum(logit, 0) - logit * label + np.log1p(np.exp(-np.abs(logit))), sigmoid(logit) - label

"""A convolutional network over characters, in numpy: embedding, one convolution, pooling by region, two dense layers.

Input: windows of ``LEFT`` characters before a candidate, ``VALUE`` of it and ``RIGHT`` after it, as codes.  The strongest
answer of each filter is taken over each region apart, and the mean over the value, so that a cue before a value and the
look of the value itself are weighed separately.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

LEFT, VALUE, RIGHT = 24, 48, 8
LENGTH = LEFT + VALUE + RIGHT
WIDTH, DIMS, FILTERS, HIDDEN = 5, 8, 24, 24
CODES = 98  # 0 padding, 1 to 95 printable ASCII, 96 other ASCII, 97 the rest
_CENTRE = np.arange(LENGTH - WIDTH + 1) + WIDTH // 2
_REGION = np.r_[np.zeros(LEFT, int), np.ones(VALUE, int), np.full(RIGHT, 2)]
REGIONS = [slice(int(np.flatnonzero(_REGION[_CENTRE] == r)[0]), int(np.flatnonzero(_REGION[_CENTRE] == r)[-1]) + 1) for r in range(3)]


def codes(text: str) -> np.ndarray:
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    return np.where(a > 126, np.where(a > 127, 97, 96), np.where(a >= 32, a - 31, 96)).astype(np.uint8)


_ASCII = codes("".join(map(chr, range(128)))).tobytes().ljust(256, b"\0")


def packed(left: str, value: str, right: str) -> bytes:
    """One input row as bytes: the end of ``left``, the beginning of ``value`` and of ``right``, padded."""
    parts = [t.encode().translate(_ASCII) if t.isascii() else codes(t).tobytes() for t in (left[-LEFT:], value[:VALUE], right[:RIGHT])]
    return parts[0].rjust(LEFT, b"\0") + parts[1].ljust(VALUE, b"\0") + parts[2].ljust(RIGHT, b"\0")


def unpacked(rows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(rows), np.uint8).reshape(-1, LENGTH)


def window(left: str, value: str, right: str) -> np.ndarray:
    return unpacked([packed(left, value, right)])[0]


def start(seed: int) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    w = lambda *shape: (r.standard_normal(shape) * np.sqrt(2 / np.prod(shape[:-1]))).astype(np.float32)
    z = lambda n: np.zeros(n, np.float32)
    return {
        "emb": (r.standard_normal((CODES, DIMS)) * 0.5).astype(np.float32), "region": z((3, DIMS)), "conv": w(WIDTH * DIMS, FILTERS), "conv_b": z(FILTERS),
        "dense": w(4 * FILTERS, HIDDEN), "dense_b": z(HIDDEN), "out": w(HIDDEN, 1), "out_b": z(1),
    }


def _convolved(p: dict[str, np.ndarray], ids: np.ndarray):
    """Which places are not padding, what the filters read there and answer; their answers by place."""
    x = np.take(p["emb"], ids, axis=0) + p["region"][_REGION]
    x *= (ids > 0)[..., None]
    on = ids[:, _CENTRE] > 0
    cols = np.take(np.lib.stride_tricks.sliding_window_view(x.ravel(), WIDTH * DIMS)[::DIMS], _begin(on), axis=0)
    act = np.maximum(cols @ p["conv"] + p["conv_b"], 0)
    a = np.zeros((*on.shape, FILTERS), act.dtype)
    a.reshape(-1, FILTERS)[np.flatnonzero(on)] = act
    return on, cols, act, a


def _begin(on: np.ndarray) -> np.ndarray:
    """Where the filter that stands at each of these places begins, in rows side by side."""
    i, j = np.nonzero(on)
    return i * LENGTH + j


def _features(a: np.ndarray, ids: np.ndarray):
    n = np.maximum((ids[:, LEFT : LEFT + VALUE] > 0).sum(1), 1)[:, None].astype(np.float32)
    return n, np.concatenate([*(a[:, r].max(1) for r in REGIONS), a[:, REGIONS[1]].sum(1) / n], axis=1)


def logits(p: dict[str, np.ndarray], ids: np.ndarray, rows: int = 512) -> np.ndarray:
    out = [np.empty(0, np.float32)]
    for i in range(0, len(ids), rows):
        f = _features(_convolved(p, ids[i : i + rows])[-1], ids[i : i + rows])[-1]
        out.append((np.maximum(f @ p["dense"] + p["dense_b"], 0) @ p["out"] + p["out_b"])[:, 0])
    return np.concatenate(out)


def gradients(p: dict[str, np.ndarray], ids: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean logistic loss."""
    on, cols, act, a = _convolved(p, ids)
    n, f = _features(a, ids)
    h = np.maximum(f @ p["dense"] + p["dense_b"], 0)
    z = (h @ p["out"] + p["out_b"])[:, 0]
    d = ((1 / (1 + np.exp(-z)) - y) / len(y)).astype(np.float32)[:, None]
    g = {"out": h.T @ d, "out_b": d.sum(0)}
    dh = d @ p["out"].T * (h > 0)
    g |= {"dense": f.T @ dh, "dense_b": dh.sum(0)}
    df = dh @ p["dense"].T
    da = np.zeros_like(a)
    for k, r in enumerate(REGIONS):
        np.put_along_axis(da[:, r], a[:, r].argmax(1)[:, None], df[:, None, k * FILTERS : (k + 1) * FILTERS], 1)
    da[:, REGIONS[1]] += (df[:, 3 * FILTERS :] / n)[:, None]
    da = np.take(da.reshape(-1, FILTERS), np.flatnonzero(on), axis=0) * (act > 0)
    g |= {"conv": cols.T @ da, "conv_b": da.sum(0)}
    dcols = np.zeros((ids.size, WIDTH * DIMS), da.dtype)
    dcols[_begin(on)] = da @ p["conv"].T
    dx = dcols[:, :DIMS].copy()
    for k in range(1, WIDTH):
        dx[k:] += dcols[:-k, k * DIMS : (k + 1) * DIMS]
    dx *= ids.reshape(-1, 1) > 0
    emb = np.stack([np.bincount(ids.ravel(), w, CODES) for w in dx.T], axis=1).astype(p["emb"].dtype)
    by = dx.reshape(*ids.shape, DIMS).sum(0)
    return g | {"emb": emb, "region": np.stack([by[_REGION == r].sum(0) for r in range(3)])}


@dataclass
class State:
    """Parameters and their first and second moments."""

    net: dict[str, np.ndarray]
    m: dict[str, np.ndarray]
    v: dict[str, np.ndarray]

    @classmethod
    def begin(cls, seed: int) -> State:
        p = start(seed)
        return cls(p, {k: np.zeros_like(w) for k, w in p.items()}, {k: np.zeros_like(w) for k, w in p.items()})


def flat(s: State) -> np.ndarray:
    return np.concatenate([w.ravel() for p in (s.net, s.m, s.v) for w in p.values()]).astype(np.float64)


def unflat(x: np.ndarray) -> State:
    of = start(0)
    cuts = np.cumsum([w.size for _ in range(3) for w in of.values()])[:-1]
    parts = iter(np.split(x.astype(np.float32), cuts))
    return State(*({k: next(parts).reshape(w.shape) for k, w in of.items()} for _ in range(3)))


def train(s: State, ids: np.ndarray, y: np.ndarray, first: int, steps: int, of: int, seed: int, batch: int = 128, rate: float = 2e-3) -> State:
    """``steps`` of Adam from step ``first`` of ``of``; half of each batch is of either class, in a fixed mixed order that goes on where
    the steps before left it and begins again at its end."""
    p, m, v = ({k: w.copy() for k, w in d.items()} for d in (s.net, s.m, s.v))
    r, half = np.random.default_rng(seed), batch // 2
    orders = [r.permutation(np.flatnonzero(y == c)) for c in (0, 1)]
    for t in range(first + 1, first + steps + 1):
        some = np.concatenate([o[np.arange((t - 1) * half, t * half) % len(o)] for o in orders])
        for k, g in gradients(p, ids[some], y[some]).items():
            m[k] += 0.1 * (g - m[k])
            v[k] += 0.001 * (g * g - v[k])
            p[k] -= rate * (1 - t / of) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return State(p, m, v)

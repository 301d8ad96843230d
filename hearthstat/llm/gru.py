"""A gated recurrent language model in numpy: truncated backpropagation and a class-factored softmax.

Tokens are words of classes, id = class * ``LEAVES`` + word, and p(token | past) = p(class | state) * p(word | class, state).
The unit is gated with diagonal recurrent weights: z = sigmoid(a + p h), c = tanh(b + q h), h' = h + z (c - h), where a and
b are learned for each token; without matrices between states, most of a step's work is the softmax.

Sequences (whole documents) are laid end to end in streams that run side by side; the state is zero where a sequence
begins and is carried over windows of ``STEPS`` tokens, over a sequence's whole length.  Gradients stop at a window's
start.  Arrays hold features by rows and tokens by columns, so that numpy's inner loops are long.
"""

from __future__ import annotations

import numpy as np

STEPS = 24
LEAVES = 64
HIDDEN = 16
CHUNK = 512  # columns of logits that stay in a core's cache
MOST = 3.0  # of a weight of the softmaxes and of the recurrence (biases apart), so that no exponential overflows


def shapes(classes: int) -> dict[str, tuple[int, ...]]:
    """E: gate (first half) and candidate of each token; R: recurrent weights of both; C, V: softmaxes from (state, 1)."""
    h = HIDDEN
    return {"E": (2 * h, classes * LEAVES), "R": (2 * h, 1), "C": (classes, h + 1), "V": (classes * LEAVES, h + 1)}


def start(counts: np.ndarray) -> np.ndarray:
    """Small fixed pseudo-random weights; the biases give the model of the counts (classes x words; below 0: no word)."""
    g, h, classes = np.random.default_rng(7), HIDDEN, len(counts)
    x = (g.standard_normal(sum(int(np.prod(s)) for s in shapes(classes).values())) * 0.015).astype(np.float32)
    m = views(x, classes)
    m["E"] *= 20
    m["E"][:h] -= 1
    m["R"][:] = 0
    n = np.maximum(counts, 0) + 1.0
    m["C"][:, -1] = np.log(n.sum(1) / n.sum())
    m["V"][:, -1] = np.where(counts < 0, -30, np.log(n / n.sum(1, keepdims=True))).ravel()
    return x


def views(x: np.ndarray, classes: int) -> dict[str, np.ndarray]:
    """Weights by name, as views into one array."""
    out, at = {}, 0
    for k, s in shapes(classes).items():
        n = int(np.prod(s))
        out[k] = x[at : at + n].reshape(s)
        at += n
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.minimum(x, 80, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _steps(m, rows, news, h):
    """States before each token of a window (and a row of ones), gates, candidates and the state after it."""
    hidden, ids = HIDDEN, np.concatenate(rows)
    pre = np.take(m["E"], ids, axis=1)
    states = np.empty((hidden + 1, len(ids)), h.dtype)
    states[-1] = 1
    at, h, (p, q) = 0, h.copy(), np.split(m["R"], 2)
    for new in news:
        n = len(new)
        own = slice(at, at + n)
        before, z, c = states[:-1, own], pre[:hidden, own], pre[hidden:, own]
        before[:] = h[:, :n]
        if new.any():
            before[:, new] = 0
        z += p * before
        z[:] = _sigmoid(z.copy())
        c += q * before
        np.tanh(c, out=c)
        after = c - before
        after *= z
        after += before
        h[:, :n] = after
        at += n
    return ids, states, pre[:hidden], pre[hidden:], h


def _outputs(m, states, ids, grads=None):
    """Natural log-probabilities; with ``grads``, also the gradients of both softmaxes and of the states.

    Works on tokens in order of id, so that a class's, and a word's, are neighbours.  Gradients of a softmax are those of
    its normaliser less the sums of states by target.
    """
    order = np.argsort(ids.astype(np.uint16), kind="stable")
    ids, s = ids[order], np.take(states, order, axis=1)
    of = ids // LEAVES
    logp = np.empty(len(ids), states.dtype)
    back = np.empty((HIDDEN, len(ids)), s.dtype) if grads is not None else None

    def softmax(w, g, part, target):
        logits = w @ s[:, part]
        own = logits[target, np.arange(len(target))]
        np.exp(logits, out=logits)  # logits start as logarithms of probabilities and stay near them, see ``MOST``
        total = logits.sum(axis=0)
        if g is not None:
            share = 1 / total
            g += logits @ (s[:, part] * share).T
            back_part = w[:, :-1].T @ logits
            back_part *= share
            return own - np.log(total), back_part
        return own - np.log(total), None

    for i in range(0, len(ids), CHUNK):
        part = slice(i, i + CHUNK)
        logp[part], d = softmax(m["C"], None if grads is None else grads["C"], part, of[part])
        if grads is not None:
            back[:, part] = d
    edges = np.searchsorted(of, np.arange(len(m["C"]) + 1)).tolist()
    for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        words = slice(k * LEAVES, (k + 1) * LEAVES)
        for i in range(a, b, CHUNK):
            part = slice(i, min(b, i + CHUNK))
            lp, d = softmax(m["V"][words], None if grads is None else grads["V"][words], part, ids[part] - k * LEAVES)
            logp[part] += lp
            if grads is not None:
                back[:, part] += d
    out = np.empty_like(logp)
    out[order] = logp
    if grads is None:
        return out, None
    first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
    sums, word = np.add.reduceat(s, first, axis=1), ids[first]
    grads["V"][word] -= sums.T
    np.subtract.at(grads["C"], word // LEAVES, sums.T)
    back -= np.repeat((m["C"][word // LEAVES, :-1] + m["V"][word, :-1]).T, np.diff(np.r_[first, len(ids)]), axis=1)
    dealt = np.empty_like(back)
    dealt[:, order] = back
    return out, (dealt, order, first, word)


def _windows(tokens, new, begins, lengths):
    """Places, ids and marks of new sequences, ``STEPS`` at a time; streams come by falling length."""
    longest = int(lengths.max(initial=0))
    for t0 in range(0, longest, STEPS):
        running = [int(np.searchsorted(-lengths, -t, side="left")) for t in range(t0, min(longest, t0 + STEPS))]
        at = [begins[:n] + t0 + i for i, n in enumerate(running)]
        yield at, [tokens[a] for a in at], [new[a] for a in at]


def score(m: dict, sequences: list[np.ndarray], streams: int = 512) -> np.ndarray:
    """Natural log-probability of each whole sequence."""
    size = np.array([len(s) for s in sequences], np.int64)
    if not size.sum():
        return np.zeros(len(sequences))
    dealt = [[] for _ in range(max(1, min(streams, int(size.sum() // max(size.max(), STEPS)))))]
    loads = np.zeros(len(dealt), np.int64)
    for i in np.argsort(-size, kind="stable").tolist():  # the longest first, each to the shortest stream
        k = int(loads.argmin())
        dealt[k].append(i)
        loads[k] += size[i]
    order = [i for k in np.argsort(-loads, kind="stable").tolist() for i in dealt[k]]
    lengths = np.sort(loads)[::-1]
    tokens, owner = np.concatenate([sequences[i] for i in order]), np.repeat(order, size[order])
    new = np.zeros(len(tokens), bool)
    new[(np.cumsum(size[order]) - size[order])[size[order] > 0]] = True
    out, h = np.zeros(len(sequences)), np.zeros((HIDDEN, len(dealt)), m["E"].dtype)
    for at, rows, news in _windows(tokens, new, np.cumsum(lengths) - lengths, lengths):
        ids, states, _, _, h = _steps(m, rows, news, h)
        logp, _ = _outputs(m, states, ids)
        out += np.bincount(owner[np.concatenate(at)], weights=logp, minlength=len(out))
    return out


def train(weights: np.ndarray, classes: int, sequences: list[np.ndarray], state: dict, rate: float = 0.015, streams: int = 512) -> None:
    """One pass in the given order, in place; ``state`` holds Adam's moments and goes on over calls.

    The sequences are laid end to end and cut into equal streams; one that a cut divides starts anew there.
    """
    m = views(weights, classes)
    tokens = np.concatenate(sequences)
    size = np.array([len(s) for s in sequences])
    new = np.zeros(len(tokens), bool)
    new[(np.cumsum(size) - size)[size > 0]] = True
    count = max(1, min(streams, len(tokens) // STEPS))
    lengths = np.full(count, len(tokens) // count)
    lengths[: len(tokens) % count] += 1
    begins = np.cumsum(lengths) - lengths
    new[begins] = True
    hidden = HIDDEN
    h = np.zeros((hidden, count), m["E"].dtype)
    p, q = np.split(m["R"], 2)
    for _, rows, news in _windows(tokens, new, begins, lengths):
        slopes = np.zeros_like(weights)
        g = views(slopes, classes)
        ids, states, z, c, after = _steps(m, rows, news, h)
        _, (back, order, first, word) = _outputs(m, states, ids, g)
        # With d the gradient of the state after a token, d * by_gate and d * by_new are those of a and b, d * kept that of the state before.
        by_gate, by_new = c - states[:-1], 1 - c * c
        kept = 1 - z
        by_gate *= z
        by_gate *= kept
        by_new *= z
        kept += p * by_gate
        kept += q * by_new
        d = np.zeros((hidden, len(ids)), h.dtype)
        dh, end = np.zeros_like(h), len(ids)
        for new_here in reversed(news):
            n = len(new_here)
            own = slice(end - n, end)
            d[:, own] = dh[:, :n]
            x = dh[:, :n] * kept[:, own]
            x += back[:, own]
            if new_here.any():
                x[:, new_here] = 0
            dh[:, :n] = x
            end -= n
        by_gate *= d
        by_new *= d
        g["R"][:hidden, 0] = (by_gate * states[:-1]).sum(1)
        g["R"][hidden:, 0] = (by_new * states[:-1]).sum(1)
        for half, x in ((slice(hidden), by_gate), (slice(hidden, None), by_new)):
            g["E"][half, word] = np.add.reduceat(np.take(x, order, axis=1), first, axis=1)
        h = after
        _adam(weights, slopes, state, rate, max(len(ids), 1000))
        for own in (m["R"], m["C"][:, :-1], m["V"][:, :-1]):
            np.clip(own, -MOST, MOST, out=own)


def _adam(weights, slopes, state, rate, n) -> None:
    state["n"] = t = state.get("n", 0) + 1
    means, squares = state.setdefault("means", np.zeros_like(weights)), state.setdefault("squares", np.zeros_like(weights))
    step = rate * np.sqrt(1 - 0.99**t) / (1 - 0.9**t) / np.sqrt(1 + t / 200)
    for i in range(0, len(weights), 1 << 14):  # blocks that stay in a core's cache
        p, d, a, b = (x[i : i + (1 << 14)] for x in (weights, slopes, means, squares))
        d /= n
        np.clip(d, -0.1, 0.1, out=d)
        a *= 0.9
        a += 0.1 * d
        b *= 0.99
        d *= d
        d *= 0.01
        b += d
        np.sqrt(b, out=d)
        d += 1e-6
        np.divide(a, d, out=d)
        d *= step
        p -= d

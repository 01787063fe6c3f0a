"""The log-bilinear model itself, in numpy: contexts, noise-contrastive gradients, Adam, normalised scores.

The score of class w after a context is r[w].h + b[w], where h = c1 * q[one before] + c2 * q[two before] + c3 * (mean of q over the
BAG classes before those). A text follows two ends of a text, and nothing (zeros) before these. Texts are laid out with that
room before each, so all contexts, and what flows back to them, are slices.
"""

from __future__ import annotations

import numpy as np

SIZE, BAG, NOISE, CHUNK, SEED = 16, 8, 128, 2048, 20240517
KEYS = ("q", "r", "c", "b")
Params = dict[str, np.ndarray]


def start(unigram: np.ndarray) -> Params:
    rng = np.random.default_rng(SEED)
    n = len(unigram)
    draw = lambda: (rng.standard_normal((n, SIZE)) * 0.3).astype(np.float32)
    p = {"q": draw(), "r": draw(), "c": np.ones((3, SIZE), np.float32), "b": np.log(unigram + 1e-12).astype(np.float32)}
    p["q"][-1] = 0  # the class of unknown words: no training text has it
    return p


def packed(p: Params) -> bytes:
    return np.concatenate([p[k].ravel() for k in KEYS]).astype("<f8").tobytes()


def unpacked(b: bytes, classes: int) -> Params:
    v, n = np.frombuffer(b, "<f8"), classes * SIZE
    return {"q": v[:n].reshape(classes, SIZE), "r": v[n : 2 * n].reshape(classes, SIZE), "c": v[2 * n : 2 * n + 3 * SIZE].reshape(3, SIZE), "b": v[2 * n + 3 * SIZE :]}


def laid_out(c: np.ndarray, counts: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes with 2 + BAG places before each text (nothing, which is class number `classes`, and two ends), and where each token stands."""
    room = 2 + BAG
    before = room * (1 + np.arange(len(counts)))
    real = np.arange(len(c)) + np.repeat(before, counts)
    out = np.full(len(c) + room * len(counts), classes, np.int64)
    out[real] = c
    first = np.cumsum(counts) - counts + before
    out[first - 1] = out[first - 2] = 0
    return out, real


def contexts(p: Params, laid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The class one before, two before, and the bag, of each place from 2 + BAG on."""
    e = np.concatenate([p["q"], np.zeros((1, SIZE), p["q"].dtype)])[laid]
    n = len(laid) - 2 - BAG
    return e[BAG + 1 : BAG + 1 + n], e[BAG : BAG + n], eights(e)[:n] * np.float32(1 / BAG)


def eights(e: np.ndarray) -> np.ndarray:
    """Sums of 8 rows from each one on."""
    for step in (1, 2, 4):
        e = e[:-step] + e[step:]
    return e


def by_class(c: np.ndarray, rows: np.ndarray, classes: int) -> np.ndarray:
    """Sums of rows by class."""
    out = np.zeros((classes, *rows.shape[1:]))
    if len(c):
        order = np.argsort(c.astype(np.uint16), kind="stable")
        own = c[order]
        begin = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        out[own[begin]] = np.add.reduceat(rows[order], begin, axis=0)
    return out


def noise_of(unigram: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """NOISE classes drawn evenly along the noise distribution from a random offset, and the log of NOISE times its probabilities."""
    p = unigram**0.75 + 1e-12
    p[-1] = 1e-12
    p /= p.sum()
    at = (np.arange(NOISE) + np.random.default_rng([SEED, step]).random()) / NOISE
    return np.minimum(np.searchsorted(np.cumsum(p), at), len(p) - 1), np.log(NOISE * p).astype(np.float32)


def gradient(p: Params, c: np.ndarray, counts: np.ndarray, drawn: np.ndarray, log_noise: np.ndarray) -> Params:
    """Of the noise-contrastive loss, summed over the tokens of whole texts."""
    classes, n, room = len(p["b"]), len(c), 2 + BAG
    laid, real = laid_out(c, counts, classes)
    one, two, bag = contexts(p, laid)
    context = (p["c"][0] * one + p["c"][1] * two + p["c"][2] * bag)[real - room]
    dh = np.zeros((len(laid) + room, SIZE), np.float32)
    own, dr = np.empty(n, np.float32), np.empty((n, SIZE), np.float32)
    noise_r, noise_b = np.zeros((len(drawn), SIZE)), np.zeros(len(drawn))
    r_drawn, b_own = p["r"][drawn], p["b"] - log_noise
    b_drawn = b_own[drawn]
    for at in range(0, n, CHUNK):
        s = slice(at, at + CHUNK)
        h, r = context[s], p["r"][c[s]]
        d_own = 1 / (1 + np.exp(-(np.einsum("ij,ij->i", h, r) + b_own[c[s]]))) - 1
        d_noise = h @ r_drawn.T
        d_noise += b_drawn
        np.negative(d_noise, out=d_noise)
        np.exp(d_noise, out=d_noise)
        d_noise += 1
        np.reciprocal(d_noise, out=d_noise)
        dh[real[s]] = d_own[:, None] * r + d_noise @ r_drawn
        dr[s] = d_own[:, None] * h
        own[s] = d_own
        noise_r += d_noise.T @ h
        noise_b += d_noise.sum(axis=0)
    g_r, g_b = by_class(c, dr, classes), np.bincount(c, own, classes)
    np.add.at(g_r, drawn, noise_r)
    np.add.at(g_b, drawn, noise_b)
    m = len(laid)
    g_c = np.stack([np.einsum("ij,ij->j", dh[room:m], x, dtype=np.float64) for x in (one, two, bag)])
    # what flows back to each place: as one before, two before, and in a bag
    back = p["c"][0] * dh[1 : m + 1] + p["c"][1] * dh[2 : m + 2] + p["c"][2] * np.float32(1 / BAG) * eights(dh[3:])[:m]
    g_q = by_class(laid, back, classes + 1)[:-1]
    g_q[-1] = 0
    return {"q": g_q, "r": g_r, "c": g_c, "b": g_b}


class Adam:
    def __init__(self, p: Params, rate: float, steps: int):
        self.p, self.rate, self.steps, self.step = p, rate, steps, 0
        self.m, self.v = ({k: np.zeros(x.shape) for k, x in p.items()} for _ in range(2))

    def move(self, g: Params, tokens: int) -> None:
        self.step += 1
        rate = self.rate * (1 - (self.step - 1) / self.steps)
        for k in KEYS:
            d = g[k] / max(tokens, 1)
            self.m[k] = 0.9 * self.m[k] + 0.1 * d
            self.v[k] = 0.98 * self.v[k] + 0.02 * d * d
            by = self.m[k] / (1 - 0.9**self.step) / (np.sqrt(self.v[k] / (1 - 0.98**self.step)) + 1e-8)
            self.p[k] = (self.p[k] - rate * by).astype(np.float32)


def log_probabilities(p: Params, c: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Natural log of each token's class probability after its context; the unknown class has none and is left out of the sum."""
    out, room = np.empty(len(c)), 2 + BAG
    laid, real = laid_out(c, counts, len(p["b"]))
    one, two, bag = contexts(p, laid)
    context = np.ones((len(c), SIZE + 1), np.float32)
    context[:, :SIZE] = (p["c"][0] * one + p["c"][1] * two + p["c"][2] * bag)[real - room]
    r = np.concatenate([p["r"], p["b"][:, None]], axis=1)[:-1].T.astype(np.float32)
    longest = np.sqrt((r**2).sum(axis=0).max())
    for at in range(0, len(c), CHUNK):
        h, own_class = context[at : at + CHUNK], np.minimum(c[at : at + CHUNK], r.shape[1] - 1)
        score = h @ r
        own = score[np.arange(len(score)), own_class].astype(np.float64)
        if np.sqrt(np.einsum("ij,ij->i", h, h).max()) * longest > 80:  # an exponential could overflow
            top = score.max(axis=1)
            score -= top[:, None]
            own -= top
        np.exp(score, out=score)
        out[at : at + CHUNK] = own - np.log(score @ np.ones(r.shape[1], np.float32))
    return out


def centroids(x: np.ndarray, weight: np.ndarray, k: int, rounds: int = 20) -> np.ndarray:
    """k-means of unit vectors, from the heaviest one and then the ones farthest from all so far."""
    c = [x[weight.argmax()]]
    far = ((x - c[0]) ** 2).sum(axis=1)
    while len(c) < min(k, len(x)):
        c.append(x[(far * weight).argmax()])
        far = np.minimum(far, ((x - c[-1]) ** 2).sum(axis=1))
    out = np.array(c)
    for _ in range(rounds):
        own = nearest(x, out)
        for j in range(len(out)):
            if (m := own == j).any():
                out[j] = (x[m] * weight[m, None]).sum(axis=0) / weight[m].sum()
    return out


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x @ c.T - (c**2).sum(axis=1) / 2).argmax(axis=1)


def unit_rows(x: np.ndarray) -> np.ndarray:
    return x / (np.sqrt((x.astype(np.float64) ** 2).sum(axis=1, keepdims=True)) + 1e-9)


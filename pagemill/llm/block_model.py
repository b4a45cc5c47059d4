"""Bidirectional LSTM over the blocks of a page, in numpy, forward and backward."""

from __future__ import annotations

from pathlib import Path

import numpy as np

from pagemill.llm import page_blocks
from pagemill.llm.page_blocks import KINDS, NUMBERS, PATH_BUCKETS, WORD_BUCKETS

WORD_SIZE, PATH_SIZE, HIDDEN = 14, 8, 24
INPUT = WORD_SIZE + PATH_SIZE + KINDS + NUMBERS
WEIGHTS = Path(__file__).with_name("block_weights.npz")
#: Padded cells (pages x blocks) of one forward pass, which bounds its memory.
CELLS = 24_000

_shared: dict[str, dict[str, np.ndarray]] = {}


def fresh(seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)

    def normal(*shape: int, scale: float) -> np.ndarray:
        return rng.normal(0, scale, shape).astype(np.float32)

    w = {"word": normal(WORD_BUCKETS, WORD_SIZE, scale=0.1), "path": normal(PATH_BUCKETS, PATH_SIZE, scale=0.1)}
    for side in "fb":
        w[f"x{side}"] = normal(INPUT, 4 * HIDDEN, scale=INPUT**-0.5)
        w[f"h{side}"] = normal(HIDDEN, 4 * HIDDEN, scale=HIDDEN**-0.5)
        bias = np.zeros(4 * HIDDEN, np.float32)
        bias[HIDDEN : 2 * HIDDEN] = 1
        w[f"c{side}"] = bias
    w["out"] = normal(2 * HIDDEN, scale=0.2)
    w["skip"] = normal(INPUT, scale=0.05)
    w["bias"] = np.zeros(1, np.float32)
    return w


def weights() -> dict[str, np.ndarray]:
    """The trained weights beside this module, read once a process."""
    if "w" not in _shared:
        with np.load(WEIGHTS) as saved:
            page_blocks.know(saved["known"])
            _shared["w"] = {k: saved[k].astype(np.float32) for k in saved.files if k != "known"}
    return _shared["w"]


def _sum_by(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Rows of ``values`` summed by their (ascending) owner."""
    out = np.zeros((n, values.shape[1]), np.float32)
    if len(owner):
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        out[owner[first]] = np.add.reduceat(values, first, axis=0)
    return out


def encode(w: dict, numbers: np.ndarray, words: np.ndarray, of_word: np.ndarray, paths: np.ndarray, of_path: np.ndarray) -> np.ndarray:
    """The input vector of each block: mean word vector, mean path vector, numbers."""
    n = len(numbers)
    word = _sum_by(w["word"][words], of_word, n) / np.maximum(1, np.bincount(of_word, minlength=n))[:, None].astype(np.float32)
    path = _sum_by(w["path"][paths], of_path, n) / np.maximum(1, np.bincount(of_path, minlength=n))[:, None].astype(np.float32)
    return np.concatenate([word, path, numbers], axis=1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _run(x: np.ndarray, wx: np.ndarray, wh: np.ndarray, bias: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """One direction over [time, page, input]."""
    steps, pages, _ = x.shape
    drive = (x.reshape(steps * pages, -1) @ wx + bias).reshape(steps, pages, -1)
    h = np.zeros((pages, HIDDEN), np.float32)
    c = np.zeros((pages, HIDDEN), np.float32)
    out = np.empty((steps, pages, HIDDEN), np.float32)
    trace = []
    for t in range(steps):
        g = drive[t] + h @ wh
        gates = _sigmoid(g[:, : 3 * HIDDEN])
        i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
        z = np.tanh(g[:, 3 * HIDDEN :])
        before = c
        c = f * c + i * z
        tc = np.tanh(c)
        if keep:
            trace.append((i, f, o, z, before, tc, h))
        h = o * tc
        out[t] = h
    return out, trace


def forward(w: dict, x: np.ndarray, mask: np.ndarray, keep: bool = False):
    """Logits [time, page].  Padding stands at the end, so the backward direction starts from zero inputs it ignores."""
    turned = _turn(x, mask)
    hf, tf = _run(x, w["xf"], w["hf"], w["cf"], keep)
    hb, tb = _run(turned, w["xb"], w["hb"], w["cb"], keep)
    both = np.concatenate([hf, _turn(hb, mask)], axis=2)
    logit = both @ w["out"] + x @ w["skip"] + w["bias"]
    return logit, (x, turned, both, tf, tb)


def _turn(x: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Each page's blocks in reverse order, padding kept at the end."""
    steps, pages = mask.shape
    length = mask.sum(0)
    index = (length[None, :] - 1 - np.arange(steps)[:, None]) % steps
    index = np.where(mask, index, np.arange(steps)[:, None])
    return x[index, np.arange(pages)[None, :]]


def _run_back(grad: np.ndarray, x: np.ndarray, trace: list, wx: np.ndarray, wh: np.ndarray):
    steps, pages, _ = x.shape
    dh = np.zeros((pages, HIDDEN), np.float32)
    dc = np.zeros((pages, HIDDEN), np.float32)
    dg = np.empty((steps, pages, 4 * HIDDEN), np.float32)
    dwh = np.zeros_like(wh)
    for t in range(steps - 1, -1, -1):
        i, f, o, z, before, tc, h = trace[t]
        dh = dh + grad[t]
        dc = dc + dh * o * (1 - tc * tc)
        g = dg[t]
        g[:, :HIDDEN] = dc * z * i * (1 - i)
        g[:, HIDDEN : 2 * HIDDEN] = dc * before * f * (1 - f)
        g[:, 2 * HIDDEN : 3 * HIDDEN] = dh * tc * o * (1 - o)
        g[:, 3 * HIDDEN :] = dc * i * (1 - z * z)
        dwh += h.T @ g
        dh = g @ wh.T
        dc = dc * f
    flat = dg.reshape(steps * pages, -1)
    return (flat @ wx.T).reshape(x.shape), x.reshape(steps * pages, -1).T @ flat, dwh, flat.sum(0)


def backward(w: dict, state, dlogit: np.ndarray, mask: np.ndarray) -> tuple[dict, np.ndarray]:
    x, turned, both, tf, tb = state
    grads = {"out": np.einsum("tp,tph->h", dlogit, both), "skip": np.einsum("tp,tpi->i", dlogit, x), "bias": np.array([dlogit.sum()], np.float32)}
    dboth = dlogit[:, :, None] * w["out"]
    dx = dlogit[:, :, None] * w["skip"]
    a, grads["xf"], grads["hf"], grads["cf"] = _run_back(dboth[:, :, :HIDDEN], x, tf, w["xf"], w["hf"])
    b, grads["xb"], grads["hb"], grads["cb"] = _run_back(_turn(dboth[:, :, HIDDEN:], mask), turned, tb, w["xb"], w["hb"])
    return grads, dx + a + _turn(b, mask)


def pad(vectors: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """[time, page, input] and its mask."""
    steps = max(len(v) for v in vectors)
    x = np.zeros((steps, len(vectors), INPUT), np.float32)
    mask = np.zeros((steps, len(vectors)), bool)
    for k, v in enumerate(vectors):
        x[: len(v), k] = v
        mask[: len(v), k] = True
    return x, mask


def label(pages: list[tuple]) -> list[np.ndarray]:
    """For each read page the blocks' logits (above 0: main body).  Pages run together in groups of like length.

    ``weights()`` must have been called before the pages are read: it names the known words.
    """
    w = weights()
    order = sorted((k for k in range(len(pages)) if len(pages[k][0])), key=lambda k: len(pages[k][0]))
    out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end + 1 - at) * len(pages[order[end]][0]) <= CELLS:
            end += 1
        group = order[at:end]
        sizes = [len(pages[k][0]) for k in group]
        base = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        flat = encode(
            w,
            np.concatenate([pages[k][0] for k in group]),
            np.concatenate([pages[k][1] for k in group]),
            np.concatenate([pages[k][2] + b for k, b in zip(group, base)]),
            np.concatenate([pages[k][3] for k in group]),
            np.concatenate([pages[k][4] + b for k, b in zip(group, base)]),
        )
        x, mask = pad(np.split(flat, base[1:]))
        logit, _ = forward(w, x, mask)
        for j, k in enumerate(group):
            out[k] = logit[: sizes[j], j]
        at = end
    return out

"""A bidirectional LSTM in numpy that labels the blocks of a page as main text or not.

A block is read as the sum of hashed embeddings of its tag path, the mean of
hashed embeddings of its words, and a few numbers; what training never met weighs nothing.  Both directions run over the
whole page, so each label uses the whole document.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from .html_blocks import Block
from .page_samples import FAMILIES, Sampler
from .textkernel import NOT_ALNUM, U64, split, word_hash

PATH_BUCKETS, WORD_BUCKETS, PATH_DIM, WORD_DIM, NUMBERS, HIDDEN = 8192, 32768, 20, 8, 7, 20
#: How the labeller is trained: invented pages, passes, pages a step, seed.
TRAINING = (6000, 6, 32, 20240601)


@lru_cache(maxsize=20000)
def _path_ids(path: tuple[str, ...]) -> tuple[int, ...]:
    return tuple(word_hash(n) % PATH_BUCKETS for n in path) or (0,)


def _ragged_sum(table: np.ndarray, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    out = np.zeros((len(first) - 1, table.shape[1]), dtype=np.float32)
    full = np.flatnonzero(np.diff(first) > 0)
    if len(full):
        out[full] = np.add.reduceat(table[ids], first[:-1][full], axis=0)
    return out


class Features:
    """Blocks of many pages, flat."""

    def __init__(self, pages: list[list[Block]]):
        flat = [b for p in pages for b in p]
        self.sizes = np.array([len(p) for p in pages], dtype=np.int64)
        paths = [_path_ids(b.path) for b in flat]
        self.path_first = np.concatenate(([0], np.cumsum([len(p) for p in paths]))).astype(np.int64)
        self.path_ids = np.array([i for p in paths for i in p], dtype=np.int64)
        raw = [b.text.encode() for b in flat]
        lengths = np.array([len(r) for r in raw], dtype=np.int64)
        data, offsets = np.frombuffer(b"".join(raw), dtype=np.uint8), np.concatenate(([0], np.cumsum(lengths)))
        w = split(data, offsets, lower=True, outside=NOT_ALNUM)
        self.word_first, self.word_ids = w.first, (w.hash % U64(WORD_BUCKETS)).astype(np.int64)
        order = np.concatenate([(np.arange(n) + 0.5) / n for n in self.sizes.tolist()]) if flat else np.zeros(0)
        words = np.maximum(np.diff(w.first), 1)
        share = np.array([b.link_chars for b in flat]) / np.maximum(lengths, 1)
        depth = np.array([len(b.path) for b in flat])
        ends = np.array([b.text[-1] in ".!?…" for b in flat], dtype=float)
        self.numbers = np.stack([np.log1p(lengths) / 6, np.minimum(share, 1), depth / 10, order, ends, np.minimum(lengths / words, 30) / 10, (words < 4).astype(float)], axis=1).astype(np.float32) if flat else np.zeros((0, NUMBERS), np.float32)


class Labeller:
    def __init__(self, seed: int):
        r = np.random.default_rng(seed)
        d = PATH_DIM + WORD_DIM + NUMBERS
        self.p = {"path": np.zeros((PATH_BUCKETS, PATH_DIM)), "word": np.zeros((WORD_BUCKETS, WORD_DIM)), "out": r.normal(0, 0.3, (2 * HIDDEN, 1)), "bias": np.zeros(1)}
        for side in "fb":
            self.p |= {f"W{side}": r.normal(0, 0.25, (d, 4 * HIDDEN)), f"U{side}": r.normal(0, 0.25, (HIDDEN, 4 * HIDDEN)), f"c{side}": np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _inputs(self, f: Features) -> np.ndarray:
        counts = np.maximum(np.diff(f.word_first), 1)[:, None].astype(np.float32)
        return np.concatenate([_ragged_sum(self.p["path"], f.path_ids, f.path_first), _ragged_sum(self.p["word"], f.word_ids, f.word_first) / counts, f.numbers], axis=1)

    def _run(self, x: np.ndarray, mask: np.ndarray, side: str, keep: bool = False):
        """x: (steps, pages, inputs); a page's state stands still outside it."""
        t, n, _ = x.shape
        pre = x @ self.p[f"W{side}"] + self.p[f"c{side}"]
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        out, memory = np.zeros((t, n, HIDDEN), np.float32), []
        for k in range(t) if side == "f" else range(t - 1, -1, -1):
            z = pre[k] + h @ self.p[f"U{side}"]
            s = 1 / (1 + np.exp(-z[:, : 3 * HIDDEN]))
            i, forget, o, g = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
            m = mask[k][:, None]
            new_c = np.where(m, forget * c + i * g, c)
            tc = np.tanh(new_c)
            new_h = np.where(m, o * tc, h)
            if keep:
                memory.append((k, h, c, i, forget, o, g, tc, m))
            h, c = new_h, new_c
            out[k] = h
        return out, memory

    def _padded(self, x: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        n, t = len(sizes), int(sizes.max())
        page = np.repeat(np.arange(n), sizes)
        step = np.arange(len(x)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        wide = np.zeros((t, n, x.shape[1]), np.float32)
        wide[step, page] = x
        mask = np.zeros((t, n), bool)
        mask[step, page] = True
        return wide, mask, step, page

    def probabilities(self, pages: list[list[Block]], at_once: int = 256) -> list[np.ndarray]:
        """For each page, the probability that each block is main text.  Pages of like length run together."""
        out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
        order = sorted((k for k, p in enumerate(pages) if p), key=lambda k: len(pages[k]))
        at = 0
        while at < len(order):
            to = at + 1
            while to < len(order) and to - at < at_once and len(pages[order[to]]) * (to - at + 1) <= 40_000:
                to += 1
            some = order[at:to]
            f = Features([pages[k] for k in some])
            wide, mask, step, page = self._padded(self._inputs(f), f.sizes)
            both = np.concatenate([self._run(wide, mask, "f")[0], self._run(wide, mask, "b")[0]], axis=2)
            p = (1 / (1 + np.exp(-(both @ self.p["out"] + self.p["bias"])))[:, :, 0])[step, page]
            for k, part in zip(some, np.split(p, np.cumsum(f.sizes)[:-1]), strict=True):
                out[k] = part
            at = to
        return out

    def gradients(self, f: Features, labels: np.ndarray) -> dict[str, np.ndarray]:
        x = self._inputs(f)
        wide, mask, step, page = self._padded(x, f.sizes)
        (hf, mf), (hb, mb) = self._run(wide, mask, "f", True), self._run(wide, mask, "b", True)
        both = np.concatenate([hf, hb], axis=2)
        p = (1 / (1 + np.exp(-(both @ self.p["out"] + self.p["bias"]))))[:, :, 0]
        dz = np.zeros_like(p)
        dz[step, page] = (p[step, page] - labels) / len(labels)
        g = {"out": np.einsum("tnh,tn->h", both, dz)[:, None], "bias": np.array([dz.sum()], np.float32)}
        back = dz[:, :, None] * self.p["out"][:, 0]
        dx = np.zeros_like(wide)
        for side, memory, dh_all in (("f", mf, back[:, :, :HIDDEN]), ("b", mb, back[:, :, HIDDEN:])):
            U, W = self.p[f"U{side}"], self.p[f"W{side}"]
            dh, dc = np.zeros((wide.shape[1], HIDDEN), np.float32), np.zeros((wide.shape[1], HIDDEN), np.float32)
            dpre, dU = np.zeros((*wide.shape[:2], 4 * HIDDEN), np.float32), np.zeros_like(U)
            for k, h, c, i, forget, o, gg, tc, m in reversed(memory):
                dh = dh + dh_all[k]
                now, through = np.where(m, dh, 0), np.where(m, 0, dh)
                dcm = np.where(m, dc, 0) + now * o * (1 - tc**2)
                z = np.concatenate([dcm * gg * i * (1 - i), dcm * c * forget * (1 - forget), now * tc * o * (1 - o), dcm * i * (1 - gg**2)], axis=1)
                dpre[k] = z
                dU += h.T @ z
                dh = z @ U.T + through
                dc = dcm * forget + np.where(m, 0, dc)
            flat = dpre.reshape(-1, 4 * HIDDEN)
            g |= {f"U{side}": dU, f"W{side}": wide.reshape(-1, wide.shape[2]).T @ flat, f"c{side}": flat.sum(axis=0)}
            dx += dpre @ W.T
        d = dx[step, page]
        g["path"], g["word"] = np.zeros_like(self.p["path"]), np.zeros_like(self.p["word"])
        np.add.at(g["path"], f.path_ids, np.repeat(d[:, :PATH_DIM], np.diff(f.path_first), axis=0))
        counts = np.diff(f.word_first)
        np.add.at(g["word"], f.word_ids, np.repeat(d[:, PATH_DIM : PATH_DIM + WORD_DIM] / np.maximum(counts, 1)[:, None], counts, axis=0))
        return g


@lru_cache(maxsize=2)
def trained(training: tuple = TRAINING, families: tuple[str, ...] = ("named", "named", *FAMILIES)) -> Labeller:
    """A labeller fitted to invented pages of some layouts by Adam; the same seed gives the same weights."""
    pages, passes, step, seed = training
    sampler = Sampler(seed, families)
    data = [(sampler.blurred(b), y) for b, y in (sampler.labelled() for _ in range(pages)) if b]
    model, t = Labeller(seed), 0
    first = {k: np.zeros_like(v) for k, v in model.p.items()}
    second = {k: np.zeros_like(v) for k, v in model.p.items()}
    order, steps = np.random.default_rng(seed), passes * -(-len(data) // step)
    for _ in range(passes):
        index = order.permutation(len(data))
        for at in range(0, len(index), step):
            some = [data[k] for k in index[at : at + step]]
            t += 1
            g = model.gradients(Features([b for b, _ in some]), np.concatenate([y for _, y in some]).astype(np.float32))
            norm = np.sqrt(sum(float((v**2).sum()) for v in g.values()))
            rate = 0.012 * (1 - (t - 1) / steps) * min(1.0, 5 / max(norm, 1e-9))
            for k, v in g.items():
                first[k] += 0.1 * (v - first[k])
                second[k] += 0.001 * (v**2 - second[k])
                model.p[k] -= (rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return model


def held_out_accuracy(model: Labeller, pages: int = 300, seed: int = 99, families: tuple[str, ...] = FAMILIES) -> float:
    """Share of the blocks of other invented pages, of these layouts, that get the right label."""
    sampler = Sampler(seed, families)
    data = [sampler.labelled() for _ in range(pages)]
    p = np.concatenate(model.probabilities([b for b, _ in data]))
    return float(((p >= 0.5) == np.concatenate([y for _, y in data])).mean())

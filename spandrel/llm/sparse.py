"""Hashed sparse features of texts and a factorisation machine over them, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .common import Words, eight_bytes, gram_hash, mix64, segment_sum


@dataclass
class Sparse:
    """Rows of (index, value); row r is ptr[r]..ptr[r+1]."""

    ptr: np.ndarray
    idx: np.ndarray
    val: np.ndarray

    def __len__(self) -> int:
        return len(self.ptr) - 1

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.ptr))

    def take(self, rows: np.ndarray) -> Sparse:
        n = np.diff(self.ptr)[rows]
        ptr = np.concatenate([[0], np.cumsum(n)])
        at = np.repeat(self.ptr[rows] - ptr[:-1], n) + np.arange(ptr[-1])
        return Sparse(ptr, self.idx[at], self.val[at])


def beside(a: Sparse, b: Sparse) -> Sparse:
    """Both rows' entries, one row after the other."""
    na, nb = np.diff(a.ptr), np.diff(b.ptr)
    ptr = np.concatenate([[0], np.cumsum(na + nb)])
    idx, val = np.empty(ptr[-1], np.int64), np.empty(ptr[-1], np.float32)
    for s, shift in ((a, np.zeros_like(na)), (b, na)):
        at = np.repeat(ptr[:-1] + shift - s.ptr[:-1], np.diff(s.ptr)) + np.arange(s.ptr[-1])
        idx[at], val[at] = s.idx, s.val
    return Sparse(ptr, idx, val)


def one_row_each(columns: np.ndarray, base: int, value: float) -> Sparse:
    """Dense integer columns (rows x columns), each a one-hot block of 32 bins from `base` on."""
    n, k = columns.shape
    return Sparse(np.arange(n + 1) * k, (base + np.arange(k) * 32 + np.clip(columns, 0, 31)).ravel(), np.full(n * k, value, np.float32))


def distinct(row: np.ndarray, idx: np.ndarray, n_rows: int) -> tuple[Sparse, np.ndarray]:
    """Distinct (row, idx) with their counts as values; idx below 2**32."""
    key, count = np.unique(row.astype(np.int64) << 32 | idx.astype(np.int64), return_counts=True)
    r = key >> 32
    return Sparse(np.searchsorted(r, np.arange(n_rows + 1)), key & 0xFFFFFFFF, count.astype(np.float32)), r


def word_features(w: Words, dims: int) -> Sparse:
    """Hashed words, weight log(1 + count), each row of length 1."""
    s, r = distinct(w.row, (w.hash >> np.uint64(20)) % np.uint64(dims), w.n_rows)
    v = np.log1p(s.val)
    norm = np.sqrt(np.bincount(r, v * v, minlength=w.n_rows))
    return Sparse(s.ptr, s.idx, (v / np.maximum(norm, 1e-9)[r]).astype(np.float32))


def prefix_hash(w: Words, size: int) -> np.ndarray:
    """Hash of the first `size` bytes (8 at most) of each word (shorter words: of all)."""
    n = np.minimum(w.end - w.start, size)
    low = np.array([(1 << 8 * k) - 1 for k in range(size + 1)], np.uint64)
    return mix64((eight_bytes(w.data)[w.start] & low[n]) * np.uint64(0xA0761D6478BD642F) + np.uint64(size))


def presence_features(w: Words, dims: int) -> Sparse:
    """Which words, and which beginnings of 5, 6 and 7 bytes, occur once, twice, four times or eight times at least."""
    size = w.end - w.start
    parts = [(w.row, w.hash), *((w.row[size >= k], prefix_hash(w, k)[size >= k]) for k in (5, 6, 7))]
    s, r = distinct(np.concatenate([x for x, _ in parts]), np.concatenate([h for _, h in parts]) >> np.uint64(33), w.n_rows)
    rows, ids = [], []
    for level, least in enumerate((1, 2, 4, 8)):
        often = s.val >= least
        rows.append(r[often])
        ids.append((mix64(s.idx[often].astype(np.uint64) * np.uint64(4) + np.uint64(level)) >> np.uint64(20)) % np.uint64(dims))
    s, _ = distinct(np.concatenate(rows), np.concatenate(ids), w.n_rows)
    return Sparse(s.ptr, s.idx, np.ones(len(s.idx), np.float32))


_UPPER, _SYMBOL, _DIGIT, _MARK = (np.isin(np.arange(256), list(x)) for x in (range(65, 91), b"#*$%&|<>{}[]\\^~@=+_", b"0123456789", b"!?.,;:"))


def structure_bins(raw: np.ndarray, w: Words) -> np.ndarray:
    """Bins (rows x 9) of length, word length, shares of capitals, symbols, digits, marks, distinct words, repeated word triples, and lines."""
    off = w.offsets
    total = lambda flags: segment_sum(flags.astype(np.int64), off)
    size = np.maximum(np.diff(off), 1)
    first = w.first
    n = np.diff(first)
    words = np.maximum(n, 1)
    share = lambda x, of: np.round(4 * np.log2(1 + 60 * x / of)).astype(np.int64)
    one, _ = distinct(w.row, w.hash >> np.uint64(33), w.n_rows)
    g = gram_hash(w.hash, 3)
    whole = w.row[: len(g)] == w.row[2 : 2 + len(g)] if len(g) else np.zeros(0, bool)
    grams, _ = distinct(w.row[: len(g)][whole], g[whole] >> np.uint64(33), w.n_rows)
    n_grams = np.maximum(n - 2, 1)
    lines = total(raw == 10) + 1
    return np.stack([
        np.round(2 * np.log2(1 + n)).astype(np.int64), np.round(2 * segment_sum(w.end - w.start, first) / words).astype(np.int64),
        share(total(_UPPER[raw]), size), share(total(_SYMBOL[raw]), size), share(total(_DIGIT[raw]), size), share(total(_MARK[raw]), size),
        np.round(20 * np.diff(one.ptr) / words).astype(np.int64), np.round(20 * (1 - np.diff(grams.ptr) / n_grams)).astype(np.int64), np.round(2 * np.log2(words / lines + 1)).astype(np.int64),
    ], axis=1)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class FM:
    """score = bias + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2); rank 0 is a linear model."""

    bias: float
    w: np.ndarray
    v: np.ndarray

    def raw(self, x: Sparse) -> np.ndarray:
        """Scores in time linear in the entries."""
        out = self.bias + segment_sum(self.w[x.idx].astype(np.float64) * x.val, x.ptr)
        if self.v.shape[1]:
            z = self.v[x.idx].astype(np.float64) * x.val[:, None]
            out += 0.5 * (segment_sum(z, x.ptr) ** 2 - segment_sum(z * z, x.ptr)).sum(axis=1)
        return out


def fit_fm(x: Sparse, y: np.ndarray, dims: int, rank: int, epochs: int = 6, rate: float = 0.1, decay: float = 1e-4, batch: int = 128, seed: int = 1) -> FM:
    """Logistic loss, AdaGrad with a falling rate, rows in a seeded order; labels 0 or 1. With no rows the model says one half."""
    rng = np.random.default_rng(seed)
    m = FM(0.0, np.zeros(dims, np.float32), (rng.standard_normal((dims, rank)) * 0.05).astype(np.float32))
    if not len(y):
        m.v[:] = 0
        return m
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    m.bias = float(np.log(share / (1 - share)))
    gb, gw, gv = 1e-6, np.full(dims, 1e-6, np.float32), np.full((dims, rank), 1e-6, np.float32)
    top = rate
    for epoch in range(epochs):
        rate = top * (1 - epoch / epochs)
        order = rng.permutation(len(y))
        for a in range(0, len(order), batch):
            rows = order[a : a + batch]
            s = x.take(rows)
            r = s.row
            z = m.v[s.idx] * s.val[:, None]
            total = segment_sum(z, s.ptr)
            score = m.bias + segment_sum(m.w[s.idx] * s.val, s.ptr) + 0.5 * (total**2 - segment_sum(z * z, s.ptr)).sum(axis=1)
            err = ((sigmoid(score) - y[rows]) / len(rows)).astype(np.float32)
            ids, at = np.unique(s.idx, return_inverse=True)
            dw = np.bincount(at, err[r] * s.val, minlength=len(ids)).astype(np.float32) + decay * m.w[ids]
            gw[ids] += dw * dw
            if rank:
                g = (err[r] * s.val)[:, None] * (total[r] - z)
                dv = np.stack([np.bincount(at, g[:, f], minlength=len(ids)) for f in range(rank)], axis=1).astype(np.float32) + decay * m.v[ids]
                gv[ids] += dv * dv
                m.v[ids] -= rate * 0.5 * dv / np.sqrt(gv[ids])
            m.w[ids] -= rate * dw / np.sqrt(gw[ids])
            db = float(err.sum())
            gb += db * db
            m.bias -= rate * db / gb**0.5
    return m



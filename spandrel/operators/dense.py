"""Small dense matrices: everything that is replicated elsewhere is numpy on the driver here.

Factorisations are rank-revealing where a tolerance is given: a pivot or eigenvalue below `tol` times the largest
counts as zero.
"""

from __future__ import annotations

import numpy as np

from ..types import RANK_TOL, EigSort, SdMat, SolverError


def put_value(n: int, m: int, value: float) -> SdMat:
    return SdMat(np.full((n, m), value, float))


def random(n: int, m: int, seed: int = 42) -> SdMat:
    return SdMat(np.random.default_rng(seed).uniform(-1, 1, (n, m)))


def identity(n: int, m: int) -> SdMat:
    return SdMat(np.eye(n, m))


def add(alpha: float, a: SdMat, beta: float, b: SdMat, transpose: bool = False) -> SdMat:
    return SdMat(alpha * (a.a.conj().T if transpose else a.a) + (beta * b.a if beta != 0 else 0))


def multiply(alpha: float, v: SdMat, w: SdMat, beta: float = 0.0, c: SdMat | None = None, first: bool = False, second: bool = False) -> SdMat:
    """alpha V W + beta C; first, second: transposed."""
    out = alpha * (v.a.conj().T if first else v.a) @ (w.a.conj().T if second else w.a)
    return SdMat(out + beta * c.a if c is not None and beta != 0 else out)


def view_block(m: SdMat, imin: int, imax: int, jmin: int, jmax: int) -> SdMat:
    """Shares memory with m."""
    return SdMat(m.a[imin : imax + 1, jmin : jmax + 1])


def get_block(m: SdMat, imin: int, imax: int, jmin: int, jmax: int) -> SdMat:
    return SdMat(view_block(m, imin, imax, jmin, jmax).a.copy())


def set_block(m: SdMat, block: SdMat, imin: int, imax: int, jmin: int, jmax: int) -> SdMat:
    out = m.a.copy()
    out[imin : imax + 1, jmin : jmax + 1] = block.a
    return SdMat(out)


def get_data(m: SdMat, row_major: bool = True) -> np.ndarray:
    return m.a.ravel("C" if row_major else "F")


def set_data(data: np.ndarray, n: int, m: int, row_major: bool = True) -> SdMat:
    return SdMat(np.array(data, float).reshape((n, m), order="C" if row_major else "F"))


def norm_f(m: SdMat) -> float:
    return float(np.linalg.norm(m.a))


def cholesky(m: SdMat, tol: float = RANK_TOL) -> tuple[SdMat, np.ndarray, int]:
    """(R, perm, rank) with M[perm][:, perm] = R' R, R upper triangular, rows from `rank` on zero."""
    a = np.array(m.a, copy=True)
    n = len(a)
    r, perm, left = np.zeros_like(a), np.arange(n), np.real(np.diag(a)).copy()
    scale = max(float(left.max(initial=0.0)), 0.0)
    rank = 0
    for k in range(n):
        p = k + int(np.argmax(left[perm[k:]]))
        if left[perm[p]] <= tol * scale or scale == 0:
            break
        perm[[k, p]] = perm[[p, k]]
        r[:k, [k, p]] = r[:k, [p, k]]
        r[k, k] = np.sqrt(left[perm[k]])
        rest = perm[k + 1 :]
        r[k, k + 1 :] = (a[perm[k], rest] - r[:k, k].conj() @ r[:k, k + 1 :]) / r[k, k]
        left[rest] -= np.abs(r[k, k + 1 :]) ** 2
        rank += 1
    return SdMat(r), perm, rank


def backward(r: SdMat, perm: np.ndarray, rank: int, x: SdMat) -> SdMat:
    """y with R y[perm] = x; components beyond the rank are zero."""
    y = np.zeros(x.a.shape, np.result_type(r.a, x.a))
    for i in range(rank - 1, -1, -1):
        y[perm[i]] = (x.a[i] - sum(r.a[i, j] * y[perm[j]] for j in range(i + 1, rank))) / r.a[i, i]
    return SdMat(y)


def forward(r: SdMat, perm: np.ndarray, rank: int, x: SdMat) -> SdMat:
    """y with R' y = x[perm]; components beyond the rank are zero."""
    y = np.zeros(x.a.shape, np.result_type(r.a, x.a))
    for i in range(rank):
        y[i] = (x.a[perm[i]] - sum(r.a[j, i].conj() * y[j] for j in range(i))) / r.a[i, i].conj()
    return SdMat(y)


def qb(gram: SdMat, tol: float = RANK_TOL) -> tuple[SdMat, SdMat, np.ndarray, int]:
    """(B, its pseudo-inverse, column norms, rank): for B = V'V, V times the result has orthonormal or zero columns."""
    norms = np.sqrt(np.maximum(np.real(np.diag(gram.a)), 0))
    d = np.where(norms > 0, 1 / np.where(norms > 0, norms, 1), 0)
    values, vectors = np.linalg.eigh(d[:, None] * gram.a * d[None, :])
    good = values > tol * max(float(values.max(initial=0.0)), 0.0)
    s = np.where(good, np.sqrt(np.where(good, values, 1)), 0)
    inverse = np.where(good, 1 / np.where(good, s, 1), 0)
    return SdMat(d[:, None] * vectors * inverse), SdMat((s[:, None] * vectors.conj().T) * norms[None, :]), norms, int(good.sum())


def inverse_hpd(a: SdMat, tol: float = RANK_TOL) -> tuple[SdMat, int]:
    r, perm, rank = cholesky(a, tol)
    return backward(r, perm, rank, forward(r, perm, rank, SdMat(np.eye(a.nrows)))), rank


def pseudo_inverse(a: SdMat, tol: float = RANK_TOL) -> tuple[SdMat, int]:
    u, s, vt = np.linalg.svd(a.a, full_matrices=False)
    good = s > tol * max(a.a.shape) * (s[0] if len(s) else 0)
    return SdMat((vt[good].conj().T / s[good]) @ u[:, good].conj().T), int(good.sum())


def svd(a: SdMat) -> tuple[SdMat, np.ndarray, SdMat]:
    u, s, vt = np.linalg.svd(a.a, full_matrices=True)
    return SdMat(u), s, SdMat(vt)


def qr(a: SdMat) -> tuple[SdMat, SdMat]:
    q, r = np.linalg.qr(a.a)
    return SdMat(q), SdMat(r)


# ---------------------------------------------------------------- Schur forms


def sort_key(values: np.ndarray, which: EigSort, target: complex = 0.0) -> np.ndarray:
    keys = {EigSort.LM: -np.abs(values), EigSort.SM: np.abs(values), EigSort.LR: -np.real(values), EigSort.SR: np.real(values), EigSort.TARGET: np.abs(values - target)}
    return keys.get(which, np.zeros(len(values)))


def schur(a: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Complex Schur form A Q = Q T: Householder reduction to Hessenberg form, then shifted QR with deflation."""
    t = np.array(a, complex)
    n = len(t)
    q = np.eye(n, dtype=complex)
    if n and np.allclose(t, t.conj().T, atol=1e-14 * max(1.0, np.abs(t).max())):
        values, vectors = np.linalg.eigh(t)
        return np.diag(values).astype(complex), vectors
    for k in range(n - 2):
        x = t[k + 1 :, k].copy()
        size = np.linalg.norm(x)
        if size == 0:
            continue
        x[0] += size * (x[0] / abs(x[0]) if x[0] != 0 else 1)
        x /= np.linalg.norm(x)
        t[k + 1 :] -= 2 * np.outer(x, x.conj() @ t[k + 1 :])
        t[:, k + 1 :] -= 2 * np.outer(t[:, k + 1 :] @ x, x.conj())
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ x, x.conj())
    high, tries = n - 1, 0
    while high > 0:
        small = np.abs(np.diag(t, -1)) <= np.finfo(float).eps * (np.abs(np.diag(t))[:-1] + np.abs(np.diag(t))[1:])
        t[np.flatnonzero(small) + 1, np.flatnonzero(small)] = 0
        while high > 0 and t[high, high - 1] == 0:
            high, tries = high - 1, 0
        if high == 0:
            break
        low = high
        while low > 0 and t[low, low - 1] != 0:
            low -= 1
        tries += 1
        if tries > sweeps:
            raise SolverError("the QR iteration does not converge")
        corner = np.linalg.eigvals(t[high - 1 : high + 1, high - 1 : high + 1])
        shift = corner[np.argmin(np.abs(corner - t[high, high]))] if tries % 10 else t[high, high] + abs(t[high, high - 1])
        own = np.arange(low, high + 1)
        block = t[np.ix_(own, own)] - shift * np.eye(len(own))
        g, r = np.linalg.qr(block)
        t[np.ix_(own, own)] = r @ g + shift * np.eye(len(own))
        t[:low, low : high + 1] = t[:low, low : high + 1] @ g
        t[low : high + 1, high + 1 :] = g.conj().T @ t[low : high + 1, high + 1 :]
        q[:, low : high + 1] = q[:, low : high + 1] @ g
    return np.triu(t), q


def swap(t: np.ndarray, q: np.ndarray, k: int) -> None:
    """Exchange the eigenvalues at k and k + 1 of a complex Schur form, in place, by one rotation."""
    a, b, c = t[k, k], t[k + 1, k + 1], t[k, k + 1]
    x = np.array([c, b - a])
    size = np.linalg.norm(x)
    if size == 0:
        return
    x /= size
    g = np.array([[x[0], -x[1].conj()], [x[1], x[0].conj()]])
    t[:, k : k + 2] = t[:, k : k + 2] @ g
    t[k : k + 2] = g.conj().T @ t[k : k + 2]
    q[:, k : k + 2] = q[:, k : k + 2] @ g
    t[k + 1, k] = 0


def order_schur(t: np.ndarray, q: np.ndarray, key: np.ndarray, count: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The Schur form with the `count` smallest keys in front (all by default), in rising order; ties stay as they are."""
    t, q, key = t.copy(), q.copy(), np.array(key, float)
    n = len(t)
    for i in range(n if count is None else min(count, n)):
        k = i + int(np.argmin(key[i:]))
        for j in range(k - 1, i - 1, -1):
            swap(t, q, j)
            key[[j, j + 1]] = key[[j + 1, j]]
    return t, q


def sorted_schur(a: np.ndarray, which: EigSort, count: int | None = None, target: complex = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(T, Q, eigenvalues) with the wanted eigenvalues in front."""
    t, q = schur(a)
    t, q = order_schur(t, q, sort_key(np.diag(t), which, target), count)
    return t, q, np.diag(t).copy()


def generalized_schur(a: np.ndarray, b: np.ndarray, which: EigSort, count: int | None = None, target: complex = 0.0):
    """(S, T, V, W, eigenvalues) with A V = W S, B V = W T: the Schur vectors of B^-1 A, and a QR of B V.  B must be regular."""
    if not len(b) or np.linalg.cond(b) > 1e14:
        raise SolverError("B is singular")
    _, v, _ = sorted_schur(np.linalg.solve(b, a), which, count, target)
    w, t = np.linalg.qr(b @ v)
    s = np.triu(w.conj().T @ a @ v)
    return s, np.triu(t), v, w, np.diag(s) / np.diag(t)


def reorder_by_residual(t: np.ndarray, q: np.ndarray, which: EigSort, residuals: np.ndarray, tol: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Among nearly equal eigenvalues, those with smaller residuals come first; returns (T, Q, permutation)."""
    key = sort_key(np.diag(t), which)
    n = len(residuals)
    group = np.concatenate([[0], np.cumsum(np.abs(np.diff(key[:n])) > tol)])
    perm = np.lexsort((residuals, group))
    rank = np.empty(n)
    rank[perm] = np.arange(n)
    full = np.concatenate([rank, np.arange(n, len(t))])
    t, q = order_schur(t, q, full, n)
    return t, q, perm


def schur_eigenvectors(t: np.ndarray) -> np.ndarray:
    """X upper triangular with T X = X diag(T), columns of norm one."""
    n = len(t)
    x = np.zeros((n, n), complex)
    scale = max(1e-300, np.abs(t).max(initial=0.0))
    for k in range(n):
        x[k, k] = 1
        for i in range(k - 1, -1, -1):
            d = t[i, i] - t[k, k]
            d = d if abs(d) > np.finfo(float).eps * scale else np.finfo(float).eps * scale
            x[i, k] = -(t[i, i + 1 : k + 1] @ x[i + 1 : k + 1, k]) / d
        x[:, k] /= np.linalg.norm(x[:, k])
    return x

"""Orthogonalisation of block vectors: Gram matrices on the cluster, factorisations on the driver, one block update each.

A sweep costs one pass for the Gram matrix of [V W] and one lazily combined projection; columns of inner products are
never taken one by one.
"""

from __future__ import annotations

import numpy as np

from ..streaming.loop import cut_vector
from ..types import RANK_TOL, BlockVector, SdMat
from . import dense, vec
from .linop import LinearOp


def svqb(v: BlockVector, tol: float = RANK_TOL) -> tuple[BlockVector, SdMat, np.ndarray, int]:
    """(Q, B, column norms, rank) with Q = V B orthonormal; columns beyond the rank are zero and come first."""
    b, _, norms, rank = dense.qb(vec.gram(v, v), tol)
    return vec.times_sdmat(1.0, v, b), b, norms, rank


def svrr(v: BlockVector, tol: float = RANK_TOL) -> tuple[BlockVector, SdMat, int]:
    q, b, _, rank = svqb(v, tol)
    return q, b, rank


def chol_qr(v: BlockVector, tol: float = RANK_TOL, sweeps: int = 2, fill: bool = True, seed: int = 1) -> tuple[BlockVector, SdMat, np.ndarray, int]:
    """(Q, R, perm, rank) with V[:, perm] = Q R, rank-revealing; with `fill` the columns beyond the rank are random orthonormal ones."""
    q, perm = cut_vector(v), np.arange(v.k)
    r, perm, rank = dense.cholesky(vec.gram(q, q), tol)
    total = r.a
    back = np.zeros((v.k, v.k))
    back[np.ix_(perm[:rank], range(rank))] = np.linalg.solve(r.a[:rank, :rank], np.eye(rank)) if rank else 0
    q = cut_vector(vec.times_sdmat(1.0, q, SdMat(back)))
    for _ in range(sweeps - 1):
        if rank < v.k and fill:
            noise = vec.random(v.spark, v.n, v.k, seed)
            keep = np.diag([1.0] * rank + [0.0] * (v.k - rank))
            q = vec.times_sdmat_add(q, SdMat(keep), noise, SdMat(np.eye(v.k) - keep))
            g = vec.gram(q, q).a
            # the new columns against the old ones
            mix = np.eye(v.k)
            mix[:rank, rank:] = -np.linalg.solve(g[:rank, :rank], g[:rank, rank:]) if rank else 0
            q = cut_vector(vec.times_sdmat(1.0, q, SdMat(mix)))
        g = vec.gram(q, q).a
        m = v.k if fill else rank
        low = np.linalg.cholesky(g[:m, :m]).T
        inverse = np.zeros((v.k, v.k))
        inverse[:m, :m] = np.linalg.solve(low, np.eye(m)) if m else 0
        total = np.concatenate([low[:rank, :rank] @ total[:rank], total[rank:]])
        q = cut_vector(vec.times_sdmat(1.0, q, SdMat(inverse)))
    return q, SdMat(total), perm, rank


def qr(v: BlockVector, tol: float = RANK_TOL) -> tuple[BlockVector, SdMat, int]:
    """V = Q R without a permutation: R has its columns in V's order."""
    q, r, perm, rank = chol_qr(v, tol)
    out = np.zeros_like(r.a)
    out[:, perm] = r.a
    return q, SdMat(out), rank


def orthog(v: BlockVector | None, w: BlockVector, b: LinearOp | None = None, sweeps: int = 3, tol: float = RANK_TOL, fill: bool = True, seed: int = 7) -> tuple[BlockVector, SdMat, SdMat | None, int]:
    """(Q, R1, R2, rank of [V W]): Q R1 = W - V R2, Q orthonormal and orthogonal to V, in the inner product of B if given.

    Directions of W that V or W already holds are replaced by random ones if `fill`, with zero columns in R1.
    """
    k, m = w.k, v.k if v is not None else 0
    r1, r2 = np.eye(k), np.zeros((m, k))
    q, rank = cut_vector(w), k
    scale = None
    for sweep in range(max(2, sweeps)):
        bq = q if b is None else cut_vector(b.apply(q))
        g = vec.gram(q, bq).a
        if scale is None:
            scale = np.sqrt(np.maximum(np.diag(g), 0))
        p = vec.gram(v, bq).a if m else np.zeros((0, k))
        inner = g - p.T @ p  # (W - V p)' B (W - V p), as V is orthonormal
        inner = (inner + inner.T) / 2
        factor, inverse, _, got = dense.qb(SdMat(inner), max(tol, 1e-14 * (1 + np.max(np.diag(g), initial=0) / max(np.max(np.abs(np.diag(inner)), initial=0), 1e-300))) if sweep == 0 else tol)
        if sweep == 0:
            rank = got
        # columns of the factor belong to rising eigenvalues: those beyond the rank come first and are zero
        r2 += p @ r1
        r1 = inverse.a @ r1
        step = vec.times_sdmat(1.0, q, factor)
        if m:
            step = vec.times_sdmat(-1.0, v, SdMat(p @ factor.a), 1.0, step)
        if got < k and fill:
            empty = np.flatnonzero(~factor.a.any(axis=0))
            pick = np.zeros((k, k))
            pick[empty, empty] = 1
            noise = vec.times_sdmat(1.0, vec.random(w.spark, w.n, k, seed + sweep), SdMat(pick))
            step = vec.axpby(1.0, noise, 1.0, step)
            r1[empty] = 0
        q = cut_vector(step)
        if got == k and np.max(np.abs(inner - np.eye(k)), initial=0) < 1e-12 and sweep > 0:
            break
    return q, SdMat(r1), SdMat(r2) if m else None, m + rank


def transform_search_space(vs: list[BlockVector], h: SdMat, m: SdMat) -> tuple[list[BlockVector], SdMat]:
    """V, A V, B V, ... times M, and M' H M."""
    return [cut_vector(vec.times_sdmat(1.0, v, m)) for v in vs], SdMat(m.a.conj().T @ h.a @ m.a)


def transform_search_space_harmonic(v: BlockVector, w: BlockVector, bv: BlockVector | None, h: SdMat, ha: SdMat, mv: SdMat, mw: SdMat):
    """The two-sided form: V MV, W MW, B V MV, MW' H MV and MW' HA MV."""
    right = [cut_vector(vec.times_sdmat(1.0, x, mv)) for x in ((v,) if bv is None else (v, bv))]
    return right[0], cut_vector(vec.times_sdmat(1.0, w, mw)), (right[1] if bv is not None else None), SdMat(mw.a.T @ h.a @ mv.a), SdMat(mw.a.T @ ha.a @ mv.a)

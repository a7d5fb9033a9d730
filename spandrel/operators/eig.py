"""Eigensolvers and spectral densities: driver loops over operator applications, Gram matrices and block updates."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, fields, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming.loop import Checkpoint, cut, cut_vector
from ..types import BlockVector, EigExtr, EigSort, LinSolv, Matrix, Precon, Projection, SdMat, SolverError
from . import dense, linop, orth, rowproj, solve, spmv, vec
from .linop import LinearOp

# ---------------------------------------------------------------- Arnoldi and Lanczos


def arnoldi(op: LinearOp, m: int, v0: BlockVector, b: LinearOp | None = None) -> tuple[BlockVector, np.ndarray]:
    """(V, H): A V[:, :m] = V H, V orthonormal (in the product of B if given), from a start vector."""
    return block_arnoldi(op, m, 1, v0, b)


def block_arnoldi(op: LinearOp, m: int, block: int = 1, v0: BlockVector | None = None, b: LinearOp | None = None, seed: int = 3, spark: SparkSession | None = None) -> tuple[BlockVector, np.ndarray]:
    """The block form with m columns in A V[:, :m] = V H; a random start without v0."""
    if m % block:
        raise SolverError("m is a multiple of the block size")
    v0 = vec.random(spark or SparkSession.active(), op.n_domain, block, seed) if v0 is None else v0
    q, _, _, _ = orth.orthog(None, v0, b)
    v = q
    h = np.zeros((m + block, m))
    for j in range(0, m, block):
        w = cut_vector(op.apply(vec.view_block(v, j, j + block - 1)))
        q, r1, r2, _ = orth.orthog(v, w, b, seed=seed + j)
        h[: j + block, j : j + block] = r2.a
        h[j + block : j + 2 * block, j : j + block] = r1.a
        v = cut_vector(vec.gather([v, q]))
    return v, h


def lanczos(op: LinearOp, max_iter: int = 100, tol: float = 1e-6, v0: BlockVector | None = None, checkpoint: Checkpoint | None = None, every: int = 10) -> tuple[float, float, int]:
    """(smallest, largest eigenvalue, iterations) of a symmetric operator; with `checkpoint` the state is stored and resumed."""
    alpha: list[float] = []
    beta: list[float] = []
    if checkpoint is not None and checkpoint.need_restart():
        s = checkpoint.read()
        df, alpha, beta = s["vectors"], s["alpha"].tolist(), s["beta"].tolist()
    else:
        v = vec.random(SparkSession.active(), op.n_domain, 1, 9) if v0 is None else v0
        v, _ = vec.normalize(v)
        df = cut(v.df.select("i", F.col("x").alias("v"), F.array(F.lit(0.0)).alias("u")))
    low = high = 0.0
    while len(alpha) < max_iter:
        df = cut(solve.apply_to(op, df, "v", 1, "w"))
        last = beta[-1] if beta else 0.0
        a = vec.dots(df, [(F.col("v")[0], F.col("w")[0])])[0]
        w = F.col("w")[0] - F.lit(float(a)) * F.col("v")[0] - F.lit(float(last)) * F.col("u")[0]
        df = cut(df.select("i", "v", F.array(w).alias("w")))
        b = float(np.sqrt(vec.dots(df, [(F.col("w")[0], F.col("w")[0])])[0]))
        alpha.append(float(a))
        t = np.diag(alpha) + np.diag(beta, 1) + np.diag(beta, -1)
        values, vectors = np.linalg.eigh(t)
        low, high = float(values[0]), float(values[-1])
        beta.append(b)
        scale = max(abs(low), abs(high), 1e-300)
        if b <= 1e-14 * scale or max(abs(b * vectors[-1, 0]), abs(b * vectors[-1, -1])) <= tol * scale:
            break
        df = df.select("i", F.transform("w", lambda x: x / F.lit(b)).alias("v"), F.col("v").alias("u"))
        if checkpoint is not None and len(alpha) % every == 0:
            df = cut(df)
            for k, x in (("vectors", df), ("alpha", alpha), ("beta", beta)):
                checkpoint.add(k, x)
            checkpoint.write()
    return low, high, len(alpha)


# ---------------------------------------------------------------- kernel polynomials


def kpm_moments(a: Matrix, x: BlockVector, scale: float, shift: float, moments: int) -> np.ndarray:
    """mu[m, j] = x_j' T_m(scale (A - shift I)) x_j for m < moments; two moments for each product (doubling)."""
    k = x.k
    run = lambda df, name, out: solve.apply_to(linop.from_function(a.nrows, a.ncols, lambda v: spmv.spmv(a, v, scale, shift=-shift)), df, name, k, out)
    df = cut(run(x.df.select("i", F.col("x").alias("t0")), "t0", "t1"))
    d = lambda p, q: solve.inner(df, k, (p, q))[0]
    mu0, mu1 = d("t0", "t0"), d("t1", "t0")
    mu = [mu0, mu1]
    while len(mu) < moments:
        # T_2m = 2 T_m T_m - T_0,  T_2m+1 = 2 T_m+1 T_m - T_1
        n = len(mu) // 2
        if n > 1:
            df = cut(run(df, "t1", "t2").select("i", F.col("t1").alias("t0"), solve.lin((2, "t2"), (-1, "t0"), k=k).alias("t1")))
        elif n == 1:
            df = cut(run(df, "t1", "t2").select("i", "t0", "t1", solve.lin((2, "t2"), (-1, "t0"), k=k).alias("n")))
            mu += [2 * d("t1", "t1") - mu0, 2 * d("n", "t1") - mu1]
            df = df.select("i", F.col("t1").alias("t0"), F.col("n").alias("t1"))
            continue
        mu += [2 * d("t0", "t0") - mu0, 2 * d("t1", "t0") - mu1]
    return np.array(mu[:moments])


def dos(a: Matrix, scale: float, shift: float, moments: int, vectors: int, seed: int = 1) -> np.ndarray:
    """Sum over random vectors of the moments: the density of states."""
    return kpm_moments(a, vec.random(a.spark, a.ncols, vectors, seed), scale, shift, moments).sum(axis=1)


# ---------------------------------------------------------------- Jacobi-Davidson


@dataclass
class JadaOptions:
    """Options of the eigensolvers and their defaults; text of `key value` lines, unknown keys ignored."""

    numEigs: int = 6
    which: EigSort = EigSort.LM
    how: EigExtr = EigExtr.STANDARD
    convTol: float = 1e-12
    relConvTol: float = 0.0
    symmetry: str = "GENERAL"
    maxIters: int = 300
    blockSize: int = 1
    lookAhead: int = -1
    minBas: int = 10
    maxBas: int = 20
    initialShift_r: float = 0.0
    initialShift_i: float = 0.0
    initialShiftIters: int = 0
    innerSolvType: LinSolv = LinSolv.GMRES
    innerSolvBlockSize: int = 1
    innerSolvMaxBas: int = 20
    innerSolvMaxIters: int = 20
    innerSolvBaseTol: float = 0.1
    innerSolvMaxProjectionSpace: int = -1
    innerSolvStopAfterFirstConverged: bool = False
    innerSolvRobust: bool = True
    preconType: Precon = Precon.NO_PRECON
    preconOpts: str = ""
    v0: BlockVector | None = field(default=None, repr=False)

    @classmethod
    def parse(cls, text: str) -> JadaOptions:
        types = {f.name: f.type for f in fields(cls)}
        out = {}
        for line in text.splitlines():
            k, _, v = line.strip().partition(" ")
            v = v.strip()
            if k not in types or k == "v0" or not v:
                continue
            kind = str(types[k])
            enums = {"EigSort": EigSort, "EigExtr": EigExtr, "LinSolv": LinSolv, "Precon": Precon}
            out[k] = enums[kind].from_str(v) if kind in enums else v.lower() in ("1", "true", "yes") if kind == "bool" else int(v) if kind == "int" else float(v) if kind == "float" else v
        return cls(**out)

    def check(self) -> None:
        """Refuses what isn't built rather than ignore it."""
        for name, built in (("lookAhead", -1), ("innerSolvMaxProjectionSpace", -1), ("innerSolvStopAfterFirstConverged", False), ("preconOpts", ""), ("preconType", Precon.NO_PRECON)):
            if getattr(self, name) != built:
                raise NotImplementedError(f"{name} {getattr(self, name)}: only {built!r} is built (a preconditioner is handed over as an operator)")
        if self.symmetry.upper() not in ("GENERAL", "SYMMETRIC", "HERMITIAN"):
            raise NotImplementedError(f"symmetry {self.symmetry}")

    def text(self) -> str:
        return "".join(f"{f.name} {getattr(self, f.name)}\n" for f in fields(self) if f.name != "v0")


@dataclass
class EigenResult:
    """Partial Schur form A Q = B Q R with its values and residual norms."""

    q: BlockVector
    r: np.ndarray
    values: np.ndarray
    residuals: np.ndarray
    converged: int
    iterations: int

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(k, float(np.real(v)), float(np.imag(v)), float(r)) for k, (v, r) in enumerate(zip(self.values, self.residuals, strict=True))]
        return spark.createDataFrame(rows, "k int, ev_re double, ev_im double, residual double")


def jada_op(ab: LinearOp, v: BlockVector, bv: BlockVector | None, sigma: Sequence[float], method: Projection = Projection.PRE_POST, precon: LinearOp | None = None) -> LinearOp:
    """(I - BV V')(A - sigma B)(I - V BV') with the projections chosen."""
    bv = v if bv is None else bv
    pre, post = linop.projection(bv, v), linop.projection(v, bv)
    skew = linop.skew_projection(precon, v, bv) if method in (Projection.SKEW, Projection.ALL) and precon is not None else None

    def run(x: BlockVector) -> BlockVector:
        if method in (Projection.PRE, Projection.PRE_POST, Projection.ALL):
            x = pre.apply(x)
        y = ab.apply_shifted(-np.asarray(sigma, float), x)
        if method in (Projection.POST, Projection.PRE_POST, Projection.ALL):
            y = post.apply(y)
        if precon is not None and method in (Projection.SKEW, Projection.ALL):
            y = skew.apply(precon.apply(y))
        return y

    return LinearOp(ab.n_range, ab.n_domain, run)


def jada_precon(p: LinearOp, v: BlockVector, bv: BlockVector | None = None, skew: bool = True) -> LinearOp:
    """P^-1 followed by the skew (or the plain) projection."""
    bv = v if bv is None else bv
    project = linop.skew_projection(p, v, bv) if skew else linop.projection(bv, v)
    return LinearOp(p.n_range, p.n_domain, lambda x: project.apply(p.apply(x)))


def with_left_precon(op: LinearOp, p: LinearOp) -> LinearOp:
    return linop.product(p, op)


@dataclass
class CorrectionSolver:
    """Solves the correction equations of all shifts: (A - sigma_j B) t_j = -r_j in the complement of Q."""

    options: JadaOptions
    custom: Callable | None = None

    def run(self, ab: LinearOp, q: BlockVector, bq: BlockVector | None, sigma: np.ndarray, res: BlockVector, tol: np.ndarray, precon: LinearOp | None = None) -> BlockVector:
        o = self.options
        kind = o.innerSolvType
        rhs = vec.scale(res, -1.0)
        if self.custom is not None:
            return self.custom(ab, q, sigma, res, tol)
        if kind == LinSolv.DO_NOTHING:
            return rhs
        out = []
        for j in range(res.k):  # each column has a shift, so an operator, of its own
            op = jada_op(ab, q, bq, [float(sigma[j])])
            b = BlockVector(cut(linop.projection(q, q if bq is None else bq).apply(vec.view_block(rhs, j, j)).df), res.n, 1)
            if kind == LinSolv.CARP_CG:  # row projections of the shifted matrix; the complement of Q by a projection after them
                if bq is not None or ab.matrix is None:
                    raise SolverError("CARP_CG takes a matrix and no second one")
                got = rowproj.carp_cg(ab.matrix, b, shifts=[complex(sigma[j])], tol=float(tol[j]), max_iter=o.innerSolvMaxIters)
                out.append(linop.projection(q, q).apply(got.x))
                continue
            if kind.name not in solve.SOLVERS:
                raise SolverError(f"{kind.name} needs a solver of one's own: CorrectionSolver(options, custom)")
            p = jada_precon(precon, q, bq) if precon is not None and kind == LinSolv.GMRES else None
            more = {"basis": o.innerSolvMaxBas} if kind in (LinSolv.GMRES, LinSolv.MINRES) else {}
            got = solve.SOLVERS[kind.name](op, b, precon=p, tol=float(tol[j]), max_iter=o.innerSolvMaxIters, **more)
            out.append(got.x)
        return cut_vector(vec.gather(out))


def subspace_jada(op: LinearOp, options: JadaOptions, b: LinearOp | None = None, precon: LinearOp | None = None, solver: CorrectionSolver | None = None) -> EigenResult:
    """Block Jacobi-Davidson for symmetric A (and positive definite B): the wanted eigenpairs, locked as they converge."""
    o = options
    if o.how != EigExtr.STANDARD:
        raise NotImplementedError("only standard extraction")
    o.check()
    solver = solver or CorrectionSolver(o)
    ab = op if b is None else linop.wrap_matrix_pair(op.matrix, b.matrix)
    if b is None:
        ab = LinearOp(op.n_range, op.n_domain, op.op, op.op_t, lambda x, s: vec.axpby(1.0, op.apply(x), 1.0, vec.vscale(x, s)) if op.op_shifted is None else op.apply_shifted(s, x))
    block, wanted = o.blockSize, o.numEigs
    spark = SparkSession.active()
    start = min(max(o.minBas, block), op.n_domain)
    start -= start % block
    v, _ = block_arnoldi(op, start - block, block, o.v0, b, spark=spark) if start > block else (orth.orthog(None, o.v0 or vec.random(spark, op.n_domain, block, 3), b)[0], None)
    av = cut_vector(op.apply(v))
    bv = cut_vector(b.apply(v)) if b is not None else None
    h = vec.gram(v, av).a
    it = 0
    conv_tol = lambda value: max(o.convTol, o.relConvTol * abs(value)) if o.relConvTol else o.convTol * max(1.0, abs(value))
    while True:
        values, vectors = np.linalg.eigh((h + h.T) / 2)
        order = np.argsort(dense.sort_key(values, o.which, complex(o.initialShift_r, o.initialShift_i)), kind="stable")
        n = min(wanted + block, len(values))
        s = vectors[:, order[:n]]
        ev = values[order[:n]]
        q, aq = cut_vector(vec.times_sdmat(1.0, v, SdMat(s))), vec.times_sdmat(1.0, av, SdMat(s))
        bq = cut_vector(vec.times_sdmat(1.0, bv, SdMat(s))) if bv is not None else None
        res = cut_vector(vec.axpby(1.0, aq, -1.0, vec.vscale(q if bq is None else bq, ev)))
        norms = vec.norm2(res)
        good = np.array([r <= conv_tol(e) for r, e in zip(norms, ev, strict=True)])
        done = int(np.argmin(np.append(good[:wanted], False)))
        if done >= min(wanted, len(values)) or it >= o.maxIters:
            k = min(wanted, n)
            return EigenResult(vec.view_block(q, 0, k - 1), np.diag(ev[:k]), ev[:k].copy(), norms[:k], done, it)
        if v.k + block > o.maxBas:  # restart with the best directions
            keep = min(max(o.minBas, done + block), v.k)
            m = SdMat(vectors[:, order[:keep]])
            blocks, hh = orth.transform_search_space([x for x in (v, av, bv) if x is not None], SdMat(h), m)
            v, av = blocks[0], blocks[1]
            bv = blocks[2] if bv is not None else None
            h = hh.a
            continue
        open_ = [j for j in range(n) if not good[j]][:block]
        open_ += [j for j in range(n) if j not in open_ and j >= done][: block - len(open_)]
        lock = sorted({*range(done), *open_})
        pick = lambda x, js: replace(x, df=x.df.select("i", F.array(*[F.col("x")[j] for j in js]).alias("x")), k=len(js))
        sigma = ev[open_] if it >= o.initialShiftIters else np.full(len(open_), o.initialShift_r)
        tol = np.full(len(open_), o.innerSolvBaseTol ** min(it + 1, 4))
        t = solver.run(ab, pick(q, lock), pick(bq, lock) if bq is not None else None, sigma, pick(res, open_), tol, precon)
        new, _, _, _ = orth.orthog(v, t, b, sweeps=3, seed=100 + it)
        a_new = cut_vector(op.apply(new))
        v, av = cut_vector(vec.gather([v, new])), cut_vector(vec.gather([av, a_new]))
        if b is not None:
            bv = cut_vector(vec.gather([bv, b.apply(new)]))
        side = vec.gram(v, a_new).a  # the last columns of H; the symmetric part gives the rows
        old = h.shape[0]
        bigger = np.zeros((old + new.k, old + new.k))
        bigger[:old, :old] = h
        bigger[:, old:] = side
        bigger[old:, :old] = side[:old].T
        h = bigger
        it += 1


def residual_norms(op: LinearOp, r: EigenResult, b: LinearOp | None = None) -> np.ndarray:
    """Explicit residuals of A q - B q r."""
    bq = r.q if b is None else b.apply(r.q)
    return vec.norm2(vec.axpby(1.0, op.apply(r.q), -1.0, vec.times_sdmat(1.0, bq, SdMat(np.real(r.r)))))


def lobpcg(op: LinearOp, count: int, which: EigSort = EigSort.SR, b: LinearOp | None = None, precon: LinearOp | None = None, tol: float = 1e-6, max_iter: int = 100, x0: BlockVector | None = None, seed: int = 8) -> EigenResult:
    """Locally optimal block preconditioned conjugate gradients for symmetric operators (smallest or largest values)."""
    sign = -1.0 if which == EigSort.LR else 1.0
    x, _, _, _ = orth.orthog(None, x0 or vec.random(SparkSession.active(), op.n_domain, count, seed), b)
    p = None
    ev, norms, it = np.zeros(count), np.full(count, np.inf), 0
    for it in range(max_iter + 1):
        ax = cut_vector(op.apply(x))
        bx = x if b is None else cut_vector(b.apply(x))
        ev, s = np.linalg.eigh(sign * vec.gram(x, ax).a)
        x, ax, bx = (cut_vector(vec.times_sdmat(1.0, y, SdMat(s))) for y in (x, ax, bx))
        r = cut_vector(vec.axpby(1.0, ax, -1.0, vec.vscale(bx, sign * ev)))
        norms = vec.norm2(r)
        if (norms <= tol * np.maximum(1, np.abs(ev))).all() or it == max_iter:
            break
        w = r if precon is None else precon.apply(r)
        w, _, _, _ = orth.orthog(x, w, b, seed=seed + it)
        basis = vec.gather([x, w])
        if p is not None:
            p, _, _, _ = orth.orthog(basis, p, b, seed=seed + 50 + it)
            basis = vec.gather([basis, p])
        basis = cut_vector(basis)
        _, s = np.linalg.eigh(sign * vec.gram(basis, op.apply(basis)).a)
        s = s[:, :count]
        step = s.copy()
        step[:count] = 0
        p = cut_vector(vec.times_sdmat(1.0, basis, SdMat(step)))
        x, _, _, _ = orth.orthog(None, vec.times_sdmat(1.0, basis, SdMat(s)), b)
    return EigenResult(x, np.diag(sign * ev), sign * ev, norms, int((norms <= tol * np.maximum(1, np.abs(ev))).sum()), it)


def krylov_schur(op: LinearOp, count: int, which: EigSort = EigSort.LM, basis: int = 20, tol: float = 1e-6, max_restarts: int = 30, v0: BlockVector | None = None, seed: int = 3) -> EigenResult:
    """Restarted Arnoldi in Krylov-Schur form for general real operators; values may be complex, Q is real only if they are."""
    v0 = vec.random(SparkSession.active(), op.n_domain, 1, seed) if v0 is None else v0
    v, h = arnoldi(op, basis, v0)
    for restart in range(max_restarts + 1):
        m = h.shape[1]
        t, q, values = dense.sorted_schur(h[:m], which)
        residuals = np.abs(h[m] @ q)
        good = residuals[:count] <= tol * np.maximum(1, np.abs(values[:count]))
        if good.all() or restart == max_restarts:
            break
        keep = min(max(count + (m - count) // 2, count + 1), m - 1)
        # a real basis of the space of the leading Schur vectors; conjugate pairs stay together
        if abs(values[keep - 1].imag) > 1e-12 and not np.isclose(values[:keep].imag.sum(), 0, atol=1e-8 * max(1, np.abs(values).max())):
            keep = keep + 1 if keep + 1 < m else keep - 1
        u, s, _ = np.linalg.svd(np.concatenate([q[:, :keep].real, q[:, :keep].imag], axis=1), full_matrices=False)
        u = u[:, :keep]
        small = np.zeros((basis + 1, basis))
        small[:keep, :keep] = u.T @ h[:m] @ u
        small[keep, :keep] = h[m] @ u
        v = cut_vector(vec.gather([vec.times_sdmat(1.0, vec.view_block(v, 0, m - 1), SdMat(u)), vec.view_block(v, m, m)]))
        for j in range(keep, basis):
            w = cut_vector(op.apply(vec.view_block(v, j, j)))
            new, r1, r2, _ = orth.orthog(v, w, seed=seed + j)
            small[: j + 1, j] = r2.a[:, 0]
            small[j + 1, j] = r1.a[0, 0]
            v = cut_vector(vec.gather([v, new]))
        h = small
    u = np.real(q[:, :count]) if np.abs(np.imag(values[:count])).max(initial=0) < 1e-9 else q[:, :count].real
    return EigenResult(vec.times_sdmat(1.0, vec.view_block(v, 0, m - 1), SdMat(u)), t[:count, :count], values[:count], residuals[:count], int(good.sum()), restart)

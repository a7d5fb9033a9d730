"""Linear solvers for several systems at once.

A solver's state is one frame with an array column for each of its vectors, aligned by row: updates are projections
without joins, all scalars of a step come from one aggregation, and only the operator application moves data.  The state
is cut with a reliable checkpoint once in an iteration; small matrices stay on the driver.

Start vectors are zero unless x0 is given.  stop="any" ends when one column has converged, "all" when all have.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..streaming.loop import cut
from ..types import BlockVector, Result, SolverError
from . import vec
from .linop import LinearOp


def lin(*terms: tuple[Sequence[float] | float, str], k: int) -> Column:
    """Sum of column-scaled arrays: (coefficient or one for each column, column name)."""
    parts = []
    for c, name in terms:
        c = np.broadcast_to(np.asarray(c, float), (k,))
        parts.append(F.zip_with(name, vec.literal(c), lambda p, q: p * q) if not (c == 1).all() else F.col(name))
    out = parts[0]
    for p in parts[1:]:
        out = F.zip_with(out, p, lambda a, b: a + b)
    return out


def inner(df: DataFrame, k: int, *pairs: tuple[str, str]) -> list[np.ndarray]:
    """Column-wise dots of named arrays, all in one job."""
    got = vec.dots(df, [(F.col(a)[j], F.col(b)[j]) for a, b in pairs for j in range(k)])
    return list(got.reshape(len(pairs), k))


def apply_to(op: LinearOp, df: DataFrame, x: str, k: int, name: str) -> DataFrame:
    """df with op applied to one of its arrays beside the others."""
    y = op.apply(BlockVector(df.select("i", F.col(x).alias("x")), op.n_domain, k))
    return df.join(y.df.select("i", F.col("x").alias(name)), "i")


def safe(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a / b, zero where b is zero (a column that is solved stays as it is)."""
    return np.where(b != 0, a / np.where(b != 0, b, 1), 0.0)


def _tol(tol, k: int) -> np.ndarray:
    return np.broadcast_to(np.asarray(tol, float), (k,))


def _stopped(rel: np.ndarray, tol: np.ndarray, stop: str) -> bool:
    done = rel <= tol
    return bool(done.any() if stop == "any" else done.all())


def _start(op: LinearOp, b: BlockVector, x0: BlockVector | None) -> tuple[DataFrame, np.ndarray]:
    """Frame with x and r, and the norms of b."""
    zero = F.transform("x", lambda _: F.lit(0.0))
    if x0 is None:
        df = b.df.select("i", zero.alias("s"), F.col("x").alias("r"))
    else:
        r = vec.axpby(-1.0, op.apply(x0), 1.0, b)
        df, (x, y) = vec.aligned(x0, r)
        df = df.select("i", x.alias("s"), y.alias("r"))
    return df, np.sqrt(vec.dots(b.df, [(F.col("x")[j], F.col("x")[j]) for j in range(b.k)]))


def _result(df: DataFrame, b: BlockVector, it: int, rel: np.ndarray, tol: np.ndarray, history: list) -> Result:
    return Result(BlockVector(df.select("i", F.col("s").alias("x")), b.n, b.k), it, bool((rel <= tol).all()), rel, history)


def pcg(op: LinearOp, b: BlockVector, precon: LinearOp | None = None, tol=1e-8, max_iter: int = 100, stop: str = "all", x0: BlockVector | None = None) -> Result:
    """Preconditioned conjugate gradients for symmetric positive definite operators."""
    k, tol = b.k, _tol(tol, b.k)
    df, norm = _start(op, b, x0)
    df = apply_to(precon, df, "r", k, "z") if precon else df.withColumn("z", F.col("r"))
    df = cut(df.withColumn("p", F.col("z")))
    rz, rr = inner(df, k, ("r", "z"), ("r", "r"))
    rel, history, it = safe(np.sqrt(rr), norm), [], 0
    while it < max_iter and not _stopped(rel, tol, stop):
        df = cut(apply_to(op, df, "p", k, "q"))
        alpha = safe(rz, inner(df, k, ("p", "q"))[0])
        df = df.select("i", lin((1, "s"), (alpha, "p"), k=k).alias("s"), lin((1, "r"), (-alpha, "q"), k=k).alias("r"), "p")
        if precon:
            df = cut(apply_to(precon, df, "r", k, "z"))
        else:
            df = df.withColumn("z", F.col("r"))
        new, rr = inner(df, k, ("r", "z"), ("r", "r"))
        df = df.withColumn("p", lin((1, "z"), (safe(new, rz), "p"), k=k))
        rz, rel, it = new, safe(np.sqrt(rr), norm), it + 1
        history.append(rel)
    return _result(cut(df), b, it, rel, tol, history)


def bicgstab(op: LinearOp, b: BlockVector, precon: LinearOp | None = None, tol=1e-8, max_iter: int = 200, stop: str = "all", x0: BlockVector | None = None) -> Result:
    """BiCGStab; iterations count operator applications, two a step.  A preconditioner is refused."""
    if precon is not None:
        raise SolverError("BiCGStab takes no preconditioner")
    k, tol = b.k, _tol(tol, b.k)
    df, norm = _start(op, b, x0)
    df = cut(df.withColumns({"h": F.col("r"), "p": F.col("r")}))
    rho = inner(df, k, ("h", "r"))[0]
    rel, history, it = safe(np.sqrt(rho), norm), [], 0
    while it < max_iter and not _stopped(rel, tol, stop):
        df = cut(apply_to(op, df, "p", k, "v"))
        alpha = safe(rho, inner(df, k, ("h", "v"))[0])
        df = df.withColumn("r", lin((1, "r"), (-alpha, "v"), k=k))
        df = cut(apply_to(op, df, "r", k, "t"))
        tr, tt = inner(df, k, ("t", "r"), ("t", "t"))
        omega = safe(tr, tt)
        df = df.select("i", "h", "v", lin((1, "s"), (alpha, "p"), (omega, "r"), k=k).alias("s"), lin((1, "r"), (-omega, "t"), k=k).alias("r"), "p")
        new, rr = inner(df, k, ("h", "r"), ("r", "r"))
        beta = safe(new, rho) * safe(alpha, omega)
        df = df.withColumn("p", lin((1, "r"), (beta, "p"), (-beta * omega, "v"), k=k)).drop("v")
        rho, rel, it = new, safe(np.sqrt(rr), norm), it + 2
        history.append(rel)
    return _result(cut(df), b, it, rel, tol, history)


def qmr(op: LinearOp, b: BlockVector, precon: LinearOp | None = None, tol=1e-8, max_iter: int = 200, stop: str = "all", x0: BlockVector | None = None) -> Result:
    """Transpose-free QMR with an optional right preconditioner; the residual bound is checked explicitly at the end."""
    k, tol = b.k, _tol(tol, b.k)
    run = op if precon is None else LinearOp(op.n_range, op.n_domain, lambda x: op.apply(precon.apply(x)))
    df, norm = _start(op, b, x0)
    zero = F.transform("r", lambda _: F.lit(0.0))
    df = df.withColumns({"w": F.col("r"), "y": F.col("r"), "h": F.col("r"), "d": zero, "e": zero})
    df = cut(apply_to(run, df, "y", k, "v")).withColumn("u", F.col("v"))
    rho = inner(df, k, ("h", "r"))[0]
    tau, theta, eta = np.sqrt(rho), np.zeros(k), np.zeros(k)
    rel, history, it = safe(tau, norm), [], 0
    while it < max_iter and not _stopped(rel, tol, stop):
        alpha = safe(rho, inner(df, k, ("h", "v"))[0])
        for half in range(2):
            if half:
                df = df.withColumn("y", lin((1, "y"), (-alpha, "v"), k=k)).drop("u")
                df = cut(apply_to(run, df, "y", k, "u"))
            w = lin((1, "w"), (-alpha, "u"), k=k)
            d = lin((1, "y"), (safe(theta**2 * eta, alpha), "d"), k=k)
            df = df.withColumns({"w": w, "d": d})
            theta = safe(np.sqrt(inner(df, k, ("w", "w"))[0]), tau)
            c = 1 / np.sqrt(1 + theta**2)
            tau, eta = tau * theta * c, c**2 * alpha
            df = cut(df.withColumn("e", lin((1, "e"), (eta, "d"), k=k)))
            it += 1
        new = inner(df, k, ("h", "w"))[0]
        beta = safe(new, rho)
        rho = new
        df = df.withColumn("y0", lin((1, "w"), (beta, "y"), k=k)).withColumnRenamed("u", "u0")
        df = cut(apply_to(run, df, "y0", k, "u"))
        df = df.withColumn("v", lin((1, "u"), (beta, "u0"), (beta * beta, "v"), k=k)).withColumn("y", F.col("y0")).drop("u0", "y0")
        rel = safe(tau * np.sqrt(it + 1), norm)
        history.append(rel)
    df = apply_to(precon, df, "e", k, "c") if precon else df.withColumn("c", F.col("e"))
    df = cut(df.select("i", lin((1, "s"), (1, "c"), k=k).alias("s"), F.col("r").alias("r0"), "c"))
    df = cut(apply_to(op, df, "c", k, "ac")).withColumn("r", lin((1, "r0"), (-1, "ac"), k=k))
    rel = safe(np.sqrt(inner(df, k, ("r", "r"))[0]), norm)
    return _result(df, b, it, rel, tol, history)


def idrs(op: LinearOp, b: BlockVector, precon: LinearOp | None = None, s: int = 4, tol: float = 1e-8, max_iter: int = 200, x0: BlockVector | None = None, seed: int = 11) -> Result:
    """IDR(s) on the block-diagonal system of all columns: scalars are sums over the columns, the norm is Frobenius'."""
    if precon is not None:
        raise SolverError("IDR(s) takes no preconditioner")
    k = b.k
    df, _ = _start(op, b, x0)
    shadow = vec.random(b.spark, b.n, k * s, seed).df.select("i", *[F.slice("x", a * k + 1, k).alias(f"p{a}") for a in range(s)])
    zero = F.transform("r", lambda _: F.lit(0.0))
    df = cut(df.join(shadow, "i").withColumns({f"{c}{a}": zero for c in "gu" for a in range(s)}))
    dot = lambda *pairs: [x.sum() for x in inner(df, k, *pairs)]
    norm = float(np.sqrt((vec.dots(b.df, [(F.col("x")[j], F.col("x")[j]) for j in range(k)])).sum()))
    m, omega = np.eye(s), 1.0
    res = np.sqrt(dot(("r", "r"))[0])
    history, it = [], 0
    while it < max_iter and norm > 0 and res / norm > tol:
        f = np.array(dot(*[(f"p{a}", "r") for a in range(s)]))
        for a in range(s):
            c = np.linalg.solve(m[a:, a:], f[a:]) if abs(np.linalg.det(m[a:, a:])) > 0 else np.linalg.lstsq(m[a:, a:], f[a:], rcond=None)[0]
            v = lin((1, "r"), *[(-c[j - a], f"g{j}") for j in range(a, s)], k=k)
            df = df.withColumn("v", v)
            df = df.withColumn(f"u{a}", lin((omega, "v"), *[(c[j - a], f"u{j}") for j in range(a, s)], k=k)).drop(f"g{a}", "v")
            df = cut(apply_to(op, df, f"u{a}", k, f"g{a}"))
            it += 1
            for j in range(a):
                alpha = dot((f"p{j}", f"g{a}"))[0] / m[j, j]
                df = df.withColumns({f"g{a}": lin((1, f"g{a}"), (-alpha, f"g{j}"), k=k), f"u{a}": lin((1, f"u{a}"), (-alpha, f"u{j}"), k=k)})
            m[a:, a] = dot(*[(f"p{j}", f"g{a}") for j in range(a, s)])
            beta = f[a] / m[a, a] if m[a, a] != 0 else 0.0
            df = df.withColumns({"r": lin((1, "r"), (-beta, f"g{a}"), k=k), "s": lin((1, "s"), (beta, f"u{a}"), k=k)})
            f[a + 1 :] -= beta * m[a + 1 :, a]
            res = np.sqrt(dot(("r", "r"))[0])
            history.append(np.array([res / norm]))
            if res / norm <= tol:
                break
        if res / norm <= tol or it >= max_iter:
            break
        df = cut(apply_to(op, df, "r", k, "t"))
        it += 1
        tr, tt, rr = dot(("t", "r"), ("t", "t"), ("r", "r"))
        omega = tr / tt if tt > 0 else 0.0
        cosine = abs(tr) / np.sqrt(tt * rr) if tt * rr > 0 else 1.0
        if 0 < cosine < 0.7:
            omega *= 0.7 / cosine
        df = df.withColumns({"s": lin((1, "s"), (omega, "r"), k=k), "r": lin((1, "r"), (-omega, "t"), k=k)}).drop("t")
        res = np.sqrt(dot(("r", "r"))[0])
        history.append(np.array([res / norm]))
    rel = np.array([res / norm if norm > 0 else 0.0])
    return Result(BlockVector(cut(df).select("i", F.col("s").alias("x")), b.n, k), it, bool(rel[0] <= tol), rel, history)


# ---------------------------------------------------------------- GMRES and MINRES with states


@dataclass
class KrylovState:
    """A system that can be iterated, stopped and iterated on.  status: -1 reset, 0 converged, 1 iterating, 2 basis full, 3 iterations used up."""

    max_basis: int
    b: BlockVector | None = None
    x0: BlockVector | None = None
    basis: DataFrame | None = None
    h: np.ndarray | None = None
    beta: float = 0.0
    norm_b: float = 0.0
    steps: int = 0
    total: int = 0
    status: int = -2
    tol: float = 1e-8
    rel: float = float("inf")
    history: list = field(default_factory=list)

    def reset(self, b: BlockVector | None = None, x0: BlockVector | None = None, tol: float | None = None) -> None:
        """New right-hand side or start vector; the basis is dropped."""
        if b is not None:
            self.b, self.total, self.history = b, 0, []
            self.norm_b = float(vec.norm2(b)[0])
        self.x0, self.basis, self.steps, self.status = x0, None, 0, -1
        self.tol = tol if tol is not None else self.tol

    def delete(self) -> None:
        self.basis, self.b, self.x0, self.status = None, None, None, -2


def create_states(count: int, max_basis: int) -> list[KrylovState]:
    return [KrylovState(max_basis) for _ in range(count)]


def _least_squares(s: KrylovState) -> tuple[np.ndarray, float]:
    e = np.zeros(s.steps + 1)
    e[0] = s.beta
    y = np.linalg.lstsq(s.h[: s.steps + 1, : s.steps], e, rcond=None)[0]
    return y, float(np.linalg.norm(s.h[: s.steps + 1, : s.steps] @ y - e))


def _arnoldi(op: LinearOp, s: KrylovState, precon: LinearOp | None, recurrence: int | None) -> None:
    """One step: the new direction against the basis (all of it, or its last `recurrence` vectors), twice."""
    m = s.steps
    df = s.basis.select("i", F.array(F.get("q", F.lit(m))).alias("x"), "q")
    run = op if precon is None else LinearOp(op.n_range, op.n_domain, lambda x: op.apply(precon.apply(x)))
    df = cut(apply_to(run, df, "x", 1, "w").drop("x"))
    low = 0 if recurrence is None else max(0, m + 1 - recurrence)
    h = np.zeros(m + 2)
    w = F.col("w")[0]
    for _ in range(2):  # classical Gram-Schmidt, one job for all products
        c = vec.dots(df, [(F.col("q")[j], w) for j in range(low, m + 1)])
        h[low : m + 1] += c
        df = df.withColumn("w", F.array(w - sum((F.col("q")[j] * F.lit(float(c[j - low])) for j in range(low, m + 1)), F.lit(0.0))))
    h[m + 1] = np.sqrt(max(vec.dots(df, [(w, w)])[0], 0.0))
    s.h[: m + 2, m] = h
    scale = 1 / h[m + 1] if h[m + 1] > 0 else 0.0
    s.basis = cut(df.select("i", F.concat("q", F.array(w * F.lit(float(scale)))).alias("q")))
    s.steps += 1


def iterate(op: LinearOp, states: Sequence[KrylovState], precon: LinearOp | None = None, max_iter: int = 100, until: str = "any", recurrence: int | None = None) -> int:
    """GMRES steps on all states that can go on, until one has converged or is full ("any") or none can go on ("all")."""
    for it in range(max_iter + 1):
        for s in states:
            if s.status == -2:
                raise SolverError("the state has no right-hand side")
            if s.status == -1:
                r = s.b if s.x0 is None else vec.axpby(-1.0, op.apply(s.x0), 1.0, s.b)
                s.beta = float(vec.norm2(r)[0])
                scale = 1 / s.beta if s.beta > 0 else 0.0
                s.basis = cut(r.df.select("i", F.transform("x", lambda x: x * F.lit(scale)).alias("q")))
                s.h = np.zeros((s.max_basis + 1, s.max_basis))
                s.rel = s.beta / s.norm_b if s.norm_b > 0 else 0.0
                s.status = 0 if s.rel <= s.tol else 1
        active = [s for s in states if s.status == 1]
        if not active or (until == "any" and any(s.status in (0, 2) for s in states)) or it == max_iter:
            break
        for s in active:
            _arnoldi(op, s, precon, recurrence)
            s.total += 1
            s.rel = _least_squares(s)[1] / s.norm_b if s.norm_b > 0 else 0.0
            s.history.append(s.rel)
            if s.rel <= s.tol or s.h[s.steps, s.steps - 1] == 0:
                s.status = 0
            elif s.steps == s.max_basis:
                s.status = 2
    for s in states:
        if s.status == 1:
            s.status = 3
    return min(s.status for s in states)


def update_solution(s: KrylovState, precon: LinearOp | None = None) -> BlockVector:
    """x0 + P^-1 V y from the stored basis."""
    if s.basis is None or s.steps == 0:
        return s.x0 if s.x0 is not None else vec.clone_shape(s.b)
    y, _ = _least_squares(s)
    x = s.basis.select("i", F.array(sum((F.col("q")[j] * F.lit(float(y[j])) for j in range(s.steps)), F.lit(0.0))).alias("x"))
    x = BlockVector(x, s.b.n, 1)
    if precon is not None:
        x = precon.apply(x)
    return x if s.x0 is None else vec.axpby(1.0, s.x0, 1.0, x)


def _restarted(op: LinearOp, b: BlockVector, precon: LinearOp | None, tol, max_iter: int, basis: int, block: int, recurrence: int | None) -> Result:
    """At most `block` systems are iterated at a time; when one is done the next takes its place."""
    k, tol = b.k, _tol(tol, b.k)
    waiting = list(range(k))
    slots: dict[int, KrylovState] = {}
    solved: dict[int, KrylovState] = {}
    parts: dict[int, BlockVector] = {}
    while waiting or slots:
        while waiting and len(slots) < block:
            c = waiting.pop(0)
            s = KrylovState(basis)
            s.reset(vec.view_block(b, c, c), tol=float(tol[c]))
            slots[c] = s
        iterate(op, list(slots.values()), precon, max_iter, "any", recurrence)
        for c, s in list(slots.items()):
            if s.status == 1:
                continue
            x = update_solution(s, precon)
            x = BlockVector(cut(x.df), x.n, 1)
            left = max_iter - s.total
            if s.status == 0 or left <= 0:
                parts[c], solved[c] = x, s
                del slots[c]
            elif s.status in (2, 3):
                total, history = s.total, s.history
                s.reset(x0=x)
                s.total, s.history = total, history
    x = vec.gather([parts[c] for c in range(k)])
    rel = np.array([solved[c].rel for c in range(k)])
    return Result(x, max(solved[c].total for c in range(k)), bool((rel <= tol).all()), rel, [np.array(solved[c].history) for c in range(k)])


def gmres(op: LinearOp, b: BlockVector, precon: LinearOp | None = None, tol=1e-8, max_iter: int = 200, basis: int = 30, block: int = 4) -> Result:
    """Restarted GMRES with an optional right preconditioner, for any number of systems."""
    return _restarted(op, b, precon, tol, max_iter, basis, block, None)


def minres(op: LinearOp, b: BlockVector, precon: LinearOp | None = None, tol=1e-8, max_iter: int = 200, basis: int = 60, block: int = 4) -> Result:
    """MINRES for symmetric operators: the same states with a three-term recurrence.  A preconditioner is refused."""
    if precon is not None:
        raise SolverError("MINRES takes no preconditioner")
    return _restarted(op, b, None, tol, max_iter, basis, block, 2)


SOLVERS: dict[str, Callable[..., Result]] = {"PCG": pcg, "BICGSTAB": bicgstab, "QMR": qmr, "IDRS": idrs, "GMRES": gmres, "MINRES": minres}


def solver_op(op: LinearOp, method: str = "GMRES", precon: LinearOp | None = None, tol: float = 1e-8, max_iter: int = 100, **more) -> LinearOp:
    """An operator whose application solves op x = b."""
    run = SOLVERS.get(method.upper())
    if run is None:
        raise SolverError(f"no solver {method!r}")
    return LinearOp(op.n_domain, op.n_range, lambda b: run(op, b, precon=precon, tol=tol, max_iter=max_iter, **more).x)

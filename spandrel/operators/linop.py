"""Linear operators: closures from block vector to block vector, and how they are put together."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np

from ..types import BlockVector, Matrix, SolverError
from . import spmv, vec


@dataclass
class LinearOp:
    """y = alpha op(x) + beta y through closures that compute op(x); members that are None aren't available."""

    n_range: int
    n_domain: int
    op: Callable[[BlockVector], BlockVector]
    op_t: Callable[[BlockVector], BlockVector] | None = None
    op_shifted: Callable[[BlockVector, np.ndarray], BlockVector] | None = None
    shifts: Sequence[float] | None = None
    use_transpose: bool = False
    retune: Callable | None = None
    matrix: Matrix | None = None
    owned: list = field(default_factory=list)

    def _combine(self, ax: BlockVector, alpha: float, beta: float, y: BlockVector | None) -> BlockVector:
        return vec.axpby(alpha, ax, beta if y is not None else 0.0, y) if alpha != 1 or (y is not None and beta != 0) else ax

    def apply(self, x: BlockVector, alpha: float = 1.0, beta: float = 0.0, y: BlockVector | None = None) -> BlockVector:
        if alpha == 0:
            return vec.scale(y, beta)
        if x.n != self.n_domain:
            raise SolverError("the vector does not match the operator's domain")
        return self._combine(self.op(x), alpha, beta, y)

    def apply_t(self, x: BlockVector, alpha: float = 1.0, beta: float = 0.0, y: BlockVector | None = None) -> BlockVector:
        if self.op_t is None:
            raise SolverError("the operator has no transpose")
        return self._combine(self.op_t(x), alpha, beta, y)

    def apply_shifted(self, sigma: Sequence[float], x: BlockVector, alpha: float = 1.0, beta: float = 0.0, y: BlockVector | None = None) -> BlockVector:
        if self.op_shifted is None:
            raise SolverError("the operator takes no shifts")
        return self._combine(self.op_shifted(x, np.broadcast_to(np.asarray(sigma, float), (x.k,))), alpha, beta, y)

    def apply_respective(self, x: BlockVector, alpha: float = 1.0, beta: float = 0.0, y: BlockVector | None = None) -> BlockVector:
        """As the operator's own transpose flag and shifts say."""
        if self.use_transpose:
            if self.shifts is not None:
                raise SolverError("a shifted transpose is not available")
            return self.apply_t(x, alpha, beta, y)
        return self.apply(x, alpha, beta, y) if self.shifts is None else self.apply_shifted(self.shifts, x, alpha, beta, y)

    def fused_apply_mvtmv(self, v: BlockVector, alpha: float = 1.0, beta: float = 0.0, w: BlockVector | None = None) -> spmv.Fused:
        out = self.apply(v, alpha, beta, w).persisted()
        return spmv.Fused(out, vec.gram(out, out).a, vec.gram(v, out).a)

    def update(self, sigma: float = 0.0, kernel: BlockVector | None = None, b_kernel: BlockVector | None = None) -> None:
        if self.retune is not None:
            self.retune(sigma, kernel, b_kernel)

    def destroy(self) -> None:
        for x in self.owned:
            x.unpersist()
        self.owned.clear()


def wrap_matrix(a: Matrix) -> LinearOp:
    return LinearOp(a.nrows, a.ncols, lambda x: spmv.spmv(a, x), lambda x: spmv.spmv_t(a, x), lambda x, s: spmv.spmv(a, x, shift=s), matrix=a)


def wrap_matrix_pair(a: Matrix, b: Matrix) -> LinearOp:
    """apply: A x; apply_shifted: (A + sigma[j] B) x."""
    one = lambda x: np.ones(x.k)
    return LinearOp(a.nrows, a.ncols, lambda x: spmv.spmv(a, x), lambda x: spmv.spmv_t(a, x), lambda x, s: spmv.spmv_pair(1.0, one(x), a, s, b, x), matrix=a)


def product(a: LinearOp, b: LinearOp) -> LinearOp:
    """A B as one plan."""
    if a.n_domain != b.n_range:
        raise SolverError("the operators do not match")
    return LinearOp(a.n_range, b.n_domain, lambda x: a.apply(b.apply(x)))


class ProductOp(LinearOp):
    """A product of any number of operators; the first added is applied first."""

    def __init__(self, *members: LinearOp):
        self.members: list[LinearOp] = []
        super().__init__(0, 0, self._run)
        for m in members:
            self.extend(m)

    def _run(self, x: BlockVector) -> BlockVector:
        for m in self.members:
            x = m.apply_respective(x)
        return x

    def extend(self, m: LinearOp) -> ProductOp:
        if self.members and m.n_domain != self.n_range:
            raise SolverError("the operators do not match")
        self.members.append(m)
        self.n_range, self.n_domain = m.n_range, self.members[0].n_domain
        return self


def identity(n: int) -> LinearOp:
    return LinearOp(n, n, lambda x: x, lambda x: x, lambda x, s: vec.vscale(x, 1 + s))


def from_function(n_range: int, n_domain: int, f: Callable[[BlockVector], BlockVector]) -> LinearOp:
    return LinearOp(n_range, n_domain, f)


def projection(v: BlockVector, w: BlockVector) -> LinearOp:
    """x - w v' x."""
    from ..types import SdMat

    def run(x: BlockVector) -> BlockVector:
        return vec.times_sdmat(-1.0, w, SdMat(vec.gram(v, x).a), 1.0, x)

    return LinearOp(v.n, v.n, run)


def skew_projection(p: LinearOp, v: BlockVector, bv: BlockVector) -> LinearOp:
    """(I - P v (Bv' P v)^-1 Bv') x, with P an approximate inverse."""
    from ..types import SdMat

    pv = p.apply(v).persisted()
    inner = vec.gram(bv, pv).a

    def run(x: BlockVector) -> BlockVector:
        return vec.times_sdmat(-1.0, pv, SdMat(np.linalg.solve(inner, vec.gram(bv, x).a)), 1.0, x)

    return LinearOp(v.n, v.n, run, owned=[pv.df])

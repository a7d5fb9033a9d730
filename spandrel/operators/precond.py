"""Preconditioners for A - sigma B as operators, by name: none, user_defined, jacobi, block_jacobi."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..types import BlockVector, Matrix, SolverError
from . import linop, vec
from .linop import LinearOp

METHODS = ("none", "user_defined", "jacobi", "block_jacobi")


def _options(text: str) -> dict[str, str]:
    return dict(p.split("=", 1) for p in text.replace(",", " ").split() if "=" in p)


def _shifted(a: Matrix, sigma: float, b: Matrix | None) -> Matrix:
    if sigma == 0:
        return a
    if b is None:
        return a.plus_diagonal(-sigma)
    both = a.df.select("i", "j", "v").unionByName(b.df.select("i", "j", (F.col("v") * float(-sigma)).alias("v")))
    return Matrix.from_entries(both, a.nrows, a.ncols)


def jacobi(a: Matrix) -> LinearOp:
    """x_i / a_ii; rows without a diagonal entry are passed through."""
    d = a.df.where((F.col("i") == F.col("j")) & (F.col("v") != 0)).select("i", F.col("v").alias("d")).persist()

    def run(x: BlockVector) -> BlockVector:
        df = x.df.join(d, "i", "left").select("i", F.transform("x", lambda v: v / F.coalesce("d", F.lit(1.0))).alias("x"))
        return BlockVector(df, x.n, x.k, x.map)

    return LinearOp(a.nrows, a.ncols, run, run, owned=[d])


def block_jacobi(a: Matrix, size: int = 32) -> LinearOp:
    """Solves with the diagonal blocks of `size` consecutive rows (least squares where a block is singular)."""
    block = lambda c: F.floor(F.col(c) / size)
    inside = a.df.where(block("i") == block("j")).select(block("i").alias("block"), (F.col("i") % size).alias("r"), (F.col("j") % size).alias("c"), "v")
    cells = inside.groupBy("block").agg(F.collect_list(F.struct("r", "c", "v")).alias("e")).persist()

    def solver(transposed: bool) -> Callable[[BlockVector], BlockVector]:
        def run_on(x: BlockVector) -> BlockVector:
            k = x.k

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    out_i, out_x = [], []
                    for e, rows in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                        i = np.array([r["i"] for r in rows])
                        order = np.argsort(i)
                        i, v = i[order], np.array([r["x"] for r in rows])[order]
                        m = np.zeros((size, size))
                        for q in e or ():
                            m[q["r"], q["c"]] += q["v"]
                        own = i % size
                        m = m[np.ix_(own, own)]
                        bare = ~m.any(axis=1) & ~m.any(axis=0)
                        m[bare, bare] = 1
                        out_x.append(np.linalg.lstsq(m.T if transposed else m, v, rcond=None)[0])
                        out_i.append(i)
                    yield vec.packed(np.concatenate(out_i), np.concatenate(out_x)) if out_i else vec.packed(np.zeros(0, np.int64), np.zeros((0, k)))

            lists = x.df.groupBy(block("i").alias("block")).agg(F.collect_list(F.struct("i", "x")).alias("rows"))  # at most `size` rows
            joined = lists.join(cells, "block", "left").select("e", "rows")
            return BlockVector(joined.mapInArrow(run, "i long, x array<double>"), x.n, k, x.map)

        return run_on

    return LinearOp(a.nrows, a.ncols, solver(False), solver(True), owned=[cells])


def create(a: Matrix, method: str = "none", options: str = "", sigma: float = 0.0, b: Matrix | None = None, user: LinearOp | Callable | None = None) -> LinearOp:
    """The preconditioner named; "usage" raises with the names.  It can be re-tuned to another shift by update()."""
    name = method.lower()

    def build(s: float) -> LinearOp:
        m = _shifted(a, s, b)
        if name in ("none", "no_precon"):
            return linop.identity(a.nrows)
        if name == "jacobi":
            return jacobi(m)
        if name == "block_jacobi":
            return block_jacobi(m, int(_options(options).get("size", 32)))
        if name in ("user_defined", "user_precon"):
            if user is None:
                raise SolverError("user_defined needs an operator")
            return user if isinstance(user, LinearOp) else linop.from_function(a.nrows, a.ncols, user)
        raise SolverError(f"{method!r} is none of {', '.join(METHODS)}")

    inner = build(sigma)
    out = LinearOp(a.nrows, a.ncols, lambda x: inner.apply(x), lambda x: inner.apply_t(x), owned=inner.owned)

    def retune(s: float, kernel=None, b_kernel=None) -> None:
        nonlocal inner
        out.destroy()
        inner = build(s)
        out.owned = inner.owned

    out.retune = retune
    out.op_shifted = lambda x, s: build(float(s[0])).apply(x) if np.ptp(s) == 0 else vec.gather([build(float(v)).apply(vec.view_block(x, j, j)) for j, v in enumerate(s)])
    return out

"""Sparse-matrix products: an equi-join on the column index and a grouped sum, with the combinations that share them.

Rows without entries come from the vector that is combined, or from the range map by a left join, so the result has a
row for every index.  beta = 0 overwrites (a NaN in the old vector does not leak).  The join is left to Catalyst: a
vector under the broadcast threshold is broadcast, otherwise both sides are shuffled on the column; keep a matrix
`by_column()` over a loop and only vectors and partial sums move.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..types import BlockVector, Matrix, SdMat, SolverError
from . import vec


def _sums(rows: DataFrame, value: Column, x: Column, k: int) -> DataFrame:
    """(i, ax): sums over the entries of a row; one aggregate for each column, or by position where there are many."""
    if k <= 64:
        return rows.groupBy("i").agg(F.array(*[F.sum(value * x[j]) for j in range(k)]).alias("ax"))
    flat = rows.select("i", value.alias("v"), F.posexplode(x).alias("pos", "x")).groupBy("i", "pos").agg(F.sum(F.col("v") * F.col("x")).alias("s"))
    return flat.groupBy("i").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "s"))), lambda p: p["s"]).alias("ax"))


def product(a: Matrix, df: DataFrame, x: str, k: int) -> DataFrame:
    """(i, ax) for the rows with entries."""
    right = df.select(F.col("i").alias("j"), F.col(x).alias("x"))
    return _sums(a.df.select("i", "j", "v").join(right, "j"), F.col("v"), F.col("x"), k)


def _zeros(k: int) -> Column:
    return F.array_repeat(F.lit(0.0), k)


def attach(a: Matrix, df: DataFrame, x: str, k: int, name: str) -> DataFrame:
    """df with A x beside its columns (zero where a row has no entries); df has a row for every index of the range."""
    ax = product(a, df, x, k).withColumnRenamed("ax", name)
    return df.join(ax, "i", "left").withColumn(name, F.coalesce(name, _zeros(k)))


def spmv(a: Matrix, x: BlockVector, alpha: float = 1.0, beta: float = 0.0, y: BlockVector | None = None, shift: float | Sequence[float] | None = None) -> BlockVector:
    """alpha (A + shift I) x + beta y, with a shift for all columns or one for each."""
    if a.ncols != x.n:
        raise SolverError("the vector does not match the domain map")
    shifts = None if shift is None else np.broadcast_to(np.asarray(shift, float), (x.k,))
    if alpha == 0:
        return vec.scale(y, beta) if y is not None and beta != 0 else BlockVector(a.maps.range.rows(a.spark).select("i", _zeros(x.k).alias("x")), a.nrows, x.k)
    ax = product(a, x.df, "x", x.k)
    if y is not None and beta != 0:
        df = y.df.select("i", F.col("x").alias("y"))
    else:
        df = x.df.select("i") if a.nrows == a.ncols else a.maps.range.rows(a.spark)
    df = df.join(ax, "i", "left").withColumn("ax", F.coalesce("ax", _zeros(x.k)))
    out = F.transform("ax", lambda s: s * float(alpha)) if alpha != 1 else F.col("ax")
    if shifts is not None and shifts.any():
        df = df.join(x.df.select("i", F.col("x").alias("own")), "i")
        out = F.zip_with(out, F.zip_with("own", vec.literal(alpha * shifts), lambda p, q: p * q), lambda p, q: p + q)
    if y is not None and beta != 0:
        out = F.zip_with(out, F.col("y"), lambda p, q: p + q * float(beta))
    return BlockVector(df.select("i", out.alias("x")), a.nrows, x.k, x.map if a.nrows == a.ncols else None)


def spmv_t(a: Matrix, x: BlockVector, alpha: float = 1.0, beta: float = 0.0, y: BlockVector | None = None) -> BlockVector:
    """alpha A' x + beta y."""
    return spmv(a.transposed(), x, alpha, beta, y)


def complex_spmv(a: Matrix, x: BlockVector, alpha: complex = 1.0, conjugate_transpose: bool = False) -> BlockVector:
    """alpha A x (or alpha A^H x) with complex entries; real parts in x, imaginary ones in x_im."""
    a = a.transposed() if conjugate_transpose else a
    im = F.col("v_im") if a.complex else F.lit(0.0)
    re_x, im_x = F.col("x"), F.col("x_im") if x.complex else F.transform("x", lambda _: F.lit(0.0))
    right = x.df.select(F.col("i").alias("j"), re_x.alias("xr"), im_x.alias("xi"))
    rows = a.df.select("i", "j", "v", im.alias("w")).join(right, "j")
    ar, ai = float(np.real(alpha)), float(np.imag(alpha))
    out = []
    for part in range(2):
        cols = []
        for j in range(x.k):
            re = F.col("v") * F.col("xr")[j] - F.col("w") * F.col("xi")[j]
            ii = F.col("v") * F.col("xi")[j] + F.col("w") * F.col("xr")[j]
            cols.append(F.sum(re * ar - ii * ai if part == 0 else re * ai + ii * ar))
        out.append(F.array(*cols))
    got = rows.groupBy("i").agg(out[0].alias("x"), out[1].alias("x_im"))
    base = a.maps.range.rows(a.spark)
    return BlockVector(base.join(got, "i", "left").select("i", F.coalesce("x", _zeros(x.k)).alias("x"), F.coalesce("x_im", _zeros(x.k)).alias("x_im")), a.nrows, x.k)


# ---------------------------------------------------------------- fused


def spmv_pair(alpha: float, shifts1: Sequence[float], a1: Matrix, shifts2: Sequence[float], a2: Matrix, x: BlockVector, beta: float = 0.0, y: BlockVector | None = None) -> BlockVector:
    """alpha (shifts1[j] A1 + shifts2[j] A2) x + beta y: tagged entries of both matrices, one join and one sum."""
    entries = a1.df.select("i", "j", "v", F.lit(0).alias("t")).unionByName(a2.df.select("i", "j", "v", F.lit(1).alias("t")))
    rows = entries.join(x.df.select(F.col("i").alias("j"), "x"), "j")
    s1, s2 = (np.broadcast_to(np.asarray(s, float), (x.k,)) for s in (shifts1, shifts2))
    sums = [F.sum(F.when(F.col("t") == 0, F.lit(float(alpha * s1[j]))).otherwise(F.lit(float(alpha * s2[j]))) * F.col("v") * F.col("x")[j]) for j in range(x.k)]
    got = rows.groupBy("i").agg(F.array(*sums).alias("ax"))
    read = y is not None and beta != 0
    base = y.df.select("i", F.col("x").alias("y")) if read else a1.maps.range.rows(a1.spark)
    out = F.coalesce("ax", _zeros(x.k))
    if read:
        out = F.zip_with(out, F.col("y"), lambda p, q: p + q * float(beta))
    return BlockVector(base.join(got, "i", "left").select("i", out.alias("x")), a1.nrows, x.k)


@dataclass
class Fused:
    """Results of a fused operation; w is persisted until `done()`."""

    w: BlockVector
    ww: np.ndarray | None = None
    vw: np.ndarray | None = None
    u: BlockVector | None = None

    def done(self) -> None:
        self.w.df.unpersist()


def spmv_mvdot(alpha: float, a: Matrix, v: BlockVector, beta: float = 0.0, w: BlockVector | None = None, want_ww: bool = True, want_vw: bool = True) -> Fused:
    """W = alpha A V + beta W with the column dots W'W and V'W: one pass over the persisted result."""
    out = spmv(a, v, alpha, beta, w).persisted()
    df, (x, y) = vec.aligned(v, out)
    pairs = [(y[j], y[j]) for j in range(v.k) if want_ww] + [(x[j], y[j]) for j in range(v.k) if want_vw]
    got = vec.dots(df if want_vw else out.df.withColumnRenamed("x", "x1"), pairs) if pairs else np.zeros(0)
    return Fused(out, got[: v.k] if want_ww else None, got[-v.k :] if want_vw else None)


def spmv_mvtmv(alpha: float, a: Matrix, v: BlockVector, beta: float = 0.0, w: BlockVector | None = None) -> Fused:
    """The same with the Gram matrices W'W and V'W, from one product of the stacked rows."""
    out = spmv(a, v, alpha, beta, w).persisted()
    df, (x, y) = vec.aligned(v, out)
    g = vec.gram_of(df.select(F.concat(x, y).alias("s"), y.alias("y")), "s", 2 * v.k, "y", v.k)
    return Fused(out, g[v.k :], g[: v.k])


def spmv_mvdot_mvadd(alpha: float, a: Matrix, v: BlockVector, beta: float, w: BlockVector | None, gamma: float, delta: float, u: BlockVector) -> Fused:
    """As spmv_mvdot, then U = gamma W + delta U."""
    out = spmv_mvdot(alpha, a, v, beta, w)
    return replace(out, u=vec.axpby(gamma, out.w, delta, u))


def mvsdi_mvtmv(alpha: float, v: BlockVector, w: BlockVector, c: SdMat, beta: float = 0.0, d: SdMat | None = None) -> tuple[BlockVector, SdMat]:
    """W = W C, D = alpha V' (W C) + beta D; by linearity the Gram matrix needs no second pass: (V'W) C."""
    g = vec.gram(v, w, alpha).a @ c.a
    return vec.times_sdmat_inplace(w, c), SdMat(g if d is None or beta == 0 else g + beta * d.a)


def mvsd_mvtmv(alpha: float, v: BlockVector, c: SdMat, beta: float, w: BlockVector) -> tuple[BlockVector, SdMat]:
    """W = alpha V C + beta W and W'W, the latter from the Gram matrix of the stacked rows [V W]."""
    df, (x, y) = vec.aligned(v, w)
    g = vec.gram_of(df.select(F.concat(x, y).alias("s")), "s", v.k + w.k, "s", v.k + w.k)
    t = np.concatenate([alpha * c.a, beta * np.eye(w.k)])
    return vec.times_sdmat(alpha, v, c, beta, w), SdMat(t.T @ g @ t)

"""Row projections: Kaczmarz sweeps per block of rows with averaging where blocks share unknowns, and CARP-CG.

The number of blocks is part of the semantics and an explicit parameter, never the number of partitions.  A sweep sends
each block its rows and the unknowns they touch, runs through the rows forward and backward, and averages the results
of an unknown over the blocks that touch it.  Complex shifts work on complex unknowns.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..streaming.loop import cut
from ..types import BlockVector, Map, Matrix, Result, SolverError
from . import vec


@dataclass
class Carp:
    """Set up for a matrix: its packed rows by block, and how many blocks touch each unknown."""

    a: Matrix
    map: Map
    rows: DataFrame
    touched: DataFrame

    def delete(self) -> None:
        self.rows.unpersist()
        self.touched.unpersist()


def touching_blocks(a: Matrix, blocks: int) -> DataFrame:
    """(j, weight): one over the number of row blocks that touch unknown j."""
    where = Map(a.nrows, blocks).block_of(F.col("i"))
    return a.df.groupBy("j").agg((F.lit(1.0) / F.count_distinct(where)).alias("weight"))


def setup(a: Matrix, blocks: int = 8) -> Carp:
    """Rows are packed (i, columns, values); a row without entries has no part in a sweep."""
    if a.complex:
        raise SolverError("sweeps take a real matrix; shifts may be complex")
    m = Map(a.nrows, blocks)
    cells = F.collect_list(F.struct("j", "v"))
    rows = a.df.where("v != 0").groupBy("i").agg(cells.alias("e")).select(m.block_of(F.col("i")).alias("block"), "i", F.col("e.j").alias("j"), F.col("e.v").alias("v")).persist()
    # every shifted row also touches its own unknown
    own = rows.select("block", F.explode("j").alias("j")).unionByName(rows.select("block", F.col("i").alias("j"))).distinct().persist()
    return Carp(a, m, rows, own)


def _kaczmarz(table: pa.Table, k: int, sigma: np.ndarray, omega: np.ndarray) -> pa.Table:
    """A forward and a backward sweep over the rows of one block."""
    kind = np.array(table["kind"].to_numpy())
    rows = np.flatnonzero(kind == 0)
    vars_ = np.flatnonzero(kind == 1)
    ids = table["i"].to_numpy()
    lists = table["x"].combine_chunks() if isinstance(table["x"], pa.ChunkedArray) else table["x"]
    values = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    off = np.asarray(values.offsets)
    flat = np.asarray(values.values)
    names = ids[vars_]
    order = np.argsort(names)
    names = names[order]
    x = np.stack([flat[off[p] : off[p + 1]] for p in vars_[order]])
    z = x[:, :k] + 1j * x[:, k:]
    cols = table["j"].combine_chunks()
    cols = cols.chunk(0) if isinstance(cols, pa.ChunkedArray) else cols
    vals = table["v"].combine_chunks()
    vals = vals.chunk(0) if isinstance(vals, pa.ChunkedArray) else vals
    rows = rows[np.argsort(ids[rows])]
    work = []
    for p in rows:
        j = np.searchsorted(names, np.asarray(cols[p].values))
        v = np.asarray(vals[p].values)
        own = int(np.searchsorted(names, ids[p]))
        b = flat[off[p] : off[p + 1]]
        at = np.flatnonzero(j == own)
        if not len(at):
            j, v, at = np.append(j, own), np.append(v, 0.0), [len(v)]
        w = np.repeat(v[:, None].astype(complex), k, axis=1)
        w[at[0]] -= sigma
        size = (np.abs(w) ** 2).sum(axis=0)
        work.append((j, w, b[:k] + 1j * b[k:], np.where(size > 0, omega / np.where(size > 0, size, 1), 0)))
    for j, w, b, scale in [*work, *reversed(work)]:
        z[j] += w.conj() * (scale * (b - (w * z[j]).sum(axis=0)))
    out = np.concatenate([z.real, z.imag], axis=1)
    arrays = pa.ListArray.from_arrays((np.arange(len(out) + 1) * 2 * k).astype(np.int32), pa.array(out.ravel()))
    return pa.table({"j": pa.array(names), "x": arrays})


def sweep(c: Carp, sigma: Sequence[complex], b: DataFrame, x: DataFrame, k: int, omega: float | Sequence[float] = 1.0) -> DataFrame:
    """(i, x): x after the sweep; b and x are frames (i, x) of 2 k numbers, real parts first."""
    sigma = np.broadcast_to(np.asarray(sigma, complex), (k,))
    omega = np.broadcast_to(np.asarray(omega, float), (k,))
    empty_j, empty_v = F.array().cast("array<long>"), F.array().cast("array<double>")
    rows = c.rows.join(b, "i").select("block", F.lit(0).alias("kind"), "i", "j", "v", "x")
    unknowns = c.touched.join(x.withColumnRenamed("i", "j"), "j").select("block", F.lit(1).alias("kind"), F.col("j").alias("i"), empty_j.alias("j"), empty_v.alias("v"), "x")
    moved = rows.unionByName(unknowns).groupBy("block").applyInArrow(lambda t: _kaczmarz(t, k, sigma, omega), "j long, x array<double>")
    mean = moved.groupBy(F.col("j").alias("i")).agg(F.array(*[F.avg(F.col("x")[n]) for n in range(2 * k)]).alias("moved"))
    return x.join(mean, "i", "left").select("i", F.coalesce("moved", "x").alias("x"))


def _packed(re: BlockVector, im: BlockVector | None = None) -> DataFrame:
    if im is None:
        return re.df.select("i", F.concat("x", F.transform("x", lambda _: F.lit(0.0))).alias("x"))
    df, (x, y) = vec.aligned(re, im)
    return df.select("i", F.concat(x, y).alias("x"))


def sweep_vectors(c: Carp, sigma: Sequence[complex], b: BlockVector, x_re: BlockVector, x_im: BlockVector | None = None, omega: float = 1.0) -> tuple[BlockVector, BlockVector]:
    """One sweep with real right-hand sides; both parts of the result."""
    k = b.k
    out = sweep(c, sigma, _packed(b), _packed(x_re, x_im), k, omega)
    part = lambda s: BlockVector(out.select("i", F.slice("x", s, k).alias("x")), b.n, k)
    return part(1), part(k + 1)


def bordered(a: Matrix, q: BlockVector) -> Matrix:
    """[A Q; Q' 0] as a matrix of its own, so sweeps on the bordered system are sweeps on it."""
    cells = q.df.select("i", F.posexplode("x").alias("p", "v"))
    right = cells.select("i", (F.lit(a.ncols) + F.col("p")).cast("long").alias("j"), "v")
    below = cells.select((F.lit(a.nrows) + F.col("p")).cast("long").alias("i"), F.col("i").alias("j"), "v")
    return Matrix(a.df.select("i", "j", "v").unionByName(right).unionByName(below), a.nrows + q.k, a.ncols + q.k)


def carp_cg(a: Matrix, b: BlockVector, shifts: Sequence[complex] | None = None, tol: float = 1e-8, max_iter: int = 200, omega: float = 1.0, blocks: int = 8, check_every: int = 10, stop: str = "all") -> Result:
    """Conjugate gradients on x = sweep(x), i.e. (I - Q) x = sweep(0) with Q the symmetric double sweep without b.

    The residual of A - shift I is computed explicitly every `check_every` steps and when the iteration says it is done.
    """
    from . import spmv

    k = b.k
    sigma = np.zeros(k, complex) if shifts is None else np.broadcast_to(np.asarray(shifts, complex), (k,))
    c = setup(a, blocks)
    rhs = _packed(b)
    zero = rhs.select("i", F.transform("x", lambda _: F.lit(0.0)).alias("x"))
    names = [F.col("x")[j] for j in range(k)]
    norm_b = np.sqrt(vec.dots(b.df, [(n, n) for n in names]))

    def residual(df: DataFrame) -> np.ndarray:
        x = BlockVector(df.select("i", F.col("s").alias("x")), b.n, 2 * k)
        ax = spmv.spmv(a, x)
        both, (u, v) = vec.aligned(x, ax)
        both = both.select("i", u.alias("u"), v.alias("v")).join(rhs, "i")
        pairs = []
        for j in range(k):
            re = F.col("x")[j] - (F.col("v")[j] - F.col("u")[j] * float(sigma[j].real) + F.col("u")[j + k] * float(sigma[j].imag))
            im = F.col("x")[j + k] - (F.col("v")[j + k] - F.col("u")[j + k] * float(sigma[j].real) - F.col("u")[j] * float(sigma[j].imag))
            pairs += [(re, re), (im, im)]
        return np.sqrt(vec.dots(both, pairs).reshape(k, 2).sum(axis=1)) / np.where(norm_b > 0, norm_b, 1)

    def scaled(coef: np.ndarray, name: str):
        return F.zip_with(name, vec.literal(np.concatenate([coef, coef])), lambda p, q: p * q)

    plus = lambda u, v: F.zip_with(u, v, lambda p, q: p + q)
    start = sweep(c, sigma, rhs, zero, k, omega)
    df = cut(start.select("i", F.transform("x", lambda _: F.lit(0.0)).alias("s"), F.col("x").alias("r"), F.col("x").alias("p")))
    two = lambda u, v: vec.dots(df, [(F.col(u)[j], F.col(v)[j]) for j in range(2 * k)]).reshape(2, k).sum(axis=0)
    rr = two("r", "r")
    first, rel, history, it = np.sqrt(rr), np.where(norm_b > 0, 1.0, 0.0), [], 0
    while it < max_iter and not (np.all(rel <= tol) if stop == "all" else np.any(rel <= tol)):
        swept = sweep(c, sigma, zero, df.select("i", F.col("p").alias("x")), k, omega)
        df = cut(df.join(swept.withColumnRenamed("x", "q"), "i").withColumn("q", F.zip_with("p", "q", lambda u, v: u - v)))
        pq = two("p", "q")
        alpha = np.where(pq != 0, rr / np.where(pq != 0, pq, 1), 0.0)
        df = df.select("i", plus("s", scaled(alpha, "p")).alias("s"), plus("r", scaled(-alpha, "q")).alias("r"), "p")
        new = two("r", "r")
        beta = np.where(rr != 0, new / np.where(rr != 0, rr, 1), 0.0)
        df = cut(df.withColumn("p", plus("r", scaled(beta, "p"))))
        rr, it = new, it + 1
        near = np.sqrt(rr) / np.where(first > 0, first, 1)
        if it % check_every == 0 or np.all(near <= tol) or it == max_iter:
            rel = residual(df)
            history.append(rel)
    c.delete()
    x = replace(BlockVector(df.select("i", F.slice("s", 1, k).alias("x"), F.slice("s", k + 1, k).alias("x_im")), b.n, k)) if np.any(sigma.imag) else BlockVector(df.select("i", F.slice("s", 1, k).alias("x")), b.n, k)
    return Result(x, it, bool(np.all(rel <= tol)), rel, history)

"""Block vectors: fills, views, element-wise arithmetic, reductions, products with small matrices.

Element-wise operations are array expressions (one projection; two vectors need one join on i).  Reductions are grouped
sums with partial aggregation.  Products of wide blocks run as Arrow batches through BLAS; narrow ones as expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..types import BlockVector, Map, SdMat, SolverError

#: Up to so many scalar products are written as one aggregate each; beyond it, Gram matrices go through Arrow.
NARROW = 256


def literal(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


# ---------------------------------------------------------------- creation and data


def create(spark: SparkSession, n: int, k: int, value: float = 0.0, map_: Map | None = None) -> BlockVector:
    return BlockVector(spark.range(n).select(F.col("id").alias("i"), F.array_repeat(F.lit(float(value)), k).alias("x")), n, k, map_)


def clone_shape(v: BlockVector) -> BlockVector:
    return put_value(v, 0.0)


def put_value(v: BlockVector, value: float) -> BlockVector:
    return v.with_x(F.array_repeat(F.lit(float(value)), v.k))


def put_func(v: BlockVector, f: Callable[[Column, Column, Column], Column]) -> BlockVector:
    """x[j] = f(i, j, x[j]) with column expressions; j counts from 0."""
    return v.with_x(F.transform("x", lambda x, j: f(F.col("i"), j, x).cast("double")))


def put_python_func(v: BlockVector, f: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> BlockVector:
    """x = f(i, j, x) on numpy arrays of whole batches (i: rows x 1, j: 1 x k)."""
    k = v.k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i = b.column(0).to_numpy()
            x = dense(b.column(1), k)
            yield packed(i, np.broadcast_to(f(i[:, None], np.arange(k)[None, :], x), x.shape))

    return replace(v, df=v.df.select("i", "x").mapInArrow(run, "i long, x array<double>"))


def random(spark: SparkSession, n: int, k: int, seed: int = 42) -> BlockVector:
    """Uniform in [-1, 1], a function of (i, j, seed) alone, so alike for any partitioning."""
    unit = lambda j: F.xxhash64(F.col("id"), j, F.lit(seed)) / F.lit(2.0**63)
    return BlockVector(spark.range(n).select(F.col("id").alias("i"), F.array(*[unit(F.lit(j)) for j in range(k)]).alias("x")), n, k)


def get_data(v: BlockVector, row_major: bool = True) -> np.ndarray:
    """Entries as a driver array (n x k), for small vectors; column-major on request."""
    t = v.df.select("i", "x").orderBy("i").toArrow().combine_chunks()
    x = dense(t["x"].chunk(0), v.k) if t.num_rows else np.zeros((0, v.k))
    return np.ascontiguousarray(x) if row_major else np.asfortranarray(x)


def set_data(spark: SparkSession, x: np.ndarray, row_major: bool = True) -> BlockVector:
    x = np.atleast_2d(np.asarray(x, np.float64))
    if not row_major:
        x = x.T
    return BlockVector(spark.createDataFrame(pa.Table.from_batches([packed(np.arange(len(x)), x)])).select("i", "x"), len(x), x.shape[1])


def dense(col: pa.Array, k: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, k)


def packed(i: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
    x = np.ascontiguousarray(x, np.float64)
    lists = pa.ListArray.from_arrays((np.arange(len(x) + 1) * x.shape[1]).astype(np.int32), pa.array(x.ravel()))
    return pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), lists], names=["i", "x"])


# ---------------------------------------------------------------- views and blocks


def view_block(v: BlockVector, jmin: int, jmax: int) -> BlockVector:
    """Columns jmin..jmax, both included, from 0."""
    if not 0 <= jmin <= jmax < v.k:
        raise SolverError("columns out of range")
    return v.with_x(F.slice("x", jmin + 1, jmax - jmin + 1), jmax - jmin + 1)


get_block = view_block


def aligned(*vs: BlockVector) -> tuple[DataFrame, list[Column]]:
    """One frame with the arrays of all vectors side by side, and their columns; the same frame twice needs no join."""
    frames: list[DataFrame] = []
    cols = []
    df = None
    for v in vs:
        seen = next((k for k, f in enumerate(frames) if f is v.df), None)
        if seen is None:
            seen = len(frames)
            frames.append(v.df)
            own = v.df.select("i", F.col("x").alias(f"x{seen}"))
            df = own if df is None else df.join(own, "i")
        cols.append(F.col(f"x{seen}"))
    return df, cols


def set_block(v: BlockVector, w: BlockVector, jmin: int, jmax: int) -> BlockVector:
    df, (x, y) = aligned(v, w)
    parts = [F.slice(x, 1, jmin)] * (jmin > 0) + [y] + [F.slice(x, jmax + 2, v.k - jmax - 1)] * (jmax < v.k - 1)
    return replace(v, df=df.select("i", F.concat(*parts).alias("x")))


def gather(blocks: Sequence[BlockVector]) -> BlockVector:
    df, cols = aligned(*blocks)
    return replace(blocks[0], df=df.select("i", F.concat(*cols).alias("x")), k=sum(b.k for b in blocks))


def scatter(v: BlockVector, widths: Sequence[int]) -> list[BlockVector]:
    at = np.concatenate([[0], np.cumsum(widths)]).astype(int)
    return [view_block(v, int(a), int(b) - 1) for a, b in zip(at, at[1:], strict=False)]


def to_map(v: BlockVector, target: Map) -> BlockVector:
    """The vector in another distribution: permuted if the maps' permutations differ, and dealt by range."""
    df = v.df
    if v.map is not None and v.map.permutation is not None:
        df = df.join(v.map.permutation.select(F.col("to").alias("i"), F.col("i").alias("__g")), "i").select(F.col("__g").alias("i"), "x")
    if target.permutation is not None:
        df = df.join(target.permutation, "i").select(F.col("to").alias("i"), "x")
    return BlockVector(df.repartitionByRange(target.blocks, "i"), v.n, v.k, target)


# ---------------------------------------------------------------- element-wise


def scale(v: BlockVector, s: float) -> BlockVector:
    return v.with_x(F.transform("x", lambda x: x * float(s)))


def vscale(v: BlockVector, s: Sequence[float]) -> BlockVector:
    return v.with_x(F.zip_with("x", literal(s), lambda x, y: x * y))


def axpby(a: float, x: BlockVector, b: float, y: BlockVector) -> BlockVector:
    """a x + b y; y is not read if b = 0, nor x if a = 0."""
    if b == 0:
        return scale(x, a)
    if a == 0:
        return scale(y, b)
    df, (u, w) = aligned(x, y)
    return replace(y, df=df.select("i", F.zip_with(u, w, lambda p, q: p * float(a) + q * float(b)).alias("x")))


def vaxpby(a: Sequence[float], x: BlockVector, b: float, y: BlockVector) -> BlockVector:
    """a[j] x(:, j) + b y(:, j)."""
    if b == 0:
        return vscale(x, a)
    df, (u, w) = aligned(x, y)
    term = F.zip_with(u, literal(a), lambda p, q: p * q)
    return replace(y, df=df.select("i", F.zip_with(term, w, lambda p, q: p + q * float(b)).alias("x")))


def times_elementwise(a: float, v: BlockVector, w: BlockVector) -> BlockVector:
    """a v * w; a one-column v serves all columns of w."""
    df, (x, y) = aligned(v, w)
    out = F.transform(y, lambda q: q * x[0] * float(a)) if v.k == 1 and w.k > 1 else F.zip_with(x, y, lambda p, q: p * q * float(a))
    return replace(w, df=df.select("i", out.alias("x")))


def normalize(v: BlockVector) -> tuple[BlockVector, np.ndarray]:
    """Columns of norm one and the norms; zero columns stay."""
    n = norm2(v)
    return vscale(v, np.where(n > 0, 1 / np.where(n > 0, n, 1), 0)), n


# ---------------------------------------------------------------- reductions


def dots(df: DataFrame, pairs: Sequence[tuple[Column, Column]]) -> np.ndarray:
    """Sums of products of column pairs in one job."""
    row = df.agg(*[F.coalesce(F.sum(a * b), F.lit(0.0)).alias(f"s{k}") for k, (a, b) in enumerate(pairs)]).first()
    return np.array(row, float)


def norm2_frame(v: BlockVector) -> DataFrame:
    """(j, value): the norms as a table."""
    return v.df.select(F.posexplode("x").alias("j", "x")).groupBy("j").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("value"))


def norm2(v: BlockVector) -> np.ndarray:
    return np.sqrt(dots(v.df, [(F.col("x")[j], F.col("x")[j]) for j in range(v.k)]))


def dot(v: BlockVector, w: BlockVector) -> np.ndarray:
    df, (x, y) = aligned(v, w)
    return dots(df, [(x[j], y[j]) for j in range(v.k)])


def norm_f(v: BlockVector) -> float:
    return float(np.sqrt(v.df.agg(F.coalesce(F.sum(F.aggregate("x", F.lit(0.0), lambda s, x: s + x * x)), F.lit(0.0))).first()[0]))


def gram_frame(df: DataFrame, x: str, kx: int, y: str, ky: int) -> DataFrame:
    """(r, c, v): x' y summed over the rows of df; partial products in BLAS, one small matrix for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((kx, ky))
        for b in batches:
            total += dense(b.column(0), kx).T @ dense(b.column(1), ky)
        r, c = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(r.ravel().astype(np.int32)), pa.array(c.ravel().astype(np.int32)), pa.array(total.ravel())], names=["r", "c", "v"])

    return df.select(F.col(x).alias("a"), F.col(y).alias("b")).mapInArrow(run, "r int, c int, v double").groupBy("r", "c").agg(F.sum("v").alias("v"))


def gram_of(df: DataFrame, x: str, kx: int, y: str, ky: int) -> np.ndarray:
    if kx * ky <= NARROW:
        return dots(df, [(F.col(x)[a], F.col(y)[b]) for a in range(kx) for b in range(ky)]).reshape(kx, ky)
    out = np.zeros((kx, ky))
    for r, c, v in gram_frame(df, x, kx, y, ky).collect():
        out[r, c] = v
    return out


def gram(v: BlockVector, w: BlockVector, alpha: float = 1.0, beta: float = 0.0, c: SdMat | None = None) -> SdMat:
    """alpha v' w + beta c."""
    df, (x, y) = aligned(v, w)
    g = alpha * gram_of(df.select(x.alias("a"), y.alias("b")), "a", v.k, "b", w.k)
    return SdMat(g if beta == 0 or c is None else g + beta * c.a)


def two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a + b and its rounding error."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def two_prod(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a b and its rounding error, by splitting the factors in halves."""
    split = lambda x: (lambda t: (t - (t - x), x - (t - (t - x))))(134217729.0 * x)
    p = a * b
    (ah, al), (bh, bl) = split(a), split(b)
    return p, ((ah * bh - p) + ah * bl + al * bh) + al * bl


def robust_gram(v: BlockVector, w: BlockVector) -> SdMat:
    """v' w in double-double: partial sums of each task in numpy, added up in a fixed order on the driver."""
    df, (x, y) = aligned(v, w)
    kx, ky = v.k, w.k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hi, lo, least = np.zeros((kx, ky)), np.zeros((kx, ky)), 1 << 62
        for b in batches:
            i = b.column(0).to_numpy()
            least = min(least, int(i.min(initial=least)))
            p, e = two_prod(dense(b.column(1), kx)[:, :, None], dense(b.column(2), ky)[:, None, :])
            while len(p) > 1:  # pairwise, so errors stay small and the loop short
                if len(p) % 2:
                    p, e = np.concatenate([p, np.zeros((1, kx, ky))]), np.concatenate([e, np.zeros((1, kx, ky))])
                p, d = two_sum(p[0::2], p[1::2])
                e = e[0::2] + e[1::2] + d
            if len(p):
                hi, d = two_sum(hi, p[0])
                lo += e[0] + d
        yield pa.RecordBatch.from_arrays([pa.array([least]), pa.array([hi.ravel()], pa.list_(pa.float64())), pa.array([lo.ravel()], pa.list_(pa.float64()))], names=["at", "hi", "lo"])

    parts = df.select("i", x.alias("a"), y.alias("b")).mapInArrow(run, "at long, hi array<double>, lo array<double>").orderBy("at").collect()
    hi, lo = np.zeros((kx, ky)), np.zeros((kx, ky))
    for p in parts:
        hi, d = two_sum(hi, np.array(p["hi"]).reshape(kx, ky))
        lo += d + np.array(p["lo"]).reshape(kx, ky)
    hi, lo = two_sum(hi, lo)
    return SdMat(hi, lo)


# ---------------------------------------------------------------- products with small matrices


def times(x: Column, k: int, c: np.ndarray) -> Column:
    """Expression: the row x (length k) times c."""
    return F.array(*[sum((x[a] * F.lit(float(c[a, b])) for a in range(k) if c[a, b] != 0), F.lit(0.0)) for b in range(c.shape[1])])


def times_sdmat(alpha: float, v: BlockVector, c: SdMat, beta: float = 0.0, w: BlockVector | None = None) -> BlockVector:
    """alpha v c + beta w."""
    if c.nrows != v.k:
        raise SolverError("shapes do not match")
    m = alpha * c.a
    if beta == 0 or w is None:
        if m.size <= NARROW:
            return v.with_x(times(F.col("x"), v.k, m), c.ncols)
        return _apply(v.df.select("i", "x"), [(v.k, m)], v)
    df, (x, y) = aligned(v, w)
    if m.size <= NARROW:
        return replace(v, df=df.select("i", F.zip_with(times(x, v.k, m), y, lambda p, q: p + q * float(beta)).alias("x")), k=c.ncols)
    return _apply(df.select("i", x.alias("a"), y.alias("b")), [(v.k, m), (w.k, beta * np.eye(w.k))], v)


def _apply(df: DataFrame, parts: list[tuple[int, np.ndarray]], like: BlockVector) -> BlockVector:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield packed(b.column(0).to_numpy(), sum(dense(b.column(1 + n), k) @ m for n, (k, m) in enumerate(parts)))

    return replace(like, df=df.mapInArrow(run, "i long, x array<double>"), k=parts[0][1].shape[1])


def times_sdmat_inplace(v: BlockVector, m: SdMat) -> BlockVector:
    """The leading columns of v become v m; the others stay."""
    full = np.eye(v.k)
    full[:, : m.ncols] = 0
    full[: m.nrows, : m.ncols] = m.a
    return times_sdmat(1.0, v, SdMat(full))


def times_sdmat_add(v: BlockVector, c: SdMat, w: BlockVector, d: SdMat) -> BlockVector:
    """v c + w d in one pass."""
    df, (x, y) = aligned(v, w)
    if c.a.size + d.a.size <= NARROW:
        return replace(v, df=df.select("i", F.zip_with(times(x, v.k, c.a), times(y, w.k, d.a), lambda p, q: p + q).alias("x")), k=c.ncols)
    return _apply(df.select("i", x.alias("a"), y.alias("b")), [(v.k, c.a), (w.k, d.a)], v)


# ---------------------------------------------------------------- complex vectors


def combine(re: BlockVector, im: BlockVector | None) -> BlockVector:
    """A complex vector from its parts; a missing imaginary part is zero."""
    if im is None:
        return replace(re, df=re.df.select("i", "x", F.transform("x", lambda _: F.lit(0.0)).alias("x_im")))
    return replace(re, df=re.df.select("i", "x").join(im.df.select("i", F.col("x").alias("x_im")), "i"))


def split(v: BlockVector) -> tuple[BlockVector, BlockVector]:
    im = F.col("x_im") if v.complex else F.transform("x", lambda _: F.lit(0.0))
    return v.with_x(F.col("x")), v.with_x(im)


def complex_dot(v: BlockVector, w: BlockVector) -> np.ndarray:
    """conj(v)' w, column by column."""
    a, b, c, d = *split(v), *split(w)
    df, (p, q, r, s) = aligned(a, b, c, d)
    parts = dots(df, [x for j in range(v.k) for x in ((p[j], r[j]), (q[j], s[j]), (p[j], s[j]), (q[j], r[j]))]).reshape(-1, 4)
    return parts[:, 0] + parts[:, 1] + 1j * (parts[:, 2] - parts[:, 3])


def single(v: BlockVector) -> BlockVector:
    """Rounded to single precision, kept in double."""
    return v.with_x(F.transform("x", lambda x: x.cast("float").cast("double")))

"""Objects of the data model: maps, contexts, sparse matrices, block vectors, small matrices, results.

A sparse matrix is a frame (i, j, v), a block vector a frame (i, x ARRAY<DOUBLE>) with one row for each index; complex
ones also have v_im or x_im.  Sizes, symmetry and distribution are metadata beside the frame.  Everything is immutable:
what writes in place elsewhere returns a new object here.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from enum import Enum

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPS = float(np.finfo(np.float64).eps)
RANK_TOL = 10 * EPS
RANK_TOL_ROBUST = 1e-12
#: Scalar types: single and double, real and complex.  Sums are always taken in double.
SCALARS = {"S": np.float32, "D": np.float64, "C": np.complex64, "Z": np.complex128}


class Named(Enum):
    @classmethod
    def from_str(cls, s: str):
        for m in cls:
            if s.strip().upper() == m.name:
                return m
        raise ValueError(f"{s!r} is not one of {[m.name for m in cls]}")

    def __str__(self) -> str:
        return self.name


EigSort = Named("EigSort", "NO_EIGSORT LM SM LR SR TARGET INVALID_EIGSORT")
EigExtr = Named("EigExtr", "STANDARD HARMONIC INVALID_EIGEXTR")
LinSolv = Named("LinSolv", "DO_NOTHING GMRES MINRES CARP_CG PCG BICGSTAB QMR IDRS USER_LINSOLV INVALID_LINSOLV")
MatSym = Named("MatSym", "GENERAL HERMITIAN COMPLEX_SYMMETRIC PATTERN_SYMMETRIC INVALID_MATSYM")
Precon = Named("Precon", "NO_PRECON JACOBI BLOCK_JACOBI USER_PRECON INVALID_PRECON")
Projection = Named("Projection", "NONE PRE POST PRE_POST SKEW ALL")


class SolverError(RuntimeError):
    """A negative return code: bad arguments, incompatible maps, or something that is not implemented."""


def type_avail(letter: str) -> bool:
    return letter in SCALARS


@dataclass(frozen=True)
class Map:
    """N indices in contiguous blocks; the first N mod p blocks hold one more.  An optional frame (i, to) permutes them."""

    n: int
    blocks: int = 1
    permutation: DataFrame | None = None

    def bounds(self, block: int) -> tuple[int, int]:
        """First and last index of a block."""
        q, r = divmod(self.n, self.blocks)
        low = block * q + min(block, r)
        return low, low + q + (block < r) - 1

    def block_of(self, i):
        """Column: the block of an index column."""
        q, r = divmod(self.n, self.blocks)
        cut = r * (q + 1)
        return F.when(i < cut, F.floor(i / (q + 1))).otherwise(r + F.floor((i - cut) / max(q, 1))).cast("int")

    def compatible(self, other: Map) -> int:
        """0 same, 1 the same blocks in another local order, 2 permuted over the blocks, -1 incompatible."""
        if self.n != other.n:
            return -1
        if self.blocks == other.blocks and self.permutation is other.permutation:
            return 0
        if self.permutation is None and other.permutation is None:
            return 2
        ours, theirs = (m.permutation or m.identity(SparkSession.active()) for m in (self, other))
        moved = ours.alias("a").join(theirs.alias("b"), "i").where("a.to != b.to")
        across = moved.where(self.block_of(F.col("a.to")) != other.block_of(F.col("b.to")))
        return 2 if across.limit(1).count() or self.blocks != other.blocks else 1

    def identity(self, spark: SparkSession) -> DataFrame:
        return spark.range(self.n).select(F.col("id").alias("i"), F.col("id").alias("to"))

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.range(self.n).withColumnRenamed("id", "i")


@dataclass(frozen=True)
class Context:
    row: Map
    col: Map
    range: Map
    domain: Map

    @classmethod
    def of(cls, nrows: int, ncols: int, blocks: int = 1) -> Context:
        r, c = Map(nrows, blocks), Map(ncols, blocks)
        return cls(r, c, r, c)


@dataclass(frozen=True)
class Matrix:
    df: DataFrame
    nrows: int
    ncols: int
    symmetry: MatSym = MatSym.GENERAL
    context: Context | None = None

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    @property
    def complex(self) -> bool:
        return "v_im" in self.df.columns

    @property
    def maps(self) -> Context:
        return self.context or Context.of(self.nrows, self.ncols)

    def local_nnz(self) -> DataFrame:
        return self.df.groupBy(F.spark_partition_id().alias("block")).agg(F.count("*").alias("nnz"))

    def global_nnz(self) -> DataFrame:
        return self.df.agg(F.count("*").alias("nnz"))

    def column_map(self) -> DataFrame:
        """(block, j): the columns that each row block touches, its halo included."""
        return self.df.select(self.maps.row.block_of(F.col("i")).alias("block"), "j").distinct()

    def transposed(self) -> Matrix:
        v = [F.col("v"), *([(-F.col("v_im")).alias("v_im")] if self.complex else [])]
        c = self.maps
        return replace(self, df=self.df.select(F.col("j").alias("i"), F.col("i").alias("j"), *v), nrows=self.ncols, ncols=self.nrows, context=Context(c.col, c.row, c.domain, c.range))

    def plus_diagonal(self, shift: float) -> Matrix:
        """A + shift I, entries summed."""
        diagonal = self.maps.range.rows(self.spark).select("i", F.col("i").alias("j"), F.lit(float(shift)).alias("v"))
        return replace(self, df=self.df.select("i", "j", "v").unionByName(diagonal).groupBy("i", "j").agg(F.sum("v").alias("v")))

    def persisted(self) -> Matrix:
        return replace(self, df=self.df.persist())

    def by_column(self) -> Matrix:
        """Entries dealt and kept by column, the side on which products join, so that only vectors move in a loop."""
        return replace(self, df=self.df.repartition("j").persist())

    def delete(self) -> None:
        self.df.unpersist()

    @classmethod
    def from_entries(cls, df: DataFrame, nrows: int, ncols: int, **more) -> Matrix:
        """Duplicate entries are summed."""
        vs = [c for c in ("v", "v_im") if c in df.columns]
        return cls(df.groupBy(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j")).agg(*[F.sum(F.col(c).cast("double")).alias(c) for c in vs]), nrows, ncols, **more)


@dataclass(frozen=True)
class BlockVector:
    df: DataFrame
    n: int
    k: int
    map: Map | None = None

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    @property
    def complex(self) -> bool:
        return "x_im" in self.df.columns

    def with_x(self, x, k: int | None = None) -> BlockVector:
        return replace(self, df=self.df.select("i", x.alias("x")), k=self.k if k is None else k)

    def local_length(self) -> DataFrame:
        return self.df.groupBy(F.spark_partition_id().alias("block")).agg(F.count("*").alias("n"))

    def persisted(self) -> BlockVector:
        return replace(self, df=self.df.persist())

    def delete(self) -> None:
        self.df.unpersist()

    def show(self, n: int = 20) -> None:
        self.df.orderBy("i").show(n, truncate=False)


@dataclass
class SdMat:
    """A small dense matrix on the driver; `lo` holds the low words of a double-double one."""

    a: np.ndarray
    lo: np.ndarray | None = None

    @property
    def nrows(self) -> int:
        return self.a.shape[0]

    @property
    def ncols(self) -> int:
        return self.a.shape[1]

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(r, c, float(self.a[r, c])) for r in range(self.nrows) for c in range(self.ncols)], "r int, c int, v double")


@dataclass
class Result:
    """What a solver returns: solution, iterations, whether it converged, and the history of relative residuals."""

    x: BlockVector | None
    iterations: int
    converged: bool
    residuals: np.ndarray
    history: list[np.ndarray] = field(default_factory=list)

    @property
    def status(self) -> str:
        return "converged" if self.converged else "max_iterations"

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(c, self.iterations, self.status, float(r)) for c, r in enumerate(np.atleast_1d(self.residuals))], "col int, iterations int, status string, rel_residual double")

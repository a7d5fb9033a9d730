"""Queries over the driver tables, each through the library's operators, with the SQL that gives the same rows.

Block vectors come out as (i, j, x), small matrices as (r, c, v); numbers are rounded, and -0 is 0.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dense, eig, linop, orth, precond, rowproj, solve, vec
from ..operators import spmv as sp
from ..sources import gen, io, relational
from ..streaming.loop import checkpoint_dir
from ..types import BlockVector, EigSort, LinSolv, Map, Matrix, SdMat

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            SQL[name or f.__name__] = sql
        return f

    return register


# ---------------------------------------------------------------- inputs and outputs


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts_by_suppliers(spark: SparkSession, sf_dir: str, value: str = "l_quantity") -> Matrix:
    """Sum of a lineitem column by part (row) and supplier (column)."""
    n, m = load(spark, sf_dir, "part").count(), load(spark, sf_dir, "supplier").count()
    df = load(spark, sf_dir, "lineitem")
    v = F.lit(1.0) if value == "1" else F.col(value)
    return relational.matrix_from_table(df, F.col("l_partkey"), F.col("l_suppkey"), v, n, m)


def suppliers(spark: SparkSession, sf_dir: str, *values: Column) -> BlockVector:
    df = load(spark, sf_dir, "supplier")
    return relational.vector_from_table(df, F.col("s_suppkey"), list(values), df.count())


def parts(spark: SparkSession, sf_dir: str, *values: Column) -> BlockVector:
    df = load(spark, sf_dir, "part")
    return relational.vector_from_table(df, F.col("p_partkey"), list(values), df.count())


def embeddings(spark: SparkSession, sf_dir: str) -> BlockVector:
    df = load(spark, sf_dir, "embeddings")
    return BlockVector(df.select(F.col("vec_id").alias("i"), F.col("embedding").cast("array<double>").alias("x")), df.count(), 64)


def nice(c: Column, digits: int = 6) -> Column:
    return F.round(c, digits) + 0.0


def long(v: BlockVector, digits: int = 6) -> DataFrame:
    return v.df.select("i", F.posexplode("x").alias("j", "x")).select("i", "j", nice(F.col("x"), digits).alias("x"))


def numbers(spark: SparkSession, values, digits: int = 6) -> DataFrame:
    return spark.createDataFrame([(k, round(float(v), digits) + 0.0) for k, v in enumerate(np.ravel(values))], "j int, value double")


def small(spark: SparkSession, m: SdMat, digits: int = 6) -> DataFrame:
    return m.frame(spark).select("r", "c", nice(F.col("v"), digits).alias("v"))


def grid(spark: SparkSession, n: int, k: int) -> BlockVector:
    """x[i, j] = (i (j + 1)) mod 7 - 3."""
    return vec.put_func(vec.create(spark, n, k), lambda i, j, x: (i * (j + 1)) % 7 - 3)


def coefficients(n: int, m: int) -> SdMat:
    """c[r, c] = (r + 2 c) mod 5 - 2."""
    r, c = np.indices((n, m))
    return SdMat(((r + 2 * c) % 5 - 2).astype(float))


E = "e AS (SELECT vec_id AS i, CAST(unnest(range(64)) AS INT) AS j, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings)"
A = "a AS (SELECT l_partkey AS i, l_suppkey AS j, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2)"
N = 200  # rows of generated matrices
T = f"t AS (SELECT r.i, r.i + d.d AS j, CASE WHEN d.d = 0 THEN 2.0 ELSE -1 / (1 + 1e-8) END AS v FROM range({N}) r(i), (VALUES (-1), (0), (1)) d(d) WHERE r.i + d.d BETWEEN 0 AND {N - 1})"
G = f"g AS (SELECT i, CAST(j AS INT) AS j, CAST((i * (j + 1)) % 7 - 3 AS DOUBLE) AS x FROM range({N}) a(i), range(3) b(j))"
TG = "tg AS (SELECT t.i, g.j, sum(t.v * g.x) AS x FROM t JOIN g ON t.j = g.i GROUP BY 1, 2)"
C3 = "c AS (SELECT CAST(r AS INT) AS r, CAST(c AS INT) AS c, CAST((r + 2 * c) % 5 - 2 AS DOUBLE) AS v FROM range(3) a(r), range(3) b(c))"


def toeplitz(spark: SparkSession, n: int = N) -> Matrix:
    return gen.tridiagonal(spark, n, 2.0, -1 / (1 + 1e-8))


# ---------------------------------------------------------------- products


@query(f"WITH {A} SELECT p_partkey AS i, coalesce(sum(v), 0) AS y FROM part LEFT JOIN a ON a.i = p_partkey GROUP BY 1")
def spmv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity of each part over all suppliers, A 1."""
    a = parts_by_suppliers(spark, sf_dir)
    return sp.spmv(a, suppliers(spark, sf_dir, F.lit(1.0))).df.select("i", F.col("x")[0].alias("y"))


@query(f"WITH {A} SELECT p_partkey AS i, round(2 * coalesce(sum(v * s_acctbal), 0) + 3 * any_value(p_retailprice), 4) + 0.0 AS y FROM part LEFT JOIN a ON a.i = p_partkey LEFT JOIN supplier ON s_suppkey = a.j GROUP BY 1")
def spmv_axpby(spark, sf_dir):
    out = sp.spmv(parts_by_suppliers(spark, sf_dir), suppliers(spark, sf_dir, F.col("s_acctbal")), 2.0, 3.0, parts(spark, sf_dir, F.col("p_retailprice")))
    return out.df.select("i", nice(F.col("x")[0], 4).alias("y"))


@query(f"WITH {A} SELECT s_suppkey AS i, coalesce(sum(v * (a.i % 10)), 0.0) AS y FROM supplier LEFT JOIN a ON a.j = s_suppkey GROUP BY 1")
def spmv_transposed(spark, sf_dir):
    out = sp.spmv_t(parts_by_suppliers(spark, sf_dir), parts(spark, sf_dir, F.col("p_partkey") % 10))
    return out.df.select("i", F.col("x")[0].alias("y"))


@query(f"WITH {T}, {G}, {TG} SELECT g.i, g.j, round(3 * (tg.x + 0.5 * g.x) - 2 * g.x, 6) + 0.0 AS x FROM g JOIN tg USING (i, j)")
def spmv_shift(spark, sf_dir):
    x = grid(spark, N, 3)
    return long(sp.spmv(toeplitz(spark), x, 3.0, -2.0, x, 0.5))


@query(f"WITH {T}, {G}, {TG} SELECT g.i, g.j, round(tg.x + (g.j - 1) * g.x, 6) + 0.0 AS x FROM g JOIN tg USING (i, j)")
def spmv_column_shifts(spark, sf_dir):
    return long(sp.spmv(toeplitz(spark), grid(spark, N, 3), shift=[-1.0, 0.0, 1.0]))


@query(
    "WITH a AS (SELECT l_partkey AS i, l_suppkey AS j, sum(l_quantity) AS q, count(*) AS n FROM lineitem GROUP BY 1, 2) "
    "SELECT p_partkey AS i, coalesce(sum(2 * (3 * q + 10 * n) * (s_suppkey % 5)), 0.0) AS y FROM part LEFT JOIN a ON a.i = p_partkey LEFT JOIN supplier ON s_suppkey = a.j GROUP BY 1"
)
def spmv_pair(spark, sf_dir):
    x = suppliers(spark, sf_dir, F.col("s_suppkey") % 5)
    out = sp.spmv_pair(2.0, [3.0], parts_by_suppliers(spark, sf_dir), [10.0], parts_by_suppliers(spark, sf_dir, "1"), x)
    return out.df.select("i", F.col("x")[0].alias("y"))


@query(f"WITH {T}, {G}, {TG} SELECT j, round(sum(tg.x * tg.x), 6) AS ww, round(sum(g.x * tg.x), 6) AS vw FROM tg JOIN g USING (i, j) GROUP BY j")
def spmv_mvdot(spark, sf_dir):
    f = sp.spmv_mvdot(1.0, toeplitz(spark), grid(spark, N, 3))
    f.done()
    return spark.createDataFrame([(j, round(float(a), 6), round(float(b), 6)) for j, (a, b) in enumerate(zip(f.ww, f.vw, strict=True))], "j int, ww double, vw double")


@query(f"WITH {T}, {G}, {TG} SELECT a.j AS r, b.j AS c, round(sum(a.x * b.x), 6) + 0.0 AS v FROM g a JOIN tg b USING (i) GROUP BY 1, 2")
def spmv_mvtmv(spark, sf_dir):
    f = sp.spmv_mvtmv(1.0, toeplitz(spark), grid(spark, N, 3))
    f.done()
    return small(spark, SdMat(f.vw))


@query(f"WITH {T}, {G}, {TG} SELECT g.i, g.j, round(2 * tg.x - g.x, 6) + 0.0 AS x FROM g JOIN tg USING (i, j)")
def spmv_mvdot_mvadd(spark, sf_dir):
    x = grid(spark, N, 3)
    return long(sp.spmv_mvdot_mvadd(1.0, toeplitz(spark), x, 0.0, None, 2.0, -1.0, x).u)


@query("SELECT o.o_custkey AS i, count(*) AS n, round(sum(l_extendedprice), 2) AS y FROM lineitem JOIN orders o ON o_orderkey = l_orderkey GROUP BY 1")
def customer_revenue(spark, sf_dir):
    """Two incidence matrices one after the other: customers x orders times orders x ones."""
    orders = load(spark, sf_dir, "orders")
    n, m = orders.count(), load(spark, sf_dir, "customer").count()
    lines = relational.vector_from_table(load(spark, sf_dir, "lineitem"), F.col("l_orderkey"), [F.lit(1.0), F.col("l_extendedprice")], n)
    a = relational.matrix_from_table(orders, F.col("o_custkey"), F.col("o_orderkey"), F.lit(1.0), m, n)
    out = sp.spmv(a, lines).df.where(F.col("x")[0] > 0)
    return out.select("i", F.col("x")[0].cast("long").alias("n"), nice(F.col("x")[1], 2).alias("y"))


@query("SELECT event_type, round(sum(value), 4) AS y, count(*) AS n FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL GROUP BY 1")
def event_graph(spark, sf_dir):
    """Event types x users: keys are numbered first, then A 1 for values and counts."""
    ev = load(spark, sf_dir, "events").where("value is not null and user_id is not null")
    types, users = relational.dense_ids(ev, "event_type").persist(), relational.dense_ids(ev, "user_id").persist()
    n, m = types.count(), users.count()
    rows = ev.join(types.withColumnRenamed("id", "r"), "event_type").join(users.withColumnRenamed("id", "u"), "user_id")
    ones = vec.create(spark, m, 1, 1.0)
    y = sp.spmv(relational.matrix_from_table(rows, F.col("r"), F.col("u"), F.col("value"), n, m), ones)
    c = sp.spmv(relational.matrix_from_table(rows, F.col("r"), F.col("u"), F.lit(1.0), n, m), ones)
    df, (a, b) = vec.aligned(y, c)
    return df.join(types, F.col("i") == F.col("id")).select("event_type", nice(a[0], 4).alias("y"), b[0].cast("long").alias("n"))


# ---------------------------------------------------------------- metadata


@query("SELECT count(*) AS nnz FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)")
def global_nnz(spark, sf_dir):
    return parts_by_suppliers(spark, sf_dir).global_nnz()


@query("SELECT (SELECT count(*) FROM part) AS nrows, (SELECT count(*) FROM supplier) AS ncols, 64 AS num_vectors, (SELECT count(*) FROM embeddings) AS vector_length")
def shapes(spark, sf_dir):
    a, v = parts_by_suppliers(spark, sf_dir), embeddings(spark, sf_dir)
    return spark.createDataFrame([(a.nrows, a.ncols, v.k, v.n)], "nrows long, ncols long, num_vectors int, vector_length long")


_BLOCK = "CAST(CASE WHEN i < (n % 7) * (n // 7 + 1) THEN i // (n // 7 + 1) ELSE (n % 7) + (i - (n % 7) * (n // 7 + 1)) // (n // 7) END AS INT)"


@query(f"SELECT DISTINCT {_BLOCK} AS block, j FROM (SELECT l_partkey AS i, l_suppkey AS j FROM lineitem), (SELECT count(*) AS n FROM part)")
def column_map(spark, sf_dir):
    """The columns that each of 7 row blocks touches."""
    a = parts_by_suppliers(spark, sf_dir)
    c = Map(a.nrows, 7)
    return Matrix(a.df, a.nrows, a.ncols, context=type(a.maps)(c, Map(a.ncols, 7), c, Map(a.ncols, 7))).column_map()


@query(f"WITH b AS (SELECT DISTINCT {_BLOCK} AS block, j FROM (SELECT l_partkey AS i, l_suppkey AS j FROM lineitem), (SELECT count(*) AS n FROM part)) SELECT j, 1.0 / count(*) AS weight FROM b GROUP BY j")
def carp_setup(spark, sf_dir):
    return rowproj.touching_blocks(parts_by_suppliers(spark, sf_dir), 7)


@query(f"WITH {E} SELECT (SELECT count(*) FROM embeddings) - 1 - i AS i, j, round(x, 6) + 0.0 AS x FROM e")
def to_map(spark, sf_dir):
    """All vectors in reverse order, in 5 blocks."""
    v = embeddings(spark, sf_dir)
    v = BlockVector(v.df, v.n, v.k, Map(v.n))
    reverse = spark.range(v.n).select(F.col("id").alias("i"), (v.n - 1 - F.col("id")).alias("to"))
    return long(vec.to_map(v, Map(v.n, 5, reverse)))


# ---------------------------------------------------------------- vectors


def vector_query(name: str, expression: str, f: Callable[[BlockVector], BlockVector], where: str = "") -> None:
    sql = f"WITH {E} SELECT i, j, round({expression}, 6) + 0.0 AS x FROM e {where}"
    query(sql, name)(lambda spark, sf_dir: long(f(embeddings(spark, sf_dir))))


vector_query("mvec_create", "0.0", lambda v: vec.create(v.spark, v.n, v.k))
vector_query("mvec_clone_shape", "0.0", vec.clone_shape)
vector_query("mvec_put_value", "2.5", lambda v: vec.put_value(v, 2.5))
vector_query("mvec_put_func", "i + 10 * j + 2 * x", lambda v: vec.put_func(v, lambda i, j, x: i + 10 * j + 2 * x))
vector_query("mvec_put_python_func", "i + 10 * j + 2 * x", lambda v: vec.put_python_func(v, lambda i, j, x: i + 10 * j + 2 * x))
vector_query("mvec_scale", "-3 * x", lambda v: vec.scale(v, -3.0))
vector_query("mvec_vscale", "(j - 31) * x", lambda v: vec.vscale(v, np.arange(64) - 31.0))
vector_query("mvec_add_mvec", "2 * (x * x) - 3 * x", lambda v: vec.axpby(2.0, vec.times_elementwise(1.0, v, v), -3.0, v))
vector_query("mvec_vadd_mvec", "(j % 4) * (x * 2) + 0.5 * x", lambda v: vec.vaxpby(np.arange(64) % 4, vec.scale(v, 2.0), 0.5, v))
vector_query("mvec_times_mvec_elemwise", "-2 * (x * x)", lambda v: vec.times_elementwise(-2.0, v, v))
vector_query("mvec_single_precision", "CAST(CAST(x AS FLOAT) AS DOUBLE)", vec.single)
for _name, _f in (("mvec_view_block", vec.view_block), ("mvec_get_block", vec.get_block)):
    query(f"WITH {E} SELECT i, CAST(j - 5 AS INT) AS j, round(x, 6) + 0.0 AS x FROM e WHERE j BETWEEN 5 AND 20", _name)(lambda spark, sf_dir, f=_f: long(f(embeddings(spark, sf_dir), 5, 20)))
vector_query("mvec_set_block", "CASE WHEN j BETWEEN 10 AND 13 THEN 7.0 ELSE x END", lambda v: vec.set_block(v, vec.put_value(vec.view_block(v, 0, 3), 7.0), 10, 13))
vector_query("mvec_gather_scatter", "x", lambda v: vec.gather(vec.scatter(v, [3, 40, 21])))


@query(f"WITH {E}, s AS (SELECT i, x FROM e WHERE j = 3) SELECT e.i, j, round(2 * e.x * s.x, 6) + 0.0 AS x FROM e JOIN s USING (i)")
def mvec_times_column(spark, sf_dir):
    v = embeddings(spark, sf_dir)
    return long(vec.times_elementwise(2.0, vec.view_block(v, 3, 3), v))


@query(f"WITH {E}, n AS (SELECT j, sqrt(sum(x * x)) AS s FROM e GROUP BY j) SELECT i, j, round(x / s, 6) + 0.0 AS x FROM e JOIN n USING (j)")
def mvec_normalize(spark, sf_dir):
    return long(vec.normalize(embeddings(spark, sf_dir))[0])


@query(f"WITH {E} SELECT j, round(sqrt(sum(x * x)), 6) AS value FROM e GROUP BY j")
def mvec_norm2(spark, sf_dir):
    return vec.norm2_frame(embeddings(spark, sf_dir)).select("j", nice(F.col("value")).alias("value"))


@query(f"WITH {E} SELECT j, round(sum(x * (x * x)), 6) + 0.0 AS value FROM e GROUP BY j")
def mvec_dot_mvec(spark, sf_dir):
    v = embeddings(spark, sf_dir)
    return numbers(spark, vec.dot(v, vec.times_elementwise(1.0, v, v)))


@query(f"WITH {E} SELECT a.j AS r, b.j AS c, round(sum(a.x * b.x), 6) + 0.0 AS v FROM e a JOIN e b USING (i) GROUP BY 1, 2")
def mvect_times_mvec(spark, sf_dir):
    """Gram matrix of all embeddings, 64 x 64."""
    v = embeddings(spark, sf_dir)
    return vec.gram_frame(v.df, "x", 64, "x", 64).select("r", "c", nice(F.col("v")).alias("v"))


@query(f"WITH {G} SELECT a.j AS r, b.j AS c, round(sum(a.x * b.x), 6) + 0.0 AS v FROM g a JOIN g b USING (i) GROUP BY 1, 2")
def robust_gram(spark, sf_dir):
    x = grid(spark, N, 3)
    return small(spark, vec.robust_gram(x, x))


@query(f"WITH {E} SELECT CAST(0 AS INT) AS j, round(sqrt(sum(x * x)), 6) AS value FROM e")
def mvec_norm_f(spark, sf_dir):
    return numbers(spark, [vec.norm_f(embeddings(spark, sf_dir))])


_C64 = "SELECT e.i, CAST(c AS INT) AS c, sum(x * ((j + 2 * c) % 5 - 2)) AS s FROM e, range({m}) b(c) GROUP BY 1, 2"


@query(f"WITH {E} SELECT i, c AS j, round(2 * s, 6) + 0.0 AS x FROM ({_C64.format(m=8)})")
def mvec_times_sdmat(spark, sf_dir):
    return long(vec.times_sdmat(2.0, embeddings(spark, sf_dir), coefficients(64, 8)))


@query(f"WITH {G}, {C3} SELECT g.i, c.c AS j, round(2 * sum(g.x * c.v) - 3 * any_value(w.x), 6) + 0.0 AS x FROM g JOIN c ON g.j = c.r JOIN g w ON w.i = g.i AND w.j = c.c GROUP BY 1, 2")
def mvec_times_sdmat_add(spark, sf_dir):
    x = grid(spark, N, 3)
    return long(vec.times_sdmat(2.0, x, coefficients(3, 3), -3.0, x))


@query(f"WITH {E}, s AS ({_C64.format(m=4)}) SELECT e.i, e.j, round(coalesce(s.s, e.x), 6) + 0.0 AS x FROM e LEFT JOIN s ON s.i = e.i AND s.c = e.j")
def mvec_times_sdmat_inplace(spark, sf_dir):
    return long(vec.times_sdmat_inplace(embeddings(spark, sf_dir), coefficients(64, 4)))


@query(f"WITH {E}, s AS ({_C64.format(m=4)}) SELECT i, c AS j, round(4 * s, 6) + 0.0 AS x FROM s")
def mvec_times_sdmat_pair(spark, sf_dir):
    v = embeddings(spark, sf_dir)
    return long(vec.times_sdmat_add(v, coefficients(64, 4), vec.scale(v, 3.0), coefficients(64, 4)))


@query(f"WITH {G}, {C3}, w AS (SELECT g.i, c.c AS j, sum(g.x * c.v) AS x FROM g JOIN c ON g.j = c.r GROUP BY 1, 2) SELECT a.j AS r, w.j AS c, round(2 * sum(a.x * w.x), 6) + 0.0 AS v FROM g a JOIN w USING (i) GROUP BY 1, 2")
def fused_mvsdi_mvtmv(spark, sf_dir):
    x = grid(spark, N, 3)
    return small(spark, sp.mvsdi_mvtmv(2.0, x, x, coefficients(3, 3))[1])


@query(f"WITH {G}, {C3}, w AS (SELECT g.i, c.c AS j, 2 * sum(g.x * c.v) - any_value(o.x) AS x FROM g JOIN c ON g.j = c.r JOIN g o ON o.i = g.i AND o.j = c.c GROUP BY 1, 2) SELECT a.j AS r, b.j AS c, round(sum(a.x * b.x), 6) + 0.0 AS v FROM w a JOIN w b USING (i) GROUP BY 1, 2")
def fused_mvsd_mvtmv(spark, sf_dir):
    x = grid(spark, N, 3)
    return small(spark, sp.mvsd_mvtmv(2.0, x, coefficients(3, 3), -1.0, x)[1])


@query(f"WITH {G} SELECT i, j, round(x, 6) + 0.0 AS x FROM g")
def mvec_get_set_data(spark, sf_dir):
    return long(vec.set_data(spark, vec.get_data(grid(spark, N, 3), row_major=False)))


@query(f"WITH {G}, y AS (SELECT i, j, x, CAST((i + 2 * j) % 5 - 1 AS DOUBLE) AS y FROM g) SELECT j, round(sum(2 * x * y), 6) + 0.0 AS re, round(sum(x * x - y * y), 6) + 0.0 AS im FROM y GROUP BY j")
def complex_dot(spark, sf_dir):
    """Of x + iy and y + ix, the first conjugated."""
    x = grid(spark, N, 3)
    y = vec.put_func(x, lambda i, j, x: ((i + 2 * j) % 5 - 1).cast("double"))
    found = vec.complex_dot(vec.combine(x, y), vec.combine(y, x))
    return spark.createDataFrame([(j, round(float(v.real), 6) + 0.0, round(float(v.imag), 6) + 0.0) for j, v in enumerate(found)], "j int, re double, im double")


@query("SELECT CAST(r AS INT) AS r, CAST(c AS INT) AS c, CAST(3 * ((r + 2 * c) % 5 - 2) - ((c + 2 * r) % 5 - 2) AS DOUBLE) AS v FROM range(4) a(r), range(4) b(c)")
def sdmat_add(spark, sf_dir):
    m = coefficients(4, 4)
    return small(spark, dense.add(-1.0, m, 3.0, m, transpose=True))


@query("WITH m AS (SELECT r, c, (r + 2 * c) % 5 - 2 AS v FROM range(4) a(r), range(4) b(c)) SELECT CAST(a.c AS INT) AS r, CAST(b.c AS INT) AS c, CAST(sum(a.v * b.v) AS DOUBLE) AS v FROM m a JOIN m b ON a.r = b.r GROUP BY 1, 2", "sdmatt_times_sdmat")
def _sdmatt_times_sdmat(spark, sf_dir):
    return small(spark, dense.multiply(1.0, coefficients(4, 4), coefficients(4, 4), first=True))


@query("WITH m AS (SELECT r, c, (r + 2 * c) % 5 - 2 AS v FROM range(4) a(r), range(4) b(c)) SELECT CAST(a.r AS INT) AS r, CAST(b.c AS INT) AS c, CAST(sum(a.v * b.v) AS DOUBLE) AS v FROM m a JOIN m b ON a.c = b.r GROUP BY 1, 2", "sdmat_times_sdmat")
def _sdmat_times_sdmat(spark, sf_dir):
    return small(spark, dense.multiply(1.0, coefficients(4, 4), coefficients(4, 4)))


@query("WITH m AS (SELECT r, c, (r + 2 * c) % 5 - 2 AS v FROM range(4) a(r), range(4) b(c)) SELECT CAST(a.r AS INT) AS r, CAST(b.r AS INT) AS c, CAST(sum(a.v * b.v) AS DOUBLE) AS v FROM m a JOIN m b ON a.c = b.c GROUP BY 1, 2", "sdmat_times_sdmatt")
def _sdmat_times_sdmatt(spark, sf_dir):
    return small(spark, dense.multiply(1.0, coefficients(4, 4), coefficients(4, 4), second=True))


# ---------------------------------------------------------------- operators as objects


@query(f"WITH {T}, {G}, {TG}, tt AS (SELECT t.i, tg.j, sum(t.v * tg.x) AS x FROM t JOIN tg ON t.j = tg.i GROUP BY 1, 2) SELECT i, j, round(2 * x, 6) + 0.0 AS x FROM tt")
def linop_product(spark, sf_dir):
    a = linop.wrap_matrix(toeplitz(spark))
    return long(linop.ProductOp(a, a).apply(grid(spark, N, 3), 2.0))


@query(f"WITH {G} SELECT i, j, round(5 * x, 6) + 0.0 AS x FROM g")
def linop_identity(spark, sf_dir):
    x = grid(spark, N, 3)
    return long(linop.identity(N).apply(x, 2.0, 3.0, x))


U = f"u AS (SELECT r.i, r.i + d.d AS j, CASE d.d WHEN 0 THEN 2.0 WHEN 1 THEN -1.0 ELSE -0.5 END AS v FROM range({N}) r(i), (VALUES (-1), (0), (1)) d(d) WHERE r.i + d.d BETWEEN 0 AND {N - 1})"
UG = "ug AS (SELECT u.i, g.j, sum(u.v * g.x) AS x FROM u JOIN g ON u.j = g.i GROUP BY 1, 2)"
UTG = "utg AS (SELECT u.j AS i, g.j, sum(u.v * g.x) AS x FROM u JOIN g ON u.i = g.i GROUP BY 1, 2)"


def uneven(spark: SparkSession, n: int = N) -> Matrix:
    """A nonsymmetric tridiagonal matrix."""
    return gen.tridiagonal(spark, n, 2.0, -1.0, -0.5)


@query(f"WITH {T}, {U}, {G}, {TG}, {UG} SELECT g.i, g.j, round(tg.x + 2 * ug.x, 6) + 0.0 AS x FROM g JOIN tg USING (i, j) JOIN ug USING (i, j)")
def linop_pair_shifted(spark, sf_dir):
    op = linop.wrap_matrix_pair(toeplitz(spark), uneven(spark))
    op.shifts = [2.0]
    return long(op.apply_respective(grid(spark, N, 3)))


@query(f"WITH {U}, {G}, {UTG} SELECT i, j, round(x, 6) + 0.0 AS x FROM utg")
def linop_transposed(spark, sf_dir):
    op = linop.wrap_matrix(uneven(spark))
    op.use_transpose = True
    return long(op.apply_respective(grid(spark, N, 3)))


@query(f"WITH {U}, {G}, {UTG} SELECT g.i, g.j, round(3 * utg.x - g.x, 6) + 0.0 AS x FROM g JOIN utg USING (i, j)")
def linop_apply_t(spark, sf_dir):
    x = grid(spark, N, 3)
    return long(linop.wrap_matrix(uneven(spark)).apply_t(x, 3.0, -1.0, x))


@query(f"WITH {U}, {G}, {UG} SELECT a.j AS r, b.j AS c, round(sum(a.x * b.x), 6) + 0.0 AS v FROM g a JOIN ug b USING (i) GROUP BY 1, 2")
def linop_fused_mvtmv(spark, sf_dir):
    f = linop.wrap_matrix(uneven(spark)).fused_apply_mvtmv(grid(spark, N, 3))
    f.done()
    return small(spark, SdMat(f.vw))


@query(f"WITH {T}, {U}, {G}, {TG}, o AS (SELECT u.i, tg.j, sum(u.v * tg.x) AS x FROM u JOIN tg ON u.j = tg.i GROUP BY 1, 2) SELECT i, j, round(x, 6) + 0.0 AS x FROM o")
def linop_product_extend(spark, sf_dir):
    return long(linop.ProductOp(linop.wrap_matrix(toeplitz(spark))).extend(linop.wrap_matrix(uneven(spark))).apply(grid(spark, N, 3)))


@query(f"WITH {G}, p AS (SELECT a.j AS r, b.j AS c, sum(a.x * b.x) AS v FROM g a JOIN g b USING (i) GROUP BY 1, 2) SELECT g.i, p.c AS j, round(any_value(o.x) - sum(g.x * p.v), 6) + 0.0 AS x FROM g JOIN p ON g.j = p.r JOIN g o ON o.i = g.i AND o.j = p.c GROUP BY 1, 2")
def projection(spark, sf_dir):
    x = grid(spark, N, 3)
    return long(linop.projection(x, x).apply(x))


# ---------------------------------------------------------------- generators


def entries(m: Matrix, digits: int = 6) -> DataFrame:
    return m.df.select("i", "j", nice(F.col("v"), digits).alias("v"))


@query("SELECT r.i, r.i + d.d AS j, round(CASE WHEN d.d = 0 THEN 2.0 ELSE -1 / (1 + 1e-8) END, 6) AS v FROM range(1024) r(i), (VALUES (-1), (0), (1)) d(d) WHERE r.i + d.d BETWEEN 0 AND 1023")
def tri_toeplitz(spark, sf_dir):
    return entries(gen.create_matrix(spark, "TriToeplitz10"))


_M = 60
_H = f"(1.0 / {_M + 1})"
_T1, _T2 = f"(0.008 / (({_H} * 0.51302) ** 2))", f"(0.004 / (({_H} * 0.51302) ** 2))"


@query(
    f"SELECT i, j, round(v, 6) + 0.0 AS v FROM (SELECT i, i + d AS j, CASE WHEN d = 0 THEN CASE WHEN i < {_M} THEN -2 * {_T1} + 4.45 ELSE -2 * {_T2} - 4 END WHEN i < {_M} THEN {_T1} ELSE {_T2} END AS v FROM range({2 * _M}) r(i), (VALUES (-1), (0), (1)) x(d) WHERE i + d BETWEEN 0 AND {2 * _M - 1} "
    f"UNION ALL SELECT i, CASE WHEN i < {_M} THEN i + {_M} ELSE i - {_M} END, CASE WHEN i < {_M} THEN 4.0 ELSE -5.45 END FROM range({2 * _M}) r(i))"
)
def brussolator(spark, sf_dir):
    return entries(gen.create_matrix(spark, f"brussolator{_M}"))


def _morton(x: str, y: str) -> str:
    return " + ".join(f"(({x} >> {b}) & 1) * {4**b} + (({y} >> {b}) & 1) * {2 * 4**b}" for b in range(4))


_PDE = f"""WITH p AS (SELECT a, b, {_morton('a', 'b')} AS i, (a + 1) / 17.0 AS x, (b + 1) / 17.0 AS y, 1 / 17.0 AS h FROM range(16) r(a), range(16) s(b)),
e AS (SELECT i, a AS ja, b AS jb, exp(-(x + h / 2) * y) + exp(-(x - h / 2) * y) + exp(x * (y + h / 2)) + exp(x * (y - h / 2)) + h * h / (1 + x + y) AS v FROM p
UNION ALL SELECT i, a, b - 1, -exp(x * (y - h / 2)) FROM p WHERE b > 0
UNION ALL SELECT i, a, b + 1, -exp(x * (y + h / 2)) FROM p WHERE b < 15
UNION ALL SELECT i, a - 1, b, -(exp(-(x - h / 2) * y) + 0.5 * h * (20 * (x + y) + 20 * (x - h + y))) FROM p WHERE a > 0
UNION ALL SELECT i, a + 1, b, -exp(-(x + h / 2) * y) + 0.5 * h * (20 * (x + y) + 20 * (x + h + y)) FROM p WHERE a < 15)
SELECT CAST(i AS BIGINT) AS i, CAST({_morton('ja', 'jb')} AS BIGINT) AS j, round(v, 6) + 0.0 AS v FROM e"""


@query(_PDE)
def matpde(spark, sf_dir):
    return entries(gen.create_matrix(spark, "matpde16"))


@query(
    "WITH b AS (SELECT i AS b, row_number() OVER (ORDER BY i) - 1 AS r FROM range(256) t(i) WHERE bit_count(i) = 4), q AS (SELECT p, CAST((1 << p) | (1 << ((p + 1) % 8)) AS BIGINT) AS m FROM range(8) t(p)), "
    "d AS (SELECT r, sum(CASE WHEN bit_count(b & m) = 1 THEN -1.0 ELSE 1.0 END) AS v FROM b, q GROUP BY r) "
    "SELECT r AS i, r AS j, v FROM d UNION ALL SELECT x.r, y.r, 2.0 FROM b x, q, b y WHERE bit_count(x.b & m) = 1 AND y.b = xor(x.b, m)"
)
def spin_sz(spark, sf_dir):
    """Heisenberg chain of 8 spins, 4 up: 70 rows."""
    return entries(gen.create_matrix(spark, "spinSZ8"))


@query("SELECT i, j, 1.0 * v AS v FROM (SELECT x + 4 * y + 16 * z AS i, x + dx + 4 * (y + dy) + 16 * (z + dz) AS j, CASE WHEN dx = 0 AND dy = 0 AND dz = 0 THEN 0.0 ELSE -1.0 END AS v FROM range(4) a(x), range(4) b(y), range(4) c(z), (VALUES (0, 0, 0), (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)) d(dx, dy, dz) WHERE x + dx BETWEEN 0 AND 3 AND y + dy BETWEEN 0 AND 3 AND z + dz BETWEEN 0 AND 3)")
def anderson(spark, sf_dir):
    return entries(gen.create_matrix(spark, "SCAMAC-Anderson,Lx=4,Ly=4,Lz=4"))


@query("SELECT CAST(0 AS INT) AS j, 0.0 AS value")
def hubbard_symmetry(spark, sf_dir):
    """Largest difference between a Hubbard matrix and its transpose."""
    m = gen.create_matrix(spark, "SCAMAC-Hubbard,n_sites=5,n_fermions=2,U=3,boundary_conditions=periodic")
    d = m.df.alias("a").join(m.transposed().df.alias("b"), ["i", "j"], "full").select(F.abs(F.coalesce("a.v", F.lit(0.0)) - F.coalesce("b.v", F.lit(0.0))).alias("d"))
    return d.agg(F.round(F.max("d"), 9).alias("value")).select(F.lit(0).alias("j"), "value")


def _morton3(x: str, y: str, z: str) -> str:
    return " + ".join(f"((({c}) >> {b}) & 1) * {8**b * 2**k}" for b in range(2) for k, c in enumerate((x, y, z)))


def bench3d_query(problem: str, scales: tuple[float, float, float], reaction: float) -> None:
    """Side 4; a row for each point and one for each neighbour inside."""
    faces = ["exp(-({x}) * ({y}) * ({z}))", "exp(({x}) * ({y}) * ({z}))", "exp((1 - ({x})) * (1 - ({y})) * (1 - ({z})))"]
    face = lambda k, s: faces[k].format(**{c: f"{c} + {s} * h / 2" if "xyz"[k] == c else c for c in "xyz"})
    parts = [f"SELECT a, b, c, a AS ja, b AS jb, c AS jc, {' + '.join(face(k, s) for k in range(3) for s in (-1, 1))} + h * h * {reaction} / (1 + x + y + z) AS v FROM p"]
    for k, wave in enumerate(("y", "z", "x")):
        for s in (-1, 1):
            to = [f"{c} + {s}" if m == k else c for m, c in enumerate("abc")]
            parts.append(f"SELECT a, b, c, {', '.join(to)}, -{face(k, s)} + {scales[k]} * sin(pi() * {wave}) * {s} * h FROM p WHERE {to[k]} BETWEEN 0 AND 3")
    sql = f"WITH p AS (SELECT a, b, c, (a + 1) / 5.0 AS x, (b + 1) / 5.0 AS y, (c + 1) / 5.0 AS z, 1 / 5.0 AS h FROM range(4) r(a), range(4) s(b), range(4) t(c)), e AS ({' UNION ALL '.join(parts)}) "
    sql += f"SELECT CAST({_morton3('a', 'b', 'c')} AS BIGINT) AS i, CAST({_morton3('ja', 'jb', 'jc')} AS BIGINT) AS j, round(v, 6) + 0.0 AS v FROM e"
    query(sql, f"bench3d_{problem.lower()}")(lambda spark, sf_dir: entries(gen.create_matrix(spark, f"BENCH3D-4-{problem}")))


for _problem, _scales, _reaction in (("B0", (0, 0, 0), 0), ("B1", (20, 0, 0), 0), ("B3", (20, 0, 0), 100), ("B4", (1000, 1000, 0), 0), ("B5", (100, 5, 0), 5)):
    bench3d_query(_problem, _scales, _reaction)


@query(f"WITH s AS (SELECT w, l, CASE WHEN (w + l) % 2 = 1 THEN 1 ELSE -1 END AS up FROM range(6) a(w), range(5) b(l)), k AS (SELECT -0.1 / 2.78 AS t2, -0.095 / 2.78 AS t3), "
       "h AS (SELECT dw, e, f, CASE t WHEN 1 THEN -1.0 WHEN 2 THEN t2 WHEN 3 THEN t3 ELSE 3 * t3 END AS v FROM k, (VALUES (0, 0, 0, 0), (-1, 0, 0, 1), (1, 0, 0, 1), (0, 0, 1, 1), (-2, 0, 0, 2), (2, 0, 0, 2), (-1, -1, 0, 2), (-1, 1, 0, 2), (1, -1, 0, 2), (1, 1, 0, 2), (-2, 0, 1, 3), (2, 0, 1, 3), (0, 0, -1, 3)) x(dw, e, f, t)) "
       "SELECT w + 6 * l AS i, w + dw + 6 * (l + e + f * up) AS j, round(v, 6) + 0.0 AS v FROM s, h WHERE w + dw BETWEEN 0 AND 5 AND l + e + f * up BETWEEN 0 AND 4")  # fmt: skip
def graphene(spark, sf_dir):
    """An open sheet, 6 wide and 5 long, without disorder."""
    return entries(gen.graphene(spark, 6, 5, gamma=0.0))


# ---------------------------------------------------------------- solvers: the solution is known

_SMALL = 64
_SOLUTION = f"SELECT i, CAST(j AS INT) AS j, CAST((i * (j + 1)) % 7 - 3 AS DOUBLE) AS x FROM range({_SMALL}) a(i), range(2) b(j)"


def _system(spark: SparkSession, diag: float = 4.0, sup: float = -1.0, sub: float = -1.0) -> tuple[Matrix, linop.LinearOp, BlockVector]:
    a = gen.tridiagonal(spark, _SMALL, diag, sup, sub).persisted()
    return a, linop.wrap_matrix(a), sp.spmv(a, grid(spark, _SMALL, 2)).persisted()


def solver_query(name: str, run: Callable, sub: float = -1.0) -> None:
    def f(spark, sf_dir):
        a, op, b = _system(spark, sub=sub)
        return long(run(a, op, b), 4)

    query(_SOLUTION, name)(f)


solver_query("blocked_pcg", lambda a, op, b: solve.pcg(op, b, tol=1e-9).x)
solver_query("pcg_jacobi", lambda a, op, b: solve.pcg(op, b, precond.create(a, "jacobi"), tol=1e-9).x)
solver_query("pcg_block_jacobi", lambda a, op, b: solve.pcg(op, b, precond.create(a, "block_jacobi", "size=16"), tol=1e-9).x)
solver_query("bicgstab", lambda a, op, b: solve.bicgstab(op, b, tol=1e-9).x, -0.5)
solver_query("qmr", lambda a, op, b: solve.qmr(op, b, tol=1e-9).x, -0.5)
solver_query("idrs", lambda a, op, b: solve.idrs(op, b, s=2, tol=1e-9).x, -0.5)
solver_query("gmres", lambda a, op, b: solve.gmres(op, b, tol=1e-9, basis=20).x, -0.5)
solver_query("minres", lambda a, op, b: solve.minres(op, b, tol=1e-9, basis=30).x)
solver_query("carp_cg", lambda a, op, b: rowproj.carp_cg(a, b, tol=1e-9, blocks=3, check_every=5).x)
solver_query("iter_op", lambda a, op, b: solve.solver_op(op, "PCG", tol=1e-9).apply(b))


_ROW1, _ROW2 = ("u + 4 * (b1 - 4 * u - v) / 17 AS u, v + (b1 - 4 * u - v) / 17 AS v", "u + (b2 - u - 4 * v) / 17 AS u, v + 4 * (b2 - u - 4 * v) / 17 AS v")


@query(
    "WITH s0 AS (SELECT p, j, CAST((2 * p * (j + 1)) % 7 - 3 AS DOUBLE) AS b1, CAST(((2 * p + 1) * (j + 1)) % 7 - 3 AS DOUBLE) AS b2, 1.0 AS u, 1.0 AS v FROM range(100) a(p), range(2) b(j)), "
    f"s1 AS (SELECT p, j, b1, b2, {_ROW1} FROM s0), s2 AS (SELECT p, j, b1, b2, {_ROW2} FROM s1), s3 AS (SELECT p, j, b1, b2, {_ROW2} FROM s2), s4 AS (SELECT p, j, b1, b2, {_ROW1} FROM s3) "
    "SELECT 2 * p AS i, CAST(j AS INT) AS j, round(u, 6) + 0.0 AS x FROM s4 UNION ALL SELECT 2 * p + 1, j, round(v, 6) + 0.0 FROM s4"
)
def carp_sweep(spark, sf_dir):
    """One sweep down and up over rows (4, 1), (1, 4) in pairs, from all ones."""
    rows = spark.range(N).select(F.col("id").alias("i"), F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    a = Matrix.from_entries(rows.select("i", (F.col("i") - F.col("i") % 2 + F.col("k")).alias("j"), F.when(F.col("i") % 2 == F.col("k"), 4.0).otherwise(1.0).alias("v")), N, N)
    return long(rowproj.sweep_vectors(rowproj.setup(a, 4), [0.0, 0.0], grid(spark, N, 2), vec.create(spark, N, 2, 1.0))[0])


# ---------------------------------------------------------------- orthogonalisation and eigenvalues: known in closed form


@query("SELECT CAST(r AS INT) AS r, CAST(c AS INT) AS c, CASE WHEN r = c THEN 1.0 ELSE 0.0 END AS v FROM range(4) a(r), range(4) b(c)", "svqb")
def _svqb(spark, sf_dir):
    q = orth.svqb(vec.view_block(embeddings(spark, sf_dir), 0, 3))[0]
    return small(spark, vec.gram(q, q))


@query("SELECT CAST(r AS INT) AS r, CAST(c AS INT) AS c, CASE WHEN r = c THEN 1.0 ELSE 0.0 END AS v FROM range(4) a(r), range(4) b(c)", "chol_qr")
def _chol_qr(spark, sf_dir):
    q = orth.chol_qr(vec.view_block(embeddings(spark, sf_dir), 0, 3))[0]
    return small(spark, vec.gram(q, q))


@query("SELECT CAST(r AS INT) AS r, CAST(c AS INT) AS c, CASE WHEN r = c THEN 1.0 ELSE 0.0 END AS v FROM range(5) a(r), range(5) b(c)", "orthog")
def _orthog(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    v = orth.orthog(None, vec.view_block(e, 0, 2))[0]
    q = orth.orthog(v, vec.view_block(e, 3, 4))[0]
    both = vec.gather([v, q])
    return small(spark, vec.gram(both, both))


@query(f"WITH {E} SELECT i, CAST(j - 3 AS INT) AS j, round(x, 6) + 0.0 AS x FROM e WHERE j BETWEEN 3 AND 8")
def orthog_factors(spark, sf_dir):
    """Q R1 + V R2 gives back what was orthogonalised: columns 3 to 8 against the first three."""
    e = embeddings(spark, sf_dir)
    v = orth.orthog(None, vec.view_block(e, 0, 2))[0]
    q, r1, r2, _ = orth.orthog(v, vec.view_block(e, 3, 8))
    return long(vec.times_sdmat_add(q, r1, v, r2))


@query(f"WITH {E} SELECT i, j, round(x, 6) + 0.0 AS x FROM e WHERE j < 8")
def mvec_qr(spark, sf_dir):
    """Q R of the first eight columns."""
    q, r, _ = orth.qr(vec.view_block(embeddings(spark, sf_dir), 0, 7))
    return long(vec.times_sdmat(1.0, q, r))


@query(f"WITH {G}, {C3}, h AS (SELECT a.c AS r, b.c AS c, sum(a.v * m.v * b.v) AS v FROM c a JOIN c m ON a.r = m.r JOIN c b ON m.c = b.r GROUP BY 1, 2) SELECT r, c, round(v, 6) + 0.0 AS v FROM h")
def transform_search_space(spark, sf_dir):
    """M' H M."""
    return small(spark, orth.transform_search_space([grid(spark, N, 3)], coefficients(3, 3), coefficients(3, 3))[1])


_TINY = 24
_EV = f"2 - 2 / (1 + 1e-8) * cos(k * pi() / {_TINY + 1})"


@query(f"SELECT CAST(j AS INT) AS j, round({_EV}, 5) AS value FROM (VALUES (0, 1), (1, {_TINY})) t(j, k)")
def simple_lanczos(spark, sf_dir):
    low, high, _ = eig.lanczos(linop.wrap_matrix(toeplitz(spark, _TINY).persisted()), _TINY, 1e-9)
    return numbers(spark, [low, high], 5)


def subspace_jada(spark, sf_dir):  # minutes of small jobs: not among the registered queries yet
    o = eig.JadaOptions(numEigs=3, which=EigSort.SR, convTol=1e-7, blockSize=2, minBas=8, maxBas=16, innerSolvType=LinSolv.MINRES, innerSolvMaxIters=10)
    return numbers(spark, eig.subspace_jada(linop.wrap_matrix(toeplitz(spark, _TINY).persisted()), o).values, 5)


def lobpcg(spark, sf_dir):  # likewise
    return numbers(spark, eig.lobpcg(linop.wrap_matrix(toeplitz(spark, _TINY).persisted()), 4, EigSort.SR, tol=1e-5, max_iter=40).values[:2], 5)


@query(f"SELECT CAST(j AS INT) AS j, round({_EV}, 4) AS value FROM (VALUES (0, {_TINY}), (1, {_TINY - 1})) t(j, k)")
def krylov_schur(spark, sf_dir):
    r = eig.krylov_schur(linop.wrap_matrix(toeplitz(spark, _TINY).persisted()), 2, EigSort.LR, basis=16, tol=1e-6)
    return numbers(spark, np.real(r.values), 4)


@query("SELECT CAST(0 AS INT) AS j, 0.0 AS value", "simple_arnoldi")
def _arnoldi(spark, sf_dir):
    """Frobenius norm of A V - V H."""
    a = toeplitz(spark, _TINY).persisted()
    v, h = eig.arnoldi(linop.wrap_matrix(a), 6, vec.create(spark, _TINY, 1, 1.0))
    left = sp.spmv(a, vec.view_block(v, 0, 5))
    return numbers(spark, [vec.norm_f(vec.axpby(1.0, left, -1.0, vec.times_sdmat(1.0, v, SdMat(h))))])


@query(
    f"WITH {T}, {G}, s AS (SELECT i, j, 0.25 * v AS v FROM t UNION ALL SELECT i, i, -0.5 FROM range({N}) r(i)), "
    "t1 AS (SELECT s.i, g.j, sum(s.v * g.x) AS x FROM s JOIN g ON s.j = g.i GROUP BY 1, 2), "
    "t2 AS (SELECT s.i, t1.j, 2 * sum(s.v * t1.x) - any_value(g.x) AS x FROM s JOIN t1 ON s.j = t1.i JOIN g ON g.i = s.i AND g.j = t1.j GROUP BY 1, 2) "
    "SELECT 0 AS m, j, round(sum(x * x), 5) + 0.0 AS value FROM g GROUP BY j UNION ALL SELECT 1, g.j, round(sum(g.x * t1.x), 5) + 0.0 FROM g JOIN t1 USING (i, j) GROUP BY g.j "
    "UNION ALL SELECT 2, g.j, round(sum(g.x * t2.x), 5) + 0.0 FROM g JOIN t2 USING (i, j) GROUP BY g.j"
)
def kpm_moments(spark, sf_dir):
    mu = eig.kpm_moments(toeplitz(spark), grid(spark, N, 3), 0.25, 2.0, 3)
    return spark.createDataFrame([(m, j, round(float(mu[m, j]), 5) + 0.0) for m in range(3) for j in range(3)], "m int, j int, value double")


@query()
def dos(spark, sf_dir):
    return numbers(spark, eig.dos(toeplitz(spark), 0.25, 2.0, 6, 4))


@query(f"SELECT CAST(0 AS INT) AS j, {math.comb(10, 5)}.0 AS value")
def free_fermions_shape(spark, sf_dir):
    m = gen.create_matrix(spark, "SCAMAC-FreeFermionChain")
    return numbers(spark, [m.nrows])


# ---------------------------------------------------------------- both outputs of fused forms


@query(f"WITH {G}, {C3} SELECT g.i, c.c AS j, round(sum(g.x * c.v), 6) + 0.0 AS x FROM g JOIN c ON g.j = c.r GROUP BY 1, 2")
def fused_mvsdi_w(spark, sf_dir):
    x = grid(spark, N, 3)
    return long(sp.mvsdi_mvtmv(2.0, x, x, coefficients(3, 3))[0])


@query(f"WITH {G}, {C3} SELECT g.i, c.c AS j, round(2 * sum(g.x * c.v) - any_value(o.x), 6) + 0.0 AS x FROM g JOIN c ON g.j = c.r JOIN g o ON o.i = g.i AND o.j = c.c GROUP BY 1, 2")
def fused_mvsd_w(spark, sf_dir):
    x = grid(spark, N, 3)
    return long(sp.mvsd_mvtmv(2.0, x, coefficients(3, 3), -1.0, x)[0])


# ---------------------------------------------------------------- small matrices: min(r, c) + 1 is positive definite, its inverse and spectrum are known

_FOUR = "FROM range(4) a(r), range(4) b(c)"


def lowest() -> SdMat:
    r, c = np.indices((4, 4))
    return SdMat(np.minimum(r, c) + 1.0)


def small_query(name: str, value: str, f: Callable[[], np.ndarray]) -> None:
    query(f"SELECT CAST(r AS INT) AS r, CAST(c AS INT) AS c, round(CAST({value} AS DOUBLE), 6) + 0.0 AS v {_FOUR}", name)(lambda spark, sf_dir: small(spark, SdMat(np.real(f()))))


def _cholesky() -> np.ndarray:
    r, perm, _ = dense.cholesky(lowest())
    out = np.zeros((4, 4))
    out[np.ix_(perm, perm)] = r.a.T @ r.a
    return out + 100 * np.tril(r.a, -1)


def _solved() -> np.ndarray:
    r, perm, rank = dense.cholesky(lowest())
    return dense.backward(r, perm, rank, dense.forward(r, perm, rank, dense.identity(4, 4))).a


def _qr() -> np.ndarray:
    q, r = dense.qr(lowest())
    return q.a @ r.a + 100 * q.a.T @ q.a + 1000 * np.tril(r.a, -1)


def _qb() -> np.ndarray:
    b, back, _, _ = dense.qb(lowest())
    return b.a.T @ lowest().a @ b.a + 100 * b.a @ back.a


def _slanted() -> np.ndarray:
    return 2.0 * np.eye(4) - np.eye(4, k=1) - 0.5 * np.eye(4, k=-1)


def _schur() -> np.ndarray:
    t, q, _ = dense.sorted_schur(_slanted(), EigSort.LR)
    return q @ t @ q.conj().T + 100 * np.tril(t, -1)


def _generalized_schur() -> np.ndarray:
    s, t, v, w, _ = dense.generalized_schur(_slanted(), lowest().a, EigSort.LM)
    return w @ s @ v.conj().T + 100 * w @ t @ v.conj().T


def _schur_vectors() -> np.ndarray:
    t, q, _ = dense.sorted_schur(_slanted(), EigSort.LR)
    x = dense.schur_eigenvectors(t)
    return q @ x @ np.diag(np.diag(t)) @ np.linalg.inv(q @ x)


_LOW, _SLANT, _UNIT = "least(r, c) + 1.0", "CASE c - r WHEN 0 THEN 2.0 WHEN 1 THEN -1.0 WHEN -1 THEN -0.5 ELSE 0.0 END", "CASE WHEN r = c THEN 1.0 ELSE 0.0 END"
_INVERSE = "CASE WHEN r = c AND r = 3 THEN 1.0 WHEN r = c THEN 2.0 WHEN abs(r - c) = 1 THEN -1.0 ELSE 0.0 END"
small_query("sdmat_add_plain", f"2 * ((r + 2 * c) % 5 - 2) - 3 * {_UNIT}", lambda: dense.add(2.0, coefficients(4, 4), -3.0, dense.identity(4, 4)).a)
small_query("sdmat_set_block", "CASE WHEN r BETWEEN 1 AND 2 AND c BETWEEN 2 AND 3 THEN 7.0 ELSE (r + 2 * c) % 5 - 2 END", lambda: dense.set_block(coefficients(4, 4), dense.put_value(2, 2, 7.0), 1, 2, 2, 3).a)
small_query("sdmat_data", "(r + 2 * c) % 5 - 2.0", lambda: dense.set_data(dense.get_data(coefficients(4, 4), False), 4, 4, False).a)
small_query("sdmat_cholesky", _LOW, _cholesky)
small_query("sdmat_substitutions", _INVERSE, _solved)
small_query("sdmat_inverse", _INVERSE, lambda: dense.inverse_hpd(lowest())[0].a)
small_query("sdmat_pseudo_inverse", _INVERSE, lambda: dense.pseudo_inverse(lowest())[0].a)
small_query("sdmat_qr", f"{_LOW} + 100 * {_UNIT}", _qr)
small_query("sdmat_qb", f"101 * {_UNIT}", _qb)
small_query("schur_form", _SLANT, _schur)
small_query("generalized_schur", f"{_SLANT} + 100 * ({_LOW})", _generalized_schur)
small_query("schur_eigenvectors", _SLANT, _schur_vectors)


@query("SELECT CAST(0 AS INT) AS j, round(sqrt(sum(((r + 2 * c) % 5 - 2) ** 2)), 6) AS value FROM range(4) a(r), range(4) b(c)")
def sdmat_norm_f(spark, sf_dir):
    return numbers(spark, [dense.norm_f(coefficients(4, 4))])


@query("SELECT CAST(k - 1 AS INT) AS j, round(1 / (2 - 2 * cos((2 * k - 1) * pi() / 9)), 6) AS value FROM range(1, 5) t(k)")
def sdmat_svd(spark, sf_dir):
    u, s, vt = dense.svd(lowest())
    return numbers(spark, np.diag(u.a.T @ lowest().a @ vt.a.T) if np.allclose(u.a @ np.diag(s) @ vt.a, lowest().a) else s * 0)


@query("SELECT CAST(k - 1 AS INT) AS j, round(2 + 2 * sqrt(0.5) * cos(k * pi() / 5), 6) AS value FROM range(1, 5) t(k)")
def schur_values(spark, sf_dir):
    """Eigenvalues of a nonsymmetric matrix, the largest real part first."""
    return numbers(spark, np.real(dense.sorted_schur(_slanted(), EigSort.LR)[2]))


@query("SELECT CAST(j AS INT) AS j, CAST(value AS DOUBLE) AS value FROM (VALUES (0, 1), (1, 0), (2, 2)) t(j, value)")
def schur_reordered(spark, sf_dir):
    """Equal eigenvalues: the smaller residual comes first."""
    return numbers(spark, dense.reorder_by_residual(np.diag([2.0, 2.0, 1.0]), np.eye(3), EigSort.LM, np.array([0.3, 0.1, 0.2]), 1e-9)[2])


# ---------------------------------------------------------------- readers and writers


def _place(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


_UNEVEN = f"WITH {U} SELECT i, j, CAST(v AS DOUBLE) AS v FROM u"


@query(_UNEVEN)
def read_mm(spark, sf_dir):
    path = _place(spark, "mm")
    io.write_mm(uneven(spark), path)
    return entries(io.read_mm(spark, path))


@query(_UNEVEN)
def read_bin(spark, sf_dir):
    path = _place(spark, "crs")
    io.write_bin(uneven(spark), path)
    return entries(io.read_bin(spark, path))


@query(_UNEVEN)
def read_parquet(spark, sf_dir):
    path = _place(spark, "matrix")
    io.write_parquet(uneven(spark), path)
    return entries(io.read_parquet(spark, path))


@query(f"WITH {E} SELECT i, j, round(x, 6) + 0.0 AS x FROM e")
def mvec_write_read(spark, sf_dir):
    path, v = _place(spark, "vector"), embeddings(spark, sf_dir)
    io.write_vector(v, path)
    return long(io.read_vector(spark, path, v.n, v.k))


@query(f"SELECT CAST(r AS INT) AS r, CAST(c AS INT) AS c, CAST({_LOW} AS DOUBLE) AS v {_FOUR}")
def sdmat_write_read(spark, sf_dir):
    path = _place(spark, "small")
    io.write_sdmat(lowest(), spark, path)
    return small(spark, io.read_sdmat(spark, path))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

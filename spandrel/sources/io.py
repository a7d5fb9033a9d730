"""Matrices and vectors from files and into files: MatrixMarket, Harwell-Boeing, binary CRS, Parquet."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..types import BlockVector, Context, MatSym, Matrix, SdMat, SolverError


def _laid_out(m: Matrix, context: Context | None) -> Matrix:
    """The matrix with the distribution of another one."""
    if context is None:
        return m
    if (context.range.n, context.domain.n) != (m.nrows, m.ncols):
        raise SolverError("the context has another shape")
    return Matrix(m.df.repartitionByRange(context.row.blocks, "i"), m.nrows, m.ncols, m.symmetry, context)


def read_mm(spark: SparkSession, path: str, context: Context | None = None) -> Matrix:
    """MatrixMarket coordinate files, real, integer, pattern or complex; general, symmetric, skew-symmetric or hermitian.

    The lines are parsed where they are read.  The mirror images of a symmetric file are added for entries off the diagonal.
    """
    lines = spark.read.text(path)
    head = lines.limit(1).first()
    words = re.sub(r"^%%matrixmarket", "", head[0].strip().lower()).split() if head and head[0].lower().startswith("%%matrixmarket") else None
    if not words or words[:2] != ["matrix", "coordinate"]:
        raise SolverError(f"{path} is not a MatrixMarket coordinate file")
    kind, sym = words[2], words[3]
    if kind not in ("real", "integer", "pattern", "complex") or sym not in ("general", "symmetric", "skew-symmetric", "hermitian"):
        raise SolverError(f"{kind} {sym} is not known")
    rows = lines.where(~F.ltrim("value").startswith("%") & (F.trim("value") != "")).select(F.split(F.trim("value"), "\\s+").alias("f"))
    wanted = {"pattern": 2, "complex": 4}.get(kind, 3)
    # the sizes are the first line that is not a comment: lines keep their order within the first partition
    size = rows.limit(1).first()["f"]
    nrows, ncols = int(size[0]), int(size[1])
    number = lambda k: F.col("f")[k].try_cast("double")
    tagged = rows.withColumn("at", F.monotonically_increasing_id()).where("at > 0").where(F.size("f") >= wanted)
    v = F.lit(1.0) if kind == "pattern" else number(2)
    cols = [(F.col("f")[0].cast("long") - 1).alias("i"), (F.col("f")[1].cast("long") - 1).alias("j"), v.alias("v"), *([number(3).alias("v_im")] if kind == "complex" else [])]
    df = tagged.select(*cols)
    if sym != "general":
        sign = -1.0 if sym == "skew-symmetric" else 1.0
        mirror = [F.col("j").alias("i"), F.col("i").alias("j"), (F.col("v") * sign).alias("v")]
        if kind == "complex":
            mirror.append((F.col("v_im") * (-1.0 if sym == "hermitian" else sign)).alias("v_im"))
        df = df.unionByName(df.where("i != j").select(*mirror))
    return _laid_out(Matrix(df, nrows, ncols, MatSym.HERMITIAN if sym in ("symmetric", "hermitian") else MatSym.GENERAL), context)


def write_mm(m: Matrix, path: str) -> None:
    """One MatrixMarket file (general), entries by row, for exchange; large matrices stay in Parquet."""
    kind = "complex" if m.complex else "real"
    n = m.df.count()
    value = F.concat_ws(" ", (F.col("i") + 1).cast("string"), (F.col("j") + 1).cast("string"), F.col("v").cast("string"), *([F.col("v_im").cast("string")] if m.complex else []))
    body = m.df.select(F.lit(1).alias("k"), "i", "j", value.alias("value"))
    head = m.spark.createDataFrame([(0, 0, 0, f"%%MatrixMarket matrix coordinate {kind} general"), (0, 0, 1, f"{m.nrows} {m.ncols} {n}")], "k int, i long, j long, value string")
    head.unionByName(body).orderBy("k", "i", "j").coalesce(1).select("value").write.text(path)


def _fortran(fmt: str) -> tuple[int, int]:
    """Numbers on a line and their width, of a format such as (16I5) or (1P,5E16.8)."""
    m = re.search(r"(\d*)\s*[IEDFG]\s*(\d+)", fmt.upper().replace("1P,", "").replace("1P", ""))
    if not m:
        raise SolverError(f"format {fmt!r} is not known")
    return int(m[1] or 1), int(m[2])


def read_hb(spark: SparkSession, path: str, context: Context | None = None) -> Matrix:
    """Harwell-Boeing assembled matrices (R, C or P; unsymmetric, symmetric, hermitian or skew); files of that age are small."""
    text = b"".join(bytes(r[0]) for r in spark.read.format("binaryFile").load(path).select("content").collect()).decode("latin-1").splitlines()
    counts = [int(text[1][k : k + 14] or 0) for k in range(0, len(text[1].rstrip()), 14)]
    kind = text[2][:3].upper()
    nrows, ncols, nnz = (int(text[2][k : k + 14]) for k in (14, 28, 42))
    formats = [text[3][:16], text[3][16:32], text[3][32:52]]
    if kind[2] != "A":
        raise SolverError("only assembled matrices")
    at = 5 if len(counts) > 4 and counts[4] > 0 else 4
    parts = []
    for fmt, n, lines, make in ((formats[0], ncols + 1, counts[1], int), (formats[1], nnz, counts[2], int), (formats[2], nnz * (2 if kind[0] == "C" else 1), counts[3], lambda x: float(x.upper().replace("D", "E")))):
        if kind[0] == "P" and make not in (int,):
            break
        per, width = _fortran(fmt)
        numbers = [make(line[k : k + width]) for line in text[at : at + lines] for k in range(0, per * width, width) if line[k : k + width].strip()]
        parts.append(numbers[:n])
        at += lines
    pointer = np.array(parts[0]) - 1
    i = np.array(parts[1], np.int64) - 1
    j = np.repeat(np.arange(ncols), np.diff(pointer))
    v = np.array(parts[2]) if len(parts) > 2 else np.ones(nnz)
    im = v[1::2] if kind[0] == "C" else None
    v = v[0::2] if kind[0] == "C" else v
    if kind[1] in "SHZ":
        off = i != j
        sign = -1.0 if kind[1] == "Z" else 1.0
        if im is not None:
            im = np.concatenate([im, im[off] * (-1.0 if kind[1] == "H" else sign)])
        i, j, v = np.concatenate([i, j[off]]), np.concatenate([j, i[off]]), np.concatenate([v, v[off] * sign])
    cols = {"i": i, "j": j.astype(np.int64), "v": v.astype(float), **({"v_im": im} if im is not None else {})}
    df = spark.createDataFrame(pa.table(cols))
    return _laid_out(Matrix(df, nrows, ncols, MatSym.HERMITIAN if kind[1] in "SH" else MatSym.GENERAL), context)


#: Header of a binary CRS file: endianness, version, base, symmetry, data type (32-bit), then rows, columns, entries (64-bit).
BIN_HEADER = "<iiiiiqqq"
#: Data types: single 1 or double 2, with real 4 or complex 8.
BIN_DTYPES = {1 | 4: "<f4", 2 | 4: "<f8", 1 | 8: "<c8", 2 | 8: "<c16"}


def read_bin(spark: SparkSession, path: str, context: Context | None = None) -> Matrix:
    """Binary CRS: header, row pointers (64-bit), column indices (64-bit), values.  Files are parsed in tasks."""
    head = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, struct.calcsize(BIN_HEADER)).alias("h")).first()["h"]
    _, _, base, _, kind, nrows, ncols, _ = struct.unpack(BIN_HEADER, bytes(head))
    if kind not in BIN_DTYPES:
        raise SolverError(f"data type {kind} is not known")
    is_complex = bool(kind & 8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob in b.column(0):
                raw = blob.as_py()
                at = struct.calcsize(BIN_HEADER)
                pointer = np.frombuffer(raw, "<i8", nrows + 1, at)
                cols = np.frombuffer(raw, "<i8", int(pointer[-1] - pointer[0]), at + 8 * (nrows + 1)) - base
                vals = np.frombuffer(raw, BIN_DTYPES[kind], len(cols), at + 8 * (nrows + 1) + 8 * len(cols))
                out = [pa.array(np.repeat(np.arange(nrows), np.diff(pointer))), pa.array(cols), pa.array(vals.real.astype(float))]
                yield pa.RecordBatch.from_arrays(out + ([pa.array(vals.imag.astype(float))] if is_complex else []), names=["i", "j", "v"] + ["v_im"] * is_complex)

    schema = "i long, j long, v double" + ", v_im double" * is_complex
    return _laid_out(Matrix(spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema), nrows, ncols), context)


def encode_bin(i: np.ndarray, j: np.ndarray, v: np.ndarray, nrows: int, ncols: int) -> bytes:
    """The bytes of a binary CRS file."""
    order = np.lexsort((j, i))
    pointer = np.searchsorted(i[order], np.arange(nrows + 1))
    kind = 2 | (8 if np.iscomplexobj(v) else 4)
    return struct.pack(BIN_HEADER, 0, 1, 0, 1, kind, nrows, ncols, len(v)) + pointer.astype("<i8").tobytes() + j[order].astype("<i8").tobytes() + v[order].astype(BIN_DTYPES[kind]).tobytes()


def write_bin(m: Matrix, path: str) -> None:
    """One binary CRS file, for exchange: its entries pass through the driver; large matrices stay in Parquet."""
    t = m.df.toPandas()
    v = t["v"].to_numpy() + 1j * t["v_im"].to_numpy() if m.complex else t["v"].to_numpy()
    where = m.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(m.spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    out.write(bytearray(encode_bin(t["i"].to_numpy(), t["j"].to_numpy(), v, m.nrows, m.ncols)))
    out.close()


def read_parquet(spark: SparkSession, path: str, context: Context | None = None) -> Matrix:
    """A matrix as written by write_parquet: entries, with the shape in a small table beside them."""
    nrows, ncols = spark.read.parquet(f"{path}/shape").first()
    return _laid_out(Matrix(spark.read.parquet(f"{path}/entries"), nrows, ncols), context)


def write_parquet(m: Matrix, path: str) -> None:
    m.df.write.parquet(f"{path}/entries")
    m.spark.createDataFrame([(m.nrows, m.ncols)], "nrows long, ncols long").coalesce(1).write.parquet(f"{path}/shape")


def write_vector(v: BlockVector, path: str) -> None:
    v.df.write.parquet(path)


def read_vector(spark: SparkSession, path: str, n: int, k: int) -> BlockVector:
    """A vector as written; every index must be there once, with k values."""
    df = spark.read.parquet(path)
    rows, distinct, wide = df.agg(F.count("*"), F.count_distinct("i"), F.count_if(F.size("x") != k)).first()
    if (rows, distinct, wide) != (n, n, 0):
        raise SolverError(f"{path} does not hold a vector of {n} x {k}")
    return BlockVector(df, n, k)


def write_sdmat(m: SdMat, spark: SparkSession, path: str) -> None:
    m.frame(spark).coalesce(1).write.parquet(path)


def read_sdmat(spark: SparkSession, path: str) -> SdMat:
    t = spark.read.parquet(path).toPandas()
    out = np.zeros((t["r"].max() + 1, t["c"].max() + 1))
    out[t["r"], t["c"]] = t["v"]
    return SdMat(out)


def packed_rows(m: Matrix) -> DataFrame:
    """(i, cols, vals): rows as sorted arrays."""
    cells = F.sort_array(F.collect_list(F.struct("j", "v")))
    return m.df.groupBy("i").agg(cells.alias("e")).select("i", F.col("e.j").alias("cols"), F.col("e.v").alias("vals"))

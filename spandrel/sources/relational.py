"""Matrices and vectors from ordinary tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..streaming.loop import cut
from ..types import BlockVector, Matrix


def matrix_from_table(df: DataFrame, i: Column, j: Column, v: Column, nrows: int, ncols: int) -> Matrix:
    """Rows of a table as entries; equal (i, j) are summed, nulls and indices out of range left out."""
    rows = df.select(i.cast("long").alias("i"), j.cast("long").alias("j"), v.cast("double").alias("v"))
    rows = rows.where(F.col("i").between(0, nrows - 1) & F.col("j").between(0, ncols - 1) & F.col("v").isNotNull())
    return Matrix.from_entries(rows, nrows, ncols)


def vector_from_table(df: DataFrame, i: Column, values: list[Column], n: int) -> BlockVector:
    """One row for each index 0..n-1; missing values and rows are zero, repeated rows summed."""
    rows = df.select(i.cast("long").alias("i"), *[F.coalesce(v.cast("double"), F.lit(0.0)).alias(f"v{k}") for k, v in enumerate(values)])
    rows = rows.groupBy("i").agg(F.array(*[F.sum(f"v{k}") for k in range(len(values))]).alias("x"))
    every = df.sparkSession.range(n).withColumnRenamed("id", "i")
    return BlockVector(every.join(rows, "i", "left").select("i", F.coalesce("x", F.array_repeat(F.lit(0.0), len(values))).alias("x")), n, len(values))


def dense_ids(df: DataFrame, key: str) -> DataFrame:
    """(key, id): distinct keys numbered 0.. in their order, without gathering them in one task.

    Keys are sorted by range; each partition numbers its own and the partitions' sizes, a row each, give the offsets.
    """
    keys = df.select(key).where(F.col(key).isNotNull()).distinct().orderBy(key).withColumn("__m", F.monotonically_increasing_id())
    keys = cut(keys)  # stored, so that a lost executor can't number them anew
    part, local = F.shiftright("__m", 33), F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = keys.groupBy(part.alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect()  # a row for each partition
    start, offsets = 0, []
    for p, n in sizes:
        offsets.append((p, start))
        start += n
    table = df.sparkSession.createDataFrame(offsets, "p long, start long")
    return keys.withColumn("p", part).join(F.broadcast(table), "p").select(key, (F.col("start") + local).alias("id"))

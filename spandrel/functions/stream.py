"""Memory-bandwidth queries: load, store, copy and triad over columns of doubles, into aggregates or the noop sink."""

from __future__ import annotations

import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def bench_stream(spark: SparkSession, n: int = 1 << 22) -> dict[str, float]:
    """GB per second of each kernel over n rows (the best of three)."""
    x = spark.range(n).select(F.col("id").cast("double").alias("x"), (F.col("id") * 0.5).alias("y")).persist()
    x.count()
    sink = lambda df: df.write.format("noop").mode("overwrite").save()
    kernels = {
        "load": (8, lambda: x.agg(F.sum("x")).collect()),
        "store": (8, lambda: sink(spark.range(n).select(F.lit(1.0).alias("x")))),
        "copy": (16, lambda: sink(x.select("x"))),
        "triad": (24, lambda: sink(x.select((F.col("x") + 2.0 * F.col("y")).alias("z")))),
    }
    out = {}
    for name, (size, run) in kernels.items():
        best = float("inf")
        for _ in range(3):
            began = time.perf_counter()
            run()
            best = min(best, time.perf_counter() - began)
        out[name] = size * n / best / 1e9
    x.unpersist()
    return out

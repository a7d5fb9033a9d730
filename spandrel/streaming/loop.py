"""Iterative queries: lineage cuts, versioned checkpoints of solver state, and an iteration log.

Lineage is cut with reliable checkpoints in the folder of `spark.checkpoint.dir` (a temporary one where that is unset on a single
machine), so a lost executor costs a re-read and not the run.
"""

from __future__ import annotations

import json
import tempfile
import time
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..types import BlockVector


def checkpoint_dir(spark: SparkSession) -> str:
    jsc = spark.sparkContext._jsc.sc()
    if not jsc.getCheckpointDir().isDefined():
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(where or tempfile.mkdtemp(prefix="ckpt"))
    return jsc.getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """The rows as they are now, computed once and stored reliably.

    A checkpointed frame keeps the estimated size and the constraints of the plan behind it.  A join multiplies sizes,
    so over a loop these become numbers of millions of digits and planning takes longer than running; hence a new frame
    over the stored rows.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    stored = df.checkpoint(eager=True)._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(stored.queryExecution().toRdd(), stored.schema(), False), spark)


def cut_vector(v: BlockVector) -> BlockVector:
    return replace(v, df=cut(v.df))


@dataclass
class IterationLog:
    """Seconds and residuals of the iterations of a loop."""

    rows: list[tuple[int, float, list[float]]] = field(default_factory=list)
    _last: float = field(default_factory=time.monotonic)

    def add(self, k: int, residuals) -> None:
        now = time.monotonic()
        self.rows.append((k, now - self._last, [float(r) for r in np.atleast_1d(residuals)]))
        self._last = now

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(k, c, s, r) for k, s, rs in self.rows for c, r in enumerate(rs)], "k int, col int, seconds double, value double")


class Checkpoint:
    """Named state in versions below a folder: frames as Parquet, numbers and small matrices as JSON.

    A version counts only once its metadata file is written, last of all, so a broken write is never read.
    """

    def __init__(self, spark: SparkSession, folder: str, name: str, keep: int = 2):
        self.spark, self.root, self.keep = spark, f"{folder}/{name}", keep
        self.state: dict = {}
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def add(self, key: str, value) -> None:
        self.state[key] = value

    update = add

    def versions(self) -> list[int]:
        if not self._fs.exists(self._path(self.root)):
            return []
        found = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.root))]
        return sorted(int(n[2:]) for n in found if n.startswith("v-") and self._fs.exists(self._path(f"{self.root}/{n}/metadata")))

    def need_restart(self) -> bool:
        return bool(self.versions())

    def write(self) -> int:
        n = (self.versions() or [-1])[-1] + 1
        where, meta = f"{self.root}/v-{n}", {}
        for k, v in self.state.items():
            if isinstance(v, BlockVector):
                v.df.write.mode("overwrite").parquet(f"{where}/{k}")
                meta[k] = {"vector": [v.n, v.k]}
            elif isinstance(v, DataFrame):
                v.write.mode("overwrite").parquet(f"{where}/{k}")
                meta[k] = {"frame": True}
            else:
                meta[k] = {"array": np.asarray(v, float).tolist()}
        self.spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{where}/metadata")
        for old in self.versions()[: -self.keep]:
            self._fs.delete(self._path(f"{self.root}/v-{old}"), True)
        return n

    def read(self) -> dict:
        n = self.versions()[-1]
        where = f"{self.root}/v-{n}"
        meta = json.loads(self.spark.read.text(f"{where}/metadata").first()[0])
        for k, m in meta.items():
            if "array" in m:
                self.state[k] = np.array(m["array"])
            else:
                df = self.spark.read.parquet(f"{where}/{k}")
                self.state[k] = BlockVector(df, *m["vector"]) if "vector" in m else df
        return self.state

    commit = write

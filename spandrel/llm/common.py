"""Shared helpers: table access, reliable lineage cuts, JVM text expressions and batched word scanning."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass holds at a time; a longer document is a slice of its own.
SLICE_BYTES = 1_500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder in `spark.checkpoint.dir`; a temporary one only where that is unset on a single machine (tests)."""
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return jsc.getCheckpointDir().get()
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="ckpt")
    spark.sparkContext.setCheckpointDir(where)
    return jsc.getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a replicated checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Lets Spark remove the shuffle files of a finished write, whose rows are in the written table.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame) -> DataFrame:
    """Write the rows as Parquet into the shared checkpoint folder and read them back (deleted when the session's JVM ends)."""
    spark = df.sparkSession
    where = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(where)
    finally:
        spark.conf.set(CLEANUP, before)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    out = spark.read.schema(df.schema).parquet(where)
    out.written_to = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables of `materialize` that nothing reads any more; what was made of them must be written."""
    for df in tables:
        path = df.written_to
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def trim() -> None:
    """Give memory that a finished task has freed back to the machine; a Python worker waits for later tasks beside others."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like `name` that the frame doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def lower_ascii(c: Column | str) -> Column:
    """A-Z to lower case, everything else as it is."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_words(c: Column) -> Column:
    """Array of the words `[^\\x20\\x09-\\x0D]+`; null has none."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), "[ \\t-\\r]+"), lambda w: w != "")


# ---------------------------------------------------------------- batched word scanning

_SPACE = np.ones(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = False
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Which bytes belong to a word, after A-Z became lower case.
WORD_BYTES = {"space": _SPACE, "alnum": _ALNUM}

_PRIME = 0x9E3779B97F4A7C15
#: The lowest 0 to 8 bytes of a 64-bit number.
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Longer words are hashed whole by XXH64, one at a time.
LONG_WORD = 64


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (shift, multiply, shift, multiply, shift)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def eight_bytes(b: np.ndarray) -> np.ndarray:
    """For each place (and the end) the eight bytes from there on, as one number; zeros after the end."""
    padded = np.zeros(len(b) + 8, np.uint8)
    padded[: len(b)] = b
    return np.ndarray((len(b) + 1,), "<u8", padded, strides=(1,))


def word_hashes(b: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of every word b[start:end]: eight bytes are mixed in after another, so equal hashes follow no pattern."""
    length = end - start
    h = mix64((length.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
    eight = eight_bytes(b)
    live = np.flatnonzero(length <= LONG_WORD)
    at, left = start[live], length[live]
    while len(live):
        h[live] = mix64(h[live] * np.uint64(_PRIME) + (eight[at] & _LOW[np.minimum(left, 8)]))
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(length > LONG_WORD).tolist():
        h[i] ^= np.uint64(xxhash.xxh64_intdigest(b[start[i] : end[i]], int(length[i])))
    return h


@dataclass
class Words:
    """The words of rows lo..hi of a column: byte positions in `data`, the row (from 0) and a 64-bit hash of each."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray

    @property
    def n_rows(self) -> int:
        return self.hi - self.lo

    @property
    def first(self) -> np.ndarray:
        """Index of the first word of each row, and the number of words at the end."""
        return np.searchsorted(self.row, np.arange(self.n_rows + 1))


def string_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a text column; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_binary()).fill_null(b"")
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data, off


def row_slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows of about `limit` bytes, one row at least."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def scan_words(col: pa.Array, kind: str = "space", limit: int = SLICE_BYTES) -> Iterator[Words]:
    """Lower-cased words of whole texts, slice by slice; empty slices come too, so every row is seen."""
    data, offsets = string_buffers(col)
    is_word = WORD_BYTES[kind]
    for lo, hi in row_slices(offsets, limit):
        off = offsets[lo : hi + 1] - offsets[lo]
        b = data[offsets[lo] : offsets[hi]].copy()
        b[(b >= 65) & (b <= 90)] += 32
        w = is_word[b]
        n = len(b)
        inner = off[(off > 0) & (off < n)]
        before = np.zeros(n, bool)
        after = np.zeros(n, bool)
        if n:
            before[1:], after[:-1] = w[:-1], w[1:]
            before[inner] = False
            after[inner - 1] = False
        start, end = np.flatnonzero(w & ~before), np.flatnonzero(w & ~after) + 1
        yield Words(lo, hi, b, off, start, end, np.searchsorted(off, start, "right") - 1, word_hashes(b, start, end))


def gram_hash(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n consecutive entries (order matters)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for i in range(n):
        out = mix64(out * np.uint64(_PRIME) + h[i : i + m])
    return out


def segment_sum(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values[first[i]:first[i+1]], zero for empty segments."""
    total = np.concatenate([np.zeros((1, *values.shape[1:]), values.dtype), np.cumsum(values, axis=0)])
    return total[first[1:]] - total[first[:-1]]

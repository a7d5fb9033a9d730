"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Inputs of a score: hashed words (log counts, each text of length one), nine binned structure statistics, and one
metadata column, n_chars, binned.  Never labels, lang, source or doc_id.  Pairwise interactions have low rank, and a
score takes time linear in the features by the sum-of-squares identity.

The model is fitted on the driver from at most `MAX_TRAIN_ROWS` labelled documents of at most `MAX_TRAIN_BYTES` of text
together, those with the smallest hashes of their doc_id, one text of each id, so the driver's memory is bounded; every
document is scored.

Defined results: a null or empty text has structure statistics only; several labels of a document count as their
majority (ties as 1), null labels not at all; a null doc_id is held out by the checksum of the empty text and never
labelled; of a labelled id with several texts the one with the smallest hash is learnt from; without labelled rows all
scores are 0.5; repeated rows are scored alike; a very long text is scored whole, as a slice of its own; other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, scan_words, string_buffers, table, trim
from .sparse import FM, Sparse, beside, fit_fm, one_row_each, sigmoid, structure_bins, word_features

DIMS = 1 << 17
RANK = 8
MAX_TRAIN_ROWS, MAX_TRAIN_BYTES = 20_000, 256_000_000
STRUCTURE = 10  # nine statistics and n_chars


def checksum(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def held_out(doc_id: Column) -> Column:
    return checksum(doc_id) % 3 == 1


def training_labels(labels: DataFrame, name: str, limit: int = MAX_TRAIN_ROWS) -> DataFrame:
    """(label_id, y) of at most `limit` documents that aren't held out, the smallest by the hash of doc_id."""
    known = labels.where(F.col(name).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("label_id")).agg((F.avg(F.col(name).cast("double")) >= 0.5).cast("int").alias("y"))
    return known.orderBy(F.xxhash64("label_id"), "label_id").limit(limit)


def training_texts(rows: DataFrame, limit: int = MAX_TRAIN_BYTES) -> DataFrame:
    """One row for each label_id of rows (label_id, text, ...), in order of its hash as far as their texts have `limit` bytes together.

    There are no more label_ids than labels were chosen, so their sizes are a bounded table for the driver.
    """
    key = F.xxhash64("label_id")
    sizes = rows.groupBy(key.alias("h")).agg(F.max(F.coalesce(F.octet_length("text"), F.lit(0))).alias("size")).toArrow().sort_by("h")
    fits = np.cumsum(sizes["size"].to_numpy().astype(np.int64)) <= limit
    if not fits.all():
        rows = rows.where(key <= int(sizes["h"].to_numpy()[fits][-1])) if fits.any() else rows.where("false")
    one = rows.groupBy("label_id").agg(F.min_by(F.struct(*rows.columns), F.struct(F.xxhash64("text"), "text")).alias("r"))
    return one.select("r.*")


def features(w: Words, raw: np.ndarray, n_chars: np.ndarray) -> Sparse:
    """Of one slice; raw: its bytes before lower-casing; n_chars below 0: unknown."""
    size = np.where(n_chars < 0, 31, np.round(1.5 * np.log2(1 + np.maximum(n_chars, 0)))).astype(np.int64)
    bins = np.concatenate([structure_bins(raw, w), size[:, None]], axis=1)
    return beside(word_features(w, DIMS), one_row_each(bins, DIMS, 0.5))


def batch_features(batch: pa.RecordBatch) -> Iterator[tuple[Words, Sparse]]:
    """Of columns doc_id, text, n_chars."""
    data, off = string_buffers(batch.column(1))
    n_chars = batch.column(2).fill_null(-1).to_numpy(zero_copy_only=False)
    for w in scan_words(batch.column(1)):
        yield w, features(w, data[off[w.lo] : off[w.hi]], n_chars[w.lo : w.hi])


def _inputs(docs: DataFrame) -> DataFrame:
    n_chars = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.length("text").cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), n_chars.alias("n_chars"))


def collect_features(rows: DataFrame, y: str = "y") -> tuple[Sparse, np.ndarray]:
    """Feature rows and labels of a bounded DataFrame (doc_id, text, n_chars, y)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w, x in batch_features(batch):
                ptr = x.ptr.astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(w.lo, w.n_rows), batch.column(3).slice(w.lo, w.n_rows), pa.ListArray.from_arrays(ptr, pa.array(x.idx.astype(np.int32))), pa.ListArray.from_arrays(ptr, pa.array(x.val))], names=["doc_id", y, "idx", "val"])
        trim()

    got = rows.mapInArrow(run, f"doc_id long, {y} int, idx array<int>, val array<float>").toArrow().sort_by("doc_id").combine_chunks()
    if not got.num_rows:
        return Sparse(np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)), np.zeros(0)
    idx = got["idx"].chunk(0)
    ptr = np.concatenate([[0], np.cumsum(np.asarray(idx.value_lengths()))]).astype(np.int64)
    return Sparse(ptr, idx.flatten().to_numpy().astype(np.int64), got["val"].chunk(0).flatten().to_numpy()), got[y].to_numpy().astype(float)


def fit(docs: DataFrame, labels: DataFrame, limit: int = MAX_TRAIN_ROWS) -> FM:
    chosen = F.broadcast(training_labels(labels, "quality", limit))  # at most `limit` rows
    rows = training_texts(_inputs(docs).join(chosen, F.col("doc_id") == F.col("label_id"))).select("doc_id", "text", "n_chars", "y")
    x, y = collect_features(rows)
    model = fit_fm(x, y, DIMS + 32 * STRUCTURE, RANK)
    del x, y
    trim()
    return model


def score(docs: DataFrame, model: FM) -> DataFrame:
    """(doc_id, score) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for w, x in batch_features(batch):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(w.lo, w.n_rows), pa.array(sigmoid(m.raw(x)))], names=["doc_id", "score"])

    return _inputs(docs).mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: FM, least: float = 0.5) -> DataFrame:
    """The documents with a score of `least` or more, all columns, without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.schema
    names = schema.fieldNames()
    text, chars = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            t = batch.column(text)
            n = batch.column(chars).cast(pa.int64()) if chars is not None else pc.utf8_length(t).cast(pa.int64())
            own = pa.RecordBatch.from_arrays([pa.nulls(len(t), pa.int64()), t, n], names=["doc_id", "text", "n_chars"])
            good = np.concatenate([sigmoid(m.raw(x)) >= least for _, x in batch_features(own)] or [np.zeros(0, bool)])
            yield batch.filter(pa.array(good))
        trim()

    return docs.mapInArrow(run, schema)


def op4_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

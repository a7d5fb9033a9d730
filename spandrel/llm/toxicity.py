"""Toxicity: a chain of linear classifiers over the words and word beginnings that occur once, twice, four or eight times.

The categories are predicted one after another; each model also gets the log-odds of the categories before it.  In
training these come from models of other folds (out-of-fold), so a later model never sees predictions that an earlier
one made for rows it was fitted on.  The chain is fitted on the driver from at most `MAX_TRAIN_ROWS` labelled documents
of at most MAX_TRAIN_BYTES of text together (the smallest by the hash of their doc_id, one text of each id); every
document is scored.

Any list of (name, SQL condition over the label columns) can be categories.  `labels` marks two: low quality (junk is
easily taken for abuse, so it comes first) and toxic.

Defined results: null or empty texts get the score of no evidence; rows whose label columns are null are not learnt
from; of several labels of a document the larger of each category holds, of several texts the one with the smallest
hash; a probability of just one half is a decision for the category; repeated rows are scored alike; a very long text is
scored whole, as a slice of its own; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scan_words, table
from .quality_classifier import held_out, training_texts
from .sparse import FM, Sparse, beside, fit_fm, presence_features, sigmoid

DIMS = 1 << 18
MAX_TRAIN_ROWS = 20_000
#: Features seen in fewer training documents say nothing.
MIN_DOCS = 6
#: Standard deviations by which a feature must be commoner, or rarer, in some category.
EVIDENCE = 4.0
FOLDS = 3
CATEGORIES = (("low_quality", "quality = 0"), ("toxic", "toxic = 1"))


@dataclass
class Chain:
    names: list[str]
    used: np.ndarray  # features that count, True or False
    models: list[FM]

    def inputs(self, x: Sparse) -> Sparse:
        keep = self.used[x.idx]
        n = np.concatenate([[0], np.cumsum(keep)])
        return Sparse(n[x.ptr], x.idx[keep], x.val[keep])

    def predict(self, x: Sparse) -> np.ndarray:
        """Probabilities (rows x categories), in the order of the chain."""
        x, out = self.inputs(x), []
        for m in self.models:
            raw = m.raw(_with_earlier(x, out))
            out.append(np.clip(raw, -6, 6))
        return sigmoid(np.stack(out, axis=1)) if out else np.zeros((len(x), 0))


def _with_earlier(x: Sparse, earlier: list[np.ndarray]) -> Sparse:
    """Adds the log-odds of the earlier categories as features DIMS, DIMS + 1, ..."""
    if not earlier:
        return x
    e = np.stack(earlier, axis=1)
    n, k = e.shape
    return beside(x, Sparse(np.arange(n + 1) * k, np.tile(DIMS + np.arange(k), n), (e / 4).ravel().astype(np.float32)))


def best_cut(raw: np.ndarray, y: np.ndarray) -> float:
    """Score from which on predicting 1 gives the best F1; 0 if either label is missing."""
    if not 0 < y.sum() < len(y):
        return 0.0
    order = np.argsort(-raw, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    k = int(np.argmax(f1))
    return float((raw[order[k]] + raw[order[min(k + 1, len(y) - 1)]]) / 2)


def fit_chain(x: Sparse, labels: np.ndarray, names: list[str], folds: int = FOLDS, min_docs: int = MIN_DOCS) -> Chain:
    """labels: rows x categories of 0 and 1."""
    n = np.bincount(x.idx, minlength=DIMS)
    used = np.zeros(DIMS, bool)
    for y in labels.T:  # what goes with a category beyond chance; the rest would only add up to noise in long texts
        p = np.clip(y.mean(), 1e-9, 1 - 1e-9)
        hits = np.bincount(x.idx, y[x.row], minlength=DIMS)
        used |= np.abs(hits - n * p) >= EVIDENCE * np.sqrt(np.maximum(n, 1) * p * (1 - p))
    used &= n >= min_docs
    chain = Chain(names, used, [])
    x = chain.inputs(x)
    fold = np.random.default_rng(2).integers(0, folds, len(x))
    dims, fit = DIMS + len(names), dict(rank=0, epochs=12, rate=0.3, decay=2e-3)
    earlier: list[np.ndarray] = []
    for c in range(len(names)):
        own = _with_earlier(x, earlier)
        y = labels[:, c]
        out = np.zeros(len(x))
        for k in range(folds):
            rest, here = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
            if len(here):
                out[here] = fit_fm(own.take(rest), y[rest], dims, **fit).raw(own.take(here))
        model = fit_fm(own, y, dims, **fit)
        shift = best_cut(out, y)
        model.bias -= shift  # a probability of one half is the decision with the best F1 out of fold
        chain.models.append(model)
        earlier.append(np.clip(out - shift, -6, 6))
    return chain


def fit(docs: DataFrame, labels: DataFrame, categories=CATEGORIES, limit: int = MAX_TRAIN_ROWS) -> Chain:
    names = [n for n, _ in categories]
    marks = [F.expr(c).cast("int").alias(f"y{i}") for i, (_, c) in enumerate(categories)]
    known = labels.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("label_id"), *marks).dropna()
    known = known.groupBy("label_id").agg(*[F.max(f"y{i}").alias(f"y{i}") for i in range(len(names))])
    chosen = F.broadcast(known.orderBy(F.xxhash64("label_id"), "label_id").limit(limit))
    packed = F.array(*[f"y{i}" for i in range(len(names))]).alias("y")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(chosen, F.col("doc_id") == F.col("label_id"))
    rows = training_texts(rows).select("doc_id", "text", packed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in scan_words(batch.column(1)):
                x = presence_features(w, DIMS)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(w.lo, w.n_rows), batch.column(2).slice(w.lo, w.n_rows), pa.ListArray.from_arrays(x.ptr.astype(np.int32), pa.array(x.idx.astype(np.int32)))], names=["doc_id", "y", "idx"])

    got = rows.mapInArrow(run, "doc_id long, y array<int>, idx array<int>").toArrow().sort_by("doc_id").combine_chunks()
    if not got.num_rows:
        return Chain(names, np.zeros(DIMS, bool), [FM(0.0, np.zeros(DIMS + len(names), np.float32), np.zeros((DIMS + len(names), 0), np.float32)) for _ in names])
    idx = got["idx"].chunk(0)
    ptr = np.concatenate([[0], np.cumsum(np.asarray(idx.value_lengths()))]).astype(np.int64)
    flat = idx.flatten().to_numpy().astype(np.int64)
    y = got["y"].chunk(0).flatten().to_numpy().reshape(-1, len(names)).astype(float)
    return fit_chain(Sparse(ptr, flat, np.ones(len(flat), np.float32)), y, names)


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """(doc_id, chain): the probabilities of the categories of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for w in scan_words(batch.column(1)):
                p = m.predict(presence_features(w, DIMS))
                lists = pa.ListArray.from_arrays((np.arange(w.n_rows + 1) * p.shape[1]).astype(np.int32), pa.array(p.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(w.lo, w.n_rows), lists], names=["doc_id", "chain"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, chain array<double>")


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    toxic = F.element_at("chain", -1)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), toxic.alias("score"), (toxic >= 0.5).alias("toxic"), F.get("chain", F.lit(0)).alias("p_low_quality"))

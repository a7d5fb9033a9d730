"""A corpus pipeline: each stage works on the rows that the one before kept, written as Parquet and read again.

STAGES: (name, function(spark, docs, sf_dir)); all but the last return the columns of documents.

Defined results, of every stage: an empty table gives no rows; other columns, whatever their names, are passed on (the
last stage returns doc_id and its own columns); a null doc_id is a value like others, the smallest where ids are
compared; rows that repeat an id or are equal are each decided by their own text, and very long texts whole.

* quality_classifier: rows with a score of one half or more stay; a null or empty text has the score of its structure,
  without labels everything stays.
* line_dedup: a null text stays null and an empty one empty; rows stay, their lines may go.
* simhash_near_dedup: of near copies the smallest doc_id stays, in all the rows that have it; null, empty and blank
  texts are copies of each other.
* decontamination: a null or empty text holds no passage and stays.
* byte_bpe: a null or empty text has no tokens.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spandrel.llm import bpe, common, decontamination, line_dedup, near_copies, quality_classifier


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good."""
    model = quality_classifier.fit(docs, common.table(spark, sf_dir, "labels"))
    return quality_classifier.keep_good(docs, model)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that other documents keep; n_chars follows where the text changed."""
    found = line_dedup.dedup_lines(docs)
    bits = F.col(line_dedup.bits_column(found))
    text, changed = line_dedup.kept_text(F.col("text"), bits), bits.isNotNull()
    new = {"text": F.when(changed, text).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length(text).cast("long")).otherwise(F.col("n_chars"))
    return found.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies (five-word shingles, similarity 0.8 or more).

    Operator 8's interface for a similarity: its fingerprints would need a radius that its trees can't prune.
    """
    return near_copies.keep_first(docs, shingle=5, similarity=0.8)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of words with the benchmark."""
    return decontamination.decontaminate(docs, common.table(spark, sf_dir, "benchmark"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, with the digests of the ids and of the decoded bytes."""
    return bpe.encode(docs, *bpe.public_vocabulary(), with_ids=True)


STAGES = [
    ("quality_classifier", quality_classifier_stage),
    ("line_dedup", line_dedup_stage),
    ("simhash_near_dedup", simhash_stage),
    ("decontamination", decontamination_stage),
    ("byte_bpe", bpe_stage),
]

#: No SQL for the rows: the first and the third stage can't be expressed in SQL (fitted model, MinHash).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after another, over the documents."""
    folder = f"{common.ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs

"""Line dedup [native]: range-partitioned line hashes, streamed in order of document and position, give keep bitmaps.

A line's key is the line without `[\\x20\\x09-\\x0D]` at its ends, A-Z in lower case.  Keys of at least `min_chars`
code points found in at least `min_docs` documents lose all their lines but those in the largest doc_id that holds
them.  The operator returns, per document, the number of dropped lines and a compressed keep bitmap - never text.  The
bitmap lists (word, keep) for each run of 64 lines that loses some; bit pos % 64 of keep is 1 for a line that stays,
and runs that aren't listed stay whole (null: nothing is dropped).

Keys are two 64-bit hashes of the key.  They are partitioned by range and sorted by key, falling doc_id and position; a
stream over that order meets a key's keeper first.  Skew: keys with more than `HOT_LINES` lines leave the stream; an
aggregation with map-side partial results decides them, and their lines are marked by a join that adaptive execution
broadcasts or splits by measured size, so no task gets all of a key however large the corpus.

Defined results: a null or empty text is one empty line; a null doc_id counts as the smallest id; rows that repeat a
doc_id are one document to the count, and each is treated by its own text; a very long text is one row whose lines are
spread by key; other columns are passed on whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, lower_ascii, materialize, table

#: Lines of one key that a task may stream.
HOT_LINES = 256
LOWEST = -(2**63)
#: What is stripped from both ends of a line.
BLANKS = " \t\n\x0b\x0c\r"


def lines_of(text: Column | str) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(BLANKS)))


def _occurrences(docs: DataFrame, min_chars: int) -> DataFrame:
    rows = docs.select(F.coalesce("doc_id", F.lit(LOWEST)).alias("d"), F.xxhash64("text").alias("t"), F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    rows = rows.where(F.length("line") >= min_chars).select("d", "t", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    return rows.select("d", "t", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.reverse("key")).alias("h2"))


def dropped_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, hot_lines: int = HOT_LINES) -> DataFrame:
    """(d, t, pos) of every line to drop; d: doc_id, t: hash of the text, pos: line from 0."""
    key = ["h1", "h2"]
    occ = materialize(_occurrences(docs, min_chars))
    counts = occ.groupBy(*key).agg(F.count("*").alias("n"))
    hot = materialize(counts.where(F.col("n") > hot_lines).select(*key))
    # the stream: at most hot_lines lines of a key, the document with the largest id first
    runs = occ.join(hot, key, "left_anti").repartitionByRange(*key)
    order = Window.partitionBy(*key).orderBy(F.desc("d"), "pos")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = (F.lag("d").over(order) != F.col("d")) | F.lag("d").over(order).isNull()
    seen = runs.withColumn("first", first.cast("int")).withColumn("keeper", F.first("d").over(order)).withColumn("docs", F.sum("first").over(whole))
    cold = seen.where((F.col("docs") >= min_docs) & (F.col("d") != F.col("keeper"))).select("d", "t", "pos")
    # hot keys: merged from partial results, a row each
    at = occ.join(hot, key, "left_semi")
    heads = at.groupBy(*key, "d").agg(F.count("*").alias("n")).groupBy(*key).agg(F.count("*").alias("docs"), F.max("d").alias("keeper"))
    warm = at.join(heads.where(F.col("docs") >= min_docs), key).where("d != keeper").select("d", "t", "pos")
    return cold.unionByName(warm)


def keep_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, hot_lines: int = HOT_LINES) -> DataFrame:
    """(d, t, n_dropped, keep) of the documents that lose lines; keep: sorted (word, bits) of the runs of 64 lines that lose some."""
    word = F.floor(F.col("pos") / 64).cast("int")
    mark = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("pos") % 64).cast("int"))
    words = dropped_lines(docs, min_chars, min_docs, hot_lines).groupBy("d", "t", word.alias("word")).agg(F.bitwise_not(F.bit_or(mark)).alias("bits"))
    keep = F.sort_array(F.collect_list(F.struct("word", "bits")))  # bounded by the text of the document
    return words.groupBy("d", "t").agg(F.sum(64 - F.bit_count("bits")).cast("long").alias("n_dropped"), keep.alias("keep"))


def kept_text(text: Column, keep: Column) -> Column:
    """Text without the lines that the bitmap drops."""
    # 1 or 0 for each line up to the last listed run, the runs between filled up; then line by line
    before = F.concat(F.array(F.lit(-1)), F.transform(keep, lambda e: e["word"]))
    runs = F.zip_with(keep, before, lambda e, last: F.concat(F.repeat(F.lit("1"), 64 * (e["word"] - last - 1)), F.rpad(F.reverse(F.bin(e["bits"])), 64, "0")))
    marks = F.split(F.array_join(runs, ""), "")
    lines = F.filter(F.zip_with(lines_of(text), marks, lambda line, mark: F.struct(line.alias("line"), mark.alias("mark"))), lambda x: x["line"].isNotNull() & (F.coalesce(x["mark"], F.lit("1")) != "0"))
    return F.when(keep.isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join(F.transform(lines, lambda x: x["line"]), "\n"))


def bits_column(docs: DataFrame) -> str:
    """Name of the bitmaps' column in what dedup_lines returns."""
    return docs.columns[-1]


def count_column(docs: DataFrame) -> str:
    return docs.columns[-2]


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, hot_lines: int = HOT_LINES) -> DataFrame:
    """The documents and two more columns, number of the dropped lines and keep bitmap (null: none), by one join on (doc_id, hash of the text)."""
    d, t, n, bits = (fresh(docs, f"__{c}") for c in ("d", "t", "n", "bits"))
    bitmaps = keep_bitmaps(docs, min_chars, min_docs, hot_lines).toDF(d, t, n, bits)
    found = docs.join(bitmaps, (F.coalesce("doc_id", F.lit(LOWEST)) == F.col(d)) & (F.xxhash64("text") == F.col(t)), "left")
    return found.select(*docs.columns, n, bits)


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id",
        F.size(lines_of(F.col("text"))).cast("long").alias("n_lines"),
        F.coalesce(count_column(out), F.lit(0)).cast("long").alias("n_dropped"),
        F.sha2(kept_text(F.col("text"), F.col(bits_column(out))), 256).alias("kept_sha256"),
    )


OP7_SQL = """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), k AS (
  SELECT doc_id, pos, line, translate(regexp_replace(line, '^[ \\t-\\r]+|[ \\t-\\r]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), g AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), f AS (
  SELECT k.*, g.keeper IS NOT NULL AND g.keeper <> k.doc_id AS dropped FROM k LEFT JOIN g USING (key)
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN dropped THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""

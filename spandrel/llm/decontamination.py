"""Benchmark decontamination by suffix arrays over shards of the training documents.

Each Arrow slice of documents is a shard: its words become dense ranks, prefix doubling (3, 6, 12 words) sorts the
suffixes, and every suffix of every test item is binary-searched among them.  A test suffix that shares `window` words
or more with training suffixes has its matches in one range of the array; those give the hit words, the items, and the
longest verbatim match with its place.  Shards need nothing of each other, so there is no shuffle of documents.

Words meet by 64-bit hashes; every match is then compared byte by byte, so a hash that two words share hits nothing.

Items reach the shards in blocks of at most `ITEM_BLOCK_BYTES` of text, one after another: one block is the usual case;
a larger benchmark takes one pass over the documents for each block, whose hits are written, and one aggregation by
row; rows are numbered and written for that.  The driver holds one block at a time.

Defined results: null or empty text has no words; items without words match nothing; a null item_id is not counted or
listed, though its words are hit; rows of equal or null doc_id are reported one by one; of equally long matches the
first is named; other columns, whatever their names, are ignored; a very long text is a shard of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, materialize, scan_words, table, trim

WINDOW = 10
ITEM_BLOCK_BYTES = 16_000_000
#: Words by which suffixes are sorted: at least the window.
DEPTH = 12


@dataclass
class Items:
    """Words of the items one after another, and their suffixes of a window or more."""

    words: np.ndarray  # hash of each word
    item: np.ndarray  # item of each word
    first: np.ndarray  # first word of each item
    ids: list[int | None]
    suffix: np.ndarray  # word at which a distinct window begins first
    size: np.ndarray  # words of that window
    holders: list[list[int]]  # items that hold it
    places: list[list[int]]  # all words at which it begins
    data: np.ndarray  # bytes of all items in lower case, and where the words are
    start: np.ndarray
    end: np.ndarray

    @classmethod
    def of(cls, ids: list, texts: list, window: int) -> Items:
        w = [x for x in scan_words(pa.array(texts, pa.string()), "alnum", 1 << 62)][0] if texts else None
        if w is None or not len(w.hash):
            z = np.zeros(0, np.int64)
            return cls(np.zeros(0, np.uint64), z, np.zeros(1, np.int64), list(ids), z, z, [], [], np.zeros(0, np.uint8), z, z)
        first, windows = w.first, {}
        for i in range(len(ids)):
            a, b = int(first[i]), int(first[i + 1])
            size = min(window, b - a)
            for p in range(a, b - size + 1) if size else ():
                at = windows.setdefault(w.hash[p : p + size].tobytes(), (p, size, set(), []))
                at[2].add(i)
                at[3].append(p)
        return cls(w.hash, w.row, first, list(ids), np.array([x[0] for x in windows.values()], np.int64), np.array([x[1] for x in windows.values()], np.int64), [sorted(x[2]) for x in windows.values()], [x[3] for x in windows.values()], w.data, w.start, w.end)


def suffix_array(ranks: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Positions ordered by their first `depth` ranks (prefix doubling from 3 words packed into one key)."""
    bits = max(1, int(ranks.max()).bit_length()) if len(ranks) else 1
    span = max(1, min(3, 63 // bits))
    key = np.zeros(len(ranks), np.int64)
    for k in range(span):
        key <<= bits
        key[: len(ranks) - k] += ranks[k:]
    order = np.argsort(key)
    while True:
        new = np.ones(len(order), np.int64)
        new[1:] = key[order[1:]] != key[order[:-1]]
        level = np.empty(len(order), np.int64)
        level[order] = np.cumsum(new)
        if span >= depth or level.max(initial=0) == len(order):
            return order
        key = level * np.int64(len(order) + 1)
        key[: len(order) - span] += level[span:]
        order = np.argsort(key)
        span *= 2


def search(ranks: np.ndarray, order: np.ndarray, queries: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Range lo..hi of the suffixes that begin with the first sizes[q] words of queries[q] (rows padded)."""

    def bound(after: bool) -> np.ndarray:
        lo, hi = np.zeros(len(queries), np.int64), np.full(len(queries), len(order), np.int64)
        while (open_ := lo < hi).any():
            mid = (lo + hi) >> 1
            p = order[np.minimum(mid, len(order) - 1)]
            less, same = np.zeros(len(queries), bool), np.ones(len(queries), bool)
            for k in range(queries.shape[1]):
                live = same & (k < sizes)
                x = ranks[np.minimum(p + k, len(ranks) - 1)]
                less |= live & (x < queries[:, k])
                same &= ~live | (x == queries[:, k])
            right = open_ & (less | (same & after))
            lo, hi = np.where(right, mid + 1, lo), np.where(open_ & ~right, mid, hi)
        return lo

    return bound(False), bound(True)


def same_words(w: Words, begin: np.ndarray, items: Items, suffix: np.ndarray, size: np.ndarray, step: int = 20_000) -> np.ndarray:
    """Whether the size[i] words from begin[i] on of a shard are, byte by byte, those from suffix[i] on of the items."""
    out = np.ones(len(begin), bool)
    for a in range(0, len(begin), step):
        n = size[a : a + step]
        of = np.repeat(np.arange(len(n)), n)
        k = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        x, y = begin[a : a + step][of] + k, suffix[a : a + step][of] + k
        length = w.end[x] - w.start[x]
        bad = length != items.end[y] - items.start[y]
        length = np.where(bad, 0, length)
        of_byte = np.repeat(np.arange(len(x)), length)
        j = np.arange(len(of_byte)) - np.repeat(np.cumsum(length) - length, length)
        bad[of_byte[w.data[w.start[x][of_byte] + j] != items.data[items.start[y][of_byte] + j]]] = True
        out[a : a + step] = np.bincount(of, bad, minlength=len(n)) == 0
    return out


def match_shard(w: Words, items: Items) -> tuple[np.ndarray, list[set[int]], np.ndarray]:
    """Of one shard: which words are hit, the items of each row, and per row its longest match (words, first word, item)."""
    word, row, n_rows = w.hash, w.row, w.n_rows
    hit, found = np.zeros(len(word), bool), [set() for _ in range(n_rows)]
    longest = np.zeros((n_rows, 3), np.int64)
    if not len(word) or not len(items.suffix):
        return hit, found, longest
    # dense ranks of the words; between rows stand entries that match nothing, at the end enough of them for any suffix
    values, rank = np.unique(word, return_inverse=True)
    place = np.arange(len(word)) + row  # one gap before each later row
    ranks = np.zeros(len(word) + n_rows + DEPTH, np.int64)
    ranks[place] = rank + 1
    back = np.full(len(ranks), -1, np.int64)
    back[place] = np.arange(len(word))
    order = suffix_array(ranks)
    at = np.minimum(np.searchsorted(values, items.words), len(values) - 1)
    local = np.where(values[at] == items.words, at + 1, -1)
    width = int(items.size.max())
    queries = local[np.minimum(items.suffix[:, None] + np.arange(width), len(local) - 1)]
    whole = ((queries >= 0) | (np.arange(width) >= items.size[:, None])).all(axis=1)
    q = np.flatnonzero(whole)
    if not len(q):
        return hit, found, longest
    lo, hi = search(ranks, order, queries[q], items.size[q])
    n = hi - lo
    some = n > 0
    q, lo, n = q[some], lo[some], n[some]
    if not len(q):
        return hit, found, longest
    of = np.repeat(np.arange(len(q)), n)
    start = order[np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))]
    begin, size = back[start], items.size[q][of]
    real = same_words(w, begin, items, items.suffix[q][of], size)
    of, start, begin, size = of[real], start[real], begin[real], size[real]
    if not len(of):
        return hit, found, longest
    edge = np.zeros(len(word) + 1, np.int64)
    np.add.at(edge, begin, 1)
    np.add.at(edge, begin + size, -1)
    hit = np.cumsum(edge)[:-1] > 0
    r = row[begin]
    for x, y in np.unique(np.stack([r, q[of]]), axis=1).T.tolist():
        found[x].update(items.holders[y])
    # how far each match goes on from any place of its window, all together, a step for each further word
    length, source = size.copy(), items.suffix[q][of]
    places = [items.places[x] for x in q.tolist()]
    count = np.array([len(x) for x in places])
    some, at_of = np.arange(len(q)), np.zeros(len(q), np.int64)
    left = np.arange(len(of))
    for k in range(int(count.max())):  # the k-th place of every window that has so many
        some, left = some[count[some] > k], left[count[of[left]] > k]
        at_of[some] = [places[x][k] for x in some.tolist()]
        at, begins, own = at_of[of[left]], start[left], size[left]
        end_of_item, live = items.first[items.item[at] + 1], np.arange(len(left))
        while len(live):
            live = live[at[live] + own[live] < end_of_item[live]]
            live = live[ranks[begins[live] + own[live]] == local[at[live] + own[live]]]
            own[live] += 1
        longer = own > length[left]
        length[left[longer]], source[left[longer]] = own[longer], at[longer]
    best = np.lexsort((begin, -length, r))
    head = best[np.concatenate([[True], r[best][1:] != r[best][:-1]])]
    longest[r[head]] = np.stack([length[head], begin[head], items.item[source[head]]], axis=1)
    return hit, found, longest


SCHEMA = "row long, doc_id long, n_words long, hit array<int>, items array<long>, longest long, longest_at long, longest_item long"


def matches(docs: DataFrame, items: Items) -> DataFrame:
    """Per row of docs (row, doc_id, text): n_words, the positions of hit words, the items, and the longest match with its place and item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in scan_words(batch.column(2), "alnum"):
                hit, found, longest = match_shard(w, items)
                first = w.first
                n = np.diff(first)
                at = np.flatnonzero(hit)
                hits = pa.ListArray.from_arrays(np.searchsorted(at, first).astype(np.int32), pa.array((at - first[w.row[at]]).astype(np.int32)))
                some = longest[:, 0] > 0
                place = longest[:, 1] - np.where(some, first[:-1], 0)
                ids = [items.ids[x] if y else None for x, y in zip(longest[:, 2].tolist(), some.tolist(), strict=True)]
                named = [sorted({items.ids[i] for i in s} - {None}) for s in found]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(w.lo, w.n_rows), batch.column(1).slice(w.lo, w.n_rows), pa.array(n, pa.int64()), hits, pa.array(named, pa.list_(pa.int64())), pa.array(longest[:, 0]), pa.array(np.where(some, place, -1)), pa.array(ids, pa.int64())], names=[f.split()[0] for f in SCHEMA.split(", ")])

    return docs.select("row", "doc_id", "text").mapInArrow(run, SCHEMA)


def item_blocks(benchmark: DataFrame, window: int, limit: int = ITEM_BLOCK_BYTES) -> Iterator[Items]:
    """Whole items in blocks of about `limit` bytes, fetched one after another."""
    ids, texts, held = [], [], 0
    for x in benchmark.select(F.col("item_id").cast("long"), F.coalesce("text", F.lit(""))).toLocalIterator():
        ids.append(x[0])
        texts.append(x[1])
        held += len(x[1])
        if held > limit:
            yield Items.of(ids, texts, window)
            ids, texts, held = [], [], 0
    if ids:
        yield Items.of(ids, texts, window)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, limit: int = ITEM_BLOCK_BYTES) -> DataFrame:
    """One row per document with n_words, n_hit, items, longest match; over several blocks the words hit are united."""
    if window > DEPTH:
        raise ValueError(f"suffixes are sorted by {DEPTH} words")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks = item_blocks(benchmark, window, limit)
    block, later = next(blocks, None) or Items.of([], [], window), next(blocks, None)
    if later is None:
        return matches(rows, block).drop("row").withColumn("n_hit", F.size("hit").cast("long"))
    # the same pass for each block over rows whose numbers are written down, and blocks are united by row
    rows = materialize(rows)
    out = materialize(matches(rows, block))
    while later is not None:
        out, later = out.unionByName(materialize(matches(rows, later))), next(blocks, None)
    best = F.max_by(F.struct("longest", "longest_at", "longest_item"), F.col("longest"))
    out = out.groupBy("row", "doc_id", "n_words").agg(F.array_distinct(F.flatten(F.collect_list("hit"))).alias("hit"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), best.alias("b"))
    return out.select("doc_id", "n_words", "hit", "items", "b.*", F.size("hit").cast("long").alias("n_hit"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without those that hold a window of a test item, in one pass without a shuffle of the texts.

    For a benchmark of several blocks, one filtering pass for each block, the rows between written down.
    """
    schema = docs.schema
    at = schema.fieldNames().index("text")
    for k, items in enumerate(item_blocks(benchmark, window)):
        docs = materialize(docs) if k else docs

        def run(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for w in scan_words(batch.column(at), "alnum"):
                    hit, _, _ = match_shard(w, items)
                    clean[w.lo + w.row[hit]] = False
                yield batch.filter(pa.array(clean))
            trim()

        docs = docs.mapInArrow(run, schema)
    return docs


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join(F.sort_array(F.transform("items", lambda i: i.cast("string"))), ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_WORDS = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
OP5_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT item_id, least(len(w), {WINDOW}) AS k, unnest(list_transform(range(1, len(w) - least(len(w), {WINDOW}) + 2), lambda i: array_to_string(w[i : i + least(len(w), {WINDOW}) - 1], ' '))) AS g FROM b WHERE len(w) > 0),
sizes AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS p, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS g FROM d, sizes WHERE len(w) >= k),
m AS (SELECT doc_id, dw.k, p, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.g = bw.g),
h AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM m) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)
"""

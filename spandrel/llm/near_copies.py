"""Near copies: the interface of SimHash near-dedup for a similarity instead of a number of bits (the pipeline's stage).

Documents are linked when their sets of five-word shingles have a Jaccard similarity of 0.8 or more.  SimHash comes
first: fingerprints of the shingles and operator 8's vantage-point trees give candidates within MAX_BITS.  A Hamming
radius that covers 0.8 is about 16 of 64 bits; no triangle bound prunes that, so trees would compare all pairs.  What the
radius doesn't cover comes from MinHash: BANDS keys of ROWS minima each; two sets of similarity s share a key with
probability 1 - (1 - s^ROWS)^BANDS, which is 0.9998 at 0.8 and 1 - 1e-7 at 0.9.  Every candidate is verified on the
whole sets (32 bits of each shingle).

Documents with equal shingles, repeats included, are one entry.  In each bucket the members are compared with one of
them, the one that shares most keys with others (the original of edited copies); in buckets of several components, then
with six others.  What is then still in buckets of several components is joined by a prefix filter, which loses no pair of that similarity:
shingles in order of rarity, the rarest ninth of the smaller set against the rarest fifth of the larger one.  Copies that
are unlike each other have rarest shingles of their own, so a large group of them makes no pairs; nothing is capped.

Defined results: fewer words than a shingle give one shingle of all words; null, empty and blank texts are copies of
each other; null doc_ids count as the smallest; rows that share the kept id all stay; other columns are passed on,
whatever their names; a very long text is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, gram_hash, materialize, mix64, scan_words, segment_sum, trim
from .components import connected_components
from .simhash import fingerprints_of
from .simhash import near_links as fingerprint_links

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 16, 4
#: Bits by which fingerprints of the first candidates differ at most.
MAX_BITS = 2
#: Rounds in which buckets are compared with a few members, before the rest meets by the prefix filter.
STARS = 2
_SEEDS = mix64(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64))


def shingles_of(w, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of a slice, row after row, and the first of each row (and their number at the end)."""
    g = gram_hash(w.hash, shingle)
    whole = w.row[: len(g)] == w.row[shingle - 1 :][: len(g)]
    h, row = g[whole], w.row[: len(g)][whole]
    first = w.first
    n = np.diff(first)
    short = np.flatnonzero((n > 0) & (n < shingle))
    if len(short):
        more = np.array([gram_hash(w.hash[first[i] : first[i + 1]], int(n[i]))[0] for i in short], np.uint64)
        row = np.concatenate([row, short])
        order = np.argsort(row, kind="stable")
        h, row = np.concatenate([h, more])[order], row[order]
    return h, np.searchsorted(row, np.arange(w.n_rows + 1))


def entries_of(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of each row's shingles, repeats included, in any order."""
    total = segment_sum(mix64(h ^ np.uint64(0xA0761D6478BD642F)), first)
    return mix64(total + np.diff(first).astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB)).view(np.int64)


def bands_of(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """BANDS keys of each row that has shingles."""
    heads = first[:-1][np.diff(first) > 0]
    out = np.zeros((len(heads), BANDS), np.uint64)
    if len(heads):
        for k in range(BANDS * ROWS):
            x = (h ^ _SEEDS[2 * k]) * (_SEEDS[2 * k + 1] | np.uint64(1))
            low = np.minimum.reduceat(x ^ (x >> np.uint64(32)), heads)
            out[:, k // ROWS] = mix64(out[:, k // ROWS] + low + np.uint64(k))
    return out.view(np.int64)


def _scan(docs: DataFrame, shingle: int, make, schema: str, *columns: str, prints: bool = False) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in scan_words(batch.column(batch.num_columns - 1)):
                h, first = shingles_of(w, shingle)
                own = [batch.column(k).slice(w.lo, w.n_rows) for k in range(batch.num_columns - 1)]
                fp = [pa.array(fingerprints_of(w, shingle).view(np.int64))] if prints else []
                yield pa.RecordBatch.from_arrays([*own, pa.array(entries_of(h, first)), *fp, make(h, first)], names=names)
        trim()

    text = F.col("text").cast("string").alias("text")
    return docs.select(*[F.col(c).cast("long").alias(c) for c in columns], text).mapInArrow(run, schema)


def sketches(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, e, fp, bands): the entry of each document, its fingerprint and its keys."""

    def make(h: np.ndarray, first: np.ndarray) -> pa.Array:
        ends = np.concatenate([[0], np.cumsum(np.diff(first) > 0)]) * BANDS
        return pa.ListArray.from_arrays(ends.astype(np.int32), pa.array(bands_of(h, first).ravel()))

    return _scan(docs, shingle, make, "doc_id long, e long, fp long, bands array<long>", "doc_id", prints=True)


def shingle_sets(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(e, s): the distinct shingles of each document, 32 bits of each."""

    def make(h: np.ndarray, first: np.ndarray) -> pa.Array:
        row = np.repeat(np.arange(len(first) - 1, dtype=np.uint64), np.diff(first))
        own = np.unique(row << np.uint64(32) | h >> np.uint64(32))
        ends = np.searchsorted(own >> np.uint64(32), np.arange(len(first), dtype=np.uint64)).astype(np.int32)
        return pa.ListArray.from_arrays(ends, pa.array(own.astype(np.uint32).view(np.int32)))

    return _scan(docs, shingle, make, "e long, s array<int>")


def prefix_pairs(sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Pairs (e, o) of sets (e, root, s) of different roots among which are all of `similarity` or more."""
    tokens = sets.select("e", "root", F.size("s").alias("n"), F.explode("s").alias("w"))
    often = tokens.groupBy("w").agg(F.count("*").alias("c")).where("c > 1")
    lists = tokens.join(often, "w").groupBy("e", "root", "n").agg(F.sort_array(F.collect_list(F.struct("c", "w"))).alias("l"))  # bounded by the text
    # places in order of rarity; shingles of one set alone come first and can't match
    at = lists.select("e", "root", "n", F.posexplode("l").alias("k", "x"), (F.col("n") - F.size("l")).alias("alone"))
    place, needs = F.col("alone") + F.col("k"), lambda share: F.ceil(F.col("n") * F.lit(share) - 1e-9)
    at = at.select("e", "root", "n", F.col("x.w").alias("w"), (F.col("n") - place).alias("left"), (place <= F.col("n") - needs(2 * similarity / (1 + similarity))).alias("index"), (place <= F.col("n") - needs(similarity)).alias("probe"))
    at = at.where("probe")
    # a shingle's commonest root meets the others only, so a large component makes no pairs of its own
    roots = at.groupBy("w", "root").agg(F.count("*").alias("c")).groupBy("w").agg(F.max(F.struct("c", "root"))["root"].alias("top"), F.count("*").alias("roots"))
    at = at.join(roots.where("roots > 1").drop("roots"), "w").withColumn("most", F.col("root") == F.col("top")).drop("top")
    index, probe = at.where("index"), at.select("w", F.col("e").alias("o"), F.col("root").alias("o_root"), F.col("n").alias("m"), F.col("most").alias("o_most"), F.col("left").alias("o_left"))
    # what two sets share is at most what both have from their first common shingle on
    enough = F.least("left", "o_left") >= (F.col("n") + F.col("m")) * (similarity / (1 + similarity)) - 1e-9
    fits = (F.col("root") != F.col("o_root")) & enough & (F.struct("n", "e") < F.struct(F.col("m").alias("n"), F.col("o").alias("e"))) & (F.col("n") >= F.col("m") * similarity - 1e-9)
    met = [i.alias("i").join(p.alias("p"), (F.col("i.w") == F.col("p.w")) & fits).select("e", "o") for i, p in ((index.where("not most"), probe), (index.where("most"), probe.where("not o_most")))]
    return met[0].unionByName(met[1]).distinct()


def fingerprint_pairs(entries: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Pairs (e, o) of entries whose fingerprints lie near each other: with the first entry of a fingerprint, and of first entries."""
    firsts = materialize(entries.groupBy("fp").agg(F.min("e").alias("o")))
    same = entries.join(firsts, "fp").where("e != o").select("e", "o")
    name = lambda c, e: firsts.select(F.col("fp").alias(c), F.col("o").alias(e))
    near = fingerprint_links(firsts.select("fp"), max_bits).join(name("u", "e"), "u").join(name("v", "o"), "v").select("e", "o")
    return materialize(same.unionByName(near).distinct())


def near_links(docs: DataFrame, entries: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """Links (u, v) between entries of `similarity` or more, enough to span every component."""
    keys = entries.select("e", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    buckets = materialize(keys.join(shared, "key"))
    wanted = materialize(buckets.groupBy("e").agg(F.sum("n").alias("degree")))
    close = fingerprint_pairs(entries)
    used = wanted.select("e").unionByName(close.select("e")).unionByName(close.select(F.col("o").alias("e"))).distinct()
    sets = materialize(shingle_sets(docs, shingle).join(used, "e", "left_semi").groupBy("e").agg(F.first("s").alias("s")))
    buckets = materialize(buckets.join(wanted, "e").select("key", "e", "degree"))

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = pairs.select(F.least("e", "o").alias("u"), F.greatest("e", "o").alias("v")).distinct()
        both = pairs.join(sets.select(F.col("e").alias("u"), F.col("s").alias("a")), "u").join(sets.select(F.col("e").alias("v"), F.col("s").alias("b")), "v")
        common = F.size(F.array_intersect("a", "b"))
        return materialize(both.where(common / (F.size("a") + F.size("b") - common) >= similarity).select("u", "v"))

    links = verified(close)
    for turn in range(STARS + 1):
        members = buckets.withColumn("root", F.col("e"))
        if turn:
            roots = connected_components(links).withColumnRenamed("root", "r")
            members = buckets.join(roots, buckets["e"] == roots["u"], "left").select("key", "e", "degree", F.coalesce("r", "e").alias("root"))
            several = members.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a != b").select("key")
            members = materialize(members.join(several, "key"))
            if members.isEmpty():
                break
        if turn < STARS:
            first = lambda order, *by: F.min(F.struct(order.cast("long").alias("order"), F.xxhash64("e", F.lit(turn), *by).alias("then"), "e", "root"))
            some = [first(F.lit(0), "key", F.lit(k)) for k in range(6)] if turn else [first(-F.col("degree"))]
            centre = members.groupBy("key").agg(F.array(*some).alias("x")).select("key", F.explode(F.array_distinct("x")).alias("x"))
            centre = centre.select("key", F.col("x.e").alias("o"), F.col("x.root").alias("o_root"))
            pairs = members.join(centre, "key").where("root != o_root").select("e", "o")
        else:
            rest = materialize(members.groupBy("e").agg(F.first("root").alias("root")))
            pairs = prefix_pairs(sets.join(rest, "e"), similarity)
        links = links.unionByName(verified(pairs))
    return links


def near_components(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, component_id): documents linked, over any number of steps, by shingle sets of `similarity` or more."""
    found = materialize(sketches(docs, shingle))
    entries = materialize(found.groupBy("e").agg(F.min(F.struct("doc_id")).alias("low"), F.first("fp").alias("fp"), F.first("bands").alias("bands")))
    roots = materialize(connected_components(near_links(docs, entries, shingle, similarity)))
    named = entries.join(roots, entries["e"] == roots["u"], "left").select("e", "low", F.coalesce("root", "e").alias("root"))
    lowest = named.groupBy("root").agg(F.min("low")["doc_id"].alias("component_id"))
    named = named.join(lowest, "root").select("e", "component_id")
    return found.select("doc_id", "e").join(named, "e").select("doc_id", "component_id")


def keep_first(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The documents without those of a component that has a smaller doc_id (rows that share the kept id all stay)."""
    name = fresh(docs, "__lost")
    lost = near_components(docs, shingle, similarity).where("not (doc_id <=> component_id)").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(lost, F.col("doc_id") == F.col(name), "left_anti")

"""SimHash near-dedup: exact pairs within a Hamming distance by vantage-point trees.

Fingerprints: bit i is 1 if it is set in over half the XXH64 values (seed 42) of a document's word shingles, repeats
included.  Equal fingerprints are one entry from then on.  A top tree of vantage points, from a small sample of the
entries, deals them into shards by Hamming distance; every entry is a member of one shard and a query to the later shards
that its ball of radius `max_bits` overlaps (triangle bounds), so every pair meets in the later of its two shards.  In a
shard, a local vantage-point tree prunes likewise.  Links leave a shard as a spanning forest, which holds its components
but never all pairs of a group.

Cost: of random fingerprints nearly half lie within two bits of a median distance, so queries grow by about 1.4 for each
doubling of the shards.  Shards are therefore large (SHARD_ENTRIES), and the tree inside prunes; a query is 17 bytes.

Defined results: a null, empty or blank text has fingerprint zero and links like any other; fewer words than a shingle
give one shingle of all words; null doc_ids count as the smallest (null is then their component's name); repeated rows
come out once for each row; a very long text is hashed as a slice of its own, 65,536 shingles' bits at a time; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize, scan_words, table
from .components import connected_components

SEED = 42
#: Fingerprints that one shard shall hold, shards that there shall be for the sake of parallel work where these have
#: LEAST_ENTRIES each, and sampled entries for each shard from which the top tree is made.
SHARD_ENTRIES, LEAST_SHARDS, LEAST_ENTRIES = 250_000, 16, 4_000
SAMPLE_PER_SHARD = 32
LEAF = 48


def fingerprints_of(w, shingle: int) -> np.ndarray:
    """Fingerprints of the rows of one slice of words."""
    first = w.first
    n = np.diff(first)
    joined, start, end = w.data, w.start, w.end
    spaced = len(start) == 0 or bool((start[1:] - end[:-1])[w.row[1:] == w.row[:-1]].max(initial=1) == 1) and bool((joined[end[:-1]][w.row[1:] == w.row[:-1]] == 32).all())
    if not spaced:  # single spaces between the words
        length = end - start
        new_start = np.zeros(len(start), np.int64)
        np.cumsum(length[:-1] + 1, out=new_start[1:])
        joined = np.full(int(length.sum() + len(length)), 32, np.uint8)
        inside = np.repeat(start - new_start, length)
        at = np.arange(int(length.sum())) + np.repeat(np.arange(len(length)), length)
        joined[at] = w.data[at + inside]
        start, end = new_start, new_start + length
    blob = joined.tobytes()
    # a shingle for each word that has enough words after it in its row, or the first of a short row
    k = np.arange(len(start)) - first[w.row]
    begins = np.flatnonzero((k <= n[w.row] - shingle) | (k == 0))
    last = np.minimum(begins + shingle, first[w.row[begins] + 1]) - 1
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(blob[a:b], SEED) for a, b in zip(start[begins].tolist(), end[last].tolist(), strict=True)), np.uint64, len(begins))
    out = np.zeros(w.n_rows, np.uint64)
    bound = np.searchsorted(w.row[begins], np.arange(w.n_rows + 1))
    some = np.flatnonzero(np.diff(bound))
    if len(some):
        counts = np.zeros((len(some), 64), np.int64)
        step = 1 << 16
        group = np.searchsorted(some, w.row[begins])
        for a in range(0, len(h), step):  # bits of a bounded number of hashes at a time
            bits = np.unpackbits(h[a : a + step].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            g = group[a : a + step]
            heads = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
            counts[g[heads]] += np.add.reduceat(bits, heads, axis=0, dtype=np.int64)
        set_ = counts * 2 > np.diff(bound)[some][:, None]
        out[some] = np.packbits(set_, axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp) with fp the 64 bits as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in scan_words(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(w.lo, w.n_rows), pa.array(fingerprints_of(w, shingle).view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def hamming(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def split_radius(d: np.ndarray) -> int:
    """The radius that parts distances most evenly with some on both sides; distances of distinct points to one of them."""
    inner = np.cumsum(np.bincount(d))[:-1]
    return int(np.argmin(np.abs(2 * inner - len(d))))


def build_top(sample: np.ndarray, shards: int) -> list[tuple[int, int, int, int]]:
    """Nodes (vantage point, radius, inner, outer); a child below 0 is the shard -1 - child.  Inner: distance <= radius."""
    nodes: list = []
    leaves = 0

    def grow(points: np.ndarray, shards: int) -> int:
        nonlocal leaves
        if shards > 1 and len(points) > 1:
            vantage = points[0]
            d = hamming(points, vantage)
            radius = split_radius(d)
            inner = d <= radius
            here = len(nodes)
            nodes.append(None)
            near = min(max(round(shards * inner.mean()), 1), shards - 1)
            nodes[here] = (int(vantage), radius, grow(points[inner], near), grow(points[~inner], shards - near))
            return here
        leaves += 1
        return -leaves

    root = grow(np.unique(sample), shards)
    return nodes if root >= 0 else []


def route(fp: np.ndarray, nodes: list, slack: int) -> tuple[np.ndarray, np.ndarray]:
    """(index, shard) of every shard that the ball of radius `slack` around each entry overlaps; slack 0: its own shard."""
    if not nodes:
        return np.arange(len(fp)), np.zeros(len(fp), np.int64)
    out_i, out_s, todo = [], [], [(0, np.arange(len(fp)))]
    while todo:
        node, i = todo.pop()
        if not len(i):
            continue
        if node < 0:
            out_i.append(i)
            out_s.append(np.full(len(i), -1 - node))
            continue
        vantage, radius, inner, outer = nodes[node]
        d = hamming(fp[i], np.uint64(vantage)).astype(np.int64)
        todo += [(inner, i[d - slack <= radius]), (outer, i[d + slack > radius])]
    return np.concatenate(out_i), np.concatenate(out_s)


class Forest:
    """Union by the smaller index, many edges at a time."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, x: np.ndarray) -> np.ndarray:
        while True:
            y = self.up[self.up[x]]
            if (y == self.up[x]).all():
                return y
            self.up[x] = y

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.root(a), self.root(b)
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(self.up, np.maximum(ra, rb), np.minimum(ra, rb))


def link_shard(fp: np.ndarray, members: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (entry, root) of the links between members and all entries of a shard; fp distinct."""
    forest = Forest(len(fp))
    todo = [(members, np.arange(len(fp)))]
    while todo:
        m, q = todo.pop()
        if not len(m) or not len(q):
            continue
        if len(m) > LEAF:
            vantage = fp[m[0]]
            dm, dq = hamming(fp[m], vantage).astype(np.int16), hamming(fp[q], vantage).astype(np.int16)
            radius = split_radius(dm)
            inner = dm <= radius
            todo += [(m[inner], q[dq - max_bits <= radius]), (m[~inner], q[dq + max_bits > radius])]
            continue
        for a in range(0, len(q), max(1, 2_000_000 // len(m))):
            part = q[a : a + max(1, 2_000_000 // len(m))]
            i, j = np.nonzero(hamming(fp[part][:, None], fp[m][None, :]) <= max_bits)
            forest.link(part[i], m[j])
    root = forest.root(np.arange(len(fp)))
    moved = np.flatnonzero(root != np.arange(len(fp)))
    return moved, root[moved]


def near_links(entries: DataFrame, max_bits: int = 2) -> DataFrame:
    """Links (u, v) between distinct fingerprints `fp`, enough to span every component."""
    n = entries.count()
    shards = max(1, -(-n // SHARD_ENTRIES), min(LEAST_SHARDS, n // LEAST_ENTRIES))
    share = min(1.0, (64 + SAMPLE_PER_SHARD * shards) / max(n, 1))
    picked = entries.select("fp").sample(share, seed=1).collect()  # places the shards' bounds only; any sample gives the same links
    sample = np.array([x[0] for x in picked], np.int64).view(np.uint64)
    nodes = build_top(sample, shards)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            own = np.zeros(len(fp), np.int64)
            i, s = route(fp, nodes, 0)
            own[i] = s
            i, s = route(fp, nodes, max_bits)
            i, s = i[s >= own[i]], s[s >= own[i]]
            yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(fp[i].view(np.int64)), pa.array(own[i] == s)], names=["shard", "fp", "member"])

    def link(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("fp")
        fp = group["fp"].to_numpy(np.int64).view(np.uint64)
        a, b = link_shard(fp, np.flatnonzero(group["member"].to_numpy(bool)), max_bits)
        return pd.DataFrame({"u": fp[a].view(np.int64), "v": fp[b].view(np.int64)})

    dealt = entries.select("fp").mapInArrow(deal, "shard long, fp long, member boolean")
    return dealt.groupBy("shard").applyInPandas(link, "u long, v long")


def near_components(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """(doc_id, fp, component_id): documents linked, over any number of steps, by fingerprints within `max_bits` bits."""
    prints = materialize(fingerprints(docs, shingle))
    entries = materialize(prints.groupBy("fp").agg(F.min(F.struct(F.col("doc_id"))).alias("low")))
    roots = materialize(connected_components(near_links(entries, max_bits)))
    named = entries.join(roots, entries["fp"] == roots["u"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = named.groupBy("root").agg(F.min("low")["doc_id"].alias("component_id"))
    named = named.join(lowest, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """The documents without those of a component that has a smaller doc_id (rows that share the kept id all stay)."""
    name = fresh(docs, "__lost")
    lost = near_components(docs, shingle, max_bits).where("not (doc_id <=> component_id)").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(lost, F.col("doc_id") == F.col(name), "left_anti")


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

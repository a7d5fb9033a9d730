"""LM scoring: a causal self-attention model in numpy over subword ids, and a word unigram as its base.

Words are cut into the ids of a public byte-level BPE (never trained here).  From all training documents come the
counts of words and ids and, for each id, a sketch of its neighbours.  Ids are clustered by their sketches into
GROUPS x EACH classes, those that begin a word (and the end of the text) apart from those that go on with it, and the
attention model predicts group and class of the next id from the ids before it; an id has its share of the class in
all training documents.  A word that the training documents hold is taken whole, by its share of its first id's class
(counts less DISCOUNT); the mass so left goes to new words, which are spelt id by id:

    P(known word | before) = P(class of its first id | before, a word begins) * (count - DISCOUNT) / uses of the class
    P(new word | before)   = P(class of its first id | before, a word begins) * mass left in the class * its ids one after another and a beginning

The probabilities of all words and the end add up to one at most.  The word counts, and with them the score, take in
every training document, however many there are.

Model: id embeddings (singular vectors of the sketches of all training documents) and trained place embeddings, one
causal attention over a window, a hidden layer, and a softmax over groups and one over the classes of a group.
Training: every training document is read once, none before or more often than others.  A hash of id and text deals the
documents into shards of about SHARD_BYTES, each for one of ROUNDS rounds; in a round every shard takes Adam steps over
its windows from the round's common weights, and the mean of the shards' weights and moments, by their targets, is the
next round's beginning.  Nothing depends on how rows are dealt to partitions, but for the rounding of sums.

Scoring: a text and its end are cut into windows of CONTEXT ids that were scored before and STEP that are scored now,
so each id is scored once at most (those inside a known word need no score), in batches of masked windows.

Placement: a word with at least one in HEAVY of all training tokens (there are at most HEAVY of them, the bound of the
broadcast) is looked up in place; the others are counted for each document and joined with the vocabulary.  Both give
the same numbers.

Defined results: a null or empty text is one end; a null doc_id has the checksum of the empty text; repeated rows are
scored one by one, and count each in training; without training documents the base is uniform and the model untrained;
a very long text is one slice and one task's work, its windows go in batches; other columns, whatever their names, are
ignored.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import parse_ranks, public_vocabulary
from .common import Words, materialize, mix64, scan_words, table, trim
from .quality_classifier import checksum

CONTEXT, STEP = 8, 24
WIDTH, HIDDEN, GROUPS, EACH = 16, 32, 16, 16
CLASSES = GROUPS * EACH
#: The first groups hold the ids that begin a word; the last class of these is the end's.
BEGIN_GROUPS = 8
BEGINNERS = BEGIN_GROUPS * EACH
BINS = 32
#: Bytes of the training documents of a shard, windows of a step, and the rate at the beginning; it falls to a fifth.
SHARD_BYTES, STEP_WINDOWS, RATE = 2_000_000, 96, 0.01
ROUNDS = 6
BATCH = 192
HEAVY = 1 << 20
DISCOUNT = 0.6
END_HASH = np.uint64(0x51ED270B9F3C1D05)
#: Words whose ids a worker remembers; when full, the memory starts anew.
MEMORY = 300_000
#: Bytes of text that are worked on at a time; a longer document is a slice of its own.
SLICE_BYTES = 2_500_000


# ---------------------------------------------------------------- subword ids


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values in order of their first place, that place, and where each entry is among them."""
    found = pa.array(h).dictionary_encode()
    of = found.indices.to_numpy()
    values = found.dictionary.to_numpy()
    at = np.empty(len(values), np.int64)
    at[of[::-1]] = np.arange(len(h))[::-1]
    return values, at, of


class Subwords:
    """Ids of words with a space before them; the last id of the file plus one is the end."""

    def __init__(self, file: str, pattern: str):
        import tiktoken

        with open(file, "rb") as f:
            ranks = parse_ranks(f.read())
        self.encoding = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.end = max(ranks.values()) + 1
        self.begins = np.zeros(self.end + 1, bool)
        self.begins[[i for b, i in ranks.items() if b[:1] == b" "]] = True
        self.known: dict[int, bytes] = {}

    def entries(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct word hashes, each word's place there, and the distinct words' ids: one after another, with the bounds."""
        values, at, of = distinct(w.hash)
        if len(self.known) > MEMORY:
            self.known.clear()
        known, hashes = self.known, values.tolist()
        found = list(map(known.get, hashes))
        for i in [i for i, x in enumerate(found) if x is None]:
            word = w.data[w.start[at[i]] : w.end[at[i]]].tobytes().decode("utf-8", "replace")
            found[i] = known[hashes[i]] = array("i", self.encoding.encode_ordinary(" " + word)).tobytes()
        bounds = np.zeros(len(found) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) // 4, out=bounds[1:])
        return values, of, np.frombuffer(b"".join(found), np.int32), bounds

    def ids(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all words one after another, where each word begins (and the end); distinct hashes with each word's place there."""
        values, of, flat, begin = self.entries(w)
        n = np.diff(begin).astype(np.int32)[of]
        end = np.zeros(len(of) + 1, np.int64)
        np.cumsum(n, out=end[1:])
        place = np.repeat((begin[of] - end[:-1]).astype(np.int32), n)
        place += np.arange(len(place), dtype=np.int32)
        return flat[place], end, values, of


_subwords: dict[str, Subwords] = {}


def subwords(file: str, pattern: str) -> Subwords:
    if file not in _subwords:
        _subwords[file] = Subwords(file, pattern)
    return _subwords[file]


def sequences(s: Subwords, w: Words) -> tuple[np.ndarray, np.ndarray]:
    ids, bounds, _, _ = s.ids(w)
    return with_ends(ids, bounds[w.first], s.end)


def with_ends(ids: np.ndarray, first: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row as end, ids, end: what is read and what is to be predicted are neighbours."""
    n = np.diff(first)
    start = np.concatenate([[0], np.cumsum(n + 2)])
    out = np.full(int(start[-1]), end, np.int32)
    out[np.repeat(start[:-1] + 1 - first[:-1], n) + np.arange(len(ids))] = ids
    return out, start


# ---------------------------------------------------------------- model


def _exp(x: np.ndarray) -> np.ndarray:
    """In place; exponents are small enough to need no shift."""
    np.clip(x, -60, 60, out=x)
    return np.exp(x, out=x)


def row_sums(x: np.ndarray) -> np.ndarray:
    """Sums over the last axis, as a product, which is faster than a reduction of short rows."""
    return x @ np.ones(x.shape[-1], x.dtype)


def by_group(g: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order by group, and (group, from, to) in it of each that occurs."""
    order = np.argsort(g.astype(np.uint8), kind="stable")
    bounds = np.searchsorted(g[order], np.arange(GROUPS + 1)).tolist()
    return order, [(k, bounds[k], bounds[k + 1]) for k in range(GROUPS) if bounds[k + 1] > bounds[k]]


_OPEN = (np.arange(CONTEXT + STEP)[None, :] <= CONTEXT + np.arange(STEP)[:, None]).astype(np.float32)


@dataclass
class Attention:
    """Weights, the fixed embeddings, the class of every id, and log10 of its share in its class."""

    weights: dict[str, np.ndarray]
    emb: np.ndarray
    classes: np.ndarray
    share: np.ndarray

    def forward(self, ids: np.ndarray, there: np.ndarray) -> dict[str, np.ndarray]:
        """ids, there: windows x (CONTEXT + STEP) inputs and which of them exist."""
        p = self.weights
        x = self.emb.take(ids, axis=0).astype(p["pos"].dtype, copy=False)
        x += p["pos"]
        kv = (x.reshape(-1, WIDTH) @ np.concatenate([p["k"], p["v"]], axis=1)).reshape(*ids.shape, 2 * WIDTH)
        xq = np.ascontiguousarray(x[:, CONTEXT:]).reshape(-1, WIDTH)
        q = (xq @ p["q"]).reshape(len(ids), STEP, WIDTH)
        a = _exp(q @ np.ascontiguousarray(kv[:, :, :WIDTH].transpose(0, 2, 1)))
        a *= _OPEN
        if not there.all():
            a *= there.astype(np.float32)[:, None, :]
        a /= row_sums(a)[:, :, None]
        o = (a @ kv[:, :, WIDTH:]).reshape(-1, WIDTH)
        return {"x": x, "xq": xq, "q": q, "k": kv[:, :, :WIDTH], "v": kv[:, :, WIDTH:], "a": a, "o": o}

    def hidden(self, f: dict[str, np.ndarray], use: np.ndarray) -> np.ndarray:
        """The hidden layer at some of the places, after `forward`."""
        p = self.weights
        z = f["xq"].take(use, axis=0) @ p["w1"][:WIDTH]
        z += f["o"].take(use, axis=0) @ p["w1"][WIDTH:]
        z += p["b1"]
        return np.maximum(z, 0, out=z)

    def heads(self, z: np.ndarray, groups: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """Both softmaxes beside each other, not yet divided by their sums, for rows in order of their groups; and the weights by group."""
        p = self.weights
        w = np.concatenate([np.broadcast_to(p["w2"], (GROUPS, HIDDEN, GROUPS)), p["u"]], axis=2)
        bias = np.concatenate([np.broadcast_to(p["b2"], (GROUPS, GROUPS)), p["c"]], axis=1)
        e = np.empty((len(z), GROUPS + EACH), z.dtype)
        for k, a, b in groups:
            np.matmul(z[a:b], w[k], out=e[a:b])
            e[a:b] += bias[k]
        return _exp(e), w

    def log10(self, ids: np.ndarray, there: np.ndarray, target: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 probabilities of each wanted target's class and of any class that begins a word or ends the text, in order."""
        use = np.flatnonzero(wanted.ravel())
        y = self.classes.take(target.ravel().take(use))
        order, groups = by_group(y // EACH)
        e, _ = self.heads(self.hidden(self.forward(ids, there), use.take(order)), groups)
        y, rows = y.take(order), np.arange(len(y))
        total = row_sums(e[:, :GROUPS])
        own, begin = np.empty((2, len(y)), np.float32)
        own[order] = e[rows, y // EACH] / total * e[rows, GROUPS + y % EACH] / row_sums(e[:, GROUPS:])
        begin[order] = row_sums(e[:, :BEGIN_GROUPS]) / total
        return np.log10(np.maximum(own, 1e-37)), np.log10(np.maximum(begin, 1e-37))

    def gradients(self, ids: np.ndarray, there: np.ndarray, target: np.ndarray, wanted: np.ndarray) -> tuple[dict[str, np.ndarray], float, int]:
        """Of the summed cross entropy over the wanted targets, that sum, and their number."""
        p, f = self.weights, self.forward(ids, there)
        use = np.flatnonzero(wanted.ravel())
        y = self.classes.take(target.ravel().take(use))
        order, groups = by_group(y // EACH)
        use, y, rows = use.take(order), y.take(order), np.arange(len(y))
        z = self.hidden(f, use)
        d, w = self.heads(z, groups)
        d[:, :GROUPS] /= row_sums(d[:, :GROUPS])[:, None]
        d[:, GROUPS:] /= row_sums(d[:, GROUPS:])[:, None]
        of, member = y // EACH, GROUPS + y % EACH
        loss = -float(np.log(np.maximum(d[rows, of], 1e-30)).sum()) - float(np.log(np.maximum(d[rows, member], 1e-30)).sum())
        d[rows, of] -= 1
        d[rows, member] -= 1
        out = {"w2": np.zeros_like(p["w2"]), "b2": np.zeros_like(p["b2"]), "u": np.zeros_like(p["u"]), "c": np.zeros_like(p["c"])}
        dz_use, ones = np.empty_like(z), np.ones(max(len(y), ids.size), z.dtype)
        for k, a, b in groups:
            g, s = z[a:b].T @ d[a:b], ones[: b - a] @ d[a:b]
            out["w2"] += g[:, :GROUPS]
            out["u"][k] = g[:, GROUPS:]
            out["b2"] += s[:GROUPS]
            out["c"][k] = s[GROUPS:]
            np.matmul(d[a:b], w[k].T, out=dz_use[a:b])
        dz_use *= np.sign(z)
        dz = np.zeros((len(f["o"]), HIDDEN), z.dtype)
        dz[use] = dz_use
        out["w1"], out["b1"] = np.concatenate([f["xq"], f["o"]], axis=1).T @ dz, ones[: len(dz)] @ dz
        do = dz @ p["w1"][WIDTH:].T
        mean = np.einsum("ij,ij->i", do, f["o"]).reshape(len(ids), STEP, 1)
        do = do.reshape(len(ids), STEP, WIDTH)
        ds = do @ np.ascontiguousarray(f["v"].transpose(0, 2, 1))
        ds -= mean
        ds *= f["a"]
        dq, dk, dv = ds @ f["k"], ds.transpose(0, 2, 1) @ f["q"], f["a"].transpose(0, 2, 1) @ do
        flat = lambda t: t.reshape(-1, WIDTH)
        over = lambda t, n: (ones[: len(ids)] @ t.reshape(len(ids), -1)).reshape(-1, n)
        dkv = flat(f["x"]).T @ np.concatenate([flat(dk), flat(dv)], axis=1)
        out["q"], out["k"], out["v"] = f["xq"].T @ flat(dq), dkv[:, :WIDTH], dkv[:, WIDTH:]
        out["pos"] = over(dk, WIDTH) @ p["k"].T + over(dv, WIDTH) @ p["v"].T
        out["pos"][CONTEXT:] += over(dq, WIDTH) @ p["q"].T + over(dz, HIDDEN) @ p["w1"][:WIDTH].T
        return out, loss, len(use)


def first_weights(rng: np.random.Generator, mass: np.ndarray) -> dict[str, np.ndarray]:
    """Random ones, with the classes' biases from their uses."""
    r = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[-2])).astype(np.float32)
    group = mass.reshape(GROUPS, EACH)
    return {"pos": r(CONTEXT + STEP, WIDTH) * 0.1, "q": r(WIDTH, WIDTH) * 0.5, "k": r(WIDTH, WIDTH) * 0.5, "v": r(WIDTH, WIDTH), "w1": r(2 * WIDTH, HIDDEN), "b1": np.zeros(HIDDEN, np.float32),
            "w2": r(HIDDEN, GROUPS) * 0.3, "b2": np.log(group.sum(axis=1) / mass.sum()).astype(np.float32), "u": r(GROUPS, HIDDEN, EACH) * 0.3, "c": np.log(group / group.sum(axis=1, keepdims=True)).astype(np.float32)}


class Adam:
    """Moments of all weights in one row each, `m` and `s` are views of them."""

    def __init__(self, weights: dict[str, np.ndarray], rate: float):
        self.rate, self.t = rate, 0
        self.names = list(weights)
        self.moments = np.zeros((2, sum(v.size for v in weights.values())), np.float32)
        parts = [np.split(x, np.cumsum([v.size for v in weights.values()])[:-1]) for x in self.moments]
        self.m, self.s = ({k: x.reshape(v.shape) for (k, v), x in zip(weights.items(), part, strict=True)} for part in parts)

    def copy(self) -> Adam:
        """Another one with the same moments (views don't survive pickling)."""
        out = Adam(self.m, self.rate)
        out.t = self.t
        for k in self.names:
            out.m[k][...], out.s[k][...] = self.m[k], self.s[k]
        return out

    def step(self, weights: dict[str, np.ndarray], g: dict[str, np.ndarray], n: int = 1) -> None:
        """g: sums over n targets."""
        self.t += 1
        flat = np.concatenate([g[k].ravel() for k in self.names])
        flat /= n
        m, s = self.moments
        m += 0.1 * (flat - m)
        flat *= flat
        s += 0.005 * (flat - s)
        by = np.sqrt(s / (1 - 0.995**self.t))
        by += 1e-8
        np.divide(m, by, out=by)
        by *= self.rate / (1 - 0.9**self.t)
        a = 0
        for k in self.names:
            v = weights[k]
            v -= by[a : a + v.size].reshape(v.shape)
            a += v.size


def cut_windows(start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, first scored place) of the windows of rows that begin at start; a row of m ids predicts m - 1."""
    n = -(-(np.diff(start) - 1) // STEP)
    row = np.repeat(np.arange(len(n)), n)
    k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return row, start[row] + k * STEP


def window_batch(ids: np.ndarray, start: np.ndarray, row: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Inputs, which of them exist, places of the targets and which of them exist, of windows."""
    place = at[:, None] + np.arange(-CONTEXT, STEP)
    lo, hi = start[row][:, None], start[row + 1][:, None] - 1  # the last id of a row is only predicted
    there = (place >= lo) & (place < hi)
    ahead = place[:, CONTEXT:] + 1
    wanted = ahead <= hi
    return ids.take(place, mode="clip"), there, np.minimum(ahead, len(ids) - 1), wanted


def predict(m: Attention, ids: np.ndarray, start: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every needed place of ids (not a row's first): log10 of its class and of a beginning at its place; zero elsewhere."""
    row, at = cut_windows(start)
    own, begin = np.zeros(len(ids)), np.zeros(len(ids))
    for a in range(0, len(row), BATCH):
        x, there, ahead, wanted = window_batch(ids, start, row[a : a + BATCH], at[a : a + BATCH])
        wanted &= need.take(ahead)
        p, q = m.log10(x, there, ids.take(ahead), wanted)
        places = ahead[wanted]
        own[places], begin[places] = p, q
    return own, begin


@dataclass
class Lexicon:
    """Words that are looked up in place: sorted hashes, log10 of (count + 0.1), log10 of the share in the class; and of each class log10 of its uses and of the mass left to new words."""

    hash: np.ndarray
    base: np.ndarray
    share: np.ndarray
    total: np.ndarray
    rest: np.ndarray

    def find(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are in it, and where."""
        at = np.minimum(np.searchsorted(self.hash, values), max(len(self.hash) - 1, 0))
        return (self.hash[at] == values if len(self.hash) else np.zeros(len(values), bool)), at

    @classmethod
    def of(cls, h: np.ndarray, first_id: np.ndarray, count: np.ndarray, classes: np.ndarray, uses: np.ndarray, kinds: np.ndarray) -> Lexicon:
        """uses, kinds: how many words, and different words, begin with each id."""
        order = np.argsort(h)
        h, first_id, count = h[order], first_id[order], count[order].astype(float)
        total = np.log10(np.bincount(classes, uses, minlength=CLASSES) + 1)
        rest = np.log10(DISCOUNT * np.bincount(classes, kinds, minlength=CLASSES) + 1) - total
        share = np.log10(np.maximum(count - DISCOUNT, 1e-9)) - total[classes[first_id]] if len(h) else np.zeros(0)
        return cls(h, np.log10(count + 0.1), share, total, rest)


def score_rows(m: Attention, lexicon: Lexicon, ids: np.ndarray, bounds: np.ndarray, w: Words, known: np.ndarray, at: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """log10 probability of each row, without what its words that aren't looked up add after their class; and what each adds if it is new.

    known, at: which words are in the lexicon, and where.
    """
    first = bounds[w.first]
    seq, start = with_ends(ids, first, end)
    place = np.arange(len(ids)) + np.repeat(start[:-1] + 1 - first[:-1], np.diff(first))
    heads, ends = place[bounds[:-1]], start[1:] - 1
    need = np.zeros(len(seq), bool)
    need[heads] = need[ends] = True
    need[place[~np.repeat(known, np.diff(bounds))]] = True
    own, begin = predict(m, seq, start, need)
    out = own[ends] - begin[ends]
    if not len(w.row):
        return out, np.zeros(0)
    out = out + np.bincount(w.row, own[heads] - begin[heads] + np.where(known, lexicon.share[at] if len(lexicon.share) else 0.0, 0.0), minlength=w.n_rows)
    run = np.concatenate([[0.0], np.cumsum(own[place] + m.share[ids])])
    head = ids[bounds[:-1]]
    new = lexicon.rest[m.classes[head]] + m.share[head] + run[bounds[1:]] - run[bounds[:-1] + 1] + begin[place[bounds[1:] - 1] + 1]
    return out, np.where(known, 0.0, new)


# ---------------------------------------------------------------- counts of the training documents


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def held_out(doc_id: Column) -> Column:
    return checksum(doc_id) % 10 == 0


def gather(training: DataFrame, file: str, pattern: str) -> DataFrame:
    """(kind, a, b, n): 0: n uses of the word with hash a and first id b; 1: id a has n neighbours in bin b (0..31 before, 32..63 after), in bin -1 its uses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = subwords(file, pattern)
        width = 2 * BINS + 1
        sketch = np.zeros((s.end + 1, width), np.int64)
        flat_sketch = sketch.ravel()
        bins = (mix64(np.arange(s.end + 1, dtype=np.uint64)) % np.uint64(BINS)).astype(np.int64)
        names = ["kind", "a", "b", "n"]
        for batch in batches:
            for w in scan_words(batch.column(1), limit=SLICE_BYTES):
                values, of, flat, bounds = s.entries(w)
                flat = flat.astype(np.int64)
                n = np.bincount(of, minlength=len(values))
                head, tail = flat[bounds[:-1]], flat[bounds[1:] - 1]
                a = np.concatenate([values, [END_HASH]]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(a), np.int32)), pa.array(a), pa.array(np.append(head, s.end).astype(np.int32)), pa.array(np.append(n, w.n_rows))], names=names)
                # neighbours inside the distinct words, by their counts, and from word to word or end
                times = np.repeat(n, np.diff(bounds))
                inside = np.ones(max(len(flat) - 1, 0), bool)
                inside[bounds[1:-1] - 1] = False
                x, y, many = flat[:-1][inside], flat[1:][inside], times[:-1][inside]
                np.add.at(flat_sketch, y * width + bins[x], many)
                np.add.at(flat_sketch, x * width + BINS + bins[y], many)
                same = w.row[1:] == w.row[:-1]
                opens, closes = np.ones(len(of), bool), np.ones(len(of), bool)
                opens[1:], closes[:-1] = ~same, ~same
                x = np.concatenate([tail[of[:-1][same]], np.full(int(opens.sum()), s.end), tail[of[closes]]])
                y = np.concatenate([head[of[1:][same]], head[of[opens]], np.full(int(closes.sum()), s.end)])
                np.add.at(flat_sketch, y * width + bins[x], 1)
                np.add.at(flat_sketch, x * width + BINS + bins[y], 1)
                np.add.at(sketch[:, -1], flat, times)
                sketch[s.end, -1] += w.n_rows
        a, b = np.nonzero(sketch)
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(a), np.int32)), pa.array(a), pa.array(np.where(b == 2 * BINS, -1, b).astype(np.int32)), pa.array(sketch[a, b])], names=names)

    return training.mapInArrow(run, "kind int, a long, b int, n long").groupBy("kind", "a", "b").agg(F.sum("n").alias("n"))


def cluster(points: np.ndarray, weight: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Weighted k-means; centres start at the heaviest points, and are numbered along their main direction."""
    centre = points[np.argsort(-weight, kind="stable")[:k]].copy()
    own = np.zeros(len(points), np.int64)
    for _ in range(rounds):
        own = np.argmin((centre * centre).sum(axis=1)[None, :] - 2 * points @ centre.T, axis=1)
        mass = np.bincount(own, weight, minlength=len(centre))
        total = np.stack([np.bincount(own, weight * points[:, j], minlength=len(centre)) for j in range(points.shape[1])], axis=1)
        centre = np.where(mass[:, None] > 0, total / np.maximum(mass, 1e-9)[:, None], centre)
    main = np.linalg.svd(centre - centre.mean(axis=0), full_matrices=False)[2][0]
    return np.argsort(np.argsort(centre @ main, kind="stable"), kind="stable")[own]


def initial_model(counts: DataFrame, begins: np.ndarray, seed: int = 5) -> Attention:
    """Classes, shares and embeddings from the counts, random weights; the driver holds a table of the ids, bounded by the vocabulary."""
    n_ids = len(begins)
    got = counts.where("kind = 1").select("a", "b", "n").toArrow()
    a, b, n = (got[c].to_numpy() for c in "abn")
    sketch, used = np.zeros((n_ids, 2 * BINS)), np.zeros(n_ids)
    used[a[b < 0]] = n[b < 0]
    sketch[a[b >= 0], b[b >= 0]] = n[b >= 0]
    seen = np.flatnonzero(used > 0)
    classes = np.where(begins, 0, BEGINNERS)  # ids that are never used
    classes[-1] = BEGINNERS - 1
    emb = np.zeros((n_ids, WIDTH))
    if len(seen) > 1:
        half = lambda m: np.sqrt(m / np.maximum(m.sum(axis=1, keepdims=True), 1))
        points = np.concatenate([half(sketch[seen, :BINS]), half(sketch[seen, BINS:])], axis=1)
        for some, low, k in ((begins[seen], 0, BEGINNERS - 1), (~begins[seen] & (seen != n_ids - 1), BEGINNERS, CLASSES - BEGINNERS)):
            if some.any():
                classes[seen[some]] = low + cluster(points[some], used[seen[some]], k)
        # singular vectors, the heavier ids counting more
        weight = np.sqrt(used[seen] / used[seen].max())[:, None]
        flat = points - np.average(points, axis=0, weights=used[seen])
        _, s, v = np.linalg.svd(flat * weight, full_matrices=False)
        k = min(WIDTH, len(s))
        to = flat @ v[:k].T
        emb[seen, :k] = to / np.maximum(np.sqrt(np.average(to * to, axis=0, weights=used[seen])), 1e-9) * np.sqrt(s[:k] / max(s[0], 1e-30)) * 0.7
    share = (used + 0.1) / np.bincount(classes, used + 0.1, minlength=CLASSES)[classes]
    mass = np.bincount(classes, used + 0.1, minlength=CLASSES) + 0.1
    return Attention(first_weights(np.random.default_rng(seed), mass), np.clip(emb, -4, 4).astype(np.float32), classes, np.log10(share).astype(np.float32))


def with_hash(docs: DataFrame) -> DataFrame:
    return docs.withColumn("hash", F.xxhash64("doc_id", "text"))


def local_steps(m: Attention, opt: Adam, texts: pa.Array, file: str, pattern: str, seed: int, begin: float, end: float) -> tuple[float, int]:
    """Adam steps over all windows of the texts, in an order of their own; the loss and the number of targets."""
    s, rng = subwords(file, pattern), np.random.default_rng(seed)
    loss, seen, done, size = 0.0, 0, 0, max(int(pa.compute.sum(pa.compute.binary_length(texts)).as_py() or 0), 1)
    for w in scan_words(texts, limit=SLICE_BYTES):
        ids, start = sequences(s, w)
        row, at = cut_windows(start)
        order = rng.permutation(len(row))
        share = len(w.data) / size
        for a in range(0, len(row), STEP_WINDOWS):
            some = order[a : a + STEP_WINDOWS]
            x, there, ahead, wanted = window_batch(ids, start, row[some], at[some])
            g, own, n = m.gradients(x, there, ids.take(ahead), wanted)
            opt.rate = RATE * (1 - 0.8 * (begin + (end - begin) * min(1.0, done + share * a / len(row))))
            opt.step(m.weights, g, n)
            loss, seen = loss + own, seen + n
        done += share
    return loss, seen


def round_of_steps(m: Attention, opt: Adam, docs: DataFrame, file: str, pattern: str, begin: float, end: float, chunk: int = 64) -> tuple[float, int]:
    """Steps of every `shard` of docs (shard, hash, text) from the same weights; their mean is put into m and opt."""
    names = sorted(m.weights)
    shared = docs.sparkSession.sparkContext.broadcast((m, opt))

    def run(group: pa.Table) -> pa.Table:
        model, before = shared.value
        own = Attention({k: v.copy() for k, v in model.weights.items()}, model.emb, model.classes, model.share)
        adam = before.copy()
        group = group.sort_by("hash")
        loss, seen = local_steps(own, adam, group["text"].combine_chunks(), file, pattern, group["shard"][0].as_py(), begin, end)
        flat = np.concatenate([*[x[k].ravel().astype(float) * seen for x in (own.weights, adam.m, adam.s) for k in names], [adam.t * seen, loss, seen]])
        rows = -(-len(flat) // chunk)
        flat = np.concatenate([flat, np.zeros(rows * chunk - len(flat))])
        lists = pa.ListArray.from_arrays((np.arange(rows + 1) * chunk).astype(np.int32), pa.array(flat))
        trim()
        return pa.Table.from_arrays([pa.array(np.arange(rows, dtype=np.int32)), lists], names=["k", "v"])

    found = docs.groupBy("shard").applyInArrow(run, "k int, v array<double>").groupBy("k").agg(F.array(*[F.sum(F.get("v", F.lit(j))) for j in range(chunk)]).alias("v"))
    got = found.toArrow().sort_by("k").combine_chunks()
    shared.unpersist()
    if not got.num_rows:
        return 0.0, 0
    flat, a = got["v"].chunk(0).flatten().to_numpy(), 0
    loss, seen = flat[3 * sum(v.size for v in m.weights.values()) + 1 :][:2]
    for x in (m.weights, opt.m, opt.s):
        for k in names:
            x[k][...] = (flat[a : a + x[k].size] / seen).reshape(x[k].shape)
            a += x[k].size
    opt.t = int(flat[a] / seen)
    return float(loss), int(seen)


def train(m: Attention, training: DataFrame, file: str, pattern: str, rounds: int = ROUNDS) -> list[float]:
    """Every training document once, in shards that take their steps side by side; the loss of a target in each round."""
    size = training.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = rounds * max(1, -(-size // (rounds * SHARD_BYTES)))
    docs = with_hash(training).select(F.pmod("hash", F.lit(shards)).alias("shard"), "hash", "text")
    opt, losses = Adam(m.weights, RATE), []
    for k in range(rounds):
        loss, n = round_of_steps(m, opt, docs.where(F.col("shard") % rounds == k), file, pattern, k / rounds, (k + 1) / rounds)
        if n:
            losses.append(loss / n)
    return losses


# ---------------------------------------------------------------- scores


def scores(docs: DataFrame, m: Attention, words: DataFrame, total: int, distinct_words: int, file: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) for each row; words: (h, first, c)."""
    spark = docs.sparkSession
    end_hash = int(END_HASH.view(np.int64))
    heavy = words.where(F.col("c") * HEAVY >= total).toArrow()  # at most HEAVY rows
    firsts = words.where(F.col("h") != end_hash).groupBy("first").agg(F.sum("c").alias("uses"), F.count("*").alias("kinds")).toArrow()  # at most the ids
    uses, kinds = np.zeros(len(m.classes)), np.zeros(len(m.classes))
    uses[firsts["first"].to_numpy()], kinds[firsts["first"].to_numpy()] = firsts["uses"].to_numpy(), firsts["kinds"].to_numpy()
    lexicon = Lexicon.of(heavy["h"].to_numpy().view(np.uint64), heavy["first"].to_numpy(), heavy["c"].to_numpy(), m.classes, uses, kinds)
    scale = np.log10(total + 0.1 * (distinct_words + 1))
    shared = spark.sparkContext.broadcast((m, lexicon))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, lexicon = shared.value
        s = subwords(file, pattern)
        own = TaskContext.get().partitionId() << 34
        names = ["doc_id", "rid", "h", "n", "new", "n_tokens", "n_known", "base", "score"]
        for batch in batches:
            for w in scan_words(batch.column(1), limit=SLICE_BYTES):
                ids, bounds, values, of = s.ids(w)
                found, at = lexicon.find(values)
                score, new = score_rows(model, lexicon, ids, bounds, w, found[of], at[of], s.end)
                # every row's words and its end
                values = np.append(values, END_HASH)
                row = np.concatenate([w.row, np.arange(w.n_rows)])
                of = np.concatenate([of, np.full(w.n_rows, len(values) - 1)])
                new = np.concatenate([new, np.zeros(w.n_rows)])
                heavy, at = lexicon.find(values)
                known = heavy[of]
                base = np.bincount(row[known], lexicon.base[at[of[known]]], minlength=w.n_rows).astype(float)  # of no rows it would be whole numbers
                n_known = np.bincount(row[known], minlength=w.n_rows)
                key, where, n = np.unique(row[~known].astype(np.int64) << 32 | of[~known], return_inverse=True, return_counts=True)
                new = np.bincount(where, new[~known], minlength=len(key))
                rid = own + np.arange(w.n_rows)
                own += w.n_rows
                k = len(key)
                yield pa.RecordBatch.from_arrays([
                    pa.concat_arrays([batch.column(0).slice(w.lo, w.n_rows), pa.nulls(k, pa.int64())]), pa.array(np.concatenate([rid, rid[key >> 32]])),
                    pa.array(np.concatenate([mix64(rid.astype(np.uint64)), values[key & 0xFFFFFFFF]]).view(np.int64)), pa.array(np.concatenate([np.zeros(w.n_rows, np.int32), n.astype(np.int32)])),
                    pa.array(np.concatenate([np.zeros(w.n_rows), new])),
                    *[pa.concat_arrays([pa.array(x), pa.nulls(k, pa.array(x).type)]) for x in (np.bincount(row, minlength=w.n_rows), n_known, base, score)],
                ], names=names)

    schema = "doc_id long, rid long, h long, n int, new double, n_tokens long, n_known long, base double, score double"
    ids = spark.createDataFrame(pa.table({"first": pa.array(np.arange(len(m.classes)), pa.int32()), "uses": pa.array(lexicon.total[m.classes])}))  # as many rows as ids
    rare = words.where(F.col("c") * HEAVY < total).join(F.broadcast(ids), "first").select("h", "c", "uses")
    joined = _rows(docs).mapInArrow(run, schema).join(rare, "h", "left")
    is_word = F.col("n") > 0
    gain = F.when(F.col("h") == end_hash, F.lit(0.0)).when(F.col("c").isNull(), F.col("new")).otherwise(F.col("n") * (F.log10(F.col("c") - DISCOUNT) - F.col("uses")))
    out = joined.groupBy("rid").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("n_tokens").alias("n_tokens"),
        (F.max("n_known") + F.coalesce(F.sum(F.when(is_word & F.col("c").isNotNull(), F.col("n"))), F.lit(0))).alias("n_known"),
        (F.max("base") + F.coalesce(F.sum(F.when(is_word, F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 0.1))), F.lit(0.0))).alias("base"),
        (F.max("score") + F.coalesce(F.sum(F.when(is_word, gain)), F.lit(0.0))).alias("score"),
    )
    return out.select("doc_id", "n_tokens", "n_known", (F.col("base") - F.col("n_tokens") * F.lit(float(scale))).alias("base_score"), "score")


def language_model(docs: DataFrame, file: str, pattern: str) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document."""
    training = _rows(docs.where(~held_out(F.col("doc_id"))))
    counts = materialize(gather(training, file, pattern))
    words = counts.where("kind = 0").select(F.col("a").alias("h"), F.col("b").alias("first"), F.col("n").alias("c")).where("c > 0")
    total, distinct_words = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    m = initial_model(counts, subwords(file, pattern).begins)
    train(m, training, file, pattern)
    out = scores(docs, m, words, total, distinct_words, file, pattern)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def op1_language_model(spark, sf_dir: str) -> DataFrame:
    return language_model(table(spark, sf_dir, "documents"), *public_vocabulary())

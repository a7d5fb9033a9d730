"""Byte-level BPE encoding and decoding, exact and in linear time, over an Aho-Corasick automaton.

The bytes of a piece (a match of the split pattern) are read as Latin-1, so that pyahocorasick finds the longest
vocabulary entry that begins at each byte.  From the left, the longest entry is taken that is compatible with the token
before it; shorter ones follow from a table of each entry's longest prefix that is an entry too.  Where none is
compatible, the token before is taken back and replaced by its next shorter entry; a place from which the end can't be
reached is never tried again.  Two adjacent tokens are compatible when merging their bytes by rank gives just these
two: no merge across their border comes before the merges that made them; that is memoised.  A sequence whose
neighbours are all compatible is the one that the merges give, so the result is exact.

Defined results: a null text is empty and has no tokens; other columns and repeated rows change nothing; a very long
text takes time and memory linear in it (Arrow batches are bounded by bytes).
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, trim

#: Pieces that a worker remembers in each of two generations; a used piece of the older one moves to the younger.
MEMORY = 150_000
#: Bytes of the longest piece that is remembered.
PIECE_BYTES = 64
NEVER = 1 << 60


class Pieces(dict):
    """Piece to (number of ids, the ids in decimal, the bytes decoded from them), made when first asked for."""

    def __init__(self, bpe: BPE):
        super().__init__()
        self.bpe, self.older = bpe, {}

    def __missing__(self, text: str) -> tuple[int, str, bytes]:
        got = self.older.get(text)
        if got is None:
            ids = self.bpe.encode_piece(text.encode())
            got = len(ids), " ".join(map(str, ids)), self.bpe.decode(ids)
            if len(text) > PIECE_BYTES:
                return got
        if len(self) >= MEMORY:
            self.older = dict(self)
            self.clear()
        self[text] = got
        return got


class BPE:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for b, i in ranks.items():
            self.bytes[i] = b
        self.size = list(map(len, self.bytes))
        self.split = regex.compile(pattern).findall
        self.automaton = ahocorasick.Automaton()
        for b, i in ranks.items():
            self.automaton.add_word(b.decode("latin-1"), (len(b), i))
        self.automaton.make_automaton()
        self.shorter: dict[int, int] = {}
        self.edges: dict[int, tuple] = {}
        self.pairs: list[dict[int, bool]] = [{} for _ in self.bytes]
        self.pieces = Pieces(self)

    def prefix(self, i: int) -> int:
        """The longest entry that is a proper prefix of entry i, -1 if there is none."""
        got = self.shorter.get(i)
        if got is None:
            b = self.bytes[i]
            got = self.shorter[i] = next((self.ranks[b[:n]] for n in range(len(b) - 1, 0, -1) if b[:n] in self.ranks), -1)
        return got

    def spines(self, i: int) -> tuple[list[tuple[bytes, int]], list[tuple[bytes, int]]]:
        """What stands at the left and at the right edge of entry i while its bytes are merged: (bytes, rank of the merge that ends it)."""
        got = self.edges.get(i)
        if got is None:
            data = self.bytes[i]
            parts = [data[k : k + 1] for k in range(len(data))]
            left, right = [], []
            while len(parts) > 1:
                rank, at = min((self.ranks.get(a + b, NEVER), k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
                if at == 0:
                    left.append((parts[0], rank))
                if at == len(parts) - 2:
                    right.append((parts[-1], rank))
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            got = self.edges[i] = [*left, (data, NEVER)], [*right, (data, NEVER)]
        return got

    def compatible(self, a: int, b: int) -> bool:
        """Whether no merge across the border of a and b comes before those that made them (of equal ranks the left one is first)."""
        got = self.pairs[a].get(b)
        if got is None:
            rank, left = self.ranks.get, self.spines(b)[0]
            got = True
            for x, x_ends in self.spines(a)[1]:
                for y, y_ends in left:
                    m = rank(x + y)
                    if m is not None and m < x_ends and m <= y_ends:
                        got = False
            self.pairs[a][b] = got
        return got

    def encode_piece(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        n = len(data)
        longest = [-1] * (n + 1)
        for end, (size, i) in self.automaton.iter(data.decode("latin-1")):
            longest[end + 1 - size] = i  # longer ones come later
        size, pairs = self.size, self.pairs
        dead = bytearray(n + 1)
        taken: list[int] = []
        at, i = 0, longest[0]
        while at < n:
            while i >= 0:
                if not dead[at + size[i]]:
                    if not taken:
                        break
                    good = pairs[taken[-1]].get(i)
                    if good or (good is None and self.compatible(taken[-1], i)):
                        break
                i = self.prefix(i)
            if i >= 0:
                taken.append(i)
                at += size[i]
                i = longest[at]
            else:
                if not taken:
                    raise ValueError("bytes outside the vocabulary")
                dead[at] = 1
                i = taken.pop()
                at -= size[i]
                i = self.prefix(i)
        return taken

    def encode(self, text: str) -> list[int]:
        return [int(i) for p in self.split(text) for i in self.pieces[p][1].split()]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


def parse_ranks(blob: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, blob.splitlines())}


_loaded: dict[tuple[str, str], BPE] = {}


def shared_bpe(file: str, pattern: str) -> BPE:
    """One encoder for each worker process and vocabulary file."""
    if (file, pattern) not in _loaded:
        with open(file, "rb") as f:
            _loaded[file, pattern] = BPE(parse_ranks(f.read()), pattern)
    return _loaded[file, pattern]


def encode(docs: DataFrame, file: str, pattern: str, with_ids: bool = True) -> DataFrame:
    """Adds n_tokens, ids_sha256, decoded_sha256 and (with_ids) token_ids to doc_id; `file` is a path that workers can open or a name added with addFile."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        bpe = shared_bpe(file if os.path.exists(file) else SparkFiles.get(os.path.basename(file)), pattern)
        for batch in batches:
            n, ids_sha, decoded_sha, kept = [], [], [], []
            for text in batch.column(1).to_pylist():
                sizes, digits, decoded = zip(*map(bpe.pieces.__getitem__, bpe.split(text)), strict=True) if text else ((), (), ())
                n.append(sum(sizes))
                ids = " ".join(digits)
                ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                decoded_sha.append(hashlib.sha256(b"".join(decoded)).hexdigest())
                if with_ids:
                    kept.append(np.array(ids.split(), np.int32))
            arrays = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                arrays, names = [*arrays, pa.array(kept, pa.list_(pa.int32()))], [*names, "token_ids"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)
        bpe.pieces.older = {}
        trim()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def public_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op6_bpe(spark, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), *public_vocabulary(), with_ids=False)

import base64
import collections
import hashlib
import math
import pickle
import re
import zlib

from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest

from spandrel.llm import bpe, common, decontamination, language_model, line_dedup, passages, quality_rules, simhash

from .conftest import frame


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def words(t):
    return [w for w in re.split("[ \t-\r]+", lower(t)) if w]


def by_row(df, *cols):
    return collections.Counter(tuple(r) for r in df.select(*cols).collect())


# ---------------------------------------------------------------- line dedup


def brute_lines(rows):
    key = lambda s: lower(s.strip(" \t\n\x0b\x0c\r"))
    holders = collections.defaultdict(set)
    low = lambda i: -(2**63) if i is None else i
    for i, t in rows:
        for s in (t or "").split("\n"):
            holders[key(s)].add(low(i))
    out = collections.Counter()
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [s for s in lines if not (len(key(s)) >= 20 and len(holders[key(s)]) >= 3 and max(holders[key(s)]) != low(i))]
        out[i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()] += 1
    return out


def line_result(df):
    from pyspark.sql import functions as F

    out = line_dedup.dedup_lines(df)
    name = line_dedup.bits_column(out)
    return by_row(out.select("doc_id", F.size(line_dedup.lines_of(F.col("text"))).alias("n"), F.coalesce(line_dedup.count_column(out), F.lit(0)).alias("k"), F.sha2(line_dedup.kept_text(F.col("text"), F.col(name)), 256).alias("h")), "doc_id", "n", "k", "h")


def test_line_dedup_matches_brute_force(spark, docs, base_rows, no_docs):
    assert line_result(docs) == brute_lines(base_rows)
    assert not line_result(no_docs)


def test_line_dedup_hot_line_and_long_document(spark, rng):
    hot = "this very line is in every document of all"
    rows = [(i, f"{hot}\nown line number {i} of this text here") for i in range(1500)] + [(5000, "\n".join([hot, "a line that comes many times over"] * 200)), (5001, "a line that comes many times over\nA LINE that comes many times over  "), (5002, "a line that comes many times over")]
    rows += [(6000 + k, "\n".join(f"line {j} that stays here or goes away" if j % 50 == 7 else f"own {k} {j} line that stays for ever" for j in range(400))) for k in range(4)]
    assert line_result(frame(spark, rows)) == brute_lines(rows)


def test_line_keys_differ_by_other_line_ends(spark):
    """Only blanks are stripped at the very ends, not before U+0085, U+2028 or U+2029."""
    rows = []
    for k, end in enumerate("\u0085\u2028\u2029"):
        rows += [(10 * k + j, f"the very same words in this line{blank}{end}") for j, blank in enumerate(("", " ", "  "))]
    rows += [(90 + j, f"{blank}a line between odd blanks is cut{blank}") for j, blank in enumerate((" ", "\t", "\x0b\x0c\r"))]
    rows += [(99, "a line between odd blanks is cut\u00a0")]
    assert line_result(frame(spark, rows)) == brute_lines(rows)


# ---------------------------------------------------------------- decontamination


def brute_hits(rows, items, window=10):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    grams = collections.defaultdict(set)
    for i, t in items:
        w = cut(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            grams[tuple(w[k : k + n])].add(i)
    out = collections.Counter()
    for i, t in rows:
        w, hit, found = cut(t), set(), set()
        for n in {len(g) for g in grams}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in grams:
                    hit |= set(range(k, k + n))
                    found |= grams[tuple(w[k : k + n])]
        out[i, len(w), len(hit), tuple(sorted(found - {None}))] += 1
    return out


@pytest.mark.parametrize("limit", [16_000_000, 10])
def test_decontamination_matches_brute_force(spark, docs, base_rows, no_docs, limit):
    w = base_rows[6][1].split()
    items = [(7, " ".join(w[5:25])), (8, " ".join(w[5:25])), (9, "TWO, words!"), (10, None), (11, "...") , (12, "ha " * 15), (None, " ".join(w[40:52])), (13, "nowhere to be found at all in any of these texts ever"), (7, " ".join(w[30:39]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = base_rows
    got = decontamination.contamination(docs, bench, limit=limit)
    have = collections.Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(sorted(r["items"]))) for r in got.collect())
    want = brute_hits(rows, items)
    assert have == want
    best = {r["doc_id"]: (r["longest"], r["longest_at"], r["longest_item"]) for r in got.collect()}
    assert best[6][:2] == (20, 5)
    kept = {r["doc_id"] for r in decontamination.decontaminate(docs, bench).collect()}
    assert kept == {k[0] for k in want if k[2] == 0}
    assert decontamination.contamination(no_docs, bench).count() == 0
    empty = decontamination.contamination(docs, bench.where("item_id = 99"))
    assert empty.where("n_hit > 0").count() == 0 and empty.count() == len(base_rows)


def thue_morse(n):
    a, b = "ab", "ba"
    while len(a) < n:
        a, b = a + b, b + a
    return a, b


def test_decontamination_compares_words_and_not_their_hashes(spark, monkeypatch):
    a, b = thue_morse(1024)
    bench = spark.createDataFrame([(1, a), (2, "one two three four five six seven eight nine ten")], "item_id long, text string")
    rows = [(1, a), (2, b), (3, "one two three four five six seven eight nine TEN"), (4, "one two three four five six seven eight nine eleven")]
    got = {r["doc_id"]: (r["n_hit"], r["items"]) for r in decontamination.contamination(frame(spark, rows), bench).collect()}
    assert got == {1: (1, [1]), 2: (0, []), 3: (10, [2]), 4: (0, [])}
    # a hash that knows lengths only
    monkeypatch.setattr(decontamination, "scan_words", lambda *x: (replace(w, hash=(w.end - w.start).astype(np.uint64)) for w in common.scan_words(*x)))
    items = decontamination.Items.of([1, 2], [a, "one two three four five six seven eight nine ten"], 10)
    shard = next(iter(decontamination.scan_words(pa.array([a, b, "one two three four five six seven eight nine TEN", "two one three four five six seven eight nine ten"]), "alnum")))
    hit, found, _ = decontamination.match_shard(shard, items)
    assert [sorted(x) for x in found] == [[0], [], [1], []] and hit.sum() == 11


def test_word_hashes_are_sound():
    rng = np.random.default_rng(8)
    words = {rng.integers(97, 123, n).astype(np.uint8).tobytes() for n in rng.integers(1, 90, 3000)} | {bytes([c]) * n for c in (97, 98, 128) for n in range(1, 300)}
    words |= {x.encode() for n in (64, 1024) for x in thue_morse(n)}
    words = sorted(words)
    w = next(iter(common.scan_words(pa.array([b" ".join(words)], pa.binary()))))
    assert len(set(w.hash.tolist())) == len(words)
    alone = np.concatenate([x.hash for x in common.scan_words(pa.array(words, pa.binary()), limit=100)])
    assert (alone == w.hash).all()


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(0)
    r = rng.integers(0, 4, 300)
    order = decontamination.suffix_array(r, 12)
    keys = [tuple(r[p : p + 12]) for p in order]
    assert keys == sorted(keys)


# ---------------------------------------------------------------- BPE


def test_bpe_equals_tiktoken_and_round_trips(spark, docs, base_rows, no_docs):
    import tiktoken

    file, pattern = bpe.public_vocabulary()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(file, "rb"))}
    truth = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    got = bpe.encode(docs, file, pattern).collect()
    assert len(got) == len(base_rows)
    for r, (i, t) in zip(sorted(got, key=lambda r: (str(r["doc_id"]), r["decoded_sha256"])), sorted(base_rows, key=lambda r: (str(r[0]), hashlib.sha256((r[1] or "").encode()).hexdigest())), strict=True):
        ids = truth.encode_ordinary(t or "")
        assert (r["doc_id"], r["token_ids"], r["n_tokens"]) == (i, ids, len(ids))
        assert r["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert bpe.encode(no_docs, file, pattern).count() == 0


def test_bpe_on_hard_pieces():
    import random

    import tiktoken

    file, pattern = bpe.public_vocabulary()
    own = bpe.shared_bpe(file, pattern)
    truth = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=own.ranks, special_tokens={})
    rng = random.Random(1)
    for _ in range(3000):
        t = "".join(rng.choices("abcdefeeinstthé日🙂  \n'sA1.,", k=rng.randint(1, 40)))
        assert own.encode(t) == truth.encode_ordinary(t)
    for t in ("a" * 5000, "ab" * 3000, "日本" * 1000, " " * 3000 + "x"):
        assert own.encode(t) == truth.encode_ordinary(t)
        assert own.decode(own.encode(t)) == t.encode()


# ---------------------------------------------------------------- SimHash


def brute_components(rows, shingle, bits):
    import xxhash

    def fp(t):
        w = words(t)
        if not w:
            return 0
        s = [" ".join(w[k : k + shingle]) for k in range(max(1, len(w) - shingle + 1))]
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    f = [fp(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (f[a] ^ f[b]).bit_count() <= bits:
                root[find(a)] = find(b)
    low = collections.defaultdict(list)
    for k, (i, _) in enumerate(rows):
        low[find(k)].append(i)
    least = {k: None if None in v else min(v) for k, v in low.items()}
    return collections.Counter((i, f[k] - 2**64 if f[k] >= 2**63 else f[k], least[find(k)]) for k, (i, _) in enumerate(rows))


def test_simhash_matches_brute_force(spark, docs, base_rows, no_docs):
    got = simhash.near_components(docs)
    assert by_row(got, "doc_id", "fp", "component_id") == brute_components(base_rows, 3, 2)
    assert simhash.near_components(no_docs).count() == 0
    kept = {r["doc_id"] for r in simhash.keep_first(docs).collect()}
    assert kept == {k[2] for k in brute_components(base_rows, 3, 2)}


def test_vantage_points_lose_no_pair():
    rng = np.random.default_rng(3)
    fp = rng.integers(0, 2**63, 1500, dtype=np.uint64)
    near = fp[:300] ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64))
    fp = np.unique(np.concatenate([fp, near, near[:100] ^ (np.uint64(1) << rng.integers(0, 64, 100).astype(np.uint64)), np.arange(400, dtype=np.uint64)]))
    brute = simhash.Forest(len(fp))
    i, j = np.nonzero(simhash.hamming(fp[:, None], fp[None, :]) <= 2)
    brute.link(i, j)
    want = brute.root(np.arange(len(fp)))
    nodes = simhash.build_top(fp[::7], 8)
    assert len(nodes) == 7 and len(simhash.build_top(np.arange(64, dtype=np.uint64) ** 0 * (np.uint64(1) << np.arange(64, dtype=np.uint64)), 8)) == 7  # all at one distance
    home = np.zeros(len(fp), int)
    a, s = simhash.route(fp, nodes, 0)
    home[a] = s
    assert len(a) == len(fp)
    parts = simhash.Forest(len(fp))
    a, s = simhash.route(fp, nodes, 2)
    for shard in np.unique(s):
        own = a[(s == shard) & (home[a] <= shard)]
        u, v = simhash.link_shard(fp[own], np.flatnonzero(home[own] == shard), 2)
        parts.link(own[u], own[v])
    assert (parts.root(np.arange(len(fp))) == want).all()


# ---------------------------------------------------------------- passages


def test_passages_match_brute_force(spark, docs, base_rows, no_docs):
    got = passages.repeated_passages(docs).collect()
    texts = collections.defaultdict(list)
    for i, t in base_rows:
        texts[i].append(words(t))
    runs = collections.defaultdict(set)
    for i, ws in texts.items():
        for w in ws:
            for k in range(len(w) - 49):
                runs[tuple(w[k : k + 50])].add(i)
    want = {i for s in runs.values() if len(s) > 1 for i in s}
    assert want <= {r["doc_id"] for r in got}
    for r in got:
        sims = []
        for a in texts[r["doc_id"]]:
            for b in texts[r["other_id"]]:
                x, y = a[r["first_word"] : r["last_word"] + 1], b[r["other_first_word"] : r["other_last_word"] + 1]
                x, y = ({tuple(z[k : k + 5]) for k in range(len(z) - 4)} for z in (x, y))
                sims.append(len(x & y) / max(1, len(x | y)))
        assert max(sims) >= 0.8 and any(abs(s - r["similarity"]) < 1e-9 for s in sims)
        assert r["last_word"] - r["first_word"] + 1 >= 50 and r["doc_id"] != r["other_id"]
    assert passages.repeated_passages(no_docs).count() == 0


def test_compact_windows_are_those_of_the_cartesian_tree():
    rng = np.random.default_rng(5)
    for _ in range(20):
        sizes = rng.integers(0, 60, 6)
        h = rng.integers(0, 2**63, int(sizes.sum()), dtype=np.uint64)
        row, first = np.repeat(np.arange(6), sizes), np.concatenate([[0], np.cumsum(sizes)])
        want = set()

        def split(lo, hi, least, h=h, want=want):
            if hi - lo + 1 < least:
                return
            c = lo + int(np.argmin(h[lo : hi + 1]))
            want.add((lo, c, hi))
            split(lo, c - 1, least)
            split(c + 1, hi, least)

        for r in range(6):
            split(int(first[r]), int(first[r + 1]) - 1, 9)
        assert {tuple(map(int, x)) for x in zip(*passages.compact_windows(h, row, first, 9), strict=True)} == want


# ---------------------------------------------------------------- language model


def test_language_model_base_and_scores(spark, docs, base_rows, no_docs):
    file, pattern = bpe.public_vocabulary()
    got = language_model.language_model(docs, file, pattern).collect()
    counts = collections.Counter()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    for i, t in base_rows:
        if not held(i):
            counts.update([*words(t), None])
    n, v = sum(counts.values()), len(counts)
    want = collections.Counter()
    for i, t in base_rows:
        w = [*words(t), None]
        want[i, held(i), len(w), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 5)] += 1
    assert collections.Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in got) == want
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert language_model.language_model(no_docs, file, pattern).count() == 0


def tiny_model(rng, n_ids=30):
    classes = rng.integers(0, language_model.CLASSES, n_ids)
    classes[:10] = rng.integers(0, language_model.BEGINNERS, 10)
    mass = np.bincount(classes, minlength=language_model.CLASSES) + 0.5
    share = np.log10(1 / np.bincount(classes, minlength=language_model.CLASSES)[classes])
    return language_model.Attention(language_model.first_weights(rng, mass), rng.standard_normal((n_ids, language_model.WIDTH)).astype(np.float32), classes, share)


def test_attention_scores_each_id_once_and_has_right_gradients():
    rng = np.random.default_rng(0)
    start = np.array([0, 2, 40, 140])
    row, at = language_model.cut_windows(start)
    ids = rng.integers(0, 30, 140).astype(np.int32)
    x, there, ahead, wanted = language_model.window_batch(ids, start, row, at)
    assert sorted(ahead[wanted].tolist()) == [k for k in range(140) if k not in start]
    m = tiny_model(rng)
    m.weights = {k: v.astype(np.float64) for k, v in m.weights.items()}
    g, loss, n = m.gradients(x, there, ids[ahead], wanted)
    assert n == 137
    for name, p in m.weights.items():
        for _ in range(3):
            k = np.unravel_index(rng.integers(p.size), p.shape)
            old = p[k]
            p[k] = old + 1e-4
            up = m.gradients(x, there, ids[ahead], wanted)[1]
            p[k] = old - 1e-4
            down = m.gradients(x, there, ids[ahead], wanted)[1]
            p[k] = old
            assert abs((up - down) / 2e-4 - g[name][k]) < 2e-3 + 1e-2 * abs(g[name][k]), name


def plain_class_probabilities(m, ids, k, first):
    """Of the id after ids[first..k], without batches or tables: context of the window that scores place k + 1."""
    p, w, c = m.weights, language_model.WIDTH, language_model.CONTEXT
    window = first + (k - first) // language_model.STEP * language_model.STEP
    seen = range(max(first, window - c), k + 1)
    x = [m.emb[ids[i]] + p["pos"][i - window + c] for i in seen]
    s = np.array([(x[-1] @ p["q"]) @ (y @ p["k"]) for y in x])
    a = np.exp(s - s.max())
    o = sum(b * (y @ p["v"]) for b, y in zip(a / a.sum(), x, strict=True))
    z = np.maximum(np.concatenate([x[-1], o]) @ p["w1"] + p["b1"], 0)
    softmax = lambda f: np.exp(f - f.max()) / np.exp(f - f.max()).sum()
    assert len(o) == w
    return np.concatenate([g * softmax(z @ p["u"][i] + p["c"][i]) for i, g in enumerate(softmax(z @ p["w2"] + p["b2"]))])


def test_batched_probabilities_equal_plain_ones_and_add_up():
    rng = np.random.default_rng(2)
    m = tiny_model(rng)
    start = np.array([0, 3, 70])
    ids = rng.integers(0, 30, 70).astype(np.int32)
    need = rng.random(70) < 0.7
    own, begin = language_model.predict(m, ids, start, need)
    for a, b in zip(start[:-1], start[1:], strict=True):
        for k in range(a, b - 1):
            p = plain_class_probabilities(m, ids, k, a)
            assert p.sum() == pytest.approx(1, abs=1e-5)
            if need[k + 1]:
                assert own[k + 1] == pytest.approx(np.log10(p[m.classes[ids[k + 1]]]), abs=1e-4)
                assert begin[k + 1] == pytest.approx(np.log10(p[: language_model.BEGINNERS].sum()), abs=1e-4)
            else:
                assert own[k + 1] == begin[k + 1] == 0


def test_shares_of_known_words_and_of_new_ones_add_up_to_one():
    classes = np.array([3, 3, 5, 200, 127])
    first, count = np.array([0, 0, 1, 2, 2]), np.array([5, 1, 2, 7, 1])
    uses, kinds = np.bincount(first, count, minlength=5), np.bincount(first, minlength=5)
    x = language_model.Lexicon.of(np.arange(5, dtype=np.uint64), first, count, classes, uses, kinds)
    for k in (3, 5):
        assert sum(10 ** x.share[i] for i in range(5) if classes[first[i]] == k) + 10 ** x.rest[k] == pytest.approx(1)
    assert x.rest[200] == 0


def test_scores_do_not_depend_on_partitions_or_on_where_words_are_looked_up(spark, docs, monkeypatch):
    file, pattern = bpe.public_vocabulary()
    score = lambda d: sorted((str(r["doc_id"]), round(r["base_score"], 6), r["score"]) for r in language_model.language_model(d, file, pattern).collect())
    one, six = score(docs.coalesce(1)), score(docs.repartition(6))
    monkeypatch.setattr(language_model, "HEAVY", 20)
    joined = score(docs.repartition(3))
    for a, b, c in zip(one, six, joined, strict=True):
        assert a[:2] == b[:2] == c[:2]
        assert b[2] == pytest.approx(a[2], abs=0.01, rel=1e-4) and c[2] == pytest.approx(a[2], abs=0.01, rel=1e-4)


def test_language_model_beats_the_base_on_held_out_text(spark):
    import random

    rng = random.Random(4)
    subjects, verbs, things = (["red fox", "old dog", "grey cat", "wise owl"], ["sees", "finds", "hears", "likes"], ["the river", "a hill", "the forest", "a stone"])
    rows = [(i, " ".join(f"the {rng.choice(subjects)} {rng.choice(verbs)} {rng.choice(things)} ." for _ in range(40))) for i in range(400)]
    file, pattern = bpe.public_vocabulary()
    got = [r for r in language_model.language_model(frame(spark, rows), file, pattern).collect() if r["held_out"]]
    assert len(got) > 20 and sum(r["score"] for r in got) > 0.75 * sum(r["base_score"] for r in got)


def test_language_model_takes_steps_on_every_training_document(spark, monkeypatch):
    """No document is read before others or more often: the steps' targets are all ids of the training texts, once."""
    import random

    file, pattern = bpe.public_vocabulary()
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choices(["red", "fox", "river", "hills"], k=30))) for i in range(300)]
    training = frame(spark, rows).select("doc_id", "text")
    monkeypatch.setattr(language_model, "SHARD_BYTES", 1500)  # several shards in a round
    targets, losses, base = [], [], language_model.round_of_steps

    def noted(*given):
        loss, n = base(*given)
        targets.append(n)
        return loss, n

    monkeypatch.setattr(language_model, "round_of_steps", noted)
    counts = language_model.gather(training, file, pattern)
    m = language_model.initial_model(counts, language_model.subwords(file, pattern).begins)
    losses = language_model.train(m, training, file, pattern)
    assert sum(targets) == sum(len(language_model.subwords(file, pattern).encoding.encode_ordinary(" " + t)) + 1 for _, t in rows)
    assert len(losses) == language_model.ROUNDS and losses[-1] < losses[0]


# ---------------------------------------------------------------- quality rules


def test_base_rules_match_brute_force(spark, docs, base_rows, no_docs):
    got = quality_rules.quality(docs).collect()
    want = collections.Counter()
    for i, t in base_rows:
        t = t or ""
        w = [x for x in re.split("[ \t-\r]+", t) if x]
        lines = [s for s in t.split("\n") if s.strip(" \t\n\x0b\x0c\r")]
        grams = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        repeat = {p for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for p in (k, k + 1, k + 2)}
        failed = len(w) < 50 or 100 * len(repeat) > 50 * len(w)
        want[i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(repeat), failed] += 1
    assert collections.Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got) == want
    assert not any(r["kept"] and r["base_failed"] for r in got)
    assert quality_rules.quality(no_docs).count() == 0


def test_mcd_is_robust_and_matches_numpy(spark):
    rng = np.random.default_rng(1)
    good = rng.normal(size=(600, quality_rules.P)) @ np.diag([1, 0.5, 2, 1, 1, 3])
    bad = rng.normal(size=(120, quality_rules.P)) * 0.1 + 8
    x = np.concatenate([good, bad])
    df = spark.createDataFrame([("a", *map(float, r)) for r in x], "grp string, " + ", ".join(f"x_{i} double" for i in range(quality_rules.P)))
    e = quality_rules.mcd(df).first()
    mean = np.array([e[f"m_{i}"] for i in range(quality_rules.P)])
    low = np.zeros((quality_rules.P, quality_rules.P))
    for i in range(quality_rules.P):
        for j in range(i + 1):
            low[i, j] = e[f"l_{i}_{j}"]
    m, s = np.median(x, axis=0), None
    scale = np.diag((1.4826 * np.median(np.abs(x - m), axis=0)) ** 2)
    s = scale
    floor = np.diag(np.array(quality_rules.FLOOR) ** 2)
    for _ in range(quality_rules.STEPS):
        d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(s + floor), x - m)
        near = x[d <= np.sort(d)[int(np.ceil(0.75 * len(x))) - 1]]
        m, s = near.mean(axis=0), np.cov(near.T, bias=True)
    assert np.allclose(mean, m, atol=0.02) and np.allclose(low @ low.T, s + floor, atol=0.1)
    assert np.abs(mean).max() < 1


def test_chi_square_quantiles():
    assert abs(quality_rules.chi2_quantile(0.95, 6) - 12.5916) < 1e-3
    assert abs(quality_rules.chi2_quantile(0.999, 2) - 13.8155) < 1e-3


def test_language_model_steps_take_sums_and_equal_plain_adam():
    rng = np.random.default_rng(6)
    weights = {"a": rng.standard_normal((3, 4)).astype(np.float32), "b": rng.standard_normal(5).astype(np.float32)}
    plain = {k: v.astype(float) for k, v in weights.items()}
    m, s = ({k: np.zeros_like(v) for k, v in plain.items()} for _ in range(2))
    adam = language_model.Adam(weights, 0.03)
    for t in range(1, 6):
        g = {k: rng.standard_normal(v.shape).astype(np.float32) for k, v in weights.items()}
        adam = pickle.loads(pickle.dumps(adam)).copy()  # as in a round: moments come by broadcast
        adam.step(weights, g, 7)
        for k, v in g.items():
            m[k] = 0.9 * m[k] + 0.1 * (v / 7)
            s[k] = 0.995 * s[k] + 0.005 * (v / 7) ** 2
            plain[k] -= 0.03 * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.995**t)) + 1e-8)
    for k in weights:
        assert weights[k] == pytest.approx(plain[k], abs=1e-5)
        assert adam.m[k] == pytest.approx(m[k], abs=1e-6) and adam.m[k].base is not None

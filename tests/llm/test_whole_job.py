"""Places where an operator once did less than the whole job."""

import collections
import pathlib
import random

import corpus_pipeline
from spandrel.llm import common, decontamination, near_copies, passages, quality_rules

from .conftest import frame, make_text
from .test_text_operators import brute_hits


def shingles(t, n=5):
    w = (t or "").lower().split()
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(rng, text, edits):
    w = text.split()
    for k in rng.sample(range(len(w)), edits):
        w[k] = f"edit{rng.randrange(10**9)}"
    return " ".join(w)


def test_pipeline_drops_near_copies_from_similarity_0_8(spark):
    rng = random.Random(11)
    rows = []
    for i in range(150):
        text = make_text(rng, 200)
        rows.append((i, text))
        rows.append((1000 + i, edited(rng, text, rng.randint(1, 6))))
    base = make_text(rng, 300)
    rows += [(5000 + i, edited(rng, base, rng.randint(1, 12))) for i in range(40)]
    rows += [(6000, "two words"), (6001, "two  words"), (6002, "other words"), (6003, ""), (6004, None)]
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    planted = collections.Counter()
    for a in range(len(rows)):
        for b in range(a):
            s = jaccard(sets[a], sets[b])
            if s >= 0.8:
                planted[min(int(s * 20), 19)] += 1
                low, high = sorted((find(a), find(b)))
                root[high] = low
    assert planted[16] and planted[17] and planted[18]  # 0.80 to 0.95
    want = {rows[k][0] for k in range(len(rows)) if find(k) == k}
    got = [r["doc_id"] for r in corpus_pipeline.simhash_stage(spark, frame(spark, rows), "").collect()]
    assert len(got) == len(want) and set(got) == want


def test_passages_recall_of_planted_near_duplicates(spark):
    rng = random.Random(17)
    rows, planted = [], []
    for i in range(1500):
        n = rng.choice((55, 60, 70, 110, 120))
        w = make_text(rng, n).split()
        e = list(w)
        for k in (n // 2,) if n < 100 else (n // 3, 2 * n // 3):
            e[k] = f"edit{i}x{k}"
        planted.append(jaccard(shingles(" ".join(w)), shingles(" ".join(e))))
        rows += [(j, " ".join([make_text(rng, 40), *x, make_text(rng, 40)])) for j, x in ((i, w), (10000 + i, e))]
    assert 0.8 <= min(planted) and max(planted) < 0.9
    got = {(r["doc_id"], r["other_id"]) for r in passages.repeated_passages(frame(spark, rows)).collect()}
    found = sum((i, 10000 + i) in got or (10000 + i, i) in got for i in range(1500))
    assert found >= 1495  # 1490 with four hash functions


def test_passages_behind_unlike_documents_are_found(spark):
    """Variants below 0.8 and a line of all documents come first in the groups; the like pair behind them is found."""
    rng = random.Random(29)
    line, rows, pairs = make_text(rng, 14), [], []
    for i in range(150):
        w = make_text(rng, 70).split()

        def variant(edits):
            e = list(w)
            for k in edits:
                e[k] = f"edit{rng.randrange(10**9)}"
            return e

        unlike = [variant(rng.sample(range(8, 62, 6), 3)) for _ in range(4)]
        like = [w, variant([35])]
        for e in unlike:
            assert jaccard(shingles(" ".join(e)), shingles(" ".join(w))) < 0.8
        ids = [10 * i + k for k in range(4)] + [100_000 + i, 200_000 + i]
        rows += [(d, " ".join([make_text(rng, 30), line, make_text(rng, 30), *e, make_text(rng, 30)])) for d, e in zip(ids, unlike + like, strict=True)]
        pairs.append((100_000 + i, 200_000 + i))
    got = passages.repeated_passages(frame(spark, rows)).collect()
    group = {r[c]: r["group_id"] for r in got for c in ("doc_id", "other_id")}
    found = sum(a in group and group.get(a) == group.get(b) for a, b in pairs)
    assert found >= 147  # 82 by the first search alone; in the other pairs one document found another partner first


def test_places_that_have_a_partner_are_linked_to_others(spark):
    """b is like a but unlike u, which comes first in the groups and is a's partner; the three are one group."""
    rng = random.Random(31)
    rows = []
    for i in range(120):
        w = make_text(rng, 70).split()
        texts = [[f"edit{i}x{k}x{e}" if k == e else x for k, x in enumerate(w)] for e in (25, None, 45)]
        assert jaccard(shingles(" ".join(texts[0])), shingles(" ".join(texts[2]))) < 0.8 < jaccard(shingles(" ".join(w)), shingles(" ".join(texts[2])))
        rows += [(d, " ".join([make_text(rng, 30), *x, make_text(rng, 30)])) for d, x in zip((i, 1000 + i, 2000 + i), texts, strict=True)]
    got = passages.repeated_passages(frame(spark, rows)).collect()
    group = {r[c]: r["group_id"] for r in got for c in ("doc_id", "other_id")}
    assert sum(group.get(2000 + i) == group.get(1000 + i) == group.get(i) == i for i in range(120)) == 120


def test_decontamination_keeps_rows_apart_over_several_blocks(spark):
    rng = random.Random(5)
    a, b = make_text(rng, 30), make_text(rng, 30)
    rows = [(1, a), (1, b), (1, a), (2, a), (None, a), (None, b), (None, make_text(rng, 30)), (None, None), (None, None), (3, "")]
    items = [(7, " ".join(a.split()[:12])), (8, " ".join(b.split()[5:20])), (9, " ".join(a.split()[:25]))]
    bench = spark.createDataFrame(items, "item_id long, text string").coalesce(1)
    for limit in (16_000_000, 10):
        got = decontamination.contamination(frame(spark, rows), bench, limit=limit).collect()
        assert collections.Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(sorted(r["items"]))) for r in got) == brute_hits(rows, items)
        assert {(r["longest"], r["longest_item"]) for r in got if 9 in r["items"]} == {(25, 9)}


def test_repetition_alone_rejects_a_text(spark):
    rng = random.Random(23)

    def lines(w):
        return [" ".join(w[k : k + 10]) for k in range(0, len(w), 10)]

    rows = [(i, "\n".join(lines(make_text(rng, rng.randint(200, 400)).split()))) for i in range(200)]
    block = make_text(rng, 72).split()
    rows.append((1000, "\n".join(lines(block + block + make_text(rng, 156).split()))))  # 48 % repeated words
    rows.append((1001, "\nterms\n".join(lines(make_text(rng, 300).split()))))  # 28 of 59 lines
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in rows], "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in quality_rules.quality(docs).collect()}
    assert not got[1000]["base_failed"] and got[1000]["n_dup_lines"] == 0 and not got[1000]["kept"]
    assert not got[1001]["base_failed"] and got[1001]["n_repeat_words"] == 0 and not got[1001]["kept"]
    assert all(got[i]["kept"] for i in range(200))


def test_near_copies_of_a_group_without_an_original(spark):
    """Edited copies of a text that isn't there: some alike, most not; the prefix filter finds what representatives miss."""
    rng = random.Random(29)
    base = make_text(rng, 150)
    rows = [(i, edited(rng, base, rng.randint(2, 12))) for i in range(250)]
    sets = [shingles(t) for _, t in rows]
    links = [(a, b) for a in range(250) for b in range(a) if jaccard(sets[a], sets[b]) >= 0.8]
    root = list(range(250))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    got = {r["doc_id"]: r["component_id"] for r in near_copies.near_components(frame(spark, rows)).collect()}
    assert got == {i: find(i) for i in range(250)} and len(set(got.values())) > 1
    tokens = [(i, i % 3, sorted(hash(x) % 2**31 for x in s)) for i, s in enumerate(sets)]
    pairs = {frozenset((r["e"], r["o"])) for r in near_copies.prefix_pairs(spark.createDataFrame(tokens, "e long, root long, s array<int>")).collect()}
    assert {frozenset(x) for x in links if x[0] % 3 != x[1] % 3} <= pairs and len(pairs) < 250 * 249 / 4


def test_near_copies_have_their_first_candidates_from_fingerprints(spark):
    """SimHash is a step of the stage: its pairs are found without any MinHash key, and what lies further off still links."""
    rng = random.Random(41)
    rows = []
    for i in range(60):
        text = make_text(rng, 400)
        rows += [(i, text), (100 + i, text + " end"), (200 + i, edited(rng, text, 6))]
    found = near_copies.sketches(frame(spark, rows)).collect()
    entry, prints = {r["doc_id"]: r["e"] for r in found}, {r["doc_id"]: r["fp"] for r in found}
    want = {frozenset((entry[i], entry[100 + i])) for i in range(60) if ((prints[i] ^ prints[100 + i]) & (2**64 - 1)).bit_count() <= near_copies.MAX_BITS}
    entries = spark.createDataFrame([(r["e"], r["fp"]) for r in found], "e long, fp long")
    got = {frozenset((r["e"], r["o"])) for r in near_copies.fingerprint_pairs(entries).collect()}
    assert len(want) >= 50 and want <= got
    groups = {r["doc_id"]: r["component_id"] for r in near_copies.near_components(frame(spark, rows)).collect()}
    assert groups == {d: d % 100 for d, _ in rows}


def test_passages_delete_the_tables_of_earlier_steps(spark):
    """Windows, texts of spans and tokens of places, the large tables, don't stay until the session ends."""
    rng = random.Random(43)
    rows = []
    for i in range(20):
        w = make_text(rng, 70).split()
        texts = [[f"edit{i}x{k}x{e}" if k == e else x for k, x in enumerate(w)] for e in (25, None, 45)]
        rows += [(d, " ".join([make_text(rng, 30), *x, make_text(rng, 30)])) for d, x in zip((i, 1000 + i, 2000 + i), texts, strict=True)]
    folder = pathlib.Path(common.ensure_checkpoint_dir(spark).removeprefix("file:"))
    before = set(folder.glob("table-*"))
    assert len({r["group_id"] for r in passages.repeated_passages(frame(spark, rows)).collect()}) == 20
    left = [set(spark.read.parquet(str(x)).columns) for x in set(folder.glob("table-*")) - before]
    assert left and not [x for x in left if x & {"low", "tokens", "near", "lr"}]

import base64
import collections
import gzip
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spandrel.llm import common, components, quality_classifier, simhash, sparse, toxicity, warc

from .conftest import DOCS, frame, make_text

# ---------------------------------------------------------------- classifiers


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(3)
    rows, marks = [], []
    for i in range(700):
        text = make_text(rng, rng.randint(40, 120))
        bad, toxic = i % 5 == 0, i % 7 == 0
        if bad:
            text = " | ".join(text.split())
        if toxic:
            w = text.split()
            for _ in range(4):
                w.insert(rng.randint(0, len(w)), rng.choice(["vilebeast", "vilegoat", "vileworm"]))
            text = " ".join(w)
        rows.append((i, text))
        if i % 3:
            marks.append((i, int(not bad), int(toxic)))
    marks += [(1, 1, None), (2, None, 0), (None, 1, 1), (5, 0, 0), (5, 0, 0)]
    return frame(spark, rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def test_quality_classifier_learns_and_takes_odd_rows(spark, labelled, docs, no_docs, base_rows):
    data, labels = labelled
    model = quality_classifier.fit(data, labels)
    got = {r["doc_id"]: r["score"] for r in quality_classifier.score(data, model).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(got[i] >= 0.5) == (i % 5 != 0) for i in held]) > 0.97
    odd = quality_classifier.score(docs, model).collect()
    assert len(odd) == len(base_rows) and all(0 <= r["score"] <= 1 for r in odd)
    assert quality_classifier.score(no_docs, model).count() == 0
    kept = quality_classifier.keep_good(data, model)
    assert kept.columns == data.columns and {r["doc_id"] for r in kept.collect()} == {i for i, s in got.items() if s >= 0.5}
    none = quality_classifier.fit(data, labels.where("false"))
    assert all(r["score"] == 0.5 for r in quality_classifier.score(docs, none).collect())


def test_sum_of_squares_identity():
    rng = np.random.default_rng(0)
    m = sparse.FM(0.3, rng.normal(size=20).astype(np.float32), rng.normal(size=(20, 4)).astype(np.float32))
    x = sparse.Sparse(np.array([0, 3, 3, 7]), np.array([1, 5, 9, 2, 5, 7, 19]), rng.normal(size=7).astype(np.float32))
    got = m.raw(x)
    for r in range(3):
        i, v = x.idx[x.ptr[r] : x.ptr[r + 1]], x.val[x.ptr[r] : x.ptr[r + 1]]
        pairs = sum(m.v[i[a]] @ m.v[i[b]] * v[a] * v[b] for a in range(len(i)) for b in range(a))
        assert got[r] == pytest.approx(0.3 + m.w[i] @ v + pairs, abs=1e-4)


def test_toxicity_chain(spark, labelled, docs, no_docs, base_rows):
    data, labels = labelled
    chain = toxicity.fit(data, labels)
    got = {r["doc_id"]: r["chain"][-1] >= 0.5 for r in toxicity.score(data, chain).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([got[i] == (i % 7 == 0) for i in held]) > 0.95
    odd = toxicity.score(docs, chain).collect()
    assert len(odd) == len(base_rows) and not any(r["chain"][-1] >= 0.5 for r in odd)
    assert toxicity.score(no_docs, chain).count() == 0
    empty = toxicity.fit(data, labels.where("false"))
    assert all(len(r["chain"]) == 2 for r in toxicity.score(docs, empty).collect())


def word_hash(word):
    return int(next(iter(common.scan_words(pa.array([word])))).hash[0])


def plain_words(text):
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in re.split("[ \t-\r]+", text or "") if w]


def test_quality_scores_equal_a_plain_factorisation_machine(spark, labelled, docs, base_rows):
    data, labels = labelled
    m = quality_classifier.fit(data, labels)
    got = collections.defaultdict(set)
    for r in quality_classifier.score(docs, m).collect():
        got[r["doc_id"]].add(round(r["score"], 4))
    for i, text in [x for x in base_rows if x[1] is None or len(x[1]) < 600][:25]:
        t, w = text or "", plain_words(text)
        x = {}
        counts = collections.Counter((word_hash(v) >> 20) % quality_classifier.DIMS for v in w)
        norm = math.sqrt(sum(math.log1p(n) ** 2 for n in counts.values()))
        for k, n in counts.items():
            x[k] = math.log1p(n) / max(norm, 1e-9)
        size, raw = len(t.encode()), t.encode()
        share = lambda n, of: round(4 * math.log2(1 + 60 * n / of))
        n = max(len(w), 1)
        grams = {tuple(w[k : k + 3]) for k in range(len(w) - 2)}
        bins = [round(2 * math.log2(1 + len(w))), round(2 * sum(len(v.encode()) for v in w) / n)]
        bins += [share(sum(c in chars for c in raw), max(size, 1)) for chars in (range(65, 91), b"#*$%&|<>{}[]\\^~@=+_", b"0123456789", b"!?.,;:")]
        bins += [round(20 * len(set(w)) / n), round(20 * (1 - len(grams) / max(len(w) - 2, 1))), round(2 * math.log2(n / (t.count("\n") + 1) + 1))]
        bins += [31 if text is None else round(1.5 * math.log2(1 + len(t)))]
        for k, b in enumerate(bins):
            x[quality_classifier.DIMS + 32 * k + min(max(b, 0), 31)] = 0.5
        ids = sorted(x)
        raw_score = m.bias + sum(m.w[k] * x[k] for k in ids)
        raw_score += sum(float(m.v[a] @ m.v[b]) * x[a] * x[b] for p, a in enumerate(ids) for b in ids[:p])
        assert any(abs(1 / (1 + math.exp(-raw_score)) - s) < 2e-3 for s in got[i]), (i, got[i])


def test_toxicity_scores_equal_a_plain_chain(spark, labelled, docs, base_rows):
    data, labels = labelled
    chain = toxicity.fit(data, labels)
    rows = [x for x in base_rows if x[1] is None or len(x[1]) < 600][:20] + [(7777, "vilebeast a b vilegoat c vileworm vilebeast")]
    got = collections.defaultdict(list)
    for r in toxicity.score(frame(spark, rows), chain).collect():
        got[r["doc_id"]].append(r["chain"])
    low = lambda n: np.uint64((1 << 8 * n) - 1)
    for i, text in rows:
        counts = collections.Counter()
        for v in plain_words(text):
            b = v.encode()
            counts[word_hash(v) >> 33] += 1
            for k in (5, 6, 7):
                if len(b) >= k:
                    first = np.frombuffer(b[:k].ljust(8, b"\0"), "<u8")
                    counts[int(common.mix64((first & low(k)) * np.uint64(0xA0761D6478BD642F) + np.uint64(k))[0]) >> 33] += 1
        on = set()
        for h, n in counts.items():
            for level, least in enumerate((1, 2, 4, 8)):
                if n >= least:
                    on.add((int(common.mix64(np.array([h * 4 + level], np.uint64))[0]) >> 20) % toxicity.DIMS)
        on = [k for k in on if chain.used[k]]
        earlier = []
        for c, m in enumerate(chain.models):
            raw = m.bias + sum(m.w[k] for k in on) + sum(m.w[toxicity.DIMS + k] * e / 4 for k, e in enumerate(earlier))
            earlier.append(min(max(raw, -6), 6))
        want = [1 / (1 + math.exp(-e)) for e in earlier]
        assert any(np.allclose(want, x, atol=1e-3) for x in got[i]), (i, want, got[i])


def test_a_labelled_id_that_comes_often_is_learnt_from_once(spark, labelled):
    data, labels = labelled
    often = data.unionByName(data.where("doc_id = 2")).unionByName(data.where("doc_id = 2")).unionByName(data.where("doc_id = 1").withColumn("doc_id", F.lit(2).cast("long")))
    rows = often.select(F.col("doc_id").alias("label_id"), "doc_id", "text")
    assert quality_classifier.training_texts(rows).count() == 700
    total = sum(len(r["text"].encode()) for r in quality_classifier.training_texts(rows, 100_000).collect())
    assert 50_000 < total <= 100_000 and quality_classifier.training_texts(rows, 10).count() == 0


def test_later_models_see_out_of_fold_probabilities():
    rng = np.random.default_rng(4)
    n = 600
    first = rng.integers(0, 2, n)
    x = sparse.Sparse(np.arange(n + 1), np.where(first == 1, 3, 4), np.ones(n, np.float32))
    chain = toxicity.fit_chain(x, np.stack([first, first], axis=1).astype(float), ["a", "b"])
    assert chain.models[1].w[toxicity.DIMS] > 0  # the second follows the first
    p = chain.predict(x)
    assert ((p[:, 1] >= 0.5) == (first == 1)).all()


# ---------------------------------------------------------------- WARC

PAGES = "page_id long, url string, html string, uid string, digest string, type string"


def pages_of(spark, rows):
    return spark.createDataFrame([(i, u, h, "clash", "clash", "clash") for i, u, h in rows], PAGES)


ROWS = [
    (1, "http://a/1", "<p>same</p>"), (2, "http://a/2", "<p>same</p>"), (9, "http://a/9", "<p>same</p>"), (3, "http://b/é", "unique é 🙂"),
    (4, None, None), (5, "", ""), (6, "http://c", "WARC/1.1\r\nContent-Length: 5\r\n\r\nhello\r\n\r\nWARC/1.1\r\n"), (None, "http://n", "null id"), (7, "x\r\ny", "z" * 300_000), (8, "http://d", "tail\r\n\r\n"),
]


@pytest.mark.parametrize("least, small", [(0, 1000), (12, 1000), (0, 12)])
def test_warc_round_trip(spark, tmp_path, least, small):
    warc.write_warc(pages_of(spark, ROWS), str(tmp_path / "w"), least, small, 6)
    for f in (tmp_path / "w").glob("*.gz"):
        found = list(warc.parse_warc(f.read_bytes()))
        assert len(found) <= 3 or len(found) <= 6 and all(len(b) < small + 200 for _, b in found)
    got = warc.captures(warc.read_records(spark, str(tmp_path / "w"))).collect()
    assert len(got) == len(ROWS)
    by_digest = collections.defaultdict(list)
    for i, _, h in ROWS:
        by_digest[(h or "").encode()].append(i)
    seen = set()
    for r in got:
        assert len(r["requests"]) == 1 and len(r["metadata"]) == 1
        text = bytes(r["metadata"][0]["payload"]).decode()
        page = None if "none" in text else int(text.split(": ")[1])
        seen.add(page)
        html = next((h or "") for i, _, h in ROWS if i == page).encode()
        resp = r["response"]
        assert resp["payload_digest"] == "sha1:" + base64.b32encode(hashlib.sha1(html).digest()).decode()
        assert resp["http_length"] == len(html) and resp["http_status"] == 200
        ids = [x if x is not None else -(2**70) for x in by_digest[html]]
        leader = max(ids)
        if len(html) < least or (page if page is not None else -(2**70)) == leader:
            assert resp["type"] == "response" and resp["refers_to"] is None and bytes(resp["payload"]) == html
        else:
            assert resp["type"] == "revisit" and f":{leader}:" in resp["refers_to"] and bytes(resp["payload"]) == b""
    assert seen == {i for i, _, _ in ROWS}


def test_warc_repeated_rows_and_empty_tables(spark, tmp_path):
    warc.write_warc(pages_of(spark, [(1, "u", "same")] * 3), str(tmp_path / "r"))
    kinds = collections.Counter(r["response"]["type"] for r in warc.captures(warc.read_records(spark, str(tmp_path / "r"))).collect())
    assert kinds == {"response": 1, "revisit": 2}
    warc.write_warc(pages_of(spark, []), str(tmp_path / "e"))
    assert warc.captures(warc.read_records(spark, str(tmp_path / "e"))).count() == 0


def test_warc_of_shuffled_rows_has_a_response_for_each_payload(spark, tmp_path):
    pages = pages_of(spark, [(k % 5, "u", f"page {k % 3}") for k in range(60)]).repartition(4).orderBy("page_id")
    warc.write_warc(pages, str(tmp_path / "s"))
    got = warc.captures(warc.read_records(spark, str(tmp_path / "s"))).collect()
    responses = {r["record_id"] for r in got if r["response"]["type"] == "response"}
    assert len(got) == 60 and len(responses) == 3 and {r["response"]["refers_to"] for r in got} == {None, *responses}


def test_warc_query_reads_sizes_and_digests_from_the_payload(spark, tmp_path, monkeypatch):
    pages_of(spark, ROWS).write.parquet(f"{tmp_path}/pages.parquet")
    honest = {r["page_id"]: r for r in warc.op10_warc(spark, str(tmp_path)).collect()}
    assert honest[1]["record_type"] == "revisit" and honest[1]["refers_to"] == 9 and honest[1]["payload_digest"] == honest[9]["payload_digest"]
    real = warc.parse_warc
    monkeypatch.setattr(warc, "parse_warc", lambda data: ((f, b.replace(b"<p>same</p>", b"<p>SAME</p>!")) for f, b in real(data)))
    damaged = {r["page_id"]: r for r in warc.op10_warc(spark, str(tmp_path)).collect()}
    want = base64.b32encode(hashlib.sha1(b"<p>SAME</p>!").digest()).decode()
    assert {damaged[k]["payload_digest"] for k in (1, 2, 9)} == {want} and damaged[1]["payload_bytes"] == 12
    assert damaged[3]["payload_digest"] == honest[3]["payload_digest"]


def test_warc_reads_member_per_record_and_odd_records(spark, tmp_path):
    def record(kind, n, block, *more):
        return b"\r\n".join([b"WARC/1.0", b"WARC-Type: " + kind, b"WARC-Record-ID: <urn:%d>" % n, *more, b"Content-Length: %d" % len(block), b"", block]) + b"\r\n\r\n"

    parts = [record(b"warcinfo", 0, b"software: x"), record(b"response", 1, b"HTTP/1.1 404 Gone\r\nContent-Length: 3\r\n\r\nabc", b"Content-Type: application/http; msgtype=response"), record(b"request", 2, b"GET / HTTP/1.1\r\n\r\n", b"WARC-Concurrent-To: <urn:1>"), record(b"metadata", 3, b"a: b", b"WARC-Concurrent-To: <urn:77>"), record(b"response", 4, b"", b"WARC-Concurrent-To: <urn:2>")]
    (tmp_path / "m.warc.gz").write_bytes(b"".join(gzip.compress(p) for p in parts))
    (tmp_path / "p.warc").write_bytes(b"")
    got = {r["record_id"]: r for r in warc.captures(warc.read_records(spark, str(tmp_path))).collect()}
    assert set(got) == {"<urn:1>", "<urn:4>"}
    assert got["<urn:1>"]["response"]["http_status"] == 404 and bytes(got["<urn:1>"]["response"]["payload"]) == b"abc"
    assert len(got["<urn:1>"]["requests"]) == 1 and got["<urn:1>"]["metadata"] == [] and got["<urn:4>"]["requests"] == []


# ---------------------------------------------------------------- components


def test_components_match_union_find(spark):
    rng = random.Random(2)
    edges = [(rng.randint(-50, 250), rng.randint(-50, 250)) for _ in range(180)] + [(k, k + 1) for k in range(1000, 1060)] + [(7, 7)]
    forest = simhash.Forest(2000)
    pairs = np.array([(a + 100, b + 100) for a, b in edges if a != b])
    forest.link(pairs[:, 0], pairs[:, 1])
    root = forest.root(np.arange(2000)) - 100
    got = components.connected_components(spark.createDataFrame(edges, "u long, v long"))
    have = {(r["u"], r["root"]) for r in got.collect()}
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    assert have == {(x, int(root[x + 100])) for x in nodes}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


# ---------------------------------------------------------------- pipeline


def test_pipeline_stage_by_stage(spark, labelled, tmp_path):
    import corpus_pipeline

    data, labels = labelled
    extra = frame(spark, [(9000 + k, t["text"]) for k, t in enumerate(data.where("doc_id in (1, 2, 3)").collect())])
    item = " ".join(data.where("doc_id = 11").first()["text"].split()[3:25])
    root = str(tmp_path)
    data.unionByName(extra).write.parquet(f"{root}/documents.parquet")
    labels.write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    docs, ids = spark.read.parquet(f"{root}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, root)
        assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == docs.columns
        out.write.parquet(f"{root}/{k}")
        docs = spark.read.parquet(f"{root}/{k}")
        ids.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    assert sum(i % 5 == 0 for i in ids[0]) <= 7 and sum(i % 5 != 0 for i in ids[0]) >= 540
    assert ids[1] == ids[0] and {9000, 9001, 9002} <= ids[1] and not {9000, 9001, 9002} & ids[2]
    assert 11 in ids[2] and ids[3] == ids[2] - {11} and ids[4] == ids[3]
    assert docs.columns[:4] == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, root).collect()} == ids[4]


def test_pipeline_on_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    root = str(tmp_path)
    spark.createDataFrame([], DOCS).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    assert corpus_pipeline.run(spark, root).count() == 0


def test_pipeline_stages_take_odd_rows(spark, labelled, docs, base_rows, tmp_path):
    import corpus_pipeline

    _, labels = labelled
    root = str(tmp_path)
    data = docs.unionByName(docs.where("doc_id in (1, 201, 205) or doc_id is null"))
    labels.where("false").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, "nothing of the kind is in any text at all here now"), (None, None), (2, "")], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    n = data.count()
    quality, lines, near, clean, bpe = (f for _, f in corpus_pipeline.STAGES)
    count = lambda d: collections.Counter((r["doc_id"], r["text"], r["score"], r["lang"]) for r in d.collect())
    assert count(quality(spark, data, root)) == count(data)
    after = lines(spark, data, root)
    assert after.columns == data.columns and after.count() == n
    assert {r["text"] for r in after.where("doc_id = 200").collect()} == {None} and {r["text"] for r in after.where("doc_id = 201").collect()} == {"", *([None] if (201, None) in base_rows else [])}
    kept = near(spark, data, root)
    ids = collections.Counter(r["doc_id"] for r in kept.collect())
    assert kept.columns == data.columns and ids[1] == 4 and not {100, 101} & set(ids) and None in ids
    blank = [i for i, t in base_rows if not (t or "").strip(" \n\t")]
    assert sum(i in ids for i in set(blank)) == 1
    assert count(clean(spark, data, root)) == count(data)
    out = bpe(spark, data, root)
    assert out.count() == n and {r["n_tokens"] for r in out.where("doc_id = 200").collect()} == {0}

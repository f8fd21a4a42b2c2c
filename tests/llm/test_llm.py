"""The operators on edge cases, against brute force and against their oracle SQL."""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from oracle import same
from pyspark.sql import functions as F

from wardline.llm import bpe, decontamination, embedding_dedup, jaccard_join, language_id, quality, registry, sharding, substring_dedup, toxicity, url_filters

SF = "/root/testdata/sf0.001"
CLASH = {"n_words": "long", "n_removed": "long", "kept": "string", "score": "double", "shard": "int", "slot": "long", "lang_pred": "string", "ids": "string", "d1": "int", "_unit": "int", "class_id": "long", "host": "string", "verdict": "string"}
PASSAGE = " ".join(f"shared{i}" for i in range(30))


def edge(spark):
    """Nulls, empty and long texts, ties and repeated rows, with extra columns of clashing names."""
    long = " ".join(f"word{i % 997} x{i}" for i in range(20_000))
    texts = [(1, None), (2, ""), (3, "   \n "), (4, "one"), (5, long), (6, f"before {PASSAGE} after"), (7, f"{PASSAGE} tail of seven"), (7, f"{PASSAGE} tail of seven"), (None, f"null id {PASSAGE}"), (8, "ha " * 40), (9, "ho " + "ha " * 20 + "end"), (10, long), (11, "É" * 3000 + " 123 $$$"), (12, "one")]
    schema = "doc_id long, text string, lang string, " + ", ".join(f"{k} {v}" for k, v in CLASH.items())
    return spark.createDataFrame([(i, t, None if i == 4 else "en", *[None] * len(CLASH)) for i, t in texts], schema)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_oracle(spark, name):
    same(spark, SF, registry.QUERIES[name], registry.ORACLE[name])


def test_empty_tables(spark):
    d = edge(spark).limit(0)
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.hits(d, items).count() == 0
    assert decontamination.hits(edge(spark), items).where("size(spans) > 0").count() == 0
    assert language_id.predict(d, language_id.fit(d.select("lang", "text"))).count() == 0
    assert jaccard_join.jaccard_join(d).count() == 0
    assert substring_dedup.remove_repeats(d).count() == 0
    assert sharding.shard(d, 3).count() == 0
    assert url_filters.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0
    assert embedding_dedup.link(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    assert quality.score(d, *quality.fit(d)).count() == 0
    assert toxicity.train([], np.zeros(0, int)).scores(["x"], defaultdict(float))[0] < 0.01


def test_decontamination(spark):
    items = spark.createDataFrame([(1, PASSAGE.upper()), (2, "One"), (3, None), (4, "--"), (None, "word1"), (10, " ".join(PASSAGE.split()[5:16]))], "item_id long, text string")
    got = {(r.doc, r.n_words): r for r in decontamination.hits(edge(spark), items).collect()}
    r = got[6, 32]
    assert r["items"] == ["1", "10"] and r.spans[0].start == 1 and r.spans[-1].end == 31
    assert got[4, 1]["items"] == ["2"] and got[1, 0]["items"] == [] and got[5, 40_000]["items"] == []
    assert [tuple(s) for s in got[5, 40_000].spans] == [(2 * i, 2 * i + 1) for i in range(20_000) if i % 997 == 1]  # an item without an id counts
    assert decontamination.hits(edge(spark), items).count() == 14
    left = decontamination.decontaminate(edge(spark), items)
    assert sorted(r.doc_id for r in left.collect()) == [1, 2, 3, 8, 9, 11] and left.columns == edge(spark).columns


def test_native_plan(spark):
    got = registry.QUERIES["op1_decontaminate"](spark, SF)
    plan = got._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct", plan)


def test_language(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    f = language_id.fit(d.where("doc_id % 4 <> 1").select("lang", "text"))
    assert "und" not in f.langs
    got = language_id.predict(d, f).where("doc_id % 4 = 1 and lang is not null and length(text) > 100")
    assert got.where("lang = lang_pred").count() / got.count() > 0.97
    e = {(r.doc_id, r.lang_pred, r.score == 0) for r in language_id.predict(edge(spark), f).collect()}
    assert {(1, "und", True), (2, "und", True), (3, "und", True)} <= e and len(e) == 13
    codes = np.array([10, 20, 30])
    both = language_id.Filters.build(["a", "b"], [(0, 10), (0, 20), (1, 20), (1, 30)], 12)
    mask = both.slots[both._slot(codes.astype(np.uint32), language_id.HASHES[0], 12)]
    assert mask[1] & 3 == 3 and mask[0] & 1 and mask[2] & 2


def encoding():
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return path, P.PATTERN, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(spark):
    path, pattern, want = encoding()
    odd = spark.createDataFrame([(20, "it's  a\t\tb \n\n c d\x00e "), (21, "ab" * 5000), (22, "<|endoftext|> …ß" + " " * 9), (23, " 12345 ,;")], "doc_id long, text string")
    d = edge(spark).select("doc_id", "text").union(odd)
    got = bpe.encode(d, path, pattern, decoded=True)
    texts = defaultdict(list)
    for r in d.collect():
        texts[r.doc_id].append(r.text or "")
    n = 0
    for r in got.collect():
        t = texts[r.doc_id][0]
        assert list(r.ids) == want.encode_ordinary(t) and bytes(r.decoded) == t.encode()
        n += 1
    assert n == 18
    again = bpe.decode(got.drop("decoded"), path, pattern)
    assert rows(again.select("doc_id", "decoded")) == rows(got.select("doc_id", "decoded"))


def sets_of(text, n=5):
    w = (text or "").lower().encode().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute_links(texts: dict):
    sets, root = {i: sets_of(t) for i, t in texts.items()}, {i: i for i in texts}
    near = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            near[g].append(i)
    both = Counter((a, b) for ids in near.values() for a in ids for b in ids if a < b)
    links = Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), n in both.items():
        if n / (len(sets[a]) + len(sets[b]) - n) >= 0.8:
            links[a] += 1
            links[b] += 1
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (find(i), links[i]) for i in texts}


def test_jaccard(spark, monkeypatch):
    base = [f"w{i}" for i in range(120)]
    texts = {i: " ".join(base[:40] + [f"v{i}"] * (i % 2) + base[40:]) for i in range(30)} | {100: None, 101: "", 102: "a b", 103: "A b", 104: " ".join(base[:60]), 105: "zz " * 50, 106: "zz " * 70}
    d = spark.createDataFrame([*texts.items(), (None, "a b")], "doc_id long, text string")
    want = brute_links(texts | {1000: "a b"})
    want[None] = want.pop(1000)  # the row without an id
    for near, verify, tile in ((1000, 400_000, 512), (7, 500, 3)):
        monkeypatch.setattr(jaccard_join, "NEAR", near)
        monkeypatch.setattr(jaccard_join, "VERIFY", verify)
        monkeypatch.setattr(jaccard_join, "TILE", tile)
        got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.jaccard_join(d).collect()}
        assert got == want
    real = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r.doc_id: (r.class_id, r.n_links) for r in registry.QUERIES["op5_jaccard_join"](spark, SF).collect()} == brute_links(real)


def test_bayes():
    least = jaccard_join.least_matches(0.8)
    assert least == sorted(least) and all(0 < m < n * 0.8 for m, n in zip(least, range(16, 65, 16)))


def brute_repeats(docs):
    first = {}
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in docs]
    for (i, _), w in zip(docs, words):
        for k in range(len(w) - 12):
            g = tuple(w[k : k + 13])
            first[g] = min(first.get(g, i), i)
    out = []
    for (i, _), w in zip(docs, words):
        gone = {k + j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for j in range(13)}
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


def test_repeats(spark):
    draw = np.random.default_rng(0)
    docs = [(r.doc_id, r.text) for r in edge(spark).where("doc_id is not null").collect()]
    for i in range(200):
        parts = []
        for _ in range(draw.integers(1, 6)):
            kind, at, n = draw.integers(0, 3), int(draw.integers(0, 40)), int(draw.integers(1, 30))
            parts += [f"s{(at + k) % 60}" for k in range(n)] if kind == 0 else ["que"] * n if kind == 1 else [f"r{draw.integers(0, 5)}" for _ in range(n)]
        docs.append((50 + i, " ".join(parts)))
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"kept": F.lit("x"), "_unit": F.lit(1)})
    got = substring_dedup.remove_repeats(d)
    assert rows(got.select("doc_id", "n_words", "n_removed", "kept")) == brute_repeats(docs)
    null = {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(edge(spark)).collect()}
    assert null[None] == 30 and null[6] == 0 and null[7] == 30


def test_quality(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labellers, scorer = quality.fit(d)
    got = quality.score(d, labellers, scorer).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").toPandas()
    good, bad = got[got.quality == 1].score, got[got.quality == 0].score
    assert (good >= 0.5).mean() > 0.9 and good.mean() > bad.mean() + 0.2
    e = quality.score(edge(spark), labellers, scorer).collect()
    assert len(e) == 14 and all(0 <= r.score <= 1 for r in e)
    truth = np.random.default_rng(1).random(4000) < 0.6
    right = np.array([0.9, 0.8, 0.7, 0.6])
    votes = np.where(np.random.default_rng(2).random((4000, 4)) < right, truth[:, None], ~truth[:, None]) * 2 - 1
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    fit = quality.Labellers.fit(patterns, counts.astype(float))
    assert np.allclose(fit.like[1, :, 2], right, atol=0.08)


def test_toxicity(spark):
    draw = np.random.default_rng(3)
    texts, labels = [], []
    for i in range(400):
        words = [f"w{draw.integers(0, 300)}" for _ in range(draw.integers(20, 200))]
        bad = i % 4 == 0
        if bad:
            words[draw.integers(0, len(words))] = "nasty" if i % 8 else "nastyish"
        texts.append(" ".join(words))
        labels.append(int(bad))
    model = toxicity.train(texts, np.array(labels))
    d = spark.createDataFrame([*enumerate(texts), (1000, "quite a nastyy word"), (1001, None), (1002, "")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score(d, model).collect()}
    right = np.mean([(got[i] >= 0.3) == bool(y) for i, y in enumerate(labels)])
    assert right > 0.95 and got[1000] >= 0.3 and got[1001] == got[1002] < 0.3
    assert toxicity.score(edge(spark), model).count() == 14


def test_embeddings(spark, monkeypatch):
    draw = np.random.default_rng(4)
    base = draw.normal(size=(6, 16))
    vecs = [(i, [float(x) for x in base[i % 6] + draw.normal(size=16) * 0.12], i % 2) for i in range(120)]
    vecs += [(200, None, 0), (201, [0.0] * 16, 0), (202, [float("nan")] + [1.0] * 15, 0), (203, [None] + [1.0] * 15, 0), (204, vecs[0][1], None), (205, vecs[0][1], 0), (206, vecs[0][1], 0), (207, [1.0, 2.0], 0)]
    df = spark.createDataFrame([(*v, 1) for v in vecs], "vec_id long, embedding array<float>, label int, kept int")
    x = {i: np.array(e, np.float32).astype(float) for i, e, l in vecs if e and l is not None and len(e) == 16 and all(v is not None and np.isfinite(v) for v in e) and any(e)}
    label = {i: l for i, _, l in vecs}
    want = {i: sum(j != i and label[i] == label[j] and x[i] @ x[j] / np.linalg.norm(x[i]) / np.linalg.norm(x[j]) >= 0.93 for j in x) for i in x}
    for near in (1500, 4):
        monkeypatch.setattr(embedding_dedup, "NEAR", near)
        got = {r.vec_id: r for r in embedding_dedup.link(df).collect()}
        assert len(got) == 128 and {i: got[i].n_links for i in x} == want
        assert all(got[i].n_links == 0 and got[i].kept for i in (200, 201, 202, 203, 204, 207))
        assert got[205].component_id == got[206].component_id == got[0].component_id


def test_urls(spark):
    cases = {1: (None, "", "", None, "allow"), 2: ("nothing", "", "", None, "allow"), 3: ("HTTP://A.Example.ORG/es/x?q#f", "a.example.org", "/es/x", "example.org/es/", "block"), 4: ("x://org", "org", "", None, "allow"), 5: ("http://b.com/de/", "b.com", "/de/", "com/de/", "block"), 6: ("http://xcom/de/", "xcom", "/de/", None, "allow"), 7: ("http://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"), 8: ("http://h?x=://y/z", "h", "", None, "allow")}
    d = spark.createDataFrame([(k, v[0], "x") for k, v in cases.items()], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.judge(d).collect()}
    assert got == {k: v[1:] for k, v in cases.items()}
    many = spark.createDataFrame([(i, f"http://bad.com/de/{i}") for i in range(60)] + [(99, "http://bad.com/xx/")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in url_filters.judge(many).collect()}[99] == "block"


def test_shards(spark):
    d = spark.createDataFrame([(i, f"t{i}") for i in range(1003)] + [(5, "t5")] * 3 + [(None, None)], "doc_id long, text string").withColumn("shard", F.lit(9))
    got = sharding.shard(d, 7, rows_per_task=20).toPandas()
    n = got.groupby("shard").slot.agg(["count", "min", "max", "nunique"])
    assert len(got) == 1007 and n["count"].max() - n["count"].min() <= 1 and (n["min"] == 0).all() and (n["max"] == n["count"] - 1).all() and (n["nunique"] == n["count"]).all()
    again = sharding.shard(d.repartition(3), 7, rows_per_task=20).toPandas()
    assert set(map(tuple, got.dropna()[["doc_id", "shard"]].drop_duplicates().values)) == set(map(tuple, again.dropna()[["doc_id", "shard"]].drop_duplicates().values))
    m = sharding.communication_matrix([10, 0, 25], 4, 1)
    assert m.sum(axis=1).tolist() == [10, 0, 25] and sorted(m.sum(axis=0)) == [8, 9, 9, 9]
    assert abs(np.corrcoef(got.dropna().doc_id, got.dropna().slot)[0, 1]) < 0.15


def test_contracts(spark):
    d = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = registry.QUERIES["op10_shard_documents"](spark, SF).collect()
    for r in got:
        raw = (d[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
    tox = registry.QUERIES["op4_toxicity"](spark, SF).collect()
    assert len(tox) == len(d) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.3) for r in tox)


def test_pipeline(spark):
    """run() against the same stages by brute force."""
    import corpus_pipeline

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    texts = {i: t for i, t in docs.items() if t and re.search(r"[^\W\d_]", t)}
    classes = brute_links(texts)
    texts = {i: t for i, t in texts.items() if classes[i][0] == i}
    kept = {}
    for i, n, gone, text in brute_repeats(sorted(texts.items())):
        if gone < n or not gone:
            kept[i] = text if gone else texts[i]
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(low))
    grams = defaultdict(set)
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = word(r.text)
        for k in range(max(1, len(w) - 9)):
            grams[min(10, len(w))].add(tuple(w[k : k + 10]))
    clean = {i: t for i, t in kept.items() if not any(tuple(w[k : k + n]) in gs for w in [word(t)] for n, gs in grams.items() if n for k in range(len(w) - n + 1))}
    enc = encoding()[2]
    want = {i: (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, t in clean.items() for ids in [enc.encode_ordinary(t)]}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "jaccard_join", "substring_dedup", "decontaminate", "byte_bpe"]

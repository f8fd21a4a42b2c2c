"""Operators 11 to 13 against brute force, and on odd tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F
from test_llm import SF, edge

from wardline.llm import periodic_runs, personal_data, token_alignment

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def whole(spark, sf=SF):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


def digest(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


# ---- 13: periodic runs


def brute_runs(ws, least=12):
    """All maximal stretches of a period, smallest periods first, and the words left."""
    n, runs = len(ws), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if ws[i] != ws[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and ws[i] == ws[i + q]:
                i += 1
            if i + q - s >= max(least, 2 * q):
                runs.setdefault((s, i + q), q)
    gone = {j for (s, e), q in runs.items() for j in range(s + q, e)}
    return sorted(((s, e - s, q) for (s, e), q in runs.items()), key=lambda r: (r[0], r[2])), b" ".join(w for j, w in enumerate(ws) if j not in gone)


def fibonacci(n):
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def test_runs_against_brute_force():
    draw = random.Random(3)
    for _ in range(250):
        texts = []
        for _ in range(draw.randint(0, 6)):
            n, alphabet = draw.choice([0, 1, 11, 12, 13, 40, 90, 200]), draw.choice([2, 3, 50])
            t = [b"%d" % draw.randint(0, alphabet) for _ in range(n)]
            kind = draw.randint(0, 4)
            if kind == 0:
                t = fibonacci(n)
            elif kind == 1 and n:
                a = draw.randrange(n)
                p = 1 + (n - a) // (3 + draw.randint(0, 7))
                t = t[:a] + [t[a + (i - a) % p] for i in range(a, n)]
            elif kind == 2:
                t = (t[:17] * 20)[:n]
            texts.append(t)
        for least in (12, 5):
            got = [([tuple(x) for x in r.tolist()], c) for r, c in periodic_runs.collapse(texts, least)]
            assert got == [brute_runs(t, least) for t in texts]


def test_runs_when_names_collide(monkeypatch):
    """Blocks whose names are equal by chance make no runs: what is reported is compared word by word."""
    monkeypatch.setattr(periodic_runs, "mix", lambda x: x & np.uint64(3))
    draw = random.Random(4)
    for _ in range(60):
        t = [b"%d" % draw.randint(0, 4) for _ in range(60)] + [b"x", b"y"] * 9
        runs, left = periodic_runs.collapse([t])[0]
        assert {(40 + 20, 18, 2)} <= {tuple(r) for r in runs.tolist()} and all(t[s + i] == t[s + i + q] for s, n, q in runs.tolist() for i in range(n - q))


def test_long_runs():
    for t in ([b"ha"] * 100_000, fibonacci(30_000), [b"%d" % (i % 1000) for i in range(100_000)]):
        runs, left = periodic_runs.collapse([t])[0]
        s, n, q = max(runs.tolist(), key=lambda r: r[1])
        assert n >= 0.6 * len(t) and len(left.split()) < len(t) / 5


def test_runs_query(spark):
    docs = whole(spark)
    got = {r.doc_id: r for r in periodic_runs.op13_periodic_runs(spark, SF).collect()}
    assert got.keys() == docs.keys() and sum(r.n_runs > 0 for r in got.values()) > 10
    for i, text in docs.items():
        ws, h = (text or "").encode().split(), zlib.crc32(str(i).encode())
        n, g = len(ws), h // 10
        if n > 1200:
            continue
        if h % 10 == 0 and n > 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            ws = [ws[k] if k < a else ws[a + (k - a) % p] for k in range(n)]
        runs, left = brute_runs(ws)
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        r = got[i]
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *(best or (None,) * 3)) and r.exponent_milli == (best and 1000 * best[1] // best[2])
        assert r.runs_sha256 == digest("".join(f"{s},{k},{q}\n" for s, k, q in runs)) and r.collapsed_sha256 == hashlib.sha256(left).hexdigest() and r.n_words == n


def test_runs_on_odd_rows(spark):
    d = edge(spark)
    got = periodic_runs.find_runs(d)
    assert got.columns == ["doc_id", "n_words", "runs", "collapsed"]
    rows = {(r.doc_id, r.n_words): r for r in got.collect()}
    assert got.count() == 14 and [tuple(x) for x in rows[8, 40].runs] == [(0, 40, 1)] and rows[8, 40].collapsed == "ha"
    assert rows[9, 22].collapsed == "ho ha end" and rows[1, 0].runs == [] and rows[1, 0].collapsed == rows[2, 0].collapsed == ""
    assert periodic_runs.find_runs(d.limit(0)).count() == 0


# ---- 12: alignment of tokenizers


def test_perfect_hash():
    draw = np.random.default_rng(1)
    for n in (0, 1, 2, 63, 1000, 40_000):
        keys = np.unique(draw.integers(0, 1 << 63, n, dtype=np.uint64))
        h = token_alignment.Hash.unpack(token_alignment.Hash.of(keys).pack())
        assert sorted(h(keys).tolist()) == list(range(len(keys)))
        other = draw.integers(0, 1 << 63, 500, dtype=np.uint64)
        assert len(h(other)) == 500 and (h(other) <= len(keys)).all()
    big = np.unique(draw.integers(0, 1 << 63, 30_000, dtype=np.uint64))
    assert 8 * len(token_alignment.Hash.of(big).pack()) / len(big) < 6  # bits a key


def brute_alignment(docs):
    """Rows of `align` by the tokenizers' own libraries and sets of offsets; docs: pairs of an id and a text."""
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    byte = {c: i for i, c in enumerate(token_alignment.byte_letters())}
    count, rows = Counter(), []
    for i, t in docs:
        x, y = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        xs = [bytes(byte[c] for c in a.id_to_token(k)) for k in x]
        ys = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode() for p in map(b.id_to_piece, y)]
        if t and not b"".join(xs) == b"".join(ys) == (" " + t).encode():
            x, y, xs, ys = [], [], [], []
        ends = [np.cumsum([len(w) for w in ws]).tolist() for ws in (xs, ys)]
        groups, at = [], (0, 0)
        for c in sorted(set(ends[0]) & set(ends[1])):
            to = ends[0].index(c) + 1, ends[1].index(c) + 1
            groups.append((x[at[0] : to[0]], y[at[1] : to[1]]))
            at = to
        links = [(g[0][-1], g[1][-1]) for g in groups]
        count.update(links)
        rows.append((i, len(x), len(y), groups, links))
    best = defaultdict(int)
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    text = lambda gs: ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in gs)
    return sorted(((i, na, nb, len(gs), len(ls), sum(count[p] == best[p[1]] for p in ls), sum(count[p] for p in ls), text(gs)) for i, na, nb, gs, ls in rows), key=repr), count


def test_alignment(spark):
    odd = ["<|endoftext|> <s>", "  two  spaces ", "▁ its own sign", "naïve ﬁ ①", "\x00 zero", "日本語 text", "a" * 3000, "\n\n", "it's 12 345"]
    d = edge(spark).select("doc_id", "text").union(spark.createDataFrame([(50 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    want, count = brute_alignment([tuple(r) for r in d.collect()])
    for bucket, slice_ in ((token_alignment.BUCKET, token_alignment.SLICE), (50, 3)):  # one pass, and many
        assert sorted(map(tuple, token_alignment.align(d, bucket=bucket, slice_=slice_).collect()), key=repr) == want
    files = token_alignment.installed()
    tokens = token_alignment.encoded(d, files, "doc_id", "text")
    links = token_alignment.linked(tokens.repartition(5), files)
    table = token_alignment.pair_counts(token_alignment.counted(links, token_alignment.hashed(links, 40), 2))
    assert {(r.a_id, r.b_id): r.links for r in table.collect()} == count
    assert token_alignment.align(edge(spark).limit(0)).count() == 0


def test_alignment_query(spark):
    want, _ = brute_alignment(whole(spark).items())
    got = sorted(map(tuple, token_alignment.op12_token_alignment(spark, SF).collect()), key=repr)
    assert got == sorted(((*r[:-1], digest(r[-1]) if r[1] else "") for r in want), key=repr)


def test_fast_encoder_is_the_file(spark):
    """Ids of A come from ranks; they are those of the file that it is defined by."""
    from tokenizers import Tokenizer

    p = token_alignment.pair(token_alignment.installed())
    t = Tokenizer.from_file(p.a_file)
    t.encode_special_tokens = True
    draw = random.Random(1)
    some = [chr(c) for c in range(0x20, 0x17F)] + list(" \n\t\r\x0b 　́漢字😀١²ⅷ'’")
    for n in range(400):
        s = "".join(draw.choice(some) for _ in range(draw.randint(0, 80)))
        assert p.encode_a(s) == t.encode(s, add_special_tokens=False).ids
    s = "x" + " " * 1_000_000 + "y"
    assert p.encode_a(s) == t.encode(s, add_special_tokens=False).ids


# ---- 11: personal data


def luhn(digits):
    d = [int(c) for c in reversed(digits)]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def brute_base(text):
    def fits(kind, s):
        digits = re.sub(r"\D", "", s)
        return {"email": True, "ip": all(int(x) <= 255 for x in s.split(".")) if kind == "ip" else 0, "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]

    return [(k, m.start(), m.end()) for k, (kind, p) in enumerate(BASE.items()) for m in re.finditer(p, text or "") if fits(kind, m.group())]


def test_base_against_the_patterns():
    draw, n = random.Random(5), 0
    for _ in range(30_000):
        letters = draw.choice(["ab@.-_ 1", "0123456789 -", "0129. ", "+0123456789 ().-", "a@.b1 +é"])
        x = "".join(draw.choice(letters) for _ in range(draw.randint(0, 40)))
        if draw.random() < 0.2:
            x += " 4111 1111 1111 1111 " + x
        want = brute_base(x)
        assert personal_data.base(x) == want, x
        n += len(want)
    assert n > 2000
    for x in ("a" * 300_000 + "@", "1" * 300_000, "1." * 200_000, "+1 " * 100_000, "1 " * 200_000, "1234 " * 50_000, "a@b.c " * 20_000):  # in linear time
        personal_data.candidates(x, personal_data.base(x))


def bootstrapped(spans, rounds):
    """The trust of `bootstrap`, by dictionaries."""
    seeds = {(s["kind"], s["name"]) for s in spans if s["seed"]}
    pats = lambda s: {f: (f, s["kind"], *(s[c] for c in cols)) for f, cols in personal_data.FAMILIES.items()}
    support, mine = defaultdict(set), defaultdict(set)
    for s in spans:
        for p in pats(s).values():
            (support if s["seed"] else mine)[p].add((s["kind"], s["name"]))
    trust = {(s["kind"], s["name"]): 1.0 for s in spans if not s["seed"] and (s["kind"], s["name"]) in seeds}
    for _ in range(rounds):
        conf = {p: (len(support[p]) + sum(trust.get(i, 0) for i in got)) / (len(support[p]) + len(got) + personal_data.PRIOR) for p, got in mine.items()}
        new = dict(trust)
        for s in spans:
            if s["seed"]:
                continue
            c = {f: conf[p] for f, p in pats(s).items()}
            beside = max(c["before"], c["before2"], c["after"], c["both"])
            ways = [c["form"]] if c["form"] >= 0.9 else []
            ways += [min(c["form"], beside)] if min(c["form"], beside) >= 0.5 else []
            ways += [min(c["before2"], c["after"])] if min(c["before2"], c["after"]) >= 0.8 else []
            ways += [c["both"]] if c["both"] >= 0.8 else []
            i = s["kind"], s["name"]
            if ways:
                new[i] = max(new.get(i, 0), *ways)
        done, trust = len(new) == len(trust), new
        if done:
            break
    return trust


def test_bootstrap(spark):
    draw = random.Random(8)
    spans = []
    for _ in range(700):
        kind = draw.randint(0, 1)
        spans.append({"kind": kind, "name": f"n{draw.randint(0, 90)}", "seed": draw.random() < 0.7, "form": f"f{draw.choice([0, 0, 0, 1, 2])}", "before": f"b{draw.randint(0, 6)}", "before2": f"c{draw.randint(0, 9)}", "after": f"a{draw.randint(0, 5)}"})
    spans += [{"kind": 0, "name": f"only{i}", "seed": False, "form": f"new{i % 3}", "before": "b1", "before2": f"d{i % 4}", "after": "a1"} for i in range(20)]
    df = spark.createDataFrame([tuple(s.values()) for s in spans], "kind int, name string, seed boolean, form string, before string, before2 string, after string")
    for rounds in (1, 4):
        got = {(r.kind, r.name): r.trust for r in personal_data.bootstrap(df, rounds).collect()}
        want = bootstrapped(spans, rounds)
        assert got.keys() == want.keys() and 10 < len(got) and all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_patterns_discover_what_base_misses(spark):
    """Addresses and numbers written otherwise are found where seeds stand; like numbers elsewhere are left alone."""
    rows = [(i, f"note {i % 7} please mail person{i}@mail{i % 5}.example.com today, or call +1 (2{i % 80 + 10}) 555-0{i % 90 + 100} before noon") for i in range(300)]
    odd = {
        1000: "note 1 please mail jane (at) mail3.example (dot) com today, or rest", 1001: "or call +1 (269) 555-3296 4524132264652877 before noon",
        1002: "on page 1234567890 of the book", 1003: "isbn 978-3-16-148410-0 is a book", 1004: "password=135299847ac0e0f0dc 5555 4444", 1005: "look (at) home.page (dot) net for more",
    }
    d = spark.createDataFrame([*rows, *odd.items(), (None, None), (7, ""), (1000, odd[1000])], "doc_id long, text string").withColumn("base", F.lit(1))
    got = defaultdict(list)
    for r in personal_data.extract(d).collect():
        got[r.doc_id].append(r)
    assert sum(map(len, got.values())) == 309 and len(got[1000]) == 2
    text = lambda i: [odd[i][s.start : s.end] for s in got[i][0].added]
    assert text(1000) == ["jane (at) mail3.example (dot) com"] and text(1001) == ["+1 (269) 555-3296"]
    assert all(not got[i][0].added for i in (1002, 1003, 1004, 1005, None, 7)) and all(len(r.base) == 2 and not r.added for i in range(300) for r in got[i] if i != 7)
    assert personal_data.extract(edge(spark)).count() == 14 and personal_data.extract(edge(spark).limit(0)).count() == 0


def test_personal_query(spark):
    docs = whole(spark, "/root/testdata/sf0.01")
    got = personal_data.op11_personal_data(spark, "/root/testdata/sf0.01").collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        want = brute_base(docs[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == j for k, _, _ in want) for j in range(4)]
        names = [f"{list(BASE)[k]}:{s}:{e}" for k, s, e in want]
        assert r.base_sha256 == digest(",".join(names)) and set(names) <= set(filter(None, r.spans.split(","))) and len(names) + r.n_added == len([x for x in r.spans.split(",") if x])

"""Operator 11: personal data, by fixed patterns and by bootstrapped contextual extraction."""

from __future__ import annotations

import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm.common import bounded, kept, read, settle, ship

KINDS = ("email", "ip", "card", "phone")
#: Characters of context on either side, rounds of the bootstrapping at most, and what is added to a pattern's extractions.
REACH, ROUNDS, PRIOR = 64, 4, 2.0
#: Trusted instances that are sent to all tasks at most; more are joined by exchange.
SENT = 100_000
#: Trust in an instance: by its form alone; by form and context; by what stands before and what stands after.
FORM, BOTH, AROUND = 0.9, 0.5, 0.8

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# What precedes a match of these two is told by where they may begin: nothing is tried twice, so long runs take linear time.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Wider shapes, whose matches are candidates.
_NUMBER = re.compile(r"\+?\(?[0-9](?:[ ().-]{0,3}[0-9])*")
_AT = re.compile(r" ?(?:@|[(\[{] ?at ?[)\]}]) ?", re.I)
_NAME = re.compile(r"[A-Za-z0-9-]+(?:(?:\.| ?[(\[{] ?dot ?[)\]}] ?)[A-Za-z0-9-]+)+", re.I)
_DOT = re.compile(r" ?[(\[{] ?dot ?[)\]}] ?", re.I)
_QUAD = re.compile(r"(?<![0-9.])[0-9]{1,3}(?: ?(?:\.|[(\[{] ?(?:\.|dot) ?[)\]}]) ?[0-9]{1,3}){3}(?![0-9])", re.I)
_SIX = re.compile(r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Za-z:])")
_DIGITS = re.compile(r"[0-9]+")
_CARD_SIGNS = frozenset("0123456789 -")


def luhn(digits: str) -> bool:
    d = [int(c) for c in reversed(digits)]
    return (sum(d[::2]) + sum(2 * x - 9 * (x > 4) for x in d[1::2])) % 10 == 0


def in_byte(digits: str) -> bool:
    d = digits.lstrip("0")
    return len(d) <= 3 and int(d or 0) <= 255


def digits_of(s: str) -> str:
    return "".join(_DIGITS.findall(s))


def base(text: str) -> list[tuple[int, int, int]]:
    """Spans (kind, start, end) of the fixed patterns, each kind's from left to right without overlaps; what fails its kind's test
    is passed over whole."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        if m := _DOMAIN.match(text, at + 1):
            s = at
            while s > last and text[s - 1] in _LOCAL:
                s -= 1
            if s < at:
                out.append((0, s, m.end()))
                last = m.end()
        at = text.find("@", max(at + 1, last))
    if _DIGITS.search(text):
        out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(map(in_byte, m[0].split(".")))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16 and 16 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
                out.append((2, m.start(), m.end()))
        if "+" in text:
            out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(digits_of(m[0])) <= 15]
    return out


class Apart:
    """Spans that do not overlap, in order."""

    def __init__(self):
        self.starts, self.ends = [], []

    def free(self, s: int, e: int) -> bool:
        k = bisect_left(self.starts, e)  # of those that start before e, the last ends last
        return not k or self.ends[k - 1] <= s

    def add(self, s: int, e: int) -> bool:
        """Whether it was free, and is taken now; else what it covers stays as it was."""
        if ok := self.free(s, e):
            k = bisect_left(self.starts, s)
            self.starts.insert(k, s)
            self.ends.insert(k, e)
        return ok


def begins(text: str, s: int) -> bool:
    """No word or number goes on before s."""
    return not (s and (text[s - 1].isalnum() or text[s - 1] in "_.+-:@/="))


def ends(text: str, e: int) -> bool:
    """None goes on from e on."""
    return not (e < len(text) and (text[e].isalnum() or text[e] in "_@=" or text[e] in ".-:/" and text[e + 1 : e + 2].isalnum()))


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans that could be of a kind but are no base spans: addresses with a spelt-out or spaced sign, dots in brackets, long addresses, and
    numbers whose groups, cut at spaces, are cards or phones. None overlaps a base span."""
    out, held = [], Apart()
    for _, s, e in sorted(taken, key=lambda x: x[1] - x[2]):  # within another kind's span, one is held already
        held.add(s, e)
    free = held.free
    if not set("@([{").isdisjoint(text):
        for m in _AT.finditer(text):
            if (m[0] != "@" or _DOT.search(text, m.end(), m.end() + 256)) and (d := _NAME.match(text, m.end())):
                s = m.start()
                while s and text[s - 1] in _LOCAL:
                    s -= 1
                if s < m.start() and free(s, d.end()):
                    out.append((0, s, d.end()))
    for m in _SIX.finditer(text) if text.count(":") >= 7 else ():
        if free(*m.span()):
            out.append((1, *m.span()))
    if _DIGITS.search(text):
        for m in _QUAD.finditer(text):
            if not set("([{ ").isdisjoint(m[0]) and free(*m.span()) and begins(text, m.start()) and ends(text, m.end()) and all(map(in_byte, _DIGITS.findall(m[0]))):
                out.append((1, *m.span()))
        for m in _NUMBER.finditer(text):
            if m.end() - m.start() >= 8:
                at, pieces = m.start(), []
                for x in m[0].split(" "):
                    pieces.append((at, at + len(x), len(digits_of(x))))
                    at += len(x) + 1
                for i, (s, _, first) in enumerate(pieces):
                    sign, n = text[s] in "+(", 0
                    if not (sign or not i or first >= 4) or not begins(text, s):
                        continue
                    for _, e, k in pieces[i : i + 20]:
                        n += k
                        if n > 19 or n > k < 2:  # a group of one digit is a first one only
                            break
                        if n < 8 or not ends(text, e) or not free(s, e):
                            continue
                        span = text[s:e]
                        if n >= 16 and set(span) <= _CARD_SIGNS and luhn(digits_of(span)):
                            out.append((2, s, e))
                        elif n <= 15 and (sign or (s, e) == m.span()) and span.count("(") == span.count(")"):
                            out.append((3, s, e))
    return out


def plain(kind: int, s: str) -> str:
    """The identifier that a span writes."""
    if kind == 0:
        return _DOT.sub(".", _AT.sub("@", s)).lower()
    if kind == 1:
        return s.lower() if ":" in s else ".".join(_DIGITS.findall(s))
    return digits_of(s)


def form(kind: int, s: str) -> str:
    """How an identifier of its kind is written: an address by its domain, others by their digits and signs."""
    if kind == 0:
        return ".".join(plain(0, s).rpartition("@")[2].split(".")[-2:])
    return _DIGITS.sub("9" if kind == 1 else lambda m: "9" * len(m[0]), s)


def around(text: str, s: int, e: int) -> tuple[str, str, str]:
    """The word before, the two words before, the word after; digits are alike, and ^ and $ stand for none."""
    left = _DIGITS.sub("9", text[max(0, s - REACH) : s].lower()).split()[-2:]
    right = _DIGITS.sub("9", text[e : e + REACH].lower()).split()[:1]
    return (left or ["^"])[-1], " ".join(["^", "^", *left][-2:]), (right or ["$"])[0]


FOUND = "array<struct<kind:int,start:bigint,end:bigint,seed:boolean,name:string,form:string,before:string,before2:string,after:string>>"
_SPANS = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))


def found(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (uid, id_col, spans), written into the shared folder: base spans (seed) and candidates with their forms and contexts."""
    ship(docs.sparkSession)
    words = ("name", "form", "before", "before2", "after")
    names = ("kind", "start", "end", "seed", *words)
    item = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("seed", pa.bool_()), *((n, pa.string()) for n in words)])

    def spans(text: str) -> list[tuple]:
        seeds = base(text)
        return [(k, s, e, seed, plain(k, text[s:e]), form(k, text[s:e]), *around(text, s, e)) for seed, got in ((True, seeds), (False, candidates(text, seeds))) for k, s, e in got]

    def work(batches):
        for batch in batches:
            got = [spans(t.as_py() or "") for t in batch.column(1)]
            rows = [dict(zip(names, x, strict=True)) for g in got for x in g]
            ends = [0]
            for g in got:
                ends.append(ends[-1] + len(g))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(rows, item))], [id_col, "spans"])
        settle()

    kind = docs.schema[id_col].dataType.simpleString()
    got = docs.select(id_col, text_col).mapInArrow(work, f"{id_col} {kind}, spans {FOUND}")
    return kept(got.select(F.monotonically_increasing_id().alias("uid"), id_col, "spans"))


#: Families of patterns: an instance's form, the word before it, the two before it, the word after it, and the words on both sides.
FAMILIES = {"form": ["form"], "before": ["before"], "before2": ["before2"], "after": ["after"], "both": ["before", "after"]}


def patterns():
    """The patterns that a span is an extraction of: array<struct<family, pattern>>."""
    return F.array(*[F.struct(F.lit(f).alias("family"), F.xxhash64(F.lit(f), "kind", *cols).alias("pattern")) for f, cols in FAMILIES.items()])


def bootstrap(spans: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Rows (kind, name, trust): the instances among candidates that patterns of seed instances, and then of each other, extract.

    spans: kind, name, seed, form, before, before2, after. Patterns and instances make a bipartite graph. A pattern's confidence is
    the trust in the distinct instances that it extracts, over their number and PRIOR; seeds have a trust of 1. An instance
    is trusted where its form alone is (FORM), its form and a word beside it are (BOTH), or what stands before and what stands after it
    are (AROUND). Each round scores the graph's patterns anew and then its instances, until no more are trusted. Patterns
    of seeds are counted once; a name or pattern of many rows is summed up before it is exchanged.
    """
    edge = ["kind", "name", *{c for cols in FAMILIES.values() for c in cols}]
    found = kept(spans.where("not seed").groupBy(*edge).count().select(*edge, F.xxhash64(*edge).alias("row")))
    if found.isEmpty():
        return spans.select("kind", "name", F.lit(0.0).alias("trust")).limit(0)
    seeds = spans.where("seed")
    edges = kept(found.select("row", "kind", "name", F.explode(patterns()).alias("p")).select("row", "kind", "name", "p.*"))
    support = seeds.select("kind", "name", F.explode(patterns().getField("pattern")).alias("pattern")).distinct().groupBy("pattern").agg(F.count("*").alias("seeds"))
    support = kept(edges.groupBy("pattern").count().drop("count").join(support, "pattern"))
    trust = kept(found.groupBy("kind", "name").count().drop("count").join(seeds.select("kind", "name").distinct(), ["kind", "name"], "left_semi").withColumn("trust", F.lit(1.0)))
    many = trust.count()
    for _ in range(rounds):
        pairs = edges.groupBy("pattern", "kind", "name").count().drop("count").join(trust, ["kind", "name"], "left")
        score = pairs.groupBy("pattern").agg(F.count("*").alias("n"), F.coalesce(F.sum("trust"), F.lit(0.0)).alias("t")).join(support, "pattern", "left")
        s = F.coalesce("seeds", F.lit(0))
        score = score.select("pattern", ((s + F.col("t")) / (s + F.col("n") + PRIOR)).alias("c"))
        best = {f: F.coalesce(F.max(F.when(F.col("family") == f, F.col("c"))), F.lit(0.0)).alias(f) for f in FAMILIES}
        rows = edges.join(score, "pattern").groupBy("row", "kind", "name").agg(*best.values())
        beside = F.greatest("before", "before2", "after", "both")
        ways = [
            F.when(F.col("form") >= FORM, F.col("form")), F.when((F.col("form") >= BOTH) & (beside >= BOTH), F.least("form", beside)),
            F.when((F.col("before2") >= AROUND) & (F.col("after") >= AROUND), F.least("before2", "after")), F.when(F.col("both") >= AROUND, F.col("both")),
        ]
        new = rows.select("kind", "name", F.coalesce(F.greatest(*ways), F.lit(0.0)).alias("trust")).where("trust > 0").union(trust)
        trust = kept(new.groupBy("kind", "name").agg(F.max("trust").alias("trust")))
        many, before = trust.count(), many
        if many == before:
            break
    return trust


def extract(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """Rows (id_col, base, added), both array<struct<kind, start, end>> in order of kind (0 email, 1 ip, 2 card, 3 phone), then start: the
    personal data of every whole text, in code points, ends exclusive.

    base are the spans of fixed patterns. added are candidates of wider shape that `bootstrap` trusts; they overlap neither base spans
    nor each other: the more trusted goes first, then the longer, then the earlier. Null and empty texts have none. Rows may
    repeat, counting once as evidence; ids may be null; other columns are ignored. Texts are read once and not exchanged: only
    spans are, with REACH characters around them.
    """
    docs = found(docs, id_col, text_col)
    spans = docs.select("uid", F.explode("spans").alias("s")).select("uid", "s.*")
    trust = bootstrap(spans, rounds)
    item = F.struct("kind", "start", "end", "trust")
    more = spans.where("not seed").select("uid", "kind", "name", "start", "end").join(bounded(trust, SENT), ["kind", "name"]).groupBy("uid").agg(F.collect_list(item).alias("more"))
    seeds = F.transform(F.filter("spans", lambda x: x["seed"]), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    rows = docs.select("uid", id_col, F.array_sort(seeds).alias("base")).join(more, "uid", "left").select(id_col, "base", "more")

    def work(batches):
        for batch in batches:
            out = []
            for found_ in batch.column(2).to_pylist():
                held = Apart()
                order = sorted(found_ or (), key=lambda x: (-x["trust"], x["start"] - x["end"], x["start"], x["kind"]))
                taken = [x for x in order if held.add(x["start"], x["end"])]
                out.append(sorted(({k: x[k] for k in ("kind", "start", "end")} for x in taken), key=lambda x: (x["kind"], x["start"])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, _SPANS)], [id_col, "base", "added"])

    kind, span = docs.schema[id_col].dataType.simpleString(), "array<struct<kind:int,start:bigint,end:bigint>>"
    return rows.mapInArrow(work, f"{id_col} {kind}, base {span}, added {span}")


def listed(spans):
    """`kind:start:end` of spans, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ",")


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: base spans counted and digested, and all spans; n_added of these are the method's."""
    got = extract(read(spark, sf_dir, "documents"))
    of = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    counts = [of(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return got.select("doc_id", *counts, F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"), listed(F.array_sort(F.concat("base", "added"))).alias("spans"), F.size("added").cast("long").alias("n_added"))


QUERIES = {"op11_personal_data": op11_personal_data}

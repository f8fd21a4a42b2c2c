"""Operator 5: n-gram Jaccard join with Bayesian pruning of MinHash candidates."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm.common import block_pairs, bounded, by_few, components, cut, join_sized, named, read, settle, ship
from wardline.llm.forest import stars
from wardline.llm.substring_dedup import mix

_U = np.uint64
#: Wanted chance that a pair at the threshold shares no band. (That 32 bits of two different bands agree by chance, which could hide
#: a pair, adds less than 1e-8.)
MISS = 5e-6
#: Names of texts that are sent to all tasks at most; more are dealt out with the texts.
SENT = 1_000_000
#: Hashes that are compared in steps, and a step.
TESTED, STEP = 64, 16
#: A candidate is dropped when the chance that it reaches the threshold falls below this.
TOLERANCE = 1e-6
#: Text bytes handled at once, members of a block of candidates, shingles of a block to verify, and documents of a tile of it.
BLOCK, NEAR, VERIFY, TILE = 2_000_000, 1000, 400_000, 512


def layout(threshold: float) -> tuple[int, int]:
    """Bands, and hashes of a band: a pair at the threshold shares a band about once in three, and no band with probability MISS."""
    rows = max(1, round(math.log(1 / 3) / math.log(threshold))) if 0 < threshold < 1 else 1
    return max(1, math.ceil(math.log(MISS) / math.log(1 - min(0.999, threshold**rows)))), rows


def shingles(texts: list[str | None], n: int) -> list[np.ndarray]:
    """For each text its distinct shingles of n words, as sorted 64-bit hashes; a shorter text that has words is one shingle."""
    from xxhash import xxh3_64_intdigest

    coef = np.random.default_rng(51).integers(1, 1 << 63, n, dtype=np.uint64) * _U(2) + _U(1)
    out = []
    for t in texts:
        words = (t or "").lower().encode().split()
        w = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
        if 0 < len(w) < n:
            out.append(mix(np.array([sum(int(x) * int(c) for x, c in zip(w, coef)) + len(w) & (1 << 64) - 1], np.uint64)))
            continue
        m = max(0, len(w) - n + 1)
        acc = np.zeros(m, np.uint64)
        for j in range(n):
            acc += w[j : j + m] * coef[j]
        out.append(np.unique(mix(acc)))
    return out


def least_matches(threshold: float) -> list[int]:
    """After each step of STEP hashes, the matches that keep a pair: with fewer, the posterior of Jaccard >= threshold (from a
    uniform prior: the chance of at most m successes in n + 1 draws) is below TOLERANCE."""
    out = []
    for n in range(STEP, TESTED + 1, STEP):
        total, m = 0.0, 0
        while True:
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= TOLERANCE:
                break
            m += 1
        out.append(m)
    return out


def signatures(docs: DataFrame, id_col: str, text_col: str, n: int, threshold: float) -> DataFrame:
    """Rows (doc, d1, d2, f1, f2, shingles, bands array<bigint>, sig binary): d1 and d2 name the row's id and text, f1 and f2 the set
    of shingles; f1 and on are null for texts without words. sig has the first hashes, 16 bits each, and 32 bits of each band."""
    ship(docs.sparkSession)
    by_few(docs.sparkSession)
    bands, rows = layout(threshold)
    hashes = max(bands * rows, TESTED)
    coef = np.random.default_rng(50).integers(1, 1 << 63, hashes, dtype=np.uint64) * _U(2) + _U(1)

    def work(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and size < BLOCK:
                    size += len(texts[end] or "")
                    end += 1
                yield one(batch.slice(at, end - at).select(["doc", "d1", "d2"]), shingles(texts[at:end], n))
                at = end
        settle()

    def one(names, sets):
        full = [s for s in sets if len(s)]
        some = np.array([len(s) > 0 for s in sets], bool)
        m = len(full)
        f1, f2 = (np.array([np.sum(mix(s + _U(k))) for s in full], np.uint64).view(np.int64) for k in (1, 2))
        sig = np.zeros((m, hashes), np.uint64)
        if m:
            flat = np.concatenate(full)
            starts = np.concatenate([[0], np.cumsum([len(s) for s in full])])[:-1]
            for k, c in enumerate(coef):
                sig[:, k] = np.minimum.reduceat(flat * c, starts)
        sig = mix(sig)
        keys = np.zeros((m, bands), np.uint64)
        for b in range(bands):
            acc = np.full(m, b + 1, np.uint64)
            for k in range(rows):
                acc = mix(acc * _U(31) + sig[:, b * rows + k])
            keys[:, b] = acc
        short = [a.tobytes() + b.tobytes() for a, b in zip((sig[:, :TESTED] >> _U(48)).astype(np.uint16), (keys >> _U(32)).astype(np.uint32))]
        pick = pa.array(np.where(some, np.cumsum(some) - 1, 0), mask=~some)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(m + 1) * bands, pa.int32()), pa.array(keys.view(np.int64).ravel(), pa.int64()))
        cols = [pa.array(f1), pa.array(f2), pa.array([len(s) for s in full], pa.int64()), lists, pa.array(short, pa.binary())]
        cols = [c.take(pick) for c in cols] if m else [pa.nulls(len(sets), c.type) for c in cols]
        return pa.RecordBatch.from_arrays([*names.columns, *cols], ["doc", "d1", "d2", "f1", "f2", "shingles", "bands", "sig"])

    doc, text = F.col(id_col).alias("doc"), F.col(text_col).alias("text")
    rows_in = docs.select(doc, *named(F.col(id_col), F.col(text_col)), text)
    return rows_in.mapInArrow(work, "doc bigint, d1 bigint, d2 bigint, f1 bigint, f2 bigint, shingles bigint, bands array<bigint>, sig binary")


def shingle_sets(docs: DataFrame, text_col: str, n: int) -> DataFrame:
    """Rows (f1, f2, hashes binary): the sets of shingles of texts, as signatures() names them."""
    ship(docs.sparkSession)
    by_few(docs.sparkSession)

    def work(batches):
        for batch in batches:
            for text in batch.column(0):
                s = shingles([text.as_py()], n)[0]
                yield pa.RecordBatch.from_pydict({"f1": pa.array([np.sum(mix(s + _U(1)))], pa.uint64()).view(pa.int64()), "f2": pa.array([np.sum(mix(s + _U(2)))], pa.uint64()).view(pa.int64()), "hashes": pa.array([s.tobytes()], pa.binary())})

    return docs.select(text_col).mapInArrow(work, "f1 bigint, f2 bigint, hashes binary")


def near(left: np.ndarray, right: np.ndarray, same: bool, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of signatures (rows of left and right; of one block if same) that Bayesian pruning leaves."""
    match = np.zeros((len(left), len(right)), np.uint8)
    for k in range(STEP):
        match += left[:, k, None] == right[None, :, k]
    keep = match >= least[0]
    a, b = np.nonzero(np.triu(keep, 1) if same else keep)
    m = match[a, b].astype(np.int64)
    for s in range(1, TESTED // STEP):
        m += (left[a, s * STEP : (s + 1) * STEP] == right[b, s * STEP : (s + 1) * STEP]).sum(axis=1)
        ok = m >= least[s]
        a, b, m = a[ok], b[ok], m[ok]
    return a, b


def candidates(t: pa.Table, tile: int, least: list[int]):
    """(a, b) arrays of places in t, a tile of the block pair at a time: the pairs that pruning leaves and that have no band in common
    before this bucket's, so that each pair is found in one bucket only."""
    own = t.column("own").to_numpy()
    b1, b2, band = (t.column(c)[0].as_py() for c in ("b1", "b2", "band"))
    raw = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint16).reshape(len(own), -1)
    sig, bands = raw[:, :TESTED], np.ascontiguousarray(raw[:, TESTED:]).view(np.uint32)
    left, right = np.flatnonzero(own == b1), np.flatnonzero(own == b2)
    for i in range(0, len(left), tile):
        for j in range(i if b1 == b2 else 0, len(right), tile):
            x, y = left[i : i + tile], right[j : j + tile]
            a, b = near(sig[x], sig[y], b1 == b2 and i == j, least)
            a, b = x[a], y[b]
            for at in range(0, len(a), 50_000):
                p, q = a[at : at + 50_000], b[at : at + 50_000]
                first = ~(bands[p, :band] == bands[q, :band]).any(axis=1)
                if first.any():
                    yield p[first], q[first]


def common(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of shingles that each pair (a[i], b[i]) of sets shares."""
    x, y = np.unique(a), np.unique(b)
    if len(a) * 8 < len(x) * len(y):  # few pairs of many
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a, b)], np.int64)
    flat = np.concatenate([sets[i] for i in (*x, *y)])
    _, code, n = np.unique(flat, return_inverse=True, return_counts=True)
    new = np.cumsum(n > 1) - 1  # the shingles that several have
    doc = np.repeat(np.arange(len(x) + len(y)), [len(sets[i]) for i in (*x, *y)])
    use = n[code] > 1
    code, doc = new[code[use]], doc[use]
    order = np.argsort(code, kind="stable")
    code, doc = code[order], doc[order]
    out, total = np.zeros((len(x), len(y)), np.float32), int(new[-1]) + 1 if len(new) else 0
    for at in range(0, total, 4096):
        lo, hi = np.searchsorted(code, [at, at + 4096])
        m = np.zeros((len(x) + len(y), 4096), np.float32)
        m[doc[lo:hi], code[lo:hi] - at] = 1
        out += m[: len(x)] @ m[len(x) :].T
    return out[np.searchsorted(x, a), np.searchsorted(y, b)].astype(np.int64)


def classes(docs: DataFrame, threshold: float = 0.8, n: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc, d1, d2, class_id, n_links, stays), one for each row of docs; see jaccard_join. d1 and d2 name the row's id and
    text; stays marks the row of each class to keep: that of the smallest id, nulls last, and of the smallest name.

    (1) Rows of equal sets form one kind, whatever their ids. (2) MinHash bands of the kinds give buckets; in each, pairs are pruned
    by comparing further hashes in steps until the posterior chance of reaching the threshold is too small. (3) The kinds that have a
    pair left come together in the same buckets with their shingles, and those pairs, no others, are verified exactly, each in the
    first bucket that it shares. Buckets of any size are cut into pairs of blocks, and a task returns sums and trees, never its pairs.
    """
    docs = docs.withColumn(id_col, F.col(id_col).cast("long"))
    least = least_matches(threshold)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # of steps whose rows are few but costly
    seen = cut(signatures(docs, id_col, text_col, n, threshold))
    place = F.struct(F.col("doc").isNull().alias("none"), "doc", "d1", "d2")
    kinds = seen.where("f1 is not null").groupBy("f1", "f2").agg(
        F.min(place).alias("best"), F.min("doc").alias("low"), F.countDistinct("doc").alias("ids"), F.count_if(F.col("doc").isNull()).alias("bare"),
        F.first("shingles").alias("shingles"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    kinds = cut(kinds.withColumn("size", F.col("ids") + F.col("bare")).drop("ids", "bare").withColumn("rep", F.monotonically_increasing_id()))

    total = kinds.count()
    keyed = kinds.select(F.posexplode("bands").alias("band", "key"), "rep")
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = join_sized(keyed, shared, "key", total * layout(threshold)[0])
    traits = kinds.select("rep", "sig")

    def prune(t: pa.Table) -> pa.Table:
        rep, some = t.column("rep").to_numpy(), np.zeros(t.num_rows, bool)
        for a, b in candidates(t, NEAR, least):
            some[a] = some[b] = True
        at = np.flatnonzero(some)
        return pa.table({"key": t.column("key").take(pa.array(at)), "band": t.column("band").take(pa.array(at)), "rep": rep[at]})

    dealt = block_pairs(members, "rep", NEAR).join(traits, "rep")
    left = dealt.select("key", "band", "rep", "own", "b1", "b2", "sig").repartition(parts, "key", "b1", "b2").groupBy("key", "b1", "b2").applyInArrow(prune, "key bigint, band int, rep bigint")
    left = cut(left.distinct().join(kinds.select("rep", "shingles"), "rep"))
    sizes = left.groupBy("key").agg(F.sum("shingles").alias("n"))
    weight = left.agg(F.coalesce(F.sum("shingles"), F.lit(0))).first()[0]

    wanted = cut(left.select("rep").distinct().join(kinds.select("rep", "f1", "f2", "size", "best"), "rep"))
    texts = docs.withColumns(dict(zip(("d1", "d2"), named(F.col(id_col), F.col(text_col)))))
    texts = texts.join(bounded(wanted.select("best.d1", "best.d2"), SENT), ["d1", "d2"], "left_semi")
    sets = shingle_sets(texts, text_col, n).dropDuplicates(["f1", "f2"]).join(wanted, ["f1", "f2"]).select("rep", "size", "hashes")

    def verify(t: pa.Table) -> pa.Table:
        rep, size = t.column("rep").to_numpy(), t.column("size").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in t.column("hashes").to_pylist()]
        have = np.array([len(s) for s in sets], np.int64)
        links, low = np.zeros(len(rep), np.int64), np.arange(len(rep))
        for a, b in candidates(t, TILE, least):
            both = common(sets, a, b)
            link = both >= threshold * (have[a] + have[b] - both) - 1e-9
            a, b = a[link], b[link]
            links += (np.bincount(a, size[b], len(rep)) + np.bincount(b, size[a], len(rep))).astype(np.int64)
            low = stars(len(rep), np.concatenate([np.arange(len(rep)), a]), np.concatenate([low, b]))
        at = np.flatnonzero(links)
        return pa.table({"rep": rep[at], "links": links[at], "root": rep[low[at]]})

    blocks = block_pairs(join_sized(left, sizes, "key", weight), "rep", VERIFY).join(sets, "rep").join(traits, "rep")
    blocks = blocks.select("key", "band", "rep", "size", "own", "b1", "b2", "sig", "hashes").repartition(parts, "key", "b1", "b2")
    found = cut(blocks.groupBy("key", "b1", "b2").applyInArrow(verify, "rep bigint, links bigint, root bigint"))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    trees = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "rep")
    known = kinds.select("rep", "f1", "f2", "best", "low", "size").join(links, "rep", "left").join(trees, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    tops = known.groupBy("component").agg(F.min("best").alias("top"), F.min("low").alias("class_id"))
    known = known.join(tops, "component").select(F.col("f1").alias("k1"), F.col("f2").alias("k2"), "top", "class_id", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    own = seen.select("doc", "d1", "d2", "f1", "f2")
    out = own.where("f1 is not null").join(known, (F.col("f1") == F.col("k1")) & (F.col("f2") == F.col("k2"))).select("doc", "d1", "d2", "class_id", F.col("n_links").cast("long").alias("n_links"), place.eqNullSafe(F.col("top")).alias("stays"))
    # texts without words apart, or they would all be one task's
    return out.union(own.where("f1 is null").select("doc", "d1", "d2", F.col("doc").alias("class_id"), F.lit(0).cast("long"), F.lit(True)))


def jaccard_join(docs: DataFrame, threshold: float = 0.8, n: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id_col, class_id, n_links): the links of documents whose shingle sets have a Jaccard similarity of threshold or more.

    Words are the runs between ASCII white space of the lower-cased text; a text of fewer than n words is one shingle. n_links counts
    the other documents linked directly; class_id is the smallest id reachable by links, itself included. Texts without words (null,
    empty) link with nothing. Ids are integers. One row for each row of docs: rows without an id are linked like any other, each as a
    document of its own, but name no class (so a class of such rows alone has a null class_id); within one set of shingles, rows of
    one id count as one document, and an id with several texts has a row for each. Other columns are ignored.
    """
    return classes(docs, threshold, n, id_col, text_col).select(F.col("doc").alias(id_col), "class_id", "n_links")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class and number of links of every document."""
    return jaccard_join(read(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op5_jaccard_join": op5_jaccard_join}

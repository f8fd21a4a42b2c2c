"""Operator 13: periodic runs of words, found by catching squares over dyadic blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm.common import SPACES, read, settle, ship

#: Shortest run, words that are worked on at once (a longer text is worked on alone), and cells of one comparison.
LEAST, WORDS, CELLS = 12, 400_000, 1 << 22
_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)
_NONE = np.zeros((0, 3), np.int64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def reach(w: np.ndarray, at: np.ndarray, q: np.ndarray, step: int) -> np.ndarray:
    """How many words, from each `at` on in direction step, equal those q later."""
    got, live, c = np.zeros(len(at), np.int64), np.arange(len(at)), 8
    while live.size:
        done = []
        for part in np.array_split(live, 1 + live.size * c // CELLS):
            j = at[part, None] + step * (got[part, None] + np.arange(c))
            k = j + q[part, None]
            same = (j >= 0) & (k < len(w))
            same &= w[np.where(same, j, 0)] == w[np.where(same, k, 0)]
            full = same.all(axis=1)
            got[part] += np.where(full, c, same.argmin(axis=1))
            done.append(part[full])
        live, c = np.concatenate(done), min(2 * c, CELLS)
    return got


def chains(i: np.ndarray, q: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Catches (block, period) merged where neighbouring blocks of b words caught the same period: first and last block, period."""
    order = np.lexsort((i, q))
    i, q = i[order], q[order]
    new = np.concatenate([[True], (q[1:] != q[:-1]) | (i[1:] != i[:-1] + b)])
    at = np.flatnonzero(new)
    return i[at], i[np.append(at[1:], len(i)) - 1], q[at]


def grown(w: np.ndarray, caught: tuple[np.ndarray, np.ndarray, np.ndarray], b: int, known: np.ndarray, least: int) -> np.ndarray:
    """Runs (start, end, period) of a level's chains, without those that are known runs over again, with a multiple of their period."""
    first, last, q = caught
    for p in np.unique(known[:, 2]):
        mine = known[known[:, 2] == p]  # of one period, a later start means a later end
        mine = mine[np.argsort(mine[:, 0])]
        at = np.searchsorted(mine[:, 0], first, "right") - 1
        again = (q % p == 0) & (at >= 0) & (first + b + q <= mine[at, 1])
        first, last, q = first[~again], last[~again], q[~again]
    start, end = first - reach(w, first - 1, q, -1), last + b + reach(w, last + b, q, 1) + q
    out = []
    for s, e, p in np.stack([start, end, q], axis=1)[end - start >= np.maximum(least, 2 * q)].tolist():
        cuts = np.flatnonzero(w[s : e - p] != w[s + p : e]).tolist()  # none, unless two blocks' names are equal by chance
        out += [(a, z, p) for a, z in zip([s, *(s + c + 1 for c in cuts)], [*(s + c + p for c in cuts), e], strict=True) if z - a >= max(least, 2 * p)]
    return np.array(out, np.int64).reshape(-1, 3)


def catch(w: np.ndarray, sizes: np.ndarray, least: int = LEAST) -> np.ndarray:
    """All runs of at least `least` (5 or more) words in texts, as rows (start, end, period) in order of start, then period. w holds
    the texts' words as numbers, one text after another, and before each text a number that is found nowhere else.

    A completed block of b words, b a power of two, is a catcher: the words appended after it advance a comparison with it, of the
    last b of them, while they end 2 b to 4 b - 1 words later. Where they are equal, a square of that period may be there. numpy
    advances all catchers of a level over all words at once, and the levels come in turn. The stretch of a square over which
    words equal those a period q later is q long and so holds a block of its level, whose catch is not missed; catches of
    neighbouring blocks merge, and are grown to the stretch's ends, fewer than b words away. A period that is a multiple of a
    run's at the same place is dropped, so that each run comes with its smallest period. Blocks are compared by 64-bit names, that
    of two halves being made of theirs; the runs that result are compared word by word.
    """
    found, b, place = _NONE, 2, np.arange(len(w))
    name = w.astype(_U)
    name = mix(name * _ODD + mix(np.append(name[1:], _U(0))))
    while sizes.size and sizes.max() >= (least if b == 2 else 4 * b):
        long = np.repeat(sizes >= (least if b == 2 else 4 * b), sizes + 1)
        if long.sum() < 0.6 * len(w):
            w, name, place, sizes = w[long], name[long], place[long], sizes[sizes >= (least if b == 2 else 4 * b)]
        at = np.searchsorted(place, found[:, 0])
        here = found[np.append(place, -1)[at] == found[:, 0]]
        at = np.searchsorted(place, here[:, 0])
        known, n = np.stack([at, at + here[:, 1] - here[:, 0], here[:, 2]], axis=1), len(w)
        if b == 2:
            for p in range(1, 8):
                i = 2 * np.flatnonzero(name[: max(n - p, 0) : 2] == name[p::2])
                i = i[i + p + 2 <= n]
                if i.size:
                    known = np.concatenate([known, grown(w, chains(i, np.full(len(i), p), b), b, known, least)])
        else:
            rows = -(-n // b)
            grid = np.append(name, np.zeros(rows * b - n, _U)).reshape(rows, b)
            hits = [(d, *np.nonzero(grid[d:] == grid[: max(rows - d, 0), :1])) for d in (2, 3)]
            i, q = (np.concatenate(x) for x in zip(*[(m * b, d * b + j) for d, m, j in hits], strict=True))
            ok = i + q + b <= n
            if ok.any():
                known = np.concatenate([known, grown(w, chains(i[ok], q[ok], b), b, known, least)])
        new = known[len(here) :]
        found = np.concatenate([found, np.stack([place[new[:, 0]], place[new[:, 0]] + new[:, 1] - new[:, 0], new[:, 2]], axis=1)])
        name = np.append(mix(name[:-b] * _ODD + mix(name[b:] + _U(b))), np.zeros(b, _U))
        b *= 2
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def collapse(texts: list[list[bytes]], least: int = LEAST) -> list[tuple[np.ndarray, bytes]]:
    """Of each text, given as its words: its runs (start, length, period), and the words that no run has after its first period."""
    number: dict = {}
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.cumsum(sizes + 1) - sizes
    w = np.empty(int((sizes + 1).sum()), np.int64)
    for k, (t, at) in enumerate(zip(texts, begin, strict=True)):
        w[at - 1] = -1 - k
        w[at : at + len(t)] = [number.setdefault(x, len(number)) for x in t]
    runs = catch(w, sizes, least)
    first = runs[:, 0] + runs[:, 2]
    gone = np.cumsum(np.bincount(first, minlength=len(w) + 1) - np.bincount(runs[:, 1], minlength=len(w) + 1)) > 0
    ends = np.searchsorted(runs[:, 0], begin + sizes)
    out, last = [], 0
    for t, at, end in zip(texts, begin, ends, strict=True):
        mine = runs[last:end]
        kept = [t[j] for j in np.flatnonzero(~gone[at : at + len(t)])] if len(mine) else t
        out.append((np.stack([mine[:, 0] - at, mine[:, 1] - mine[:, 0], mine[:, 2]], axis=1), b" ".join(kept)))
        last = end
    return out


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """Rows (id_col, n_words, runs array<struct<start, length, period>>, collapsed): the periodic runs of every whole text, in order
    of start, then period, and the text without the words that a run has after its first period, joined by one space.

    Words are what lies between ASCII space characters, unchanged, numbered from 0. A run is a stretch of at least `least` words,
    and of two periods, that no neighbour extends; its period is its smallest. Null and empty texts have no words and no runs. Each
    text is judged alone, so rows may repeat, ids may be null, and other columns are ignored. There is no shuffle; a task
    holds a batch, or one text, at a time.
    """
    if least < 5:
        raise ValueError("runs of fewer than 5 words are not looked for")
    ship(docs.sparkSession)

    def packed(ids: list, texts: list[list[bytes]], kind: pa.DataType) -> pa.RecordBatch:
        got = collapse(texts, least)
        flat = np.concatenate([_NONE, *[r for r, _ in got]])
        ends = np.cumsum([0, *[len(r) for r, _ in got]])
        runs = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], ["start", "length", "period"]))
        cols = [pa.array(ids, kind), pa.array([len(t) for t in texts], pa.int64()), runs, pa.array([c for _, c in got], pa.binary()).cast(pa.string())]
        return pa.RecordBatch.from_arrays(cols, [id_col, "n_words", "runs", "collapsed"])

    def work(batches):
        for batch in batches:
            ids, texts, n = [], [], 0
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(i)
                texts.append((t.as_py() or "").encode().split())  # at the ASCII space characters
                n += len(texts[-1])
                if n > WORDS:
                    yield packed(ids, texts, batch.column(0).type)
                    ids, texts, n = [], [], 0
            if ids:
                yield packed(ids, texts, batch.column(0).type)
        settle()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(work, f"{id_col} {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def repeated(text: Column, doc_id: Column) -> Column:
    """The contract's text: of every tenth document by a hash of its id, the words from some place on repeat a stretch of words."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def rewritten(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        back = lambda i: F.element_at(words, (F.when(i < a, i).otherwise(a + (i - a) % p) + 1).cast("int"))
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), back), " ")).otherwise("")

    words = F.filter(F.split(text, SPACES), lambda x: x != "")
    return F.when((h % 10 == 0) & text.isNotNull(), F.transform(F.array(words), rewritten)[0]).otherwise(text)  # one array, so that words are cut once


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, after the contract's repetition: their number, the longest one, and digests of all and of what is left."""
    d = read(spark, sf_dir, "documents")
    got = find_runs(d.select("doc_id", repeated(F.col("text"), F.col("doc_id")).alias("text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    got = got.withColumn("best", best)
    return got.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).cast("long").alias("exponent_milli"), F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"), "n_words",
    )


QUERIES = {"op13_periodic_runs": op13_periodic_runs}

"""Operator 6: removal of repeated passages, found by recompression."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.llm.common import read, settle, ship

#: Words of a window. The parse below is worked out for it: two rounds of pairs lose four words at most at either end.
WINDOW, LOSS = 13, 4
ROUNDS = 2
_U = np.uint64
_COEF = np.random.default_rng(20).integers(1, 1 << 63, (2, WINDOW), dtype=np.uint64) | _U(1)
_SALT = np.random.default_rng(21).integers(1, 1 << 63, ROUNDS + 2, dtype=np.uint64)
_LAST = np.iinfo(np.int64).max


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Unit:
    """The documents of one unit: word hashes in one array, and each document's part of it."""

    def __init__(self, ids: pa.ChunkedArray, texts: pa.ChunkedArray):
        from xxhash import xxh3_64_intdigest

        self.ids = ids.fill_null(_LAST).to_numpy()
        self.texts = [(t or b"").split() for t in texts.cast(pa.binary()).to_pylist()]  # at the ASCII space characters
        self.sizes = np.array([len(t) for t in self.texts], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        n = int(self.starts[-1])
        self.words = np.fromiter((xxh3_64_intdigest(w) for t in self.texts for w in t), np.uint64, n)
        self.doc = np.repeat(np.arange(len(self.texts)), self.sizes)
        left = self.starts[1:][self.doc] - np.arange(n)
        self.window = left >= WINDOW  # a window starts here

    def parse(self):
        """Recompression: (runs' start, length, key), (symbols' start, keys of each symbol with the next; valid).

        Runs of one word become one symbol, then twice every adjacent pair whose names hash to (0, 1) becomes one. Names are
        hashes of what they stand for, so they are the same everywhere without a dictionary; whether two symbols pair up
        depends on them alone, so equal passages have equal symbols but for LOSS words at either end.
        """
        w, n = self.words, len(self.words)
        head = np.zeros(n, bool)
        head[self.starts[:-1][self.sizes > 0]] = True
        new = head.copy()
        new[1:] |= w[1:] != w[:-1]
        at = np.flatnonzero(new)
        length = np.diff(np.append(at, n))
        many = length > 1
        runs = at[many], length[many], mix(w[at[many]] + _SALT[-1])
        sym = np.where(many, mix(w[at] ^ mix(length.astype(np.uint64) + _SALT[-2])), w[at])
        head = head[at]
        for r in range(ROUNDS):
            one = (mix(sym + _SALT[r]) & _U(1)).astype(bool)
            pair = ~one[:-1] & one[1:] & ~head[1:]
            left = np.flatnonzero(pair)
            sym[left] = mix(sym[left] * _U(0x9E3779B97F4A7C15) + mix(sym[left + 1] + _SALT[r]))
            keep = np.ones(len(sym), bool)
            keep[left + 1] = False
            sym, at, head = sym[keep], at[keep], head[keep]
        return runs, at, mix(sym[:-1] * _U(0xD6E8FEB86659FD93) + mix(sym[1:])), ~head[1:]

    def long(self, at: np.ndarray) -> np.ndarray:
        return self.sizes[self.doc[at]] >= WINDOW

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys of the documents that have windows, and whether two ids of this unit share each."""
        (run_at, _, run_key), at, key, valid = self.parse()
        use = valid & self.long(at[:-1])
        run_use = self.long(run_at)
        k = np.concatenate([key[use], run_key[run_use]])
        d = self.ids[self.doc[np.concatenate([at[:-1][use], run_at[run_use]])]]
        return _grouped(k, d)

    def candidates(self, shared) -> np.ndarray:
        """Starts of the windows that may occur elsewhere; shared: a test on keys.

        Whatever a repeated window holds beyond LOSS words from its ends is parsed alike everywhere, so each pair of
        neighbouring symbols there must be shared. Where a run of a word reaches into the outer words, its visible part may
        belong to runs of other lengths elsewhere: then the key of the run, which is free of its length, must be shared.
        """
        (run_at, run_len, run_key), at, key, valid = self.parse()
        n = len(self.words)
        if not n:
            return np.zeros(0, np.int64)
        bad = np.concatenate([[0], np.cumsum(valid & ~shared(key))])
        of = np.cumsum(np.bincount(at, minlength=n)) - 1
        starts = np.flatnonzero(self.window)
        ok = bad[of[starts + WINDOW - 1 - LOSS]] == bad[of[starts + LOSS]]
        if len(run_at):
            known = shared(run_key)
            lo, hi = self.starts[:-1][self.doc[run_at]], self.starts[1:][self.doc[run_at]]
            end = run_at + run_len
            seen = np.zeros((2, n + 1), np.int64)
            for a, b in ((run_at - LOSS + 1, end - 2), (run_at - WINDOW + 2, end - WINDOW + LOSS - 1)):
                a, b = np.clip(a, lo, hi), np.clip(b + 1, lo, hi)
                good = a < b
                for row, use in ((0, good), (1, good & known)):
                    np.add.at(seen[row], a[use], 1)
                    np.add.at(seen[row], b[use], -1)
            count, fine = np.cumsum(seen, axis=1)[:, starts]
            ok = np.where(count > 0, count == fine, ok)
        return starts[ok]

    def hashes(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two independent 64-bit hashes of the windows that start there."""
        out = np.zeros((2, len(starts)), np.uint64)
        for j in range(WINDOW):
            w = self.words[starts + j]
            for k in (0, 1):
                out[k] += w * _COEF[k, j]
        return mix(out[0]), mix(out[1])


def _grouped(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, and whether several ids have each."""
    if not len(keys):
        return keys, np.zeros(0, bool)
    order = np.argsort(keys, kind="stable")
    k, d = keys[order], ids[order]
    at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return k[at], np.minimum.reduceat(d, at) != np.maximum.reduceat(d, at)


def _lowest(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the smallest id of each, and of each input its key's place."""
    got, where = np.unique(keys, return_inverse=True)
    low = np.full(len(got), _LAST)
    np.minimum.at(low, where, ids)
    return got, low, where


def _dealt(bucket: np.ndarray, n: int):
    """(bucket, its members' places) for each bucket with members, places in their own order."""
    order = np.argsort(bucket, kind="stable")
    ends = np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=n))])
    for b in np.flatnonzero(np.diff(ends)):
        yield int(b), order[ends[b] : ends[b + 1]]


def _split(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    return (keys % _U(buckets)).astype(np.int64), (keys // _U(buckets)).astype(np.uint32)


def _table(rows: list[tuple], kinds: list[tuple[str, pa.DataType]]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) or [[] for _ in kinds]
    return pa.table({n: pa.array(c, t) for (n, t), c in zip(kinds, cols, strict=True)})


#: Columns that the operator adds or uses.
OWN = ("n_words", "n_removed", "kept", "_unit")
_KEYS = [("bucket", pa.int32()), ("unit", pa.int32()), ("multi", pa.bool_()), ("keys", pa.binary())]
_WINDOWS = [("bucket", pa.int32()), ("unit", pa.int32()), ("keys", pa.binary()), ("ids", pa.binary())]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with n_words, n_removed and kept: the text without each word covered by a window of 13 consecutive words that
    also starts in a document of a smaller id, words joined by one space.

    Words are the runs between ASCII space characters, unchanged; windows are judged on the input. A null text has no words.
    A null id counts as larger than any other; rows of one id do not remove each other's words. Ids must be integers. Other
    columns are carried (of docs' own columns n_words, n_removed, kept and _unit, none is).

    The documents are dealt into units of some megabytes by a hash of their ids, and that exchange is used three times. (1) A
    unit sends the distinct keys of its recompression parse to buckets of keys, which tell it the ones that other units have,
    too. (2) It sends the hashes of its candidate windows with their smallest id to buckets of windows, which tell it where a
    smaller id has one. (3) It removes the words. Keys and hashes travel packed, once for each unit, so a passage of a third
    of all documents is as small as any; a bucket's size is bounded by their number. Windows are told apart by 64 bits and
    their bucket, which is dealt by a second hash.
    """
    ship(docs.sparkSession)
    docs = docs.drop(*OWN)
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    units, buckets = int(max(64, size >> 22)), int(max(32, size // 15_000_000))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    unit = F.pmod(F.xxhash64(F.coalesce(F.col(id_col).cast("long"), F.xxhash64(text_col))), F.lit(units)).cast("int")
    dealt = docs.withColumn("_unit", unit).repartition(max(parts, min(units, size >> 26)), "_unit")

    def load(t: pa.Table) -> Unit:
        return Unit(t.column(id_col).cast(pa.int64()), t.column(text_col))

    def offer_keys(t: pa.Table) -> pa.Table:
        u, k = load(t), t.column("_unit")[0].as_py()
        keys, multi = u.keys()
        bucket, low = _split(keys, buckets)
        rows = []
        for b, at in _dealt(bucket, buckets):
            for m in (False, True):
                if (mine := at[multi[at] == m]).size:
                    rows.append((b, k, m, low[mine].tobytes()))
        return _table(rows, _KEYS)

    def match_keys(t: pa.Table) -> pa.Table:
        units, multi = t.column("unit").to_numpy(), t.column("multi").to_numpy()
        parts = [np.frombuffer(x, np.uint32) for x in t.column("keys").to_pylist()]
        sizes = [len(p) for p in parts]
        keys, entry = np.concatenate(parts), np.repeat(np.arange(len(parts), dtype=np.int32), sizes)
        order = np.argsort(keys, kind="stable")
        keys, entry = keys[order], entry[order]
        at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        n = np.diff(np.append(at, len(keys)))
        send = np.repeat(n > 1, n) & ~multi[entry]
        b = t.column("bucket")[0].as_py()
        return _table([(b, int(units[e]), False, keys[send][x].tobytes()) for e, x in _dealt(entry[send], len(parts))], _KEYS)

    def offer_windows(t: pa.Table, told: pa.Table) -> pa.Table:
        if not t.num_rows:
            return _table([], _WINDOWS)
        u, k = load(t), t.column("_unit")[0].as_py()
        known = [np.frombuffer(x, np.uint32).astype(np.uint64) | _U(b) << _U(32) for b, x in zip(told.column("bucket").to_pylist(), told.column("keys").to_pylist(), strict=True)]
        keys, multi = u.keys()
        own = _split(keys[multi], buckets)
        known = np.unique(np.concatenate([*known, own[0].astype(np.uint64) << _U(32) | own[1]]))

        def shared(keys: np.ndarray) -> np.ndarray:
            bucket, low = _split(keys, buckets)
            name = bucket.astype(np.uint64) << _U(32) | low
            at = np.searchsorted(known, name)
            return known[np.minimum(at, len(known) - 1)] == name if len(known) else np.zeros(len(name), bool)

        starts = u.candidates(shared)
        h1, h2 = u.hashes(starts)
        got, low, where = _lowest(h1, u.ids[u.doc[starts]])
        bucket = np.zeros(len(got), np.int64)
        bucket[where] = (h2 % _U(buckets)).astype(np.int64)
        order = np.argsort(low, kind="stable")  # by id, which then packs well
        got, low, bucket = got[order], low[order], bucket[order]
        del u, told, known, starts, h1, h2, where
        settle()
        return _table([(b, k, got[x].tobytes(), low[x].tobytes()) for b, x in _dealt(bucket, buckets)], _WINDOWS)

    def match_windows(t: pa.Table) -> pa.Table:
        units = t.column("unit").to_numpy()
        parts = [np.frombuffer(x, np.uint64) for x in t.column("keys").to_pylist()]
        ids = np.concatenate([np.frombuffer(x, np.int64) for x in t.column("ids").to_pylist()])
        entry = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        keys = np.concatenate(parts)
        _, low, where = _lowest(keys, ids)
        low = low[where]
        send = np.flatnonzero(low < ids)
        send = send[np.argsort(low[send], kind="stable")]
        b = t.column("bucket")[0].as_py()
        return _table([(b, int(units[e]), keys[send[x]].tobytes(), low[send[x]].tobytes()) for e, x in _dealt(entry[send], len(parts))], _WINDOWS)

    out = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])

    def remove(t: pa.Table, told: pa.Table) -> pa.Table:
        if not t.num_rows:
            t = t.drop_columns(["_unit"])
            return t.append_column("n_words", pa.array([], pa.int64())).append_column("n_removed", pa.array([], pa.int64())).append_column("kept", pa.array([], pa.string()))
        u = load(t)
        starts = np.flatnonzero(u.window)
        h1, _ = u.hashes(starts)
        ids = u.ids[u.doc[starts]]
        got, low, where = _lowest(h1, ids)
        for keys, lows in zip(told.column("keys").to_pylist(), told.column("ids").to_pylist(), strict=True):
            if len(got):
                keys = np.frombuffer(keys, np.uint64)
                at = np.minimum(np.searchsorted(got, keys), len(got) - 1)
                hit = got[at] == keys
                np.minimum.at(low, at[hit], np.frombuffer(lows, np.int64)[hit])
        gone = starts[low[where] < ids] if len(starts) else starts
        edge = np.bincount(gone, minlength=len(u.words) + WINDOW + 1) - np.bincount(gone + WINDOW, minlength=len(u.words) + WINDOW + 1)
        cover = np.cumsum(edge)[: len(u.words)] > 0
        removed = np.diff(np.concatenate([[0], np.cumsum(cover)])[u.starts])
        kept = []
        for i, words in enumerate(u.texts):
            if removed[i]:
                words = [words[j] for j in np.flatnonzero(~cover[u.starts[i] : u.starts[i + 1]])]
            kept.append(b" ".join(words))
        sizes = u.sizes
        del u, told, starts, h1, ids, got, low, where, gone, edge, cover
        settle()
        t = t.drop_columns(["_unit"])
        return t.append_column("n_words", pa.array(sizes)).append_column("n_removed", pa.array(removed.astype(np.int64))).append_column("kept", pa.array(kept, pa.binary()).cast(pa.string()))

    k_type, w_type = "bucket int, unit int, multi boolean, keys binary", "bucket int, unit int, keys binary, ids binary"
    keys = dealt.groupBy("_unit").applyInArrow(offer_keys, k_type).groupBy("bucket").applyInArrow(match_keys, k_type)
    wins = dealt.groupBy("_unit").cogroup(keys.groupBy("unit")).applyInArrow(offer_windows, w_type).groupBy("bucket").applyInArrow(match_windows, w_type)
    return dealt.groupBy("_unit").cogroup(wins.groupBy("unit")).applyInArrow(remove, out)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without passages that a document of a smaller id has."""
    got = remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {"op6_substring_dedup": op6_substring_dedup}

ORACLE = {
    "op6_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, s, array_to_string(ws[s : s + 12], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS s FROM d WHERE len(ws) >= 13)),
f AS (SELECT win, min(doc_id) AS low FROM w GROUP BY win),
c AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(s, s + 13)) AS p FROM w JOIN f USING (win) WHERE low < doc_id) GROUP BY 1),
x AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM d),
g AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(ps) AS p FROM c)),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept FROM x ANTI JOIN g USING (doc_id, p) GROUP BY 1)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN c USING (doc_id) LEFT JOIN k USING (doc_id)"""
}

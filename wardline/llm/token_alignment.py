"""Operator 12: alignment of two tokenizers, its pair counts in dense vectors that a minimal perfect hash indexes."""

from __future__ import annotations

import base64
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm.common import kept, read, settle, ship

#: Pairs in a bucket, each with a hash of its own; buckets whose tables one pass sends to all tasks; distinct pairs that a task holds.
BUCKET, SLICE, HELD = 1 << 15, 64, 1 << 20
#: White space in a row from which on the fast encoder of A is not trusted with a text (its recursion is not bounded).
BLANK = 100_000
#: Bits of a pair's key for the token of B, bits of each level of a hash for each key, and levels before keys are listed.
SHIFT, GAMMA, LEVELS = 32, 1.6, 24
_U = np.uint64
_pairs: dict = {}


def mix(x: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit hash, of which each salt gives another."""
    x = (x + _U((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & ((1 << 64) - 1))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(32))


class Hash:
    """A minimal perfect hash: the n distinct keys it was made of go to 0..n-1, without collisions, at about 5 bits a key.

    At each level the keys left are hashed to bits; a key alone on its bit stays there, the others go on to the next level. A
    key's place is the number of bits set before its own. Other keys go anywhere, so what is looked up must be verified.
    """

    def __init__(self, levels: list[np.ndarray], rest: np.ndarray):
        self.levels, self.rest, n = levels, rest, 0
        self.before = []
        for words in levels:
            up = np.cumsum(np.bitwise_count(words), dtype=np.int64)
            self.before.append(n + np.concatenate([[0], up[:-1]]))
            n += int(up[-1])
        self.n = n + len(rest)

    @staticmethod
    def of(keys: np.ndarray) -> Hash:
        """keys: distinct, of 64 bits."""
        levels = []
        while len(keys) and len(levels) < LEVELS:
            bits = -(-max(64, int(GAMMA * len(keys))) // 64) * 64
            at = (mix(keys, len(levels)) % _U(bits)).astype(np.int64)
            alone = np.bincount(at, minlength=bits) == 1
            levels.append(np.packbits(alone, bitorder="little").view(_U))
            keys = keys[~alone[at]]
        return Hash(levels, np.sort(keys))

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The keys' places; for a key that the hash was not made of, one of 0..n-1 or n."""
        out, left, key = np.full(len(keys), self.n, np.int64), np.arange(len(keys)), keys
        for k, (words, before) in enumerate(zip(self.levels, self.before, strict=True)):
            bit = mix(key, k) % _U(64 * len(words))
            word, low = (bit >> _U(6)).astype(np.int64), bit & _U(63)
            hit = (words[word] >> low & _U(1)).astype(bool)
            below = words[word[hit]] & ((_U(1) << low[hit]) - _U(1))
            out[left[hit]] = before[word[hit]] + np.bitwise_count(below)
            left, key = left[~hit], key[~hit]
        if len(self.rest):
            at = np.minimum(np.searchsorted(self.rest, key), len(self.rest) - 1)
            same = self.rest[at] == key
            out[left[same]] = self.n - len(self.rest) + at[same]
        return out

    def pack(self) -> bytes:
        head = np.array([len(self.levels), *map(len, self.levels), len(self.rest)], _U)
        return b"".join(x.tobytes() for x in (head, *self.levels, self.rest))

    @staticmethod
    def unpack(data: bytes) -> Hash:
        x = np.frombuffer(data, _U)
        sizes = x[1 : 2 + int(x[0])].astype(np.int64)
        parts = np.split(x[2 + int(x[0]) :], np.cumsum(sizes)[:-1])
        return Hash(parts[:-1], parts[-1])


class Pair:
    """Both tokenizers: ids of texts, and each id's bytes."""

    def __init__(self, a: str, b: str, ranks: str, pattern: str):
        import sentencepiece
        import tiktoken

        self.a_file, self._slow = a, None
        with open(ranks, "rb") as f:
            table = {base64.b64decode(x): int(y) for x, y in map(bytes.split, f)}
        self._fast = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self._b = sentencepiece.SentencePieceProcessor(model_file=b)
        with open(a, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        byte = {c: n for n, c in enumerate(byte_letters())}
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for entry, k in vocab.items():
            self.a_bytes[k] = bytes(byte[c] for c in entry) if all(c in byte for c in entry) else entry.encode()
        pieces = [self._b.id_to_piece(k) for k in range(self._b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self._b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.sizes = [np.fromiter(map(len, x), np.int64, len(x)) for x in (self.a_bytes, self.b_bytes)]
        comma, semi, bar = ([f"{c}{k}" for k in range(max(map(len, self.sizes)))] for c in ",;|")
        self.named = [*comma, *semi, *bar]  # an id after each of the signs
        self.kind = np.uint16 if max(map(len, self.sizes)) <= 1 << 16 else np.uint32  # of stored ids
        self.blank = re.compile(rf"\s{{{BLANK}}}")

    def encode_a(self, text: str) -> list[int]:
        if len(text) > BLANK and self.blank.search(text):
            if self._slow is None:
                from tokenizers import Tokenizer

                self._slow = Tokenizer.from_file(self.a_file)
                self._slow.encode_special_tokens = True
            return self._slow.encode(text, add_special_tokens=False).ids
        return self._fast.encode_ordinary(text)

    def encode(self, text: str | None) -> tuple[list[int], list[int]]:
        """Ids by both; none if the text is empty, or if either's tokens are not the bytes of a space and the text."""
        if not text:
            return [], []
        a, b, whole = self.encode_a(" " + text), self._b.encode(text), b" " + text.encode()
        ok = b"".join(map(self.a_bytes.__getitem__, a)) == whole and b"".join(map(self.b_bytes.__getitem__, b)) == whole
        return (a, b) if ok else ([], [])


def byte_letters() -> str:
    """The letters that stand for bytes 0 to 255 in a byte-level vocabulary: a printable byte for itself, the others from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return "".join(chr(n if n in plain else next(other)) for n in range(256))


def pair(files: tuple[str, str, str, str]) -> Pair:
    """One pair of tokenizers for each Python worker."""
    if files not in _pairs:
        _pairs[files] = Pair(*files)
    return _pairs[files]


def installed() -> tuple[str, str, str, str]:
    """Files of A, of B, of A's ranks, and its pattern."""
    import public_tokenizers as P

    return P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN


def encoded(docs: DataFrame, files: tuple[str, str, str, str], id_col: str, text_col: str) -> DataFrame:
    """Rows (uid, id_col, a, b), written into the shared folder: ids by both tokenizers, as binary of 16 bits each (32
    if a vocabulary needs them); uid is the row's own."""
    ship(docs.sparkSession)

    def work(batches):
        p = pair(files)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                got = [p.encode(t.as_py()) for t in part.column(1)]
                cols = [pa.array([np.array(x[k], p.kind).tobytes() for x in got], pa.binary()) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], [id_col, "a", "b"])
        settle()

    kind = docs.schema[id_col].dataType.simpleString()
    got = docs.select(id_col, text_col).mapInArrow(work, f"{id_col} {kind}, a binary, b binary")
    return kept(got.select(F.monotonically_increasing_id().alias("uid"), id_col, "a", "b"))


class Aligned:
    """Documents of a batch: their tokens side by side, and where the ends of tokens of A and of B meet."""

    def __init__(self, a: pa.Array, b: pa.Array, p: Pair):
        self.ids, self.n, ends = [], [], []
        for col, size in zip((a, b), p.sizes, strict=True):
            raw = [x.as_py() for x in col]
            self.ids.append(np.frombuffer(b"".join(raw), p.kind).astype(np.int64))
            self.n.append(np.fromiter(map(len, raw), np.int64, len(raw)) // p.kind().itemsize)
            ends.append(np.cumsum(size[self.ids[-1]]))  # both of a document's sides have the same bytes, so it goes on from the last one's end
        mark = np.zeros(int(max([e[-1] for e in ends if len(e)], default=0)) + 1, bool)
        mark[ends[0]] = True
        self.b_at = np.flatnonzero(mark[ends[1]])  # tokens that end a group
        mark[:] = False
        mark[ends[1]] = True
        self.a_at = np.flatnonzero(mark[ends[0]])
        stops = np.concatenate([[0], np.cumsum(self.n[1])])
        self.groups = np.searchsorted(self.b_at, stops)  # of all documents before each
        self.keys = self.ids[0][self.a_at].astype(_U) << _U(SHIFT) | self.ids[1][self.b_at].astype(_U)

    def text(self, named: list[str]) -> list[str]:
        """Each document's groups, as in `a1,a2|b1;a3|b2`."""
        v, (na, nb) = len(named) // 3, map(len, self.ids)
        ga, gb = np.zeros(na + 1, np.int64), np.zeros(nb + 1, np.int64)
        ga[self.a_at + 1], gb[self.b_at + 1] = 1, 1
        new_a, new_b = ga[:na] > 0, gb[:nb] > 0
        new_a[:1] = new_b[:1] = True
        ga, gb = np.cumsum(ga)[:na], np.cumsum(gb)[:nb]  # a token's group
        b_before = np.concatenate([[0], self.b_at + 1])  # tokens of B in the groups before each
        a_until = np.append(self.a_at + 1, na)
        code = np.empty(na + nb, np.int64)
        code[np.arange(na) + b_before[ga]] = self.ids[0] + v * new_a
        code[np.arange(nb) + a_until[gb]] = self.ids[1] + 2 * v * new_b
        ends = np.cumsum(self.n[0] + self.n[1])
        code, at, out = code.tolist(), 0, []
        for end in ends.tolist():
            out.append("".join(map(named.__getitem__, code[at:end]))[1:])
            at = end
        return out


def in_parts(batches, rows: int = 256):
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def linked(tokens: DataFrame, files: tuple[str, str, str, str]) -> DataFrame:
    """Rows (key, n), written into the shared folder: how often each task has linked a pair. A task holds HELD distinct pairs."""

    def work(batches):
        p = pair(files)
        keys, n, waiting, rows = np.zeros(0, _U), np.zeros(0, np.int64), [], 0

        def summed():
            k, inv = np.unique(np.concatenate([keys, *waiting]), return_inverse=True)
            return k, np.bincount(inv, weights=np.concatenate([n, np.ones(rows)]), minlength=len(k)).astype(np.int64)

        for part in in_parts(batches):
            got = Aligned(part.column("a"), part.column("b"), p).keys
            waiting.append(got)
            rows += len(got)
            if rows > HELD:
                keys, n = summed()
                waiting, rows = [], 0
                if len(keys) > HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["key", "n"])
                    keys, n = keys[:0], n[:0]
        keys, n = summed()
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["key", "n"])
        settle()

    return kept(tokens.select("a", "b").mapInArrow(work, "key bigint, n bigint"))


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(keys, 99) % _U(buckets)).astype(np.int64)


def hashed(links: DataFrame, size: int = BUCKET) -> DataFrame:
    """Rows (bucket, hash, keys), written into the shared folder: the distinct pairs dealt into buckets of about `size`, each bucket's
    minimal perfect hash, and its keys in the hash's order."""
    keys = kept(links.select("key").distinct())
    buckets = max(1, -(-keys.count() // size))

    def deal(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(bucket_of(b.column(0).to_numpy().view(_U), buckets)), b.column(0)], ["bucket", "key"])

    def build(t: pa.Table) -> pa.Table:
        k = t.column("key").to_numpy().view(_U)
        h, order = Hash.of(k), np.empty(len(k), _U)
        order[h(k)] = k
        return pa.table({"bucket": t.column("bucket").slice(0, 1), "hash": pa.array([h.pack()], pa.binary()), "keys": pa.array([order.tobytes()], pa.binary())})

    dealt = keys.mapInArrow(deal, "bucket bigint, key bigint")
    return kept(dealt.groupBy("bucket").applyInArrow(build, "bucket bigint, hash binary, keys binary"))


def add_up(vectors: DataFrame, *by: str) -> DataFrame:
    """The sums of int64 vectors (binary) of equal length."""

    def work(t: pa.Table) -> pa.Table:
        total = np.frombuffer(t.column("vector")[0].as_py(), np.int64).copy()
        for x in t.column("vector")[1:]:
            total += np.frombuffer(x.as_py(), np.int64)
        return pa.table({**{c: t.column(c).slice(0, 1) for c in by}, "vector": pa.array([total.tobytes()], pa.binary())})

    return vectors.groupBy(*by).applyInArrow(work, ", ".join([*(f"{c} bigint" for c in by), "vector binary"]))


def counted(links: DataFrame, hashes: DataFrame, slice_: int = SLICE) -> DataFrame:
    """Rows (bucket, hash, keys, counts), written into the shared folder: each pair's links in all, in the order of its bucket's hash.

    A task adds its links into one dense vector a bucket, and the vectors are added up in a tree: first in about as many groups as
    the square root of the tasks, then all. As many tasks count as keep their vectors full to a quarter, so what is exchanged
    stays within some 32 bytes for each row of links. The hashes of `slice_` buckets at a time are sent to all tasks.
    """
    spark = links.sparkSession
    buckets, pairs = hashes.select(F.coalesce(F.max("bucket") + 1, F.lit(0)), F.coalesce(F.sum(F.octet_length("keys")), F.lit(0)) / 8).first()
    if not buckets:
        return hashes.withColumn("counts", F.lit(b""))
    tasks = max(1, min(links.rdd.getNumPartitions(), int(4 * links.count() / pairs)))
    branches = max(1, int(tasks**0.5))
    links, parts = links.coalesce(tasks), []
    for low in range(0, buckets, slice_):
        sent = spark.sparkContext.broadcast({r.bucket: bytes(r.hash) for r in hashes.where(F.col("bucket").between(low, low + slice_ - 1)).select("bucket", "hash").toLocalIterator()})

        def work(batches, sent=sent):
            from pyspark import TaskContext

            known = {b: Hash.unpack(x) for b, x in sent.value.items()}
            vectors: dict[int, np.ndarray] = {}
            for batch in batches:
                keys, n = batch.column(0).to_numpy().view(_U), batch.column(1).to_numpy()
                of = bucket_of(keys, buckets)
                for b, at in dealt_out(of):
                    if b in known:
                        if b not in vectors:
                            vectors[b] = np.zeros(known[b].n, np.int64)
                        np.add.at(vectors[b], known[b](keys[at]), n[at])
            branch = TaskContext.get().partitionId() % branches
            for b, v in vectors.items():
                yield pa.RecordBatch.from_arrays([pa.array([b]), pa.array([branch]), pa.array([v.tobytes()], pa.binary())], ["bucket", "branch", "vector"])
            settle()

        parts.append(links.mapInArrow(work, "bucket bigint, branch bigint, vector binary"))
    vectors = parts[0]
    for p in parts[1:]:
        vectors = vectors.union(p)
    total = add_up(add_up(vectors, "bucket", "branch"), "bucket").withColumnRenamed("vector", "counts")
    return kept(hashes.join(total, "bucket"))


def dealt_out(of: np.ndarray):
    """(value, its places) for each value of `of`."""
    order = np.argsort(of, kind="stable")
    at = np.flatnonzero(np.concatenate([[True], of[order][1:] != of[order][:-1]])) if len(of) else np.zeros(0, np.int64)
    for k, z in zip(at, [*at[1:], len(of)], strict=True):
        yield int(of[order[k]]), order[k:z]


def pair_counts(counts: DataFrame) -> DataFrame:
    """Rows (a_id, b_id, links) of `counted`: how many links of all documents hold each pair."""

    def work(batches):
        for batch in batches:
            for keys, n in zip(batch.column(0), batch.column(1), strict=True):
                k = np.frombuffer(keys.as_py(), _U)
                cols = [(k >> _U(SHIFT)).astype(np.int32), (k & _U((1 << SHIFT) - 1)).astype(np.int32), np.frombuffer(n.as_py(), np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["a_id", "b_id", "links"])

    return counts.select("keys", "counts").mapInArrow(work, "a_id int, b_id int, links bigint")


def looked_up(tokens: DataFrame, counts: DataFrame, files: tuple[str, str, str, str], id_col: str, slice_: int = SLICE) -> DataFrame:
    """The documents aligned again, with their links' counts: see `align`. The tables of `slice_` buckets at a time, about 35 MB, are
    sent to all tasks, and the highest count of each token of B (there are no more than B has tokens)."""
    spark = tokens.sparkSession
    best = {r.b_id: r.m for r in pair_counts(counts).groupBy("b_id").agg(F.max("links").alias("m")).collect()}
    buckets = counts.select(F.coalesce(F.max("bucket") + 1, F.lit(0))).first()[0]
    top = np.zeros(1 + max(best, default=0), np.int64)
    top[list(best)] = list(best.values())
    kind = tokens.schema[id_col].dataType.simpleString()
    own = f"{id_col} {kind}, n_a bigint, n_b bigint, n_groups bigint, groups string, "
    parts = []
    for low in range(0, max(1, buckets), slice_):
        rows = counts.where(F.col("bucket").between(low, low + slice_ - 1)).toLocalIterator()
        sent = spark.sparkContext.broadcast((top, {r.bucket: (bytes(r.hash), bytes(r["keys"]), bytes(r.counts)) for r in rows}))

        def work(batches, sent=sent, low=low):
            p, (top, raw) = pair(files), sent.value
            known = {b: (Hash.unpack(h), np.frombuffer(k, _U), np.frombuffer(n, np.int64)) for b, (h, k, n) in raw.items()}
            for part in in_parts(batches):
                x = Aligned(part.column("a"), part.column("b"), p)
                n, n_best = np.zeros(len(x.keys), np.int64), np.zeros(len(x.keys), np.int64)
                for b, at in dealt_out(bucket_of(x.keys, buckets)):
                    if b in known:
                        h, keys, links = known[b]
                        got = h(x.keys[at])
                        if (got >= len(keys)).any() or (keys[got] != x.keys[at]).any():
                            raise ValueError("a pair that the count does not have: the documents have changed between the passes")
                        n[at] = links[got]
                        n_best[at] = n[at] == top[(keys[got] & _U((1 << SHIFT) - 1)).astype(np.int64)]
                sums = [np.diff(np.concatenate([[0], np.cumsum(v)])[x.groups]) for v in (n_best, n)]
                cols = [part.column("uid"), pa.array(sums[0]), pa.array(sums[1])]
                if not low:
                    cols = [part.column(id_col), pa.array(x.n[0]), pa.array(x.n[1]), pa.array(np.diff(x.groups)), pa.array(x.text(p.named), pa.string()), *cols]
                yield pa.RecordBatch.from_arrays(cols, [id_col, "n_a", "n_b", "n_groups", "groups", "uid", "n_best", "count_sum"][-len(cols) :])
            settle()

        parts.append(tokens.mapInArrow(work, own * (not low) + "uid bigint, n_best bigint, count_sum bigint"))
    out = parts[0]
    if parts[1:]:
        more = parts[1]
        for p in parts[2:]:
            more = more.union(p)
        more = more.groupBy("uid").agg(F.sum("n_best").alias("m_best"), F.sum("count_sum").alias("m_sum"))
        out = out.join(more, "uid").withColumns({"n_best": F.col("n_best") + F.col("m_best"), "count_sum": F.col("count_sum") + F.col("m_sum")})
    return out.select(id_col, "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups")


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", files: tuple[str, str, str, str] | None = None, bucket: int = BUCKET, slice_: int = SLICE) -> DataFrame:
    """Rows (id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups): every whole text by two tokenizers, and how they meet.

    A encodes a space and the text, B the text, to which it adds a space. Byte offsets where tokens of both end cut them into
    groups (`a1,a2|b1;a3|b2`, decimal ids). The two tokens that end there are linked (no token of either vocabulary is empty). A
    pair's count is the number of its links in all documents; n_best are a text's links whose count is the highest of their
    token of B, ties included, and count_sum adds up the counts of its links.

    Texts that are null, empty, or not what either's tokens stand for have no tokens. Rows may repeat, each counting again; ids may
    be null; other columns are ignored. First pass: encode, link, count. The distinct pairs get a minimal perfect hash,
    built in buckets; counts are dense vectors in its order, added up in a tree. Second pass: align again from the stored ids
    and look counts up, each key verified. Tables lie in the shared folder; nothing on the driver grows beyond one slice of buckets.
    """
    files = files or installed()
    tokens = encoded(docs, files, id_col, text_col)
    links = linked(tokens, files)
    return looked_up(tokens, counted(links, hashed(links, bucket), slice_), files, id_col, slice_)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both tokenizers' alignment of every document, with the counts of its links."""
    got = align(read(spark, sf_dir, "documents"))
    digest = F.when(F.col("n_a") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise("")
    return got.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256"))


QUERIES = {"op12_token_alignment": op12_token_alignment}

"""Operator 3: byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue."""

from __future__ import annotations

import base64
import re
import sys
from array import array
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm.common import by_few, read, settle, ship

#: Bytes of each of the two generations of chunks and pieces that a task remembers, their longest length, the bytes that an entry
#: takes besides its text and ids, and about how many chunks are looked up at once, between two looks at the room.
ROOM, LONG, ENTRY, MANY = 50_000_000, 48, 190, 50_000
#: Pieces whose queues run side by side, and the most bytes such a piece may have.
SIDE, SHORT = 2048, 64
# Letters and digits that came after Unicode 16.0, which the encoder to match goes by; the installed `regex` knows later ones.
NEWER = (
    "\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d"
    "\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb"
    "\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8"
    "\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20"
    "\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6"
    "\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de"
    "\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff"
    "\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
_BITS = [1 << i for i in range(256)]
_BIT, _ONE = np.uint64(1) << np.arange(64, dtype=np.uint64), np.uint64(1)
_STOPS = frozenset(",.;:!?)")
_codecs: dict = {}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the adjacent pair of lowest rank, leftmost first, is merged until no pair has a rank.

    Tokens form a linked list over their start positions. Each rank has a bucket of starts (a heap, so that the leftmost comes
    first); a two-level bitmap (256 ranks a word, and a bit for each word) finds the lowest rank in use by find-first-set.
    Entries whose pair has another rank by now are stale and skipped. A piece of n bytes takes O(n log n).
    """
    n, find = len(piece), ranks.get
    end, prev = list(range(1, n + 1)), list(range(-1, n - 1))
    pair = [find(piece[i : i + 2]) for i in range(n - 1)]  # rank of the pair that starts there
    pair.append(None)
    buckets: dict[int, list[int]] = {}
    words: dict[int, int] = {}
    top = 0
    for i, r in enumerate(pair):
        if r in buckets:
            buckets[r].append(i)
        elif r is not None:
            buckets[r] = [i]
            w = r >> 8
            if w in words:
                words[w] |= _BITS[r & 255]
            else:
                words[w] = _BITS[r & 255]
                top |= 1 << w
    while top:
        w = (top & -top).bit_length() - 1
        bits = words[w]
        first = bits & -bits
        r = (w << 8) + first.bit_length() - 1
        bucket = buckets[r]
        if len(bucket) > 1:
            i = heappop(bucket)
        else:
            i = bucket[0]
            del buckets[r]
            if bits == first:
                del words[w]
                top &= top - 1
            else:
                words[w] = bits ^ first
        if pair[i] != r:
            continue
        j = end[i]
        k = end[i] = end[j]
        pair[i] = pair[j] = None
        if k < n:
            prev[k] = i
            q = pair[i] = find(piece[i : end[k]])
            if q is not None:
                if q in buckets:
                    heappush(buckets[q], i)
                else:
                    buckets[q] = [i]
                    v = q >> 8
                    if v in words:
                        words[v] |= _BITS[q & 255]
                    else:
                        words[v] = _BITS[q & 255]
                        top |= 1 << v
        s = prev[i]
        if s >= 0:
            q = pair[s] = find(piece[s:k])
            if q is not None:
                if q in buckets:
                    heappush(buckets[q], s)
                else:
                    buckets[q] = [s]
                    v = q >> 8
                    if v in words:
                        words[v] |= _BITS[q & 255]
                    else:
                        words[v] = _BITS[q & 255]
                        top |= 1 << v
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Queues:
    """Rank queues of many short pieces, side by side: what `merge` does to one piece, a step of all pieces at a time.

    Each piece has a hierarchical bitmap of its own over the ranks: words of 64 bits, a bit of the level above for each word that is
    not 0, and one word on top. Find-first-set from the top down gives a piece's lowest rank in use, and the leftmost pair of that rank is
    merged. A bit whose pairs are gone is cleared when it comes up. The bitmaps are all 0 again when the pieces are done.
    """

    def __init__(self, ranks: dict[bytes, int], side: int = SIDE):
        self.side, find = side, ranks.get
        pairs = {}  # two tokens whose bytes together have a rank: pairs of ids say as much as pairs of texts, as all parts are tokens
        for text, r in ranks.items():
            for i in range(1, len(text)):
                a, b = find(text[:i]), find(text[i:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = r
        self.keys = np.array(sorted(pairs), np.int64)
        self.rank = np.array([pairs[k] for k in self.keys.tolist()] + [-1], np.int32)
        self.keys = np.append(self.keys, np.iinfo(np.int64).max)
        self.single = np.array([find(bytes([b]), -1) for b in range(256)], np.int32)
        self.whole = bool((self.single >= 0).all())
        two = np.array([find(bytes([a, b]), -1) for a in range(256) for b in range(256)], np.int32)
        self.two = two
        self.levels, n = [], max(ranks.values(), default=0) + 1
        while not self.levels or n > 1:
            n = -(-n // 64)
            self.levels.append((n, np.zeros(side * n, np.uint64)))

    def paired(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, -1 where it has none; an id of -1 has none with any."""
        key = (left.astype(np.int64) << 32) + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.rank[at], -1)

    def put(self, rows: np.ndarray, ranks: np.ndarray) -> None:
        """A rank for each of some different pieces; -1 is none."""
        some = ranks >= 0
        rows, q = rows[some], ranks[some].astype(np.int64)
        for n, words in self.levels:
            words[rows * n + (q >> 6)] |= _BIT[q & 63]
            q >>= 6

    def drop(self, rows: np.ndarray, q: np.ndarray) -> None:
        for n, words in self.levels:
            at = rows * n + (q >> 6)
            left = words[at] & ~_BIT[q & 63]
            words[at] = left
            empty = left == 0
            rows, q = rows[empty], q[empty] >> 6

    def lowest(self, rows: np.ndarray) -> np.ndarray:
        q = np.zeros(len(rows), np.int64)
        for n, words in reversed(self.levels):
            x = words[rows * n + q]
            q = (q << 6) + np.bitwise_count((x & (~x + _ONE)) - _ONE)
        return q

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece as bytes of 32-bit integers. Pieces must not be empty."""
        out = [b""] * len(pieces)
        order = sorted(range(len(pieces)), key=lambda i: len(pieces[i]))
        for at in range(0, len(order), self.side):
            part = order[at : at + self.side]
            for i, got in zip(part, self._merge([pieces[i] for i in part]), strict=True):
                out[i] = got
        return out

    def _merge(self, pieces: list[bytes]) -> list[bytes]:
        length = np.fromiter(map(len, pieces), np.int64, len(pieces))
        width = int(length.max()) + 1  # a place behind the last byte is always free
        live = np.arange(width) < length[:, None]
        text = np.zeros(live.shape, np.int64)
        text[live] = np.frombuffer(b"".join(pieces), np.uint8)
        pair = np.full(live.shape, -1, np.int32)
        pair[:, :-1] = np.where(live[:, 1:], self.two[text[:, :-1] << 8 | text[:, 1:]], -1)
        rows = np.arange(len(pieces))
        for column in pair.T[: width - 1]:
            self.put(rows, column)
        ids = np.where(live, self.single[text], -1).ravel()
        live, ranks = live.ravel(), pair.ravel()
        end = np.arange(1, len(ids) + 1)
        prev = np.arange(-1, len(ids) - 1)
        prev[::width] = -1  # the last place of all, which is free
        top = self.levels[-1][1]
        rows = rows[top[rows] != 0]
        while len(rows):
            r = self.lowest(rows)
            same = pair[rows] == r[:, None]
            count = np.count_nonzero(same, axis=1)
            i = rows * width + same.argmax(axis=1)
            last = count <= 1
            self.drop(rows[last], r[last])
            due = count > 0
            mine, i, r = rows[due], i[due], r[due].astype(np.int32)
            j = end[i]
            k = end[j]
            s = prev[i]
            end[i], ids[i], live[j], ranks[j], prev[k] = k, r, False, -1, i
            q = np.where(k < (mine + 1) * width, self.paired(r, ids[k]), -1)
            ranks[i] = q
            self.put(mine, q)
            q = self.paired(ids[s], r)
            ranks[s] = q
            self.put(mine, q)
            rows = rows[top[rows] != 0]
        ends = np.cumsum(np.count_nonzero(live.reshape(-1, width), axis=1) * 4).tolist()
        blob = ids[live].astype(np.int32).tobytes()
        return [blob[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


class _Now(dict):
    """Chunk of text -> its ids as bytes of 32-bit integers, filled on demand by a codec."""

    __slots__ = ("codec",)

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec = codec

    def __missing__(self, chunk: str) -> bytes:
        return self.codec.ids_of(chunk)


class Codec:
    """Encodes and decodes whole texts. Chunks seen lately are remembered in two generations of about `room` bytes each."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, room: int = ROOM):
        import regex

        self.ranks, self.room = ranks, room
        self._pieces = regex.compile(pattern)
        self._newer = regex.compile(f"[{NEWER}]")
        self.bytes_of = dict(zip(ranks.values(), ranks.keys(), strict=True))
        self.entries, self.queues = None, None
        self.runs = re.compile(r"\s\s|\x00").search
        self.forget()

    def forget(self) -> None:
        self.old, self.now, self.left = {}, _Now(self), self.room

    def pieces(self, text: str) -> list[str]:
        """Matches of the pattern; characters of NEWER count as neither letters nor digits."""
        if text.isascii() or not self._newer.search(text):
            return self._pieces.findall(text)
        return [text[m.start() : m.end()] for m in self._pieces.finditer(self._newer.sub("\U000f0000", text))]

    def split(self, chunk: str) -> tuple[str, ...] | list[str]:
        """The pieces of a chunk."""
        head = chunk[:-1]
        if chunk.isalpha() or chunk[:1] == " " and chunk[1:].isalpha():  # one run of letters is one piece
            return (chunk,)
        if chunk[-1:] in _STOPS and head and (head.isalpha() or head[0] == " " and head[1:].isalpha()):
            return head, chunk[-1]
        return self.pieces(chunk)

    def keep(self, chunk: str, ids: bytes) -> None:
        self.now[chunk] = ids
        self.left -= ENTRY + len(chunk) + len(ids)

    def ids_of(self, chunk: str) -> bytes:
        """Ids of a chunk that is not among the newer generation."""
        got = self.old.get(chunk)
        if got is None:
            pieces = self.split(chunk)
            if len(pieces) == 1:
                b = chunk.encode()
                r = self.ranks.get(b)
                got = array("i", merge(b, self.ranks)).tobytes() if r is None else r.to_bytes(4, sys.byteorder)
            else:  # a piece alone is one piece again
                got = b"".join(map(self.now.__getitem__, pieces))
        if len(chunk) <= LONG:
            self.keep(chunk, got)
        return got

    def learn(self, chunks: set[str]) -> None:
        """Bring chunks that are not in the newer generation into it, but long ones; pieces seen in neither are merged side by side."""
        now, old, ranks = self.now, self.old.get, self.ranks.get
        joined, fresh = [], set()
        for chunk in chunks:
            if len(chunk) > LONG:
                continue
            got = old(chunk)
            if got is not None:
                self.keep(chunk, got)
                continue
            pieces = self.split(chunk)
            if len(pieces) == 1:
                fresh.add(chunk)
            else:
                joined.append((chunk, pieces))
                fresh.update(pieces)
        many = {}
        for piece in fresh:
            if piece not in now:
                b = piece.encode()
                r = ranks(b)
                if r is not None:
                    self.keep(piece, r.to_bytes(4, sys.byteorder))
                elif 0 < len(b) <= SHORT:
                    many[piece] = b
        if many:
            self.queues = self.queues or Queues(self.ranks)
            if self.queues.whole:
                for piece, got in zip(many, self.queues.merge(list(many.values())), strict=True):
                    self.keep(piece, got)
        for chunk, pieces in joined:
            self.keep(chunk, b"".join(map(now.__getitem__, pieces)))

    def chunks(self, text: str) -> list[str]:
        """A text where no two white-space characters meet is cut before each space and around each newline: no pre-token
        reaches over such a cut, so the chunks' ids in turn are the text's."""
        if self.runs(text):
            return self.pieces(text)
        return text.replace(" ", "\x00 ").replace("\n", "\x00\n\x00").split("\x00")

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def looked_up(self, chunks: list[str]) -> list[bytes]:
        """Ids of each chunk."""
        if self.left < 0:
            self.old, self.now, self.left = self.now, _Now(self), self.room
        got = list(map(self.now.get, chunks))
        missing = [i for i, x in enumerate(got) if x is None]
        self.learn({chunks[i] for i in missing})
        for i in missing:
            got[i] = self.now[chunks[i]]
        return got

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text. Chunks of short texts are looked up together, those of long ones in parts."""
        out, group, n = [], [], 0
        for i, text in enumerate(texts):
            group.append(self.chunks(text))
            n += len(group[-1])
            if n < MANY and i + 1 < len(texts):
                continue
            ids = []
            flat = [c for chunks in group for c in chunks]
            for at in range(0, n, MANY):
                ids += self.looked_up(flat[at : at + MANY])
            at = 0
            for chunks in group:
                out.append(np.frombuffer(b"".join(ids[at : at + len(chunks)]), np.int32))
                at += len(chunks)
            group, n = [], 0
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decoded(self, flat: np.ndarray, ends: np.ndarray) -> pa.Array:
        """What the ids of texts that end at `ends` (0 first) decode to: entries of the vocabulary are laid one behind the other, whole batch
        at once, and cut where texts end."""
        if self.entries is None:
            top = max(self.bytes_of) + 1
            self.entries = pa.array([self.bytes_of.get(i) for i in range(top)], pa.large_binary())
        got = self.entries.take(pa.array(flat))
        if got.null_count:
            raise KeyError("an id outside the vocabulary")
        _, offsets, data = got.buffers()
        at = np.frombuffer(offsets, np.int64, len(got) + 1) if len(got) else np.zeros(1, np.int64)
        texts = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(at[ends]), data if data is not None else pa.py_buffer(b"")])
        return texts.cast(pa.binary())


def codec(path: str, pattern: str) -> Codec:
    """One codec for each rank file, whose tables are kept while the Python worker lives."""
    if (path, pattern) not in _codecs:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _codecs[path, pattern] = Codec(ranks, pattern)
    return _codecs[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False, rows: int = 256) -> DataFrame:
    """Rows (id_col, ids array<int>), and with decoded=True also the bytes that the ids decode to (column decoded).

    path names a rank file that every executor can read (such as one of an installed package). A null text counts as empty;
    an empty text has no ids. Any length is taken whole. Rows repeat as they do in docs, null ids included; other columns are
    ignored. There is no shuffle.
    """
    ship(docs.sparkSession)
    by_few(docs.sparkSession)

    def work(batches):
        c = codec(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                ids = c.encode_all([t or "" for t in part.column(1).to_pylist()])
                ends = np.cumsum([0, *map(len, ids)])
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                cols = [part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))]
                if decoded:
                    cols.append(c.decoded(flat, ends))
                yield pa.RecordBatch.from_arrays(cols, [id_col, "ids", "decoded"][: len(cols)])
        c.forget()
        settle()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(work, f"{id_col} {kind}, ids array<int>" + ", decoded binary" * decoded)


def decode(rows: DataFrame, path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """rows with a column decoded: the bytes of ids_col. Null ids decode to nothing; an id outside the vocabulary fails."""
    from pyspark.sql.types import BinaryType, StructType

    ship(rows.sparkSession)
    rows = rows.drop("decoded")

    def work(batches):
        c = codec(path, pattern)
        for b in batches:
            got = [c.decode(x or ()) for x in b.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.binary())], [*b.schema.names, "decoded"])

    return rows.mapInArrow(work, StructType([*rows.schema.fields]).add("decoded", BinaryType()))


def ids_text(ids):
    return F.concat_ws(",", ids.cast("array<string>"))


def digests(docs: DataFrame, file: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """Rows (doc_id, n_tokens, ids_sha256, decoded_sha256): every document encoded by an installed rank file and decoded again."""
    import public_tokenizers as P

    got = encode(docs, P.path(file), P.PATTERN, decoded=True)
    return got.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(ids_text(F.col("ids")).cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document, encoded and decoded again."""
    return digests(read(spark, sf_dir, "documents"))


QUERIES = {"op3_byte_bpe": op3_byte_bpe}

"""Many short pieces are merged side by side, as each alone."""

from array import array

import numpy as np

from wardline.llm import bpe


def vocabulary(draw, alphabet: bytes, size: int) -> dict[bytes, int]:
    """All bytes and some texts, with ranks in no order: a token may rank before its own parts."""
    texts = {bytes([b]) for b in range(256)}
    while len(texts) < 256 + size:
        texts.add(bytes(draw.choice(list(alphabet), draw.integers(2, 6)).tolist()))
    return {t: int(r) for t, r in zip(sorted(texts), draw.permutation(len(texts)), strict=True)}


def test_side_by_side():
    draw = np.random.default_rng(5)
    for alphabet, size in ((b"a", 4), (b"ab", 30), (b"abc\xc3", 300), (bytes(range(97, 123)), 6000)):
        ranks = vocabulary(draw, alphabet, size)
        queues = bpe.Queues(ranks, 50)
        pieces = [bytes(draw.choice(list(alphabet), draw.integers(1, bpe.SHORT + 1)).tolist()) for _ in range(260)]
        assert queues.merge(pieces) == [array("i", bpe.merge(p, ranks)).tobytes() for p in pieces]
        assert not any(words.any() for _, words in queues.levels) and queues.merge([]) == []


def test_new_words_are_not_merged_one_by_one(monkeypatch):
    ranks = vocabulary(np.random.default_rng(6), b"abcd", 200)
    words = [f" {a}{b}dcba{a}" for a in ("ab", "cd", "dd", "ca") for b in ("c", "bb", "ad")]
    want = np.concatenate([bpe.merge(w.encode(), ranks) for w in words]).tolist()
    monkeypatch.setattr(bpe, "merge", lambda piece, ranks: 1 / 0)
    assert bpe.Codec(ranks, r" ?\w+|[^\w]+").encode("".join(words)).tolist() == want


def test_long_texts_and_bytes_missing(monkeypatch):
    """More chunks than are looked up at once, among short texts and empty ones; a vocabulary without all bytes."""
    monkeypatch.setattr(bpe, "MANY", 7)
    draw = np.random.default_rng(7)
    for ranks in (vocabulary(draw, b"ab", 30), {b"a": 0, b"b": 1, b" ": 2, b"ab": 3, b" a": 4}):
        texts = [" ".join("".join(draw.choice(["a", "b"], draw.integers(1, 90))) for _ in range(n)) for n in (0, 3, 40, 1, 0, 8, 2)]
        c = bpe.Codec(ranks, r" ?\w+|[^\w]+", 3000)
        want = [[i for p in c.pieces(t) for i in bpe.merge(p.encode(), ranks)] for t in texts]
        assert [x.tolist() for x in c.encode_all(texts)] == want

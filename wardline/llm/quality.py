"""Operator 7: quality from weak labellers, whose accuracies are estimated by expectation-maximisation, and a hashed linear scorer."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm.common import read, ship
from wardline.llm.language_id import blocks

#: Bytes of text that the scorer is fitted on at most, besides the number of documents.
BYTES = 32 << 20
#: (name, feature, bad below, good from, good to, bad above): 1 between the good bounds, -1 outside the bad ones, else no vote.
LABELLERS = (
    ("shouting", "upper", -1.0, 0.0, 0.10, 0.30),
    ("symbols", "symbol", -1.0, 0.0, 0.06, 0.10),
    ("word_length", "word_chars", 2.5, 3.0, 9.0, 14.0),
    ("line_repeats", "line_repeats", -1.0, 0.0, 0.05, 0.30),
    ("word_variety", "variety", 0.12, 0.25, 2.0, 3.0),
    ("short_words", "short_words", 0.12, 0.22, 0.60, 0.80),
    ("sentence_ends", "sentence_ends", 0.01, 0.03, 0.25, 0.45),
    ("digits", "digit", -1.0, 0.0, 0.05, 0.20),
    ("few_words", "words", 8.0, 30.0, np.inf, np.inf),
)
NAMES = tuple(x[0] for x in LABELLERS)


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_UPPER, _DIGIT = _class(bytes(range(65, 91))), _class(bytes(range(48, 58)))
_LETTER = _class(bytes([*range(65, 91), *range(97, 123), *range(128, 256)]))
_SPACE, _SYMBOL = _class(b" \t\n\r\x0b\x0c"), _class(b"!#$%&*+/<=>@\\^_`{|}~[]")
_END = _class(b".?!")


def features(texts: list[bytes | None]) -> dict[str, np.ndarray]:
    """What the labellers look at, of each whole text."""
    data = [t or b"" for t in texts]
    sizes = np.array([len(t) for t in data], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    raw = np.frombuffer(b"".join(data), np.uint8)

    def count(mask: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return (c[starts[1:]] - c[starts[:-1]]).astype(float)

    letters, chars = count(_LETTER[raw]), count(~_SPACE[raw])
    words = [t.split() for t in data]
    n = np.array([len(w) for w in words], float)
    short = np.array([sum(map((3).__ge__, map(len, w))) for w in words], float)
    after = np.append(_SPACE[raw[1:]], True)[: len(raw)]
    after[starts[1:][sizes > 0] - 1] = True  # the end of a text, whatever the next one begins with
    ends = count(_END[raw] & after)
    lines = [[x for x in t.split(b"\n") if x] for t in data]
    safe = lambda a, b: np.divide(a, b, out=np.full(len(a), np.nan), where=b > 0)
    return {
        "upper": safe(count(_UPPER[raw]), letters), "symbol": safe(count(_SYMBOL[raw]), chars), "digit": safe(count(_DIGIT[raw]), chars), "word_chars": safe(chars, n),
        "line_repeats": np.array([1 - len(set(x)) / len(x) if len(x) > 1 else np.nan for x in lines]),
        "variety": safe(np.array([len(set(w)) for w in words], float), np.minimum(n, 40 * np.sqrt(np.maximum(n, 1)))),
        "short_words": safe(short, n), "sentence_ends": safe(ends, n), "words": n,
    }


def votes(texts: list[bytes | None]) -> np.ndarray:
    """Vote of each labeller (columns) on each text: 1 good, -1 bad, 0 none."""
    f = features(texts)
    out = np.zeros((len(texts), len(LABELLERS)), np.int8)
    for j, (_, name, low, good, fine, high) in enumerate(LABELLERS):
        x = f[name]
        out[:, j] = np.where((x >= good) & (x <= fine), 1, np.where((x < low) | (x > high), -1, 0))
    return out


@dataclass
class Labellers:
    """prior: chance that a text is good; like[y, j, v + 1]: chance that labeller j votes v on a text of class y."""

    prior: float
    like: np.ndarray

    @classmethod
    def fit(cls, patterns: np.ndarray, counts: np.ndarray, rounds: int = 100, smooth: float = 1.0):
        """EM over vote patterns and how often they occur; labellers are taken as independent given the class, and start right 7
        times in 10. Classes are good (1) and bad (0)."""
        m = patterns.shape[1]
        like = np.zeros((2, m, 3))
        like[0], like[1] = (0.5, 0.3, 0.2), (0.2, 0.3, 0.5)
        out = cls(0.7, like)
        for _ in range(rounds):
            good = out.posterior(patterns)
            new = np.full((2, m, 3), smooth)
            for y, p in ((0, 1 - good), (1, good)):
                for j in range(m):
                    new[y, j] += np.bincount(patterns[:, j] + 1, counts * p, 3)
            out = cls(float((counts @ good + 7 * smooth) / (counts.sum() + 10 * smooth)), new / new.sum(axis=2, keepdims=True))
        return out

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        at = np.arange(patterns.shape[1])
        logs = np.log(self.like[:, at, patterns + 1]).sum(axis=2)
        d = logs[1] - logs[0] + np.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(d, -30, 30)))


def hashed(texts: list[bytes | None], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all 3-byte grams (case and signs kept), each text between two spaces, and where each text's begin."""
    data = [b" " + (t or b"") + b" " for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(t) for t in data])])
    raw = np.frombuffer(b"".join(data), np.uint8).astype(np.uint32)
    code = raw[:-2] | raw[1:-1] << 8 | raw[2:] << 16
    keep = np.ones(len(code) + 2, bool)
    keep[starts[1:] - 1] = keep[starts[1:] - 2] = False
    keep = keep[: len(code)]
    code = code[keep]
    ends = np.concatenate([[0], np.cumsum(np.diff(starts) - 2)])
    return (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits), ends


@dataclass
class Scorer:
    """Linear in the shares of hashed grams."""

    weights: np.ndarray
    bias: float
    bits: int

    @classmethod
    def fit(cls, texts: list[bytes | None], target: np.ndarray, bits: int = 16, steps: int = 80, rate: float = 2.0, decay: float = 1e-5):
        """Logistic regression on soft targets by Adam; gram shares are scaled by the square root of their rarity."""
        n = len(texts)
        if not n:
            return cls(np.zeros(1 << bits, np.float32), 0.0, bits)
        rows, cols, vals = [], [], []
        for at, part in blocks(texts):
            code, ends = hashed(part, bits)
            doc = np.repeat(np.arange(len(part)), np.diff(ends))
            key, k = np.unique(doc.astype(np.int64) << bits | code, return_counts=True)
            r = key >> bits
            rows.append(r + at)
            cols.append(key & (1 << bits) - 1)
            vals.append(k / np.maximum(np.diff(ends), 1)[r])
        row, col, val = np.concatenate(rows), np.concatenate(cols), np.concatenate(vals)
        df = np.bincount(col, val, 1 << bits) / n
        scale = 1 / np.sqrt(df + 1e-4)
        val = val * scale[col]
        w, b = np.zeros(1 << bits), 0.0
        m, u = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
        for step in range(1, steps + 1):
            z = np.bincount(row, val * w[col], n) + b
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / n
            grad = np.append(np.bincount(col, val * g[row], 1 << bits) + decay * w, g.sum())
            m += 0.1 * (grad - m)
            u += 0.01 * (grad**2 - u)
            move = rate * 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(u / (1 - 0.99**step)) + 1e-8)
            w, b = w - move[:-1], b - move[-1]
        return cls((w * scale).astype(np.float32), float(b), bits)

    def __call__(self, texts: list[bytes | None]) -> np.ndarray:
        code, ends = hashed(texts, self.bits)
        c = np.concatenate([[0.0], np.cumsum(self.weights[code], dtype=np.float64)])
        z = (c[ends[1:]] - c[ends[:-1]]) / np.maximum(np.diff(ends), 1) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def vote_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id_col, a column of each labeller's vote)."""
    ship(docs.sparkSession)

    def work(batches):
        for b in batches:
            texts = b.column(1).cast(pa.binary()).to_pylist()
            got = [votes(part) for _, part in blocks(texts)]
            got = np.concatenate(got) if got else np.zeros((0, len(NAMES)), np.int8)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(got[:, j].astype(np.int32)) for j in range(len(NAMES)))], [id_col, *NAMES])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(work, f"{id_col} {kind}, " + ", ".join(f"{x} int" for x in NAMES))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 4000, seed: int = 7) -> tuple[Labellers, Scorer]:
    """Labeller accuracies from the votes on all documents (a row for each vote pattern reaches the driver: 3^9 at most), and
    the scorer from the posterior labels of at most `sample` documents and BYTES bytes of text: those whose id and text hash lowest,
    rows equal in both counting once. Null ids are ids like others."""
    got = vote_table(docs, id_col, text_col).groupBy(*NAMES).count().toPandas().sort_values(list(NAMES))
    patterns, counts = got[list(NAMES)].to_numpy(np.int64), got["count"].to_numpy(float)
    labellers = Labellers.fit(patterns, counts)
    rows = docs.select(F.xxhash64(F.lit(seed), id_col, text_col).alias("h"), F.col(text_col).alias("text"))
    first = rows.groupBy("h").agg(F.first(F.coalesce(F.octet_length("text"), F.lit(0))).alias("n")).orderBy("h").limit(sample).collect()
    fits = int(np.searchsorted(np.cumsum([r.n for r in first]), BYTES, side="right"))
    texts = []
    if fits:
        got = rows.where(F.col("h") <= first[fits - 1].h).groupBy("h").agg(F.first("text").alias("text"))
        texts = got.orderBy("h").select("text").toArrow().column("text").cast(pa.binary()).to_pylist()
    target = labellers.posterior(votes(texts).astype(np.int64)) if texts else np.zeros(0)
    return labellers, Scorer.fit(texts, target)


def score(docs: DataFrame, labellers: Labellers, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id_col, posterior, score): what the votes on the whole text say, and what the scorer says.

    Null texts count as empty. One row for each row of docs; other columns are ignored. There is no shuffle.
    """
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast((labellers, scorer))  # of fixed size

    def work(batches):
        l, s = sent.value  # noqa: E741
        for b in batches:
            texts = b.column(1).cast(pa.binary()).to_pylist()
            got = [(l.posterior(votes(part).astype(np.int64)), s(part)) for _, part in blocks(texts)]
            cols = [np.concatenate([g[k] for g in got]) if got else np.zeros(0) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c) for c in cols)], [id_col, "posterior", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(work, f"{id_col} {kind}, posterior double, score double")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posterior and score of every document; kept from a score of 0.5. No label of the tables is used."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    got = score(docs, *fit(docs))
    return got.select("doc_id", "posterior", "score", (F.col("score") >= 0.5).alias("kept"))


QUERIES = {"op7_quality": op7_quality}

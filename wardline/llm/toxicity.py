"""Operator 4: toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy."""

from __future__ import annotations

from array import array
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm.common import held_out, read, ship

_WORD = r"[^\W_]+"
#: Letters of words that a task remembers at most, and the bytes that an entry takes besides two for each letter.
LONG, ENTRY = 48, 150


@dataclass(frozen=True)
class Settings:
    """bits: buckets of hashed subwords (a power of two); dim: of embeddings; lengths: of character n-grams; span: words of a
    stretch of text that is averaged; sample: labelled texts to train on at most; common: texts that a word must occur in to count in training; steps, rate, decay: of the training."""

    bits: int = 17
    dim: int = 4
    lengths: tuple[int, ...] = (3, 4, 5)
    span: int = 48
    sample: int = 5_000
    common: int = 1
    steps: int = 40
    rate: float = 0.05
    decay: float = 3e-5
    seed: int = 4


def subwords(word: str, s: Settings) -> np.ndarray:
    """Buckets of a word: of itself and of its character n-grams between boundary marks."""
    from xxhash import xxh3_64_intdigest

    w = f"<{word}>"
    parts = [w, *(w[i : i + n] for n in s.lengths for i in range(len(w) - n + 1))]
    return np.fromiter((xxh3_64_intdigest(p) for p in parts), np.uint64, len(parts)) >> np.uint64(64 - s.bits)


def tokens(text: str | None) -> list[str]:
    import re

    return re.findall(_WORD, (text or "").lower())


class _Sums:
    """Sums over the rows of a sparse 0/1 matrix and, for gradients, of its transpose."""

    def __init__(self, row: np.ndarray, col: np.ndarray, rows: int, cols: int):
        self.parts = []
        for r, c, n in ((row, col, rows), (col, row, cols)):
            order = np.argsort(r, kind="stable")
            got, at = np.unique(r[order], return_index=True)
            self.parts.append((c[order].astype(np.int32), at, got, n))

    def __call__(self, x: np.ndarray, back: bool = False) -> np.ndarray:
        c, at, got, n = self.parts[back]
        out = np.zeros((n, *x.shape[1:]), x.dtype)
        if len(at):
            out[got] = np.add.reduceat(x[c], at, axis=0)
        return out


@dataclass
class Model:
    """weights: of each bucket, embedding and softmax multiplied out; bias; and the settings."""

    weights: np.ndarray
    bias: float
    settings: Settings

    def scores(self, texts: list[str | None], seen: dict[str, float]) -> np.ndarray:
        """For each text the probability of its most toxic stretch; of the bias alone for a text without words."""
        out = np.zeros(len(texts))
        span = self.settings.span
        for i, t in enumerate(texts):
            words = tokens(t)
            v = np.fromiter(map(seen.__getitem__, words), np.float64, len(words))
            out[i] = stretches(v, span).max() if len(v) else 0.0
        return 1 / (1 + np.exp(-np.clip(out + self.bias, -50, 50)))


def stretches(v: np.ndarray, span: int) -> np.ndarray:
    """Averages of v over stretches of span words, half a span apart; a shorter text counts as a whole span."""
    c = np.concatenate([[0.0], np.cumsum(v)])
    if len(v) <= span:
        return np.array([c[-1] / span])
    at = np.unique(np.append(np.arange(0, len(v) - span, max(1, span // 2)), len(v) - span))
    return (c[at + span] - c[at]) / span


class Grams(dict):
    """Subword -> weight of its bucket. Words share most of theirs, so few need hashing."""

    def __init__(self, model: Model, size: int = 300_000):
        from xxhash import xxh3_64_intdigest

        super().__init__()
        self.weights, self.shift, self.size, self.digest = model.weights, 64 - model.settings.bits, size, xxh3_64_intdigest

    def __missing__(self, gram: str) -> float:
        if len(self) > self.size:
            self.clear()
        self[gram] = got = self.of(gram)
        return got

    def of(self, gram: str) -> float:
        return float(self.weights[self.digest(gram) >> self.shift])


class Seen(dict):
    """Word -> its share of the score, the average over its subwords, kept while a task lasts in about `room` bytes; words longer than LONG
    are worked out anew each time."""

    def __init__(self, model: Model, room: int = 60_000_000):
        super().__init__()
        self.lengths, self.room, self.left, self.grams = model.settings.lengths, room, room, Grams(model)

    def __missing__(self, word: str) -> float:
        w, grams = f"<{word}>", self.grams
        n_found, total = 1, grams.of(w)
        for n in self.lengths:
            for i in range(len(w) - n + 1):
                total += grams[w[i : i + n]]
            n_found += max(0, len(w) - n + 1)
        got = total / n_found
        if len(word) <= LONG:
            if self.left < 0:
                self.clear()
                self.left = self.room
            self[word] = got
            self.left -= ENTRY + 2 * len(word)
        return got


def train(texts: list[str | None], labels: np.ndarray, s: Settings = Settings()) -> Model:
    """Fit embeddings and softmax together by Adam on the log loss of the texts' most toxic stretches.

    A word is the average of its subwords' embeddings, a stretch the average of its words. The first steps use the average of
    all of a text's stretches; the later ones the stretch that scores highest at the time.
    """
    if not len(labels) or labels.min() == labels.max():
        return Model(np.zeros(1 << s.bits), -20.0 if not len(labels) or labels.max() == 0 else 20.0, s)
    number: dict[str, int] = {}
    split = [tokens(t) for t in texts]
    found = Counter(w for d in split for w in set(d))
    # a word of too few texts keeps its place with no subwords
    docs = [np.array([number.setdefault(w, len(number)) if found[w] >= s.common else -1 for w in d], np.int32) for d in split]
    if not number:
        return Model(np.zeros(1 << s.bits), float(np.log(labels.mean() / (1 - labels.mean()))), s)
    flat_subs, lens = array("i"), array("i")
    for w in number:
        got = subwords(w, s)
        flat_subs.extend(got.tolist())
        lens.append(len(got))
    n_words = len(number)
    del number, split, found
    lens = np.frombuffer(lens, np.int32)
    per_word = lens.astype(np.float32)[:, None]
    words = _Sums(np.repeat(np.arange(n_words, dtype=np.int32), lens), np.frombuffer(flat_subs, np.int32), n_words, 1 << s.bits)
    sizes = np.array([len(d) for d in docs])
    flat = np.concatenate(docs)
    all_rows = np.repeat(np.arange(len(docs), dtype=np.int32), sizes)
    whole = _Sums(all_rows[flat >= 0], flat[flat >= 0], len(docs), n_words)
    norm_all = np.maximum(sizes, s.span).astype(np.float32)[:, None]
    draw = np.random.default_rng(s.seed)
    E = draw.normal(0, 0.1, (1 << s.bits, s.dim)).astype(np.float32)
    w, b = draw.normal(0, 1, s.dim).astype(np.float32), np.float32(np.log(labels.mean() / (1 - labels.mean())))
    y = labels.astype(np.float32)
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32) ** 0.5
    weight /= weight.sum()
    state = {k: [np.zeros_like(x), np.zeros_like(x)] for k, x in (("E", E), ("w", w), ("b", np.zeros(1, np.float32)))}
    sums, norm, gain = whole, norm_all, np.float32(s.span)
    for step in range(1, s.steps + 1):
        V = words(E) / per_word
        if step > s.steps // 3 and step % 4 == 0 or step == s.steps // 3 + 1:
            v = np.append(V @ w, 0.0).astype(np.float64)  # place -1
            rows, cols, at = [], [], 0
            for i, d in enumerate(docs):
                if len(d):
                    k = int(np.argmax(stretches(v[d], s.span))) * max(1, s.span // 2) if len(d) > s.span else 0
                    k = min(k, max(0, len(d) - s.span))
                    part = d[k : k + s.span]
                    part = part[part >= 0]
                    rows.append(np.full(len(part), i, np.int32))
                    cols.append(part)
            sums, norm = _Sums(np.concatenate(rows), np.concatenate(cols), len(docs), n_words), np.full((len(docs), 1), s.span, np.float32)
        D = sums(V) / norm * gain
        p = 1 / (1 + np.exp(-np.clip(D @ w + b, -30, 30)))
        g = weight * (p - y)
        gV = sums(g[:, None] * w[None, :] / norm * gain, back=True) / per_word
        grads = {"E": words(gV, back=True) + s.decay * E, "w": D.T @ g + s.decay * w, "b": np.array([g.sum()], np.float32)}
        new = {}
        for k, x in (("E", E), ("w", w), ("b", np.array([b]))):
            m, u = state[k]
            m += 0.1 * (grads[k] - m)
            u += 0.01 * (grads[k] ** 2 - u)
            new[k] = (x - s.rate * (m / (1 - 0.9**step)) / (np.sqrt(u / (1 - 0.99**step)) + 1e-9)).astype(np.float32)
        E, w, b = new["E"], new["w"], new["b"][0]
    return Model((E @ w * gain).astype(np.float32), float(b), s)


def sample(labelled: DataFrame, s: Settings) -> tuple[list[str | None], np.ndarray]:
    """At most s.sample rows of labelled (id, text, label 0 or 1), those whose ids hash lowest: texts and labels for training."""
    rows = labelled.where("label in (0, 1)").orderBy(F.xxhash64(F.lit(s.seed), "id"), "id").limit(s.sample).select("text", "label").toArrow()
    return rows.column("text").to_pylist(), rows.column("label").to_numpy().astype(np.int64)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id_col, score), one for each row of docs; only the text counts, the whole of it.

    Null and empty texts have the score of no words at all. Other columns are ignored. There is no shuffle.
    """
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)  # 2^bits floats

    def work(batches):
        seen = Seen(sent.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sent.value.scores(b.column(1).to_pylist(), seen))], [id_col, "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(work, f"{id_col} {kind}, score double")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from a bounded sample of the labelled rows that are not held out."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label")).where(~held_out(F.col("doc_id")) & F.col("label").isin(0, 1))
    settings = Settings()
    chosen = labels.orderBy(F.xxhash64(F.lit(settings.seed), "doc_id"), "doc_id").limit(settings.sample)
    texts = docs.join(F.broadcast(chosen), "doc_id").withColumnRenamed("doc_id", "id")  # at most settings.sample rows
    model = train(*sample(texts, settings), settings)
    got = score(docs, model)
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


QUERIES = {"op4_toxicity": op4_toxicity}

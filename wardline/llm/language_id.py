"""Operator 2: language identification by bit-sliced Bloom filters of n-grams."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.llm.common import by_few, held_out, read, settle, ship

#: Bytes as they count in n-grams: A-Z as a-z, other ASCII as a space, the rest unchanged.
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)
HASHES = (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)
#: Bytes of text handled at once in a task.
BLOCK = 2_000_000
#: Languages in one array of slots.
SLICE = 64


def blocks(texts: list[bytes | None]):
    """(first row, texts) of about BLOCK bytes each."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or b"")
        if size >= BLOCK:
            yield at, texts[at : i + 1]
            at, size = i + 1, 0
    if at < len(texts):
        yield at, texts[at:]


def grams(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all 4-byte grams of the texts, each padded with two spaces at either end, and where each text's begin."""
    sizes = np.array([len(t or b"") for t in texts], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 4)])
    data = _FOLD[np.frombuffer(b"".join(b"  " + (t or b"") + b"  " for t in texts), np.uint8)]
    wide = data.astype(np.uint32)
    codes = wide[:-3] | wide[1:-2] << 8 | wide[2:-1] << 16 | wide[3:] << 24
    # a text's last three windows reach into the next one; drop them
    keep = np.ones(len(codes) + 3, bool)
    for k in (1, 2, 3):
        keep[starts[1:] - k] = False
    return codes[keep[: len(codes)]], np.concatenate([[0], np.cumsum(sizes + 1)])


@dataclass
class Filters:
    """One Bloom filter for each language over the same slots; a slot's bit l is language l's. `more` has the slots of the 65th
    language and on, 64 in each array."""

    langs: list[str]
    slots: np.ndarray
    wrong: np.ndarray
    more: tuple[np.ndarray, ...] = ()

    @classmethod
    def build(cls, langs: list[str], found, bits: int):
        """found: (language's number, gram's code), as tuples or rows of an array; at most SLICE languages."""
        found = np.asarray(found, np.int64).reshape(-1, 2)
        kind = next(t for n, t in ((8, np.uint8), (16, np.uint16), (32, np.uint32), (64, np.uint64)) if len(langs) <= n)
        slots = np.zeros(1 << bits, kind)
        codes, which = found[:, 1].astype(np.uint32), found[:, 0]
        for n in range(len(langs)):
            for h in HASHES:
                slots[cls._slot(codes[which == n], h, bits)] |= kind(1 << n)
        full = np.array([np.mean(slots >> kind(n) & kind(1)) for n in range(len(langs))])
        return cls(langs, slots, full ** len(HASHES))

    @classmethod
    def joined(cls, parts: list):
        """One of parts; all but the last have SLICE languages."""
        return cls([x for p in parts for x in p.langs], parts[0].slots, np.concatenate([p.wrong for p in parts]), tuple(p.slots for p in parts[1:]))

    @staticmethod
    def _slot(codes: np.ndarray, h: int, bits: int) -> np.ndarray:
        mixed = codes ^ (codes >> np.uint32(15))
        mixed = mixed * np.uint32(h)
        mixed ^= mixed >> np.uint32(13)
        return (mixed * np.uint32(0x27D4EB2F)) >> np.uint32(32 - bits)

    def share(self, texts: list[bytes | None]) -> np.ndarray:
        """For each text and language, the share of the text's grams in its filter, false positives taken out."""
        codes, starts = grams(texts)
        bits = len(self.slots).bit_length() - 1
        places = [self._slot(codes, h, bits) for h in HASHES]
        n = np.diff(starts)
        out = np.zeros((len(texts), len(self.langs)))
        for at, slots in enumerate((self.slots, *self.more)):
            mask = slots[places[0]]
            for p in places[1:]:
                mask &= slots[p]
            one = mask.dtype.type(1)
            for i in range(at * SLICE, min(at * SLICE + SLICE, len(self.langs))):
                hits = np.add.reduceat((mask >> mask.dtype.type(i % SLICE) & one).astype(np.uint8), starts[:-1], dtype=np.int64)
                out[:, i] = np.clip((hits / n - self.wrong[i]) / (1 - self.wrong[i]), 0, 1)
        return out


def gram_counts(labelled: DataFrame) -> DataFrame:
    """Rows (lang, gram, n) over labelled rows (lang, text); a task emits each gram once a language."""
    ship(labelled.sparkSession)
    by_few(labelled.sparkSession)

    def work(batches):
        found: dict[str, list] = {}

        def pooled(parts):
            codes, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return [(codes, np.bincount(where, np.concatenate([p[1] for p in parts])).astype(np.int64))]

        for batch in batches:
            by: dict[str, list] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                for _, part in blocks(texts):
                    found.setdefault(lang, []).append(np.unique(grams(part)[0], return_counts=True))
                if len(found[lang]) > 16:
                    found[lang] = pooled(found[lang])
        for lang, parts in found.items():
            codes, n = pooled(parts)[0]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes)), pa.array(codes.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])
        found.clear()
        settle()

    each = labelled.select("lang", "text").mapInArrow(work, "lang string, gram bigint, n bigint")
    return each.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit(labelled: DataFrame, share: float = 8e-6, near: float = 0.05, bits: int = 20) -> Filters:
    """Filters of the languages in labelled rows (lang, text); null languages and texts teach nothing. All rows are counted.

    A language's filter takes the grams that make up at least `share` of its grams (so at most 1 / share of them reach the
    driver for each language), unless some other language uses the gram more than 1 / near times as often.
    Grams come to the driver for SLICE languages at a time. With no labelled rows there are no languages.
    """
    labelled = labelled.where("lang is not null and text is not null")
    counts = gram_counts(labelled).persist()
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    langs = [r.lang for r in totals.orderBy(F.desc("total"), "lang").collect()]
    kept = counts.join(F.broadcast(totals), "lang").withColumn("rate", F.col("n") / F.col("total")).where(F.col("rate") >= share)
    best = kept.groupBy("gram").agg(F.max("rate").alias("best"))
    rows = kept.join(best, "gram").where(F.col("rate") >= near * F.col("best")).select("lang", "gram")
    if len(langs) > SLICE:
        rows = rows.persist()
    parts = []
    for at in range(0, len(langs), SLICE):
        part = langs[at : at + SLICE]
        got = (rows.where(F.col("lang").isin(part)) if len(langs) > SLICE else rows).toArrow()
        which = pa.compute.index_in(got["lang"], pa.array(part)).to_numpy()
        parts.append(Filters.build(part, np.stack([which.astype(np.int64), got["gram"].to_numpy()], axis=1), bits))
    rows.unpersist()
    counts.unpersist()
    return Filters.joined(parts) if parts else Filters([], np.zeros(1, np.uint8), np.zeros(0))


def predict(docs: DataFrame, filters: Filters, text_col: str = "text", rejected: str | None = None) -> DataFrame:
    """docs with lang_pred and score: the language with the largest corrected share of the text's grams, and that share.

    `und` with score 0 for a null text, one without a letter, or if no language was learned. Ties go to the language with more
    training text. The whole text counts; rows stay as they are. Columns of docs named lang_pred or score are replaced. There is
    no shuffle. A name in `rejected` adds a boolean column: true for a null text and one without a letter, whatever was learned.
    """
    spark = docs.sparkSession
    ship(spark)
    by_few(spark)
    model = spark.sparkContext.broadcast(filters)  # 2^bits slots of 1 to 8 bytes for each SLICE languages
    docs = docs.drop("lang_pred", "score")

    def work(batches):
        import regex

        letter, f = regex.compile(r"\p{L}").search, model.value
        for batch in batches:
            texts = batch.column(text_col).to_pylist()
            lang, score = ["und"] * len(texts), np.zeros(len(texts))
            good = [bool(t and letter(t)) for t in texts]
            for at, part in blocks([None if t is None else t.encode() for t in texts]) if f.langs else ():
                share = f.share(part)
                best = np.argmax(share, axis=1)
                for i, b in enumerate(best):
                    if good[at + i]:
                        lang[at + i], score[at + i] = f.langs[b], share[i, b]
            more = [pa.array([not x for x in good], pa.bool_())] if rejected else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), *more], [*batch.schema.names, "lang_pred", "score", *([rejected] if rejected else [])])
        settle()

    schema = T.StructType([*docs.schema.fields]).add("lang_pred", "string").add("score", "double")
    return docs.mapInArrow(work, schema.add(rejected, "boolean") if rejected else schema)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the rows that are not held out."""
    docs = read(spark, sf_dir, "documents")
    filters = fit(docs.where(~held_out(F.col("doc_id"))).select("lang", "text"))
    return predict(docs.select("doc_id", "text"), filters).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


QUERIES = {"op2_language_id": op2_language_id}

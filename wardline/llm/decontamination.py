"""Operator 1: benchmark decontamination by a prefix-filtered containment join, in DataFrame operations only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm.common import cut, named, read

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a window, and words of the shingles that are ordered by rarity.
WINDOW, SHINGLE = 10, 3
#: Bytes of windows that are broadcast at once; more take several passes over the documents.
BLOCK = 64 << 20


def words(text: Column) -> Column:
    """Words of a text with A-Z lower-cased; none for null."""
    text = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(low, BETWEEN), "")


def shingle(ws: Column, at: Column, width: int) -> Column:
    return F.xxhash64(*[F.get(ws, at + i) for i in range(width)])


def item_windows(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (item, win, words, size, width): the windows of each item, with an id or without; win names the window's words."""
    w = items.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("ws")).where(F.size("ws") > 0)
    w = w.withColumn("size", F.least(F.size("ws"), F.lit(WINDOW)))
    w = w.select("item", "ws", "size", F.explode(F.sequence(F.lit(1), F.size("ws") - F.col("size") + 1)).alias("s"))
    w = w.select("item", F.slice("ws", F.col("s"), F.col("size")).alias("words"), "size")
    return w.withColumns({"win": F.md5(F.array_join("words", " ").cast("binary")), "width": F.least("size", F.lit(SHINGLE))}).distinct()


def tokens(docs: DataFrame, width: int) -> DataFrame:
    """docs (d1, d2, doc, ws, n) with a row for each word: pos and key, the shingle that begins there (null at the end)."""
    out = docs.select("d1", "d2", "doc", "ws", "n", F.posexplode_outer("ws").alias("pos", "_w"))
    full = F.col("pos") + width <= F.col("n")
    return out.withColumn("key", F.when(full, F.xxhash64("_w", *[F.get("ws", F.col("pos") + i) for i in range(1, width)]))).drop("_w")


def hits(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Rows (doc, n_words, spans array<struct<start, end>>, items array<string>, d1, d2), one for each row of docs; d1 and d2 name its id and text.

    spans: the occurrences in the document, in order, of windows of 10 consecutive words of an item (of fewer words: the whole
    item); items: the ids of the items they belong to, as strings in order, without those of items that have none
    (whose windows count like any other). Null texts have no words; items without words have no windows; rows of docs that repeat give equal rows. Other columns are ignored.

    Containment of a whole window needs any one of its shingles, so the prefix is its rarest shingle over all documents, the
    only one joined. A candidate must fit the document's length at that position, and is then compared word by word.
    The windows are broadcast in blocks of at most BLOCK bytes; only matches are shuffled, never texts.
    """
    d = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("t"))
    d = d.select("doc", *named(F.col("doc"), F.col("t")), words(F.col("t")).alias("ws")).withColumn("n", F.size("ws"))
    wins = cut(item_windows(items, item_col, item_text))
    sizes = wins.groupBy("width").agg(F.sum(F.octet_length(F.array_join("words", " ")) + 200).alias("b")).collect()  # a row for each width, three at most

    parts = [d.select("d1", "d2", "doc", "n", F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"), F.lit(None).cast("string").alias("win"))]
    for first, (width, size) in enumerate(sorted(sizes, reverse=True)):
        blocks = -(-size // BLOCK)
        own = wins.where(F.col("width") == width).select("win", "words", "size").distinct()
        own = own.select("win", "words", "size", F.posexplode(F.sequence(F.lit(0), F.col("size") - width)).alias("off", "_o")).drop("_o")
        own = cut(own.withColumn("key", shingle(F.col("words"), F.col("off"), width)))
        counts = []
        for b in range(blocks):
            some = own.select("key").distinct().where(F.pmod("key", F.lit(blocks)) == b)
            counts.append(tokens(d, width).select("key").join(F.broadcast(some), "key").groupBy("key").count())
        rare = own.join(reduce(DataFrame.union, counts), "key", "left").fillna(0, ["count"])
        anchors = rare.groupBy("win", "words", "size").agg(F.min_by(F.struct("key", "off"), F.struct("count", "key", "off")).alias("a"))
        anchors = cut(anchors.groupBy(F.col("a.key").alias("key")).agg(F.collect_list(F.struct(F.col("a.off").alias("off"), "size", "words", "win")).alias("cands")))
        for b in range(blocks):
            some = anchors.where(F.pmod("key", F.lit(blocks)) == b)
            base = not first and not b
            got = tokens(d, width).join(F.broadcast(some), "key", "left" if base else "inner")
            got = got.where("cands is not null or coalesce(pos, 0) = 0" if base else "cands is not null")
            start = F.col("pos") - F.col("c.off")
            got = got.select("d1", "d2", "doc", "n", "ws", "pos", F.posexplode_outer("cands").alias("i", "c")).withColumn("start", start)
            # slice fails on a start below 1, which the positional bound excludes
            same = (F.col("start") >= 0) & (F.col("start") + F.col("c.size") <= F.col("n")) & (F.slice("ws", F.greatest("start", F.lit(0)) + 1, F.col("c.size")) == F.col("c.words"))
            same = F.coalesce(same, F.lit(False))
            got = got.where(same | (F.lit(base) & (F.coalesce("pos", F.lit(0)) == 0) & (F.coalesce("i", F.lit(0)) == 0)))
            counted = F.when(F.lit(base) & (F.coalesce("pos", F.lit(0)) == 0) & (F.coalesce("i", F.lit(0)) == 0), F.col("n"))
            got = got.select("d1", "d2", "doc", counted.alias("n"), F.when(same, F.col("start")).alias("start"), F.when(same, F.col("start") + F.col("c.size")).alias("end"), F.when(same, F.col("c.win")).alias("win"))
            parts = [got] if base else [*parts, got]
    found = reduce(DataFrame.union, parts)
    spans = found.groupBy("d1", "d2").agg(
        F.first("doc", True).alias("doc"), F.max("n").alias("n_words"), F.count("n").alias("rows"),
        F.array_sort(F.collect_set(F.when(F.col("win").isNotNull(), F.struct("start", "end")))).alias("spans"), F.collect_set("win").alias("wins"),
    )
    of = spans.select("d1", "d2", F.explode("wins").alias("win")).join(wins.where("item is not null").select("win", "item").distinct(), "win")
    of = of.groupBy("d1", "d2").agg(F.array_sort(F.collect_set("item")).alias("items"))
    out = spans.drop("wins").join(of, ["d1", "d2"], "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    return out.select("doc", F.col("n_words").cast("long").alias("n_words"), "spans", "items", "d1", "d2", F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("_r")).drop("_r")


def covered(spans: Column) -> Column:
    """Number of positions within sorted spans."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to"))
    step = lambda a, s: F.struct((a["n"] + F.greatest(s["end"] - F.greatest(s["start"], a["to"]), F.lit(0))).cast("long").alias("n"), F.greatest(a["to"], s["end"]).alias("to"))
    return F.aggregate(spans, zero, step, lambda a: a["n"])


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **names) -> DataFrame:
    """docs without the rows whose text holds a window of an item; rows without an id are judged like any other."""
    bad = hits(docs, items, id_col, text_col, **names).where(F.size("spans") > 0).select(F.col("d1").alias("_d1"), F.col("d2").alias("_d2")).distinct()
    d1, d2 = named(docs[id_col], docs[text_col])
    return docs.join(bad, (d1 == bad["_d1"]) & (d2 == bad["_d2"]), "left_anti")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside benchmark windows, and the items these are of."""
    found = hits(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    n = covered(F.col("spans"))
    return found.select(
        F.col("doc").alias("doc_id"), "n_words", n.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


QUERIES = {"op1_decontaminate": op1_decontaminate}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = {
    "op1_decontaminate": rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
i AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
iw AS (SELECT DISTINCT item_id, size, array_to_string(ws[s : s + size - 1], ' ') AS win FROM (
  SELECT item_id, ws, least(len(ws), 10) AS size, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS s FROM i WHERE len(ws) > 0)),
dw AS (SELECT doc_id, s, size, array_to_string(ws[s : s + size - 1], ' ') AS win FROM (
  SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS s FROM d, (SELECT DISTINCT size FROM iw) WHERE len(ws) >= size)),
m AS (SELECT doc_id, s, dw.size, item_id FROM dw JOIN iw USING (win)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + size)) AS p FROM m) GROUP BY 1),
x AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m WHERE item_id IS NOT NULL) GROUP BY 1)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN x USING (doc_id)"""
}

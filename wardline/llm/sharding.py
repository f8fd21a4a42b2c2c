"""Operator 10: a uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardline.llm.common import bounded, cut, read

#: Hashes of rows with copies that are sent to all tasks at most; more are joined by exchange.
SENT = 200_000


def hypergeometric(good: int, bad: int, n: int, draw: np.random.Generator) -> int:
    """How many of n draws without replacement from good + bad are good, for numbers of any size (numpy's own sampler ends at 10^9).

    By inversion: the chances are worked out from the mode both ways by the exact ratio of neighbours, as far as twelve standard
    deviations (beyond lies less than 1e-30), so the work is about the square root of n.
    """
    total = good + bad
    low, high = max(0, n - bad), min(n, good)
    if low == high:
        return low
    mode = min(high, max(low, (n + 1) * (good + 1) // (total + 2)))
    sd = (n * (good / total) * (bad / total) * ((total - n) / max(1, total - 1))) ** 0.5
    reach = int(12 * sd) + 40
    up = np.arange(mode, min(high, mode + reach), dtype=np.float64)
    down = np.arange(mode, max(low, mode - reach), -1, dtype=np.float64)
    rest = float(bad - n)
    above = np.cumprod((good - up) * (n - up) / ((up + 1) * (rest + up + 1)))
    below = np.cumprod(down * (rest + down) / ((good - down + 1) * (n - down + 1)))
    chances = np.concatenate([below[::-1], [1.0], above])
    sums = np.cumsum(chances)
    return mode - len(down) + int(min(np.searchsorted(sums, draw.random() * sums[-1], side="right"), len(sums) - 1))


def communication_matrix(counts: list[int], shards: int, seed: int) -> np.ndarray:
    """How many rows each partition sends to each shard: rows sum to counts, columns differ by one at most.

    Drawn partition by partition from the multivariate hypergeometric law of what the shards still want, which is the law of
    these counts under a uniformly random permutation of all rows. Counts may have any size.
    """
    total = sum(counts)
    want = [total // shards + (s < total % shards) for s in range(shards)]
    draw = np.random.default_rng(seed)
    out = np.zeros((len(counts), shards), dtype=np.int64)
    for p, n in enumerate(counts):
        rest = sum(want)
        for s in range(shards):
            if not n:
                break
            rest -= want[s]
            out[p, s] = got = hypergeometric(want[s], rest, n, draw)
            want[s] -= got
            n -= got
    return out


def whole(df: DataFrame) -> Column:
    """A hash of all columns of a row."""
    return F.xxhash64(*[F.col(f"`{f.name}`").cast("string") if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in df.schema])


def numbered(docs: DataFrame, key: Column) -> DataFrame:
    """docs with _sh_key, a hash of key and, of rows that are equal in all columns, of each copy's number. Copies are counted by their
    hashes; only they are brought together, as one row each, and told apart again by counting up to their number."""
    a, b = whole(docs), F.xxhash64(F.lit(1), whole(docs), key)
    rows = docs.withColumns({"_sh_a": a, "_sh_b": b, "_sh_key": key})
    many = cut(rows.groupBy("_sh_a", "_sh_b").agg(F.count("*").alias("n")).where("n > 1").drop("n"))
    if many.isEmpty():
        return rows.drop("_sh_a", "_sh_b")
    many = bounded(many, SENT)
    row = F.struct(*[F.col(f"`{c}`") for c in (*docs.columns, "_sh_key")])
    copies = rows.join(many, ["_sh_a", "_sh_b"], "left_semi").groupBy("_sh_a", "_sh_b").agg(F.first(row).alias("_sh_row"), F.count("*").alias("_sh_n"))
    copies = copies.select("_sh_row.*", F.explode(F.sequence(F.lit(1).cast("long"), "_sh_n")).alias("_sh_copy"))
    copies = copies.withColumn("_sh_key", F.xxhash64("_sh_key", "_sh_copy")).drop("_sh_copy")
    return rows.join(many, ["_sh_a", "_sh_b"], "left_anti").drop("_sh_a", "_sh_b").unionByName(copies)


def shard(docs: DataFrame, shards: int, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", rows_per_task: int = 250_000) -> DataFrame:
    """docs with two more columns: shard (0 to shards - 1) and slot (gapless from 0 within the shard), a uniform random order.

    Law: `rows`; shard counts differ by one at most, whatever the sizes of the rows. Rows are dealt into virtual partitions by
    a seeded hash of id and text (so a lost task repeats its work exactly); the matrix says how many rows each partition sends
    to each shard, a local order by a second hash says which, and after the exchange a third hash orders each shard. Of rows
    that are equal in all columns, each copy has a number of its own that is hashed, too, so that copies are dealt like other rows.
    A shard is ordered in cells of about rows_per_task rows, so no task holds a whole shard. Only a count for each partition
    (rows / rows_per_task, at least 64) reaches the driver. Null ids and texts are ordinary values. An empty table gives an
    empty result. Other columns are carried, and take part in the hash; their names must not be `shard`, `slot` or start with
    `_sh_` (such columns are dropped).
    """
    spark = docs.sparkSession
    docs = docs.drop("shard", "slot", *[c for c in docs.columns if c.startswith("_sh_")])
    key = F.xxhash64(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("\x00")), F.coalesce(F.col(text_col), F.lit("\x00null")), whole(docs))
    rows = docs.count()
    parts = max(64, -(-rows // rows_per_task))
    cells = max(8, -(-rows // (shards * rows_per_task)))
    base = numbered(docs, key).withColumn("_sh_p", F.pmod("_sh_key", F.lit(parts)).cast("int"))
    got = dict(base.groupBy("_sh_p").count().collect())
    matrix = communication_matrix([got.get(p, 0) for p in range(parts)], shards, seed)
    ends = spark.createDataFrame([(p, [int(x) for x in np.cumsum(matrix[p])]) for p in range(parts)], "_sh_p int, _sh_ends array<bigint>")
    local = Window.partitionBy("_sh_p").orderBy(F.xxhash64(F.lit(seed + 1), "_sh_key"), "_sh_key")
    sent = (
        base.withColumn("_sh_rank", F.row_number().over(local))
        .join(F.broadcast(ends), "_sh_p")  # one short row for each virtual partition
        .withColumn("shard", F.size(F.filter("_sh_ends", lambda e: e < F.col("_sh_rank"))).cast("int"))
        .withColumn("_sh_order", F.xxhash64(F.lit(seed + 2), "_sh_key"))
        .withColumn("_sh_cell", F.floor((F.shiftrightunsigned("_sh_order", 33) * cells) / F.lit(1 << 31)).cast("int"))
        .drop("_sh_ends", "_sh_rank", "_sh_p")
    )
    # the cell follows the top bits of the unsigned order, so that cells in turn are the shard in order
    sizes = sent.groupBy("shard", "_sh_cell").agg(F.count("*").alias("_sh_n"))
    starts = sizes.withColumn("_sh_start", F.sum("_sh_n").over(Window.partitionBy("shard").orderBy("_sh_cell")) - F.col("_sh_n")).drop("_sh_n")
    inner = Window.partitionBy("shard", "_sh_cell").orderBy(F.shiftrightunsigned("_sh_order", 1), F.col("_sh_order"), "_sh_key")
    return (
        sent.withColumn("_sh_slot", F.row_number().over(inner) - 1)
        .join(starts, ["shard", "_sh_cell"])
        .withColumn("slot", (F.col("_sh_start") + F.col("_sh_slot")).cast("long"))
        .drop("_sh_key", "_sh_order", "_sh_cell", "_sh_start", "_sh_slot")
    )


def op10_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7 under the law `rows`."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    digests = docs.withColumns({"size": (F.octet_length(text) + 1).cast("long"), "text_crc32": F.crc32(text.cast("binary"))})
    out = shard(digests, 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op10_shard_documents": op10_shard_documents}

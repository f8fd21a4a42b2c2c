"""Operator 8: near-duplicate embeddings by cross-polytope hashing after fast Hadamard rotations."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm.common import block_pairs, components, cut, join_sized, read, ship, with_least
from wardline.llm.forest import stars

#: Members of a block of a bucket.
NEAR = 1500
#: Rows of a task's table of buckets, about; and the comparisons that a row in a bucket costs as much as.
ROWS, PLACE = 20_000, 400
#: Wanted chance that a pair exactly at the threshold meets in a bucket.
RECALL = 0.995


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row (length a power of two), normalised."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / math.sqrt(d)


class Hasher:
    """tables hash tables, each of depth cross-polytope hashes; a vector goes to the probes best buckets of each table."""

    def __init__(self, dim: int, tables: int, depth: int, probes: int, seed: int = 8):
        self.dim, self.tables, self.depth, self.probes = max(2, 1 << (dim - 1).bit_length()), tables, depth, probes
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], (tables, depth, 3, self.dim))

    def keys(self, x: np.ndarray) -> np.ndarray:
        """Bucket numbers of unit vectors: (rows, tables, probes).

        A hash is the signed axis nearest to the rotated vector (three sign flips and Hadamard transforms). The first probe
        takes the nearest axis in each of the depth hashes; each further one takes the second nearest in one hash, the hashes
        in order of how little that loses.
        """
        n = len(x)
        y = np.zeros((n, self.dim))
        y[:, : x.shape[1]] = x
        out = np.zeros((n, self.tables, self.probes), np.int64)
        rows = np.arange(n)
        for t in range(self.tables):
            best, second, loss = [], [], []
            for d in range(self.depth):
                z = y
                for s in self.signs[t, d]:
                    z = hadamard(z * s)
                a = np.abs(z)
                i = np.argmax(a, axis=1)
                top = a[rows, i]
                a[rows, i] = -1
                j = np.argmax(a, axis=1)
                best.append(2 * i + (z[rows, i] < 0))
                second.append(2 * j + (z[rows, j] < 0))
                loss.append(top - a[rows, j])
            order = np.argsort(np.stack(loss, 1), axis=1)
            for p in range(self.probes):
                key = np.full(n, t, np.int64)
                for d in range(self.depth):
                    swap = (p > 0) & (order[:, max(0, p - 1)] == d)
                    key = key * (2 * self.dim) + np.where(swap, second[d], best[d])
                out[:, t, p] = key
        return out


def plan(dim: int, rows: float, threshold: float, seed: int = 80) -> Hasher:
    """The hasher of least estimated work whose tables give RECALL at the threshold: rows is how many vectors of its label one meets
    on average. There are as many tables as that takes.

    The chance to meet in a table is measured on simulated pairs exactly at the threshold. Work is what a vector's rows in buckets
    and their comparisons cost.
    """
    size = 2 * max(2, 1 << (dim - 1).bit_length())
    draw = np.random.default_rng(seed)
    x, y = draw.normal(size=(2, 500, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= x * np.sum(x * y, axis=1, keepdims=True)
    y = threshold * x + math.sqrt(max(0.0, 1 - threshold**2)) * y / np.linalg.norm(y, axis=1, keepdims=True)
    best = None
    for depth in range(1, 5):
        most = min(4, depth + 1)
        trial = Hasher(dim, 4, depth, most)
        a, b = trial.keys(x), trial.keys(y)
        for probes in range(1, most + 1):
            met = np.mean((a[:, :, :probes, None] == b[:, :, None, :probes]).any(axis=(2, 3)))
            if met > 0:
                tables = max(2, math.ceil(math.log(1 - RECALL) / math.log(1 - min(met, 0.999))))
                work = tables * probes * (PLACE + probes * rows / size**depth)
                best = min(best or (work, tables, depth, probes), (work, tables, depth, probes))
        if size**depth > rows:
            break
    if best is None:
        raise ValueError(f"no simulated pair at {threshold} shares a bucket: vectors of {dim} dimensions at this threshold need another method")
    _, tables, depth, probes = best
    return Hasher(dim, tables, depth, probes)


def short(keys: np.ndarray) -> np.ndarray:
    """32 bits of bucket numbers."""
    x = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x >> np.uint64(32)).astype(np.uint32)


def _unit(col: pa.ChunkedArray) -> np.ndarray:
    flat = col.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(col), -1)
    # scaled first, so that squares of tiny or huge components neither vanish nor overflow
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def link(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Rows (id_col, n_links, component_id, kept), one for each row of vectors.

    Vectors of one (not null) label link at a cosine of threshold or more, in double precision. Null or zero vectors, ones with
    a null or non-finite component and ones without a label link with nothing. n_links: other vectors linked directly;
    component_id: the smallest id reachable; kept: id = component_id. Null ids link with nothing. Other columns are ignored.
    Vectors of different lengths never link. Each row is a vector of its own: rows that repeat an id with other vectors or labels
    are not linked by it, and rows equal in all link with each other.

    Equal vectors of a label form a class, linked throughout, with a number of its own. Representatives meet in the
    buckets of their label; buckets are compared in pairs of blocks. A vector is hashed once and carries 32 bits of each of its
    buckets, so that a pair is counted in the first bucket that it shares only; a task returns sums and trees, never its pairs.
    """
    ship(vectors.sparkSession)
    v = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"), F.col(label_col).alias("label"))
    fine = F.col("label").isNotNull() & F.col("id").isNotNull() & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    v = v.withColumn("fine", F.coalesce(fine, F.lit(False)))
    v = v.withColumns({"f1": F.when(F.col("fine"), F.xxhash64("label", "vec")), "f2": F.when(F.col("fine"), F.xxhash64(F.lit(1), "vec", "label"))})
    kinds = v.where("fine").groupBy("f1", "f2").agg(F.min("id").alias("low"), F.count("*").alias("size"), F.first("vec").alias("vec"), F.first("label").alias("label"))
    kinds = cut(kinds.withColumn("rep", F.monotonically_increasing_id()))
    facts = kinds.groupBy(F.size("vec").alias("dim"), "label").agg(F.count("*").alias("n"))
    facts = facts.groupBy("dim").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("n").cast("double")) / F.sum("n")).alias("each")).collect()  # a row for each length of vectors
    found = None
    for dim, rows, each in sorted(map(tuple, facts)):
        got = _linked(kinds.where(F.size("vec") == dim), rows, plan(dim, each, threshold), threshold)
        found = got if found is None else found.union(got)
    if found is None:
        return v.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").cast("long").alias("component_id"), F.lit(True).alias("kept"))
    found = cut(found)
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    trees = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "rep")
    trees = cut(trees.join(kinds.select("rep", "low"), "rep"))
    lowest = trees.groupBy(F.col("component").alias("a")).agg(F.min("low").alias("m"), F.count("*").alias("n"))
    trees = with_least(trees.select(F.col("component").alias("a"), F.col("rep").alias("b")), lowest, trees.count()).select(F.col("b").alias("rep"), F.col("m").alias("component_id"))
    known = kinds.select("f1", "f2", "rep", "low", "size").join(links, "rep", "left").join(trees, "rep", "left")
    known = known.select(F.col("f1").alias("k1"), F.col("f2").alias("k2"), F.coalesce("component_id", "low").alias("component_id"), (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    own = v.select("id", "f1", "f2")
    out = own.where("f1 is not null").join(known, (F.col("f1") == F.col("k1")) & (F.col("f2") == F.col("k2"))).select("id", "n_links", "component_id")
    out = out.union(own.where("f1 is null").select("id", F.lit(0).cast("long"), "id"))  # apart, or they would all be one task's
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def _linked(kinds: DataFrame, kinds_rows: int, hasher: Hasher, threshold: float) -> DataFrame:
    """Rows (rep, links, root) of representatives with links, several for each."""

    def bucket(batches):
        for b in batches:
            x = _unit(pa.chunked_array([b.column("vec")])) if b.num_rows else np.zeros((0, hasher.dim))
            keys = hasher.keys(x).reshape(len(x), hasher.tables * hasher.probes)
            brief = pa.array([np.unique(k).tobytes() for k in short(keys)], pa.binary())
            keys = [np.unique(k) for k in keys]
            ends = np.cumsum([0, *map(len, keys)])
            flat = pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("label"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat), brief], ["rep", "label", "buckets", "brief"])

    label = kinds.schema["label"].dataType.simpleString()
    keyed = cut(kinds.select("rep", "label", "vec").mapInArrow(bucket, f"rep bigint, label {label}, buckets array<bigint>, brief binary"))
    traits = kinds.select("rep", "size", "vec").join(keyed.select("rep", "brief"), "rep")
    keyed = keyed.select("rep", F.explode("buckets").alias("bucket"), "label").select("rep", F.struct("label", "bucket").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    dealt = block_pairs(join_sized(keyed, shared, "key", kinds_rows * hasher.tables * hasher.probes), "rep", NEAR).join(traits, "rep")

    def compare(t: pa.Table) -> pa.Table:
        """Many pairs of blocks at once: links are summed and joined to trees over all of them."""
        import pandas as pd

        own, b1, b2, bucket = (t.column(c).to_numpy() for c in ("own", "b1", "b2", "bucket"))
        rep, first_at, at = np.unique(t.column("rep").to_numpy(), return_index=True, return_inverse=True)
        size = t.column("size").to_numpy()[first_at]
        x = _unit(t.column("vec").take(pa.array(first_at)))
        keys = [np.frombuffer(k, np.uint32) for k in t.column("brief").take(pa.array(first_at)).to_pylist()]
        many = max(map(len, keys))
        # filled up with a vector's own last key, which is already there
        keys = np.array([np.append(k, np.full(many - len(k), k[-1], np.uint32)) for k in keys])
        small = short(bucket)
        groups = pd.DataFrame({"l": t.column("label").to_pandas(), "k": bucket, "i": b1, "j": b2}).groupby(["l", "k", "i", "j"], sort=False).indices
        found, counted = [], []
        for rows in groups.values():
            k, i, j = small[rows[0]], b1[rows[0]], b2[rows[0]]
            left, right = at[rows[own[rows] == i]], at[rows[own[rows] == j]]
            close = x[left] @ x[right].T >= threshold
            a, b = np.nonzero(np.triu(close, 1) if i == j else close)
            if not len(a):
                continue
            a, b = left[a], right[b]
            found.append((a, b))
            for lo in range(0, len(a), 50_000):  # a pair counts where its smallest common bucket is this one
                p, q = a[lo : lo + 50_000], b[lo : lo + 50_000]
                k1, k2 = keys[p], keys[q]
                fresh = np.ones(len(p), bool)
                for c in range(k1.shape[1]):
                    fresh &= ~((k1[:, c, None] < k) & (k1[:, c, None] == k2)).any(axis=1)
                counted.append((p[fresh], q[fresh]))
        if not found:
            return pa.table({"rep": rep[:0], "links": size[:0], "root": rep[:0]})
        tree = stars(len(rep), np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found]))
        a, b = np.concatenate([a for a, _ in counted]), np.concatenate([b for _, b in counted])
        links = np.bincount(a, size[b], len(rep)) + np.bincount(b, size[a], len(rep))
        out = np.flatnonzero((links > 0) | (tree != np.arange(len(rep))))
        return pa.table({"rep": rep[out], "links": links[out].astype(np.int64), "root": rep[tree[out]]})

    parts = max(64, kinds_rows * hasher.tables * hasher.probes // ROWS)
    groups = dealt.select(F.col("key.label").alias("label"), F.col("key.bucket").alias("bucket"), "rep", "size", "own", "b1", "b2", "vec", "brief")
    groups = groups.withColumn("part", F.pmod(F.xxhash64("label", "bucket", "b1", "b2"), F.lit(parts)).cast("int"))
    groups = groups.repartition(int(kinds.sparkSession.conf.get("spark.sql.shuffle.partitions")), "part")
    return groups.groupBy("part").applyInArrow(compare, "rep bigint, links bigint, root bigint")


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors."""
    return link(read(spark, sf_dir, "embeddings"))


QUERIES = {"op8_embedding_dedup": op8_embedding_dedup}
ORACLE = {
    "op8_embedding_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS low FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(low, vec_id)) AS kept
FROM embeddings LEFT JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id"""
}

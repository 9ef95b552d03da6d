"""Approximate nearest neighbours by a hash-prefix forest (LSH Forest).

A tree gives every vector a long hash string of ``BITS`` signs of random projections
about the vectors' mean, and keeps the strings sorted.  A query descends each
tree to its longest-prefix match, then all trees ascend together, one bit at a time,
until the rows that share the prefix in some tree are ``SHARE`` of the shard's rows;
these candidates are ranked by exact distance.  A prefix's rows hold those of all longer
ones, so where the ascent stops is looked for from short prefixes, with a bit a row; and
a product of matrices, with a bound of its error, tells which candidates' exact distances are needed.

The forest is sharded by a hash of the vector id into shards of about ``SHARD`` rows.
Each (shard, block of about ``BLOCK`` queries) is one group, which builds the sorted
arrays once and then asks ``TOGETHER`` queries at a time.  A query's best rows of all shards
are merged.  Every row is indexed.

Equal vectors: only the ``k + 1`` smallest ids of a vector can be among anyone's
``k`` nearest under ties to the smaller id, so only these are indexed.

The mean that the projections are centred at is fitted on at most ``FIT`` rows; it
moves recall, not correctness of distances.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table

K, TREES, BITS, SHARE = 10, 48, 24, 0.75
SHARD, BLOCK, TOGETHER, FIT = 16_384, 16_384, 512, 10_000
#: Queries whose distances are ranked at once, bytes of the maps of the longest mapped prefixes, and tasks at most.
RANKED, MAPS, PARTS = 64, 16 << 20, 10_000

FOUND = "query_id long, vec_id long, score double"


def codes(x: np.ndarray, mean: np.ndarray, trees: int, bits: int, seed: int) -> np.ndarray:
    """Each vector's hash string in each tree, as an integer whose highest bits come first."""
    rng = np.random.default_rng([seed, x.shape[1]])
    planes = rng.standard_normal((x.shape[1], trees * bits)).astype(np.float32)
    out = np.zeros((len(x), trees), np.int64)
    for i in range(0, len(x), 4096):
        sign = ((x[i : i + 4096] - mean).astype(np.float32) @ planes > 0).reshape(-1, trees, bits)
        octets = np.packbits(sign, axis=2)
        for j in range(octets.shape[2]):
            out[i : i + 4096] = out[i : i + 4096] << 8 | octets[:, :, j]
    return out >> -bits % 8


class Forest:
    """One shard's rows, with each tree's hash strings sorted.

    The rows that share a prefix of some bits hold all that share a longer one, so where the
    ascent stops is also found from its short prefixes alone.  For these, down to ``mapped``
    bits, a tree keeps each prefix's rows as a row of bits.
    """

    def __init__(self, index: np.ndarray, ids: np.ndarray, mean: np.ndarray, trees: int, bits: int, seed: int):
        self.index, self.ids, self.mean, self.trees, self.bits, self.seed = index, ids, mean, trees, bits, seed
        self.own = codes(index, mean, trees, bits, seed)
        self.order = np.argsort(self.own, axis=0, kind="stable").T.astype(np.int32)
        self.sorted = np.ascontiguousarray(np.take_along_axis(self.own, self.order.T, axis=0).T)
        self.squares = np.einsum("ij,ij->i", index, index)
        self.by_id = np.argsort(ids, kind="stable")
        self.mapped = max([0, *(d for d in range(min(bits, len(index).bit_length()) + 1) if trees * (len(index) // 8 + 1) << d <= MAPS)])
        self.start, self.maps = self.mapped, {}

    def map_of(self, depth: int) -> np.ndarray:
        """Each tree's and prefix's rows, a bit a row."""
        if depth not in self.maps:
            prefixes = np.arange(1 << depth)[:, None]
            self.maps[depth] = np.stack([np.packbits(prefixes == self.own[:, t] >> (self.bits - depth), axis=1) for t in range(self.trees)])
        return self.maps[depth]

    def sharing(self, asked: np.ndarray, depth: int) -> np.ndarray:
        """The rows that share a prefix of ``depth`` bits, mapped, in some tree, as bits."""
        rows, prefixes = self.map_of(depth), asked >> (self.bits - depth)
        out = rows[0][prefixes[:, 0]]
        for t in range(1, self.trees):
            out |= rows[t][prefixes[:, t]]
        return out

    def climb(self, asked: np.ndarray, want: int) -> np.ndarray:
        """The ascent from the whole strings to prefixes longer than the mapped ones, row by row."""
        seen = np.zeros((len(asked), len(self.index)), bool)
        live = np.arange(len(asked))
        for depth in range(self.bits, self.mapped - 1, -1):  # all trees ascend together
            shift = self.bits - depth
            for t in range(self.trees):
                prefix = asked[live, t] >> shift
                lo = np.searchsorted(self.sorted[t], prefix << shift)
                hi = np.searchsorted(self.sorted[t], (prefix + 1) << shift)
                for q, a, b in zip(live[hi > lo], lo[hi > lo], hi[hi > lo], strict=True):
                    seen[q, self.order[t, a:b]] = True
            live = live[seen[live].sum(axis=1) < want]
            if not len(live):
                break
        return np.packbits(seen, axis=1)

    def candidates(self, queries: np.ndarray, want: int) -> np.ndarray:
        """Which rows are candidates of each query: ``want`` of them or more."""
        asked = codes(queries, self.mean, self.trees, self.bits, self.seed)
        seen = np.zeros((len(queries), (len(self.index) + 7) // 8), np.uint8)
        live, start, longest = np.arange(len(queries)), self.start, 0
        while len(live):  # those that a prefix as long as the first suffices for start at a longer one
            at, early = live, live[:0]
            for depth in range(start, -1, -1):
                rows = self.sharing(asked[at], depth)
                enough = np.bitwise_count(rows).sum(axis=1, dtype=np.int64) >= want
                if depth == start and depth < self.bits:
                    early, longest = at[enough], depth + 1 if enough.any() else longest
                else:
                    seen[at[enough]] = rows[enough]
                    longest = max(longest, depth if enough.any() else 0)
                at = at[~enough]
                if not len(at):
                    break
            if start == self.mapped:
                if len(early):
                    seen[early] = self.climb(asked[early], want)
                break
            live, start = early, self.mapped
        self.start = min(self.mapped, longest + 1)
        return np.unpackbits(seen, axis=1, count=len(self.index)).view(bool)

    def short_list(self, queries: np.ndarray, seen: np.ndarray, k: int) -> np.ndarray:
        """``seen`` but for rows that can't be among the ``k`` nearest, by a product of matrices and a bound of its error."""
        if seen.shape[1] <= k:
            return seen
        with np.errstate(over="ignore", invalid="ignore"):
            squares = np.einsum("ij,ij->i", queries, queries)
            slack = 1e-300 + 16 * (queries.shape[1] + 8) * np.finfo(float).eps * (np.sqrt(self.squares.max()) + np.sqrt(squares)) ** 2
            far = self.squares - 2 * (queries @ self.index.T)  # squared distances but for the query's square
        if not (np.isfinite(slack).all() and np.isfinite(far).all()):
            return seen
        far[~seen] = np.inf
        return seen & (far <= (np.partition(far, k - 1, axis=1)[:, k - 1] + slack)[:, None])

    def nearest(self, queries: np.ndarray, query_ids: np.ndarray, k: int, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query id, id, distance) of each query's ``k`` nearest candidates."""
        want = min(len(self.index), max(4 * (k + 1), int(np.ceil(share * len(self.index)))))
        out_q, out_i, out_d = [], [], []
        for i in range(0, len(queries), TOGETHER):
            seen = self.candidates(queries[i : i + TOGETHER], want)
            for j in range(0, len(seen), RANKED):
                asked, own, hit = queries[i + j : i + j + RANKED][: len(seen) - j], query_ids[i + j : i + j + RANKED][: len(seen) - j], seen[j : j + RANKED]
                at = self.by_id[np.minimum(np.searchsorted(self.ids, own, sorter=self.by_id), len(self.ids) - 1)]
                same = self.ids[at] == own
                hit[np.flatnonzero(same), at[same]] = False
                q, r = np.nonzero(self.short_list(asked, hit, k))
                d = np.concatenate([np.sqrt(((self.index[r[m : m + 4096]] - asked[q[m : m + 4096]]) ** 2).sum(axis=1)) for m in range(0, len(q), 4096)] or [np.empty(0)])
                best = np.lexsort((self.ids[r], d, q))
                q = q[best]
                first = np.arange(len(q)) - np.searchsorted(q, q) < k
                best = best[first]
                out_q.append(own[q[first]])
                out_i.append(self.ids[r[best]])
                out_d.append(d[best])
        empty = [np.empty(0)]
        return np.concatenate(out_q or empty).astype(np.int64), np.concatenate(out_i or empty).astype(np.int64), np.concatenate(out_d or empty)


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    n = len(flat)
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def group_search(mean: np.ndarray, k: int, trees: int, bits: int, share: float, seed: int):
    def run(group: pa.Table) -> pa.Table:
        asks = group.column("ask").to_numpy()
        x, ids = matrix(group.column("v")), group.column("vec_id").to_numpy()
        if asks.all() or not asks.any():
            q, i, d = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        else:
            q, i, d = Forest(x[~asks], ids[~asks], mean, trees, bits, seed).nearest(x[asks], ids[asks], k, share)
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(i, pa.int64()), "score": pa.array(d, pa.float64())})

    return run


def usable(v: Column) -> Column:
    """Not null, not empty, all components finite, some component not zero."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)


def nearest(vectors: DataFrame, asked: Column, k: int = K, trees: int = TREES, bits: int = BITS, share: float = SHARE, shard: int = SHARD, block: int = BLOCK, seed: int = 7) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest other rows found for each row where ``asked`` holds.

    ``vectors`` has vec_id and embedding; other columns are ignored.  Rows with a null
    vec_id, and vectors that are null, empty, zero or hold null or non-finite
    components take no part.  Vectors of another length than the most frequent one take
    no part.  Repeated vec_ids: the row with the smallest vector counts.
    """
    scratch = Scratch(vectors.sparkSession, "forest")
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), F.coalesce(asked, F.lit(False)).alias("ask")).filter(F.col("vec_id").isNotNull() & usable(F.col("v")))
    # a repeated id keeps its least vector; negative zeros equal zeros
    rows = rows.withColumn("v", F.transform("v", lambda x: x + 0.0)).groupBy("vec_id").agg(F.min(F.struct("v", "ask")).alias("s")).select("vec_id", "s.v", "s.ask")
    rows = scratch.keep(rows.withColumn("size", F.size("v")))
    sizes = rows.groupBy("size").count().orderBy(F.desc("count"), "size").first()
    if sizes is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.filter(F.col("size") == sizes["size"])
    n = sizes["count"]
    fit = rows.orderBy(F.xxhash64("vec_id")).limit(FIT).select("v").toArrow()  # a bounded sample
    mean = matrix(fit.column("v")).mean(axis=0)
    # row_number below a bound is cut to k + 1 rows a vector before the shuffle
    first = Window.partitionBy(F.xxhash64("v"), "v").orderBy("vec_id")  # sorts by the hash, vectors only where it is equal
    index = scratch.keep(rows.select("vec_id", "v").withColumn("at", F.row_number().over(first)).filter(F.col("at") <= k + 1).drop("at"))
    queries = rows.filter("ask").select("vec_id", "v")
    shards, blocks = max(1, -(-n // shard)), max(1, -(-queries.count() // block))
    left = index.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("ask", F.lit(False))
    right = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))).withColumn("ask", F.lit(True))
    columns = ["shard", "block", "ask", "vec_id", "v"]
    groups = left.select(columns).union(right.select(columns)).repartition(min(shards * blocks, PARTS), "shard", "block")  # tasks of about one group
    found = groups.groupBy("shard", "block").applyInArrow(group_search(mean, k, trees, bits, share, seed), FOUND)
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_hash_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)

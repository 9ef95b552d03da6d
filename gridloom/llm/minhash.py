"""MinHash near-duplicate detection with SuperMinHash signatures.

1. Every document becomes the set of its distinct word shingles.  Documents with
   equal sets form a class, which is represented by its smallest doc_id.
2. A class gets a SuperMinHash signature: each element draws ranks of one
   permutation of the signature's cells, and a cell keeps the least
   ``rank + fraction``.  Ranks are drawn level by level for all elements at once;
   a document stops as soon as every cell holds a value below the next rank,
   because later ranks can't change it.
3. Bands of the signature give bucket keys.  In each bucket the smallest doc_id is
   the hub, and every other member is compared with it on the full shingle sets:
   one comparison a member, not one a pair.
4. A bucket whose members are then still in several components may hide links
   between members.  Members apart from their hub seek links to the other members of
   that hub's buckets: counted on full sets, in blocks inside tasks, so that only
   links become rows.  No pair that shares a bucket and could join two components is
   left out.
5. Links are grouped by union-find in each partition, then by alternating star
   contractions across partitions.

With 40 bands of 5 cells, a pair at the similarity threshold 0.75 shares no band
with probability 2e-5, one at 0.8 with 2e-7.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import GOLDEN, STEP_BYTES, U64, Scratch, Words, batch_of, mix, seeds, shingles, slices, steps, table

WIDTH, BANDS, ROWS, PERCENT = 5, 40, 5, 75
#: Parts that a frequent key is dealt into.
SALTS = 16


#: Elements whose permutations are held at once.
ELEMENTS = 1 << 16


def superminhash(sets: list[np.ndarray], m: int) -> np.ndarray:
    """One signature a set: ``rank << 32 | fraction`` for each of ``m`` cells (all ones for an empty set)."""
    out = np.full(len(sets) * m, ~U64(0), U64)
    every = np.concatenate(sets) if sets else np.empty(0, U64)
    of = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    for at in range(0, len(every), ELEMENTS):  # least values of parts are least values of the whole
        lower(out, m, every[at : at + ELEMENTS], of[at : at + ELEMENTS])
    return out.reshape(-1, m)


def lower(out: np.ndarray, m: int, h: np.ndarray, d: np.ndarray) -> None:
    """Puts the elements ``h`` of the sets ``d`` into the signatures."""
    low, half = U64(0xFFFFFFFF), U64(32)
    with np.errstate(over="ignore"):
        cells = None
        for j in range(m):
            x = mix(h + U64(j + 1) * GOLDEN)
            k = j + (((x >> half) * U64(m - j)) >> half).astype(np.int64)
            if cells is None:
                cell = k
            else:
                line = np.arange(len(h))
                cell = cells[line, k].astype(np.int64)
                cells[line, k] = cells[:, j]
            np.minimum.at(out, d * m + cell, (U64(j) << half) | (x & low))
            first = d[0]
            most = out.reshape(-1, m)[first : d[-1] + 1].max(axis=1)
            more = (most >= (U64(j + 1) << half))[d - first]
            if not more.any():
                break
            if j == 0:
                h, d, k = h[more], d[more], k[more]
                cells = np.tile(np.arange(m, dtype=np.uint16), (len(h), 1))
                cells[np.arange(len(h)), k] = 0
            elif more.sum() < 0.7 * len(more):
                h, d, cells = h[more], d[more], cells[more]


def band_keys(signatures: np.ndarray, bands: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        cut = mix(signatures + GOLDEN).reshape(len(signatures), bands, -1)
        odd = seeds(cut.shape[2], 5) | U64(1)
        return mix((cut * odd).sum(axis=2, dtype=U64) + seeds(bands, 6))


FEATURES = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("bands", pa.list_(pa.int64()))])


def features(width: int, bands: int, rows: int):
    def run(batches):
        for batch, raw in steps(batches, limit=STEP_BYTES // 2):
            sets = shingles(Words(raw), width)
            keys = band_keys(superminhash(sets, bands * rows), bands).view(np.int64)
            n = np.array([len(x) for x in sets])
            with np.errstate(over="ignore"):
                f1 = np.array([x.sum(dtype=U64) for x in map(mix, sets)], U64).view(np.int64)
                f2 = np.array([np.bitwise_xor.reduce(mix(x + GOLDEN)) if len(x) else U64(0) for x in sets], U64).view(np.int64)
            yield batch_of(FEATURES, {"doc_id": batch.column("doc_id"), "n": n, "f1": f1, "f2": f2, "bands": pa.ListArray.from_arrays(np.arange(0, len(n) * bands + 1, bands, dtype=np.int32), keys.ravel())})

    return run


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("linked", pa.bool_())])


def verify(width: int, percent: int):
    """Whether two texts' full shingle sets reach the similarity."""

    def run(batches):
        for batch in slices(batches):
            texts: dict[bytes, int] = {}
            ta = [texts.setdefault(x or b"", len(texts)) for x in batch.column("ta").cast(pa.binary()).to_pylist()]
            tb = [texts.setdefault(x or b"", len(texts)) for x in batch.column("tb").cast(pa.binary()).to_pylist()]
            sets = shingles(Words(list(texts)), width)
            ok = []
            for i, j in zip(ta, tb, strict=True):
                x, y = sets[i], sets[j]
                both = np.sort(np.concatenate((x, y)))
                same = int((both[1:] == both[:-1]).sum())
                ok.append(len(x) > 0 and len(y) > 0 and 100 * same >= percent * (len(x) + len(y) - same))
            yield batch_of(LINKS, {"a": batch.column("a"), "b": batch.column("b"), "linked": ok})

    return run


#: Nodes that a partition's union-find holds; then it begins anew.
NODES = 500_000


def union_find(batches):
    """The partition's links as stars: (smallest node of the node's group here, node)."""
    root: dict[int, int] = {}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def stars():
        nodes = [x for x in root if find(x) != x]
        for i in range(0, len(nodes), 50_000):
            part = nodes[i : i + 50_000]
            yield pa.RecordBatch.from_pydict({"a": pa.array([find(x) for x in part], pa.int64()), "b": pa.array(part, pa.int64())})

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            root.setdefault(a, a)
            root.setdefault(b, b)
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
        if len(root) > NODES:
            yield from stars()
            root.clear()
    yield from stars()


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of every node that has a link; component is its smallest node."""
    low, high = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    # by node and a part of its links, so that a node of many links is no single task
    edges = scratch.keep(links.select(low, high).repartition(F.col("a"), F.pmod(F.xxhash64("b"), F.lit(SALTS))).mapInArrow(union_find, "a long, b long"))
    mark = None
    while True:
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
        # large star: every larger neighbour of a node links to the smallest of its neighbours and itself
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        least = scratch.keep(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = scratch.keep(both.join(least, "u").filter("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct())
        # small star: a node and its smaller neighbours link to the smallest of them
        tops = scratch.keep(large.groupBy("b").agg(F.min("a").alias("m")))
        small = large.join(tops, "b").select(F.col("m").alias("a"), F.col("a").alias("b")).union(tops.select("m", "b")).filter("a <> b").distinct()
        old, edges = edges, scratch.keep(small)
        scratch.drop(old, least, large, tops)
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).union(edges.select("a", "a").distinct())


SETS = pa.schema([("rep", pa.int64()), ("s", pa.list_(pa.int64()))])


def shingle_lists(width: int):
    def run(batches):
        for batch, raw in steps(batches):
            sets = shingles(Words(raw), width)
            cut = np.append(0, np.cumsum([len(x) for x in sets])).astype(np.int32)
            yield batch_of(SETS, {"rep": batch.column("rep"), "s": pa.ListArray.from_arrays(cut, np.concatenate(sets).view(np.int64) if sets else [])})

    return run


#: Members of a hub's buckets that are compared with seekers at once.
BLOCK = 512


def seek_links(percent: int):
    """For each seeker, one linked member of the block for each other component that it is linked to."""

    def run(seekers: pa.Table, members: pa.Table) -> pa.Table:
        out = {"a": [], "b": []}
        if len(seekers) and len(members):
            ids, comps = members.column("rep").to_numpy(), members.column("comp").to_numpy()
            sets = members.column("s").combine_chunks()
            sizes = np.diff(sets.offsets.to_numpy())
            values = sets.flatten().to_numpy()
            owner = np.repeat(np.arange(len(ids)), sizes)
            order = np.argsort(values, kind="stable")
            values, owner = values[order], owner[order]
            for x, comp, s in zip(seekers.column("rep").to_pylist(), seekers.column("comp").to_pylist(), seekers.column("s"), strict=True):
                s = s.values.to_numpy()
                lo, hi = np.searchsorted(values, s, "left"), np.searchsorted(values, s, "right")
                n = hi - lo
                if 100 * np.count_nonzero(n) < percent * len(s):  # no set can share enough
                    continue
                at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
                same = np.bincount(owner[at], minlength=len(ids))
                linked = np.flatnonzero((100 * same >= percent * (len(s) + sizes - same)) & (comps != comp))
                for i in linked[np.unique(comps[linked], return_index=True)[1]]:
                    out["a"].append(min(x, int(ids[i])))
                    out["b"].append(max(x, int(ids[i])))
        return pa.table({k: pa.array(v, pa.int64()) for k, v in out.items()})

    return run


def sought_links(seekers: DataFrame, members: DataFrame, texts: DataFrame, width: int, percent: int, scratch: Scratch) -> DataFrame:
    """Links (a, b) between components: of each seeker (rep, comp, goal), to members (rep, comp, goal) of its goals.

    Both sides of a goal are cut into blocks by a hash, so no task holds a whole
    goal; pairs are counted on full sets inside a task and only links leave it.
    """
    active = members.select("rep").distinct()
    lists = scratch.keep(active.join(texts.withColumnRenamed("doc_id", "rep"), "rep").mapInArrow(shingle_lists(width), "rep long, s array<long>"), "lz4")
    counts = seekers.groupBy("goal").agg(F.count("*").alias("xs")).join(members.groupBy("goal").agg(F.count("*").alias("ys")), "goal")
    counts = scratch.keep(counts.select("goal", F.ceil(F.col("xs") / BLOCK).cast("int").alias("xs"), F.ceil(F.col("ys") / BLOCK).cast("int").alias("ys")))
    one = seekers.join(counts, "goal").join(lists, "rep").withColumn("x", F.pmod(F.hash("rep"), F.col("xs"))).withColumn("y", F.explode(F.expr("sequence(0, ys - 1)")))
    two = members.join(counts, "goal").join(lists, "rep").withColumn("y", F.pmod(F.hash("rep"), F.col("ys"))).withColumn("x", F.explode(F.expr("sequence(0, xs - 1)")))
    columns = ["goal", "x", "y", "rep", "comp", "s"]
    one = scratch.keep(one.select(columns), "lz4")
    return one.groupBy("goal", "x", "y").cogroup(two.select(columns).groupBy("goal", "x", "y")).applyInArrow(seek_links(percent), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row a row of ``docs`` (doc_id, text; other columns are ignored).

    Null and empty texts have no shingles and are alone in their component.  Rows
    that share a doc_id are one node: all their texts' links join in it.  A null doc_id
    has no component and is kept.  Ties: the smallest doc_id is the one that is kept.  Very
    long texts are hashed, and their signatures drawn, in pieces.
    """
    scratch = Scratch(docs.sparkSession, "minhash", "none")  # many small tables
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    feats = scratch.keep(docs.mapInArrow(features(width, bands, rows), "doc_id long, n long, f1 long, f2 long, bands array<long>"), "lz4")
    real = feats.filter("n > 0 and doc_id is not null")
    classes = scratch.keep(real.groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands")), "lz4")
    texts = docs.filter("doc_id is not null")
    each = classes.select("rep", "n", F.explode("bands").alias("key"))
    hubs = scratch.keep(each.groupBy("key").agg(F.min(F.struct("rep", "n")).alias("hub"), F.max("rep").alias("last")).filter("hub.rep < last").select("key", F.col("hub.rep").alias("hub"), F.col("hub.n").alias("hn")))
    members = scratch.keep(each.join(hubs, "key").filter("rep <> hub"))

    def verified(pairs: DataFrame) -> DataFrame:
        sides = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
        return scratch.keep(sides.mapInArrow(verify(width, percent), "a long, b long, linked boolean"))

    stars = scratch.keep(members.filter(f"100 * least(n, hn) >= {percent} * greatest(n, hn)").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct())
    first = verified(stars)
    # rows of one doc_id are one node, so their classes are linked
    own = real.groupBy("doc_id").agg(F.min(F.struct("f1", "f2")).alias("x"), F.max(F.struct("f1", "f2")).alias("y")).filter("x <> y").select("doc_id")
    several = scratch.keep(real.select("doc_id", "f1", "f2").join(own, "doc_id", "left_semi").join(classes.select("f1", "f2", "rep"), ["f1", "f2"]).filter("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).distinct())
    links = first.filter("linked").select("a", "b").union(several)
    group = scratch.keep(components(links, scratch))
    of = members.join(group.select(F.col("node").alias("rep"), F.col("component").alias("rc")), "rep", "left").join(group.select(F.col("node").alias("hub"), F.col("component").alias("hc")), "hub", "left")
    apart = scratch.keep(of.select("key", "rep", "hub", F.coalesce("rc", "rep").alias("rc"), F.coalesce("hc", "hub").alias("hc")).withColumn("apart", F.col("rc") != F.col("hc")))
    seekers = scratch.keep(apart.filter("apart").select("rep", F.col("rc").alias("comp"), F.col("hub").alias("goal")).distinct())
    salt = F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int").alias("salt")
    mixed = apart.filter("apart").select("key").distinct().withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    inside = apart.select("*", salt).join(mixed, ["key", "salt"], "left_semi")
    around = scratch.keep(inside.select("rep", F.col("rc").alias("comp"), F.col("hub").alias("goal")).distinct())
    links = links.union(scratch.keep(sought_links(seekers, around, texts, width, percent, scratch)))
    group = components(links, scratch)
    named = classes.select("f1", "f2", "rep").join(group.withColumnRenamed("node", "rep"), "rep", "left")
    named = scratch.keep(named.select("f1", "f2", F.coalesce("component", "rep").alias("component_id"), F.lit(True).alias("real")))
    slim = scratch.keep(feats.select("doc_id", "n", "f1", "f2"))
    scratch.only(slim, named)
    out = slim.select("doc_id", F.col("n").alias("n_shingles"), "f1", "f2", F.expr("n > 0 and doc_id is not null").alias("real"))
    out = out.join(named, ["f1", "f2", "real"], "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingles, component and verdict of each of ``documents``; cases as in ``near_duplicates``."""
    return near_duplicates(table(spark, sf_dir, "documents"))

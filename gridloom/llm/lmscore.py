"""Language-model scoring with a log-frequency Bloom filter of quantised n-gram counts.

1. Texts are dealt into steps of about ``TOGETHER`` bytes, which are written once.
   Each step's distinct unigrams and bigrams go, with their counts in its training
   texts (0: only asked for), packed by hash segment, to the task that owns the segment.
2. The owner adds them up.  A count c has level ``1 + floor(2 * log2 c)``, and the
   n-gram is put into the segment's filter once for each level up to its own, so
   that a level is found by repeated membership probes (levels are nested: by
   bisection).  A filter has ``BITS`` bits an entry, so all filters together grow with
   the distinct n-grams; the number of segments grows with the text, so one filter
   doesn't, and a task holds one at a time.
3. The owner probes its filter for the n-grams of every step and sends the levels back
   in the n-grams' order.  The step meets them and scores its texts:
   P(w|v) = (c(vw) + mu * P(w)) / (c(v) + mu), all counts from probes.

The unigram base score uses exact counts: the ``HEAD`` most frequent tokens are
broadcast, the others are joined with the count table by shuffle; none of them is
frequent, so none is a hot key.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import GOLDEN, U64, Scratch, Words, batch_of, held_out, mix, planes, segment_of, steps, summed, table, unplaned

MIN_BITS, BITS = 6, 12
HEAD = 100_000
MU = 300.0
#: Text bytes per segment, about.
SEGMENT = 16 << 20
#: Text bytes of a step, about; a longer text is a step of its own.
TOGETHER = 4 << 20
#: N-grams that are probed at once.
BLOCK = 1 << 18
#: Bits of a bigram's hash that are kept: among 1e12 bigrams, one in 280 meets another's, about as many as the filter's false positives.
PAIR = ~U64((1 << 16) - 1)
END, START = U64(0x1234567), U64(0x7654321)


def tokens(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes with an end after each text, the token before each one, and each text's first index (and the end)."""
    w = Words(raw)
    first = w.first + np.arange(len(w.first))
    t = np.empty(first[-1], U64)
    ends = first[1:] - 1
    mask = np.ones(len(t), bool)
    mask[ends] = False
    t[mask], t[ends] = w.h, mix(np.array([END]))[0]
    before = np.empty_like(t)
    before[1:] = t[:-1]
    before[first[:-1]] = mix(np.array([START]))[0]
    return t, before, first


def bigrams(t: np.ndarray, before: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(before * U64(0xD6E8FEB86659FD93) + t + GOLDEN) & PAIR


HELD = pa.schema([("step", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("held_out", pa.list_(pa.bool_())), ("size", pa.list_(pa.int64())), ("text", pa.binary())])


def together(batches):
    """Each step's rows as one row, their texts together by zstd."""
    task = TaskContext.get().partitionId()
    for i, (batch, raw) in enumerate(steps(batches, limit=TOGETHER)):
        yield batch_of(HELD, {"step": [(task << 32) + i], "doc_id": [batch.column("doc_id").to_pylist()], "held_out": [batch.column("held_out").to_pylist()], "size": [[len(x) for x in raw]], "text": [pa.Codec("zstd", compression_level=3).compress(b"".join(raw), asbytes=True)]})


def texts(size: list[int], text: bytes) -> list[bytes]:
    """A step's texts."""
    ends = np.append(0, np.cumsum(size))
    every = pa.decompress(text, int(ends[-1]), codec="zstd", asbytes=True)
    return [every[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def trained(keys: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and how often each is in the training part."""
    some, n = summed(keys[train])
    rest = summed(keys[~train])[0]
    every = np.union1d(some, rest)
    counts = np.zeros(len(every), np.int64)
    counts[np.searchsorted(every, some)] = n
    return every, counts


PACKED = pa.schema([("step", pa.int64()), ("seg", pa.int32()), ("uk", pa.binary()), ("uc", pa.binary()), ("bk", pa.binary()), ("bc", pa.binary())])


def count(segments: int):
    """Each step's distinct n-grams (as differences) and training counts, by segment."""

    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                t, before, first = tokens(texts(*(batch.column(k)[i].as_py() for k in ("size", "text"))))
                train = np.repeat(~np.array(batch.column("held_out")[i].as_py(), bool), np.diff(first))
                rows = {f.name: [] for f in PACKED}
                parts = []
                for k in (t, bigrams(t, before)):
                    key, n = trained(k, train)
                    parts.append((key, n.astype("<u4"), np.searchsorted(segment_of(key, segments), np.arange(segments + 1))))
                (uk, uc, ua), (bk, bc, ba) = parts
                step = batch.column("step")[i].as_py()
                for s in np.flatnonzero((np.diff(ua) > 0) | (np.diff(ba) > 0)):
                    u, b = slice(ua[s], ua[s + 1]), slice(ba[s], ba[s + 1])
                    for name, v in zip(rows, (step, int(s), planes(np.diff(uk[u], prepend=U64(0))), planes(uc[u]), planes(np.diff(bk[b], prepend=U64(0))), planes(bc[b])), strict=True):
                        rows[name].append(v)
                yield batch_of(PACKED, rows)

    return run


def level(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(2 * np.log2(np.maximum(counts, 1)) + 1e-9).astype(np.int64)


def count_of(levels: np.ndarray) -> np.ndarray:
    """The middle of a level's counts; 0 for level 0."""
    low = 2.0 ** ((np.maximum(levels, 1) - 1) / 2)
    lo, hi = np.ceil(low - 1e-9), np.ceil(low * 2**0.5 - 1e-9) - 1
    return np.where(levels > 0, (lo + np.maximum(hi, lo)) / 2, 0.0)


def entry(keys: np.ndarray, lv) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        x = mix(keys + (np.asarray(lv).astype(U64) + U64(1)) * GOLDEN)
    return x & U64(0xFFFFFFFF), (x >> U64(32)) | U64(1)


MODEL = pa.schema([("seg", pa.int32()), ("key", pa.int64()), ("c", pa.int64()), ("bits", pa.binary()), ("probes", pa.int32()), ("base", pa.int32())])


def filtered(keys: np.ndarray, counts: np.ndarray, share: int | None) -> tuple[bytes, int, int, int]:
    """The filter's bits, and its size, probes and base."""
    lv = level(counts)
    above = np.bincount(lv, minlength=2)[::-1].cumsum()[::-1]  # n-grams that reach a level
    base = 0
    while share is not None and above[base + 1 :].sum() * MIN_BITS > share and base + 2 < len(above):
        base += 1
    entries = max(1, int(above[base + 1 :].sum()))
    size = int((entries * BITS if share is None else min(share, entries * BITS)) + 64)
    probes = max(1, min(8, round(size / entries * 0.69)))
    bits = np.zeros(size, bool)
    for x in range(base + 1, len(above)):
        reach = keys[lv >= x]
        for begin in range(0, len(reach), BLOCK):
            h1, h2 = entry(reach[begin : begin + BLOCK], x)
            for i in range(probes):
                bits[((h1 + U64(i) * h2) % U64(size)).astype(np.int64)] = True
    return np.packbits(bits).tobytes(), size, probes, base


def build(share: int | None = None):
    """Exact unigram counts and the segment's filter, with ``BITS`` bits an entry.

    Only if a caller bounds it to ``share`` bits and entries would get under ``MIN_BITS``
    each, the lowest count classes leave it.
    """

    def run(group: pa.Table) -> pa.Table:
        def column(name, kind):
            return np.frombuffer(b"".join(group.column(name).to_pylist()), kind)

        uk, un = summed(column("uk", "<u8").astype(U64), column("uc", "<u4"))
        bk, bn = summed(column("bk", "<u8").astype(U64), column("bc", "<u4"))
        (uk, un), (bk, bn) = ((k[n > 0], n[n > 0]) for k, n in ((uk, un), (bk, bn)))
        bits, size, probes, base = filtered(np.concatenate((uk, bk)), np.concatenate((un, bn)), share)
        last = np.arange(len(uk) + 1) == len(uk)

        def only(value, kind):
            return pa.concat_arrays([pa.nulls(len(uk), kind), pa.array([value], kind)])

        columns = [np.full(len(last), group.column("seg")[0].as_py(), np.int32), pa.array(np.append(uk, U64(0)).view(np.int64), mask=last), np.append(un, size), only(bits, pa.binary()), only(probes, pa.int32()), only(base, pa.int32())]
        return pa.Table.from_arrays([pa.array(x, f.type) if isinstance(x, np.ndarray) else x for x, f in zip(columns, MODEL, strict=True)], schema=MODEL)

    return run


def joined(rows: list[tuple[int, bytes, int, int, int]], segments: int) -> tuple[np.ndarray, ...]:
    """All segments' bits in one array, and each one's first bit, size, probes and base."""
    size, probes, base, offset = np.ones(segments, U64), np.zeros(segments, np.int64), np.zeros(segments, np.int64), np.zeros(segments, np.int64)
    bits = np.zeros(max(1, sum(len(r[1]) for r in rows)), np.uint8)
    at = 0
    for seg, part, n, k, low in rows:
        size[seg], probes[seg], base[seg], offset[seg] = n, k, low, at * 8
        bits[at : at + len(part)] = np.frombuffer(part, np.uint8)
        at += len(part)
    return bits, offset, size, probes, base


class Filter:
    """Probes the joined filter for the levels of n-gram hashes."""

    def __init__(self, bits, offset, size, probes, base):
        self.bits, self.offset, self.size, self.probes, self.base = bits, offset, size, probes, base
        self.segments = len(size)
        self.most = 2 * 64 + 1

    def has(self, keys, lv, seg) -> np.ndarray:
        h1, h2 = entry(keys, lv)
        live, out = np.flatnonzero(self.probes[seg] > 0), np.zeros(len(keys), bool)
        for i in range(int(self.probes.max(initial=0))):
            s = seg[live]
            at = ((h1[live] + U64(i) * h2[live]) % self.size[s]).astype(np.int64) + self.offset[s]
            hit = ((self.bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).astype(bool) | (self.probes[s] <= i)
            live = live[hit]
        out[live] = True
        return out

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The level by gallop and bisection over nested levels; 0 if the lowest kept level is absent."""
        seg = segment_of(keys, self.segments)
        base = self.base[seg]
        good, step = base.copy(), np.ones(len(keys), np.int64)
        live = np.arange(len(keys))
        bad = np.full(len(keys), self.most)
        while len(live):
            lv = np.minimum(good[live] + step[live], self.most)
            hit = self.has(keys[live], lv, seg[live])
            bad[live[~hit]] = lv[~hit]
            good[live[hit]] = lv[hit]
            step[live] *= 2
            live = live[hit & (lv < self.most)]
        live = np.flatnonzero(bad - good > 1)
        while len(live):
            lv = (good[live] + bad[live]) // 2
            hit = self.has(keys[live], lv, seg[live])
            good[live[hit]], bad[live[~hit]] = lv[hit], lv[~hit]
            live = live[bad[live] - good[live] > 1]
        return np.where(good > base, good, 0)


ANSWERS = pa.schema([("key", pa.int64()), ("c", pa.int64()), ("step", pa.int64()), ("seg", pa.int32()), ("ul", pa.binary()), ("bl", pa.binary())])


def answer(share: int | None = None):
    """Exact unigram counts, and the levels of each step's n-grams from the segment's filter."""

    def run(group: pa.Table) -> pa.Table:
        found = []
        for key, count in (("uk", "uc"), ("bk", "bc")):
            asked = [np.cumsum(unplaned(x.as_py(), "<u8")) for x in group.column(key)]
            ends = np.append(0, np.cumsum([len(x) for x in asked]))
            keys, back = np.unique(np.concatenate(asked), return_inverse=True)
            n = np.concatenate([unplaned(x.as_py(), "<u4") for x in group.column(count)])
            found.append((keys, back, ends, np.bincount(back, n, len(keys)).astype(np.int64)))
        (uk, un), (bk, bn) = ((k[n > 0], n[n > 0]) for k, _, _, n in found)
        bits, size, probes, base = filtered(np.concatenate((uk, bk)), np.concatenate((un, bn)), share)
        del bk, bn
        probe = Filter(*joined([(0, bits, size, probes, base)], 1))
        levels = []
        while found:
            keys, back, ends, _ = found.pop(0)
            lv = np.concatenate([probe.levels(keys[i : i + BLOCK]).astype(np.uint8) for i in range(0, len(keys), BLOCK)] or [np.empty(0, np.uint8)])[back]
            levels.append(pa.array([lv[i:j].tobytes() for i, j in zip(ends, ends[1:], strict=False)], pa.binary()))
        n, m = len(uk), len(group)
        one = [pa.array(uk.view(np.int64)), pa.array(un), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), *[pa.nulls(n, pa.binary())] * 2]
        two = [*[pa.nulls(m, pa.int64())] * 2, group.column("step"), group.column("seg"), *levels]
        return pa.concat_tables([pa.Table.from_arrays(x, schema=ANSWERS) for x in (one, two)]).combine_chunks()

    return run


SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("rare", pa.list_(pa.int64()))])


def score(shared, total: int, distinct: int, mu: float):
    """Scores a step's texts with the levels that its n-grams' owners sent."""

    def run(held: pa.Table, levels: pa.Table) -> pa.Table:
        head, head_n = shared.value
        zero = total + 0.5 * (distinct + 1)
        seg = np.argsort(levels.column("seg").to_numpy())  # segments are in the order of keys
        got = levels.take(pa.array(seg))
        c_words, c_pairs = (count_of(np.frombuffer(b"".join(got.column(k).to_pylist()), np.uint8).astype(np.int64)) for k in ("ul", "bl"))
        t, before, first = tokens(texts(*(held.column(k)[0].as_py() for k in ("size", "text"))))
        words, back = np.unique(t, return_inverse=True)
        at = np.minimum(np.searchsorted(head, words), max(len(head) - 1, 0))
        known = head[at] == words if len(head) else np.zeros(len(words), bool)
        logs = np.log10((np.where(known, head_n[at] if len(head) else 0, 0) + 0.5) / zero)
        p1 = (c_words + 0.5) / zero
        _, pair_back = np.unique(bigrams(t, before), return_inverse=True)
        before_n = np.empty(len(t))
        before_n[1:] = c_words[back[:-1]]
        before_n[first[:-1]] = c_words[back[-1]]  # as many starts as ends
        p = (np.minimum(c_pairs[pair_back], before_n) + mu * p1[back]) / (before_n + mu)
        held_known = known[back]
        rare = t[~held_known].view(np.int64)
        cut = np.append(0, np.cumsum(~held_known))[first].astype(np.int32)
        out = {"doc_id": held.column("doc_id")[0].as_py(), "held_out": held.column("held_out")[0].as_py(), "n_tokens": np.diff(first), "known": np.add.reduceat(held_known.astype(np.int64), first[:-1]), "base": np.add.reduceat(logs[back], first[:-1]), "score": np.add.reduceat(np.log10(p), first[:-1]), "rare": pa.ListArray.from_arrays(cut, rare)}
        return pa.Table.from_batches([batch_of(SCORED, out)])

    return run


def lm_scores(docs: DataFrame, remainder: int = 1, mu: float = MU, max_filter: int | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row a row of ``docs``.

    Learns from rows whose ``crc32(doc_id as text) mod 5`` isn't ``remainder``; a null
    doc_id isn't held out.  Null and empty texts have the end token only.  Without
    training rows all counts are 0.  Rows that share a doc_id are scored each for
    itself.  Other columns are ignored.  With ``max_filter``, all filters together have
    at most so many bytes, and low counts are lost where that is too little.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lmscore")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id"), remainder).alias("held_out"), F.col("text").cast("string").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    segments = max(16, -(-size // SEGMENT))
    held = scratch.keep(docs.mapInArrow(together, "step long, doc_id array<long>, held_out array<boolean>, size array<long>, text binary"), "none")
    packed = held.mapInArrow(count(segments), "step long, seg int, uk binary, uc binary, bk binary, bc binary")
    share = None if max_filter is None else 8 * max_filter // segments
    model = scratch.keep(packed.groupBy("seg").applyInArrow(answer(share), "key long, c long, step long, seg int, ul binary, bl binary"))
    counts = model.filter("key is not null").select("key", "c")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    head = counts.orderBy(F.desc("c"), "key").limit(HEAD).toArrow()
    keys, n = head.column("key").to_numpy().view(U64), head.column("c").to_numpy()
    order = np.argsort(keys)
    shared = spark.sparkContext.broadcast((keys[order], n[order]))
    levels = model.filter("step is not null").select("step", "seg", "ul", "bl")
    scored = held.groupBy("step").cogroup(levels.groupBy("step")).applyInArrow(score(shared, total, distinct, mu), "doc_id long, held_out boolean, n_tokens long, known long, base double, score double, rare array<long>")
    scored = scratch.keep(scored.withColumn("row", F.monotonically_increasing_id()))
    scratch.drop(held)
    rare = scored.select("row", F.explode("rare").alias("key"))
    more = rare.join(counts, "key").groupBy("row").agg(F.count("*").alias("more"), F.sum(F.log10((F.col("c") + 0.5) / 0.5)).alias("gain"))
    out = scored.drop("rare").join(more, "row", "left")
    return out.select("doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("gain", F.lit(0.0))).alias("base_score"), "score")


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))

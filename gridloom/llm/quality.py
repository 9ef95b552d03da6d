"""Quality classifier: an interpolated modified Kneser-Ney trigram model of trusted text.

Tokens are byte-level BPE tokens of the given vocabulary: frequent words are one token,
rare and invented ones are spelled out, so no word is unknown.  A word that equals the
word before it becomes one mark, which is predicted like a token but is no context: a
hundredth repetition is as unlikely as the first one.

Documents are dealt into two halves by a hash of their text.  Each half has a model,
trained on its trusted documents, and is judged by the other half's model: no document,
and no exact copy of one, is judged by a model that has seen it, and the thresholds
come from perplexities of the same kind as those they are applied to.

1. Texts become steps of about ``TOGETHER`` bytes of tokens, written once, bucketed by
   step.  Very long texts are several parts, each with the two tokens before it.
2. A step's distinct trigrams (a, b, c) go, with their counts in its trusted texts (0:
   only asked for), packed, to the shard of (b, c): a frequent token is spread over
   shards by its neighbours.  The shard adds up counts, takes the continuation
   counts of its bigrams (b, c), and sends both back for what the other half's steps ask.
3. Sums by context (a, b) meet in the shards of (a, b) and answer what the steps ask
   for.  Sums by token (continuation counts of c, totals of b) are one row a token of the
   vocabulary, and are broadcast.
4. A step meets its answers and gets one probability a distinct trigram:
   P(c|ab) = (c(abc) - D) / c(ab) + weight(ab) * P(c|b), and so on down to a uniform share.
   Documents get log probability, number of tokens and so their perplexity.
5. Few tokens say little, so a document counts as if it had ``PRIOR`` more tokens of the
   trusted documents' mean log probability.  It is kept if this steadied perplexity is
   at most its language's threshold: the ``QUANTILE`` of the trusted documents'
   steadied perplexities in that language (of all trusted documents if the language
   has fewer than ``LEAST``).

A few toxic words in ordinary prose hardly move a text's perplexity.  They are found beside
the model: a word is toxic if a ``SHARE`` of the texts labelled toxic hold it, and
``RATIO`` times as large a share as of the labelled others.  Each row tells how many
different ones it holds; this doesn't change ``keep``.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import GOLDEN, U64, Scratch, batch_of, mix, odd_powers, remove, segment_of, slices, squeezed, summed, table, unsqueezed
from .packing import Encoder, default_vocabulary
from .wordsql import words

QUANTILE, LEAST, PRIOR = 0.998, 60, 40
#: Languages whose thresholds are broadcast; trusted ids that are.
MAX_LANGUAGES, MAX_IDS = 10_000, 1_000_000
#: A toxic word's least share of toxic texts, least number of them, and least ratio of shares.
SHARE, TEXTS, RATIO = 0.1, 5, 20
#: Tokens of a step, about; text bytes for a shard, about.
TOGETHER, SHARD = 3 << 20, 32 << 20
#: Buckets of the steps at most, half of what Spark allows.
MAX_BUCKETS = 50_000

#: A trigram is one integer of three tokens; the last token numbers are marks.
BITS = 21
MASK = U64((1 << BITS) - 1)
START, END, AGAIN = ((1 << BITS) - i for i in (1, 2, 3))


def marked(ids: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The tokens with each word that equals the word before it as one mark; a word begins with white space."""
    if len(ids) < 2:
        return ids
    begin = begins[ids]
    begin[0] = True
    at = np.flatnonzero(begin)
    width = np.diff(np.append(at, len(ids)))
    place = np.arange(len(ids)) - np.repeat(at, width)
    with np.errstate(over="ignore"):
        h = np.add.reduceat(mix(ids.astype(U64) + GOLDEN) * odd_powers(int(width.max()))[place], at)
    again = np.append(False, (h[1:] == h[:-1]) & (width[1:] == width[:-1]))
    if not again.any():
        return ids
    keep = np.repeat(~again, width)
    keep[at] = True
    out = ids.copy()
    out[at[again]] = AGAIN
    return out[keep]


def tokens(encoder: Encoder, text: str):
    """The text's tokens with an end mark, in parts of bounded size."""
    held = np.empty(0, "<u4")
    for part in encoder.parts(text):
        if len(held):
            yield held
        held = marked(np.frombuffer(part, "<u4"), encoder.begins)
    yield np.append(held, END).astype("<u4")


def packed(ids: np.ndarray, small: bool) -> bytes:
    """Token numbers by zstd, after their width and length; ``small``: the vocabulary leaves 16 bits the marks' last ones."""
    raw = ids.astype("<u2" if small else "<u4").tobytes()
    return bytes([2 if small else 4]) + len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=9).compress(raw, asbytes=True)


def unpacked(raw: bytes) -> np.ndarray:
    x = np.frombuffer(pa.decompress(raw[9:], int.from_bytes(raw[1:9], "little"), codec="zstd", asbytes=True), f"<u{raw[0]}").astype(U64)
    return np.where(x >= U64(AGAIN & 0xFFFF), x | U64(AGAIN & ~0xFFFF), x) if raw[0] == 2 else x


ABOUT = {"row": pa.int64(), "doc_id": pa.int64(), "lang": pa.string(), "trusted": pa.bool_(), "toxic_words": pa.int32(), "size": pa.int32()}
HELD = pa.schema([("step", pa.int64()), ("half", pa.int32()), *[(k, pa.list_(v)) for k, v in ABOUT.items()], ("ids", pa.binary())])
HELD_SQL = "step long, half int, row array<long>, doc_id array<long>, lang array<string>, trusted array<boolean>, toxic_words array<int>, size array<int>, ids binary"


def together(vocabulary: str | None, limit: int):
    """Texts' tokens in steps, each of one half; every part has the two tokens before it in front."""

    def run(batches):
        encoder = Encoder(vocabulary or default_vocabulary())
        if len(encoder.begins) > AGAIN:
            raise ValueError(f"a vocabulary of at most {AGAIN} tokens is needed")
        task, n = TaskContext.get().partitionId(), 0
        held = [({k: [] for k in ABOUT}, []) for _ in range(2)]

        def step(half):
            about, ids = held[half]
            held[half] = ({k: [] for k in ABOUT}, [])
            return batch_of(HELD, {"step": [(task << 32) + n], "half": [half], "ids": [packed(np.concatenate(ids), len(encoder.begins) <= AGAIN & 0xFFFF)]} | {k: [v] for k, v in about.items()})

        for batch in slices(batches):
            for row, doc, lang, trusted, toxic, half, text in zip(*(batch.column(k).to_pylist() for k in ("row", "doc_id", "lang", "trusted", "toxic_words", "half", "text")), strict=True):
                before = np.array([START, START], "<u4")
                for part in tokens(encoder, text):
                    about, ids = held[half]
                    ids += [before, part]
                    for k, v in zip(ABOUT, (row, doc, lang, trusted, toxic, len(part) + 2), strict=True):
                        about[k].append(v)
                    before = np.append(before, part[part != AGAIN][-2:])[-2:]
                    if sum(about["size"][-64:]) > limit or len(about["size"]) % 64 == 0 and sum(about["size"]) > limit:
                        yield step(half)
                        n += 1
        for half in range(2):
            if held[half][1]:
                yield step(half)
                n += 1

    return run


def trigrams(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """The trigram that ends at each token, as b, c, a from the highest bits on, and the token's part; marks of repetition are no context."""
    x = unpacked(row["ids"])
    part = np.repeat(np.arange(len(row["size"])), row["size"])
    inside = np.append([False, False], part[2:] == part[:-2])
    word = x != U64(AGAIN)
    before = (np.cumsum(word) - word)[inside]  # words before the token, of which there are two in its part
    y = x[word]
    return (y[before - 1] << U64(2 * BITS)) | (x[inside] << U64(BITS)) | y[before - 2], part[inside]


def distinct(keys: np.ndarray) -> np.ndarray:
    return keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys


def bigrams_of(keys: np.ndarray) -> np.ndarray:
    """The distinct (b, c) of sorted trigrams."""
    return distinct(keys >> U64(BITS))


def contexts_of(keys: np.ndarray) -> np.ndarray:
    """The (a, b) of trigrams."""
    return ((keys & MASK) << U64(BITS)) | (keys >> U64(2 * BITS))


def dealt(pairs: np.ndarray, shards: int, keys: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The order by shard of sorted distinct pairs, or of the sorted trigrams ``keys`` of these pairs, and each shard's first place."""
    shard = segment_of(mix(pairs + GOLDEN), shards)
    if keys is not None:
        shard = shard[np.cumsum(np.append(False, keys[1:] >> U64(BITS) != keys[:-1] >> U64(BITS)))] if len(keys) else shard
    shard = shard.astype(np.uint16 if shards < 1 << 16 else np.int64)
    order = np.argsort(shard, kind="stable")
    return order, np.searchsorted(shard[order], np.arange(shards + 1).astype(shard.dtype) if shards < 1 << 16 else np.arange(shards + 1))


SENT = pa.schema([("kind", pa.int32()), ("half", pa.int32()), ("shard", pa.int32()), ("step", pa.int64()), ("data", pa.list_(pa.binary())), ("sums", pa.list_(pa.int64()))])
SENT_SQL = "kind int, half int, shard int, step long, data array<binary>, sums array<long>"
ASKED, CONTEXT, TOKEN, SUMS = range(4)


def sent(rows: list[tuple]) -> pa.RecordBatch:
    return batch_of(SENT, {f.name: [r[i] for r in rows] for i, f in enumerate(SENT)})


def ask_trigrams(shards: int):
    """Each step's distinct trigrams (as differences) with their counts in trusted texts, by shard of (b, c)."""

    def run(batches):
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(len(batch))):
                keys, part = trigrams(row)
                train = keys[np.array(row["trusted"], bool)[part]]
                keys, (known, n) = distinct(np.sort(keys)), summed(train)
                counts = np.zeros(len(keys), "<u4")
                counts[np.searchsorted(keys, known)] = n
                order, cut = dealt(bigrams_of(keys), shards, keys)
                keys, counts = keys[order], counts[order]
                yield sent([(ASKED, row["half"], s, row["step"], [squeezed(np.diff(keys[a:b], prepend=U64(0))), squeezed(counts[a:b])], None) for s, (a, b) in enumerate(zip(cut, cut[1:], strict=False)) if b > a])

    return run


def ask_contexts(shards: int):
    """Each step's distinct (a, b), by shard."""

    def run(batches):
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(len(batch))):
                pairs = distinct(np.sort(contexts_of(trigrams(row)[0])))
                order, cut = dealt(pairs, shards)
                pairs = pairs[order]
                yield sent([(ASKED, row["half"], s, row["step"], [squeezed(np.diff(pairs[a:b], prepend=U64(0)))], None) for s, (a, b) in enumerate(zip(cut, cut[1:], strict=False)) if b > a])

    return run


def looked_up(keys: np.ndarray, values: list[np.ndarray], asked: np.ndarray) -> list[np.ndarray]:
    """Each asked key's values; 0 for a key that isn't there."""
    if not len(keys):
        return [np.zeros(len(asked), v.dtype) for v in values]
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    hit = keys[at] == asked
    return [np.where(hit, v[at], 0).astype(v.dtype) for v in values]


def classes(pairs: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Sorted distinct pairs with the sum of their counts, and how many are 1, 2, and more."""
    order = np.argsort(pairs, kind="stable")
    pairs, counts = pairs[order], counts[order].astype(np.int64)
    at = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1])) if len(pairs) else np.empty(0, np.int64)
    sums = [np.add.reduceat(x, at) if len(at) else np.empty(0, np.int64) for x in (counts, *(np.asarray(c, np.int64) for c in (counts == 1, counts == 2, counts > 2)))]
    return pairs[at], sums


def of_counts(counts: np.ndarray) -> list[int]:
    """How many counts are 1, 2, 3 and 4."""
    return np.bincount(np.minimum(counts, 5).astype(np.int64), minlength=6)[1:5].tolist()


def owned(shards: int):
    """Answers of a shard of (b, c): trigram and continuation counts; its part of the sums by context and by token."""

    def run(group: pa.Table) -> pa.Table:
        halves, steps_ = group.column("half").to_pylist(), group.column("step").to_pylist()
        shard = group.column("shard")[0].as_py()
        asked, counts = [], []
        for d in group.column("data").to_pylist():
            asked.append(np.cumsum(unsqueezed(d[0], "<u8")))
            counts.append(unsqueezed(d[1], "<u4"))
        out, model = [], []
        for half in range(2):
            own = [(k[n > 0], n[n > 0]) for k, n, h in zip(asked, counts, halves, strict=True) if h == half]
            keys, n = summed(np.concatenate([k for k, _ in own] or [np.empty(0, U64)]), np.concatenate([n for _, n in own] or [np.empty(0, "<u4")]))
            pairs, ways = summed(keys >> U64(BITS))
            model.append((keys, n, pairs, ways))
            context, sums = classes(contexts_of(keys), n)
            order, cut = dealt(context, shards)
            for s, (a, b) in enumerate(zip(cut, cut[1:], strict=False)):
                if b > a:
                    at = order[a:b]
                    out.append((CONTEXT, half, s, None, [squeezed(np.diff(context[at], prepend=U64(0))), *(squeezed(x[at].astype("<u8")) for x in sums)], None))
            first, sums = classes(pairs >> U64(BITS), ways)
            last, many = summed(pairs & MASK)
            names = np.union1d(first, last)
            lines = np.stack([names.astype(np.int64), *looked_up(last, [many], names), *looked_up(first, sums, names)], axis=1)
            out += [(TOKEN, half, None, None, None, line) for line in lines.tolist()]
            out.append((SUMS, half, None, None, None, of_counts(n) + of_counts(ways)))
        for k, half, step in zip(asked, halves, steps_, strict=True):
            keys, n, pairs, ways = model[1 - half]
            (c3,) = looked_up(keys, [n], k)
            (c2,) = looked_up(pairs, [ways], bigrams_of(k))
            out.append((ASKED, half, shard, step, [squeezed(c3.astype("<u8")), squeezed(c2.astype("<u8"))], None))
        return pa.Table.from_batches([sent(out)])

    return run


def summed_contexts(group: pa.Table) -> pa.Table:
    """Answers of a shard of (a, b): total count, and how many trigrams have count 1, 2, and more."""
    rows = group.to_pylist()
    model = []
    for half in range(2):
        parts = [[np.cumsum(unsqueezed(r["data"][0], "<u8")), *(unsqueezed(x, "<u8").astype(np.int64) for x in r["data"][1:])] for r in rows if r["kind"] == CONTEXT and r["half"] == half]
        columns = [np.concatenate(x) for x in zip(*parts, strict=True)] or [np.empty(0, U64), *[np.empty(0, np.int64)] * 4]
        order = np.argsort(columns[0], kind="stable")
        keys = columns[0][order]
        at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
        model.append((keys[at], [np.add.reduceat(x[order], at) if len(at) else x for x in columns[1:]]))
    out = []
    for r in rows:
        if r["kind"] == ASKED:
            got = looked_up(*model[1 - r["half"]], np.cumsum(unsqueezed(r["data"][0], "<u8")))
            out.append((CONTEXT, r["half"], r["shard"], r["step"], [squeezed(x.astype("<u8")) for x in got], None))
    return pa.Table.from_batches([sent(out)])


def discounts(ones: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from how many n-grams have counts 1 to 4."""
    n1, n2, n3, n4 = ones
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    raw = [i - (i + 1) * y * (m / n) if n else i * 0.5 for i, n, m in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return tuple(min(max(d, 0.05), i - 0.05) for i, d in enumerate(raw, 1))


def left(counts: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    """What counts keep after their discount."""
    return counts - np.array([0.0, *d])[np.minimum(counts, 3).astype(np.int64)]


def logs(keys, c3, c2, context, token, own) -> np.ndarray:
    """The log probability of each of the sorted distinct trigrams.

    ``c3``: their counts; ``c2``: continuation counts of their distinct (b, c); ``context``:
    total and numbers of counts 1, 2, more of their distinct (a, b), by value; ``token``: by
    token c1, t2, m1, m2, m3; ``own``: the discounts of the orders 3, 2, 1.
    """
    d3, d2, d1 = own
    names, (c1, t2, *m) = token
    pairs = bigrams_of(keys)
    last, first = looked_up(names, [c1], pairs & MASK)[0], looked_up(names, [t2, *m], pairs >> U64(BITS))
    total = max(int(c1.sum()), 1)
    types = np.count_nonzero(c1) + 1
    rest = sum(d * np.count_nonzero(x) for d, x in zip(d1, (c1 == 1, c1 == 2, c1 > 2), strict=True)) / total if types > 1 else 1.0
    p1 = left(last, d1) / total + rest / types
    with np.errstate(divide="ignore", invalid="ignore"):
        p2 = np.where(first[0] > 0, (left(c2, d2) + sum(d * x for d, x in zip(d2, first[1:], strict=True)) * p1) / first[0], p1)
        lower = p2[np.searchsorted(pairs, keys >> U64(BITS))]
        at = np.searchsorted(distinct(np.sort(contexts_of(keys))), contexts_of(keys))
        total3, *n = (x[at] for x in context)
        return np.log(np.where(total3 > 0, (left(c3, d3) + sum(d * x for d, x in zip(d3, n, strict=True)) * lower) / total3, lower))


SCORED = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("lang", pa.string()), ("trusted", pa.bool_()), ("toxic_words", pa.int32()), ("tokens", pa.int64()), ("logp", pa.float64())])


def score(shards: int, shared):
    """Log probability of a step's parts, from what the shards have sent."""

    def run(held: pa.Table, answers: pa.Table) -> pa.Table:
        row, got = held.to_pylist()[0], sorted(answers.to_pylist(), key=lambda r: r["shard"])
        token, own = shared.value[1 - row["half"]]
        every, part = trigrams(row)
        order = np.argsort(every)
        keys = every[order]
        new = np.append(True, keys[1:] != keys[:-1])
        keys = keys[new]

        def back(kind, i, pairs, asked=None):
            order, _ = dealt(pairs, shards, asked)
            out = np.empty(len(order), np.int64)
            out[order] = np.concatenate([unsqueezed(r["data"][i], "<u8") for r in got if r["kind"] == kind])
            return out

        pairs, around = bigrams_of(keys), distinct(np.sort(contexts_of(keys)))
        p = logs(keys, back(ASKED, 0, pairs, keys), back(ASKED, 1, pairs), [back(CONTEXT, i, around) for i in range(4)], token, own)
        by_place = np.empty(len(every))
        by_place[order] = p[np.cumsum(new) - 1]
        size = np.array(row["size"], np.int64) - 2
        out = {k: row[k] for k in ("row", "doc_id", "lang", "trusted", "toxic_words")} | {"tokens": size, "logp": np.add.reduceat(by_place, np.cumsum(size) - size)}
        return pa.Table.from_batches([batch_of(SCORED, out)])

    return run


def models(sums: DataFrame) -> list[tuple]:
    """Each half's sums by token and discounts; at most one row a token of the vocabulary and half comes to the driver."""
    v = [F.sum(F.col("sums")[i]).alias(f"v{i}") for i in range(8)]
    ones = {r.half: list(r)[1:] for r in sums.filter(f"kind = {SUMS}").groupBy("half").agg(*v).collect()}
    each = sums.filter(f"kind = {TOKEN}").groupBy("half", F.col("sums")[0].alias("token")).agg(*v[1:6]).orderBy("half", "token").toArrow()
    out = []
    for half in range(2):
        at = np.flatnonzero(each.column("half").to_numpy() == half)
        names, *values = (each.column(i).to_numpy()[at].astype(np.int64) for i in range(1, 7))
        n = ones.get(half, [0] * 8)
        out.append(((names.view(U64), values), (discounts(n[:4]), discounts(n[4:]), discounts(of_counts(values[0])))))
    return out


def toxic_words(docs: DataFrame, labels: DataFrame) -> list[str]:
    """The words that mark toxic texts; equal texts count once.

    ``labels`` has doc_id and toxic; a document labelled both ways is toxic, a null label is none.
    At most 1 / ``SHARE`` times a toxic text's mean number of different words come to the driver.
    """
    said = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic is not null")
    said = said.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    toxic, others = (said.filter(f"(toxic > 0) = {x}").select("doc_id") for x in ("true", "false"))
    held = docs.filter("text is not null").select("doc_id", "text", F.xxhash64("text").alias("h"))

    def texts(ids: DataFrame, pick) -> DataFrame:
        few = ids.count() <= MAX_IDS  # else by shuffle
        return held.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi").select("h", pick(F.array_distinct(words(F.col("text")))).alias("w")).dropDuplicates(["h"])

    bad = texts(toxic, lambda w: w)
    n = bad.count()
    often = {r.word: r["count"] for r in bad.select(F.explode("w").alias("word")).groupBy("word").count().filter(F.col("count") >= max(TEXTS, SHARE * n)).collect()}
    if not often:
        return []
    rest = texts(others, lambda w: F.array_intersect(w, F.lit(sorted(often))))
    met = rest.select(F.explode_outer("w").alias("word")).groupBy("word").count()
    all_of = rest.count()
    seen = {r.word: r["count"] for r in met.collect()}
    return sorted(w for w, c in often.items() if c / n >= RATIO * (seen.get(w, 0) + 0.5) / max(all_of, 1))


def perplexities(docs: DataFrame, trusted: DataFrame, vocabulary: str | None, scratch: Scratch, toxic: list[str] | None = None) -> DataFrame:
    """(row, doc_id, lang, trusted, toxic_words, n_tokens, logp), one row a row of ``docs`` (doc_id, text, lang).

    ``toxic_words``: how many different ones of the words ``toxic`` the text holds.
    """
    spark = docs.sparkSession
    good = trusted.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null").distinct().withColumn("trusted", F.lit(True))
    good = scratch.keep(good)
    docs = docs.withColumn("row", F.monotonically_increasing_id()).withColumn("text", F.coalesce("text", F.lit("")))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(16, -(-size // SHARD))
    few = good.count() <= MAX_IDS  # else by shuffle
    docs = docs.join(F.broadcast(good) if few else good, "doc_id", "left").withColumn("trusted", F.coalesce("trusted", F.lit(False))).withColumn("half", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int"))
    docs = docs.withColumn("toxic_words", F.size(F.array_intersect(words(F.col("text")), F.lit(toxic))) if toxic else F.lit(0))
    # bucketed by step, so that meeting the answers doesn't shuffle the tokens again
    name = f"quality_{uuid.uuid4().hex}"
    docs.mapInArrow(together(vocabulary, TOGETHER), HELD_SQL).write.bucketBy(min(shards, MAX_BUCKETS), "step").option("path", f"{scratch.top}/held").option("compression", "none").format("parquet").saveAsTable(name)
    held = spark.table(name)
    owner = scratch.keep(held.mapInArrow(ask_trigrams(shards), SENT_SQL).groupBy("shard").applyInArrow(owned(shards), SENT_SQL), "none")
    shared = spark.sparkContext.broadcast(models(owner))
    around = owner.filter(f"kind = {CONTEXT}").union(held.mapInArrow(ask_contexts(shards), SENT_SQL)).groupBy("shard").applyInArrow(summed_contexts, SENT_SQL)
    answers = owner.filter(f"kind = {ASKED}").union(around)
    scored = held.groupBy("step").cogroup(answers.groupBy("step")).applyInArrow(score(shards, shared), "row long, doc_id long, lang string, trusted boolean, toxic_words int, tokens long, logp double")
    scored = scored.groupBy("row").agg(F.min("doc_id").alias("doc_id"), F.min("lang").alias("lang"), F.max("trusted").alias("trusted"), F.max("toxic_words").alias("toxic_words"), F.sum("tokens").alias("n_tokens"), F.sum("logp").alias("logp"))
    scored = scratch.keep(scored)
    spark.sql(f"DROP TABLE {name}")
    remove(spark, f"{scratch.top}/held")  # an external table's files outlive it
    scratch.only(scored)
    return scored


def classify(docs: DataFrame, trusted: DataFrame, quantile: float = QUANTILE, prior: int = PRIOR, vocabulary: str | None = None, labels: DataFrame | None = None) -> DataFrame:
    """(row, doc_id, lang, n_tokens, perplexity, steadied, threshold, toxic_words, toxic, keep), one row a row of ``docs``.

    ``docs`` has doc_id, text and lang; other columns are ignored.  ``trusted``: doc_ids of
    trusted documents, repeated ones count once.  ``vocabulary``: a file for `tokenizers`.
    ``labels``: doc_id and toxic (0 or 1), from which the toxic words are learned; without
    it, or with too few toxic texts, no row is toxic.  ``toxic`` tells of any toxic word.
    Null and empty texts have the end mark only.  A null lang, or one without enough
    trusted documents, takes the threshold of all trusted documents; a perplexity equal
    to the threshold is kept.  With no trusted document, everything is kept and the
    threshold is null.  Rows that share a doc_id are judged each for itself.  Very long
    texts are counted in parts, which doesn't change the result, but that a word repeated
    over the border of two parts isn't marked as one.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    sums = perplexities(docs, trusted, vocabulary, scratch, toxic_words(docs, labels) if labels is not None else None)
    mean = sums.filter("trusted").agg(F.sum("logp") / F.sum("n_tokens")).first()[0] or 0.0
    # rounded: sums depend on the order of rows in their last bits, and few distinct values keep exact quantiles small
    steady = F.round(F.least(F.exp(-(F.col("logp") + prior * mean) / (F.col("n_tokens") + prior)), F.lit(1e6)), 2)
    scored = sums.withColumn("perplexity", F.exp(-F.col("logp") / F.col("n_tokens"))).withColumn("steadied", steady)
    sure = scored.filter("trusted")
    every = sure.agg(F.percentile("steadied", quantile)).first()[0]
    by = sure.groupBy("lang").agg(F.percentile("steadied", quantile).alias("q"), F.count("*").alias("many")).filter(f"lang is not null and many >= {LEAST}").select("lang", "q")
    by = scratch.keep(by)
    few = by.count() <= MAX_LANGUAGES  # else both sides are shuffled
    out = scored.join(F.broadcast(by) if few else by, "lang", "left")
    out = out.select("row", "doc_id", "lang", "n_tokens", "perplexity", "steadied", F.coalesce("q", F.lit(every).cast("double")).alias("threshold"), "toxic_words", (F.col("toxic_words") > 0).alias("toxic"))
    return out.withColumn("keep", F.coalesce(F.col("steadied") <= F.col("threshold"), F.lit(True)))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Documents labelled as of good quality and not toxic."""
    return labels.filter("quality = 1 and coalesce(toxic, 0) = 0").select("doc_id")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity and verdict of each of ``documents``; cases as in ``classify``."""
    labels = table(spark, sf_dir, "labels")
    return classify(table(spark, sf_dir, "documents"), trusted_ids(labels), labels=labels).drop("row")

"""Multilingual mixture inference for language identification.

Each language is a multinomial over byte trigrams of letters (lower-cased ASCII, all
of UTF-8), hashed into ``BUCKETS`` buckets.  A document is a mixture: each word is
drawn from one language with the document's proportions.  Expectation-maximisation
estimates the proportions from the words' n-gram likelihoods.  The set of languages
grows from the best single one by the next largest proportion as long as the
likelihood, less ``PENALTY / 2 * log(words)`` for each language, gets better.

The model has one row of ``BUCKETS`` floats a language; the number of languages is
checked before it is sent to the workers (``MAX_LANGUAGES``: 64 MB).
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, Scratch, batch_of, held_out, steps, table

BUCKETS = 1 << 15
MAX_LANGUAGES = 512
#: Training uses about this many labelled documents, of each language as many as another or all it has.
SAMPLE = 200_000
ALPHA, PENALTY, ROUNDS = 0.5, 4.0, 6

_FOLD = LOWER.copy()
_FOLD[:128][~np.array([chr(c).isalpha() for c in range(128)])] = 32
LETTER = re.compile(r"[A-Za-zÀ-ÖØ-öø-ɏ]")


def letters(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram bucket of each letter byte (with its neighbours), each word's first letter, each text's first word (and the ends)."""
    text = _FOLD[np.frombuffer(b" " + b" ".join(raw) + b"  ", np.uint8)]
    at = np.flatnonzero(text != 32)
    x = text.astype(np.uint32)
    gram = ((x[at - 1] * np.uint32(0x9E3779B1)) ^ (x[at] * np.uint32(0x85EBCA77)) ^ (x[at + 1] * np.uint32(0xC2B2AE3D))) * np.uint32(0x27D4EB2F)
    gram = (gram >> np.uint32(17)).astype(np.int64) % BUCKETS
    word = np.flatnonzero(np.append(True, np.diff(at) > 1)) if len(at) else at
    ends = 1 + np.cumsum([0] + [len(t) + 1 for t in raw])
    first = np.searchsorted(at[word], ends) if len(at) else np.zeros(len(raw) + 1, np.int64)
    return gram, word, first


COUNTS = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])


def learn(batches):
    held: dict[str, np.ndarray] = {}

    def out():
        for lang, n in held.items():
            at = np.flatnonzero(n)
            yield batch_of(COUNTS, {"lang": [lang] * len(at), "bucket": at.astype(np.int32), "n": n[at]})
        held.clear()

    for batch, raw in steps(batches):
        by: dict[str, list[bytes]] = {}
        for lang, x in zip(batch.column("lang").to_pylist(), raw, strict=True):
            by.setdefault(lang, []).append(x)
        for lang, texts in by.items():
            gram, _, _ = letters(texts)
            n = np.bincount(gram, minlength=BUCKETS)
            held[lang] = held[lang] + n if lang in held else n
        if len(held) > 64:
            yield from out()
    yield from out()


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of rows of values over [first[i], first[i + 1]); zero where that is empty."""
    total = np.concatenate((np.zeros((1, values.shape[1])), np.cumsum(values, axis=0, dtype=np.float64)))
    return total[first[1:]] - total[first[:-1]]


def mixtures(ll: np.ndarray, first: np.ndarray, rounds: int = ROUNDS, penalty: float = PENALTY) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of the selected languages for each text, from each word's log likelihood in each language."""
    texts, langs = len(first) - 1, ll.shape[1]
    n = np.diff(first)
    owner = np.repeat(np.arange(texts), n)
    top = ll.max(axis=1, keepdims=True)
    like = np.exp(ll - top)

    def em(start):
        part = start
        for _ in range(rounds):
            r = like * part[owner]
            r /= r.sum(axis=1, keepdims=True) + 1e-300
            part = sums(r, first) / np.maximum(n, 1)[:, None]
            part /= np.maximum(part.sum(axis=1, keepdims=True), 1e-300)
        value = sums(np.log((like * part[owner]).sum(axis=1, keepdims=True) + 1e-300), first)[:, 0]
        return part, value

    base = sums(ll - top, first)
    best = np.eye(langs)[base.argmax(axis=1)]
    value = base.max(axis=1)
    if langs == 1 or not len(ll):
        return best, n
    every, _ = em(np.full((texts, langs), 1 / langs))
    # the best single language comes first, then the others by proportion
    order = np.argsort(-(every + 2 * best), axis=1, kind="stable")
    growing = n > 1
    for size in range(2, langs + 1):
        if not growing.any():
            break
        mask = np.zeros((texts, langs))
        np.put_along_axis(mask, order[:, :size], 1.0, axis=1)
        start = mask * (every + 0.01)
        part, v = em(start / start.sum(axis=1, keepdims=True))
        better = growing & (v - 0.5 * penalty * np.log(np.maximum(n, 1)) > value)
        best[better] = part[better]
        value = np.where(better, v - 0.5 * penalty * np.log(np.maximum(n, 1)), value)
        growing = better
    return best, n


PREDICTED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("languages", pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))])


def has_letter(text: str) -> bool:
    return bool(LETTER.search(text)) or any(map(str.isalpha, text))


def predict(shared):
    def run(batches):
        langs, model = shared.value
        for batch, raw in steps(batches, limit=1 << 20):
            gram, word, first = letters(raw)
            lettered = [has_letter(x.decode("utf-8", "replace")) for x in raw]
            names, scores, shares = [], [], []
            if langs:
                ll = np.add.reduceat(model[gram], word, axis=0) if len(word) else np.empty((0, len(langs)))
                part, _ = mixtures(ll, first)
            for i, ok in enumerate(lettered):
                if not ok or not langs:
                    names.append("und")
                    scores.append(0.0)
                    shares.append([])
                    continue
                k = int(part[i].argmax())
                names.append(langs[k])
                scores.append(float(min(1.0, part[i][k])))
                shares.append([{"lang": langs[j], "share": float(part[i][j])} for j in np.argsort(-part[i], kind="stable") if part[i][j] > 0])
            yield batch_of(PREDICTED, {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "lang_pred": names, "score": scores, "languages": shares})

    return run


def most_of_each(sizes: list[int], sample: int) -> int:
    """The greatest m so that ``min(size, m)`` summed over the languages is at most ``sample``; 1 at least."""
    left = sample
    for k, n in enumerate(sorted(sizes)):
        if n * (len(sizes) - k) > left:
            return max(1, left // (len(sizes) - k))
        left -= n
    return max(sizes, default=1)


def identify(docs: DataFrame, remainder: int = 0, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, languages), one row a row of ``docs``.

    ``languages``: the selected set with proportions, largest first; ``score`` is the
    largest proportion.  Learns from text and lang where both are given and
    ``crc32(doc_id as text) mod 5`` isn't ``remainder`` (a null doc_id isn't held
    out), on about ``sample`` documents, all of a language's where it has few.  Null text, text without a letter, and
    every text if nothing was learned, is ``und`` with score 0.  Other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "langid")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id"), remainder).alias("held_out"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    train = docs.filter("not held_out and lang is not null and text is not null").select("doc_id", "text", "lang")
    sizes = {r.lang: r.n for r in train.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages in the labels")
    if sum(sizes.values()) > sample:
        most, steps_of = most_of_each(list(sizes.values()), sample), 1_000_000_007
        train = train.withColumn("place", F.pmod(F.xxhash64("doc_id", "text"), F.lit(steps_of)))
        least = {r.lang: r.least for r in train.groupBy("lang").agg(F.min("place").alias("least")).collect()}
        # the least place is always in: no language is left without a document
        upto = spark.createDataFrame([(lang, max(int(steps_of * min(1.0, most / n)), least[lang] + 1)) for lang, n in sizes.items()], "lang string, upto long")
        train = train.join(F.broadcast(upto), "lang").filter("place < upto")
    train = train.select("text", "lang")
    counts = scratch.keep(train.mapInArrow(learn, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    langs = sorted(r.lang for r in counts.select("lang").distinct().collect())
    model = np.full((BUCKETS, max(len(langs), 1)), ALPHA)
    got = counts.toArrow()  # at most MAX_LANGUAGES * BUCKETS rows
    if len(got):
        model[got.column("bucket").to_numpy(), np.searchsorted(langs, got.column("lang").to_pylist())] += got.column("n").to_numpy()
    model = np.log(model / model.sum(axis=0)).astype(np.float32)
    shared = spark.sparkContext.broadcast((langs, model))
    return docs.drop("lang").mapInArrow(predict(shared), "doc_id long, held_out boolean, lang_pred string, score double, languages array<struct<lang:string,share:double>>")


def op3_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents")).drop("languages")

"""Best-two-fit packing of tokenised documents into fixed-length sequences.

Packing looks only at lengths, of which there are at most ``capacity`` (2048): the
plan is made on the histogram of lengths, not on the documents.  It is a list of
patterns, each a multiset of lengths with a number of repeats.  A pattern is filled
greedily with the longest lengths that fit; then its smallest document is replaced
by two unpacked documents that fit the expanded gap more tightly, as long as that
helps.  It repeats until one of its lengths runs out, so there are at most about as
many patterns as lengths, whatever the input's size, and the driver holds only
the histogram and the plan.

Pieces of one length are interchangeable: a piece's rank among the pieces of its
length says which pattern, which repeat and which slot it fills.  Ranks come from
bounded groups (length, bucket) plus running totals over buckets, so a length that
holds a third of all pieces is no single task.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, batch_of, steps, table

CAPACITY, END = 2048, 0
#: Pieces in a rank group, about.
GROUP = 20_000

#: Fixed value: how byte-level BPE splits text before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable Latin-1 ones for themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


#: Characters that are encoded at once; a longer text is cut before a lone space, where byte-level BPE always splits.
TOGETHER = 1 << 20
_LONE = re.compile(r"(?<=\S) (?=\S)")


def parts(text: str, size: int | None = None) -> Iterator[str]:
    size = size or TOGETHER
    at = 0
    while len(text) - at > size and (cut := _LONE.search(text, at + size)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


class Encoder:
    """Token ids of texts as `tokenizers` gives them by the file at ``path``, without special tokens added.

    A byte-level BPE file whose ids are its merges' order gives the same ids by its ranks
    in `tiktoken`, three times as fast; texts that hold the string of a special token, and
    any other file, are left to `tokenizers` itself.  Byte-level BPE encodes a long text in
    parts of bounded size; other kinds of files take a text as a whole.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split, added = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
        vocab, merges = model["vocab"], [m.split(" ", 1) if isinstance(m, str) else m for m in model.get("merges") or []]
        bytewise = model["type"] == "BPE" and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True) and not spec.get("normalizer")
        plain = bytewise and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        self.path, self.slow = path, None
        self.special = [t["content"] for t in added]
        self.cuts = bytewise and not any(t.get("lstrip") or t.get("rstrip") or " " in t["content"] for t in added)
        names = vocab if isinstance(vocab, dict) else {t: i for i, (t, _) in enumerate(vocab)}
        letters = byte_letters()
        white = {c for c, b in letters.items() if b in b" \t\n\r"} | {"\u2581"}
        #: Whether the token of an id begins with white space.
        self.begins = np.zeros(max([*names.values(), *(t["id"] for t in added)], default=0) + 1, bool)
        self.begins[[i for t, i in names.items() if t[:1] in white]] = True
        self.quick = None
        if plain and all(vocab.get(a + b) == 256 + i for i, (a, b) in enumerate(merges)):
            import tiktoken

            ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items() if t not in set(self.special)}
            self.quick = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def exact(self, text: str) -> list[int]:
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path)
        return self.slow.encode(text, add_special_tokens=False).ids

    def parts(self, text: str) -> Iterator[array]:
        """The ids of a text, part by part."""
        run = self.exact if self.quick is None or any(x in text for x in self.special) else self.quick
        for part in parts(text) if self.cuts else [text]:
            yield array("I", run(part))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit bytes."""
        return [b"".join(x.tobytes() for x in self.parts(text)) for text in texts]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])


def cut(vocabulary: str | None, capacity: int, end: int, with_ids: bool):
    """Each document's ids and the end id, cut into pieces of ``capacity``; only the first piece may be shorter."""

    def run(batches):
        encoder = Encoder(vocabulary or default_vocabulary())
        tail = np.array([end], "<u4").tobytes()
        for batch, raw in steps(batches):
            rows = {f.name: [] for f in PIECES}
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode([x.decode("utf-8", "replace") for x in raw]), strict=True):
                ids += tail
                n, start, piece = len(ids) // 4, 0, 0
                while start < n:
                    stop = start + ((n - start) % capacity or capacity)
                    part = ids[4 * start : 4 * stop]
                    for k, v in zip(rows, (doc, piece, start, stop - start, part if with_ids else zlib.crc32(part).to_bytes(4, "big")), strict=True):
                        rows[k].append(v)
                    start, piece = stop, piece + 1
            yield batch_of(PIECES, rows)

    return run


def plan(lengths: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Patterns ({length: how often in one sequence}, number of sequences) that use up the histogram."""
    left = np.zeros(capacity + 1, np.int64)
    for k, v in lengths.items():
        left[k] += v
    out = []
    while True:
        live = np.flatnonzero(left)
        if not len(live):
            return out
        held: dict[int, int] = {}

        def free(length, held=held):
            return left[length] - held.get(length, 0)

        def fit(most, held=held, live=live):
            """The longest unpacked length of at most ``most``."""
            i = int(np.searchsorted(live, most, "right")) - 1
            while i >= 0 and free(int(live[i])) <= 0:
                i -= 1
            return int(live[i]) if i >= 0 else 0

        def put(length, by, held=held):
            held[length] = held.get(length, 0) + by
            if not held[length]:
                del held[length]

        room = capacity
        while room and (length := fit(room)):
            put(length, 1)
            room -= length
        while room:
            small = min(held)
            put(small, -1)
            best = (small, 0, 0)
            for a in live[live <= room + small][::-1]:
                a = int(a)
                if 2 * a < best[0]:
                    break
                if free(a) <= 0:
                    continue
                put(a, 1)
                b = fit(min(room + small - a, a))
                put(a, -1)
                if b and a + b > best[0]:
                    best = (a + b, a, b)
                    if a + b == room + small:
                        break
            if not best[1]:
                put(small, 1)
                break
            put(best[1], 1)
            put(best[2], 1)
            room += small - best[0]
        times = min(int(left[k]) // n for k, n in held.items())
        for k, n in held.items():
            left[k] -= n * times
        out.append((held, times))


def slots(patterns: list[tuple[dict[int, int], int]], capacity: int) -> list[list[np.ndarray]]:
    """By length: first rank of each segment, its first sequence, pieces a sequence, and offset of the first one."""
    by: list[list[list[int]]] = [[] for _ in range(capacity + 1)]
    used, sequence = [0] * (capacity + 1), 0
    for held, times in patterns:
        offset = 0
        for length in sorted(held, reverse=True):
            by[length].append([used[length], sequence, held[length], offset])
            used[length] += held[length] * times
            offset += length * held[length]
        sequence += times
    return [list(np.array(x, np.int64).T) if x else [] for x in by]


def assign(segments: list[list[np.ndarray]]):
    def run(batches):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for x in np.unique(length):
                at = np.flatnonzero(length == x)
                first, seq, many, off = segments[int(x)]
                i = np.searchsorted(first, rank[at], "right") - 1
                nth = rank[at] - first[i]
                sequence[at], offset[at] = seq[i] + nth // many[i], off[i] + nth % many[i] * x
            names = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end: int = END, with_ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids, sequence_id, offset), one row a piece.

    ``ids`` are little-endian unsigned 32-bit ids, or without ``with_ids`` their
    big-endian CRC-32.  Null and empty texts are one piece of the end id.  Rows
    that share a doc_id, or have none, are packed as documents of their own.  Pieces of
    one length are interchangeable: which takes which place follows the order of reading.
    A text that holds a special token's string gets that token's id, as from
    `tokenizers`; very long texts are encoded in parts.  Other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = docs.mapInArrow(cut(vocabulary, capacity, end, with_ids), "doc_id long, piece int, start long, length long, ids binary")
    # a number of its own spreads pieces that share a doc_id or have none
    pieces = scratch.keep(pieces.withColumn("row", F.monotonically_increasing_id()), "lz4")
    buckets = max(64, -(-pieces.count() // GROUP))
    key = F.pmod(F.xxhash64("row"), F.lit(buckets)).alias("bucket")
    counts = pieces.groupBy("length", key).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    counts = scratch.keep(counts.withColumn("before", F.coalesce(before, F.lit(0).cast("long"))))
    # one row a length at most comes to the driver
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    segments = slots(plan(histogram, capacity), capacity)
    within = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("row"))
    ranked = pieces.withColumn("bucket", key).withColumn("within", within).join(counts, ["length", "bucket"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids", (F.col("before") + F.col("within") - 1).alias("rank"))
    return ranked.mapInArrow(assign(segments), "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long")


def digests(packed: DataFrame) -> DataFrame:
    crc = F.conv(F.hex("ids"), 16, 10).cast("long")
    return packed.select("doc_id", "piece", "start", "length", crc.alias("ids_crc32"), "sequence_id", "offset")


def op1_best_two_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, length and checksum of each piece of ``documents``; cases as in ``pack``."""
    return digests(pack(table(spark, sf_dir, "documents"), with_ids=False))

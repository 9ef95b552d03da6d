"""Shared storage, text batches and vectorised hashing for the corpus operators."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step handles; a longer document is a step of its own.
STEP_BYTES = 2 << 20


# --- shared storage -------------------------------------------------------


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; in local mode one of our own where that is unset."""
    place = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not place:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        place = held.get() if held.isDefined() else None
    if not place:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        place = tempfile.mkdtemp(prefix="gridloom-")
        atexit.register(shutil.rmtree, place, True)
        spark.sparkContext.setCheckpointDir(place)
    return place.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Spark's own file system layer; a session that has ended is left alone."""
    with contextlib.suppress(Exception):
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Tables written in the shared folder: they cut lineage and survive the loss of executors.

    ``keep`` writes a table and reads it back, ``drop`` deletes tables that no later
    step reads, ``only`` all but those that the result still reads.  What is left goes
    when the driver's Python ends.
    """

    def __init__(self, spark: SparkSession, name: str, codec: str = "zstd"):
        self.spark, self.codec = spark, codec
        self.top = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.paths: dict[int, str] = {}
        self.held: list[DataFrame] = []
        self.n = 0
        atexit.register(remove, spark, self.top)

    def keep(self, df: DataFrame, codec: str | None = None) -> DataFrame:
        self.n += 1
        path = f"{self.top}/{self.n}"
        df.write.option("compression", codec or self.codec).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        self.held.append(out)  # ids stay unique
        return out

    def only(self, *dfs: DataFrame) -> None:
        for k in [k for k in self.paths if k not in set(map(id, dfs))]:
            remove(self.spark, self.paths.pop(k))

    def drop(self, *dfs: DataFrame | None) -> None:
        for df in dfs:
            if df is not None and (path := self.paths.pop(id(df), None)):
                remove(self.spark, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id, remainder: int):
    """Whether ``crc32`` of the id's decimal text leaves this remainder by 5; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == remainder, F.lit(False))


# --- text batches ---------------------------------------------------------


#: Rows of a batch whose texts are Python objects at once.
ROWS = 256


def slices(batches: Iterable[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def steps(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = STEP_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with their texts as UTF-8 bytes (null: empty), of about ``limit`` bytes each."""
    for batch in slices(batches, max(ROWS, limit // 2048)):
        raw = [x or b"" for x in batch.column(text).cast(pa.binary()).to_pylist()]
        begin = size = 0
        for i, x in enumerate(raw):
            if size and size + len(x) > limit:
                yield batch.slice(begin, i - begin), raw[begin:i]
                begin, size = i, 0
            size += len(x) + 1
        if begin < len(raw):
            yield batch.slice(begin), raw[begin:]


def batch_of(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x, f.type) for f, x in ((f, columns[f.name]) for f in schema)], schema=schema)


# --- hashing --------------------------------------------------------------

U64 = np.uint64
_MUL1, _MUL2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
GOLDEN = U64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixing step (xor-shift-multiply)."""
    x = x ^ (x >> U64(30))
    x = x * _MUL1
    x ^= x >> U64(27)
    x *= _MUL2
    x ^= x >> U64(31)
    return x


def seeds(n: int, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=U64) + U64(salt) * U64(1_000_003)) * GOLDEN)


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: White space that separates words: space, and tab to carriage return.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


#: Bytes that are hashed at once; a longer text is cut at white space.
HASH_BYTES = 8 << 20


class Words:
    """The words of some texts (bytes of A-Z lower-cased, split at white space) as 64-bit hashes.

    ``h``: hash of each word in text order; ``first``: index of each text's first word,
    with one entry more for the end.
    """

    VALUE = seeds(256, 11)

    def __init__(self, raw: list[bytes]):
        if sum(map(len, raw)) <= HASH_BYTES:
            self.h, self.first = self.hashed(raw)
            return
        # a few texts or pieces of one at a time
        parts, counts = [], []
        for x in raw:
            n = at = 0
            while at < len(x):
                end = at + HASH_BYTES // 2
                if end < len(x):
                    cut = next((i for i in range(end, len(x)) if SPACE[x[i]]), len(x))
                    end = cut
                h, _ = self.hashed([x[at:end]])
                parts.append(h)
                n, at = n + len(h), end
            counts.append(n)
        self.h = np.concatenate(parts) if parts else np.empty(0, U64)
        self.first = np.append(0, np.cumsum(counts)).astype(np.int64)

    def hashed(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        text = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
        space = SPACE[text]
        begin = np.empty(len(text), bool)
        begin[0] = not space[0]
        np.logical_and(~space[1:], space[:-1], out=begin[1:])
        at = np.flatnonzero(begin)
        ends = np.cumsum([len(x) + 1 for x in raw])
        first = np.searchsorted(at, np.concatenate(([0], ends)))
        if not len(at):
            return np.empty(0, U64), first
        text, space = text[at[0]:], space[at[0]:]
        at = at - at[0]
        width = np.diff(np.append(at, len(text)))
        place = np.arange(len(text)) - np.repeat(at, width)
        value = self.VALUE[LOWER[text]]
        value[space] = 0
        with np.errstate(over="ignore"):
            value *= odd_powers(int(width.max()))[place]
            return mix(np.add.reduceat(value, at)), first


_POWERS = np.ones(1, U64)


def odd_powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        with np.errstate(over="ignore"):
            _POWERS = np.concatenate(([U64(1)], np.cumprod(np.full(max(n, 256) - 1, 0xD6E8FEB86659FD93, U64))))
    return _POWERS


def shingles(w: Words, width: int) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes; one whole-text shingle for a text of fewer words, none without words."""
    out, h = [], w.h
    with np.errstate(over="ignore"):
        n = len(h) - width + 1
        full = np.zeros(max(n, 0), U64)
        for i in range(width):
            full = full * U64(0xD6E8FEB86659FD93) + h[i : i + n] if n > 0 else full
        full = mix(full)
        for a, b in zip(w.first[:-1], w.first[1:], strict=True):
            if b - a >= width:
                x = np.sort(full[a : b - width + 1])
                out.append(x[np.append(True, x[1:] != x[:-1])])
            elif b > a:
                s = U64(int(b - a))
                for v in h[a:b]:
                    s = s * U64(0xD6E8FEB86659FD93) + v
                out.append(mix(np.array([s])))
            else:
                out.append(np.empty(0, U64))
    return out


# --- packed arrays --------------------------------------------------------


def summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and their summed counts."""
    if not len(keys):
        return keys, np.empty(0, np.int64)
    if counts is None:
        keys = np.sort(keys)
        at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        return keys[at], np.diff(np.append(at, len(keys)))
    order = np.argsort(keys)
    keys = keys[order]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[at], np.add.reduceat(counts[order].astype(np.int64), at)


def segment_of(keys: np.ndarray, segments: int) -> np.ndarray:
    return (((keys >> U64(32)) * U64(segments)) >> U64(32)).astype(np.int64)


def planes(x: np.ndarray) -> bytes:
    """All first bytes, then all second bytes, ...: a codec packs the high ones."""
    return x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def unplaned(raw: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(raw, np.uint8).reshape(size, len(raw) // size).T.copy().view(kind).ravel()


def squeezed(x: np.ndarray) -> bytes:
    """An array's planes by zstd, after their length."""
    raw = planes(x)
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=6).compress(raw, asbytes=True)


def unsqueezed(raw: bytes, kind: str) -> np.ndarray:
    return unplaned(pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), codec="zstd", asbytes=True), kind)

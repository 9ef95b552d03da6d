"""Suffix-array deduplication: bytes covered by a 100-byte string that also starts earlier.

All suffixes of a large corpus can't be compared with each other's shards, so shards are
made by content, in such a way that equal strings always meet:

1. *Anchors.*  Each ``LENGTH``-byte window has an anchor: its least ``GRAM``-byte gram by
   hash, the last one in a tie.  Equal windows have equal anchors at equal offsets.
   Consecutive windows of one anchor form a context, the bytes they cover.
2. Anchors and context hashes go, packed, to the shard of the gram.  A later copy of a
   context is a repeat as a whole.  A gram with one distinct context is done;
   only grams with several contexts (the edges of repeats and edits) need their bytes.
3. *Suffix arrays.*  A shard's contexts are joined in corpus order and sorted by
   Larsson-Sadakane refinement: by 8 bytes first, then groups of equal rank are
   refined to twice the depth, until none is left.  Kasai's pass over text order, in
   parallel lanes, gives common prefixes.  Suffixes that share ``LENGTH`` bytes are one
   class; each window but its first is a repeat.
4. *Merging.*  Contexts of one gram that are too many for one array get several, in
   corpus order; windows of later arrays are looked up in the sorted windows of earlier
   ones by binary search.
5. *Frequent grams.*  A gram that a sample shows to be in over ``HOT`` documents is keyed
   more finely: windows at ``FINE`` neighbouring offsets have all but ``FINE - 1`` bytes in
   common, and these bytes are the key.  If such a key is in over ``HOT`` documents
   too, each window is its own key, and equal windows are counted without an array.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import GOLDEN, U64, Scratch, batch_of, mix, odd_powers, seeds, slices, table

LENGTH, GRAM = 100, 20
#: Window starts in a piece of a document; text bytes for a shard, about; suffixes sorted at once, about.
PIECE, SHARD, SORTED = 1 << 18, 4 << 20, 1 << 20
#: Documents from which on a gram is keyed more finely; documents in the sample that finds such grams; offsets of a finer key.
HOT, SAMPLE, FINE = 20_000, 20_000, 8
#: Frequent grams that are sent to workers at most (32 MB); HOT rises with the input where it would give more.
MAX_KEYS = 4_000_000

VALUE = seeds(256, 31)
_INVERSE = np.ones(1, U64)


def inverse_powers(n: int) -> np.ndarray:
    global _INVERSE
    if len(_INVERSE) < n:
        with np.errstate(over="ignore"):
            _INVERSE = np.concatenate(([U64(1)], np.cumprod(np.full(n - 1, pow(0xD6E8FEB86659FD93, -1, 1 << 64), U64))))
    return _INVERSE


def loads(buf: np.ndarray, kind: str) -> np.ndarray:
    """The integer that starts at each byte."""
    size = np.dtype(kind).itemsize
    return np.ndarray((len(buf) - size + 1,), kind, buf.tobytes(), 0, (1,)).copy()


def among(x: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each value is one of the sorted keys."""
    return keys[np.minimum(np.searchsorted(keys, x), len(keys) - 1)] == x if len(keys) else np.zeros(len(x), bool)


def contexts(pieces: list[bytes], length: int = LENGTH, gram: int = GRAM, hot: tuple[np.ndarray, ...] = ()) -> tuple[np.ndarray, ...]:
    """(piece, first window, windows, gram hash, context hash) of every run of windows with one anchor."""
    whole = b"".join(pieces)
    none = (np.empty(0, np.int64),) * 3 + (np.empty(0, U64),) * 2
    if len(whole) < length:
        return none
    text = np.frombuffer(whole, np.uint8)
    n, width = len(text), length - gram + 1
    with np.errstate(over="ignore"):
        h = np.zeros(n - gram + 1, U64)
        step = loads(text, "<u8") if gram >= 8 else None
        if step is None:
            for i in range(gram):
                h = h * U64(0xD6E8FEB86659FD93) + VALUE[text[i : i + len(h)]]
        else:
            for i in [*range(0, gram - 7, 8), gram - 8]:
                h = (h ^ step[i : i + len(h)]) * U64(0x9E3779B97F4A7C15) + (h >> U64(29))
        h = mix(h)
        low = U64((1 << 23) - 1)
        least = (h & ~low) | (low - np.arange(len(h), dtype=U64))
        span = 1
        while 2 * span <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < width:
            rest = width - span
            least = np.minimum(least[:-rest], least[rest:])
        anchor = (low - (least & low)).astype(np.int64)  # of the window at each start
        ends = np.cumsum([len(x) for x in pieces])
        begins = ends - [len(x) for x in pieces]
        valid = np.zeros(n - length + 1, bool)
        for b, e in zip(begins, ends, strict=True):
            valid[b : max(b, e - length + 1)] = True
        first = valid.copy()
        first[1:] &= (anchor[1:] != anchor[:-1]) | ~valid[:-1]
        first[begins[begins < len(first)]] &= True
        starts = begins[(begins < len(first))]
        first[starts] = valid[starts]
        lo = np.flatnonzero(first)
        if not len(lo):
            return none
        last = np.flatnonzero(valid & np.append((anchor[1:] != anchor[:-1]) | ~valid[1:], True) | np.append(first[1:], True) & valid)
        many = last - lo + 1
        sums = np.concatenate(([U64(0)], np.cumsum(VALUE[text] * odd_powers(n)[:n])))
        inverse = inverse_powers(n + 1)

        def content(start, stop):
            return (sums[stop] - sums[start]) * inverse[start]

        at = anchor[lo]
        fp = mix(h[at] + GOLDEN)
        for keys, width in zip(hot, (FINE, 1), strict=False):
            often = among(fp, keys)
            if not often.any():
                break
            # offsets of the windows from their anchor, cut at multiples of width
            deep = at[often] - lo[often]
            near = deep - many[often] + 1
            parts = deep // width - near // width + 1
            which, part = np.repeat(np.flatnonzero(often), parts), spans(near // width, parts)
            top, low_ = np.minimum(np.repeat(deep, parts), part * width + width - 1), np.maximum(np.repeat(near, parts), part * width)
            common = content(at[which] - part * width, at[which] - (part * width + width - 1) + length)
            finer = mix(fp[which] + mix(common + part.astype(U64) * GOLDEN))
            lo, many, fp, at = (np.concatenate((x[~often], y)) for x, y in ((lo, at[which] - top), (many, top - low_ + 1), (fp, finer), (at, at[which])))
        own = mix(content(lo, lo + many - 1 + length) + mix((at - lo).astype(U64) * U64(512) + many.astype(U64)))
        piece = np.searchsorted(ends, lo, "right")
        return piece, lo - begins[piece], many, fp, own


def pieces_of(raw: list[bytes], length: int = LENGTH):
    """Lists of (text, start, bytes) of bounded size; window starts of a text are split without overlap."""
    out, size = [], 0
    for i, x in enumerate(raw):
        for at in range(0, len(x) - length + 1, PIECE):
            part = x[at : at + PIECE + length - 1]
            if size and size + len(part) > 2 * PIECE:
                yield out
                out, size = [], 0
            out.append((i, at, part))
            size += len(part)
    if out:
        yield out


def documents(batches):
    """Batches' rows as (did, sha, text) lists of bounded size."""
    for batch in slices(batches):
        did, sha = batch.column("did").to_numpy(), batch.column("sha").to_numpy()
        raw = [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]
        at = size = 0
        for i, x in enumerate(raw):
            size += len(x)
            if size > 2 * PIECE or i == len(raw) - 1:
                yield did[at : i + 1], sha[at : i + 1], raw[at : i + 1]
                at, size = i + 1, 0


SEEN = pa.schema([("fp", pa.int64()), ("n", pa.int64())])


def gram_counts(length: int, gram: int, shared):
    def run(batches):
        hot = shared.value
        for _, _, raw in documents(batches):
            for part in pieces_of(raw, length):
                piece, _, _, fp, _ = contexts([x for _, _, x in part], length, gram, hot)
                order = np.lexsort((piece, fp))
                piece, fp = piece[order], fp[order]
                new = np.append(True, (fp[1:] != fp[:-1]) | (piece[1:] != piece[:-1]))[: len(fp)]
                keys, n = np.unique(fp[new], return_counts=True)
                yield batch_of(SEEN, {"fp": keys.view(np.int64), "n": n})

    return run


#: ``done``: windows that are known to repeat an earlier place of their own document.
FIELDS = {"fp": "<u8", "own": "<u8", "did": "<i8", "sha": "<i8", "lo": "<i4", "many": "<i4", "done": "|u1"}
PACKED = pa.schema([("shard", pa.int32()), *[(k, pa.binary()) for k in FIELDS], ("text", pa.binary())])
PACKED_SQL = "shard int, fp binary, own binary, did binary, sha binary, lo binary, many binary, done binary, text binary"


def settled(doc: np.ndarray, lo: np.ndarray, many: np.ndarray, fp: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, ...]:
    """The contexts with those that a document has had before joined to runs, and which ones these are.

    A stretch of a short period has a context a period; it becomes one run.
    """
    order = np.lexsort((lo, own, fp, doc))
    again = np.zeros(len(lo), bool)
    again[order[1:]] = (doc[order[1:]] == doc[order[:-1]]) & (fp[order[1:]] == fp[order[:-1]]) & (own[order[1:]] == own[order[:-1]])
    order = np.lexsort((lo, doc))
    doc, lo, many, fp, own, again = (x[order] for x in (doc, lo, many, fp, own, again))
    on = np.append(False, again[1:] & again[:-1] & (doc[1:] == doc[:-1]) & (lo[1:] == lo[:-1] + many[:-1]))
    at = np.flatnonzero(~on)
    many = np.add.reduceat(many, at) if len(at) else many
    return doc[at], lo[at], many, fp[at], own[at], again[at]


def packed(shards: int, rows: dict[str, np.ndarray], texts: list[bytes] | None = None) -> pa.RecordBatch:
    """Rows grouped by shard, each group's columns as binaries."""
    shard = (((rows["fp"] >> U64(32)) * U64(shards)) >> U64(32)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    cut = np.flatnonzero(np.diff(shard[order], prepend=-1))
    out = {f.name: [] for f in PACKED}
    for a, b in zip(cut, [*cut[1:], len(order)], strict=True):
        at = order[a:b]
        out["shard"].append(int(shard[at[0]]))
        for k, kind in FIELDS.items():
            out[k].append(rows[k][at].astype(kind).tobytes())
        out["text"].append(None if texts is None else b"".join(texts[i] for i in at))
    return batch_of(PACKED, out)


def unpacked(group: pa.Table) -> dict[str, np.ndarray]:
    return {k: np.frombuffer(b"".join(group.column(k).to_pylist()), kind) for k, kind in FIELDS.items()}


#: Contexts that are packed together, so that a shard's part is more than a few.
TOGETHER = 200_000


def spread(shards: int, shared, length: int, gram: int):
    def run(batches):
        hot = shared.value
        held: list[dict[str, np.ndarray]] = []
        n = 0
        for did, sha, raw in documents(batches):
            for part in pieces_of(raw, length):
                piece, lo, many, fp, own = contexts([x for _, _, x in part], length, gram, hot)
                doc, base = np.array([i for i, _, _ in part]), np.array([at for _, at, _ in part])
                mine, lo, many, fp, own, done = settled(doc[piece], lo + base[piece], many, fp, own)
                rows = {"fp": fp, "own": own, "did": did[mine], "sha": sha[mine], "lo": lo, "many": many, "done": done}
                held.append({k: v.astype(FIELDS[k]) for k, v in rows.items()})
                n += len(fp)
                if n > TOGETHER:
                    yield packed(shards, {k: np.concatenate([h[k] for h in held]) for k in FIELDS})
                    held, n = [], 0
        if held:
            yield packed(shards, {k: np.concatenate([h[k] for h in held]) for k in FIELDS})

    return run


RANGES = pa.schema([("ask", pa.bool_()), ("did", pa.int64()), ("sha", pa.int64()), ("lo", pa.int32()), ("many", pa.int32()), ("fp", pa.int64()), ("own", pa.int64())])
RANGES_SQL = "ask boolean, did long, sha long, lo int, many int, fp long, own long"


def ranges(rows: dict[str, np.ndarray], at: np.ndarray, ask: bool = False) -> pa.Table:
    """Windows that repeat, or with ``ask`` contexts whose bytes are needed."""
    return pa.Table.from_arrays([pa.array(np.full(len(at), ask))] + [pa.array(rows[k][at].view(np.int64) if k in ("fp", "own") else rows[k][at], RANGES.field(k).type) for k in RANGES.names[1:]], schema=RANGES)


def distinct(r: dict[str, np.ndarray], order: np.ndarray, names: tuple[str, ...]) -> np.ndarray:
    """Whether each of the ordered rows differs from the one before in one of the columns."""
    out = np.zeros(len(order), bool)
    out[:1] = True
    for k in names:
        out[1:] |= r[k][order[1:]] != r[k][order[:-1]]
    return out


def copies(group: pa.Table) -> pa.Table:
    """Later copies of a context repeat; the first ones of grams with several contexts need their bytes.

    Equal rows send the same contexts of the same document; they are no copies of each other.
    """
    r = unpacked(group)
    done = np.flatnonzero(r["done"])
    order = np.flatnonzero(r["done"] == 0)
    order = order[np.lexsort([r[k][order] for k in ("lo", "sha", "did", "own", "fp")])]
    order = order[distinct(r, order, ("lo", "sha", "did", "own", "fp"))]
    fp, own = r["fp"][order], r["own"][order]
    new_fp = np.append(True, fp[1:] != fp[:-1])[: len(fp)]
    first = new_fp | np.append(True, own[1:] != own[:-1])[: len(fp)]
    del fp, own
    gram = np.cumsum(new_fp) - 1
    several = (np.bincount(gram, first) > 1)[gram]
    return pa.concat_tables([ranges(r, done), ranges(r, order[~first]), ranges(r, order[first & several], ask=True)])


def cut_out(shards: int, length: int):
    """The asked contexts' bytes, packed by shard."""

    def run(batches):
        held = {k: [] for k in FIELDS}
        texts, size, before = [], 0, None
        for batch in slices(batches):
            for did, sha, text, asked in zip(batch.column("did").to_pylist(), batch.column("sha").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), batch.column("asked").to_pylist(), strict=True):
                if (did, sha) == before:  # equal rows mostly come one after the other; repeats() sorts out the rest
                    continue
                before = did, sha
                for a in asked:
                    for k in FIELDS:
                        held[k].append(did if k == "did" else sha if k == "sha" else 0 if k == "done" else a[k])
                    texts.append(text[a["lo"] : a["lo"] + a["many"] - 1 + length])
                    size += len(texts[-1])
                if size > SHARD:
                    yield packed(shards, arrays(held), texts)
                    held, texts, size = {k: [] for k in FIELDS}, [], 0
        if texts:
            yield packed(shards, arrays(held), texts)

    return run


def arrays(held: dict[str, list]) -> dict[str, np.ndarray]:
    return {k: np.array(v, np.int64).astype(kind) if k not in ("fp", "own") else np.array(v, np.int64).view(U64) for (k, v), kind in zip(held.items(), FIELDS.values(), strict=True)}


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of the suffixes, by Larsson-Sadakane refinement of groups with equal first bytes."""
    n = len(text)
    padded = np.concatenate((text, np.zeros(8, np.uint8)))
    value = loads(padded, ">u8")[:n].astype(U64)
    order = np.argsort(value)
    sorted_value = value[order]
    head = np.append(True, sorted_value[1:] != sorted_value[:-1])
    rank = np.empty(n + 1, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(1, n + 1), 0))
    rank[n] = 0
    done = 8
    while done < n:
        lone = head & np.append(head[1:], True)
        at = np.flatnonzero(~lone)  # places in the array whose groups are still to be refined
        if not len(at):
            break
        sub = order[at]
        key = (rank[sub] << 32) | rank[np.minimum(sub + done, n)]
        by = np.argsort(key)
        order[at], key = sub[by], key[by]
        head[at] = np.append(True, key[1:] != key[:-1])
        rank[order[at]] = np.maximum.accumulate(np.where(head[at], at + 1, 0))
        done *= 2
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int = LENGTH, lanes: int = 64) -> np.ndarray:
    """Common prefix (up to ``most``) of each suffix in the array with the one before it.

    Kasai's pass: in text order, a suffix shares at least one byte less than its
    predecessor did.  The text is cut into lanes that run side by side.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    words = loads(np.concatenate((text, np.zeros(most + 16, np.uint8))), "<u8")
    out = np.zeros(n, np.int32)
    shared = np.zeros(-(-n // lanes), np.int64)
    for step in range(lanes):
        at = np.arange(step, n, lanes)
        shared = np.maximum(shared[: len(at)] - 1, 0)
        other = before[at]
        shared[other < 0] = 0
        live = np.flatnonzero((other >= 0) & (shared < most))
        while len(live):
            i, j, s = at[live], other[live], shared[live]
            diff = words[i + s] ^ words[j + s]
            same = np.full(len(live), 8)
            odd = diff != 0
            low = diff[odd] & (~diff[odd] + U64(1))
            same[odd] = np.frexp(low.astype(np.float64))[1] - 1 >> 3
            s = np.minimum(np.minimum(s + same, most), n - np.maximum(i, j))
            shared[live] = s
            live = live[~odd & (s < most) & (s < n - np.maximum(i, j))]
        out[at] = shared
    return out[order]


def window_hash(text: np.ndarray, at: np.ndarray, length: int, salt: int) -> np.ndarray:
    words = loads(np.concatenate((text, np.zeros(8, np.uint8))), "<u8")
    h = np.full(len(at), salt, U64)
    with np.errstate(over="ignore"):
        for i in [*range(0, length - 7, 8), max(length - 8, 0)]:
            h = mix(h * U64(0xD6E8FEB86659FD93) + words[at + i])
    return h


def repeats(length: int):
    def run(group: pa.Table) -> pa.Table:
        r = unpacked(group)
        size = r["many"].astype(np.int64) - 1 + length
        begin = np.cumsum(size) - size
        text = np.frombuffer(b"".join(group.column("text").to_pylist()), np.uint8)
        out = [RANGES.empty_table()]
        order = np.lexsort((r["lo"], r["sha"], r["did"], r["fp"]))
        order = order[distinct(r, order, ("lo", "sha", "did", "fp"))]
        new = np.append(True, r["fp"][order][1:] != r["fp"][order][:-1])
        upto = np.cumsum(size[order])
        edges = np.append(np.flatnonzero(new), len(order))
        a = 0
        while a < len(edges) - 1:  # whole grams, about SORTED bytes in one array
            start = edges[a]
            base = upto[start] - size[order[start]]
            b = max(a + 1, int(np.searchsorted(upto[edges[1:] - 1], base + SORTED, "right")))
            at = order[start : edges[b]]
            if upto[edges[b] - 1] - base <= SORTED:
                out.append(one_array(r, in_order(r, at), begin, size, text, length))
            else:
                out += merged(r, in_order(r, at), begin, size, text, length)
            a = b
        return pa.concat_tables(out)

    return run


def in_order(r, at: np.ndarray) -> np.ndarray:
    return at[np.lexsort((r["lo"][at], r["sha"][at], r["did"][at]))]


def spans(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All of first[i], ..., first[i] + sizes[i] - 1."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - sizes), sizes)


def late_windows(joined: np.ndarray, window: np.ndarray, length: int) -> np.ndarray:
    """Whether an equal window starts before, by the suffix array of the joined contexts."""
    order = suffix_array(joined)
    same = common_prefixes(joined, order, length) >= length
    is_window = np.zeros(len(joined), bool)
    is_window[window] = True
    kind = np.cumsum(~same) - 1
    keep = is_window[order]
    kind, where = kind[keep], order[keep]
    least = np.full(kind[-1] + 1 if len(kind) else 0, len(joined), np.int64)
    np.minimum.at(least, kind, where)
    late = np.zeros(len(joined), bool)
    late[where[where != least[kind]]] = True
    return late[window]


def one_array(r, at, begin, size, text, length, earlier: list | None = None) -> pa.Table:
    """Runs of repeating windows of the contexts ``at``; ``earlier`` are sorted windows of the arrays before."""
    joined = text[spans(begin[at], size[at])]
    starts = np.cumsum(size[at]) - size[at]
    many = r["many"][at].astype(np.int64)
    window = spans(starts, many)
    owner = np.repeat(np.arange(len(at)), many)
    late = late_windows(joined, window, length)
    if earlier is not None:
        h1, h2 = (window_hash(joined, window, length, s) for s in (1, 2))
        for sorted1, sorted2 in earlier:
            i = np.minimum(np.searchsorted(sorted1, h1), len(sorted1) - 1)
            late |= (sorted1[i] == h1) & (sorted2[i] == h2)
        new = np.flatnonzero(~late)
        by = new[np.argsort(h1[new])]
        if len(by):
            earlier.append((h1[by], h2[by]))
    lo = r["lo"][at].astype(np.int64)[owner] + window - starts[owner]
    together = owner[1:] == owner[:-1]
    i = np.flatnonzero(late & ~np.append(False, late[:-1] & together))
    j = np.flatnonzero(late & ~np.append(late[1:] & together, False))
    runs = {k: r[k][at][owner[i]] for k in FIELDS} | {"lo": lo[i].astype(np.int32), "many": (j - i + 1).astype(np.int32)}
    return ranges(runs, np.arange(len(i)))


def merged(r, at, begin, size, text, length) -> list[pa.Table]:
    """Several arrays of about SORTED bytes, in corpus order, merged by binary search."""
    part = (np.cumsum(size[at]) - 1) // SORTED
    cuts = np.flatnonzero(np.diff(part, prepend=-1))
    earlier: list = []
    return [one_array(r, at[a:b], begin, size, text, length, earlier) for a, b in zip(cuts, [*cuts[1:], len(at)], strict=True)]


CLEANED = {"doc_id": "long", "n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept_sha256": "string", "kept": "string"}


def remove(length: int, with_text: bool, carry: str | None):
    def run(batches):
        for batch in slices(batches):
            out = {k: [] for k in CLEANED}
            for doc, text, cut in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), batch.column("cut").to_pylist(), strict=True):
                text = text or b""
                parts, at, removed, n = [], 0, 0, 0
                until = -1
                for c in sorted(cut or [], key=lambda c: c["lo"]):
                    a, b = c["lo"], c["lo"] + c["many"] - 1 + length
                    if a > until:  # touching ranges are one run
                        parts.append(text[at:a])
                        removed, n, at, until = removed + b - a, n + 1, b, b
                    elif b > until:
                        removed, at, until = removed + b - until, b, b
                parts.append(text[at:])
                left = b"".join(parts)
                for k, v in zip(out, (doc, len(text), removed, n, hashlib.sha256(left).hexdigest(), left.decode("utf-8", "ignore") if with_text else None), strict=True):
                    out[k].append(v)
            columns = [pa.array(v, pa.string() if k.startswith("kept") else pa.int64()) for k, v in out.items()]
            names = list(out)
            if carry:
                columns, names = [*columns, batch.column(carry)], [*names, carry]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def dedup_substrings(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, with_text: bool = True, carry: str | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept), one row a row of ``docs``.

    ``kept`` is the text left (``with_text``), without the bytes of characters that a cut
    splits.  The column named by ``carry`` comes along; others are ignored.

    Null and empty texts have no bytes.  Earlier means a smaller doc_id, or an earlier
    start in the document; a null doc_id is smaller than all.  Rows that share a doc_id
    are ordered by a hash of their text; equal ones are one document and get the same
    result.  Texts shorter than ``length`` lose nothing.
    """
    if not 8 <= gram <= length or length < 16:
        raise ValueError("gram: at least 8 and at most length; length: at least 16")
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffix")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)).cast("long")).alias("did"), F.xxhash64(text).alias("sha"), text.alias("text"), *([carry] if carry else []))
    long = rows.filter(F.octet_length("text") >= length)
    size, n = long.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    shards = max(16, -(-(size or 0) // SHARD))
    part = min(1.0, max(SAMPLE / max(n, 1), 0.001))
    sampled = long.filter(F.pmod(F.xxhash64("did", F.lit(3)), F.lit(1_000_000)) < int(part * 1_000_000))
    hot = max(hot, (size or 0) // MAX_KEYS)  # a context has one byte of its own at least
    keys: tuple[np.ndarray, ...] = ()
    shared = spark.sparkContext.broadcast(keys)
    for _ in range(2):
        often = sampled.mapInArrow(gram_counts(length, gram, shared), "fp long, n long").groupBy("fp").agg(F.sum("n").alias("n")).filter(F.col("n") >= max(2, hot * part))
        more = often.select("fp").toArrow().column("fp").to_numpy().view(U64)  # at most MAX_KEYS
        if not len(more):
            break
        keys = (*keys, np.sort(more))
        shared = spark.sparkContext.broadcast(keys)
    first = scratch.keep(long.select("did", "sha", "text").mapInArrow(spread(shards, shared, length, gram), PACKED_SQL).groupBy("shard").applyInArrow(copies, RANGES_SQL))
    asked = first.filter("ask").groupBy("did", "sha").agg(F.collect_list(F.struct("lo", "many", "fp", "own")).alias("asked"))
    need = asked.join(long.select("did", "sha", "text"), ["did", "sha"])
    second = scratch.keep(need.mapInArrow(cut_out(shards, length), PACKED_SQL).groupBy("shard").applyInArrow(repeats(length), RANGES_SQL))
    every = first.filter("not ask").union(second).select("did", "sha", "lo", "many")
    cut = scratch.keep(every.groupBy("did", "sha").agg(F.collect_list(F.struct("lo", "many")).alias("cut")))
    scratch.only(cut)
    out = rows.join(cut, ["did", "sha"], "left")
    schema = ", ".join(f"{k} {v}" for k, v in CLEANED.items())
    if carry:
        schema += f", `{carry}` {docs.schema[carry].dataType.simpleString()}"
    return out.select("doc_id", "text", "cut", *([carry] if carry else [])).mapInArrow(remove(length, with_text, carry), schema)


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of ``documents`` loses; cases as in ``dedup_substrings``."""
    return dedup_substrings(table(spark, sf_dir, "documents"), with_text=False).drop("kept")

"""Plain Python versions of the operators' results."""

import hashlib
import re
import zlib
from collections import Counter
from math import log10

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def near(docs, width=5, percent=75):
    sets = {}
    for i, t in docs:
        w = WORD.findall(low(t))
        sets[i] = frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                n = len(sets[a] & sets[b])
                if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def repeated(docs, length=100):
    """docs: (doc_id, text) with distinct ids."""
    seen, out = set(), {}
    for i, t in sorted(docs):
        b = (t or "").encode()
        covered = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if b[s : s + length] in seen:
                covered[s : s + length] = b"\1" * length
            seen.add(b[s : s + length])
        kept = bytes(x for x, c in zip(b, covered, strict=True) if not c)
        runs = sum(1 for k, c in enumerate(covered) if c and (k == 0 or not covered[k - 1]))
        out[i] = (len(b), sum(covered), runs, hashlib.sha256(kept).hexdigest())
    return out


def contaminated(docs, items, size=10):
    wins = {}
    for i, t in items:
        w = ALNUM.findall(low(t))
        n = min(size, len(w))
        for k in range(len(w) - n + 1) if n else ():
            wins.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = {}
    for i, t in docs:
        w = ALNUM.findall(low(t))
        hit, ids = set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                found = wins.get(tuple(w[k : k + n]))
                if found:
                    hit.update(range(k, k + n))
                    ids |= found
        out[i] = (len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit))
    return out


def base_scores(docs, remainder=1):
    tokens = {i: [*WORD.findall(low(t)), None] for i, t in docs}
    held = {i: zlib.crc32(str(i).encode()) % 5 == remainder for i in tokens}
    c = Counter(t for i, ts in tokens.items() if not held[i] for t in ts)
    total, kinds = sum(c.values()), len(c)
    return {i: (held[i], len(ts), sum(t in c for t in ts), total, sum(log10((c[t] + 0.5) / (total + 0.5 * (kinds + 1))) for t in ts)) for i, ts in tokens.items()}


def scores(docs, quantised, mu, remainder=1):
    tokens = {i: [*WORD.findall(low(t)), None] for i, t in docs}
    train = [ts for i, ts in tokens.items() if zlib.crc32(str(i).encode()) % 5 != remainder]
    one = Counter(t for ts in train for t in ts)
    two = Counter(p for ts in train for p in zip([None, *ts], ts))  # noqa: B905
    zero = sum(one.values()) + 0.5 * (len(one) + 1)

    def p(v, w):
        n = quantised(one[v])
        return (min(quantised(two[v, w]), n) + mu * (quantised(one[w]) + 0.5) / zero) / (n + mu)

    return {i: sum(log10(p(v, w)) for v, w in zip([None, *ts], ts)) for i, ts in tokens.items()}  # noqa: B905


def kneser_ney(docs, again):
    """docs: (key, half, tokens with an end mark, trusted); log probability of each by the other half's model."""
    from math import log

    def trigrams(t):
        words = [-1, -1]
        for x in t:
            yield words[-2], words[-1], x
            if x != again:
                words.append(x)

    def discount(counts):
        n = [sum(c == i for c in counts) for i in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
        raw = [i - (i + 1) * y * n[i + 1] / n[i] if n[i] else i * 0.5 for i in (1, 2, 3)]
        d = [0, *(min(max(r, 0.05), i - 0.05) for i, r in enumerate(raw, 1))]
        return lambda c: d[min(c, 3)]

    models = []
    for half in (0, 1):
        c3 = Counter(g for _, h, t, good in docs if h == half and good for g in trigrams(t))
        c2 = Counter((b, c) for _, b, c in c3)
        c1 = Counter(c for _, c in c2)
        d3, d2, d1 = (discount(list(x.values())) for x in (c3, c2, c1))
        after3, after2 = {}, {}
        for (a, b, _), n in c3.items():
            after3.setdefault((a, b), []).append(n)
        for (b, _), n in c2.items():
            after2.setdefault(b, []).append(n)
        models.append((c3, c2, c1, d3, d2, d1, after3, after2))
    out = {}
    for key, h, t, _ in docs:
        c3, c2, c1, d3, d2, d1, after3, after2 = models[1 - h]
        total, types = max(sum(c1.values()), 1), len(c1) + 1
        rest = sum(map(d1, c1.values())) / total if c1 else 1.0
        s = 0.0
        for a, b, c in trigrams(t):
            p = (c1[c] - d1(c1[c])) / total + rest / types
            if b in after2:
                p = (c2[b, c] - d2(c2[b, c]) + sum(map(d2, after2[b])) * p) / sum(after2[b])
            if (a, b) in after3:
                p = (c3[a, b, c] - d3(c3[a, b, c]) + sum(map(d3, after3[a, b])) * p) / sum(after3[a, b])
            s += log(p)
        out[key] = s
    return out

"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

from panelkit.llm.katz import DELTA, K, Discounts


def katz(rows: list[tuple], mod: int = 5) -> dict:
    """doc_id -> (n_tokens, n_known, train_tokens, base, score) from (doc_id, text); also the model's P(w | v)."""
    def tokens(text):
        raw = (text or "").encode()
        return [*raw.lower().split(), None]

    train = [tokens(t) for i, t in rows if zlib.crc32(str("" if i is None else i).encode()) % mod != 1]
    uni = Counter(w for t in train for w in t)
    bi, context = Counter(), Counter()
    for t in train:
        for v, w in zip(["<", *t], t):
            bi[v, w] += 1
            context[v] += 1
    n = sum(uni.values())

    def discount(counts):
        of = Counter(counts.values())
        d = Discounts.good_turing([of[r] for r in range(1, K + 2)]).small
        return lambda c: d[c] if c <= K else 1 - DELTA / c

    du, db = discount(uni), discount(bi)
    lost = sum((1 - du(c)) * c for c in uni.values())

    def p1(w):
        if not n:
            return 1.0
        return du(uni[w]) * uni[w] / n if uni[w] else lost / n

    seen = defaultdict(list)
    for (v, w), c in bi.items():
        seen[v].append((w, c))

    def p2(v, w):
        if bi[v, w]:
            return db(bi[v, w]) * bi[v, w] / context[v]
        if not context[v]:
            return p1(w)
        left = sum((1 - db(c)) * c for _, c in seen[v]) / context[v]
        return left / (1 - sum(p1(x) for x, _ in seen[v])) * p1(w)

    out = {}
    for i, text in rows:
        t = tokens(text)
        base = sum(math.log10((uni[w] + 0.5) / (n + 0.5 * (len(uni) + 1))) for w in t)
        out[i] = (len(t), sum(uni[w] > 0 for w in t), n, base, sum(math.log10(p2(v, w)) for v, w in zip(["<", *t], t)))
    return out, p2, uni, context


def xx_fingerprint(text) -> int:
    """SimHash by the definition, bit by bit."""
    import xxhash

    words = [w for w in __import__("re").findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())]
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints: dict, tau: int = 3) -> dict:
    """id -> smallest id reachable, from id -> fingerprint."""
    ids = sorted(prints)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            if (prints[a] ^ prints[b]).bit_count() <= tau:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def mix(rows: list[tuple], weights=(1, 2, 3), repeats: int = 3) -> list[tuple]:
    """(doc_id, times, size, source_size, target) per row from (doc_id, text, source), by resharing step by step."""
    import hashlib
    import re

    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    sized = [(i, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), md5(f"{'' if i is None else i}|{md5(t or '')}")) for i, t, s in rows]
    sources = sorted({s for _, s, _, _ in sized}, key=lambda s: (s is None, s or ""))
    size = {s: sum(n for _, x, n, _ in sized if x == s) for s in sources}
    weight = {s: weights[k % len(weights)] for k, s in enumerate(sources)}
    target, full = {}, set()
    while True:
        left = sum(size.values()) - sum(repeats * size[s] for s in full)
        ws = sum(weight[s] for s in sources if s not in full)
        target = {s: repeats * size[s] if s in full else weight[s] * left / ws for s in sources}
        over = {s for s in sources if s not in full and target[s] > repeats * size[s]}
        if not over:
            break
        full |= over
    out = []
    for s in sources:
        at = 0
        for i, _, n, o in sorted((r for r in sized if r[1] == s), key=lambda r: (r[3], r[0] is not None, r[0] or 0)):
            times = sum(at + n / 2 + k * size[s] <= target[s] and target[s] > 0 for k in range(repeats))
            out.append((i, times, n, size[s], target[s]))
            at += n
    return out

"""Plain versions of the operators' contracts, for small tables."""

import hashlib
import math
import re
import unicodedata
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import xxhash


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def decontamination(rows, items):
    find = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
    windows = defaultdict(set)
    for name, text in items:
        w = find(lower(text))
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i : i + n])].add(str(name))
    out = {}
    for doc, text, *_ in rows:
        w, found = find(lower(text)), set()
        hit = [0] * len(w)
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if ids := windows.get(tuple(w[i : i + n])):
                    found |= ids
                    hit[i : i + n] = [1] * n
        k = sum(hit)
        out[doc] = (len(w), k, len(found), sha(",".join(sorted(found))), k > 0 and 20 * k >= len(w))
    return out


def near_duplicates(rows, words=2):
    sets = {}
    for doc, text, *_ in rows:
        w = lower(text).encode().split()
        sets[doc] = {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (len(s), find(k), find(k) == k) for k, s in sets.items()}


def passages(rows, window=13):
    first, words = {}, {}
    for doc, text, *_ in sorted(rows, key=lambda r: r[0]):
        w = words[doc] = (text or "").encode().split()
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), doc)
    out = {}
    for doc, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < doc:
                gone[i : i + window] = [True] * window
        out[doc] = (len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone) if not g)))
    return out


def fingerprints(rows):
    def canon(t):
        t = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold())
        return re.sub(r"\s+", " ", t).strip(" ").encode()

    def print_of(t):
        seeds = (xxhash.xxh64_intdigest(s.to_bytes(4, "little"), seed=42) for s in (0, 1))
        return "".join(f"{xxhash.xxh64_intdigest(canon(t), seed=s):016x}" for s in seeds)

    texts = {r[0]: r[1] or "" for r in rows}
    ids = sorted(texts, reverse=True)
    prints = {k: print_of(t) for k, t in texts.items()}
    groups = {}
    for k in sorted(texts):
        groups.setdefault(canon(texts[k]), k)
    out = {}
    for k, doc in enumerate(ids):
        t, after = texts[doc], ids[(k + 1) % len(ids)]
        half = len(t) // 2
        edited = t[: len(t) - half] + texts[after][:half]
        out[doc] = (len(t), sha(edited), prints[doc], print_of(edited), float(prints[doc] == print_of(edited)), float(prints[doc] == prints[after]), groups[canon(t)])
    return out


def katz(rows, order=3, k_most=5, cutoff=1):
    texts = [(doc, lower(t).encode().split() + ["END"]) for doc, t, *_ in rows]
    held = lambda d: zlib.crc32(str(d).encode()) % 5 == 1
    counts, contexts = [Counter() for _ in range(order + 1)], Counter()
    start = ["START"] * (order - 1)
    for doc, t in texts:
        if not held(doc):
            s = start + t
            for i in range(order - 1, len(s)):
                for m in range(1, order + 1):
                    counts[m][tuple(s[i - m + 1 : i + 1])] += 1
                    if m > 1:
                        contexts[tuple(s[i - m + 1 : i])] += 1
    total, types = sum(counts[1].values()), len(counts[1])
    discount = [None]
    for m in range(1, order + 1):
        of = Counter(counts[m].values())
        floor = (k_most + 1) * of[k_most + 1] / of[1] if of[1] else 0
        d = {}
        for r in range(1, k_most + 1):
            x = ((r + 1) * of[r + 1] / (r * of[r]) - floor) / (1 - floor) if of[r] and floor < 1 else 1
            d[r] = 0 if m > 1 and r <= cutoff else x if 0 < x <= 1 else 1.0
        discount.append(d)
    kept = lambda m, c: c if c > k_most else discount[m].get(c, 0) * c
    mass = sum(kept(1, c) for c in counts[1].values())
    size = total + (mass >= total)
    after = defaultdict(list)
    for m in range(2, order + 1):
        for g, c in counts[m].items():
            if kept(m, c) > 0:
                after[g[:-1]].append((g[-1], c))

    @lru_cache(None)
    def weight(h):
        if h not in after:
            return 1.0, 0
        own, c = sum(kept(len(h) + 1, x) for _, x in after[h]), contexts[h]
        full = int(own >= c * (1 - 1e-12))
        return (1 - own / (c + full)) / (1 - sum(p(w, h[1:]) for w, _ in after[h])), full

    def p(w, h):
        if not h:
            return kept(1, counts[1][w,]) / size if (w,) in counts[1] else (size - mass) / size
        own = kept(len(h) + 1, counts[len(h) + 1].get((*h, w), 0))
        a, full = weight(h)
        return own / (contexts[h] + full) if own > 0 else a * p(w, h[1:])

    out = {}
    for doc, t in texts:
        s = start + t
        base = sum(math.log10((counts[1].get((w,), 0) + 0.5) / (total + 0.5 * (types + 1))) for w in t)
        own = sum(math.log10(p(s[i], tuple(s[i - order + 1 : i]))) for i in range(order - 1, len(s)))
        out[doc] = (held(doc), len(t), sum((w,) in counts[1] for w in t), total, base, own)
    sums = [sum(p(w[0], h) for w in counts[1]) + p("never", h) for h in [*list(after)[:20], ("START",) * (order - 1)]]
    return out, sums

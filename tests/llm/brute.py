"""Plain-Python versions of the operators' contracts."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import xxhash

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
FOLDED = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOW = {i: i + 32 for i in range(65, 91)}


def low(text):
    return (text or "").translate(_LOW)


def sha(b):
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


def simhash(text):
    w = SPACED.findall(low(text))
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), seed=42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def near_duplicates(rows):
    fp = [simhash(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i + 1, len(rows)):
            if (fp[i] ^ fp[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(least.get(find(i), k), k)
    return [(k, f"{fp[i]:016x}", least.get(find(i))) for i, (k, _) in enumerate(rows)]


def licenses(text, rules):
    w = FOLDED.findall(low(text))
    phrases = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
    at = [(i, label) for i in range(len(w)) for p, label in phrases.items() if tuple(w[i : i + len(p)]) == p]
    norm = " " + " ".join(w) + " " if w else " "
    found = sorted({(m.start(), -m.end(), p, label, c) for p, label, c, k, r in rules if k in norm for m in re.finditer(r, norm, re.A)})
    kept = [x for n, x in enumerate(found) if not any(y[1] <= x[1] and y[2] <= x[2] for y in found[:n])]
    base = {label for _, label in at}
    return (len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted(base)), ",".join(sorted(base | {x[3] for x in kept})), round(1.0 - math.prod(1 - x[4] for x in kept), 9), len(kept))


def byte_repeats(rows, n=200):
    seen = Counter()
    data = [(k, (t or "").encode()) for k, t in rows]
    for _, b in data:
        seen.update(b[i : i + n] for i in range(len(b) - n + 1))
    out = []
    for k, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if seen[b[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((k, len(b), sum(gone), spans, sha(bytes(c for c, g in zip(b, gone, strict=True) if not g))))
    return out


def word_repeats(rows, n=50):
    inf = 1 << 70
    data = [(k, inf if k is None else k, SPACED.findall(t or "")) for k, t in rows]
    least = {}
    for _, o, w in data:
        for i in range(len(w) - n + 1):
            key = tuple(w[i : i + n])
            least[key] = min(least.get(key, inf), o)
    out = []
    for k, o, w in data:
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            if least[tuple(w[i : i + n])] < o:
                gone[i : i + n] = [True] * n
        out.append((k, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g))))
    return out


def leaks(rows, items, n=13):
    windows = defaultdict(set)
    for item, t in items:
        w = FOLDED.findall(low(t))
        for i in range(max(1, len(w) - n + 1) if w else 0):
            windows[tuple(w[i : i + n])].add("" if item is None else str(item))
    out = []
    for k, t in rows:
        w = FOLDED.findall(low(t))
        hit, found = [False] * len(w), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                if own := windows.get(tuple(w[i : i + size])):
                    found |= own
                    hit[i : i + size] = [True] * size
        out.append((k, len(w), sum(hit), len(found), sha(",".join(sorted(found))), sum(hit) > 0 and 20 * sum(hit) >= len(w)))
    return out


def held(k):
    return zlib.crc32(b"" if k is None else str(k).encode()) % 10 == 0


def _into(word, index):
    return [[(i, index[word[i:j]]) for i in range(max(0, j - 140), j) if word[i:j] in index] for j in range(len(word) + 1)]


def _add(xs):
    top = max(xs, default=-math.inf)
    return top if top == -math.inf else top + math.log(math.fsum(math.exp(x - top) for x in xs))


def log_forward(word, index, scores):
    """Natural-log sum over all segmentations of a word."""
    a = [0.0]
    for own in _into(word, index)[1:]:
        a.append(_add([a[i] + scores[p] for i, p in own]))
    return a[-1]


def long_word(word, index, scores):
    """Expected piece counts of one word, in log space."""
    into = _into(word, index)
    a = [0.0]
    for own in into[1:]:
        a.append(_add([a[i] + scores[p] for i, p in own]))
    out = [[] for _ in into]
    for j, own in enumerate(into):
        for i, p in own:
            out[i].append((j, p))
    b = [0.0] * len(into)
    for i in range(len(into) - 2, -1, -1):
        b[i] = _add([b[j] + scores[p] for j, p in out[i]])
    got = Counter()
    for j, own in enumerate(into):
        for i, p in own:
            got[p] += math.exp(a[i] + scores[p] + b[j] - a[-1])
    return got


def unigram(rows):
    data = [(k, [*SPACED.findall(low(t)), None]) for k, t in rows]
    count = Counter(x for k, w in data if not held(k) for x in w)
    n, v = sum(count.values()), len(count)
    return [(k, held(k), len(w), sum(count[x] > 0 for x in w), n, sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)) for k, w in data]

"""Plain forms of the corpus operators, to hold the real ones against."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

LAST = 2**63 - 1
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall((text or "").encode())


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def place(i):
    return LAST if i is None else i


def byte_repeats(rows, n=50):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - n + 1):
            w = b[p : p + n]
            first[w] = min(first.get(w, LAST), place(i))
    out = []
    for i, t in rows:
        b, end = (t or "").encode(), 0
        gone = bytearray(len(b))
        for p in range(len(b) - n + 1):
            if first[b[p : p + n]] < place(i):
                for q in range(max(end, p), p + n):
                    gone[q] = 1
                end = p + n
        spans = sum(1 for j in range(len(b)) if gone[j] and (j == 0 or not gone[j - 1]))
        out.append((i, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone, strict=True) if not g))))
    return sorted(out, key=str)


def word_repeats(rows, n=20):
    first = {}
    for i, t in rows:
        w = words(t)
        for p in range(len(w) - n + 1):
            k = tuple(w[p : p + n])
            first[k] = min(first.get(k, (2**64, 0)), (place(i), p))
    out = []
    for i, t in rows:
        w = words(t)
        gone = [0] * len(w)
        for p in range(len(w) - n + 1):
            if first[tuple(w[p : p + n])] < (place(i), p):
                gone[p : p + n] = [1] * n
        out.append((i, len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone, strict=True) if not g))))
    return sorted(out, key=str)


def exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        left = 1
        for i in sorted(ids, key=lambda i: (i is None, i)):
            kept = i == keep and left > 0
            left -= kept
            out.append((i, keep, len(ids), kept, sha(t.encode())))
    return sorted(out, key=str)


def fingerprint(text, k=4):
    import xxhash

    w = [x.lower() for x in words(text)]
    n = len(w)
    shingles = [b" ".join(w[i : i + k]) for i in range(n - k + 1)] if n >= k else [b" ".join(w)] * (n > 0)
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near(rows, bits=4):
    f = [fingerprint(t) for _, t in rows]
    parent = list(range(len(f)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(f)):
        for j in range(i):
            if bin(f[i] ^ f[j]).count("1") <= bits:
                parent[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        r = find(k)
        least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
    return sorted(((i, f"{f[k]:016x}", least[find(k)]) for k, (i, _) in enumerate(rows)), key=str)


def ppm(rows, depth=5):
    learnt = lambda i: i is None or zlib.crc32(str(i).encode()) % 7 != 2
    tokens = [[w.lower() for w in words(t)] for _, t in rows]
    streams = [b"\n" * depth + b"".join(w + b" " for w in ws) + b"\n" for ws in tokens]
    counts, unigrams = defaultdict(Counter), Counter()
    for (i, _), ws, z in zip(rows, tokens, streams, strict=True):
        if learnt(i):
            unigrams.update(ws)
            unigrams[b"\n"] += 1
            for p in range(depth, len(z)):
                for d in range(depth + 1):
                    counts[z[p - d : p]][z[p]] += 1
    n, v = sum(unigrams.values()), len(unigrams)

    def bits(z, p):
        total, out = 0.0, set()
        for d in range(depth, -1, -1):
            c = {k: x for k, x in counts.get(z[p - d : p], {}).items() if k not in out}
            kinds, seen = len(c), sum(c.values())
            if kinds:
                if z[p] in c:
                    return total + math.log10(c[z[p]] / (seen + kinds))
                total += math.log10(kinds / (seen + kinds))
                out |= set(c)
        return total - math.log10(256 - len(out))

    out = []
    for (i, _), ws, z in zip(rows, tokens, streams, strict=True):
        ws = [*ws, b"\n"]
        out.append((i, not learnt(i), len(ws), sum(w in unigrams for w in ws), n, sum(math.log10((unigrams[w] + 1) / (n + v + 1)) for w in ws), sum(bits(z, p) for p in range(depth, len(z)))))
    return sorted(out, key=str)

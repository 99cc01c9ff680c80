"""Plain versions of the corpus operators, for small inputs."""

import re
import zlib

import numpy as np
import xxhash

MASK = (1 << 64) - 1


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def simhash(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = words(low)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(fingerprints, radius=4):
    """Root (a position) of every fingerprint."""
    f = np.array(fingerprints, np.uint64)
    parent = list(range(len(f)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f[i + 1 :] ^ f[i]) <= radius) + i + 1:
            a, b = sorted((find(i), find(int(j))))
            parent[b] = a
    return [find(i) for i in range(len(f))]


def cut_repeats(texts, length=100):
    """(kept bytes, removed, runs) of texts in order."""
    seen, out = set(), []
    for text in texts:
        data = (text or "").encode()
        covered = bytearray(len(data))
        for p in range(len(data) - length + 1):
            gram = data[p : p + length]
            if gram in seen:
                covered[p : p + length] = b"\1" * length
            seen.add(gram)
        runs = len(re.findall(rb"\x01+", bytes(covered)))
        out.append((bytes(b for b, c in zip(data, covered) if not c), sum(covered), runs))
    return out


def winnow(text, gram, window):
    points = [ord(c) for c in text]
    k = min(gram, len(points))
    if not points:
        return []
    odd = 0x9E3779B97F4A7C15
    inverse = pow(odd, -1, 1 << 64)
    base = [pow(inverse, j, 1 << 64) for j in range(k)]
    hashes = []
    for i in range(len(points) - k + 1):
        h = sum((points[i + j] + 1) * base[j] for j in range(k)) & MASK
        h ^= h >> 31
        h = h * 0xBF58476D1CE4E5B9 & MASK
        hashes.append((h ^ h >> 29) >> 32)
    width, out = min(window, len(hashes)), []
    for a in range(len(hashes) - width + 1):
        least = min(hashes[a : a + width])
        chosen = (least, max(i for i in range(a, a + width) if hashes[i] == least))
        if not out or out[-1] != chosen:
            out.append(chosen)
    return out


def grams(text, longest=3):
    counts = {}
    for word in "".join(c if c.isalpha() else " " for c in text.lower()).split():
        padded = f" {word} "
        for n in range(1, longest + 1):
            for i in range(len(padded) - n + 1):
                if padded[i : i + n] != " ":
                    counts[padded[i : i + n]] = counts.get(padded[i : i + n], 0) + 1
    return counts


def out_of_place(text, model, profile):
    """Language and score by profiles of n-gram text -> rank."""
    counts = grams(text)
    ranked = sorted(counts, key=lambda g: (-counts[g], [ord(c) if c != " " else 0 for c in g] + [-1] * (3 - len(g))))[:profile]
    if not ranked:
        return "und", 0.0
    charge = {lang: sum(abs(ranks[g] - r) if g in ranks else profile for r, g in enumerate(ranked)) for lang, ranks in model.items()}
    best = min(sorted(charge), key=charge.get)
    return best, 1 - charge[best] / (profile * len(ranked))


def least_packing_cost(sizes, lengths, cost):
    """The cheapest way to deal pieces into bins, over all ways."""

    def dealt(at, bins):
        if at == len(sizes):
            return sum(cost(next(n for n in lengths if n >= b)) for b in bins)
        found = [dealt(at + 1, [*bins, sizes[at]])]
        for k in range(len(bins)):
            if bins[k] + sizes[at] <= max(lengths):
                found.append(dealt(at + 1, [*bins[:k], bins[k] + sizes[at], *bins[k + 1 :]]))
        return min(found)

    return dealt(0, [])


def held_out(doc_id):
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 5 == 0

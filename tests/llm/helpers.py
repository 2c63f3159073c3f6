"""Plain-Python counterparts of the operators."""

from __future__ import annotations

import re

import numpy as np
import xxhash


def words(text):
    return (text or "").encode().lower().split()


def simhash(text):
    w = words(text)
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(prints):
    """Smallest reachable position of each of a list of fingerprints within three bits."""
    a = np.array(prints, np.uint64)
    par = list(range(len(a)))

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= 3) + i + 1:
            x, y = find(i), find(int(j))
            par[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(a))]


def normalised(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")

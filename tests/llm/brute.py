"""Plain versions of the operators, over lists of (id, text)."""

import hashlib
import re
import zlib

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(x: str) -> str:
    return hashlib.sha256(x.encode("utf-8")).hexdigest()


def words(text):
    return WORD.findall(text or "")


def fingerprint(text) -> int:
    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = WORD.findall(t)
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(nodes, linked):
    """Smallest id reachable for every id; ``linked`` is a set of pairs."""
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in linked:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def simhash(docs, distance=4):
    fp = {d: fingerprint(t) for d, t in docs}
    ids = sorted(fp)
    import numpy as np

    f = np.array([fp[i] for i in ids], np.uint64)
    links = set()
    for i in range(len(ids)):
        x = np.bitwise_count(f[i + 1 :] ^ f[i])
        links.update((ids[i], ids[i + 1 + int(j)]) for j in np.flatnonzero(x <= distance))
    return fp, components(ids, links)


def repeats(docs, size=20):
    """{id: (n_words, n_removed, kept)}"""
    seen, out = {}, {}
    for d, t in sorted(docs, key=lambda x: x[0]):
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            k = tuple(w[i : i + size])
            if k in seen:
                for j in range(i, i + size):
                    gone[j] = True
            else:
                seen[k] = (d, i)
        out[d] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return out


def crc_ids(ids) -> int:
    return zlib.crc32(b"".join(int(i).to_bytes(4, "little") for i in ids))

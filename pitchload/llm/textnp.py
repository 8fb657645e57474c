"""NumPy helpers that work on the UTF-8 bytes of many texts at once (inside Spark tasks)."""

from __future__ import annotations

import numpy as np

_U = np.uint64
BASE = _U(0x9E3779B97F4A7C15)                       # odd, so it has an inverse modulo 2**64
BASE_INV = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: bytes taken as white space (ASCII only; other bytes belong to words)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
#: white space and ASCII punctuation
SEPARATOR = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_powers: dict[str, np.ndarray] = {}


def splitmix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit words with good avalanche."""
    x = x + _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def splitmix_int(x: int) -> int:
    """`splitmix` of one Python int."""
    m = (1 << 64) - 1
    x = (x + 0x9E3779B97F4A7C15) & m
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & m
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & m
    return x ^ (x >> 31)


def _power(n: int, which: str) -> np.ndarray:
    """BASE**i (or its inverse) for i < n, kept between calls."""
    have = _powers.get(which)
    if have is None or len(have) < n:
        step = np.full(max(n, 1 << 16), BASE if which == "up" else BASE_INV, np.uint64)
        step[0] = 1
        have = _powers[which] = np.multiply.accumulate(step)
    return have[:n]


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """P of length n + 1 so that a range's hash is (P[end] - P[start]) * BASE**-start."""
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + _U(1)) * _power(len(buf), "up"), out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of buf[start:end], equal for equal bytes wherever they stand."""
    inv = _power(len(prefix), "down")
    h = (prefix[end] - prefix[start]) * inv[start]
    return splitmix(h ^ ((end - start).astype(np.uint64) * _U(0xD6E8FEB86659FD93)))


def slices(texts: list, most: int = 1 << 19):
    """Index ranges (a, b) whose texts have about `most` characters together (one text at least)."""
    a = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > a and size + n > most:
            yield a, i
            a, size = i, 0
        size += n
    if a < len(texts):
        yield a, len(texts)


def join_bytes(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All parts in one buffer, each followed by a newline; offsets of their starts (one more than parts)."""
    off = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=off[1:])
    return np.frombuffer(b"\n".join(parts) + b"\n", np.uint8), off


def words(buf: np.ndarray, off: np.ndarray, apart: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and text index of every word of a `join_bytes` buffer; `apart` marks the bytes between words."""
    inside = ~apart[buf]
    edge = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0]))))
    start, end = edge[::2], edge[1::2]
    h = range_hash(prefix_hash(buf), start, end)
    return h, start, np.searchsorted(off, start, side="right") - 1


def shingles(h: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words of one text and their text index; a text of 1 to k-1 words gives one
    shingle of all its words, a text without words none."""
    n = len(h)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    count = np.bincount(doc)
    if n >= k:
        acc = np.zeros(n - k + 1, np.uint64)
        for j in range(k):
            acc = splitmix(acc * _U(3) + h[j:n - k + 1 + j])
        ok = doc[:n - k + 1] == doc[k - 1:]
        acc, where = acc[ok], doc[:n - k + 1][ok]
    else:
        acc, where = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        first = np.searchsorted(doc, short)
        extra = np.array([int(_fold(h[a:a + count[s]])) for a, s in zip(first, short)], np.uint64)
        acc, where = np.concatenate((acc, extra)), np.concatenate((where, short))
        o = np.argsort(where, kind="stable")
        acc, where = acc[o], where[o]
    return acc, where


def _fold(h: np.ndarray) -> np.uint64:
    acc = np.full(1, len(h) * 7919, np.uint64)
    for x in h:
        acc = splitmix(acc * _U(3) + x)
    return acc[0]


def unique_per_doc(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (doc, hash) sorted by both, and how often each occurs."""
    o = np.lexsort((h, doc))
    h, doc = h[o], doc[o]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return h[at], doc[at], np.diff(np.append(at, len(h)))

"""Deep-shallow sorting of byte strings: multikey quicksort to a shallow depth, then blind tries.

Used inside Spark tasks on the contexts of one task; see `suffix_dedup`.
"""

from __future__ import annotations

import numpy as np

WORD = 8        # bytes that the quicksort compares at once
SHALLOW = 48    # bytes; groups that agree further go to a blind trie


def order(strings: list[bytes], shallow: int = SHALLOW) -> list[int]:
    """Indexes of `strings` in lexicographic order (equal strings in any order)."""
    out: list[int] = []
    stack = [(list(range(len(strings))), 0)]
    while stack:
        idx, depth = stack.pop()
        if len(idx) < 2:
            out += idx
        elif depth >= shallow:
            out += blind_trie(strings, idx)
        else:
            word = [strings[i][depth:depth + WORD] for i in idx]
            few = sorted(word[::len(word) // 9 + 1])      # a median of some that stand apart
            pivot = few[len(few) // 2]
            less, same, more = [], [], []
            for i, w in zip(idx, word):
                (same if w == pivot else less if w < pivot else more).append(i)
            # the stack's top is sorted next: push the greater parts first
            stack.append((more, depth))
            # strings that end inside this word and agree in it are equal as a whole
            stack.append((same, depth + WORD if len(pivot) == WORD else shallow))
            stack.append((less, depth))
    return out


def _agree(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n - 1
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[:mid] == b[:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def blind_trie(strings: list[bytes], idx: list[int]) -> list[int]:
    """Order of strings[i] for i in idx through a blind (Patricia) trie.

    An inner node holds the depth at which its strings part and a child for each byte there (-1: the
    string ends). A new string goes down blindly, by the bytes at the nodes' depths alone; one
    comparison with the leaf it reaches tells where it really parts from the trie.
    """
    root: list = [idx[0]]                            # a leaf: equal strings' indexes
    for i in idx[1:]:
        s = strings[i]
        node = root
        while isinstance(node, tuple):
            depth, kids = node
            node = kids.get(s[depth] if depth < len(s) else -1) or next(iter(kids.values()))
        other = strings[node[0]]
        common = _agree(s, other)
        if common == len(s) == len(other):
            node.append(i)
            continue
        above, edge, node = None, None, root
        while isinstance(node, tuple) and node[0] < common:
            above, edge = node, (s[node[0]] if node[0] < len(s) else -1)
            node = node[1][edge]
        new = s[common] if common < len(s) else -1
        if isinstance(node, tuple) and node[0] == common:
            node[1][new] = [i]
            continue
        fork = (common, {(other[common] if common < len(other) else -1): node, new: [i]})
        if above is None:
            root = fork
        else:
            above[1][edge] = fork
    out: list[int] = []
    stack = [root]
    while stack:
        node = stack.pop()
        if isinstance(node, tuple):
            stack += [node[1][c] for c in sorted(node[1], reverse=True)]
        else:
            out += node
    return out


def neighbours(strings: list[bytes], at: np.ndarray, width: int) -> np.ndarray:
    """Longest common prefixes of each string with the one before it in the order `at` (0 for the first)."""
    n = len(at)
    if n < 2:
        return np.zeros(n, np.int64)
    length = np.fromiter((len(s) for s in strings), np.int64, len(strings))[at]
    rows = np.frombuffer(b"".join(strings[i].ljust(width, b"\0") for i in at), np.uint8).reshape(n, width)
    differ = rows[1:] != rows[:-1]
    first = np.where(differ.any(1), differ.argmax(1), width)
    return np.concatenate(([0], np.minimum(first, np.minimum(length[1:], length[:-1]))))

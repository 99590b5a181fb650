"""Suffix arrays of byte arrays in numpy: Larsson-Sadakane refinement and Kasai prefixes."""

from __future__ import annotations

import numpy as np


def byte_words(data: np.ndarray) -> np.ndarray:
    """The little-endian 8-byte word that starts at each position (len - 7 of them), no copy."""
    return np.ndarray((max(0, len(data) - 7),), dtype="<u8", buffer=data, strides=(1,))


def suffix_array(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sa, rank). Suffixes start sorted by 8 bytes; each round sorts only the groups that are
    still tied, by the rank of the suffix twice as far on, as Larsson and Sadakane do: sorted
    suffixes are never touched again. A suffix that ends sorts before a longer one."""
    n = len(data)
    if n == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    tail = np.concatenate([data, np.zeros(8, np.uint8)])
    key = byte_words(tail)[:n].byteswap()
    sa = np.argsort(key, kind="stable")
    same = np.concatenate(([False], key[sa[1:]] == key[sa[:-1]]))
    # Zero padding must not tie a short suffix with one that holds real zero bytes.
    near = sa > n - 8
    same &= ~near
    same[1:] &= ~near[:-1]
    if near.any() and (data == 0).any():  # rare: order those ends exactly
        sa = np.array(sorted(range(n), key=lambda i: (data[i : i + 8].tobytes(), min(8, n - i))), dtype=np.int64)
        heads = [data[i : i + 8].tobytes() for i in sa]
        same = np.array([False] + [a == b for a, b in zip(heads[1:], heads[:-1], strict=True)])
    first = np.where(same, 0, np.arange(n))
    np.maximum.accumulate(first, out=first)
    rank = np.empty(n, np.int64)
    rank[sa] = first
    h = 8
    slots = np.flatnonzero(same | np.append(same[1:], False))
    while len(slots):
        at = sa[slots]
        further = np.where(at + h < n, rank[np.minimum(at + h, n - 1)] + 1, 0)
        pair = rank[at] * (n + 2) + further
        order = np.argsort(pair, kind="stable")
        at, pair = at[order], pair[order]
        sa[slots] = at
        tied = np.concatenate(([False], pair[1:] == pair[:-1]))
        start = np.where(tied, 0, slots)
        np.maximum.accumulate(start, out=start)
        rank[at] = start
        slots = slots[tied | np.append(tied[1:], False)]
        h *= 2
    return sa, rank


def common_prefixes(data: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """lcp[j]: common prefix of suffixes sa[j - 1] and sa[j] (lcp[0] = 0).

    Kasai's rule - the prefix at i + 1 is at least that at i less one - in the form that vectors
    take: where the bytes before the two suffixes agree, it is exactly one less, so only the
    other positions are compared, eight bytes at a time."""
    n = len(data)
    if n == 0:
        return np.empty(0, np.int64)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    at = np.arange(n)
    derived = (phi > 0) & (at > 0)
    derived[derived] = data[at[derived] - 1] == data[phi[derived] - 1]
    i = np.flatnonzero(~derived)
    j = phi[i]
    plcp = np.zeros(n, np.int64)
    i, j = i[j >= 0], j[j >= 0]
    words = byte_words(np.concatenate([data, np.zeros(8, np.uint8)]))
    own, size = i, np.zeros(len(i), np.int64)
    live = np.arange(len(i))
    while len(live):
        a, b = i[live] + size[live], j[live] + size[live]
        room = n - np.maximum(a, b)
        ok = room > 0
        diff = words[np.minimum(a, n)] ^ words[np.minimum(b, n)]
        low = diff & (~diff + np.uint64(1))
        same = np.where(diff == 0, 8, np.log2(np.maximum(low, 1).astype(np.float64)).astype(np.int64) // 8)
        same = np.where(ok, np.minimum(same, room), 0)
        size[live] += same
        live = live[ok & (same == 8)]
    plcp[own] = size
    base = np.where(derived, -1, at)
    np.maximum.accumulate(base, out=base)
    plcp = plcp[base] - (at - base)
    return plcp[sa] * (np.arange(n) > 0)

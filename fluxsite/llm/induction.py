"""Byte-level work of the suffix operator, on numpy buffers inside a task.

Terms: a *window* is a string of ``LENGTH`` bytes; the *anchor* of a window is
the first of its ``GRAM``-byte grams with the least hash, so equal windows have
equal anchors at equal places. Consecutive windows with one anchor form a run;
the bytes a run covers are its context.
"""

from __future__ import annotations

import numpy as np

LENGTH = 200
GRAM = 32
SPREAD = LENGTH - GRAM + 1  # places that an anchor can have in its window
_FACTOR = 0x9E3779B97F4A7C15
_FULL = (1 << 64) - 1


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each position (the last GRAM - 1 are short)."""
    h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    width, factor = 1, _FACTOR
    while width < GRAM:
        grown = h * np.uint64(factor)
        grown[:-width] += h[width:]
        h, width, factor = grown, 2 * width, factor * factor & _FULL
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    return h


def first_least(h: np.ndarray, spread: int) -> np.ndarray:
    """Position of the first least value among the ``spread`` from each position."""
    n = len(h) - spread + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at, best, width = np.arange(len(h), dtype=np.int32), h, 1
    while 2 * width <= spread:
        at, best = _merge(at, best, width)
        width *= 2
    if width < spread:
        at, best = _merge(at, best, spread - width)
    return at[:n].astype(np.int64)


def _merge(at: np.ndarray, best: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
    later = best[shift:] < best[:-shift]
    return np.where(later, at[shift:], at[:-shift]), np.where(later, best[shift:], best[:-shift])


def runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, hash, anchor, first, last) of every run of windows: the text's number,
    the anchor's hash and position, and the first and last window, all positions
    counted in ``data``. No window crosses texts."""
    if len(data) < LENGTH:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    h = gram_hashes(data)
    anchor = first_least(h, SPREAD)[: len(data) - LENGTH + 1]
    # windows that start less than LENGTH before the end of their text are none
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(anchor)]
    inside = np.arange(len(anchor)) + LENGTH <= offsets[1:][text]
    start = np.flatnonzero(inside)
    anchor, text = anchor[start], text[start]
    if not len(start):
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    new = np.flatnonzero((np.diff(anchor) != 0) | (np.diff(text) != 0)) + 1
    first = np.concatenate([[0], new])
    last = np.concatenate([new, [len(start)]]) - 1
    return text[first], h[anchor[first]].view(np.int64), anchor[first], start[first], start[last]


def induced_repeats(group: np.ndarray, contexts: list[bytes], anchor: np.ndarray, shortest: np.ndarray) -> list[np.ndarray]:
    """Which windows of each context occur in another context of its group.

    Row i of group ``group[i]`` (rows in order of group) holds ``contexts[i]``
    with its anchor at ``anchor[i]``; its windows start ``shortest[i]`` to
    ``anchor[i]`` bytes before the anchor. Returns a boolean array per row, by
    that distance from 0.

    The suffixes at the anchors are sorted once, with the common-prefix lengths
    of neighbours. From the order at distance d that at d + 1 is induced: sorted
    by the byte before, stably, and the common prefix of two that come together
    is one more than the least between them. A window occurs elsewhere if a
    neighbour shares LENGTH bytes with it.
    """
    n = len(contexts)
    found = [np.zeros(int(a) + 1, bool) for a in anchor]
    if n < 2:
        return found
    anchor, group = np.asarray(anchor, np.int64), np.asarray(group, np.int64)
    right = [c[a:] for c, a in zip(contexts, anchor.tolist(), strict=True)]
    order = np.array(sorted(range(n), key=lambda i: (group[i], right[i])), np.int64)
    # the bytes left of the anchors, by distance
    left = np.zeros((n, SPREAD), np.uint8)
    for i, (c, a) in enumerate(zip(contexts, anchor.tolist(), strict=True)):
        left[i, :a] = np.frombuffer(c, np.uint8, a)[::-1]
    wide = np.zeros((n, LENGTH + 1), np.uint8)
    sizes = np.array([len(r) for r in right])
    for i, r in enumerate(right):
        wide[i, : len(r)] = np.frombuffer(r, np.uint8)
    common = np.zeros(n, np.int64)  # with the row before it in the order; 0 at a group's first
    a, b = order[:-1], order[1:]
    for at in range(0, n - 1, 1 << 14):
        x, y = a[at : at + (1 << 14)], b[at : at + (1 << 14)]
        differ = wide[x] != wide[y]
        equal = np.where(differ.any(axis=1), differ.argmax(axis=1), LENGTH + 1)
        common[1 + at : 1 + at + len(x)] = np.minimum(equal, np.minimum(sizes[x], sizes[y]))
    common[1:][group[a] != group[b]] = 0
    distance = 0
    while len(order):
        following = np.concatenate([common[1:], [0]])
        longest = np.maximum(common, following)
        for i in order[(longest >= LENGTH) & (shortest[order] <= distance)]:
            found[i][distance] = True
        # rows that can't come to LENGTH bytes any more, or have no byte before, end here
        go = (anchor[order] > distance) & (longest + anchor[order] - distance >= LENGTH)
        keep = np.flatnonzero(go)
        if not len(keep):
            break
        key = group[order[keep]] * 256 + left[order[keep], distance]
        sort = np.argsort(key, kind="stable")
        old, key = keep[sort], key[sort]
        same = np.flatnonzero(key[1:] == key[:-1]) + 1
        new_common = np.zeros(len(old), np.int64)
        if len(same):
            bounds = np.stack([old[same - 1] + 1, old[same] + 1], axis=1).ravel()
            padded = np.concatenate([common, [0]])
            new_common[same] = 1 + np.minimum.reduceat(padded, bounds)[::2]
        order, common = order[old], new_common
        distance += 1
    return found

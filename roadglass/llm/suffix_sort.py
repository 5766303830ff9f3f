"""Two-stage suffix sorting of a byte array, to a bounded depth, in numpy."""

from __future__ import annotations

import numpy as np


def ascending(text: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than their successor. The last is not: it is followed by the empty one."""
    n = len(text)
    change = np.flatnonzero(text[1:] != text[:-1]) + 1  # where a run of equal bytes ends
    after = np.searchsorted(change, np.arange(n), side="right")
    inside = after < len(change)
    nxt = change[np.minimum(after, max(len(change) - 1, 0))] if len(change) else np.zeros(n, np.int64)
    return inside & (text[nxt] > text) if n else np.zeros(0, bool)


def words_at(text: np.ndarray) -> np.ndarray:
    """The eight bytes at each position as one big-endian number; zeros follow the end."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(text), np.uint64)
    for k in range(8):
        out = out << np.uint64(8) | padded[k : k + len(text)]
    return out


def sort_directly(at: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes `at`, sorted by their first `depth` bytes: by eight bytes, then ties by the next eight."""
    n = len(words)
    order = at[np.argsort(words[at], kind="stable")]
    key = words[order]
    rank = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])]) if len(order) else np.zeros(0, np.int64)
    for skip in range(8, depth, 8):
        same = np.zeros(len(order), bool)
        tied = rank[1:] == rank[:-1]
        same[1:] |= tied
        same[:-1] |= tied
        slots = np.flatnonzero(same)
        if not len(slots):
            break
        own = order[slots]
        nxt = np.where(own + skip < n, words[np.minimum(own + skip, n - 1)], 0)
        by = np.lexsort((nxt, rank[slots]))
        order[slots] = own[by]
        group, nxt = rank[slots][by], nxt[by]
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (nxt[1:] != nxt[:-1])])
        # ranks stay ordered if each takes the slot of its first member
        rank[slots] = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
        rest = np.flatnonzero(~same)
        rank[rest] = rest
    return order


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """All suffixes of `text` (uint8), sorted by at least their first `depth` bytes."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    up = ascending(text)
    direct = sort_directly(np.flatnonzero(up), words_at(text), depth)
    ends = np.searchsorted(text[direct], np.arange(257))
    falling: list[list[np.ndarray]] = [[] for _ in range(256)]
    falling[text[-1]].append(np.array([n - 1]))

    def before(found: np.ndarray) -> np.ndarray:
        pred = found[found > 0] - 1
        return pred[~up[pred]]

    def hand_out(pred: np.ndarray) -> None:
        chars = text[pred]
        order = np.argsort(chars, kind="stable")
        pred, chars = pred[order], chars[order]
        bounds = np.flatnonzero(np.diff(chars)) + 1
        for part in np.split(pred, bounds):
            if len(part):
                falling[text[part[0]]].append(part)

    out = []
    for c in range(256):
        wave = np.concatenate(falling[c]) if falling[c] else np.zeros(0, np.int64)
        while len(wave):  # the bucket scan meets what it has itself put at the bucket's end
            out.append(wave)
            pred = before(wave)
            own = text[pred] == c
            hand_out(pred[~own])
            wave = pred[own]
        rising = direct[ends[c] : ends[c + 1]]
        if len(rising):
            out.append(rising)
            hand_out(before(rising))
    return np.concatenate(out)


def common_prefixes(order: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """For each neighbouring pair in `order` the length of the common prefix, in whole steps of eight up to `depth`."""
    a, b = order[:-1], order[1:]
    n, length, live = len(words), np.zeros(len(a), np.int64), np.arange(len(a))
    for skip in range(0, depth, 8):
        x, y = a[live] + skip, b[live] + skip
        inside = (x < n) & (y < n)
        equal = inside & (words[np.minimum(x, n - 1)] == words[np.minimum(y, n - 1)])
        live = live[equal]
        if not len(live):
            break
        length[live] = skip + 8
    return length

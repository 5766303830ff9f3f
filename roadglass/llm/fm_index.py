"""A compressed FM-index over word numbers: backward search on a Huffman-shaped wavelet tree.

The index stores what a shard's text looks like to a search that reads patterns from right to left: for each suffix in
order the word before it, entropy-coded in a wavelet tree whose bits are packed and ranked by popcount. Number 0 parts
texts and is never searched for. Suffixes are sorted by their first `depth` words only, which is all that patterns of
at most `depth` words can see. Searches run for many texts at once: all advance by one word together.
"""

from __future__ import annotations

import heapq

import numpy as np


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Bits of each symbol's Huffman code; symbols that do not occur get none."""
    present = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.int64)
    if len(present) < 2:
        lengths[present] = 1
        return lengths
    m = len(present)
    parent = np.zeros(2 * m - 1, np.int64)
    heap = list(zip(counts[present].tolist(), range(m), strict=True))
    heapq.heapify(heap)
    for node in range(m, 2 * m - 1):
        a, x = heapq.heappop(heap)
        b, y = heap[0]
        parent[x] = parent[y] = node
        heapq.heapreplace(heap, (a + b, node))
    depth = np.zeros(2 * m - 1, np.int64)
    for node, up in zip(range(2 * m - 3, -1, -1), parent[2 * m - 3 :: -1].tolist(), strict=True):
        depth[node] = depth[up] + 1
    lengths[present] = depth[:m]
    return lengths


class Bits:
    """A packed bit vector that counts the ones before a place."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)]).view(np.uint64)
        before = np.cumsum(np.bitwise_count(self.words), dtype=np.int64)
        self.before = np.concatenate([np.zeros(1, np.int64), before[:-1]])

    def ones(self, place: np.ndarray) -> np.ndarray:
        word = place >> 6
        mask = (np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class WaveletTree:
    """The symbols of a sequence, one packed bit vector for each level of their canonical Huffman codes."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        counts = np.bincount(symbols, minlength=n_symbols)
        self.lengths = code_lengths(counts)
        order = np.lexsort((np.arange(n_symbols), self.lengths))
        self.codes, code, last = np.zeros(n_symbols, np.int64), 0, 0
        for s, size in zip(order.tolist(), self.lengths[order].tolist(), strict=True):
            if size:
                code = (code + 1 if last else 0) << (size - last)
                self.codes[s], last = code, size
        self.levels: list[tuple[Bits, np.ndarray, np.ndarray]] = []
        now, starts = symbols, self._starts(0, counts)
        for level in range(int(self.lengths.max(initial=0))):
            bit = self._bit(now, level).astype(bool)
            bits = Bits(bit)
            ones_before = bits.ones(starts)  # those before a symbol's node
            self.levels.append((bits, starts, ones_before))
            following = self._starts(level + 1, counts)
            ones = np.cumsum(bit) - bit - ones_before[now]
            rank = np.where(bit, ones, np.arange(len(now)) - starts[now] - ones)
            stays = self.lengths[now] > level + 1
            ordered = np.empty(int(stays.sum()), now.dtype)
            ordered[following[now[stays]] + rank[stays]] = now[stays]
            now, starts = ordered, following

    def _bit(self, symbols: np.ndarray, level: int) -> np.ndarray:
        return (self.codes[symbols] >> (self.lengths[symbols] - 1 - level)) & 1

    def _starts(self, level: int, counts: np.ndarray) -> np.ndarray:
        """Where each symbol's node begins in the order of a level."""
        starts = np.zeros(len(counts), np.int64)
        live = np.flatnonzero(self.lengths > level)
        _, node = np.unique(self.codes[live] >> (self.lengths[live] - level), return_inverse=True)
        sizes = np.bincount(node, counts[live]).astype(np.int64)
        starts[live] = (np.cumsum(sizes) - sizes)[node] if len(live) else 0
        return starts

    def rank(self, symbols: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol (one that occurs) stands before its place."""
        place, lanes = place.copy(), np.arange(len(symbols))
        for level, (bits, starts, ones_before) in enumerate(self.levels):
            lanes = lanes[self.lengths[symbols[lanes]] > level]
            s, p = symbols[lanes], place[lanes]
            ones = bits.ones(starts[s] + p) - ones_before[s]
            place[lanes] = np.where(self._bit(s, level) == 1, ones, p - ones)
        return place


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by their first `depth` symbols: ranks of ever longer beginnings, as many side by side in one key as
    63 bits hold. The last one may overlap the one before; where that is equal the overlap is, too."""
    rank, size = text.astype(np.int64) + 1, 1
    while True:
        bits = int(rank.max(initial=1)).bit_length()
        places = [min(k * size, depth - size) for k in range(min(63 // bits, -(-depth // size)))]
        key = np.zeros(len(rank), np.int64)
        for at in places:
            key <<= bits
            key[: max(len(rank) - at, 0)] |= rank[at:]
        size += places[-1]
        if size >= depth:
            return np.argsort(key)
        rank = np.unique(key, return_inverse=True)[1].astype(np.int64) + 1


class FMIndex:
    """The index of `text` (numbers from 0, the last of them 0) for patterns of at most `depth` numbers other than 0."""

    def __init__(self, text: np.ndarray, depth: int):
        self.depth, self.size = depth, len(text)
        self.order = suffix_order(text, depth)
        n_symbols = int(text.max(initial=0)) + 1
        self.tree = WaveletTree(text[self.order - 1], n_symbols)
        counts = np.bincount(text, minlength=n_symbols)
        self.occurs = np.append(counts > 0, False)
        self.occurs[0] = False
        self.first = np.cumsum(counts) - counts
        # words that neighbours in suffix order have in common, `depth` at most
        padded = np.concatenate([text, np.zeros(depth, text.dtype)])
        self.common = np.zeros(len(text), np.uint8)
        alive = np.arange(1, len(text))
        for k in range(depth):
            ours, theirs = padded[self.order[alive] + k], padded[self.order[alive - 1] + k]
            alive = alive[(ours == theirs) & (ours != 0)]
            self.common[alive] += 1
        self._classes: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def classes(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(number of the class of each suffix, bounds of the classes): suffixes of a class share `length` words."""
        if length not in self._classes:
            fresh = self.common < length
            fresh[:1] = True
            self._classes[length] = np.cumsum(fresh) - 1, np.append(np.flatnonzero(fresh), self.size)
        return self._classes[length]

    def extend(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the patterns with one more symbol in front, empty where there is none."""
        new_low, new_high = np.zeros(len(symbols), np.int64), np.zeros(len(symbols), np.int64)
        known = np.flatnonzero(self.occurs[np.minimum(symbols, len(self.occurs) - 1)])
        s = symbols[known]
        before = self.tree.rank(np.concatenate([s, s]), np.concatenate([low[known], high[known]]))
        new_low[known], new_high[known] = self.first[s] + before[: len(s)], self.first[s] + before[len(s) :]
        return new_low, new_high

    def shortened(self, length: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        """Widen each interval, in place, to that of its pattern's first `length` symbols."""
        for k in np.unique(length).tolist():
            which = np.flatnonzero(length == k)
            number, bounds = self.classes(k)
            at = number[low[which]]
            low[which], high[which] = bounds[at], bounds[at + 1]

    def matching_statistics(self, text: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each place of the texts that lie at `starts` in `text`: the length of the longest string that starts
        there, ends in the same text and occurs in the index, `depth` at most, and the interval of its suffixes."""
        found = np.zeros(len(text), np.int64), np.zeros(len(text), np.int64), np.full(len(text), self.size, np.int64)
        by_size = np.argsort(-sizes, kind="stable")
        stops, sizes = (starts + sizes)[by_size], sizes[by_size]
        length, low, high = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), np.full(len(sizes), self.size, np.int64)
        for step in range(1, int(sizes.max(initial=0)) + 1):
            n = int(np.searchsorted(-sizes, -step, "right"))  # texts that are long enough come first
            at, length, low, high = stops[:n] - step, length[:n], low[:n], high[:n]
            full = np.flatnonzero(length == self.depth)
            if len(full):
                a, b = low[full], high[full]
                length[full] -= 1
                self.shortened(length[full], a, b)
                low[full], high[full] = a, b
            todo = np.arange(n)
            while len(todo):
                a, b = self.extend(text[at[todo]], low[todo], high[todo])
                went = a < b
                done = todo[went]
                low[done], high[done] = a[went], b[went]
                length[done] += 1
                todo = todo[~went]
                low[todo[length[todo] == 0]], high[todo[length[todo] == 0]] = 0, self.size
                todo = todo[length[todo] > 0]
                if len(todo):  # the next shorter beginning of the match that also goes on otherwise
                    edge = np.append(self.common, 0)
                    a, b = low[todo], high[todo]
                    length[todo] = np.minimum(np.maximum(edge[a], edge[b]), length[todo] - 1)
                    self.shortened(length[todo], a, b)
                    low[todo], high[todo] = a, b
            for kept, now in zip(found, (length, low, high), strict=True):
                kept[at] = now
        return found

"""An FM-index over a sequence of numbers: suffix array, wavelet matrix over the BWT, backward search and sampled positions.

All steps are numpy operations on whole arrays; patterns of one length are searched together."""

from __future__ import annotations

import numpy as np

STEP = 16


def suffix_array(text: np.ndarray, sigma: int) -> np.ndarray:
    """Start positions in the order of their suffixes. text ends with the only 0. Prefix doubling that sorts open groups only."""
    n = len(text)
    width = max(1, int(sigma).bit_length())
    depth = max(1, 62 // width)
    key = np.zeros(n, dtype=np.int64)
    padded = np.concatenate([text.astype(np.int64), np.zeros(depth, np.int64)])
    for k in range(depth):
        key = (key << width) | padded[k : k + n]
    order = np.argsort(key, kind="stable")
    slots, members, keys = np.arange(n), order, key[order]
    rank = np.empty(n, dtype=np.int64)
    while True:
        new = np.ones(len(members), dtype=bool)
        new[1:] = (keys[1:] != keys[:-1]) | (slots[1:] != slots[:-1] + 1)
        group = np.cumsum(new) - 1
        rank[members] = slots[new][group]
        open_ = np.bincount(group)[group] > 1
        if not open_.any():
            return order
        slots, members = slots[open_], members[open_]
        key = rank[members] * np.int64(n + 1) + rank[np.minimum(members + depth, n - 1)]
        by = np.argsort(key, kind="stable")
        members, keys = members[by], key[by]
        order[slots] = members
        depth *= 2


class FMIndex:
    """Counts and locates patterns in `text` (numbers from 1 to sigma; 0 is added at the end)."""

    def __init__(self, text: np.ndarray, sigma: int):
        text = np.concatenate([text.astype(np.int64), np.zeros(1, np.int64)])
        order = suffix_array(text, sigma)
        bwt = text[order - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma + 1))])
        self.bits = max(1, int(sigma).bit_length())
        self.ones, self.zeros = [], []
        level = bwt
        for shift in range(self.bits - 1, -1, -1):
            bit = (level >> shift) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(len(bit) - int(self.ones[-1][-1]))
            level = np.concatenate([level[bit == 0], level[bit == 1]])
        self.starts = np.zeros(sigma + 1, dtype=np.int64)  # where a symbol begins in the last level
        present, at = np.unique(level, return_index=True)
        self.starts[present] = at
        sampled = order % STEP == 0
        self.sampled = sampled
        self.sample_rank = np.cumsum(sampled) - 1
        self.samples = order[sampled]
        self.size = len(text)

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often the symbol stands in the first i places of the BWT."""
        for k in range(self.bits):
            bit = (symbol >> (self.bits - 1 - k)) & 1
            ones = self.ones[k][i]
            i = np.where(bit == 1, self.zeros[k] + ones, i - ones)
        return i - self.starts[symbol]

    def back(self, i: np.ndarray) -> np.ndarray:
        """The row of the suffix that starts one place earlier."""
        symbol = np.zeros(len(i), dtype=np.int64)
        for k in range(self.bits):
            ones = self.ones[k][i]
            bit = self.ones[k][i + 1] - ones
            symbol = (symbol << 1) | bit
            i = np.where(bit == 1, self.zeros[k] + ones, i - ones)
        return self.first[symbol] + i - self.starts[symbol]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) whose suffixes start with each pattern (one per line, all of one length)."""
        n = len(patterns)
        low, high = np.zeros(n, dtype=np.int64), np.full(n, self.size, dtype=np.int64)
        live = np.arange(n)
        for k in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[live, k]
            low[live] = self.first[symbol] + self.rank(symbol, low[live])
            high[live] = self.first[symbol] + self.rank(symbol, high[live])
            dead = live[high[live] <= low[live]]
            high[dead] = low[dead]
            live = live[high[live] > low[live]]
            if not len(live):
                break
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: back through the text to the next sampled one."""
        at = rows.copy()
        steps = np.zeros(len(rows), dtype=np.int64)
        out = np.full(len(rows), -1, dtype=np.int64)
        left = np.arange(len(rows))
        while len(left):
            hit = self.sampled[at[left]]
            done = left[hit]
            out[done] = self.samples[self.sample_rank[at[done]]] + steps[done]
            left = left[~hit]
            at[left] = self.back(at[left])
            steps[left] += 1
        return out

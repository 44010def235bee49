"""An FM-index over a sequence of word numbers: suffix array, BWT, wavelet matrix, sampled positions."""

from __future__ import annotations

import numpy as np

SAMPLE_RATE = 16


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Positions in order of their suffixes. Zeros end a suffix: they are least, and among themselves in order of place.

    Prefix doubling; only positions that are still tied are sorted again.
    """
    n = len(seq)
    key = seq.astype(np.int64) + n
    zeros = np.flatnonzero(seq == 0)
    key[zeros] = np.arange(len(zeros))
    order = np.argsort(key, kind="stable")
    rank = np.empty(n + 1, dtype=np.int64)
    rank[n] = -1

    def heads(sorted_keys_differ: np.ndarray, base: np.ndarray) -> np.ndarray:
        """For items in order: the first place of each one's run of ties."""
        first = np.where(sorted_keys_differ, np.arange(len(base)), 0)
        return base[np.maximum.accumulate(first)]

    differ = np.ones(n, dtype=bool)
    differ[1:] = key[order[1:]] != key[order[:-1]]
    rank[order] = heads(differ, np.arange(n))
    tied = ~(differ & np.append(differ[1:], True))
    step = 1
    while tied.any():
        slots = np.flatnonzero(tied)
        items = order[slots]
        group, after = rank[items], rank[np.minimum(items + step, n)]
        again = np.lexsort((after, group))
        items, group, after = items[again], group[again], after[again]
        order[slots] = items
        differ = np.ones(len(slots), dtype=bool)
        differ[1:] = (group[1:] != group[:-1]) | (after[1:] != after[:-1])
        rank[items] = heads(differ, slots)
        tied[slots] = ~(differ & np.append(differ[1:], True))
        step *= 2
    return order


class Bits:
    """A bit vector with rank."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, dtype=np.uint8)
        padded[: len(bits)] = bits
        self.blocks = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.blocks), dtype=np.int64)])
        self.zeros = len(bits) - int(self.before[-1])

    def ones(self, i: np.ndarray) -> np.ndarray:
        """How many ones lie before place i."""
        block = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[block] + np.bitwise_count(self.blocks[np.minimum(block, len(self.blocks) - 1)] & mask)


class WaveletMatrix:
    """Rank of a symbol before a place, by one bit vector per bit of the symbols."""

    def __init__(self, seq: np.ndarray, symbols: int):
        self.levels: list[Bits] = []
        self.bits = max(1, int(symbols - 1).bit_length())
        now = seq
        for level in range(self.bits - 1, -1, -1):
            bit = (now >> level) & 1
            self.levels.append(Bits(bit.astype(np.uint8)))
            now = np.concatenate([now[bit == 0], now[bit == 1]])

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        low, high = np.zeros_like(place), place
        for level, bits in zip(range(self.bits - 1, -1, -1), self.levels, strict=True):
            one = ((symbol >> level) & 1).astype(bool)
            a, b = bits.ones(low), bits.ones(high)
            low, high = np.where(one, bits.zeros + a, low - a), np.where(one, bits.zeros + b, high - b)
        return high - low


class FMIndex:
    """seq: numbers below symbols, 0 parts the stretches that are searched."""

    def __init__(self, seq: np.ndarray, symbols: int, rate: int = SAMPLE_RATE):
        if not len(seq) or seq[-1]:  # the last suffix must end in a zero of its own
            seq = np.append(seq, 0)
        order = suffix_array(seq)
        before = np.where(order > 0, seq[order - 1], 0)
        self.size, self.symbols = len(seq), symbols
        self.bwt = before.astype(np.int64)
        self.tree = WaveletMatrix(self.bwt, symbols)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=symbols))]).astype(np.int64)
        kept = (order % rate == 0) | (before == 0)
        self.sampled = Bits(kept.astype(np.uint8))
        self.kept, self.positions = kept, order[kept]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of the suffixes that begin with each phrase; phrases: one a row, equally long."""
        low = np.zeros(len(phrases), dtype=np.int64)
        high = np.full(len(phrases), self.size, dtype=np.int64)
        live = np.arange(len(phrases))
        for k in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[live, k].astype(np.int64)
            low[live] = self.first[symbol] + self.tree.rank(symbol, low[live])
            high[live] = self.first[symbol] + self.tree.rank(symbol, high[live])
            live = live[low[live] < high[live]]
            if not len(live):
                break
        dead = low >= high
        low[dead] = high[dead] = 0
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Where the suffixes of these rows begin."""
        out = np.empty(len(rows), dtype=np.int64)
        left, row, steps = np.arange(len(rows)), rows.astype(np.int64), 0
        while len(left):
            here = self.kept[row]
            out[left[here]] = self.positions[self.sampled.ones(row[here])] + steps
            left, row = left[~here], row[~here]
            symbol = self.bwt[row]
            row = self.first[symbol] + self.tree.rank(symbol, row)
            steps += 1
        return out

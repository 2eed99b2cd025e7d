"""FM-index over word numbers: suffix array, wavelet matrix, backward search and sampled positions."""

import numpy as np

#: every so many positions of a run are kept with the index
SAMPLE = 16


class _Bits:
    """A bit vector with rank."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[:len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        word, low = i >> 6, (i & 63).astype(np.uint64)
        within = self.words[np.minimum(word, len(self.words) - 1)] & ((np.uint64(1) << low) - np.uint64(1))
        return self.before[word] + np.bitwise_count(within)


class WaveletMatrix:
    """Counts of a symbol before a position, in as many steps as symbols have bits."""

    def __init__(self, symbols: np.ndarray, symbol_count: int):
        self.levels = []
        rest = symbols
        for level in range(max(1, int(symbol_count - 1).bit_length()) - 1, -1, -1):
            bit = (rest >> level) & 1
            self.levels.append((level, _Bits(bit), int(len(bit) - bit.sum())))
            rest = np.concatenate([rest[bit == 0], rest[bit == 1]])

    def _walk(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, bits, zeros in self.levels:
            ones = bits.ones(i)
            i = np.where((symbol >> level) & 1, zeros + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self._walk(symbol, i) - self._walk(symbol, np.zeros_like(i))


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of the suffixes; each 0 in ``symbols`` is smaller than all else and unlike every other 0."""
    n = len(symbols)
    gap = symbols == 0
    rank = np.where(gap, np.cumsum(gap) - 1, symbols + int(gap.sum())).astype(np.int64)
    step = 1
    order = np.argsort(rank, kind="stable")
    while True:
        sorted_rank = rank[order]
        new = np.concatenate([[0], np.cumsum(sorted_rank[1:] != sorted_rank[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        follow = np.zeros(n, np.int64)
        follow[:n - step] = rank[step:] + 1
        rank = rank * (n + 1) + follow
        order = np.argsort(rank, kind="stable")
        step *= 2


class FMIndex:
    """Of a sequence of numbers from 1 to ``largest``, cut into runs by single zeros, one at its end."""

    def __init__(self, symbols: np.ndarray, largest: int):
        order = suffix_array(symbols)
        self.last = symbols[order - 1]  # the symbol before each suffix; the first one's is the final zero
        self.tree = WaveletMatrix(self.last, largest + 1)
        self.below = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=largest + 1))])
        # sampled: each run's first place and every SAMPLE-th of the sequence, so that no walk leaves a run
        kept = order % SAMPLE == 0
        kept |= self.last == 0
        self.kept = _Bits(kept)
        self.is_kept = kept
        self.places = order[kept]

    def _step(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self.below[symbol] + self.tree.rank(symbol, i)

    def ranges(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of phrases, which are rows of symbols aligned to the right, none of them 0."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), len(self.last), np.int64)
        for back in range(1, phrases.shape[1] + 1):
            live = np.flatnonzero((lengths >= back) & (high > low))
            if not len(live):
                break
            symbol = phrases[live, -back]
            low[live], high[live] = self._step(symbol, low[live]), self._step(symbol, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the sequence of suffixes by their rank."""
        at, steps = rows.copy(), np.zeros(len(rows), np.int64)
        walking = np.flatnonzero(~self.is_kept[at])
        while len(walking):
            at[walking] = self._step(self.last[at[walking]], at[walking])
            steps[walking] += 1
            walking = walking[~self.is_kept[at[walking]]]
        return self.places[self.kept.ones(at)] + steps

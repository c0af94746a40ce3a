"""A table of the pieces between white space that a worker has met, looked up for many texts at once in numpy.

A piece of up to 15 bytes is its own key: two 64-bit integers of its bytes and its length. Longer ones are rare and go through a dict.
"""

from __future__ import annotations

import numpy as np

from riskloom.llm.shingles import mix

#: White space of ASCII but for the separators 28 to 31.
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Longest piece that is its own key.
SHORT = 15
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def piece_bounds(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the pieces of texts that stand one after the other in ``data``; ``ends``: of the texts."""
    inside = ~_IS_SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[0] = True
    first[ends] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | first[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | first[1:-1]
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


class PieceTable:
    """Ids of pieces. ``slots``: places of the open table, of which half are filled at most."""

    def __init__(self, slots: int = 1 << 20):
        self.shift = np.uint64(64 - (slots.bit_length() - 1))
        self.slots = slots
        self.clear()

    def clear(self) -> None:
        self.low, self.high = np.zeros(self.slots, np.uint64), np.zeros(self.slots, np.uint64)  # high is 0 in an empty place
        self.start, self.count = np.zeros(self.slots, np.int64), np.zeros(self.slots, np.int32)
        self.long: dict[bytes, tuple[int, int]] = {}
        self.pool, self.used, self.filled = np.zeros(1 << 20, "<u4"), 0, 0

    def keys(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of short pieces; ``data`` goes on for 16 bytes behind the last of them."""
        eight = np.lib.stride_tricks.as_strided(data[:8].view(np.uint64), (len(data) - 7,), (1,))
        low = eight[begin] & _MASKS[np.minimum(size, 8)]
        high = (eight[begin + 8] & _MASKS[np.maximum(size - 8, 0)]) | (size.astype(np.uint64) << np.uint64(56))
        return low, high

    def _first_place(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return (mix(low ^ (high * _FACTOR)) >> self.shift).astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Place of each key, or -1."""
        place = self._first_place(low, high)
        found = np.where((self.low[place] == low) & (self.high[place] == high), place, -1)
        rest = np.flatnonzero((found < 0) & (self.high[place] != 0))
        while len(rest):
            place[rest] = (place[rest] + 1) & (self.slots - 1)
            at = place[rest]
            same = (self.low[at] == low[rest]) & (self.high[at] == high[rest])
            found[rest[same]] = at[same]
            rest = rest[~same & (self.high[at] != 0)]
        return found

    def _kept(self, ids: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        flat = np.frombuffer(b"".join(ids), "<u4")
        if self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate((self.pool[: self.used], np.zeros(self.used + 2 * len(flat), "<u4")))
        self.pool[self.used : self.used + len(flat)] = flat
        count = np.array([len(x) // 4 for x in ids], np.int64)
        start = self.used + np.cumsum(count) - count
        self.used += len(flat)
        return start, count

    def add(self, pieces: list[bytes], ids: list[bytes]) -> None:
        """``pieces``: all different, none in the table."""
        start, count = self._kept(ids)
        size = np.array([len(p) for p in pieces], np.int64)
        for k in np.flatnonzero(size > SHORT).tolist():
            self.long[pieces[k]] = int(start[k]), int(count[k])
        short = np.flatnonzero(size <= SHORT)
        data = np.frombuffer(b"".join(pieces) + bytes(16), np.uint8)
        low, high = self.keys(data, (np.cumsum(size) - size)[short], size[short])
        place, left = self._first_place(low, high), np.arange(len(short))
        while len(left):
            at = place[left]
            free = self.high[at] == 0
            _, one = np.unique(at[free], return_index=True)  # of those that want one place, one gets it
            take = left[free][one]
            at = place[take]
            self.low[at], self.high[at], self.start[at], self.count[at] = low[take], high[take], start[short[take]], count[short[take]]
            left = np.setdiff1d(left, take, assume_unique=True)
            place[left] = (place[left] + 1) & (self.slots - 1)
        self.filled += len(pieces)

    def encode(self, texts: list[bytes], learn) -> list[bytes]:
        """Ids of each text, little-endian unsigned 32-bit integers. ``learn`` gives the ids of new pieces."""
        whole = b"".join(texts)
        data = np.frombuffer(whole + bytes(16), np.uint8)
        ends = np.cumsum([len(t) for t in texts])
        begin, end = piece_bounds(data[: len(whole)], ends[ends < len(whole)]) if whole else (np.zeros(0, np.int64),) * 2
        size = end - begin
        is_long = size > SHORT
        low, high = self.keys(data, begin, np.minimum(size, SHORT)) if len(begin) else (np.zeros(0, np.uint64),) * 2
        place = self.find(low, high)
        new = np.flatnonzero((place < 0) & ~is_long)
        slices = [whole[a:b] for a, b in zip(begin[is_long].tolist(), end[is_long].tolist(), strict=True)]
        fresh = {whole[a:b] for a, b in zip(begin[new].tolist(), end[new].tolist(), strict=True)} | {p for p in slices if p not in self.long}
        if fresh:
            if 2 * (self.filled + len(fresh)) > self.slots:
                if not self.filled:  # one text has more pieces than the table takes
                    self.slots, self.shift = 2 * self.slots, self.shift - np.uint64(1)
                self.clear()
                return self.encode(texts, learn)
            pieces = list(fresh)
            self.add(pieces, learn([p.decode("utf-8", "surrogatepass") for p in pieces]))
            place[new] = self.find(low[new], high[new])
        start, count = self.start[place], self.count[place].astype(np.int64)
        if slices:
            start[is_long], count[is_long] = np.array([self.long[p] for p in slices], np.int64).T
        first = np.concatenate(([0], np.cumsum(count)))
        ids = self.pool[np.repeat(start - first[:-1], count) + np.arange(first[-1])].tobytes()
        cuts = (4 * first[np.searchsorted(begin, np.concatenate(([0], ends)))]).tolist()
        return [ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

"""Byte-pair merges of many words at once, in padded matrices of token ids.

Ids are numbered in the order of their merges, so that the id a pair becomes is its rank.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

NONE = np.int32(np.iinfo(np.int32).max)  # rank of a pair that is no token
CELLS = 1 << 19  # ids of a matrix


class PairTable:
    """Rank of a pair of token ids, by hashing with linear probes; whole arrays are looked up at once."""

    _TIMES = np.uint64(0x9E3779B97F4A7C15)
    _EMPTY = np.int64(-1)

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        self._bits = max(4, int(4 * len(rank)).bit_length())
        self._key = np.full(1 << self._bits, self._EMPTY)
        self._rank = np.full(1 << self._bits, NONE, dtype=np.int32)
        key = self._keys(left, right)
        slot = self._slots(key)
        while len(key):  # the first of each free slot settles, the others go on to the next slot
            first = np.zeros(len(key), dtype=bool)
            first[np.unique(slot, return_index=True)[1]] = True
            settled = first & (self._key[slot] == self._EMPTY)
            self._key[slot[settled]], self._rank[slot[settled]] = key[settled], rank[settled]
            key, rank, slot = key[~settled], rank[~settled], slot[~settled] + 1 & (1 << self._bits) - 1

    @staticmethod
    def _keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return left.astype(np.int64) << 32 | right.astype(np.int64)

    def _slots(self, key: np.ndarray) -> np.ndarray:
        return (key.view(np.uint64) * self._TIMES >> np.uint64(64 - self._bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the pairs, NONE where a pair is no token or an id is missing (below 0)."""
        out = np.full(left.shape, NONE, dtype=np.int32)
        at = np.flatnonzero((left >= 0) & (right >= 0))
        key = self._keys(left.ravel()[at], right.ravel()[at])
        slot = self._slots(key)
        while len(at):
            held = self._key[slot]
            hit = held == key
            out.ravel()[at[hit]] = self._rank[slot[hit]]
            on = ~hit & (held != self._EMPTY)
            at, key, slot = at[on], key[on], slot[on] + 1 & (1 << self._bits) - 1
        return out


def merge_rows(pairs: PairTable, ids: np.ndarray) -> list[bytes]:
    """Ids of each row (-1 after its end) when its leftmost pair of the least rank is merged until none is left."""
    out: list[bytes] = [b""] * len(ids)
    for names, done in _finished(pairs, ids):
        held = done >= 0
        raw, ends = done[held].tobytes(), np.cumsum(held.sum(axis=1) * ids.itemsize).tolist()
        for name, begin, end in zip(names.tolist(), [0, *ends], ends, strict=False):
            out[name] = raw[begin:end]
    return out


def merge_matrix(pairs: PairTable, ids: np.ndarray) -> np.ndarray:
    """What merge_rows makes, as a matrix with -1 after the end of a row."""
    out = np.full_like(ids, -1)
    for names, done in _finished(pairs, ids):
        out[names, :done.shape[1]] = done
    return out


def _finished(pairs: PairTable, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows without a pair left, with their numbers. In a round every row merges one pair and the matrix loses a column."""
    names = np.arange(len(ids))
    rank = pairs.ranks(ids[:, :-1], ids[:, 1:])
    while True:
        n, places = rank.shape
        at = rank.argmin(axis=1) if places else np.zeros(n, dtype=np.int64)
        least = rank[np.arange(n), at] if places else np.full(n, NONE)
        over = least == NONE
        yield names[over], ids[over]
        if over.all():
            return
        ids, rank, at, least, names = ids[~over], rank[~over], at[~over], least[~over], names[~over]
        row, place = np.arange(len(names)), np.arange(places)
        ids = np.take_along_axis(ids, place + (place > at[:, None]), axis=1)
        ids[row, at] = least
        rank = np.take_along_axis(rank, place[:-1] + (place[:-1] >= at[:, None]), axis=1)
        for side in (at - 1, at):  # the pairs that hold the new token
            ok = (side >= 0) & (side < places - 1)
            r, c = row[ok], side[ok]
            rank[r, c] = pairs.ranks(ids[r, c], ids[r, c + 1])


def width_for(size: int) -> int:
    """Columns for a match of ``size`` bytes: the size up to 8, then the next half or whole power of two."""
    if size <= 8:
        return size
    top = 1 << (size - 1).bit_length()
    return top * 3 // 4 if size <= top * 3 // 4 else top

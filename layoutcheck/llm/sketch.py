"""A count-min sketch in slices: each block of rows sends the cells it hits, owners of slices add them up.

A cell's counter ends as one bit, "hit twice or more", for that is all the
prefilter asks. A key's estimate is the least of its cells, so a key that two
documents have always passes; some others pass too.
"""

import numpy as np

ROWS = 2
SLICE = 20  # log2 of the cells in a slice
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xE7037ED1A0B428DB], np.uint64)


def width_bits(keys: float, most_bytes: int) -> int:
    """log2 of the cells in a row: 1.5 cells a key, within the stated memory for all rows together."""
    most = int(np.log2(most_bytes * 8 // ROWS))
    return int(min(max(np.ceil(np.log2(max(keys * 1.5, 1))), SLICE), most))


def cells(keys: np.ndarray, row: int, bits: int) -> np.ndarray:
    return ((keys * MULTIPLIERS[row]) >> np.uint64(64 - bits)).astype(np.uint32)


def pack(ascending: np.ndarray) -> bytes:
    """Ascending integers as gaps in bytes; 255 adds 255 and goes on."""
    gaps = np.diff(ascending.astype(np.int64), prepend=0)
    more, rest = np.divmod(gaps, 255)
    out = np.full(len(gaps) + int(more.sum()), 255, np.uint8)
    out[np.cumsum(more + 1) - 1] = rest
    return out.tobytes()


def unpack(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(blob, np.uint8)
    return np.cumsum(raw, dtype=np.int64)[raw < 255]


def block(keys: np.ndarray, bits: int):
    """(slice, cells hit once, cells hit more often) of a block's keys; slices count on over the rows."""
    each = 1 << (bits - SLICE)
    for row in range(ROWS):
        hit = np.sort(cells(keys, row, bits))
        if not len(hit):
            continue
        new = np.empty(len(hit), bool)
        new[0] = True
        np.not_equal(hit[1:], hit[:-1], out=new[1:])
        at = np.flatnonzero(new)
        often = np.diff(at, append=len(hit)) > 1
        hit = hit[at]
        cuts = np.searchsorted(hit, np.arange(each + 1, dtype=np.int64) << SLICE)
        for i in range(each):
            low, high = cuts[i], cuts[i + 1]
            if low < high:
                own, twice = hit[low:high] - np.uint32(i << SLICE), often[low:high]
                yield row * each + i, pack(own[~twice]), pack(own[twice])


def add(count: np.ndarray, once, twice) -> None:
    """Adds a block's cells to a slice's counters, which stop at 2."""
    own = unpack(once)
    count[own] = np.minimum(count[own], 1) + 1
    count[unpack(twice)] = 2


def bits(count: np.ndarray) -> bytes:
    """A bit for each cell of a slice, set if all blocks together hit it twice or more."""
    return np.packbits(count >= 2).tobytes()


def passes(keys: np.ndarray, bits: int, sketch: np.ndarray) -> np.ndarray:
    """Whether a key's estimated count is two or more. sketch: all slices' bits, ROWS by cells."""
    out = np.ones(len(keys), bool)
    for row in range(ROWS):
        left = np.flatnonzero(out)
        at = cells(keys[left], row, bits)
        byte = sketch[row, at >> np.uint32(3)]
        out[left] = (byte >> (7 - (at & np.uint32(7))).astype(np.uint8)) & 1 == 1
    return out

"""Words of whole texts as numpy arrays of 64-bit hashes.

A word is a run of bytes other than space and \\x09-\\x0D, the same words that
``bytes.split()`` gives. All work is done on the UTF-8 bytes of many texts at
once; words and windows never cross from one text into the next.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are hashed in pieces of about so many bytes, cut at white space.
PIECE = 1 << 18

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose bits all depend on all bits of x."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def column(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null counts as an empty text."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = array.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    data = array.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word."""
    word = ~_SPACE[data]
    before = np.zeros(len(word), bool)
    before[1:] = word[:-1]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    before[edges] = False
    starts = np.flatnonzero(word & ~before)
    after = np.zeros(len(word), bool)
    after[:-1] = word[1:]
    after[edges - 1] = False
    return starts, np.flatnonzero(word & ~after) + 1


def _factors(n: int, salt: int) -> np.ndarray:
    """Odd pseudo-random numbers, one for each place."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_ODD[salt])) | np.uint64(1)


def _hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int) -> np.ndarray:
    """Hash of each span: its pieces of eight bytes, each mixed by itself and weighted by its place, and its length.

    Mixing first is what a polynomial modulo 2**64 lacks: for any odd base, that has short strings which collide.
    """
    eight = np.ndarray((len(data),), "<u8", np.concatenate((data, np.zeros(8, np.uint8))), strides=(1,))
    length, seed = ends - starts, np.uint64(_ODD[1 - salt])
    factor = _factors(int((length.max() + 7) >> 3), salt)
    out = mix((eight[starts] & _MASKS[np.minimum(length, 8)]) ^ seed) * factor[0]
    long = np.flatnonzero(length > 8)
    if len(long):
        count = (length[long] - 1) >> 3  # pieces after the first
        first = np.cumsum(count) - count
        place = np.arange(int(count.sum())) - np.repeat(first, count) + 1
        own = np.repeat(long, count)
        piece = eight[starts[own] + 8 * place] & _MASKS[np.minimum(length[own] - 8 * place, 8)]
        out[long] += np.add.reduceat(mix(piece ^ seed) * factor[place], first)
    return mix(out + length.astype(np.uint64) * np.uint64(_ODD[salt]))


def hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = False, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, index of every text's first word and of the end). salt: 0 or 1, for two independent hashes."""
    if lower:
        data = _LOWER[data]
    starts, ends = spans(data, offsets)
    first = np.searchsorted(starts, offsets)
    out, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):  # pieces end between words; a longer word is a piece of its own
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + 2 * PIECE, "right")))
        low = starts[i]
        out[i:j] = _hash_spans(data[low : ends[j - 1]], starts[i:j] - low, ends[i:j] - low, salt)
        i = j
    return out, first


def run_hashes(h: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hash of every run of k hashes: runs of 1, 2, 4, ... are joined two by two, and those that make up k one after another."""
    factor = _factors(2 * k.bit_length(), salt)
    out = np.empty(max(0, len(h) - k + 1), np.uint64)

    def join(a, b, by):
        a = a * by
        a += b
        a ^= a >> np.uint64(32)
        return a

    for low in range(0, len(out), PIECE):
        block = h[low : low + PIECE + k - 1]
        n, done, whole = len(block) - k + 1, 0, None
        for bit in range(k.bit_length()):
            size = 1 << bit
            if k & size:
                part = block[done : done + n]
                whole = part if whole is None else join(whole, part, factor[2 * bit])
                done += size
            if 2 * size <= k:
                block = join(block[:-size], block[size:], factor[2 * bit + 1])
        out[low : low + n] = mix(whole)
    return out


def windows(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, position in the text) of every run of k words inside one text."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    runs = run_hashes(h, k)
    at = np.flatnonzero(text[: len(runs)] == text[k - 1 : k - 1 + len(runs)])
    return runs[at], text[at], at - first[text[at]]


def chunks(batch: pa.RecordBatch, text: str, most: int = 2 * PIECE):
    """The batch in runs of rows with at most so many bytes of text, one row at least."""
    lengths = np.asarray(pc.binary_length(batch.column(text)).fill_null(0))
    low, size = 0, 0
    for i, n in enumerate(lengths):
        if size + n > most and i > low:
            yield batch.slice(low, i - low)
            low, size = i, 0
        size += int(n)
    if low < batch.num_rows:
        yield batch.slice(low)

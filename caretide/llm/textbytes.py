"""Numpy helpers over the UTF-8 bytes of a batch of texts, taken from the Arrow buffers without a copy per text."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Odd multiplier of the rolling hashes and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Random value of each byte (fixed seed): neighbouring byte values get unrelated ones.
BYTE_VALUE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(of: int, n: int) -> np.ndarray:
    """of^0 .. of^(n-1) modulo 2^64."""
    out = np.full(max(n, 1), of, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS: dict[int, np.ndarray] = {}


def cached_powers(of: int, n: int) -> np.ndarray:
    if len(_POWERS.get(of, ())) < n:
        _POWERS[of] = powers(of, max(n, 1 << 16))
    return _POWERS[of][:n]


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array and the offsets of its texts; null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(offsets) else data[:0], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``most`` bytes of text; a longer text is a piece of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def _next_space(data: np.ndarray, at: int) -> int:
    found = np.flatnonzero(SPACE[data[at:]])
    return at + int(found[0]) if len(found) else len(data)


#: ASCII white space: the separators of words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32


#: A single text longer than this is cut at white space while it is hashed.
LONG = 4 << 20


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the white-space separated, A-Z lowered words of all texts in order, and the number of words in
    each text."""
    n = len(data)
    if n > LONG and len(offsets) == 2:
        cuts = [0]
        while cuts[-1] < n:
            spaces = np.flatnonzero(SPACE[data[cuts[-1] + LONG // 4 : cuts[-1] + LONG]])
            cuts.append(min(n, cuts[-1] + LONG // 4 + int(spaces[0]) if len(spaces) else _next_space(data, cuts[-1] + LONG)))
        parts = [_hashes(data[a:b], np.array([0, b - a]))[0] for a, b in zip(cuts, cuts[1:], strict=False)]
        return np.concatenate(parts), np.array([sum(map(len, parts))])
    return _hashes(data, offsets)


def _hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    inside = ~SPACE[data]
    edge = np.zeros(n + 1, bool)  # a new text starts a new word
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(BYTE_VALUE[LOWERED[data]] * cached_powers(INVERSE, n), out=sums[1:])
    hashes = mixed((sums[ends] - sums[starts]) * cached_powers(BASE, n)[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.diff(np.searchsorted(starts, offsets))

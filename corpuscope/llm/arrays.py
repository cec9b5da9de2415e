"""Texts as one buffer of bytes, and hashes of its spans, words and shingles, in NumPy."""

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes that are hashed at once; bounds what the helper arrays take.
SEGMENT = 1 << 20
_random = np.random.default_rng(20_240_607)
BYTE_VALUES = _random.integers(1 << 63, size=256, dtype=U64) * U64(2) + U64(1)
MULTIPLIER = int(_random.integers(1 << 62)) * 8 + 5
INVERSE = pow(MULTIPLIER, -1, 1 << 64)
MIX, MIX2 = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
VISIBLE = np.ones(256, dtype=bool)
VISIBLE[[9, 10, 11, 12, 13, 32]] = False

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base ** 2, ... modulo 2 ** 64; kept for the next call."""
    held = _powers.get(base)
    if held is None or len(held) < n:
        held = np.full(max(n, 1), base & (2 ** 64 - 1), dtype=U64)
        held[0] = 1
        held = _powers[base] = np.cumprod(held, dtype=U64)
    return held[:n]


def mixed(x: np.ndarray, by=MIX) -> np.ndarray:
    """Spread the bits of hashes over all of their 64."""
    x = (x ^ (x >> U64(32))) * by
    return x ^ (x >> U64(29))


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values; many times faster on hashes than the library's own."""
    ordered = np.sort(values)
    return ordered[np.concatenate([[True], ordered[1:] != ordered[:-1]])] if len(ordered) else ordered


def buffer_of(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a column without nulls end to end, and their n + 1 offsets."""
    whole = pa.concat_arrays([c.cast(pa.large_binary()) for c in column.chunks] or [pa.array([], pa.large_binary())])
    if not len(whole):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = whole.buffers()
    places = np.frombuffer(offsets, np.int64)[whole.offset:whole.offset + len(whole) + 1]
    held = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return held[places[0]:places[-1]], places - places[0]


class Spans:
    """Hashes of spans of one segment of bytes, each by two look-ups in sums of hashed bytes."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, dtype=U64)
        np.cumsum(BYTE_VALUES[data] * powers(MULTIPLIER, len(data)), out=self.sums[1:])

    def hashes(self, starts, ends) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * powers(INVERSE, len(self.sums))[starts])

    def grams(self, k: int) -> np.ndarray:
        """Hash of each k bytes in a row."""
        n = len(self.sums) - k
        return mixed((self.sums[k:] - self.sums[:n]) * powers(INVERSE, n)) if n > 0 else np.zeros(0, U64)


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (a run of visible characters, A-Z lowered), and each text's places among them."""
    visible = VISIBLE[data]
    inner = np.ones(len(data) + 1, dtype=bool)
    inner[offsets] = False  # a text begins or ends here
    before = np.zeros(len(data), dtype=bool)
    before[1:] = visible[:-1] & inner[1:-1]
    starts = np.flatnonzero(visible & ~before)
    after = np.zeros(len(data), dtype=bool)
    after[:-1] = visible[1:] & inner[1:-1]
    ends = np.flatnonzero(visible & ~after) + 1
    hashes = np.empty(len(starts), dtype=U64)
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, np.searchsorted(starts, starts[lo] + SEGMENT))
        first = starts[lo]
        spans = Spans(LOWER[data[first:ends[hi - 1]]])
        hashes[lo:hi] = spans.hashes(starts[lo:hi] - first, ends[lo:hi] - first)
        lo = hi
    return hashes, np.searchsorted(starts, offsets)


def shingle_sets(hashes: np.ndarray, places: np.ndarray, size: int):
    """For each text its distinct shingles, sorted; with fewer words, one for all of them."""
    n = len(hashes) - size + 1
    rolled = np.zeros(max(n, 0), dtype=U64)
    for j in range(size):
        rolled = rolled * MIX2 + hashes[j:j + len(rolled)]
    rolled = mixed(rolled)
    for a, b in zip(places[:-1], places[1:]):
        if b - a >= size:
            yield distinct(rolled[a:b - size + 1])
        elif b > a:
            short = np.array([b - a], dtype=U64)
            for h in hashes[a:b]:
                short = short * MIX2 + h
            yield mixed(short, MIX2)
        else:
            yield np.zeros(0, U64)


def packed(values: np.ndarray) -> bytes:
    """Unsigned numbers in as few bytes as the largest needs."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    return bytes([width]) + np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpacked(blob: bytes) -> np.ndarray:
    width = blob[0]
    narrow = np.frombuffer(blob, np.uint8, offset=1).reshape(-1, width)
    wide = np.zeros((len(narrow), 8), np.uint8)
    wide[:, :width] = narrow
    return wide.view("<u8").ravel().astype(U64, copy=False)


def packed_sorted(values: np.ndarray) -> bytes:
    return packed(np.diff(values, prepend=U64(0)))


def unpacked_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpacked(blob), dtype=U64)

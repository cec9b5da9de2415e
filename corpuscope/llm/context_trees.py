"""Context-tree weighting over bytes: a tree for every node of a byte's eight binary decisions.

A gram is a byte with the ``depth`` bytes before it, written as one number: the nearest byte of the
context highest, the byte itself lowest, so that a shorter context is a prefix of the number.
"""

import numpy as np

from corpuscope.llm.arrays import U64, mixed

#: Stands before and after a text; UTF-8 never has it.
EDGE = 0xFF
#: Contexts of at most this length are put together from all buckets; longer ones stay in one.
SHALLOW = 2
LOG_HALF = float(np.log(0.5))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, from at least 8 upwards by the recurrence."""
    x = x.astype(np.float64)
    shift = np.zeros_like(x)
    for _ in range(8):
        low = x < 8
        shift[low] += np.log(x[low])
        x[low] += 1
    inverse = 1 / x
    series = inverse * (1 / 12 - inverse ** 2 * (1 / 360 - inverse ** 2 * (1 / 1260 - inverse ** 2 / 1680)))
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + series - shift


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Krichevsky-Trofimov probability of a sequence with so many zeros and ones."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1) - np.log(np.pi)


def weigh(zeros, ones, below):
    """Log weighted probability of inner nodes, and the share of their own estimate in it."""
    own = log_kt(zeros, ones)
    weighted = LOG_HALF + np.logaddexp(own, below)
    return weighted, np.exp(LOG_HALF + own - weighted)


def segments(data: np.ndarray, offsets: np.ndarray, depth: int, size: int):
    """(first text, last + 1 text, grams, n + 1 offsets of the texts' grams), some ``size`` bytes at a time.

    A text has a gram for each byte and one for its end."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        texts = [data[a:b].tobytes() for a, b in zip(offsets[lo:hi], offsets[lo + 1:hi + 1])]
        edge = bytes([EDGE])
        padded = np.frombuffer(edge * depth + (edge * (depth + 1)).join(texts) + edge, np.uint8).astype(U64)
        grams = padded[depth:].copy()
        for j in range(1, depth + 1):
            grams |= padded[depth - j:-j] << U64(8 * (depth + 1 - j))
        lengths = np.diff(offsets[lo:hi + 1]) + 1
        ends = np.cumsum(lengths)
        keep = np.ones(len(grams), dtype=bool)
        gaps = ends[:-1] + depth * np.arange(hi - lo - 1)
        keep[(gaps[:, None] + np.arange(depth)).ravel()] = False
        yield lo, hi, grams[keep], np.concatenate([[0], ends])
        lo = hi


def added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of several blocks, in order, with the sums of their counts."""
    if not keys:
        return np.zeros(0, U64), np.zeros(0, U64)
    all_keys, all_counts = np.concatenate(keys), np.concatenate(counts).astype(U64)
    order = np.argsort(all_keys)
    all_keys = all_keys[order]
    at = np.flatnonzero(np.concatenate([[True], all_keys[1:] != all_keys[:-1]])) if len(all_keys) else np.zeros(0, np.int64)
    return all_keys[at], np.add.reduceat(all_counts[order], at) if len(at) else np.zeros(0, U64)


def bucket_of(grams: np.ndarray, depth: int, buckets: int) -> np.ndarray:
    """Bucket of a gram by the three nearest bytes of its context, so that a bucket has whole subtrees."""
    return mixed(grams >> U64(8 * (depth - SHALLOW))) % U64(buckets)


class Tree:
    """The subtrees of one bucket, from grams (in order, each once) and their counts in training.

    For every depth above ``SHALLOW`` each of the eight decisions of a gram points to a node: its zeros,
    ones, weighted log probability and own share."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, depth: int):
        symbol = grams & U64(255)
        place = np.arange(8, dtype=U64)
        self.bits = ((symbol[:, None] >> (U64(7) - place)) & U64(1)).astype(np.int64)
        self.nodes = (U64(1) << place) | (symbol[:, None] >> (U64(8) - place))
        self.levels: dict[int, tuple] = {}
        weight = np.repeat(counts.astype(np.float64), 8)
        ones = self.bits.ravel() == 1
        below = None
        for d in range(depth, SHALLOW, -1):
            ids = ((grams >> U64(8 * (depth + 1 - d)))[:, None] << U64(8) | self.nodes).ravel()
            found, inverse = np.unique(ids, return_inverse=True)
            total = np.bincount(inverse, weights=weight, minlength=len(found))
            one = np.bincount(inverse, weights=weight * ones, minlength=len(found))
            if below is None:
                weighted, share = log_kt(total - one, one), np.ones(len(found))
            else:
                ids_below, weighted_below = below
                # drop the farthest byte of the context below: its parent here
                parent = np.searchsorted(found, (ids_below >> U64(16) << U64(8)) | (ids_below & U64(255)))
                weighted, share = weigh(total - one, one, np.bincount(parent, weights=weighted_below, minlength=len(found)))
            below = (found, weighted)
            self.levels[d] = (inverse.ravel(), total, one, share)
        self.top = (below[0], total - one, one, weighted)

    def log10_probabilities(self, shallow: "Shallow", contexts: np.ndarray) -> np.ndarray:
        """Of each gram; ``contexts`` holds its two nearest bytes.

        The mixture runs over all depths that training has seen on the way to the gram."""
        bits = self.bits.ravel()
        value = np.full(len(bits), 0.5)
        seen = np.zeros(len(bits), dtype=bool)
        for d in sorted(self.levels, reverse=True):
            inverse, total, one, share = self.levels[d]
            value, seen = mix(value, seen, bits, total[inverse], one[inverse], share[inverse])
        for d in range(SHALLOW, -1, -1):
            value, seen = mix(value, seen, bits, *shallow.look_up(d, contexts, self.nodes))
        return np.log10(value).reshape(-1, 8).sum(axis=1)


def mix(value, seen, bits, total, one, share):
    own = (np.where(bits == 1, one, total - one) + 0.5) / (total + 1)
    here = total > 0
    return np.where(here, np.where(seen, share * own + (1 - share) * value, own), value), seen | here


class Shallow:
    """Nodes of contexts of up to two bytes: at most 65,793 contexts of 255 nodes each."""

    def __init__(self, levels: dict[int, tuple]):
        self.levels = levels  # depth: (node ids in order, total, one, share)

    def look_up(self, depth: int, contexts: np.ndarray, nodes: np.ndarray):
        ids, total, one, share = self.levels[depth]
        wanted = ((contexts >> U64(8 * (SHALLOW - depth)))[:, None] << U64(8) | nodes).ravel()
        if not len(ids):
            return np.zeros(len(wanted)), np.zeros(len(wanted)), np.zeros(len(wanted))
        at = np.minimum(np.searchsorted(ids, wanted), len(ids) - 1)
        known = ids[at] == wanted
        return np.where(known, total[at], 0), np.where(known, one[at], 0), np.where(known, share[at], 0)


def parents(ids, zeros, ones, weighted):
    """One level up: the nodes of the context without its farthest byte."""
    up = (ids >> U64(16) << U64(8)) | (ids & U64(255))
    found, inverse = np.unique(up, return_inverse=True)
    zeros, ones, below = (np.bincount(inverse, weights=w, minlength=len(found)) for w in (zeros, ones, weighted))
    weighted, share = weigh(zeros, ones, below)
    return found, zeros, ones, weighted, share


class Lookup:
    """Values by key in a table of open addresses; every key that is asked for must be there."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(4 * len(keys)).bit_length())
        self.keys, self.values, self.shift, self.mask = keys, values, U64(64 - bits), (1 << bits) - 1
        self.slots = np.full(1 << bits, -1, dtype=np.int32)
        place = (mixed(keys) >> self.shift).astype(np.int64)
        rest = np.arange(len(keys), dtype=np.int32)
        while len(rest):
            at = place[rest]
            free = self.slots[at] < 0
            self.slots[at[free]] = rest[free]
            rest = rest[self.slots[at] != rest]
            place[rest] = (place[rest] + 1) & self.mask

    def __call__(self, wanted: np.ndarray) -> np.ndarray:
        place = (mixed(wanted) >> self.shift).astype(np.int64)
        found = self.slots[place]
        rest = np.flatnonzero(self.keys[found] != wanted)
        while len(rest):
            place[rest] = (place[rest] + 1) & self.mask
            found[rest] = self.slots[place[rest]]
            rest = rest[self.keys[found[rest]] != wanted[rest]]
        return self.values[found]

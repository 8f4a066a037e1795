"""Vectorised words, hashes and n-grams of a column of texts."""
import numpy as np

from .common import text_buffers

_WORD_SPACE = np.zeros(256, bool)
_WORD_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C1B)
#: positions that are hashed at once
PIECE = 1 << 18


def _powers(n: int, step: np.uint64 = _STEP) -> np.ndarray:
    out = np.full(n, step, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POWERS = _powers(PIECE)
#: powers of the step's inverse modulo 2^64
_BACK = _powers(PIECE, np.uint64(pow(int(_STEP), -1, 1 << 64)))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input moves every bit of the output."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Per run, the sum of its values times the powers of their places in it: a difference of running sums, moved to the run's start."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _POWERS[: len(values)], out=total[1:])
    return (total[ends] - total[starts]) * _BACK[starts]


def run_hashes(values, inside: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of runs: values are 64-bit codes, or a function that makes those of a slice; inside marks the runs' positions.

    The arrays beside the input are of one piece of PIECE positions, however long the input or a run is.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    code = values if callable(values) else (lambda a, b: values[a:b])
    sums = np.zeros(len(starts), np.uint64)
    for a in range(0, len(inside), PIECE):
        b = min(a + PIECE, len(inside))
        lo, hi = np.searchsorted(ends, a, "right"), np.searchsorted(starts, b, "left")
        if lo == hi:
            continue
        part = _sums(code(a, b), np.maximum(starts[lo:hi], a) - a, np.minimum(ends[lo:hi], b) - a)
        if starts[lo] < a:  # the run began in a piece before
            part[:1] *= np.array([pow(int(_STEP), int(a - starts[lo]), 1 << 64)], np.uint64)
        sums[lo:hi] += part
    return mix(sums ^ (ends - starts).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))


class Words:
    """Words [^\\x20\\x09-\\x0D]+ of a string column: spans in `data`, hashes, and the first word of each row."""

    def __init__(self, column, lower: bool = False, hashes: bool = True, fold: np.ndarray | None = None):
        """fold: a table of 256 bytes that is applied first, instead of lower's."""
        data, offs = text_buffers(column)
        if lower or fold is not None:
            data = (_LOWER if fold is None else fold)[data]
        self.data, self.offs, self.rows = data, offs, len(offs) - 1
        inside = ~_WORD_SPACE[data]
        edge = np.empty(len(data), bool)  # a word's first byte: inside, and the byte before is not, or is another row's
        if len(data):
            edge[0] = inside[0]
            np.greater(inside[1:], inside[:-1], out=edge[1:])
            heads = offs[:-1][offs[:-1] < len(data)]
            edge[heads] = inside[heads]
        self.inside = inside
        self.starts = np.flatnonzero(edge)
        if len(data):
            edge[-1] = inside[-1]
            np.greater(inside[:-1], inside[1:], out=edge[:-1])
            tails = offs[1:][offs[1:] > 0] - 1
            edge[tails] = inside[tails]
        self.ends = np.flatnonzero(edge) + 1
        del edge
        self.first = np.searchsorted(self.starts, offs)
        self.counts = np.diff(self.first)
        self.row = np.repeat(np.arange(self.rows), self.counts)
        self.hash = run_hashes(lambda a, b: _BYTE[data[a:b]], inside, self.starts, self.ends) if hashes else None

    def normal(self):
        """(bytes, starts, ends): the same words with one space between words of a row."""
        keep = self.inside.copy()
        joined = self.row[1:] == self.row[:-1] if len(self.row) else np.zeros(0, bool)
        keep[self.ends[:-1][joined]] = True  # the gap behind a word that has a next one in its row
        sizes = self.ends - self.starts
        ends = np.cumsum(sizes)
        ends[1:] += np.cumsum(joined)
        out = self.data[keep]
        out[ends[:-1][joined]] = 0x20
        return out.tobytes(), ends - sizes, ends


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every n consecutive items (rows are not kept apart)."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(size, np.uint64)
    for j in range(n):
        out *= _STEP
        out += hashes[j : j + size]
    return mix(out)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` consecutive values, by doubling."""
    if len(x) < width:
        return x[:0]
    size, span = len(x) - width + 1, 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[:size], x[width - span : width - span + size]) if span < width else x[:size]


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, lengths) of equal neighbours."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1])
    return starts, np.diff(np.append(starts, len(keys)))


def dealt(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of a hash, by its top bits, in the order of the hashes."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)

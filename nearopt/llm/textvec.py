"""Vectorised text primitives over Arrow string columns.

Everything here works on the UTF-8 buffers that Arrow hands to a Python worker, so no Python object is
made per word.  Slices are bounded in bytes; a single text longer than a slice is walked in pieces that end
at ASCII white space, so the temporary arrays stay bounded however long a text is.
"""

from __future__ import annotations

import ctypes
import functools

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_MIX = _rng.integers(0, 2**64, 8, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 2**64))
#: ASCII white space, as in the word pattern [^\x20\x09-\x0D]+
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: A-Z to a-z; every other byte stays
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


_powers = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64; kept up to a bounded length."""
    kept = _powers.get(int(base))
    if kept is None or len(kept) < n:
        kept = np.full(max(n, 1 << 16), base, np.uint64)
        kept[0] = 1
        np.multiply.accumulate(kept, out=kept)
        if n <= 4 * SLICE_BYTES:
            _powers[int(base)] = kept
    return kept[:n]


def splitmix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection on 64-bit words."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def as_strings(column) -> pa.Array:
    """A column of a batch as one plain array of large strings; nulls become empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_string()).fill_null("")


def buffers(strings: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a large-string array; offsets start at 0."""
    n = len(strings)
    if not n:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = strings.buffers()
    offsets = np.frombuffer(off, np.int64)[strings.offset : strings.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(strings: pa.LargeStringArray, limit: int = SLICE_BYTES):
    """Row ranges [a, b) whose texts together hold about `limit` bytes; at least one row each."""
    _, offsets = buffers(strings)
    a, n = 0, len(strings)
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def _cuts(raw: np.ndarray, limit: int) -> list[int]:
    """Positions that cut raw into pieces of about `limit` bytes, each cut before a white-space byte."""
    out, at = [0], 0
    while len(raw) - at > limit:
        end, step = at + limit, 1 << 16
        while end < len(raw):
            hit = np.flatnonzero(_SPACE[raw[end : end + step]])
            if len(hit):
                end += int(hit[0])
                break
            end += step
        end = min(end, len(raw))
        if end >= len(raw):
            break
        out.append(end)
        at = end
    return [*out, len(raw)]


def _words_of(raw: np.ndarray, breaks: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of the words of raw; `breaks` are positions at which a word ends in any case."""
    n = len(raw)
    word = ~_SPACE[raw]
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    inner = breaks[(breaks > 0) & (breaks < n)]
    if len(inner):
        first[inner] |= word[inner]
        last[inner - 1] |= word[inner - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(start):
        return start, end, np.empty(0, np.uint64)
    run = np.empty(n + 1, np.uint64)
    run[0] = 0
    np.cumsum(_BYTE[_LOWER[raw] if lower else raw] * powers(_BASE, n), out=run[1:])
    back = powers(_BASE_INV, n)
    hashed = (run[end] - run[start]) * back[start]
    return start, end, splitmix(hashed ^ ((end - start).astype(np.uint64) * _MIX[7]))


def words(strings: pa.LargeStringArray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): the 64-bit hash of each word, and for text i the range bounds[i]:bounds[i+1] of its words.

    Words are [^\\x20\\x09-\\x0D]+; with lower, A-Z count as a-z.  Equal words have equal hashes everywhere.
    """
    raw, offsets = buffers(strings)
    hashes, counts = [], np.zeros(len(strings) + 1, np.int64)
    cuts = _cuts(raw, 2 * SLICE_BYTES)
    for a, b in zip(cuts, cuts[1:]):
        start, _, h = _words_of(raw[a:b], offsets[(offsets > a) & (offsets < b)] - a, lower)
        hashes.append(h)
        upto = np.searchsorted(start + a, offsets[1:], "left")
        counts[1:] += np.diff(upto, prepend=0)
    return (np.concatenate(hashes) if hashes else np.empty(0, np.uint64)), np.cumsum(counts)


def shingles(hashes: np.ndarray, bounds: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds) of the word shingles of each text, repeats included.

    A text with fewer than `width` words but at least one has its whole sequence as its only shingle; a text
    without words has none.
    """
    size = np.diff(bounds)
    count = np.where(size >= width, size - width + 1, np.minimum(size, 1))
    out = np.concatenate([[0], np.cumsum(count)])
    if not out[-1]:
        return np.empty(0, np.uint64), out
    text = np.repeat(np.arange(len(size)), count)
    at = np.arange(out[-1]) - out[text] + bounds[text]
    span = np.minimum(size, width)[text]
    top = max(len(hashes) - 1, 0)
    mixed = np.zeros(len(at), np.uint64)
    for k in range(width):
        part = hashes[np.minimum(at + k, top)] * _MIX[k]
        mixed += np.where(k < span, part ^ (part >> np.uint64(29)), np.uint64(0)) * _MIX[(k + 3) % 7]
    return splitmix(mixed + span.astype(np.uint64) * _MIX[6]), out


def distinct(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct hashes of each text, and their bounds."""
    parts, count = [], np.zeros(len(bounds) - 1, np.int64)
    for i in range(len(bounds) - 1):
        if bounds[i] < bounds[i + 1]:
            own = np.sort(hashes[bounds[i] : bounds[i + 1]])
            own = own[np.concatenate([[True], own[1:] != own[:-1]])]
            parts.append(own)
            count[i] = len(own)
    return (np.concatenate(parts) if parts else np.empty(0, np.uint64)), np.concatenate([[0], np.cumsum(count)])


def trimmed(function):
    """A function of batches whose worker gives its freed memory back when a task ends: workers live on from stage to
    stage, and an executor's memory is that of all of them."""

    @functools.wraps(function)
    def run(batches):
        try:
            yield from function(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library
                pass

    return run

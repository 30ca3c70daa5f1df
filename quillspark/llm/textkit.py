"""Vectorised text work on Arrow batches: UTF-8 buffers, words, names, hashes, window minima, intervals.

Polynomial hashes (`window_hashes`) only deal rows out: sequences can be made that collide in them. What
decides a result is a name: words and windows of a batch are numbered by their own bytes, so names are equal exactly
where the sequences are. Hashes of words that must agree between tasks are keyed and without linear structure; they find
candidates, and never decide.

Memory: texts are taken up in pieces of PIECE bytes. One longer text takes about 25 bytes of memory a byte where words
are cut (a text of 20 MB: 0.5 GB in the worker); where bytes are the units, it is cut into overlapping slices.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import cache, wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U = np.uint64
#: Bytes of text worked on at once; one longer text is still taken whole.
PIECE = 1 << 20
SEED = 0x5EED0F9
LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=U)

WHITE = np.ones(256, dtype=bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = False
#: Word bytes of the pattern [^\x20\x09-\x0D]+; bytes of multi-byte characters are all word bytes.
SPACED_WORD = WHITE

ALNUM_WORD = np.zeros(256, dtype=bool)
ALNUM_WORD[0x30:0x3A] = ALNUM_WORD[0x41:0x5B] = ALNUM_WORD[0x61:0x7B] = ALNUM_WORD[0x80:] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTE_CODE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
BASE_1, BASE_2 = 0x9E3779B97F4A7C15 | 1, 0xD1B54A32D192ED03 | 1
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        x = np.full(max(n, 1), base % (1 << 64), dtype=U)
        x[0] = 1
        have = np.multiply.accumulate(x)
        if n <= 2 * PIECE:
            _powers[base] = have
    return have[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


@cache
def _trim() -> Callable[[int], int]:
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library
        return lambda n: 0


def tidy(run: Callable) -> Callable:
    """A function of batches that leaves its worker as small as it found it: workers are used again by later stages, and
    what allocators hold back adds up over them."""

    @wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            _powers.clear()
            pa.default_memory_pool().release_unused()
            _trim()(0)

    return wrapped


def joint(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of pairs without linear structure."""
    return mix((a ^ (a >> U(29))) * U(0x9FB21C651E98DF25) + b)


def gram_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of windows of random codes, by doubling."""
    size, out = 1, h
    while size < width and len(out):
        step = min(size, width - size)
        out = joint(out[:-step], out[step:]) if len(out) > step else out[:0]
        size += step
    return out


def window_names(names: np.ndarray, width: int) -> np.ndarray:
    """Numbers of the windows of numbered units, equal exactly for equal windows.

    Windows are sorted by hash and neighbours compared unit by unit; should two different ones share a hash, windows are
    numbered without hashes: pairs of names get numbers, doubling the width.
    """
    n = len(names) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    h = gram_hashes(mix(names.astype(U) + U(1)), width)
    order = np.argsort(h)
    new = np.ones(n, dtype=bool)
    new[1:] = h[order[1:]] != h[order[:-1]]
    a, b = order[:-1][~new[1:]], order[1:][~new[1:]]
    if all(np.array_equal(names[a + k], names[b + k]) for k in range(width)):
        out = np.empty(n, dtype=np.int64)
        out[order] = np.cumsum(new) - 1
        return out
    size, out = 1, names
    while size < width:
        step = min(size, width - size)
        out = np.unique((out[:-step].astype(U) << U(32)) | out[step:].astype(U), return_inverse=True)[1]
        size += step
    return out


def keyed_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end] without linear structure: eight bytes at a time for the first 64, by XXH3 for longer ones."""
    size = ends - starts
    h = mix(size.astype(U) + U(SEED))
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    eight = np.ndarray(len(data) + 1, dtype="<u8", buffer=padded, strides=(1,))
    own = np.arange(len(size))
    for k in range(0, 64, 8):
        own = own[size[own] > k]
        if not len(own):
            break
        h[own] = joint(h[own], eight[starts[own] + k] & LOW_BYTES[np.minimum(size[own] - k, 8)])
    for k in own[size[own] > 64].tolist():
        h[k] = xxhash.xxh3_64_intdigest(memoryview(data)[starts[k] : ends[k]], SEED)
    return h


def window_hashes(codes: np.ndarray, width: int, base: int = BASE_1) -> np.ndarray:
    n = len(codes) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=U)
    total = np.zeros(len(codes) + 1, dtype=U)
    np.cumsum(codes * powers(base, len(codes)), out=total[1:])
    return mix((total[width:] - total[:n]) * powers(inverse(base), n))


def window_min(x: np.ndarray, width: int) -> np.ndarray:
    size, out = 1, x
    while size * 2 <= width:
        out, size = np.minimum(out[:-size], out[size:]), size * 2
    if size < width:
        rest = width - size
        out = np.minimum(out[:-rest], out[rest:])
    return out


def texts(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A text column as one large_string array; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a large_string or large_binary array, and its n + 1 offsets."""
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, dtype=np.int64)
    data = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    return data, off - off[0]


def pieces(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int | None = None) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each holds at most PIECE bytes of text, or one row."""
    limit = limit or PIECE
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        at, total = 0, np.concatenate([[0], np.cumsum(size)])
        while at < len(size):
            to = max(at + 1, int(np.searchsorted(total, total[at] + limit, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to


class Words:
    """Words of all texts of a piece: bytes, starts, ends (exclusive), and the n + 1 word offsets of the texts."""

    def __init__(self, column: pa.Array, table: np.ndarray = SPACED_WORD, lower: bool = False):
        joined = pc.binary_join_element_wise(column, pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string()))
        data, off = buffer(joined)
        self.data = LOWER[data] if lower else data
        inside = np.zeros(len(data) + 1, dtype=np.int8)
        inside[1:] = table[data]
        step = np.diff(inside)
        self.starts = np.flatnonzero(step == 1)
        self.ends = np.flatnonzero(step == -1)  # each text ends with a space, so every word has an end
        self.text_starts = off[:-1]
        self.offsets = np.searchsorted(self.starts, off)
        self._names: np.ndarray | None = None
        self._hashes: np.ndarray | None = None
        self._joined: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    @property
    def names(self) -> np.ndarray:
        """Numbers of the words, equal exactly for equal words of this piece."""
        if self._names is None:
            data, starts, _ = self.joined()
            coded = binary_view(data, np.append(starts, len(data))).dictionary_encode()  # each with its space
            self._names = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        return self._names

    @property
    def hashes(self) -> np.ndarray:
        """A hash of each word that is the same everywhere."""
        if self._hashes is None:
            self._hashes = keyed_hashes(self.data, self.starts, self.ends)
        return self._hashes

    def joined(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All words, one space after each: bytes, and the starts and ends of the words in them."""
        if self._joined is None:
            self._joined = self._join()
        return self._joined

    def _join(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = self.ends - self.starts + 1
        starts = np.concatenate([[0], np.cumsum(size)])
        take = np.zeros(len(self.data) + 1, dtype=np.int8)
        take[self.starts] = 1
        take[self.ends + 1] -= 1  # the space after a word is kept; the next word may begin right behind it
        take = np.cumsum(take[:-1], dtype=np.int8).astype(bool)
        out = self.data[take].copy()
        out[starts[1:] - 1] = 0x20
        return out, starts[:-1], starts[1:] - 1


def owner(offsets: np.ndarray) -> np.ndarray:
    """For each unit, the row that owns it."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def within(offsets: np.ndarray, width: int) -> np.ndarray:
    """Starts of the windows of that width that lie in one row."""
    n = int(offsets[-1])
    ok = np.ones(n, dtype=bool)
    for k in np.unique(offsets[1:]):
        ok[max(0, k - width + 1) : k] = False
    # rows shorter than the width may have been touched by their neighbours only, which is also right
    return np.flatnonzero(ok)


def shingles(words: Words, width: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word shingles of each text, with repeats: names (equal exactly for equal shingles), hashes, and the n + 1 offsets.

    A text with fewer words has its whole sequence as one shingle; one without words has none. Short texts never
    share a name with another text here; those with equal words have equal hashes.
    """
    counts = words.counts
    short = (counts > 0) & (counts < width)
    own = np.where(short, 1, np.maximum(counts - width + 1, 0))
    offsets = np.concatenate([[0], np.cumsum(own)])
    names, codes = np.empty(int(offsets[-1]), dtype=np.int64), np.empty(int(offsets[-1]), dtype=U)
    long = own * ~short
    at = np.repeat(words.offsets[:-1] - np.concatenate([[0], np.cumsum(long)[:-1]]), long) + np.arange(int(long.sum()))
    place = np.repeat(~short, own)
    if len(at):
        names[place], codes[place] = window_names(words.names, width)[at], gram_hashes(words.hashes, width)[at]
    if short.any():
        names[~place] = len(words.starts) + np.arange(int(short.sum()))
        data, starts, ends = words.joined()
        raw = data.tobytes()
        first, last = words.offsets[:-1][short], words.offsets[1:][short] - 1
        codes[~place] = [int.from_bytes(hashlib.blake2b(raw[starts[a] : ends[b]], digest_size=8).digest(), "little") for a, b in zip(first, last, strict=True)]
    return names, codes, offsets


def distinct(names: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and names of the different units of each row, in order."""
    many = int(names.max()) + 1 if len(names) else 1
    return np.divmod(different(owner(offsets) * many + names), many)


def different(x: np.ndarray) -> np.ndarray:
    """The different values in order."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def shared(x: pa.Array, y: pa.Array, width: int = 5, table: np.ndarray = SPACED_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each pair of texts: different shingles of x, of y, and of both, told apart by their words."""
    n = len(x)
    row, name = distinct(*(lambda s: (s[0], s[2]))(shingles(Words(pa.concat_arrays([x, y]), table, lower=True), width)))
    sizes = np.bincount(row, minlength=2 * n)
    many = int(name.max()) + 1 if len(name) else 1
    both = np.sort(row % max(n, 1) * many + name)
    twice = both[1:][both[1:] == both[:-1]] // many
    return sizes[:n], sizes[n:], np.bincount(twice, minlength=n)


def gather(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """data[start:end] of all spans, one after the other, and the n + 1 offsets."""
    size = ends - starts
    offsets = np.concatenate([[0], np.cumsum(size)])
    return data[np.repeat(starts - offsets[:-1], size) + np.arange(int(offsets[-1]))], offsets


def binary_view(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A large_binary array over bytes that are there."""
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def binary_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary array from bytes and offsets; large only while building."""
    big = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())])
    return big.cast(pa.binary())


def merged(starts: np.ndarray, width: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs covered by windows that begin at sorted starts; runs of different rows stay apart: begin, end, row."""
    if not len(starts):
        e = np.zeros(0, dtype=np.int64)
        return e, e, e
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (starts[1:] > starts[:-1] + width) | (rows[1:] != rows[:-1])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:] - 1, [len(starts) - 1]])
    return starts[first], starts[last] + width, rows[first]


def union(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the union of half-open spans."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out

"""Byte-level kernels over Arrow string columns: blocks, word spans, word and shingle hashes.

The quick hash of a span only gathers what may be equal: whoever calls two spans equal compares their bytes
(``same_spans``) or takes a cryptographic hash (``digests``). All work on whole texts. A block is a run of rows of at most ``BLOCK`` bytes (one row if it is longer), so
temporary arrays stay small whatever the batch size.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_MIX1, _MIX2 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
_STEP = _U(0x9E3779B97F4A7C15)
_COMBINE = _U(0xD1342543DE82EF95)
#: Bytes from which spans are compared one by one; the first k of eight bytes.
LONG = 4096
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

#: Bytes that separate words: space and 09-0D.
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
#: Bytes of letters, digits and all non-ASCII characters.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: A-Z to a-z, all else as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_tables: dict[str, np.ndarray] = {}
_kept: dict = {}


def kept(key, make):
    """What ``make`` returned for the key, kept from task to task of a worker; one thing at a time, as memory is bounded."""
    if key not in _kept:
        forget()
        _kept[key] = make()
    return _kept[key]


def forget() -> None:
    """Drop what this worker kept for another operator, and return its memory where the C library can."""
    if _kept:
        _kept.clear()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, up to ``n`` at least."""
    if "up" not in _tables or len(_tables["up"]) < n:
        size = max(n, BLOCK + 1)
        for name, x in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            t = np.full(size, _U(x))
            t[0] = 1
            _tables[name] = np.multiply.accumulate(t)
    return _tables["up"], _tables["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> _U(30))
    x *= _MIX1
    x ^= x >> _U(27)
    x *= _MIX2
    return x ^ (x >> _U(31))


def prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial modulo 2**64: for choosing places alone, as unlike spans may well agree in it."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + _U(1)) * powers(len(data) + 1)[0][: len(data)], out=out[1:])
    return out


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its row offsets; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    if at is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def blocks(column: pa.Array, most: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets of the rows in them) for runs of rows."""
    data, at = buffers(column)
    i, n = 0, len(column)
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, j, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def word_spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that ``inside`` (by byte) marks, none across rows, and word offsets by row."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    w = inside[data]
    first, last = w.copy(), w.copy()
    first[1:] &= ~w[:-1]
    last[:-1] &= ~w[1:]
    full = offsets[1:] > offsets[:-1]
    edge = offsets[:-1][full]
    first[edge] = w[edge]
    edge = offsets[1:][full] - 1
    last[edge] = w[edge]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, zeros behind the end."""
    return np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), 0, (1,))


def same_spans(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the ``size`` bytes at ``a`` and at ``b`` are equal, for each pair of places: eight bytes at a time."""
    out, eight = np.ones(len(a), bool), _eights(data)
    live, done = np.flatnonzero((a != b) & (size > 0)), 0
    while len(live):
        if done == LONG:  # few are as long as that
            for k in live.tolist():
                x, y, n = int(a[k]), int(b[k]), int(size[k])
                out[k] = bool((data[x + done : x + n] == data[y + done : y + n]).all())
            break
        differ = eight[a[live] + done] ^ eight[b[live] + done]
        differ &= _FIRST[np.minimum(size[live] - done, 8)]
        out[live[differ != 0]] = False
        live = live[(differ == 0) & (size[live] - done > 8)]
        done += 8
    return out


def digests(words: list[bytes]) -> np.ndarray:
    """64 bits of BLAKE2b for each byte string, as a column: what no text can be made to collide in."""
    return np.frombuffer(b"".join(hashlib.blake2b(w, digest_size=8).digest() for w in words), "<u8")[:, None]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words, mixed from eight bytes at a time; those of words under eight bytes are their own alone."""
    eight, size = _eights(data), ends - starts
    h = eight[starts] & _FIRST[np.minimum(size, 8)]
    live = np.flatnonzero(size > 7)
    h += np.minimum(size, 8).astype(np.uint64) << _U(56)  # above the bytes of a short word
    h[live] += size[live].astype(np.uint64) * _STEP
    h = mix(h)
    for k in live[size[live] > LONG].tolist():
        h[k] = digests([data[starts[k] : ends[k]].tobytes()])[0, 0]
    live, done = live[(size[live] > 8) & (size[live] <= LONG)], 8
    while len(live):
        more = eight[starts[live] + done] & _FIRST[np.minimum(size[live] - done, 8)]
        h[live] = mix(h[live] * _COMBINE + more)
        done += 8
        live = live[size[live] > done]
    return h


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of ``size`` words; of all words if there are fewer; nothing of nothing."""
    size = min(size, len(words))
    if not size:
        return words[:0]
    n = len(words) - size + 1
    h = words[:n]
    for k in range(1, size):
        h = mix(h * _COMBINE + words[k : k + n])
    return h


def word_count(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Words of each row."""
    return np.diff(word_spans(data, offsets, inside)[2])


def split_spans(data: np.ndarray, offsets: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word spans as of ``word_spans``, cut between bytes of kinds 1 and 2 also. Kind 0 separates; 3 joins anything."""
    if not len(data):
        return word_spans(data, offsets, kinds > 0)
    kind = kinds[data]
    w = kind > 0
    first = w.copy()
    first[1:] &= ~w[:-1] | (kind[1:] + kind[:-1] == 3) & w[:-1]  # 1 beside 2, as 3 beside 0 starts a word anyway
    full = offsets[1:] > offsets[:-1]
    edge = offsets[:-1][full]
    first[edge] = w[edge]
    last = w.copy()
    last[:-1] &= ~w[1:] | first[1:]
    edge = offsets[1:][full] - 1
    last[edge] = w[edge]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


class WordTable:
    """Rows of numbers by word, computed once for each distinct word and kept while there is room.

    ``compute`` takes a list of distinct words (bytes) and returns an array of a row each. When the table is full, words
    that only one block has used since the last time go; that changes no result.
    """

    def __init__(self, compute, width: int, dtype, most: int = 400_000):
        self.compute, self.most = compute, most
        self.index: dict[bytes, int] = {}
        self.rows, self.uses = np.zeros((1024, width), dtype), np.zeros(1024, np.int64)

    def _shrink(self) -> None:
        n = len(self.index)
        keep = self.uses[:n] > 1
        if keep.sum() > self.most // 2:
            keep = self.uses[:n] > np.partition(self.uses[:n], -(self.most // 2))[-(self.most // 2)]
        old = np.flatnonzero(keep)
        flags = keep.tolist()
        self.index = {w: k for k, w in enumerate(w for w, i in self.index.items() if flags[i])}
        self.rows[: len(old)], self.uses[: len(old)] = self.rows[old], 0

    def look_up(self, words: list[bytes]) -> np.ndarray:
        """Row numbers of distinct words."""
        if len(self.index) > self.most:
            self._shrink()
        at = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new = [words[i] for i in missing.tolist()]
            n = len(self.index)
            if n + len(new) > len(self.rows):
                size = max(2 * len(self.rows), n + len(new))
                self.rows, old = np.zeros((size, self.rows.shape[1]), self.rows.dtype), self.rows
                self.rows[: len(old)] = old
                self.uses = np.concatenate([self.uses, np.zeros(size - len(self.uses), np.int64)])
            self.rows[n : n + len(new)] = self.compute(new)
            self.uses[n : n + len(new)] = 0
            self.index.update(zip(new, range(n, n + len(new)), strict=True))
            at[missing] = np.arange(n, n + len(new))
        self.uses[at] += 1
        return at

    def of(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A row number for each word span of a block."""
        if not len(starts):
            return np.zeros(0, np.int64)
        _, first, inverse = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
        raw = data.tobytes()
        words = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        size, one = ends - starts, first[inverse]
        same = size == size[one]
        check = np.flatnonzero(same & (size > 7))  # the hash of a shorter word is no other such word's
        same[check] = same_spans(data, starts[check], starts[one[check]], size[check])
        if not same.all():  # equal hashes of unlike words
            more: dict[bytes, int] = {}
            for k in np.flatnonzero(~same).tolist():
                inverse[k] = len(first) + more.setdefault(raw[starts[k] : ends[k]], len(more))
            words += more
        return self.look_up(words)[inverse]

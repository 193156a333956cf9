"""Words of whole texts as 64-bit hashes, computed on Arrow buffers without a Python loop over words.

A word is a run of bytes other than space and ``\\t\\n\\v\\f\\r``, so the UTF-8 bytes can be cut directly.
Its hash is a sum of random numbers, one per byte and place in the word, so it has no structure that
texts could follow (as polynomials modulo a power of two have); a second hash of other numbers is there where
64 bits are too few.
``slices`` deals a batch out in pieces of about ``SLICE_BYTES``: memory follows that size, or the
longest single text where it is longer.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 18

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def constants(seed: int, n: int) -> np.ndarray:
    """``n`` fixed odd 64-bit multipliers."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed)) | _U(1)


_BYTE = constants(17, 256)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    out[0] = 1
    return np.multiply.accumulate(out)


_TABLES = {"n": 0}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n <= SLICE_BYTES + 1:
        if not _TABLES["n"]:
            size = SLICE_BYTES + 1
            _TABLES.update(n=size, up=_powers(_BASE, size), down=_powers(_BASE_INVERSE, size))
        return _TABLES["up"][:n], _TABLES["down"][:n]
    return _powers(_BASE, n), _powers(_BASE_INVERSE, n)


class Words(NamedTuple):
    """Words of several texts: hashes, byte spans in ``data``, and where each text's words begin."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # one more than there are texts
    data: np.ndarray
    second: np.ndarray  # a hash independent of the first, where asked for


class Slice(NamedTuple):
    row: int
    data: np.ndarray
    offsets: np.ndarray  # into data, one more than there are texts


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if pa.types.is_large_binary(column.type) else column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_large_binary(column.type) else "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), offsets


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Consecutive texts of a column, about ``limit`` bytes at a time; NULL is the empty text."""
    data, offsets = _buffers(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(max(end, row + 1), rows)
        yield Slice(row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row])
        row = end


#: Random numbers per place in a word and byte, for the first places; those further on are mixed when met.
_PLACES = 32
_TABLES_OF = [mix(np.arange(_PLACES * 256, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed)) for seed in (17, 0xD1B54A32D192ED03)]


def _numbers(code: np.ndarray, far: np.ndarray, which: int) -> np.ndarray:
    """One random number per code (256 times the place in the word, and the byte)."""
    if not len(far):
        return _TABLES_OF[which][code]
    out = _TABLES_OF[which][np.minimum(code, _PLACES * 256 - 1)]
    with np.errstate(over="ignore"):
        out[far] = mix(code[far].astype(_U) * _U(0x9E3779B97F4A7C15) + _U((17, 0xD1B54A32D192ED03)[which]))
    return out


def words(piece: Slice, lower: bool = False, second: bool = False) -> Words:
    data, offsets = piece.data, piece.offsets
    if lower:
        data = LOWER[data]
    n = len(data)
    space = _SPACE[data]
    solid = ~space
    before = np.ones(n, bool)
    before[1:] = space[:-1]
    inner = offsets[:-1]
    before[inner[inner < n]] = True
    starts = np.flatnonzero(solid & before)
    if not len(starts):
        empty, none = np.zeros(0, np.int64), np.zeros(0, _U)
        return Words(none, empty, empty, np.zeros(len(offsets), np.int64), data, none)
    after = np.ones(n, bool)
    # The byte before a text's first byte ends the word before it.
    after[:-1] = before[1:] | space[1:]
    ends = np.flatnonzero(solid & after) + 1
    lengths = ends - starts
    begin = np.cumsum(lengths) - lengths
    size = np.int32 if int(lengths.sum()) < 1 << 23 else np.int64  # a slice is small, but for one very long text
    place = np.arange(int(lengths.sum()), dtype=size) - np.repeat(begin.astype(size), lengths)
    code = place << 8 | data[solid]
    far = np.flatnonzero(place >= _PLACES) if int(lengths.max()) > _PLACES else place[:0]
    with np.errstate(over="ignore"):
        hashes, again = (mix(np.add.reduceat(_numbers(code, far, i), begin) + lengths.astype(_U)) if i == 0 or second else code[:0].astype(_U) for i in (0, 1))
    return Words(hashes, starts, ends, np.searchsorted(starts, offsets), data, again)


def whole_texts(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One hash per text, of its words in order."""
    lengths = np.diff(first)
    with np.errstate(over="ignore"):
        place = (np.arange(len(hashes)) - np.repeat(first[:-1], lengths)).astype(_U)
        total = np.zeros(len(hashes) + 1, _U)
        np.cumsum(mix(hashes ^ mix(place * _U(0x9E3779B97F4A7C15) + _U(5))), out=total[1:])
        return mix(total[first[1:]] - total[first[:-1]] + lengths.astype(_U))


def grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """The hash of every run of ``size`` words, by its first word."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, _U)
    with np.errstate(over="ignore"):
        out = np.zeros(n, _U)
        for j, a in enumerate(constants(29, size)):
            out += hashes[j : j + n] * a
        return mix(out)


def long_gram(hashes: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of word runs ``first`` to ``last`` (exclusive), of any lengths, through one prefix sum."""
    with np.errstate(over="ignore"):
        up, down = _power_tables(len(hashes) + 1)
        total = np.zeros(len(hashes) + 1, _U)
        np.cumsum(hashes * up[: len(hashes)], out=total[1:])
        return mix((total[last] - total[first]) * down[first] + (last - first).astype(_U))

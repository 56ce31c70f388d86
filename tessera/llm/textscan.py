"""Vectorised word scanning over Arrow string columns.

A word is a maximal run of bytes other than space and 0x09-0x0D.  All
functions work on whole texts; null texts count as empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_U = np.uint64
#: Bytes of text that are scanned at once; a longer text is scanned alone.
BLOCK_BYTES = 1 << 18

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Of each byte its number in a word, from 1; white space counts for nothing.
_WORD_CODES = np.where(_SPACE, 0, np.arange(1, 257)).astype(np.uint16)
_FOLDED_CODES = _WORD_CODES[LOWER]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (multiply and xor-shift)."""
    x = x ^ (x >> _U(31))
    x = x * _U(0x9E3779B97F4A7C15)
    x ^= x >> _U(29)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    return x


#: Primes and bases of the two fingerprints of ``run_hashes``.
_FIELDS = (((1 << 31) - 1, 1_103_515_245), ((1 << 31) - 19, 1_812_433_253 % ((1 << 31) - 19)))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(prime: int, base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo a prime."""
    if prime not in _powers or len(_powers[prime][0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        tables = []
        for root in (base, pow(base, -1, prime)):
            table, filled = np.ones(size, _U), 1
            while filled < size:
                step = min(filled, size - filled)
                table[filled : filled + step] = table[:step] * _U(pow(root, filled, prime)) % _U(prime)
                filled += step
            tables.append(table)
        _powers[prime] = tables[0], tables[1]
    up, down = _powers[prime]
    return up[:n], down[:n]


def run_hashes(codes: np.ndarray, starts: np.ndarray, limit: int = 1 << 16) -> np.ndarray:
    """A 64-bit hash of each run of ``codes`` from one of ``starts`` to the next.

    Codes are numbers below 512, and 0 counts for nothing.  Two polynomial fingerprints modulo
    primes are mixed: unlike those modulo a power of two, no pattern of letters makes
    them meet for any base.  Long input is hashed in pieces of about ``limit`` codes.
    """
    out = np.zeros(len(starts), _U)
    ends = np.append(starts[1:], len(codes))
    first = 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + limit, "right")))
        begin, at = int(starts[first]), starts[first:last] - starts[first]
        part = codes[begin : int(ends[last - 1])].astype(_U)
        found = []
        for prime, base in _FIELDS:
            up, down = _power_tables(prime, base, len(part))
            # a sum of less than 2**24 products of 9 and 31 bits cannot overflow
            terms = part * up if len(part) < 1 << 24 else part * up % _U(prime)
            found.append(np.add.reduceat(terms, at) % _U(prime) * down[at] % _U(prime))
        out[first:last] = mix64(found[0] << _U(31) | found[1])
        first = last
    return out


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the n+1 offsets of the texts in them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def blocks(column: pa.Array, limit: int = BLOCK_BYTES):
    """Yield (first row, bytes, offsets) for runs of rows of about ``limit`` bytes."""
    raw, offs = text_buffers(column)
    first, n = 0, len(offs) - 1
    while first < n:
        last = int(np.searchsorted(offs, offs[first] + limit, "right")) - 1
        last = min(n, max(last, first + 1))
        yield first, raw[offs[first] : offs[last]], offs[first : last + 1] - offs[first]
        first = last


class Words:
    """Words of a block: byte starts and ends, and per text the first word."""

    def __init__(self, raw: np.ndarray, offs: np.ndarray):
        self.raw, self.offs = raw, offs
        solid = ~_SPACE[raw]
        begins = solid.copy()
        begins[1:] &= ~solid[:-1]
        inner = offs[1:-1]
        inner = inner[inner < len(raw)]
        begins[inner] = solid[inner]  # a word ends with its text
        self.solid = solid
        self.starts = np.flatnonzero(begins)
        # of each text the place of its first word; one more for the end
        self.first = np.searchsorted(self.starts, offs)
        self.counts = np.diff(self.first)

    def hashes(self, fold_case: bool) -> np.ndarray:
        """A 64-bit hash of each word, equal for equal words everywhere."""
        return run_hashes((_FOLDED_CODES if fold_case else _WORD_CODES)[self.raw], self.starts)


def windows(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all windows of ``width`` consecutive word hashes."""
    n = max(0, len(words) - width + 1)
    out = np.zeros(n, _U)
    for k in range(width):
        out += words[k : k + n] * _U(pow(0xE7037ED1A0B428DB, 2 * k + 1, 1 << 64))
    return mix64(out)


def shingle_sets(words: np.ndarray, first: np.ndarray, width: int) -> list[np.ndarray]:
    """For each text its sorted distinct shingles; a shorter text is one shingle."""
    whole = windows(words, width)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(whole[a : b - width + 1]))
        elif b > a:
            out.append(windows(words[a:b], b - a) ^ _U(b - a))
        else:
            out.append(words[:0])
    return out

"""Counts over whole texts that the quality rules read, vectorised over blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tessera.llm.textscan import Words, blocks, mix64, run_hashes, windows

_U = np.uint64
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_MARK = np.zeros(256, bool)
_MARK[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?\"'"]] = True

#: Of each byte its number in a line; the line's end counts for nothing.
_LINE_CODES = np.arange(1, 257, dtype=np.uint16)
_LINE_CODES[10] = 0

#: Names of the columns of ``text_stats``.
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_loud_words", "n_bang", "n_closed_lines", "n_distinct_words", "n_echo_words", "n_symbol_words", "n_marks")


def _sums(mask: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
    return total[offs[1:]] - total[offs[:-1]]


def _line_counts(w: Words, doc_of_byte_start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: lines with a word, those equal to an earlier one, those closed by a stop."""
    raw, offs = w.raw, w.offs
    n = len(offs) - 1
    zero = np.zeros(n, np.int64)
    if not len(w.starts):
        return zero, zero.copy(), zero.copy()
    breaks = np.flatnonzero(raw == 10) + 1
    starts = np.unique(np.concatenate((offs[:-1], breaks)))
    starts = starts[starts < len(raw)]
    ends = np.append(starts[1:], len(raw))
    solid = np.concatenate(([0], np.cumsum(w.solid)))
    hashes = run_hashes(_LINE_CODES[raw], starts)
    doc = np.searchsorted(offs, starts, "right") - 1
    worded = solid[ends] > solid[starts]
    doc, hashes, starts, ends = doc[worded], hashes[worded], starts[worded], ends[worded]
    lines = np.bincount(doc, minlength=n)
    order = np.lexsort((hashes, doc))
    d, h = doc[order], hashes[order]
    again = np.zeros(len(d), bool)
    again[1:] = (d[1:] == d[:-1]) & (h[1:] == h[:-1])
    last_word = np.searchsorted(w.starts, ends) - 1
    last_byte = _word_ends(w)[last_word] - 1
    closed = _STOP[raw[last_byte]]
    return lines, np.bincount(d[again], minlength=n), np.bincount(doc[closed], minlength=n)


def _word_ends(w: Words) -> np.ndarray:
    solid = w.solid
    ends = np.empty(len(solid), bool)
    ends[:-1] = solid[:-1] & ~solid[1:]
    ends[-1:] = solid[-1:]
    inner = w.offs[1:-1]
    inner = inner[inner > 0] - 1
    ends[inner] = solid[inner]
    return np.flatnonzero(ends) + 1


def _repeated(hashes: np.ndarray, w: Words, width: int) -> np.ndarray:
    """Per text: words in windows of ``width`` words that occur twice or more in it."""
    n, total = len(w.counts), len(hashes)
    if total < width:
        return np.zeros(n, np.int64)
    doc = np.repeat(np.arange(n), w.counts)
    whole = windows(hashes, width)
    inside = doc[: len(whole)] == doc[width - 1 :]
    keys = whole ^ mix64(doc[: len(whole)].astype(_U) + _U(1))
    at = np.flatnonzero(inside)
    order = at[np.argsort(keys[at], kind="stable")]
    same = keys[order[1:]] == keys[order[:-1]]
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    cover = np.zeros(total + 1, np.int64)
    hit = order[twice]
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + width, -1)
    return _sums((np.cumsum(cover[:-1]) > 0), w.first)


def text_stats(column: pa.Array) -> dict[str, np.ndarray]:
    """The ``STATS`` of each text of the column (null: an empty text)."""
    parts: dict[str, list[np.ndarray]] = {name: [] for name in STATS}
    for _, raw, offs in blocks(column):
        w = Words(raw, offs)
        hashes = w.hashes(fold_case=False)
        parts["n_words"].append(w.counts)
        parts["word_chars"].append(_sums(w.solid & ((raw & 0xC0) != 0x80), offs))
        parts["n_symbols"].append(_sums(_SYMBOL[raw], offs))
        lines, dups, closed = _line_counts(w, offs)
        parts["n_lines"].append(lines)
        parts["n_dup_lines"].append(dups)
        parts["n_closed_lines"].append(closed)
        parts["n_repeat_words"].append(_repeated(hashes, w, 3))
        if len(w.starts):
            upper = (raw >= 65) & (raw <= 90)
            lower = (raw >= 97) & (raw <= 122)
            ups = np.add.reduceat(upper, w.starts, dtype=np.int64)
            lows = np.add.reduceat(lower, w.starts, dtype=np.int64)
            parts["n_loud_words"].append(_sums((ups >= 2) & (lows == 0), w.first))
            parts["n_symbol_words"].append(_sums(np.logical_or.reduceat(_SYMBOL[raw], w.starts), w.first))
        else:
            parts["n_loud_words"].append(np.zeros(len(w.counts), np.int64))
            parts["n_symbol_words"].append(np.zeros(len(w.counts), np.int64))
        parts["n_marks"].append(_sums(_MARK[raw], offs))
        parts["n_bang"].append(_sums((raw == 33) | (raw == 63), offs))
        doc = np.repeat(np.arange(len(w.counts), dtype=np.int64), w.counts)
        keys = np.unique(hashes ^ mix64(doc.astype(_U) + _U(1)), return_index=True)[1]
        echo = np.zeros(len(hashes), bool)
        echo[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
        parts["n_echo_words"].append(_sums(echo, w.first))
        parts["n_distinct_words"].append(np.bincount(doc[keys], minlength=len(w.counts)))
    return {name: np.concatenate(v).astype(np.int64) if v else np.zeros(0, np.int64) for name, v in parts.items()}

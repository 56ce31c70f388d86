"""String measures over many pairs at once, bit-parallel in NumPy.

The longest common subsequence of two texts needs one word of bits per 64 characters of
the first and one step per character of the second; a step is a few NumPy operations
over all pairs.  ``functions.similarity`` has the same measures for one pair.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

_U = np.uint64
_ALL = _U(0xFFFFFFFFFFFFFFFF)
#: Entries of a table of character masks that are made at once.
TABLE = 1 << 22


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in turn, and the lengths of the texts."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), lengths


def _matrix(values: np.ndarray, lengths: np.ndarray, pad: int) -> np.ndarray:
    """Rows of values of such lengths, padded at the right."""
    out = np.full((len(lengths), int(lengths.max(initial=0)) + 1), pad, np.int32)
    out[np.arange(out.shape[1]) < lengths[:, None]] = values
    return out


class Pairs:
    """Both sides of some pairs as matrices of character numbers; the pad matches nothing."""

    def __init__(self, a: list[str], b: list[str]):
        (x, self.na), (y, self.nb) = _codes(a), _codes(b)
        present = np.zeros(max(int(x.max(initial=0)), int(y.max(initial=0))) + 1, bool)
        present[x] = present[y] = True
        number = np.cumsum(present, dtype=np.int32) - 1
        self.pad = int(number[-1]) + 1
        self.a, self.b = _matrix(number[x], self.na, self.pad), _matrix(number[y], self.nb, self.pad)


def _masks(rows: np.ndarray, lengths: np.ndarray, pad: int) -> np.ndarray:
    """Of each row and character the bits of its places: (rows, pad + 1, words)."""
    words = max(1, -(-int(lengths.max(initial=0)) // 64))
    table = np.zeros((len(rows), pad + 1, words), _U)
    every = np.arange(len(rows))
    for at in range(rows.shape[1]):  # pads fall into a column of their own
        table[every, rows[:, at], min(at >> 6, words - 1)] |= _U(1) << _U(at & 63)
    table[:, pad] = 0
    return table


def _within(lengths: np.ndarray, words: int) -> np.ndarray:
    """Masks of the first so many bits: (rows, words)."""
    bits = np.clip(lengths[:, None] - 64 * np.arange(words), 0, 64).astype(_U)
    return np.where(bits == 64, _ALL, (_U(1) << np.minimum(bits, _U(63))) - _U(1))


def _run(table: np.ndarray, row: np.ndarray, lengths: np.ndarray, text: np.ndarray, sizes: np.ndarray, each: Callable | None = None) -> np.ndarray:
    """Longest common subsequences of needles (``table`` rows ``row``) with texts.

    ``lengths`` are those of the needles, ``sizes`` those of the texts, whose rows are
    sorted by falling size.  ``each(step, live, found)`` hears of every step.
    """
    words = table.shape[2]
    state, mask = np.full((len(row), words), _ALL, _U, order="F"), _within(lengths, words)
    count = lambda n: lengths[:n] - np.bitwise_count(state[:n] & mask[:n]).sum(axis=1, dtype=np.int64)
    flat = [np.ascontiguousarray(table[:, :, w]).ravel() for w in range(words)]
    steps = int(sizes.max(initial=0))
    place = np.ascontiguousarray((row[:, None] * table.shape[1] + text[:, :steps]).T)
    live, falling = len(row), -sizes
    for step in range(steps):
        live = int(np.searchsorted(falling[:live], -step, "left"))
        at, carry = place[step, :live], _U(0)
        for w in range(words):
            own, hit = state[:live, w], flat[w].take(at)
            met = own & hit
            total = own + met
            if w + 1 < words or w:
                over = total < met
                if w:
                    total += carry
                    over |= total < carry
                carry = over.astype(_U)
            state[:live, w] = total | (own & ~hit)
        if each:
            each(step, live, count(live))
    return count(len(row))


def _in_parts(measure: Callable[[Pairs], np.ndarray], a: list[str], b: list[str], rows: int = 4096) -> np.ndarray:
    """A measure over parts of the pairs whose tables stay small."""
    out, at = np.zeros(len(a)), 0
    while at < len(a):
        pairs = Pairs(a[at : at + rows], b[at : at + rows])
        words = 1 + max(int(pairs.na.max(initial=0)), int(pairs.nb.max(initial=0))) // 64
        if rows > 1 and len(pairs.na) * (pairs.pad + 1) * words > TABLE:
            rows = max(1, rows // 2)
            continue
        out[at : at + len(pairs.na)] = measure(pairs)
        at += len(pairs.na)
    return out


def _lcs(pairs: Pairs) -> np.ndarray:
    order = np.argsort(-pairs.nb, kind="stable")
    out = np.zeros(len(order), np.int64)
    out[order] = _run(_masks(pairs.a, pairs.na, pairs.pad), order, pairs.na[order], pairs.b[order], pairs.nb[order])
    return out


def indels(a: list[str], b: list[str]) -> np.ndarray:
    """2 * longest common subsequence / (length + length); 1 for two empty texts."""

    def measure(pairs: Pairs) -> np.ndarray:
        total = pairs.na + pairs.nb
        return np.where(total > 0, 2 * _lcs(pairs) / np.maximum(total, 1), 1.0)

    return _in_parts(measure, a, b)


def _ends(pairs: Pairs) -> np.ndarray:
    """Best similarity of the needle a with a shorter start of b."""
    best, size = np.zeros(len(pairs.na)), np.minimum(pairs.na - 1, pairs.nb)
    order = np.argsort(-size, kind="stable")

    def each(step: int, live: int, found: np.ndarray) -> None:
        at = order[:live]
        best[at] = np.maximum(best[at], 2 * found / (pairs.na[at] + step + 1))

    _run(_masks(pairs.a, pairs.na, pairs.pad), order, pairs.na[order], pairs.b[order], size[order], each)
    return best


def partials(a: list[str], b: list[str]) -> np.ndarray:
    """The best indel similarity of the shorter text with any window of the longer.

    Windows are as long as the shorter text, or shorter at either end.  The windows at
    an end are all met in one run; those inside are runs of their own.
    """
    short, long = zip(*((x, y) if len(x) <= len(y) else (y, x) for x, y in zip(a, b))) if a else ((), ())
    short, long = list(short), list(long)

    def inside(pairs: Pairs) -> np.ndarray:
        windows = pairs.nb - pairs.na + 1
        row = np.repeat(np.arange(len(windows)), windows)
        start = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
        order = np.argsort(-pairs.na[row], kind="stable")
        row, start = row[order], start[order]
        best, table = np.zeros(len(windows)), _masks(pairs.a, pairs.na, pairs.pad)
        for at in range(0, len(row), 1 << 16):
            part, first = row[at : at + (1 << 16)], start[at : at + (1 << 16)]
            size = pairs.na[part]
            place = np.minimum(first[:, None] + np.arange(max(1, int(size.max(initial=0)))), pairs.b.shape[1] - 1)
            found = _run(table, part, size, pairs.b[part[:, None], place], size)
            np.maximum.at(best, part, found / np.maximum(size, 1))
        return best

    best = np.maximum(_in_parts(inside, short, long), _in_parts(_ends, short, long))
    best = np.maximum(best, _in_parts(_ends, [x[::-1] for x in short], [x[::-1] for x in long]))
    empty = np.fromiter((not x for x in short), bool, len(short))
    return np.where(empty, [float(not y) for y in long], best)


def sorted_words(texts: list[str]) -> list[str]:
    known = {t: " ".join(sorted(t.split())) for t in set(texts)}
    return [known[t] for t in texts]


def token_sets(a: list[str], b: list[str]) -> np.ndarray:
    """The best similarity of common words, and of these with the rest of either side.

    The common words begin both longer texts, so two of the three similarities are
    known from lengths.
    """
    words = {t: frozenset(t.split()) for t in {*a, *b}}
    out, left, right, at = np.zeros(len(a)), [], [], []
    for i, (s, t) in enumerate(zip(a, b)):
        x, y = words[s], words[t]
        if not x or not y:
            continue
        common = x & y
        if common and (len(common) == len(x) or len(common) == len(y)):
            out[i] = 1.0
            continue
        head = sorted(common)
        shared = " ".join(head)
        one, two = (" ".join([*([shared] if head else []), *sorted(rest)]) for rest in (x - y, y - x))
        if head:
            n = len(shared)
            out[i] = max(2 * n / (n + len(one)), 2 * n / (n + len(two)))
        left.append(one)
        right.append(two)
        at.append(i)
    np.maximum.at(out, at, indels(left, right))
    return out


def _jaro(pairs: Pairs) -> np.ndarray:
    """Jaro-Winkler similarity of pairs of at most 64 characters."""
    na, nb = pairs.na, pairs.nb
    table, rows = _masks(pairs.b, nb, pairs.pad)[:, :, 0], np.arange(len(na))
    reach = np.maximum(np.maximum(na, nb) // 2 - 1, 0)
    first = lambda n: _within(np.clip(n, 0, 64), 1)[:, 0]
    taken, met = np.zeros(len(na), _U), np.zeros(pairs.a.shape, bool)
    for i in range(int(na.max(initial=0))):
        window = first(np.minimum(nb, i + reach + 1)) & ~first(i - reach)
        free = table[rows, pairs.a[:, i]] & ~taken & window
        taken |= free & (~free + _U(1))
        met[:, i] = free != 0
    m = np.bitwise_count(taken).astype(np.int64)
    places = np.arange(min(64, pairs.b.shape[1]), dtype=_U)
    other = (taken[:, None] >> places & _U(1)).astype(bool)
    unlike = pairs.a[met] != pairs.b[:, : other.shape[1]][other]
    swaps = np.bincount(np.repeat(rows, m), weights=unlike, minlength=len(na)) // 2
    n = np.maximum(m, 1)
    jaro = np.where(m > 0, (m / np.maximum(na, 1) + m / np.maximum(nb, 1) + (m - swaps) / n) / 3, 0.0)
    width = min(4, pairs.a.shape[1], pairs.b.shape[1])
    same = (pairs.a[:, :width] == pairs.b[:, :width]) & (np.arange(width) < np.minimum(na, nb)[:, None])
    prefix = np.logical_and.accumulate(same, axis=1).sum(axis=1)
    return np.where(jaro > 0.7, jaro + 0.1 * prefix * (1 - jaro), jaro)


def jaro_winklers(a: list[str], b: list[str], one: Callable[[str, str], float]) -> np.ndarray:
    """Jaro-Winkler similarities; ``one`` measures pairs of more than 64 characters."""
    out = np.zeros(len(a))
    short = np.fromiter((len(x) <= 64 and len(y) <= 64 for x, y in zip(a, b)), bool, len(a))
    at = np.flatnonzero(short)
    out[at] = _in_parts(_jaro, [a[i] for i in at], [b[i] for i in at])
    for i in np.flatnonzero(~short):
        out[i] = one(a[i], b[i])
    return out


def weighted_ratios(a: list[str], b: list[str]) -> np.ndarray:
    """The weighted ratio: whole, token and (for unlike lengths) partial measures."""
    out = np.zeros(len(a))
    full = [i for i in range(len(a)) if a[i] and b[i]]
    unlike = np.array([max(len(a[i]), len(b[i])) / min(len(a[i]), len(b[i])) for i in full])
    whole = indels([a[i] for i in full], [b[i] for i in full])
    near = np.flatnonzero(unlike < 1.5) if full else np.zeros(0, np.int64)
    x, y = [a[full[k]] for k in near], [b[full[k]] for k in near]
    whole[near] = np.maximum(whole[near], 0.95 * np.maximum(indels(sorted_words(x), sorted_words(y)), token_sets(x, y)))
    far = np.flatnonzero(unlike >= 1.5) if full else near
    if len(far):
        x, y = [a[full[k]] for k in far], [b[full[k]] for k in far]
        scale = np.where(unlike[far] <= 8, 0.9, 0.6)
        left, right = ([" ".join(sorted(set(t.split()))) for t in side] for side in (x, y))
        common = np.array([bool(set(s.split()) & set(t.split())) for s, t in zip(x, y)])
        words = np.where(common, 1.0, partials(left, right))
        words = np.maximum(words, partials(sorted_words(x), sorted_words(y)))
        whole[far] = np.maximum(whole[far], np.maximum(scale * partials(x, y), 0.95 * scale * words))
    out[full] = whole
    return out


def over_distinct(measure: Callable[[list[str], list[str]], np.ndarray], a: list[str], b: list[str], empty: float | None = 0.0) -> np.ndarray:
    """A measure computed once per distinct pair; ``empty`` where a text is (if given)."""
    place: dict[tuple[str, str], int] = {}
    at = np.fromiter((place.setdefault(pair, len(place)) for pair in zip(a, b)), np.int64, len(a))
    left, right = [p[0] for p in place], [p[1] for p in place]
    found = measure(left, right)
    if empty is not None:
        found = np.where([not (x and y) for x, y in place], empty, found) if place else found
    return found[at]

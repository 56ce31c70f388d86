"""String similarities that Spark has no functions for, as Arrow UDFs.

``ratio`` is the indel similarity 2 * LCS / (length + length); partial, sorted and set
variants follow the public definitions of the usual fuzzy-matching libraries.  The
functions of one pair define the measures; the UDFs compute them by ``vectors``, for all
distinct pairs of a batch at once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import vectors


def _masks(text: str) -> dict[str, int]:
    """Of each character the bits of its places."""
    masks: dict[str, int] = {}
    for i, ch in enumerate(text):
        masks[ch] = masks.get(ch, 0) | 1 << i
    return masks


def _lcs(masks: dict[str, int], length: int, other: str) -> int:
    every = row = (1 << length) - 1
    for ch in other:
        hit = row & masks.get(ch, 0)
        row = (row + hit | row - hit) & every
    return length - row.bit_count()


def lcs_length(a: str, b: str) -> int:
    return _lcs(_masks(a), len(a), b)


def indel(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 2 * lcs_length(a, b) / total if total else 1.0


def partial(a: str, b: str) -> float:
    """The best indel similarity of the shorter with any window of the longer."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    n, best = len(short), 0.0
    if not n:
        return 1.0 if not long else 0.0
    if short in long:
        return 1.0
    masks = _masks(short)
    for end in range(1, len(long) + n):
        window = long[max(0, end - n) : end]
        # a window that starts and ends with strangers is no better than its core
        if window and (window[-1] in masks or window[0] in masks) and 2 * min(n, len(window)) / (n + len(window)) > best:
            best = max(best, 2 * _lcs(masks, n, window) / (n + len(window)))
    return best


def token_sort(a: str, b: str, measure=indel) -> float:
    return measure(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    common = " ".join(sorted(x & y))
    if common and (x <= y or y <= x):
        return 1.0
    left, right = (" ".join(filter(None, (common, " ".join(sorted(rest))))) for rest in (x - y, y - x))
    best = indel(left, right)
    return max(best, indel(common, left), indel(common, right)) if common else best


def weighted(a: str, b: str) -> float:
    """The weighted ratio: whole, token and (for unlike lengths) partial measures."""
    if not a or not b:
        return 0.0
    lengths = max(len(a), len(b)) / min(len(a), len(b))
    best = indel(a, b)
    if lengths < 1.5:
        return max(best, 0.95 * max(token_sort(a, b), token_set(a, b)))
    scale = 0.9 if lengths <= 8 else 0.6
    x, y = set(a.split()), set(b.split())
    part = 1.0 if x & y else partial(" ".join(sorted(x)), " ".join(sorted(y)))
    return max(best, scale * partial(a, b), 0.95 * scale * max(part, token_sort(a, b, partial)))


def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity, raised by a common prefix of up to four where above 0.7; 0 of an empty text."""
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken, mine = [False] * len(b), []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == ch:
                taken[j] = True
                mine.append(ch)
                break
    m = len(mine)
    if not m:
        return 0.0
    swaps = sum(x != y for x, y in zip(mine, (ch for ch, t in zip(b, taken) if t))) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    if jaro <= 0.7:
        return jaro
    prefix = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4])) if x != y), min(4, len(a), len(b)))
    return jaro + 0.1 * prefix * (1 - jaro)


def _texts(column: pd.Series) -> list[str]:
    return column.fillna("").tolist()


def _pairwise(measure, empty: float | None = 0.0):
    @F.pandas_udf(T.DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(vectors.over_distinct(measure, _texts(a), _texts(b), empty))

    return run


def _sorted_ratios(a: list[str], b: list[str]) -> np.ndarray:
    return vectors.indels(vectors.sorted_words(a), vectors.sorted_words(b))


#: The four ratios that pairs of texts are compared by.
RATIOS = {"ratio": vectors.indels, "partial_ratio": vectors.partials, "token_sort_ratio": _sorted_ratios, "token_set_ratio": vectors.token_sets}

ratio = _pairwise(vectors.indels)
partial_ratio = _pairwise(vectors.partials)
token_sort_ratio = _pairwise(_sorted_ratios)
token_set_ratio = _pairwise(vectors.token_sets)
weighted_ratio = _pairwise(vectors.weighted_ratios)
jaro_winkler_similarity = _pairwise(lambda a, b: vectors.jaro_winklers(a, b, jaro_winkler), None)


@F.pandas_udf(T.StructType([T.StructField(name, T.DoubleType()) for name in RATIOS]))
def fuzzy_ratios(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """All ``RATIOS`` of a pair, as a struct."""
    x, y = _texts(a), _texts(b)

    def every(left: list[str], right: list[str]) -> np.ndarray:
        found = np.column_stack([measure(left, right) for measure in RATIOS.values()]) if left else np.zeros((0, len(RATIOS)))
        return np.where(np.array([not (s and t) for s, t in zip(left, right)], bool)[:, None], 0.0, found)

    return pd.DataFrame(vectors.over_distinct(every, x, y, None), columns=list(RATIOS))


def levenshtein_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest > 0, 1 - F.levenshtein(a, b) / longest).otherwise(1.0)


def grams(text: Column, n: int) -> Column:
    """Distinct character n-grams; none if the text is shorter."""
    last = F.length(text) - (n - 1)
    return F.when(last >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substr(text, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Intersection over union of two arrays; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / F.greatest(union, F.lit(1))).otherwise(0.0)

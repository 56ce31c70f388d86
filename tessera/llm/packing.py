"""Best-fit decreasing packing into sequences of a fixed number of tokens.

Lengths are whole numbers up to the capacity, so a histogram of them (capacity
entries, whatever the input) is all that the packing itself needs.  The driver
packs the histogram best-fit decreasing: a segment tree over remaining capacities
finds the tightest open bin in logarithmic time, and equal bins and equal lengths
are placed in one step.  What comes out is a list of runs - "the items ranked a to
b of length n go to bins c, c+1, ... at this offset" - which executors apply to
their own rows by rank.  No text or id leaves the row it was read in.

Defined results: a null or empty text is its end id alone; a longer document is
cut into full pieces and a rest; repeated rows are packed each; null ids sort
first; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.caching import CACHE_BYTES
from tessera.llm.sharding import BUCKET_ROWS, _ranked
from tessera.llm.store import Workspace, rows_of
from tessera.llm.word_ids import encoder

CAPACITY = 2048
END_ID = 0


class CapacityTree:
    """Which remaining capacities have an open bin; finds the tightest that fits."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.node = [False] * (2 * self.size)

    def set(self, remaining: int, open_: bool) -> None:
        i = self.size + remaining
        self.node[i] = open_
        while i > 1:
            i >>= 1
            self.node[i] = self.node[2 * i] or self.node[2 * i + 1]

    def tightest(self, length: int) -> int | None:
        """The least remaining capacity of ``length`` or more with an open bin."""
        i = self.size + length
        if self.node[i]:
            return length
        while i > 1:
            if not i & 1 and self.node[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.node[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return None


def best_fit_decreasing(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Runs (length, first rank, items, first bin, items per bin, offset) and the number of bins.

    Items of a run are ranked from 0 among those of their length; item k goes to
    bin ``first bin + k // items per bin`` at ``offset + (k % items per bin) * length``.
    Placing one item at a time gives the same bins: the tightest bin that takes
    one item stays the tightest until no further item of that length fits.
    """
    tree = CapacityTree(capacity)
    open_bins: dict[int, list[tuple[int, int]]] = {}
    runs, bins = [], 0

    def push(remaining: int, first: int, n: int) -> None:
        if n and remaining:
            if not open_bins.get(remaining):
                open_bins[remaining] = []
                tree.set(remaining, True)
            open_bins[remaining].append((first, n))

    for length in sorted((n for n, c in counts.items() if c), reverse=True):
        rank, left = 0, counts[length]
        while left:
            remaining = tree.tightest(length)
            if remaining is None:
                remaining, first, n = capacity, bins, math.ceil(left / (capacity // length))
                bins += n
            else:
                first, n = open_bins[remaining].pop()
                if not open_bins[remaining]:
                    tree.set(remaining, False)
            each = remaining // length
            full = min(n, left // each)
            rest = left - full * each if full < n else 0
            rest = min(rest, each - 1) if full < n else 0
            taken = full * each + rest
            runs.append((length, rank, taken, first, each, capacity - remaining))
            used = full + (rest > 0)
            push(remaining, first + used, n - used)
            push(remaining - each * length, first, full)
            if rest:
                push(remaining - rest * length, first + full, 1)
            rank += taken
            left -= taken
    return runs, bins


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, id_column: str = "doc_id", text_column: str = "text", cache_bytes: int = CACHE_BYTES) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encode = encoder(tokenizer, cache_bytes).encode_column
        for batch in batches:
            rows, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(encode(batch.column(1))):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column), F.col(text_column)).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, tokenizer: str, work: Workspace, capacity: int = CAPACITY, end_id: int = END_ID, id_column: str = "doc_id", text_column: str = "text", cache_bytes: int = CACHE_BYTES) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = work.keep(token_pieces(docs, tokenizer, capacity, end_id, id_column, text_column, cache_bytes), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    runs, _ = best_fit_decreasing(counts, capacity)
    runs.sort()
    table = np.array(runs, np.int64).reshape(-1, 6)
    # Items of one length can be any share of all rows: ranked by buckets of hashes.
    buckets = max(8, math.ceil(rows_of(pieces) / BUCKET_ROWS))
    spread = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int")
    ranked = work.sized(_ranked(pieces, ["length"], spread, ["doc_id", "piece", "ids_crc32"], "rank"), rows_of(pieces))

    def place(batches):
        keys = table[:, 0] << 44 | table[:, 1]
        for batch in batches:
            length, rank = (batch.column(name).to_numpy(zero_copy_only=False) for name in ("length", "rank"))
            run = table[np.searchsorted(keys, length << 44 | (rank - 1), "right") - 1]
            k = rank - 1 - run[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(name) for name in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(run[:, 3] + k // run[:, 4]), pa.array(run[:, 5] + k % run[:, 4] * length)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    kind = pieces.schema["doc_id"].dataType.simpleString()
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")

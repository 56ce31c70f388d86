"""Byte-level BPE with a segment tree over byte positions.

A leaf holds the rank of the pair that starts at its position, and each node the
leftmost minimum below it, so the next merge is read at the root and a merge
updates the leaves of its two live neighbours in logarithmic time.  A piece of
n bytes takes O(n log n) whatever its length; pieces are encoded once and kept
in a cache bounded in bytes.

Defined results: a null text is empty and has no ids; texts of any length are
encoded whole; repeated rows encode alike; strings of special tokens are ordinary
text; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.caching import CACHE_BYTES, BytesCache, owned


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks of a .tiktoken file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class PairTree:
    """Leftmost minimum over positions; leaves hold rank * size + position."""

    def __init__(self, ranks: list[int | None]):
        n = len(ranks)
        self.size = size = 1 << max(0, (n - 1).bit_length())
        self.none = none = 1 << 62
        node = [none] * size
        node += [none if r is None else r * size + i for i, r in enumerate(ranks)]
        node += [none] * (size - n)
        for i in range(size - 1, 0, -1):
            a, b = node[2 * i], node[2 * i + 1]
            node[i] = a if a < b else b
        self.node = node

    def first(self) -> int | None:
        """Position of the leftmost pair of minimum rank."""
        low = self.node[1]
        return None if low >= self.none else low & (self.size - 1)

    def put(self, at: int, rank: int | None) -> None:
        node, i = self.node, self.size + at
        node[i] = self.none if rank is None else rank * self.size + at
        while i > 1:
            i >>= 1
            a, b = node[2 * i], node[2 * i + 1]
            if b < a:
                a = b
            if node[i] == a:
                return
            node[i] = a


class ByteBpe:
    """Encoder and decoder for one table of ranks and one splitting pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, limit: int = CACHE_BYTES):
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.longest = max(map(len, ranks), default=0)
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.code = "<u2" if max(self.bytes_of, default=0) < 1 << 16 else "<u4"
        self.digits_of = {rank: str(rank) for rank in self.bytes_of}
        #: piece -> its ids as integers of ``code``
        self.pieces = BytesCache(lambda piece: np.array(self.merge(piece.encode()), self.code).tobytes(), limit)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n, ranks, longest = len(piece), self.ranks, self.longest
        end = list(range(1, n + 1))  # by the start of a live part: where it ends
        before = list(range(-1, n - 1))  # and where the live part before it starts
        tree = PairTree([ranks.get(piece[i : i + 2]) if i + 1 < n else None for i in range(n)])

        def rank_at(i: int) -> int | None:
            mid = end[i]
            if mid >= n or end[mid] - i > longest:
                return None
            return ranks.get(piece[i : end[mid]])

        while (i := tree.first()) is not None:
            mid = end[i]
            end[i] = end[mid]
            if end[i] < n:
                before[end[i]] = i
            tree.put(mid, None)
            tree.put(i, rank_at(i))
            if (p := before[i]) >= 0:
                tree.put(p, rank_at(p))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(b"".join(map(self.pieces.__getitem__, self.split(text))), self.code).tolist()

    def digits(self, ids: list[int]) -> str:
        """The ids as decimal text joined by commas."""
        return ",".join(map(self.digits_of.__getitem__, ids))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def codec(path: str, pattern: str) -> ByteBpe:
    """The codec of a rank file, loaded once per process."""
    table = owned("bytes")
    if (path, pattern) not in table:
        table[path, pattern] = ByteBpe(load_ranks(path), pattern)
    return table[path, pattern]


def encode_column(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of every row."""

    def run(batches):
        bpe = codec(path, pattern)
        for batch in batches:
            ids = [bpe.encode(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column), F.col(text_column)).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode_column(encoded: DataFrame, path: str, pattern: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """doc_id and data (binary) of every row of ids; null ids give empty data."""

    def run(batches):
        bpe = codec(path, pattern)
        for batch in batches:
            data = [bpe.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], ["doc_id", "data"])

    kind = encoded.schema[id_column].dataType.simpleString()
    return encoded.select(F.col(id_column), F.col(ids_column)).mapInArrow(run, f"doc_id {kind}, data binary")


def round_trip_digests(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode, then decode the ids."""

    def run(batches):
        bpe = codec(path, pattern)
        for batch in batches:
            counts, sums, back = [], [], []
            for text in batch.column(1):
                ids = bpe.encode(text.as_py() or "")
                counts.append(len(ids))
                sums.append(hashlib.sha256(bpe.digits(ids).encode()).hexdigest())
                back.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(sums, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column), F.col(text_column)).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")

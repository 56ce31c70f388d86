"""Token output as one wavelet matrix per shard.

A shard file holds the ids of a run of documents as succinct bit planes (one per
bit of the largest id) and the table of its documents.  A plane is cut into blocks, each
compressed with a rank directory of its own; the ones before every block stand in the
file's head.  So the id at a place, counts and ranks of an id, the place of its k-th
occurrence and the ids of a document inflate only the blocks that they touch.

Texts are encoded where they are read; only ids, packed, are range-partitioned and
sorted by document, so shards follow one another in ascending id order and the place
of a document in the corpus is the sum of what stands before it.  Each shard is one
file of its own, written by Spark's writer, which commits a task's files once however
often the task is tried.

Defined results: a null or empty text is its end id alone; equal ids (repeated rows)
follow one another in the order of their texts' hashes; null ids come first; very
long documents are never split over shards; an empty table gives an empty result;
other columns are ignored.  Ids of documents are integers.
"""

from __future__ import annotations

import struct
import zlib
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.caching import CACHE_BYTES
from tessera.llm.store import Workspace
from tessera.llm.word_ids import encoder

MAGIC = b"TWM2"
#: A shard is closed when it holds at least so many ids.
SHARD_TOKENS = 1 << 20
#: Bits of a compressed block, and per entry of its rank directory.
BLOCK_BITS, RANK_BITS = 1 << 16, 1 << 9
CELLS = BLOCK_BITS // RANK_BITS
#: Inflated blocks that a plane keeps for lookups.
HELD_BLOCKS = 8
END_ID = 2

_ONES = np.bitwise_count(np.arange(256, dtype=np.uint8))


class Plane:
    """A bit vector in compressed blocks, with rank and select.

    ``ones`` holds the ones before each block and, last, all ones.
    """

    def __init__(self, n: int, ones: np.ndarray, blocks: list):
        self.n, self.ones, self.blocks = n, ones, blocks
        self.held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.inflated = 0

    @classmethod
    def build(cls, bits: np.ndarray) -> "Plane":
        n, count = len(bits), -(-len(bits) // BLOCK_BITS)
        if not n:
            return cls(0, np.zeros(1, "<u4"), [])
        packed = np.zeros(count * BLOCK_BITS // 8, np.uint8)
        packed[: -(-n // 8)] = np.packbits(bits)
        cells = np.bitwise_count(packed.view(np.uint64)).reshape(count, CELLS, -1).sum(axis=2, dtype=np.int64)
        before = np.cumsum(cells, axis=1)
        ones = np.concatenate(([0], np.cumsum(before[:, -1])))
        directory = np.concatenate((np.zeros((count, 1), np.int64), before[:, :-1]), axis=1).astype("<u2")
        compress = zstandard.ZstdCompressor(level=1).compress
        body = packed.reshape(count, -1)
        return cls(n, ones.astype("<u4"), [compress(body[i].tobytes() + directory[i].tobytes()) for i in range(count)])

    def _inflate(self, block: int) -> tuple[np.ndarray, np.ndarray]:
        """Packed bits and rank directory of a block."""
        self.inflated += 1
        data = zstandard.ZstdDecompressor().decompress(self.blocks[block])
        return np.frombuffer(data, np.uint8, BLOCK_BITS // 8), np.frombuffer(data, "<u2", CELLS, BLOCK_BITS // 8)

    def _block(self, block: int) -> tuple[np.ndarray, np.ndarray]:
        found = self.held.get(block)
        if found is None:
            if len(self.held) >= HELD_BLOCKS:
                self.held.pop(next(iter(self.held)))
            found = self.held[block] = self._inflate(block)
        return found

    def bits(self) -> np.ndarray:
        if not self.blocks:
            return np.zeros(0, bool)
        return np.unpackbits(np.concatenate([self._inflate(i)[0] for i in range(len(self.blocks))]), count=self.n).view(bool)

    def get(self, i: int) -> int:
        return int(self._block(i // BLOCK_BITS)[0][i % BLOCK_BITS >> 3]) >> (7 - (i & 7)) & 1

    def rank1(self, i: int) -> int:
        """Ones before place i."""
        block, inside = divmod(i, BLOCK_BITS)
        if not inside:
            return int(self.ones[block])
        packed, directory = self._block(block)
        cell = inside // RANK_BITS
        out = int(self.ones[block]) + int(directory[cell]) + int(_ONES[packed[cell * RANK_BITS // 8 : inside >> 3]].sum())
        return out + (int(packed[inside >> 3]) >> (8 - (inside & 7))).bit_count() if inside & 7 else out

    def rank(self, bit: int, i: int) -> int:
        return self.rank1(i) if bit else i - self.rank1(i)

    def select(self, bit: int, k: int) -> int:
        """Place of the k-th (from 0) such bit."""
        at = np.minimum(np.arange(len(self.ones), dtype=np.int64) * BLOCK_BITS, self.n)
        before = self.ones.astype(np.int64) if bit else at - self.ones
        block = int(np.searchsorted(before, k, "right")) - 1
        packed, directory = self._block(block)
        k -= int(before[block])
        ahead = directory.astype(np.int64) if bit else np.arange(CELLS) * RANK_BITS - directory
        cell = int(np.searchsorted(ahead, k, "right")) - 1
        part = np.unpackbits(packed[cell * RANK_BITS // 8 : (cell + 1) * RANK_BITS // 8])
        return block * BLOCK_BITS + cell * RANK_BITS + int(np.flatnonzero(part == bit)[k - int(ahead[cell])])


class WaveletMatrix:
    """Access, rank and select over a sequence of unsigned integers."""

    def __init__(self, n: int, planes: list[Plane]):
        self.n, self.planes = n, planes

    @classmethod
    def build(cls, values: np.ndarray) -> "WaveletMatrix":
        values = np.asarray(values)
        top = max(1, int(values.max(initial=0)).bit_length())
        values = values.astype(np.uint16 if top <= 16 else np.uint32, copy=False)
        planes = []
        for level in range(top - 1, -1, -1):
            bits = (values & values.dtype.type(1 << level)) != 0
            planes.append(Plane.build(bits))
            values = np.concatenate((np.compress(~bits, values), np.compress(bits, values)))
        return cls(len(values), planes)

    @cached_property
    def zeros(self) -> list[int]:
        return [p.n - int(p.ones[-1]) for p in self.planes]

    def access(self, i: int) -> int:
        out = 0
        for plane, zeros in zip(self.planes, self.zeros):
            bit = plane.get(i)
            out = out << 1 | bit
            i = zeros + plane.rank1(i) if bit else i - plane.rank1(i)
        return out

    def _range(self, value: int, i: int) -> tuple[int, int]:
        lo, hi = 0, i
        for level, (plane, zeros) in zip(range(len(self.planes) - 1, -1, -1), zip(self.planes, self.zeros)):
            bit = value >> level & 1
            lo, hi = plane.rank(bit, lo) + zeros * bit, plane.rank(bit, hi) + zeros * bit
        return lo, hi

    def rank(self, value: int, i: int) -> int:
        """Occurrences of ``value`` before place i."""
        if value >> len(self.planes):
            return 0
        lo, hi = self._range(value, i)
        return hi - lo

    def count(self, value: int) -> int:
        return self.rank(value, self.n)

    def select(self, value: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence of ``value``."""
        if not 0 <= k < self.count(value):
            raise IndexError(k)
        at = self._range(value, self.n)[0] + k
        for level, (plane, zeros) in enumerate(reversed(list(zip(self.planes, self.zeros)))):
            bit = value >> level & 1
            at = plane.select(bit, at - zeros * bit)
        return at

    def decode(self) -> np.ndarray:
        """All values: the planes are undone from the lowest bit upwards."""
        values = np.zeros(self.n, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for level, (plane, zeros) in enumerate(reversed(list(zip(self.planes, self.zeros)))):
            bits = plane.bits()
            above = np.empty_like(values)
            above[np.flatnonzero(~bits)], above[np.flatnonzero(bits)] = values[:zeros], values[zeros:]
            above |= bits.astype(values.dtype) << values.dtype.type(level)
            values = above
        return values.astype(np.uint32, copy=False)


def write_shard(ids: list[int | None], lengths: list[int], values: np.ndarray) -> bytes:
    """The file of a shard: document ids, their lengths, and all token ids in turn.

    A head of four numbers (ids, documents, planes, bytes of the index), the
    compressed index (document table, ones before each block, bytes of each block),
    and the blocks of all planes from the highest bit down.
    """
    planes = WaveletMatrix.build(values).planes
    table = np.array([0 if i is None else i for i in ids], "<i8").tobytes() + np.array([i is None for i in ids], "u1").tobytes() + np.array(lengths, "<u4").tobytes()
    ones = b"".join(p.ones.tobytes() for p in planes)
    sizes = np.array([len(b) for p in planes for b in p.blocks], "<u4").tobytes()
    index = zstandard.ZstdCompressor(level=1).compress(table + ones + sizes)
    return MAGIC + struct.pack("<QIII", len(values), len(ids), len(planes), len(index)) + index + b"".join(b for p in planes for b in p.blocks)


def read_shard(data: bytes) -> tuple[list[int | None], np.ndarray, WaveletMatrix]:
    """Document ids, their lengths and the matrix of a shard file; no block is inflated."""
    if data[:4] != MAGIC:
        raise ValueError("not a shard file")
    n, docs, count, size = struct.unpack_from("<QIII", data, 4)
    index = zstandard.ZstdDecompressor().decompress(data[24 : 24 + size])
    ids = np.frombuffer(index, "<i8", docs).tolist()
    absent = np.frombuffer(index, "u1", docs, 8 * docs)
    lengths = np.frombuffer(index, "<u4", docs, 9 * docs)
    per = -(-n // BLOCK_BITS)
    ones = np.frombuffer(index, "<u4", count * (per + 1), 13 * docs).reshape(count, per + 1)
    sizes = np.frombuffer(index, "<u4", count * per, 13 * docs + 4 * count * (per + 1))
    ends = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))) + 24 + size
    body = memoryview(data)
    blocks = [body[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
    planes = [Plane(n, ones[k], blocks[k * per : (k + 1) * per]) for k in range(count)]
    return [None if a else i for i, a in zip(ids, absent)], lengths, WaveletMatrix(n, planes)


def encoded_ids(docs: DataFrame, tokenizer: str, end_id: int = END_ID, id_column: str = "doc_id", text_column: str = "text", cache_bytes: int = CACHE_BYTES) -> DataFrame:
    """doc_id, tie (the text's hash) and ids, packed, of every row, each with its end id."""

    def run(batches):
        words = encoder(tokenizer, cache_bytes)
        end = np.array([end_id], words.code).tobytes()
        for batch in batches:
            packed = [ids + end for ids in words.pack_column(batch.column(2))]
            width = pa.array([int(words.code[2])] * len(packed), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), width, pa.array(packed, pa.binary())], ["doc_id", "tie", "width", "ids"])

    text = F.col(text_column)
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.xxhash64(text).alias("tie"), text.alias("text")).mapInArrow(run, "doc_id long, tie long, width int, ids binary")


def write_corpus(docs: DataFrame, tokenizer: str, work: Workspace, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Write the shards; returns their table (part, shard, n_tokens, data) as reread."""

    def run(batches):
        part = TaskContext.get().partitionId()
        ids, lengths, held, total, serial, width = [], [], [], 0, 0, 2

        def close():
            data = write_shard(ids, lengths, np.frombuffer(b"".join(held), f"<u{width}"))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([serial], pa.int32()), pa.array([total], pa.int64()), pa.array([data], pa.binary())], ["part", "shard", "n_tokens", "data"])

        for batch in batches:
            for doc_id, width, own in zip(*(batch.column(k).to_pylist() for k in range(3))):
                ids.append(doc_id)
                lengths.append(len(own) // width)
                held.append(own)
                total += len(own) // width
                if total >= shard_tokens:
                    yield close()
                    ids, lengths, held, total, serial = [], [], [], 0, serial + 1
        if ids:
            yield close()

    # Written first: the range partitioning reads its input twice, and no text is encoded twice.
    encoded = work.keep(encoded_ids(docs, tokenizer, end_id, id_column, text_column), "ids")
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie")]
    ordered = encoded.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "width", "ids")
    # A record per file, not compressed again: the file is the shard.
    shards = work.keep(ordered.mapInArrow(run, "part int, shard int, n_tokens long, data binary"), "shards", maxRecordsPerFile=1, compression="uncompressed")
    work.drop(encoded)
    return shards


def read_corpus(shards: DataFrame) -> DataFrame:
    """Per document, from the shard files: doc_id, start, n_tokens, ids_crc32."""

    def run(batches):
        for batch in batches:
            for part, shard, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                ids, lengths, matrix = read_shard(data.as_py())
                raw = matrix.decode().astype("<u4", copy=False).tobytes()
                ends = np.cumsum(lengths, dtype=np.int64)
                at = ends - lengths
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(ids), pa.int32()), pa.array([shard] * len(ids), pa.int32()), pa.array(ids, pa.int64()), pa.array(at), pa.array(lengths.astype(np.int64)), pa.array(crc, pa.int64())],
                    ["part", "shard", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    found = shards.select("part", "shard", "data").mapInArrow(run, "part int, shard int, doc_id long, at long, n_tokens long, ids_crc32 long")
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("in_part"))
    before_part = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("in_part").over(before_part), F.lit(0).cast("long")).alias("part_start"))
    before_shard = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = shards.select("part", "shard", F.coalesce(F.sum("n_tokens").over(before_shard), F.lit(0).cast("long")).alias("shard_start")).join(parts, "part")
    placed = found.join(starts, ["part", "shard"])
    return placed.select("doc_id", (F.col("part_start") + F.col("shard_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def occurrences(shards: DataFrame, token: int) -> DataFrame:
    """part, shard, count and places of one token id, looked up shard by shard."""

    def run(batches):
        for batch in batches:
            for part, shard, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                _, _, matrix = read_shard(data.as_py())
                places = [matrix.select(token, k) for k in range(matrix.count(token))]
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([len(places)], pa.int64()), pa.array([places], pa.list_(pa.int64()))], ["part", "shard", "count", "places"])

    return shards.select("part", "shard", "data").mapInArrow(run, "part int, shard int, count long, places array<long>")

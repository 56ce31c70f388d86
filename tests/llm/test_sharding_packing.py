import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm import packing, sharding, wavelet, word_ids
from tessera.llm.word_ids import ChunkEncoder
from tests.llm.cases import ROWS, cluttered, documents, workspace

WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(WORDS)


def test_shards_have_equal_rows_and_the_mixture(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 50)  # many buckets
    rng = random.Random(3)
    rows = [(i, f"text {i}", "en", rng.choice(["hot"] * 6 + ["a", "b", None]), 1) for i in range(1001)]
    got = sharding.shard(documents(spark, rows), workspace(spark), shards=24).collect()
    per = defaultdict(list)
    for r in got:
        per[r["shard"]].append(r)
    assert sorted(per) == list(range(24)) and {len(v) for v in per.values()} <= {41, 42}
    total = Counter(r[3] for r in rows)
    for own in per.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        for source, n in Counter(r["source"] for r in own).items():
            assert abs(n - total[source] / 24) < 2
    assert all(r["size"] == len(f"text {r['doc_id']}") + 8 and r["text_crc32"] == zlib.crc32(f"text {r['doc_id']}".encode()) for r in got)


def test_shards_do_not_depend_on_buckets(spark, monkeypatch):
    rows = [(i, f"text {i}", "en", "hot" if i % 3 else "b", 1) for i in range(300)]
    one = {(r["doc_id"], r["shard"], r["slot"]) for r in sharding.shard(documents(spark, rows), workspace(spark)).collect()}
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 7)
    assert one == {(r["doc_id"], r["shard"], r["slot"]) for r in sharding.shard(documents(spark, rows), workspace(spark)).collect()}


def test_shards_of_awkward_rows(spark):
    got = sharding.shard(cluttered(spark), workspace(spark), shards=5).collect()
    assert len(got) == len(ROWS) and {r["law"] for r in got} == {"rows"}
    assert Counter(r["shard"] for r in got) == {0: 4, 1: 3, 2: 3, 3: 3, 4: 3}
    assert {(r["size"], r["text_crc32"]) for r in got if r["doc_id"] in (0, 1)} == {(8, 0)}
    assert sharding.shard(documents(spark, []), workspace(spark)).count() == 0


def naive_best_fit(counts, capacity):
    bins = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fitting = [(left, i) for i, left in enumerate(bins) if left >= length]
            if fitting:
                bins[min(fitting)[1]] -= length
            else:
                bins.append(capacity - length)
    return sorted(bins)


@pytest.mark.parametrize("seed", range(40))
def test_best_fit_decreasing_like_one_by_one(seed):
    rng = random.Random(seed)
    capacity, counts = rng.choice([1, 7, 20, 50]), Counter()
    for _ in range(rng.randint(0, 60)):
        counts[rng.randint(1, capacity)] += rng.randint(1, 3)
    runs, n = packing.best_fit_decreasing(counts, capacity)
    fill, ranked = [0] * n, Counter()
    for length, rank, items, first, each, offset in runs:
        assert ranked[length] == rank
        ranked[length] += items
        for k in range(items):
            assert fill[first + k // each] == offset + k % each * length
            fill[first + k // each] += length
    assert ranked == counts and sorted(capacity - f for f in fill) == naive_best_fit(counts, capacity)


def check_packing(rows, texts, tokenizer, capacity):
    by_doc, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    for doc_id, text in texts.items():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        parts = [ids[i : i + 4 * capacity] for i in range(0, len(ids), 4 * capacity)]
        assert [(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in sorted(by_doc[doc_id], key=lambda r: r["piece"])] == [(k, k * capacity, len(p) // 4, zlib.crc32(p)) for k, p in enumerate(parts)]
    return len(sequences)


def test_pack(spark, tokenizer, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 5)
    rng = random.Random(8)
    texts = {i: " ".join(rng.choice(["river", "stone", "Übermut", "x9!"]) for _ in range(rng.choice([0, 1, 5, 20, 90, 200]))) for i in range(150)}
    texts[500] = None
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = packing.pack(df, WORDS, workspace(spark), capacity=64).collect()
    n = check_packing(rows, texts, tokenizer, 64)
    assert n <= 1.05 * -(-sum(r["length"] for r in rows) // 64) + 1


def test_pack_awkward_rows(spark, tokenizer):
    rows = packing.pack(cluttered(spark), WORDS, workspace(spark)).collect()
    texts = {r[0]: r[1] for r in ROWS if r[0] not in (11, None)}
    check_packing([r for r in rows], texts, tokenizer, 2048)
    assert sum(r["doc_id"] == 11 for r in rows) == 2 and sum(r["doc_id"] is None for r in rows) == 1
    assert packing.pack(documents(spark, []), WORDS, workspace(spark)).count() == 0


def test_chunk_encoder_like_the_library(tokenizer):
    own = ChunkEncoder(WORDS, 30_000)  # generations turn over
    texts = [r[1] or "" for r in ROWS] + ["don't 'S it's x'll", "a\x0bb\x0cc", "é ́ é", "ǅ ß ẞ ΐ", "a.,b;c!!! ...", "１２ ½ x²", "<|startoftext|>", "İİ ı", "Ñandú, ÉTÉ. naïve× ª º ǰa ŉ ſs"]
    for text in texts * 2:
        assert np.frombuffer(own.encode(text.encode()), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_long_texts_are_encoded_in_blocks(tokenizer, monkeypatch):
    own, text = ChunkEncoder(WORDS), " ".join(f"Wort{i}," for i in range(400)) + "x" * 300 + "\t\nz"
    whole = tokenizer.encode(text, add_special_tokens=False).ids
    for size in (1, 7, 100, 3000, 1 << 18):
        monkeypatch.setattr(word_ids, "BLOCK_BYTES", size)
        assert np.frombuffer(own.encode(text.encode()), "<u4").tolist() == whole


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        ChunkEncoder(public_tokenizers.path("byte_bpe_50k.json"))


def test_wavelet_matrix():
    rng = np.random.default_rng(1)
    for n, high in ((0, 1), (1, 1), (9, 3), (700, 40), (3000, 50000), (1500, 1 << 20)):
        values = rng.integers(0, high, n).astype(np.uint32)
        data = wavelet.write_shard([3, None], [n // 2, n - n // 2], values)
        ids, lengths, matrix = wavelet.read_shard(data)
        assert ids == [3, None] and lengths.tolist() == [n // 2, n - n // 2]
        assert np.array_equal(matrix.decode(), values)
        for i in range(0, n, 13):
            v = int(values[i])
            assert matrix.access(i) == v
            assert matrix.rank(v, i) == (values[:i] == v).sum()
            assert matrix.select(v, matrix.rank(v, i)) == i
        assert matrix.count(1 << 30) == 0
        with pytest.raises(IndexError):
            matrix.select(0, n + 1)
    with pytest.raises(ValueError):
        wavelet.read_shard(b"none")


def test_lookups_inflate_only_the_blocks_they_touch():
    rng = np.random.default_rng(2)
    n = 10 * wavelet.BLOCK_BITS + 77
    values = rng.integers(0, 1 << 10, n).astype(np.uint16)
    matrix = wavelet.read_shard(wavelet.write_shard([1], [n], values))[2]
    assert not any(p.inflated for p in matrix.planes) and len(matrix.planes[0].blocks) == 11
    assert matrix.access(n // 2) == values[n // 2]
    assert all(p.inflated <= 2 for p in matrix.planes)
    token = int(values[5])
    places = np.flatnonzero(values == token)
    assert matrix.count(token) == len(places)
    assert [matrix.select(token, k) for k in (0, 7, len(places) - 1)] == [places[0], places[7], places[-1]]
    assert all(p.inflated <= 9 for p in matrix.planes)


def test_a_shard_is_a_file(spark):
    df = spark.createDataFrame([(i, f"river {i} stone") for i in range(200)], "doc_id long, text string")
    shards = wavelet.write_corpus(df, WORDS, workspace(spark), shard_tokens=100)
    files = shards.selectExpr("_metadata.file_path AS file", "part", "shard").collect()
    assert len(files) > 5 and len({r["file"] for r in files}) == len(files)


def test_corpus_round_trip(spark, tokenizer):
    rng = random.Random(2)
    texts = {i * 3: " ".join(rng.choice(["river", "stone", "x9!"]) for _ in range(rng.randint(0, 80))) for i in range(120)}
    texts[1] = None
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    shards = wavelet.write_corpus(df, WORDS, workspace(spark), shard_tokens=500)
    assert shards.count() > 5
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in wavelet.read_corpus(shards).collect()}
    at, want, stones = 0, {}, 0
    for doc_id in sorted(texts):
        ids = [*tokenizer.encode(texts[doc_id] or "", add_special_tokens=False).ids, 2]
        want[doc_id] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        stones += ids.count(tokenizer.encode("stone", add_special_tokens=False).ids[0])
        at += len(ids)
    assert got == want
    token = tokenizer.encode("stone", add_special_tokens=False).ids[0]
    found = wavelet.occurrences(shards, token).collect()
    assert sum(r["count"] for r in found) == stones and all(len(r["places"]) == r["count"] for r in found)


def test_corpus_awkward_rows(spark):
    rows = wavelet.read_corpus(wavelet.write_corpus(cluttered(spark), WORDS, workspace(spark))).collect()
    assert len(rows) == len(ROWS)
    ordered = sorted(rows, key=lambda r: r["start"])
    assert [r["doc_id"] for r in ordered] == [None, *sorted(r[0] for r in ROWS if r[0] is not None)]
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(ordered, ordered[1:]))
    assert wavelet.read_corpus(wavelet.write_corpus(documents(spark, []), WORDS, workspace(spark))).count() == 0

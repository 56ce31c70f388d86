import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models, pre_tokenizers

from tessera.llm import byte_bpe, unigram_count
from tessera.llm.caching import GenerationCache
from tests.llm.cases import ROWS, cluttered, documents

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["  \n\t x", "'s 'LL don't", "  x\x0b\x1c\x85y", "日本語テキスト" * 30, "<|endoftext|> z", "🙂🙃" * 9, "\u0301a \u0301", " " * 777 + "x", "\r\n\r\n  a", "ab" * 4000]


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=byte_bpe.load_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def bpe():
    return byte_bpe.codec(RANKS, PATTERN)


def test_byte_bpe_like_the_library(bpe, reference):
    for text in [r[1] or "" for r in ROWS] + ODD:
        ids = bpe.encode(text)
        assert ids == reference.encode_ordinary(text)
        assert bpe.decode(ids) == text.encode()


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_byte_bpe_any_text(text):
    bpe = byte_bpe.codec(RANKS, PATTERN)
    reference = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    assert bpe.encode(text) == reference.encode_ordinary(text)


def test_merge_of_random_bytes():
    """Against merging the first pair of least rank by scanning."""
    rng = random.Random(4)
    ranks = {bytes([i]): i for i in range(256)}
    for _ in range(300):
        token = bytes(rng.choices(b"abc", k=rng.randint(2, 6)))
        ranks.setdefault(token, len(ranks))
    own = byte_bpe.ByteBpe(ranks, r"(?s).+")
    for _ in range(300):
        piece = bytes(rng.choices(b"abcd", k=rng.randint(1, 40)))
        parts = [bytes([b]) for b in piece]
        while piece not in ranks and len(parts) > 1:
            found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
            if not found:
                break
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        want = [ranks[piece]] if piece in ranks else [ranks[p] for p in parts]
        assert own.merge(piece) == want


def test_pair_tree():
    rng = random.Random(5)
    ranks = [rng.choice([None, 1, 2, 3, 9]) for _ in range(37)]
    tree = byte_bpe.PairTree(ranks)
    for _ in range(500):
        live = [(r, i) for i, r in enumerate(ranks) if r is not None]
        assert tree.first() == (min(live)[1] if live else None)
        at = rng.randrange(37)
        ranks[at] = rng.choice([None, 0, 1, 5])
        tree.put(at, ranks[at])
    assert byte_bpe.PairTree([None]).first() is None


def test_round_trip_query(spark, reference):
    got = byte_bpe.round_trip_digests(cluttered(spark), RANKS, PATTERN).collect()
    texts = {r[0]: r[1] or "" for r in ROWS}
    assert len(got) == len(ROWS)
    for r in got:
        ids = reference.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    assert byte_bpe.round_trip_digests(documents(spark, []), RANKS, PATTERN).count() == 0


def test_encode_and_decode_columns(spark):
    encoded = byte_bpe.encode_column(documents(spark), RANKS, PATTERN)
    back = byte_bpe.decode_column(encoded, RANKS, PATTERN).collect()
    texts = {r[0]: r[1] or "" for r in ROWS}
    assert all(bytes(r["data"]) == texts[r["doc_id"]].encode() for r in back) and len(back) == len(ROWS)


def test_small_caches_change_nothing(reference):
    own = byte_bpe.ByteBpe(byte_bpe.load_ranks(RANKS), PATTERN, 1 << 16)
    for text in ODD[:6] * 2:
        assert own.encode(text) == reference.encode_ordinary(text)


def unigram(vocabulary):
    out = Tokenizer(models.Unigram(vocabulary, 0, True))
    out.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.Metaspace()])
    return out


def test_unigram_counts_like_the_library():
    vocabulary = unigram_count.load_vocabulary(PIECES)
    own, reference = unigram_count.UnigramCounter(vocabulary), unigram(vocabulary)
    for text in [r[1] or "" for r in ROWS] + ODD + ["▁a ▁▁ b▁c", "<s> <0x41>"]:
        assert own.text(text.encode())[0] == len(reference.encode(text, add_special_tokens=False).ids), text[:50]


@pytest.mark.parametrize("seed", range(60))
def test_unigram_ties(seed):
    rng = random.Random(seed)
    letters = "abcé▁"
    vocabulary = [("<unk>", 0.0)] + [(f"<0x{i:02X}>", 0.0) for i in range(256)]
    vocabulary += list({"".join(rng.choices(letters, k=rng.randint(1, 4))): rng.choice([-1.0, -2.0, -3.0, -1.5]) for _ in range(25)}.items())
    own, reference = unigram_count.UnigramCounter(vocabulary), unigram(vocabulary)
    for _ in range(25):
        text = "".join(rng.choices(letters + "d日 ", k=rng.randint(0, 14)))
        assert own.text(text.encode())[0] == len(reference.encode(text, add_special_tokens=False).ids), text


def test_unigram_query(spark):
    reference = unigram(unigram_count.load_vocabulary(PIECES))
    got = unigram_count.count_tokens(cluttered(spark), PIECES).collect()
    texts = {r[0]: r[1] or "" for r in ROWS}
    assert len(got) == len(ROWS)
    assert all(r["n_tokens"] == len(reference.encode(texts[r["doc_id"]], add_special_tokens=False).ids) for r in got)
    assert unigram_count.count_tokens(documents(spark, []), PIECES).count() == 0


def test_unigram_unknown_characters():
    """Unknown characters count one piece per byte: the mark has three, z has one."""
    own = unigram_count.UnigramCounter([("<unk>", 0.0), ("▁a", -1.0), ("b", -2.0)], 1 << 16)
    assert own.text(b"a") == (1, 0) and own.text(b"ab") == (2, 0)
    assert own.text(b"zz") == (3 + 1 + 1, 3)
    assert own.text(b"a ab zz") == (1 + 2 + 5, 3)
    assert own.text(b"") == own.text(b" \n") == (0, 0)


def test_caches_keep_to_their_bytes():
    made = []
    cache = GenerationCache(lambda key: made.append(key) or key * 2, 100_000, lambda key, value: len(key) + len(value))
    for i in range(5000):
        assert cache[f"key {i}"] == f"key {i}" * 2
        assert cache.held <= 50_000 and len(cache) + len(cache.older) <= 100_000 // 60
    made.clear()
    assert cache["key 4999"] and not made
    assert cache["x" * 9000] == "x" * 18000 and "x" * 9000 not in cache
    before = made.copy()
    assert cache["x" * 9000] and made == before + ["x" * 9000]

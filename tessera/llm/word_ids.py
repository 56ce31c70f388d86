"""Ids of a word-level public tokenizer, encoded once per distinct word.

The tokenizer of this kind drops white space and never joins characters across
it, so a text's ids are those of its white-space chunks one after another.  Two
caches bounded in bytes hold ids as packed integers: of chunks as they stand in
texts, and of lower-cased words without the marks around them, which many chunks share.
Chunks of plain Latin letters, digits and marks need no normaliser but lower case
and go to the merges directly; all others go through the whole tokenizer.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex

from tessera.llm.caching import CACHE_BYTES, BytesCache, owned

#: A longer text is encoded in blocks of about so many bytes, cut at white space.
BLOCK_BYTES = 1 << 18

#: No white space, controls or combining marks: composed already, one case rule.
_PLAIN = regex.compile(r"[!-~¡-ʯ]+").fullmatch
#: One Latin word (but for the dotted capital I, which lower case takes apart) and a mark.
_LATIN = re.compile("([A-Za-zÀ-ÖØ-öø-įı-ʯ]+)([.,;:!?]?)").fullmatch
_MARKS = b".,;:!?"
_BREAK = re.compile(rb"[\t-\r ]").search

# What the tokenizer's file has to say for the shortcuts to hold.
NORMALIZER = ["NFC", "Replace", "Lowercase"]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _byte_letters() -> list[str]:
    """The printable letter that byte-level models use for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def check_spec(spec: dict) -> str:
    """The splitting pattern of a tokenizer file of this kind; an error for another."""
    steps = [step["type"] for step in (spec["normalizer"] or {}).get("normalizers", [])]
    splits = [p for p in (spec["pre_tokenizer"] or {}).get("pretokenizers", []) if p["type"] == "Split"]
    if spec["model"]["type"] != "BPE" or steps != NORMALIZER or len(splits) != 1 or splits[0]["pattern"].get("Regex") != SPLIT:
        raise ValueError("not a lower-casing word tokenizer: its texts cannot be encoded chunk by chunk")
    return splits[0]["pattern"]["Regex"]


class ChunkEncoder:
    """Ids of texts, as little-endian integers of ``code`` (two bytes where they do)."""

    def __init__(self, path: str, limit: int = CACHE_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        with open(path) as lines:
            spec = json.load(lines)
        self.special = tuple(t["content"] for t in spec["added_tokens"])
        self.split = regex.compile(check_spec(spec)).findall
        self.letters = _byte_letters()
        size = self.tokenizer.get_vocab_size()
        self.code = "<u2" if size <= 1 << 16 else "<u4"
        self.ids_of = [np.array([i], self.code).tobytes() for i in range(size)]
        self.words = BytesCache(self._word, 2 * limit // 3)
        self.chunks = BytesCache(self._chunk, limit // 3)

    def _word(self, word: bytes) -> bytes:
        """Ids of one lower-cased word, digit or run of marks."""
        tokens = self.merge(word.decode() if word.isascii() else "".join([self.letters[b] for b in word]))
        if len(tokens) == 1:
            return self.ids_of[tokens[0].id]
        ids_of = self.ids_of
        return b"".join([ids_of[t.id] for t in tokens])

    def _chunk(self, chunk: bytes) -> bytes:
        if chunk.isalpha():  # ASCII letters
            return self.words[chunk.lower()]
        if chunk[-1] in _MARKS and chunk[:-1].isalpha():
            return self.words[chunk[:-1].lower()] + self.words[chunk[-1:]]
        text = chunk.decode()
        if found := _LATIN(text):
            word, mark = found.groups()
            ids = self.words[word.lower().encode()]
            return ids + self.words[mark.encode()] if mark else ids
        if _PLAIN(text) and not any(s in text for s in self.special):
            return b"".join([self.words[w.encode()] for w in self.split(text.lower())])
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.code).tobytes()

    def pack(self, text: bytes) -> bytes:
        """Ids of the whole text as integers of ``code``."""
        of = self.chunks.__getitem__
        if len(text) <= BLOCK_BYTES:
            return b"".join(map(of, text.split()))
        out, at = [], 0
        while at < len(text):
            cut = _BREAK(text, at + BLOCK_BYTES)
            end = cut.start() if cut else len(text)
            out.append(b"".join(map(of, text[at:end].split())))
            at = end
        return b"".join(out)

    def encode(self, text: bytes) -> bytes:
        """Ids of the whole text as little-endian unsigned 32-bit integers."""
        packed = self.pack(text)
        return packed if self.code == "<u4" else np.frombuffer(packed, self.code).astype("<u4").tobytes()

    def pack_column(self, column) -> Iterator[bytes]:
        """``pack`` of every text of an Arrow string column (null: empty)."""
        for text in column.cast(pa.large_binary()):
            yield self.pack(text.as_py() or b"")

    def encode_column(self, column) -> Iterator[bytes]:
        """``encode`` of every text of an Arrow string column (null: empty)."""
        for text in column.cast(pa.large_binary()):
            yield self.encode(text.as_py() or b"")


def encoder(path: str, limit: int = CACHE_BYTES) -> ChunkEncoder:
    """The encoder of a tokenizer file, loaded once per process."""
    table = owned("words")
    if (path, limit) not in table:
        table[path, limit] = ChunkEncoder(path, limit)
    return table[path, limit]

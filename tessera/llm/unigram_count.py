"""Count-only unigram tokenization.

An Aho-Corasick automaton lists all vocabulary matches of a word; the best path is
carried as (score, pieces) only, no path is kept.  The rules are those of the
tokenizers library's Unigram model with byte fallback, behind a split at white
space and a word mark before each word:

* a longer piece wins a tie of scores, since starts are tried from the left and a
  later one has to score strictly more;
* a character that no single-character piece covers may be unknown, at the least
  score of the vocabulary less 10, and counts one piece per UTF-8 byte.

Distinct chunks are counted once and kept in a cache bounded in bytes.

Defined results: null, empty and blank texts have no pieces; texts are counted
whole; repeated rows count alike; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.caching import CACHE_BYTES, GenerationCache, owned

MARK = "▁"
UNKNOWN_PENALTY = 10.0
_PARTS = regex.compile(f"{MARK}[^{MARK}]*").findall
_WORDS = regex.compile(r"\P{White_Space}+").findall


def load_vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) of a sentencepiece model file, in id order."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class UnigramCounter:
    def __init__(self, vocabulary: list[tuple[str, float]], limit: int = CACHE_BYTES):
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((score for _, score in vocabulary), default=0.0) - UNKNOWN_PENALTY
        #: chunk -> pieces, and unknown characters above bit 40
        self.chunks = GenerationCache(lambda c: (n := self.chunk(c.decode()))[0] | n[1] << 40, limit, lambda chunk, _: 72 + len(chunk))

    def word(self, word: str) -> tuple[int, int, float]:
        """(pieces, unknown characters, score) of the best path of a marked word."""
        n, none = len(word), float("-inf")
        best, pieces, unknown = [0.0] + [none] * n, [0] * (n + 1), [0] * (n + 1)
        done = 0  # ends up to here are settled
        single = False
        for last, (length, own) in self.automaton.iter(word):
            end = last + 1
            if end != done:
                if done and not single:
                    self._unknown(word, done, best, pieces, unknown)
                for gap in range(done + 1, end):  # no match ends here
                    self._unknown(word, gap, best, pieces, unknown)
                done, single = end, False
            start = end - length  # the leftmost start comes first
            got = own + best[start]
            if got > best[end]:
                best[end], pieces[end], unknown[end] = got, pieces[start] + 1, unknown[start]
            single |= length == 1
        if done and not single:
            self._unknown(word, done, best, pieces, unknown)
        for gap in range(done + 1, n + 1):
            self._unknown(word, gap, best, pieces, unknown)
        return pieces[n], unknown[n], best[n]

    def _unknown(self, word: str, end: int, best: list, pieces: list, unknown: list) -> None:
        """The character before ``end`` as an unknown one, if that scores more."""
        got = self.unknown + best[end - 1]
        if got > best[end]:
            best[end], pieces[end], unknown[end] = got, pieces[end - 1] + len(word[end - 1].encode()), unknown[end - 1] + 1

    def chunk(self, chunk: str) -> tuple[int, int]:
        pieces = unknown = 0
        for word in _WORDS(chunk):
            # the word mark always starts a word of its own
            for part in _PARTS(word if word.startswith(MARK) else MARK + word):
                a, b, _ = self.word(part)
                pieces += a
                unknown += b
        return pieces, unknown

    def text(self, text: bytes) -> tuple[int, int]:
        """(pieces, unknown characters) of a text."""
        total = sum(map(self.chunks.__getitem__, text.split()))
        return total & (1 << 40) - 1, total >> 40


def counter(path: str) -> UnigramCounter:
    """The counter of a vocabulary file, loaded once per process."""
    table = owned("unigrams")
    if path not in table:
        table[path] = UnigramCounter(load_vocabulary(path))
    return table[path]


def count_tokens(docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_tokens and n_unknown (characters) of every row."""

    def run(batches):
        count = counter(vocabulary).text
        for batch in batches:
            found = np.array([count(t.as_py() or b"") for t in batch.column(1).cast(pa.large_binary())], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found[:, 0]), pa.array(found[:, 1])], ["doc_id", "n_tokens", "n_unknown"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column), F.col(text_column)).mapInArrow(run, f"doc_id {kind}, n_tokens long, n_unknown long")
